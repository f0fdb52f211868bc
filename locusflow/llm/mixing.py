"""Mixing sources to target weights, with DataFrame functions only.

Each source's words, document after document in a pseudo-random order, are one
stream that is cut into blocks of a fixed number of words. The mix is a row of
output shards of a fixed number of slots. Every slot of a shard draws a source with
the probability of its target (a multinomial draw of the shard's source counts), and
a source's slots are numbered through all shards. Draws of a source beyond its
quota of blocks are then settled: they go to the sources that drew too few, so that
totals meet the targets at any size and no block is taken more often than the cap
allows. Slot number n of a source with m blocks is block p(n mod m), where p is a
pseudo-random permutation of 0..m-1 of its own for each source and turn n div m.
Slots and blocks are joined by (source, block).

The permutation is swap-or-not: each round pairs x with k - x modulo m and a hash
bit of the pair says whether they change places. It needs no table, works for
any m and gives every row of a slot its block without a look at the others.

Scale: streams are laid out by sums within range partitions, so a source that holds
a third of all rows is many tasks' work; a block is at most as many pieces as it has
words. Sources are looked up through 65 536 equal cells of their cumulated
quotas, by an equi-join. Tables of sources and cells are broadcast if they are
counted to be small, else joined by a shuffle.

Defined cases: a null or empty text has size 0 and is taken 0 times; a null source is a
source of its own, the last one, and an empty one another; rows that repeat a doc_id
are documents each (rows that are equal in doc_id, source and size may change places);
without any word all targets are 0; an empty table gives an empty table. Only doc_id,
text and source are read, so other columns can't clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_ranges, light, materialise, running_totals, spread, text_of

WORD = r"[^\x20\x09-\x0D]+"
CELLS = 1 << 16
ROUNDS = 16


@dataclass(frozen=True)
class Mix:
    """weights: of the sources in their order, repeating; percent: of all words, to be taken; most: times a word is taken at most."""

    weights: tuple[int, ...] = (5, 2, 1)
    percent: int = 150
    most: int = 2
    block_words: int = 64
    shard_slots: int = 8192
    seed: int = 2024


def source_targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """(source, source_size) with source_no, target, blocks and quota (blocks that the mix takes).

    Caps are reached in the order of cap over weight: a source is capped if its share of
    what the sources before it leave is its cap or more.
    """
    weights = F.array(*(F.lit(float(w)) for w in mix.weights))
    everything, up_to = Window.partitionBy(), Window.partitionBy().orderBy(F.col("cap") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    numbered = sizes.withColumn("source_no", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    numbered = numbered.withColumn("weight", weights[F.col("source_no") % len(mix.weights)]).withColumn("cap", F.col("source_size") * float(mix.most))
    total = F.sum("source_size").over(everything) * (mix.percent / 100)
    left = total - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))
    of = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(up_to), F.lit(0.0))
    capped = numbered.withColumn("capped", F.col("cap") * of <= F.col("weight") * left)
    left = total - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    of = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    met = capped.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(left * F.col("weight") / of))
    met = met.withColumn("blocks", F.ceil(F.col("source_size") / mix.block_words))
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size") * F.col("blocks")).otherwise(0.0)
    return met.withColumn("quota", F.least(F.round(share).cast("long"), mix.most * F.col("blocks"))).select("source", "source_no", "source_size", "target", "blocks", "quota")


def from_zero(df: DataFrame, length: str, lo: str) -> DataFrame:
    """df, one row a source, with lo: the sum of length over the sources before."""
    ahead = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(lo, F.coalesce(F.sum(length).over(ahead), F.lit(0)))


def whole(x: Column, n: Column) -> Column:
    """x divided by n, rounded down, for whole numbers below 2**53."""
    return ((x - F.pmod(x, n)) / n).cast("long")


def in_intervals(points: DataFrame, point: str, intervals: DataFrame, lo: str, length: str, total: int) -> DataFrame:
    """points with the columns of the interval [lo, lo + length) that holds each; all intervals together are [0, total)."""
    wide = F.lit(total // CELLS + 1)
    parts = F.sequence(whole(F.col(lo), wide), whole(F.col(lo) + F.col(length) - 1, wide))
    # an interval has CELLS parts at most, all of them together CELLS and one for each interval
    cells = materialise(intervals.where(F.col(length) > 0).withColumn("cell", F.explode(parts)), "mix-cells")
    met = points.withColumn("cell", whole(F.col(point), wide)).join(light(cells), "cell")
    return met.where((F.col(lo) <= F.col(point)) & (F.col(point) < F.col(lo) + F.col(length))).drop("cell", lo)


def permuted(x: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """The place of x in the key's pseudo-random permutation of 0..n-1."""

    def turn(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(key, r), n) - at, n)
        swap = F.xxhash64(key, r, F.greatest(at, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(swap, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), x, turn)


def drawn_slots(sources: DataFrame, mix: Mix) -> DataFrame:
    """(shard, source_no, slot, turn, block): the mix, each source's slots numbered from 0 to its quota."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("quota")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = spark.range(0, total, 1, tasks).select(whole(F.col("id"), F.lit(mix.shard_slots)).alias("shard"), F.pmod(F.xxhash64("id", F.lit(mix.seed)), F.lit(max(total, 1))).alias("draw"))
    quotas = from_zero(sources.select("source_no", "quota"), "quota", "lo")
    drawn = in_intervals(ids, "draw", quotas, "lo", "quota", total)
    counts = materialise(drawn.groupBy("shard", "source_no").agg(F.count(F.lit(1)).alias("n")), "mix-counts")

    # a source's draws beyond its quota, and what it lacks, each laid out from 0
    sums = counts.groupBy("source_no").agg(F.sum("n").alias("had"))
    met = sources.join(sums, "source_no", "left").withColumn("had", F.coalesce("had", F.lit(0)))
    met = met.withColumn("over", F.greatest(F.col("had") - F.col("quota"), F.lit(0))).withColumn("short", F.greatest(F.col("quota") - F.col("had"), F.lit(0)))
    settled = materialise(from_zero(from_zero(met.select("source_no", "blocks", "quota", "had", "over", "short"), "over", "over_lo"), "short", "short_lo"), "mix-settled")

    # shards in a hashed order, so that draws beyond a quota are spread over all shards
    ahead = Window.partitionBy("source_no").orderBy(F.xxhash64("shard"), "shard").rowsBetween(Window.unboundedPreceding, -1)
    runs = counts.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    runs = runs.join(light(settled.select("source_no", "quota", "over_lo")), "source_no")
    # a run becomes shard_slots rows at most; runs are dealt anew, so that a source's slots are many tasks' work
    slots = spread(runs, "shard", "source_no").select("shard", "source_no", "quota", "over_lo", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("slot"))  # shard_slots at most
    kept = slots.where("slot < quota").select("shard", "source_no", "slot")
    over = slots.where("slot >= quota").select("shard", (F.col("over_lo") + F.col("slot") - F.col("quota")).alias("nth"))
    lacks = settled.select("source_no", "had", "short", "short_lo", F.col("short_lo").alias("from"))
    moved = in_intervals(over, "nth", lacks, "short_lo", "short", settled.agg(F.sum("short")).first()[0] or 0)
    moved = moved.select("shard", "source_no", (F.col("had") + F.col("nth") - F.col("from")).alias("slot"))

    both = kept.unionByName(moved).join(light(settled.select("source_no", "blocks")), "source_no")
    turn = whole(F.col("slot"), F.col("blocks"))
    block = permuted(F.pmod("slot", "blocks"), F.col("blocks"), F.xxhash64(F.lit(mix.seed), F.col("source_no"), turn))
    return both.select("shard", "source_no", "slot", turn.alias("turn"), block.alias("block"))


def block_pieces(sized: DataFrame, mix: Mix) -> DataFrame:
    """(row, doc_id, size, source_no) with block, first (word of the document) and words: what each document gives to the blocks of its source."""
    order = [F.asc("source_no"), F.xxhash64("doc_id", F.lit(mix.seed)).asc(), F.asc("doc_id"), F.asc("size"), F.asc("row")]
    laid = running_totals(in_ranges(sized.where("size > 0"), "mix-order", *order), "size", "at", order, by=("source_no",))
    b, end = F.lit(mix.block_words), F.col("at") + F.col("size")
    cut = laid.withColumn("block", F.explode(F.sequence(whole(F.col("at"), b), whole(end - 1, b))))
    first = F.greatest(F.col("block") * b, F.col("at"))
    words = F.least((F.col("block") + 1) * b, end) - first
    return cut.select("row", "doc_id", "size", "source_no", "block", (first - F.col("at")).alias("first"), words.alias("words"))


def prepared(docs: DataFrame, mix: Mix) -> tuple[DataFrame, DataFrame]:
    """Documents' sizes with the number of their source, and the sources; both written."""
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("long")
    sized = materialise(docs.select("doc_id", "source", size.alias("size"), F.monotonically_increasing_id().alias("row")), "mix-sized")
    sources = materialise(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), mix), "mix-sources")
    named = light(sources.select(F.col("source").alias("__lf_source"), "source_no"))
    return sized.join(named, F.col("source").eqNullSafe(F.col("__lf_source"))).select("doc_id", "size", "row", "source_no"), sources


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: shard, source_no, slot, and the pieces of its block (doc_id, first word, words)."""
    sized, sources = prepared(docs, mix)
    found = drawn_slots(sources, mix).join(block_pieces(sized, mix), ["source_no", "block"])
    return found.select("shard", "source_no", "slot", "doc_id", "first", "words")


def words_taken(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """Every document's doc_id, size, source_size, target (its source's) and taken: the words of it in the mix."""
    sized, sources = prepared(docs, mix)
    times = drawn_slots(sources, mix).groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("times"))
    of = ["row", "doc_id", "size", "source_no"]
    taken = block_pieces(sized, mix).join(times, ["source_no", "block"]).select(*of, (F.col("words") * F.col("times")).alias("taken"))
    every = sized.select(*of, F.lit(0).cast("long").alias("taken")).unionByName(taken)
    done = every.groupBy(*of).agg(F.sum("taken").alias("taken"))
    return done.join(light(sources), "source_no").select("doc_id", "size", "source_size", "target", "taken")
