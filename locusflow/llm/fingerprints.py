"""Document fingerprints by one-permutation MinHash, with DataFrame functions only.

Word shingles are hashed once; the top seven bits of a hash are its bin, the rest
its rank, and a bin keeps its least rank. An empty bin copies the bin that comes
first in its own pseudo-random order of all bins (optimal densification: every
empty bin probes independently, and equal occupancy gives equal probes). The low
eight bits of each bin are stored, two hex digits a bin. The share of equal bins
is corrected for bins that agree by chance.

Defined cases: a null text is the empty text; white space is ``\\s``, words are
lower-cased, fewer words than a shingle are one shingle; a text without words has
the fingerprint '' (like another of its kind by 1, any other text by 0). The next
document goes by descending doc_id, nulls last, ties by a hash of the text; rows
with equal doc_id and text count as one in that order and have equal results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, text_of

BINS, RANK_BITS, KEPT_BITS = 128, 56, 8
SHINGLE = 5
_NO_ID = -(1 << 63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def shingle_hashes(text: Column, width: int = SHINGLE) -> Column:
    """63-bit hashes of the text's word shingles; fewer words than width are one shingle."""
    words = F.array_remove(F.split(F.lower(text), r"\s+"), "")

    def of(hashed: Column) -> Column:
        run = F.transform(F.slice(hashed, 1, F.size(hashed) - (width - 1)), lambda h, i: F.shiftrightunsigned(F.xxhash64(h, *(hashed[i + k] for k in range(1, width))), 1))
        whole = F.array(F.shiftrightunsigned(F.xxhash64(F.array_join(F.transform(hashed, lambda h: h.cast("string")), " ")), 1))
        return F.when(F.size(hashed) >= width, run).when(F.size(hashed) > 0, whole).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def _bin(x: Column) -> Column:
    return F.shiftright(x, RANK_BITS).cast("int")


def minima(hashes: Column) -> Column:
    """The least hash of each bin that has any, by bin."""
    return let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: (i == 0) | (F.shiftright(x, RANK_BITS) != F.shiftright(s[F.greatest(i - 1, F.lit(0))], RANK_BITS))))


def densified(mins: Column) -> Column:
    """BINS values of KEPT_BITS bits, in the order of the bins; none for no minima."""
    low = (1 << KEPT_BITS) - 1

    def of(m: Column) -> Column:
        own = F.transform(m, lambda x: _bin(x) * (low + 1) + x.bitwiseAND(F.lit(low)).cast("int"))
        empty = F.array_except(F.sequence(F.lit(0), F.lit(BINS - 1)), F.transform(m, _bin))
        probe = lambda e: F.array_min(F.transform(m, lambda x: F.xxhash64(e, _bin(x)).bitwiseAND(F.lit(~low)).bitwiseOR(x.bitwiseAND(F.lit(low)))))
        copied = F.transform(empty, lambda e: e * (low + 1) + probe(e).bitwiseAND(F.lit(low)).cast("int"))
        filled = F.transform(F.sort_array(F.concat(own, copied)), lambda v: v.bitwiseAND(F.lit(low)))
        return F.when(F.size(m) > 0, filled).otherwise(F.array().cast("array<int>"))

    return let(mins, of)


def fingerprint(text: Column, width: int = SHINGLE) -> Column:
    """array<int> of BINS values, or of none."""
    return densified(minima(shingle_hashes(text, width)))


def packed(values: Column) -> Column:
    """The values as hex digits."""
    return F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v), KEPT_BITS // 4, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of two fingerprints, 0 to 1."""
    chance = 2.0**-KEPT_BITS
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(BINS))
    both = F.greatest((same - chance) / (1 - chance), F.lit(0.0))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both).otherwise((F.size(a) == F.size(b)).cast("double"))


def with_key(docs: DataFrame) -> DataFrame:
    """text and a key: __lf_id never null, __lf_hash of the text and of whether doc_id is null (none)."""
    doc_id = F.col("doc_id").cast("long")
    text = text_of()
    return docs.select(text.alias("text"), F.coalesce(doc_id, F.lit(_NO_ID)).alias("__lf_id"), F.xxhash64(text, doc_id.isNull()).alias("__lf_hash"), doc_id.isNull().alias("none"))


def next_documents(keyed: DataFrame) -> DataFrame:
    """(id, hash, none, chars, next_id, next_hash) of each distinct key, in descending order, the last one's next being the first.

    The order is found within range partitions; only the partitions' first keys,
    one row each, are ordered in one place.
    """
    keys = keyed.select(F.col("__lf_id").alias("id"), F.col("__lf_hash").alias("hash"), F.length("text").alias("chars"), "none").distinct()
    order = [F.asc("none"), F.desc("id"), F.asc("hash")]
    ranged = materialise(keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "fingerprint-order")
    head = F.min(F.struct("none", F.bitwise_not("id").alias("down"), "hash", "id")).alias("head")
    heads = ranged.groupBy("part").agg(head)
    ends = Window.orderBy("part")
    first = F.first("head").over(ends.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("part"), F.coalesce(F.lead("head").over(ends), first).alias("after"))
    within = Window.partitionBy("part").orderBy(*order)
    after = ranged.withColumn("next", F.lead(F.struct("id", "hash")).over(within)).join(F.broadcast(heads), "part")
    return after.select("id", "hash", "none", "chars", F.coalesce("next.id", "after.id").alias("next_id"), F.coalesce("next.hash", "after.hash").alias("next_hash"))


def edited_fingerprints(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Each document and its edited text, whose last third comes from the next document.

    doc_id, text, edited_text, fingerprint, edited_fingerprint (hex), near_edited, near_next.
    """
    keyed = with_key(docs)
    nexts = next_documents(keyed)
    # both joins read the same columns by the same key, so texts are shuffled once
    texts = keyed.select("text", "__lf_id", "__lf_hash")
    asked = nexts.join(texts, (F.col("next_id") == F.col("__lf_id")) & (F.col("next_hash") == F.col("__lf_hash")))
    third = F.floor(F.col("chars") / 3).cast("int").alias("__lf_third")
    put = F.expr("substring(text, 1, cast(chars div 3 as int))").alias("__lf_put")
    given = asked.select("id", "hash", "none", put, third, fingerprint(F.col("text"), width).alias("__lf_next"))
    # the next document may stand in several equal rows
    nth = F.row_number().over(Window.partitionBy("id", "hash").orderBy("none"))
    given = given.withColumn("__lf_nth", nth).where("__lf_nth = 1")
    both = texts.join(given, (F.col("__lf_id") == F.col("id")) & (F.col("__lf_hash") == F.col("hash")))
    both = both.withColumn("edited_text", F.concat(F.expr("substring(text, 1, length(text) - __lf_third)"), F.col("__lf_put")))
    both = both.withColumn("__lf_own", fingerprint(F.col("text"), width)).withColumn("__lf_edited", fingerprint(F.col("edited_text"), width))
    return both.select(
        F.when(~F.col("none"), F.col("id")).alias("doc_id"),
        "text",
        "edited_text",
        packed(F.col("__lf_own")).alias("fingerprint"),
        packed(F.col("__lf_edited")).alias("edited_fingerprint"),
        likeness(F.col("__lf_own"), F.col("__lf_edited")).alias("near_edited"),
        likeness(F.col("__lf_own"), F.col("__lf_next")).alias("near_next"),
    )
