"""From aligned reads to allele counts and candidate variants.

reads: contig, ref_start, cigar (array of op and len), seq, bq (array of int),
mapq, is_rev, name, mate. reference: contig, chunk, bases, in chunks of CHUNK
bases each followed by those of the next chunk (reference_chunks).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.alleles import DELETION, INSERTION, REFERENCE, SUBSTITUTION
from ..functions.cigar import OPS, with_offsets
from ..plans.lineage import light

CHUNK = 1000


@dataclass(frozen=True)
class CounterOptions:
    min_base_quality: int = 10
    min_mapping_quality: int = 10


@dataclass(frozen=True)
class CallerOptions:
    min_count_snps: int = 2
    min_count_indels: int = 2
    min_fraction_snps: float = 0.12
    min_fraction_indels: float = 0.06


def reference_chunks(sequences: DataFrame) -> DataFrame:
    """(contig, chunk, bases) of upper-cased sequences (contig, bases), each chunk with the next one's bases behind it."""
    size = F.length("bases")
    starts = F.sequence(F.lit(0), F.floor(F.greatest(size - 1, F.lit(0)) / CHUNK))
    return sequences.select("contig", F.upper("bases").alias("all"), F.explode(F.when(F.length("bases") > 0, starts)).alias("chunk")).select("contig", "chunk", F.expr(f"substring(all, cast(chunk * {CHUNK} + 1 as int), {2 * CHUNK})").alias("bases"))


def passing_reads(raw: DataFrame, min_mapq: int = 10) -> DataFrame:
    """Reads with none of the flags unmapped, secondary, QC failed, duplicate and supplementary, of enough mapping quality; a missing one is 255."""
    return raw.where((F.col("flag").bitwiseAND(F.lit(0xF04)) == 0) & (F.coalesce("mapq", F.lit(255)) >= min_mapq))


def region_reads(reads: DataFrame, contig: str, start: int, end: int) -> DataFrame:
    """Reads of a region; one that ends exactly where the region starts is kept."""
    return reads.where((F.col("contig") == contig) & (F.col("ref_end") >= start) & (F.col("ref_start") < end))


def aligned_units(reads: DataFrame) -> DataFrame:
    """One row per CIGAR unit, with the bases before it; a unit of an unknown op ends a read."""
    known = F.transform("cigar", lambda u: u["op"].isin(*OPS))
    whole = F.array_position(known, F.lit(False)) == 0
    plain = (F.size("cigar") == 1) & F.get("cigar", F.lit(0))["op"].isin(*OPS)
    kept = F.when(plain | whole, F.col("cigar")).otherwise(F.slice("cigar", 1, F.greatest(F.array_position(known, F.lit(False)).cast("int") - 1, F.lit(0))))
    key = F.concat_ws("/", "name", F.col("mate").cast("string")).alias("read_key")
    return reads.withColumn("u", F.explode(with_offsets(kept))).select("contig", "ref_start", "seq", "bq", "mapq", "is_rev", key, "u.*")


def aligned_bases(reads: DataFrame) -> DataFrame:
    """One row per aligned base: contig, pos, read_key, base, bq, idx, mapq, is_rev."""
    units = aligned_units(reads).where(F.col("op").isin("M", "=", "X"))
    at = units.withColumn("k", F.explode(F.expr("sequence(0, len - 1)")))
    return at.select("contig", (F.col("ref_start") + F.col("ref_off") + F.col("k")).alias("pos"), "read_key", F.upper(F.expr("substring(seq, read_off + k + 1, 1)")).alias("base"), F.expr("bq[read_off + k]").alias("bq"), "idx", "mapq", "is_rev")


def bases_at(sites: DataFrame, reads: DataFrame, width: int = 64) -> DataFrame:
    """Reads' aligned bases at sites (contig, pos): contig, pos, base, bq, mapq, is_rev, read_key.

    Sites come first: a CIGAR unit is cut into pieces of bins, of which only those with a site go on, and a
    piece gives its base when it has met the site. Bins are filtered before the shuffle if the sites' bins are few enough
    to be sent to all executors, so what moves follows the sites and not the bases.
    """
    wanted = sites.select("contig", "pos").distinct().withColumn("bin", F.floor(F.col("pos") / width))
    units = aligned_units(reads).where(F.col("op").isin("M", "=", "X") & (F.col("len") > 0)).withColumn("at", F.col("ref_start") + F.col("ref_off"))
    last = F.floor((F.col("at") + F.col("len") - 1) / width)
    binned = units.withColumn("bin", F.explode(F.sequence(F.floor(F.col("at") / width), last)))
    near = binned.join(light(wanted.select("contig", "bin").distinct()), ["contig", "bin"], "left_semi")
    lo = F.greatest(F.col("bin") * width, F.col("at"))
    n = (F.least((F.col("bin") + 1) * width, F.col("at") + F.col("len")) - lo).cast("int")
    first = (F.col("read_off") + lo - F.col("at") + 1).cast("int")
    pieces = near.select("contig", "bin", lo.alias("lo"), F.upper(F.substring(F.col("seq"), first, n)).alias("own"), F.slice("bq", first, n).alias("quals"), "mapq", "is_rev", "read_key")
    inside = (F.col("pos") >= F.col("lo")) & (F.col("pos") < F.col("lo") + F.length("own"))
    met = wanted.join(pieces, ["contig", "bin"]).where(inside).withColumn("k", (F.col("pos") - F.col("lo")).cast("int"))
    return met.select("contig", "pos", F.substring(F.col("own"), F.col("k") + 1, F.lit(1)).alias("base"), F.get("quals", F.col("k")).alias("bq"), "mapq", "is_rev", "read_key")


def with_reference(facts: DataFrame, reference: DataFrame, position: str = "pos") -> DataFrame:
    """facts with ref_base, and ref_after: the reference from there on, a chunk at least where the contig has it."""
    chunked = facts.withColumn("chunk", F.floor(F.col(position) / CHUNK))
    at = F.expr(f"cast({position} - chunk * {CHUNK} + 1 as int)")
    joined = chunked.join(reference, ["contig", "chunk"])
    return joined.withColumn("ref_base", F.substring(F.col("bases"), at, F.lit(1))).withColumn("ref_after", F.substring(F.col("bases"), at, F.lit(CHUNK))).where(F.length("ref_base") == 1).drop("chunk", "bases")


def _units_on_reference(reads: DataFrame, reference: DataFrame, ops: tuple[str, ...]) -> DataFrame:
    """CIGAR units with their own bases and the reference's from start on: contig, start, op, len, own, bq, ref, read_key, idx, mapq, is_rev.

    Units meet the reference, not bases: one row a unit, long matches cut into
    pieces of a chunk. start is the first base of a match (op M), and the base
    before an insertion or deletion; own and bq are empty for a deletion.
    """
    units = aligned_units(reads).where(F.col("op").isin(*ops))
    match = F.col("op").isin("M", "=", "X")
    cut = units.withColumn("skip", F.explode(F.when(match, F.expr(f"sequence(0, greatest(len - 1, 0), {CHUNK})")).otherwise(F.array(F.lit(0)))))
    size = F.when(match, F.least(F.col("len") - F.col("skip"), F.lit(CHUNK))).otherwise(F.col("len"))
    taken = F.when(F.col("op") == "D", 0).otherwise(size)
    start = F.col("ref_start") + F.col("ref_off") + F.when(match, F.col("skip")).otherwise(-1)
    at = cut.select(
        "contig", start.alias("start"), F.when(match, F.lit("M")).otherwise(F.col("op")).alias("op"), size.alias("len"),
        F.upper(F.substring(F.col("seq"), F.col("read_off") + F.col("skip") + 1, taken)).alias("own"),
        F.slice("bq", F.col("read_off") + F.col("skip") + 1, taken).alias("bq"), "read_key", "idx", "mapq", "is_rev",
    )
    placed = at.where("start >= 0 AND len > 0").withColumn("chunk", F.floor(F.col("start") / CHUNK)).join(reference, ["contig", "chunk"])
    first = (F.col("start") - F.col("chunk") * CHUNK + 1).cast("int")
    reach = F.when(F.col("op") == "M", F.col("len")).when(F.col("op") == "D", F.col("len") + 1).otherwise(1)
    return placed.withColumn("ref", F.substring(F.col("bases"), first, reach)).drop("chunk", "bases")


def aligned_bases_on_reference(reads: DataFrame, reference: DataFrame) -> DataFrame:
    """aligned_bases() with ref_base, of positions that the reference has."""
    units = _units_on_reference(reads, reference, ("M", "=", "X"))
    at = units.where("length(ref) > 0").withColumn("k", F.explode(F.expr("sequence(0, least(len, length(ref)) - 1)")))
    return at.select("contig", (F.col("start") + F.col("k")).alias("pos"), "read_key", F.expr("substring(own, k + 1, 1)").alias("base"), F.expr("bq[k]").alias("bq"), "idx", "mapq", "is_rev", F.expr("substring(ref, k + 1, 1)").alias("ref_base"))


def allele_facts(reads: DataFrame, reference: DataFrame, options: CounterOptions = CounterOptions(), region: tuple[str, int, int] | None = None) -> DataFrame:
    """What reads say of positions: contig, pos, read_key, idx, type, bases, bq, mapq, is_rev, ref_base.

    type: REFERENCE for matching bases (is_low_quality marks those of low
    quality), SUBSTITUTION, INSERTION and DELETION otherwise. Insertions and
    deletions are keyed to the base before them. Outside region nothing is
    counted, and deleted bases that lie outside are N.
    """
    good = reads.where(F.col("mapq") >= options.min_mapping_quality)
    units = _units_on_reference(good, reference, ("M", "=", "X", "I", "D")).where("length(ref) > 0")
    matched = F.col("op") == "M"
    places = F.when(matched, F.expr("sequence(0, least(len, length(ref)) - 1)")).otherwise(F.array(F.lit(0)))
    at = units.withColumn("k", F.explode(places)).withColumn("pos", F.col("start") + F.col("k"))
    if region is not None:
        contig, start, end = region
        at = at.where((F.col("contig") == contig) & (F.col("pos") >= start) & (F.col("pos") < end))
        left = F.greatest(F.least(F.col("len"), (F.lit(end) - 1 - F.col("pos")).cast("int")), F.lit(0))
    else:
        left = F.col("len")
    own = F.when(matched, F.expr("substring(own, k + 1, 1)")).otherwise(F.col("own"))
    quality = F.when(matched, F.expr("bq[k]")).when(F.col("op") == "I", F.array_min("bq")).otherwise(0)
    seen = at.select("contig", "pos", "read_key", "idx", "op", "len", "mapq", "is_rev", own.alias("own"), quality.alias("bq"), F.expr("substring(ref, k + 1, 1)").alias("ref_base"), F.substring(F.col("ref"), F.lit(1), left + 1).alias("gone"))
    kind = F.when(F.col("op") == "I", INSERTION).when(F.col("op") == "D", DELETION).when(F.col("own") == F.col("ref_base"), REFERENCE).otherwise(SUBSTITUTION)
    text = F.when(F.col("op") == "I", F.concat("ref_base", "own")).when(F.col("op") == "D", F.rpad("gone", F.col("len") + 1, "N")).otherwise(F.col("own"))
    ok = F.col("bq") >= options.min_base_quality
    kept = seen.withColumn("type", kind).where(ok | (F.col("op") == "D") | (F.col("type") == REFERENCE))
    return kept.select("contig", "pos", "read_key", "idx", "type", text.alias("bases"), "bq", "mapq", "is_rev", "ref_base", (~ok & (F.col("type") == REFERENCE)).alias("is_low_quality"))


def read_alleles(facts: DataFrame) -> DataFrame:
    """The allele that counts for each read at each position: the last along the read."""
    own = facts.where(F.col("type") != REFERENCE)
    last = F.max_by(F.struct("type", "bases", "bq", "mapq", "is_rev", "ref_base"), "idx").alias("a")
    return own.groupBy("contig", "pos", "read_key").agg(last).select("contig", "pos", "read_key", "a.*")


def sites(facts: DataFrame) -> DataFrame:
    """One row per position: ref_base, ref_count, ref_low_count, alleles (array of type, bases, n, in order).

    Matching bases are counted before they move, so what is dealt by position are
    counts, and the facts of other alleles; reads, alleles and positions are then
    aggregated without another shuffle.
    """
    is_ref = F.col("type") == REFERENCE
    other = lambda c: F.when(~is_ref, F.col(c)).alias(c)
    held = facts.groupBy("contig", "pos", "ref_base", *(other(c) for c in ("read_key", "type", "bases", "idx")))
    return _gathered(held.agg(F.count_if(is_ref & ~F.col("is_low_quality")).alias("ok"), F.count_if(is_ref & F.col("is_low_quality")).alias("low")))


def _gathered(counted: DataFrame) -> DataFrame:
    """sites() of counted facts: contig, pos, ref_base, ok and low (how many matching bases), and of one other allele read_key, type, bases, idx."""
    keys = ["contig", "pos", "ref_base"]
    per_read = counted.repartition("contig", "pos").groupBy(*keys, "read_key").agg(F.sum("ok").alias("ok"), F.sum("low").alias("low"), F.max_by(F.struct("type", "bases"), "idx").alias("a"))
    per_allele = per_read.groupBy(*keys, "a").agg(F.sum("ok").alias("ok"), F.sum("low").alias("low"), F.count("a").alias("n"))
    listed = F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a.type", "a.bases", "n")))
    return per_allele.groupBy(*keys).agg(F.sum("ok").alias("ref_count"), F.sum("low").alias("ref_low_count"), F.sort_array(listed).alias("alleles"))


_COUNTED = "contig string, pos long, ref_base string, read_key string, type int, bases string, idx int, ok long, low long"
#: Bases that are compared at once.
_BASES = 1 << 18


def _letters(codes: np.ndarray) -> pa.Array:
    """A string of one byte for each code, none for 0."""
    ends = np.concatenate([[0], np.cumsum(codes > 0)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(codes), pa.py_buffer(ends), pa.py_buffer(codes[codes > 0].tobytes()))


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of texts, and where each begins and how long it is."""
    texts = texts.cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), ends[:-1], np.diff(ends)


def _counted_matches(units: pa.Table, least: int) -> pa.Table:
    """Matches' bases: those that are the reference's counted by position, others of enough quality one by one."""
    units = units.filter(pc.and_(pc.is_valid(units["own"]), pc.is_valid(units["ref"]))).combine_chunks()
    column = lambda name: units[name].combine_chunks() if isinstance(units[name], pa.ChunkedArray) else units[name]
    own, own_at, own_n = _bytes_of(column("own"))
    ref, ref_at, ref_n = _bytes_of(column("ref"))
    quals = column("bq")
    known = quals.is_valid().to_numpy(zero_copy_only=False)
    sizes = pc.fill_null(quals.value_lengths(), 0).to_numpy()
    scores, first = quals.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
    n = np.minimum(column("len").to_numpy(), ref_n)
    if (known & (sizes < n)).any():
        raise ValueError("a read has fewer qualities than bases in its alignment")
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    here = k < own_n[row]
    base, theirs, q = np.zeros(len(row), np.uint8), ref[ref_at[row] + k], np.full(len(row), np.nan)
    base[here] = own[(own_at[row] + k)[here]]
    scored = known[row]
    q[scored] = scores[(first[row] + k)[scored]]
    pos, same = column("start").to_numpy()[row] + k, base == theirs
    contigs = pc.dictionary_encode(column("contig"))
    code = pc.fill_null(contigs.indices, len(contigs.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)[row]
    key, where, group = np.unique((code[same] << 40) + pos[same], return_index=True, return_inverse=True)
    ok, low = (np.bincount(group, chosen, len(key)).astype(np.int64) for chosen in (q[same] >= least, q[same] < least))
    at = np.flatnonzero(same)[where]
    odd = np.flatnonzero(~same & (q >= least))
    none = lambda kind, size: pa.nulls(size, kind)
    matched = [column("contig").take(pa.array(row[at])), pa.array(pos[at]), _letters(theirs[at]), *(none(t, len(at)) for t in (pa.string(), pa.int32(), pa.string(), pa.int32())), pa.array(ok), pa.array(low)]
    zeros, rows = pa.array(np.zeros(len(odd), np.int64)), pa.array(row[odd])
    other = [column("contig").take(rows), pa.array(pos[odd]), _letters(theirs[odd]), column("read_key").take(rows), pa.array(np.full(len(odd), SUBSTITUTION, np.int32)), _letters(base[odd]), column("idx").take(rows), zeros, zeros]
    return pa.table([pa.chunked_array([a, b], a.type) for a, b in zip(matched, other, strict=True)], names=[c.split()[0] for c in _COUNTED.split(", ")])


def counted_sites(reads: DataFrame, reference: DataFrame, options: CounterOptions = CounterOptions()) -> DataFrame:
    """sites(allele_facts(reads, reference)), without a row for each base.

    Reads' units meet the reference in the order of its chunks, so that units of one place come together, and
    matching bases are counted by the batch before they are dealt by position. Reads without bases say nothing.
    """
    least = options.min_base_quality
    units = _units_on_reference(reads.where(F.col("mapq") >= options.min_mapping_quality), reference.hint("merge"), ("M", "=", "X", "I", "D")).where("length(ref) > 0")
    # insertions and deletions are few, and are made by columns as in allele_facts()
    text = F.when(F.col("op") == "I", F.concat(F.substring("ref", 1, 1), "own")).when(F.col("op") == "D", F.rpad(F.substring(F.col("ref"), F.lit(1), F.col("len") + 1), F.col("len") + 1, "N"))
    kept = units.where(F.col("op").isin("M", "D") | (F.array_min("bq") >= least)).withColumn("text", text)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = pa.Table.from_batches([batch])
            matches = whole.filter(pc.equal(whole["op"], "M"))
            step = max(1, _BASES // max(pc.max(matches["len"]).as_py() or 1, 1))
            for at in range(0, len(matches), step):
                yield from _counted_matches(matches.slice(at, step), least).to_batches()
            gaps = whole.filter(pc.not_equal(whole["op"], "M"))
            zeros = pa.array(np.zeros(len(gaps), np.int64))
            kinds = pc.if_else(pc.equal(gaps["op"], "I"), pa.scalar(INSERTION, pa.int32()), pa.scalar(DELETION, pa.int32()))
            yield from pa.table([gaps["contig"], gaps["start"], pc.utf8_slice_codeunits(gaps["ref"], 0, 1), gaps["read_key"], kinds, gaps["text"], gaps["idx"], zeros, zeros], names=[c.split()[0] for c in _COUNTED.split(", ")]).to_batches()

    made = kept.select("contig", "start", "op", "len", "own", "bq", "ref", "read_key", "idx", "text").mapInArrow(count, _COUNTED)
    return _gathered(made)


def _added(alleles: Column) -> Column:
    return F.aggregate(alleles, F.lit(0).cast("long"), lambda t, a: t + a["n"])


def allele_counts(at: DataFrame) -> DataFrame:
    """Per position of sites(): ref_base, ref_count, ref_low_count (matching bases of low quality), alt_count."""
    return at.select("contig", "pos", "ref_base", "ref_count", "ref_low_count", _added(F.col("alleles")).alias("alt_count"))


def total_depth(counts: DataFrame) -> DataFrame:
    """counts with depth, the low-quality reference bases included."""
    return counts.withColumn("depth", F.col("ref_count") + F.col("ref_low_count") + F.col("alt_count"))


def summarize_alleles(at: DataFrame) -> DataFrame:
    """contig, pos, type, bases, n: alleles of reads, and the reference where any base supports it."""
    ref = F.when(F.col("ref_count") > 0, F.array(F.struct(F.lit(REFERENCE).alias("type"), F.col("ref_base").alias("bases"), F.col("ref_count").alias("n"))))
    every = F.concat("alleles", F.coalesce(ref, F.array().cast("array<struct<type:int,bases:string,n:bigint>>")))
    return at.select("contig", "pos", F.explode(every).alias("a")).select("contig", "pos", "a.*")


def sum_alleles(at: DataFrame, low_quality: bool = False, span: int = 1) -> DataFrame:
    """Allele counts over spans of span positions: contig, span_start, type, bases, n.

    The reference row stands under its first position's base. low_quality also
    counts matching bases of low quality.
    """
    start = (F.floor(F.col("pos") / span) * span).alias("span_start")
    ref_n = F.col("ref_count") + (F.col("ref_low_count") if low_quality else F.lit(0))
    ref = at.groupBy("contig", start).agg(F.lit(REFERENCE).alias("type"), F.min_by("ref_base", "pos").alias("bases"), F.sum(ref_n).alias("n")).where("n > 0")
    alt = at.select("contig", start, F.explode("alleles").alias("a")).groupBy("contig", "span_start", "a.type", "a.bases").agg(F.sum("a.n").alias("n"))
    return alt.unionByName(ref)


def total_alleles(at: DataFrame, span: int = 1) -> DataFrame:
    """Reads with an allele other than the reference over spans: contig, span_start, n."""
    start = (F.floor(F.col("pos") / span) * span).alias("span_start")
    return at.groupBy("contig", start).agg(F.sum(_added(F.col("alleles"))).alias("n"))


def _kept_alleles(at: DataFrame, options: CallerOptions) -> DataFrame:
    """Sites with an allele that counts for a candidate, in kept, and dp, the depth without matching bases of low quality."""
    deep = at.withColumn("dp", (F.col("ref_count") + _added(F.col("alleles"))).cast("int")).where("dp > 0")

    def passes(a: Column) -> Column:
        share = a["n"] / F.col("dp")
        snp = (a["type"] == SUBSTITUTION) & (a["n"] >= options.min_count_snps) & (share >= options.min_fraction_snps)
        indel = a["type"].isin(INSERTION, DELETION) & (a["n"] >= options.min_count_indels) & (share >= options.min_fraction_indels)
        return snp | indel

    return deep.withColumn("kept", F.filter("alleles", passes)).where(F.size("kept") > 0)


def candidate_alleles(at: DataFrame, options: CallerOptions = CallerOptions()) -> DataFrame:
    """The alternates of candidates one by one: contig, start, alt_index, type, bases, n, dp."""
    kept = _kept_alleles(at, options).select("contig", F.col("pos").alias("start"), "dp", F.posexplode("kept").alias("alt_index", "a"))
    return kept.select("contig", "start", "alt_index", "a.type", "a.bases", "a.n", "dp")


def candidates(at: DataFrame, options: CallerOptions = CallerOptions()) -> DataFrame:
    """Candidate variants: contig, start, end, ref, alts, dp, ad, vaf.

    Depth leaves out matching bases of low quality. With a deletion the reference
    is its first base and N for the rest, and alternates are alleles as counted.
    """
    found = _kept_alleles(at, options)
    deletions = F.transform(F.filter("kept", lambda a: a["type"] == DELETION), lambda a: F.length(a["bases"]))
    found = found.withColumn("ref_len", F.coalesce(F.array_max(deletions), F.lit(1)))
    return found.select(
        "contig",
        F.col("pos").alias("start"),
        (F.col("pos") + F.col("ref_len")).alias("end"),
        F.rpad("ref_base", F.col("ref_len"), "N").alias("ref"),
        F.transform("kept", lambda a: a["bases"]).alias("alts"),
        "dp",
        F.concat(F.array(F.col("ref_count").cast("int")), F.transform("kept", lambda a: a["n"].cast("int"))).alias("ad"),
        F.transform("kept", lambda a: a["n"] / F.col("dp").cast("double")).alias("vaf"),
    )


def vaf_context(counts: DataFrame, points: DataFrame, half: int = 25) -> DataFrame:
    """points (contig, pos) with context: integer percentages of alternates at each position from pos - half to pos + half, 0 where nothing is known."""
    # places come in bins of an array each, and a point's stretch is cut from its first bin and the next
    width = max(64, 2 * half + 1)
    none = F.expr(f"array_repeat(0, {width})")
    percent = counts.where("ref_count + alt_count > 0").select("contig", "pos", F.floor(F.col("alt_count") * 100 / (F.col("ref_count") + F.col("alt_count"))).cast("int").alias("vaf")).where("vaf <> 0")
    held = percent.groupBy("contig", F.floor(F.col("pos") / width).alias("bin")).agg(F.collect_list(F.struct((F.col("pos") - F.floor(F.col("pos") / width) * width).cast("int").alias("at"), "vaf")).alias("own"))
    row = F.expr(f"transform(sequence(0, {width - 1}), i -> coalesce(own[i], 0))")
    rows = held.withColumn("own", F.map_from_entries("own")).select("contig", "bin", row.alias("row"))
    pairs = rows.select("contig", "bin", "row", F.explode(F.array(F.lit(0), F.lit(1))).alias("next")).select("contig", (F.col("bin") - F.col("next")).alias("bin"), "next", "row")
    both = pairs.groupBy("contig", "bin").agg(*(F.coalesce(F.first(F.when(F.col("next") == k, F.col("row")), ignorenulls=True), none).alias(f"r{k}") for k in (0, 1)))
    wide = points.select("contig", "pos").distinct().withColumn("bin", F.floor((F.col("pos") - half) / width))
    cut = F.slice(F.concat(F.coalesce("r0", none), F.coalesce("r1", none)), (F.col("pos") - half - F.col("bin") * width + 1).cast("int"), F.lit(2 * half + 1))
    return wide.join(both, ["contig", "bin"], "left").select("contig", "pos", cut.alias("context"))


def window_scores(at: DataFrame, min_support: int = 2, short_insertion_fraction: float = 0.08) -> DataFrame:
    """contig, pos, score: reads whose alleles touch a position.

    Substitutions touch their own base, insertions as many bases on both sides
    of the anchor as they are long, deletions what they delete. Alleles need
    min_support reads; insertions of one base also a share of the depth, which
    has matching bases of low quality in it.
    """
    depth = (F.col("ref_count") + F.col("ref_low_count") + _added(F.col("alleles"))).alias("depth")
    deep = at.select("contig", "pos", depth, F.explode("alleles").alias("a")).select("contig", "pos", "depth", "a.*")
    weak = (F.col("type") == INSERTION) & (F.length("bases") <= 2) & (F.col("n") / F.col("depth") < short_insertion_fraction)
    strong = deep.where((F.col("n") >= min_support) & ~weak)
    size, here = F.length("bases"), F.col("pos")
    lo = F.when(F.col("type") == SUBSTITUTION, here).when(F.col("type") == DELETION, here + 1).otherwise(here + 2 - size)
    hi = F.when(F.col("type") == SUBSTITUTION, here + 1).otherwise(here + size)
    touched = strong.select("contig", "n", F.greatest(lo, F.lit(0)).alias("lo"), hi.alias("hi")).where("lo < hi").withColumn("pos", F.explode(F.expr("sequence(lo, hi - 1)")))
    return touched.groupBy("contig", "pos").agg(F.sum("n").alias("score"))


def reference_windows(windows: DataFrame, reference: DataFrame) -> DataFrame:
    """windows (contig, start, end) with bases, the reference's from start to end, however many chunks that are; shorter at a contig's end."""
    wide = windows.select("contig", "start", "end").distinct().where("start < end")
    chunked = wide.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("start") / CHUNK), F.floor((F.col("end") - 1) / CHUNK))))
    lo, hi = F.greatest(F.col("start") - F.col("chunk") * CHUNK, F.lit(0)), F.least(F.col("end") - F.col("chunk") * CHUNK, F.lit(CHUNK))
    parts = chunked.join(reference, ["contig", "chunk"]).select("contig", "start", "end", "chunk", F.substring(F.col("bases"), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("part"))
    listed = F.sort_array(F.collect_list(F.struct("chunk", "part")))
    return parts.groupBy("contig", "start", "end").agg(F.array_join(F.transform(listed, lambda x: x["part"]), "").alias("bases"))
