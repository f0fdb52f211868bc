"""Feature vectors of the small model, and its gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype, phred
from .pileup import bases_at, vaf_context

WINDOW = 51


def classify_reads(sites: DataFrame, reads: DataFrame) -> DataFrame:
    """Per site (contig, start, ref, alt): counts and means of reads with the reference's and the alternate's first base.

    Reads with another base count in the depth alone. Only bases at sites are taken from the reads (bases_at).
    """
    first = lambda c: F.upper(F.substring(c, 1, 1))
    bases = bases_at(sites.select("contig", F.col("start").alias("pos")), reads).select(F.col("contig").alias("b_contig"), F.col("pos").alias("b_pos"), "base", "bq", "mapq", "is_rev")
    at = sites.select("contig", "start", "ref", "alt").distinct()
    seen = at.join(bases, (F.col("contig") == F.col("b_contig")) & (F.col("start") == F.col("b_pos")), "left")
    ref = F.coalesce(F.col("base") == first("ref"), F.lit(False))
    alt = F.coalesce(F.col("base") == first("alt"), F.lit(False)) & ~ref
    mean = lambda kind, x: F.coalesce(F.floor(F.try_divide(F.sum(F.when(kind, x)), F.count_if(kind))), F.lit(0)).cast("int")
    share = lambda kind: F.coalesce(F.floor(F.try_divide(F.count_if(kind & F.col("is_rev")) * 100, F.count_if(kind))), F.lit(0)).cast("int")
    aggregates = [F.count_if(ref).cast("int").alias("n_ref"), F.count_if(alt).cast("int").alias("n_alt"), F.count("base").cast("int").alias("depth")]
    for name, kind in (("ref", ref), ("alt", alt)):
        aggregates += [mean(kind, F.col("mapq")).alias(f"mapq_{name}"), mean(kind, F.col("bq")).alias(f"bq_{name}"), share(kind).alias(f"rev_{name}")]
    return seen.groupBy("contig", "start", "ref", "alt").agg(*aggregates)


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.floor(part * 100 / F.greatest(whole, F.lit(1)))).otherwise(0).cast("int")


def considered(alts: Column, alt_idx: Column) -> Column:
    """The alternates that an output is about, without symbolic ones."""
    others = F.filter(alts, lambda a, i: ~F.array_contains(alt_idx, i))
    return F.filter(alts, lambda a: ~F.array_contains(others, a) & ~F.startswith(a, F.lit("<")))


def variant_features(ref: Column, alts: Column, alt_idx: Column) -> list[Column]:
    """is SNP, insertion, deletion; their lengths; several alternates at the site, in the output."""
    own, n = considered(alts, alt_idx), F.length(ref)
    kind = lambda test: ((F.size(own) > 0) & F.forall(own, test)).cast("int")
    longest = lambda sign: F.greatest(F.coalesce(F.array_max(F.transform(alt_idx, lambda i: (F.length(F.get(alts, i)) - n) * sign)), F.lit(0)), F.lit(0))
    snp = F.when(n == 1, kind(lambda a: (F.length(a) == 1) & (a != ref))).otherwise(0)
    return [snp, kind(lambda a: F.length(a) > n), kind(lambda a: F.length(a) < n), longest(1), longest(-1), (F.size(alts) > 1).cast("int"), (F.size(alt_idx) > 1).cast("int")]


def features(sites: DataFrame, reads: DataFrame, counts: DataFrame) -> DataFrame:
    """sites (contig, start, ref, alts, alt_idx) with features: 12 of reads, 7 of the variant, WINDOW of the frequencies around."""
    named = sites.withColumn("alt", F.get("alts", F.get("alt_idx", F.lit(0))))
    read_part = classify_reads(named, reads)
    around = vaf_context(counts, named.select("contig", F.col("start").alias("pos")).distinct(), WINDOW // 2).withColumnRenamed("pos", "start")
    joined = named.join(read_part, ["contig", "start", "ref", "alt"]).join(around, ["contig", "start"])
    both = F.col("n_ref") + F.col("n_alt")
    own = ["n_ref", "n_alt", both, "depth", _percent(F.col("n_alt"), F.col("depth")), _percent(F.col("n_alt"), both), "mapq_ref", "mapq_alt", "bq_ref", "bq_alt", "rev_ref", "rev_alt"]
    base = F.array(*(F.col(c).cast("float") if isinstance(c, str) else c.cast("float") for c in own), *(c.cast("float") for c in variant_features(F.col("ref"), F.col("alts"), F.col("alt_idx"))))
    return joined.select(*sites.columns, F.concat(base, F.transform("context", lambda v: v.cast("float"))).alias("features"))


def gate(scored: DataFrame, snp_gq: float = 25.0, indel_gq: float = 30.0) -> DataFrame:
    """scored (ref, alts, probs) with gq and passes: whether the small model is sure enough.

    Filter on passes and on its opposite for the two branches of a run.
    """
    p = F.get("probs", genotype.argmax(F.col("probs")))
    snp = (F.length("ref") == 1) & F.forall("alts", lambda a: F.length(a) == 1)
    quality = phred.small_model_quality(p)
    return scored.withColumn("gq", quality).withColumn("passes", F.when(snp, quality >= snp_gq).otherwise(quality >= indel_gq))
