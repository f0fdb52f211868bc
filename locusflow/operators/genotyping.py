"""From model outputs to genotype calls.

outputs: contig, start, end, ref, alts, dp, ad, vaf, alt_idx (array of int), probs
(three doubles: none, one, both chromosomes have one of the alternates).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from ..functions import genotype, phred
from ..functions.fields import pruned, reindexed
from ..functions.vcf_text import ANY_ALT
from ..plans.lineage import cut
from .intervals import subtract_intervals

ANY_ALT_LIKELIHOOD = -99.0


@dataclass(frozen=True)
class CallOptions:
    min_quality: float = 1.0
    min_alt_quality: float = 1.0
    min_homref_gq: float = 20.0
    quality_digits: int = 7


def sort_outputs(outputs: DataFrame) -> DataFrame:
    """By contig name, start, end, ref, sorted alternates and sorted indices."""
    return outputs.orderBy("contig", "start", "end", "ref", F.array_sort("alts"), F.array_sort("alt_idx"))


def group_outputs(outputs: DataFrame) -> DataFrame:
    """One row per (contig, start, end): its outputs in order. The first one's variant stands for all."""
    # maps have no order, so they are lists of entries here
    outputs = outputs.withColumns({f.name: F.map_entries(f.name) for f in outputs.schema if isinstance(f.dataType, MapType)})
    rest = [c for c in outputs.columns if c not in ("contig", "start", "end")]
    row = F.struct(F.col("ref").alias("k1"), F.array_sort("alts").alias("k2"), F.array_sort("alt_idx").alias("k3"), *(F.col(c) for c in rest if c != "ref"), F.col("ref"))
    return outputs.groupBy("contig", "start", "end").agg(F.sort_array(F.collect_list(row)).alias("outputs"))


def removed_alts(outputs: Column, min_quality: float, digits: int = 7) -> Column:
    """Alternates whose own output says less than min_quality; if that is all of them the best one stays."""
    alts = outputs[0]["alts"]
    if min_quality <= 0:
        return F.array().cast("array<string>")
    single = F.filter(outputs, lambda o: (F.size(o["alt_idx"]) == 1) & (o["alt_idx"][0] < F.size(alts)))
    scored = F.transform(single, lambda o: F.struct(F.get(alts, o["alt_idx"][0]).alias("alt"), phred.variant_quality(o["probs"], digits).alias("q")))
    low = F.array_distinct(F.transform(F.filter(scored, lambda s: s["q"] < min_quality), lambda s: s["alt"]))
    quals = F.transform(scored, lambda s: s["q"])
    best = F.get(scored, genotype.argmax(quals))["alt"]
    return F.when(F.size(low) == F.size(alts), F.array_except(low, F.array(best))).otherwise(low)


def fuse_outputs(grouped: DataFrame, options: CallOptions = CallOptions()) -> DataFrame:
    """One variant per group with probs over its genotypes: contig, start, end, ref, alts, dp, ad, vaf, probs, and info where outputs have it.

    info is a map of list fields; those that go by alleles lose the values of pruned alternates, as ad and vaf do.
    A lone output is passed on. Several are fused: a genotype's probability is
    the product over outputs of the probability of how many of its alleles are
    among the output's alternates, normalised over genotypes (uniform if all
    are 0). Alternates of low quality are pruned first.
    """
    g = grouped.withColumn("v", F.col("outputs")[0]).withColumn("gone", F.when(F.size("outputs") > 1, removed_alts(F.col("outputs"), options.min_alt_quality, options.quality_digits)).otherwise(F.array().cast("array<string>")))
    kept = lambda a: ~F.array_contains(F.col("gone"), a)
    at = lambda i: F.get(F.col("v.alts"), i)
    g = g.withColumn("keep", F.transform("v.alts", kept)).withColumn("alts", F.filter("v.alts", kept)).withColumn("ad", reindexed(F.col("v.ad"), F.col("keep"), "R")).withColumn("vaf", reindexed(F.col("v.vaf"), F.col("keep"), "A"))
    info = [pruned(F.map_from_entries("v.info"), F.col("keep")).alias("info")] if "info" in g.schema["v"].dataType.fieldNames() else []
    used = F.transform("outputs", lambda o: F.struct(F.filter(F.transform(o["alt_idx"], at), lambda a: a.isNotNull()).alias("subset"), o["probs"].alias("p")))
    g = g.withColumn("used", F.filter(used, lambda e: ~F.exists(e["subset"], lambda a: F.array_contains(F.col("gone"), a))))
    g = g.withColumn("names", F.concat(F.array("v.ref"), "alts")).withColumn("order", genotype.genotype_order(F.size("alts")))

    def product(pair: Column) -> Column:
        has = lambda e, n: F.array_contains(e["subset"], F.get(F.col("names"), n)).cast("int")
        return F.aggregate("used", F.lit(1.0), lambda t, e: t * F.coalesce(F.get(e["p"], has(e, pair["first"]) + has(e, pair["second"])), F.lit(0.0)))

    g = g.withColumn("fused", F.transform("order", product)).withColumn("total", F.aggregate("fused", F.lit(0.0), lambda t, x: t + x))
    normal = F.transform("fused", lambda x: F.when(F.col("total") > 0, x / F.col("total")).otherwise(1.0 / F.size("fused")))
    return g.select("contig", "start", "end", "v.ref", "alts", "v.dp", "ad", "vaf", *info, F.when(F.size("outputs") == 1, F.col("v.probs")).otherwise(normal).alias("probs"))


def ad_sum(ad: Column) -> Column:
    return F.coalesce(F.aggregate(ad, F.lit(0).cast("long"), lambda t, x: t + x), F.lit(0).cast("long"))


def filter_of(gt: Column, qual: Column, min_quality: float) -> Column:
    return F.when(F.forall(gt, lambda g: g == -1), "NoCall").when(F.forall(gt, lambda g: g == 0), "RefCall").when(qual < min_quality, "LowQual").otherwise("PASS")


def call_genotypes(fused: DataFrame, options: CallOptions = CallOptions(), model_id: str = "cnn") -> DataFrame:
    """fused with gt, gq, gl, pl, qual, filter (an array), phased and mid.

    Without any read for an allele a site is uncalled (its pl stays). A weak
    reference call loses its genotype after the filter was set.
    """
    n_alts = F.size("alts")
    c = fused.withColumn("likeliest", genotype.argmax(F.col("probs"))).withColumn("gt", genotype.likeliest(F.col("probs"), n_alts))
    c = c.withColumn("gq", phred.genotype_quality(F.col("probs"), F.col("likeliest"))).withColumn("qual", phred.variant_quality(F.col("probs"), options.quality_digits))
    c = c.withColumn("gl", phred.bounded_log10s(F.col("probs"))).withColumn("pl", phred.pl_of_likelihoods(F.col("gl")))
    uncalled = F.array(F.lit(-1), F.lit(-1))
    bare = ad_sum(F.col("ad")) == 0
    c = c.withColumn("gt", F.when(bare, uncalled).otherwise(F.col("gt"))).withColumn("gl", F.when(bare, F.array(F.lit(0.0), F.lit(0.0))).otherwise(F.col("gl"))).withColumn("gq", F.when(bare, 0).otherwise(F.col("gq")))
    c = c.withColumn("filter", F.array(filter_of(F.col("gt"), F.col("qual"), options.min_quality)))
    weak = (F.col("gt") == F.array(F.lit(0), F.lit(0))) & (F.col("gq") < options.min_homref_gq)
    return c.withColumn("gt", F.when(weak, uncalled).otherwise(F.col("gt"))).withColumn("phased", F.lit(False)).withColumn("mid", F.lit(model_id)).drop("likeliest")


def call_variants(outputs: DataFrame, options: CallOptions = CallOptions(), model_id: str = "cnn") -> DataFrame:
    """Outputs to called variants."""
    return call_genotypes(fuse_outputs(group_outputs(outputs), options), options, model_id)


def to_gvcf(called: DataFrame) -> DataFrame:
    """Variants with the symbolic alternate: likelihoods for it, no reads, pl anew. Ones that have it are unchanged."""
    has = F.array_contains("alts", ANY_ALT)
    shifted = phred.zero_shifted(F.col("gl"))
    more = F.array_repeat(F.lit(ANY_ALT_LIKELIHOOD), F.size("alts") + 2)
    c = called.withColumn("gl", F.when(has, shifted).otherwise(F.concat(shifted, more)))
    c = c.withColumn("pl", F.when(has | (F.size("gl") == 0), F.col("pl")).otherwise(phred.pl_of_likelihoods(F.col("gl"))))
    c = c.withColumn("ad", F.when(has, F.col("ad")).otherwise(F.concat("ad", F.array(F.lit(0))))).withColumn("vaf", F.when(has, F.col("vaf")).otherwise(F.concat("vaf", F.array(F.lit(0.0)))))
    return c.withColumn("alts", F.when(has, F.col("alts")).otherwise(F.concat("alts", F.array(F.lit(ANY_ALT)))))


def merge_gvcf(called: DataFrame, blocks: DataFrame, reference_bases: DataFrame | None = None, bin_width: int = 1024) -> DataFrame:
    """gVCF records of called variants, and of what they leave of blocks without variants.

    blocks: contig, start, end, ref, min_dp, gq, gl, gt. A rest that starts
    after a variant takes its reference base from reference_bases (contig, pos,
    ref_base) where that has one.
    """
    # numbers are read twice, so they are fixed first: a retried task may number rows that came by a shuffle otherwise
    keyed = cut(blocks.withColumn("block", F.monotonically_increasing_id()).withColumn("__begin", F.col("start")))
    rest = subtract_intervals(keyed, called.select("contig", "start", "end"), bin_width)
    if reference_bases is not None:
        named = reference_bases.select(F.col("contig").alias("__c"), F.col("pos").alias("__p"), "ref_base")
        moved = F.when(F.col("start") != F.col("__begin"), F.col("start"))
        rest = rest.join(named, (F.col("contig") == F.col("__c")) & (moved == F.col("__p")), "left").withColumn("ref", F.coalesce("ref_base", "ref")).drop("__c", "__p", "ref_base")
    rest = rest.drop("block", "__begin").withColumn("alts", F.array(F.lit(ANY_ALT)))
    return to_gvcf(called).unionByName(rest, allowMissingColumns=True)


def in_file_order(records: DataFrame, contigs: list[str]) -> DataFrame:
    """Sorted by the contigs' order (unknown ones last), start, end, alternates: range-partitioned, so files follow each other."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(c) for c in contigs)), F.col("contig")).cast("int"), F.lit(0)) if contigs else F.lit(0)
    rank = F.when(rank > 0, rank).otherwise(len(contigs) + 1)
    keys = [rank, F.col("contig"), F.col("start"), F.col("end"), F.col("alts")]
    return records.orderBy(*keys)
