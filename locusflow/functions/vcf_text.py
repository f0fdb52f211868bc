"""VCF text of qualities, genotypes, call fields and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .phred import pl_of_likelihoods

#: The symbolic alternate of blocks without variants, and the keys of records.
ANY_ALT = "<*>"
VARIANT_KEYS = ("GT", "GQ", "DP", "AD", "VAF", "MID", "PL")
BLOCK_KEYS = ("GT", "GQ", "MIN_DP", "PL")

#: Meta lines in front of the contigs.
HEADER = """##fileformat=VCFv4.2
##FILTER=<ID=PASS,Description="All filters passed">
##FILTER=<ID=RefCall,Description="Genotyping model thinks this site is reference.">
##FILTER=<ID=LowQual,Description="Confidence in this variant being real is below calling threshold.">
##FILTER=<ID=NoCall,Description="Site has depth=0 resulting in no call.">
##INFO=<ID=END,Number=1,Type=Integer,Description="End position (for use with symbolic alleles)">
##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">
##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Conditional genotype quality">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read depth">
##FORMAT=<ID=MIN_DP,Number=1,Type=Integer,Description="Minimum DP observed within the GVCF block.">
##FORMAT=<ID=AD,Number=R,Type=Integer,Description="Read depth for each allele">
##FORMAT=<ID=VAF,Number=A,Type=Float,Description="Variant allele fractions.">
##FORMAT=<ID=PL,Number=G,Type=Integer,Description="Phred-scaled genotype likelihoods rounded to the closest integer">
##FORMAT=<ID=PS,Number=1,Type=Integer,Description="Phase set">
##FORMAT=<ID=MF,Number=R,Type=Float,Description="Methylation fraction for each of the reference and alternate allele">
##FORMAT=<ID=MD,Number=R,Type=Integer,Description="Methylation depth for each of the reference and alternate allele">
##FORMAT=<ID=MT,Number=1,Type=String,Description="Methylation type: 0/0=Unmethylated, 0/1=Heterozygous, 1/1=Methylated">
##FORMAT=<ID=MI,Number=1,Type=Float,Description="Allele-specific methylation score: p-value for Wilcoxon Rank-Sum test based on the observed difference in methylation between haplotypes.">
##FORMAT=<ID=MED_DP,Number=1,Type=Integer,Description="Median DP observed within the GVCF block rounded to the nearest integer.">
##FORMAT=<ID=MID,Number=1,Type=String,Description="Identifies which model called this variant.">
"""


def header_text(contigs: list[tuple[int, str, int]], samples: list[str], caller_line: str = "") -> str:
    """Meta lines, contigs (number, name, length; no length if 0) and the column line.

    caller_line: a meta line of one's own that names the caller and its version.
    """
    lines = [f"{caller_line}\n"] if caller_line else []
    lines += [f"##contig=<ID={name},length={n}>\n" if n > 0 else f"##contig=<ID={name}>\n" for _, name, n in contigs]
    columns = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", *(["FORMAT", *samples] if samples else [])]
    return HEADER + "".join(lines) + "\t".join(columns) + "\n"


def quality_text(q: Column) -> Column:
    """Rounded to a tenth, without '.0'."""
    return F.regexp_replace(F.format_string("%.1f", F.round(q, 1)), r"\.0$", "")


def float_text(x: Column) -> Column:
    """Six decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")


def genotype_text(genotype: Column, phased: Column) -> Column:
    names = F.transform(genotype, lambda g: F.when(g < 0, ".").otherwise(g.cast("string")))
    return F.when(F.size(genotype) < 1, ".").when(phased, F.array_join(names, "|")).otherwise(F.array_join(names, "/"))


def list_text(values: Column, floats: bool = False) -> Column:
    """Joined by commas; '.' for none."""
    return F.when(F.size(values) > 0, F.array_join(F.transform(values, float_text if floats else lambda v: v.cast("string")), ",")).otherwise(".")


def _or_dot(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("."))


def call_field(key: str, columns: set[str]) -> Column:
    """The text of a call's field from the columns gt, phased, gq, dp, ad, vaf, mid, pl, gl, ps, min_dp, med_dp, mf, md, nad, naf, mt, mi."""
    name = key.lower()
    if key == "GT":
        return genotype_text(F.col("gt"), F.coalesce(F.col("phased"), F.lit(False)) if "phased" in columns else F.lit(False))
    if key == "PL":
        kept = F.col("pl") if "pl" in columns else F.lit(None).cast("array<int>")
        derived = pl_of_likelihoods(F.col("gl")) if "gl" in columns else F.lit(None).cast("array<int>")
        return list_text(F.coalesce(kept, derived))
    if name not in columns:
        return F.lit(".")
    if key in ("AD", "MD", "NAD"):
        return list_text(F.col(name))
    if key in ("VAF", "MF", "NAF"):
        return list_text(F.col(name), floats=True)
    return _or_dot(F.col(name)) if key in ("GQ", "DP", "MIN_DP", "MED_DP", "PS", "MT", "MI", "MID") else F.lit(".")


def record_text(keys: tuple[str, ...], columns: set[str], end_info: bool = False) -> Column:
    """A record's line from the columns contig, start, end, ref, alts, qual, filter (an array), names (an array)."""
    joined = lambda c, sep: F.when(F.size(c) > 0, F.array_join(c, sep)).otherwise(".")
    return F.concat_ws(
        "\t",
        F.col("contig"),
        (F.col("start") + 1).cast("string"),
        joined(F.col("names"), ";") if "names" in columns else F.lit("."),
        F.col("ref"),
        joined(F.col("alts"), ","),
        quality_text(F.col("qual")),
        joined(F.col("filter"), ";"),
        F.concat(F.lit("END="), F.col("end").cast("string")) if end_info else F.lit("."),
        F.lit(":".join(keys)),
        F.concat_ws(":", *(call_field(k, columns) for k in keys)),
    )


def gvcf_text(columns: set[str]) -> Column:
    """The line of a variant, or of a block without variants."""
    return F.when(F.col("alts") == F.array(F.lit(ANY_ALT)), record_text(BLOCK_KEYS, columns, end_info=True)).otherwise(record_text(VARIANT_KEYS, columns))
