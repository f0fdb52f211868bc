"""Alleles and variants: simplification, types, strands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Codes of allele types; their order is a sort key.
UNSPECIFIED, REFERENCE, SUBSTITUTION, INSERTION, DELETION, SOFT_CLIP = range(6)


def complement(bases: Column) -> Column:
    """Complement with the case kept; what isn't a base or a gap is N."""
    return F.translate(F.regexp_replace(bases, "[^ACGTNacgtn-]", "N"), "ACGTacgt", "TGCAtgca")


def reverse_complement(bases: Column) -> Column:
    return F.reverse(complement(bases))


def _run(a: Column, b: Column, most: Column, at) -> Column:
    """How many of the first most places agree."""
    differ = F.filter(F.sequence(F.lit(1), most), lambda k: at(a, k) != at(b, k))
    return F.when(most < 1, F.lit(0)).otherwise(F.coalesce(F.array_min(differ) - 1, most))


def common_suffix(a: Column, b: Column, most: Column) -> Column:
    return _run(a, b, most, lambda s, k: F.substring(s, -k, F.lit(1)))


def common_prefix(a: Column, b: Column, most: Column) -> Column:
    return _run(a, b, most, lambda s, k: F.substring(s, k, F.lit(1)))


def simplify_alleles(ref: Column, alt: Column) -> Column:
    """(ref, alt) without their common suffix and then prefix; one base stays at least."""
    suffix = common_suffix(ref, alt, F.least(F.length(ref), F.length(alt)) - 1)
    r = F.substring(ref, F.lit(1), F.length(ref) - suffix)
    a = F.substring(alt, F.lit(1), F.length(alt) - suffix)
    prefix = common_prefix(r, a, F.least(F.length(r), F.length(a)) - 1)
    return F.struct(F.substring(r, prefix + 1, F.length(r)).alias("ref"), F.substring(a, prefix + 1, F.length(a)).alias("alt"))


def simplify_ref_alt(ref: Column, alt: Column) -> Column:
    """'ref->alt' without the common suffix."""
    suffix = common_suffix(ref, alt, F.least(F.length(ref), F.length(alt)) - 1)
    return F.concat(F.substring(ref, F.lit(1), F.length(ref) - suffix), F.lit("->"), F.substring(alt, F.lit(1), F.length(alt) - suffix))


def allele_type(ref: Column, alt: Column) -> Column:
    """By the lengths of ref and alt."""
    return F.when(F.length(ref) == F.length(alt), SUBSTITUTION).when(F.length(ref) < F.length(alt), INSERTION).otherwise(DELETION)


def is_snp(ref: Column, alts: Column) -> Column:
    return (F.length(ref) == 1) & (F.size(alts) > 0) & F.forall(alts, lambda a: F.length(a) == 1)


def is_indel(ref: Column, alts: Column) -> Column:
    return (F.size(alts) > 0) & ((F.length(ref) > 1) | F.exists(alts, lambda a: F.length(a) > 1))


def is_biallelic(alts: Column) -> Column:
    return F.size(alts) == 1


def is_multiallelic(alts: Column) -> Column:
    return F.size(alts) > 1


def has_insertion(ref: Column, alts: Column) -> Column:
    return F.exists(alts, lambda a: F.length(a) > F.length(ref))


def has_deletion(ref: Column, alts: Column) -> Column:
    return F.exists(alts, lambda a: F.length(a) < F.length(ref))


def encoded_variant_type(ref: Column, alts: Column) -> Column:
    """1 SNP, 2 indel, 0 unknown."""
    return F.when(is_snp(ref, alts), 1).when(is_indel(ref, alts), 2).otherwise(0)


def deletion_size(kind: Column, bases: Column) -> Column:
    """Bases of a deletion allele, -1 for others."""
    return F.when(kind == DELETION, F.length(bases)).otherwise(-1)


def alt_under(prefix: Column, ref: Column, start: Column) -> Column:
    """prefix followed by what ref has from place start (0-based) on."""
    return F.concat(prefix, F.substring(ref, start + 1, F.length(ref)))


def extended_ref(ref: Column, alleles: Column) -> Column:
    """ref with what the longest deletion of alleles, (type, bases), takes after its first base; of equally long ones the last counts."""
    deletions = F.filter(alleles, lambda a: a["type"] == DELETION)
    longest = F.aggregate(deletions, F.lit(""), lambda best, a: F.when(F.length(a["bases"]) >= F.length(best), a["bases"]).otherwise(best))
    return F.concat(ref, F.substring(longest, F.lit(2), F.length(longest)))


def variant_alt(kind: Column, bases: Column, ref: Column) -> Column:
    """An allele as an alternate of ref, which may be extended; null for the reference and clips."""
    deleted = alt_under(F.substring(bases, 1, 1), ref, F.length(bases))
    return F.when(kind.isin(SUBSTITUTION, INSERTION), alt_under(bases, ref, F.lit(1))).when(kind == DELETION, deleted)


def flanked_haplotype(window: Column, window_start: Column, start: Column, ref: Column, alt: Column, half_width: int, n_bases: Column) -> Column:
    """(bases, start, end): alt between half_width reference bases on each side, clipped to the contig; window must reach over them."""
    end = start + F.length(ref)
    first, last = F.greatest(start - half_width, F.lit(0)), F.least(end + half_width, n_bases)
    cut = lambda a, b: F.substring(window, (a - window_start + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))
    return F.struct(F.concat(cut(first, start), alt, cut(end, last)).alias("bases"), first.alias("start"), last.alias("end"))


def splice_alt(window: Column, window_start: Column, start: Column, ref: Column, alt: Column) -> Column:
    """The window of reference bases with ref at start replaced by alt; null if it isn't inside."""
    at = start - window_start
    inside = (at >= 0) & (at + F.length(ref) <= F.length(window))
    return F.when(inside, F.concat(F.substring(window, F.lit(1), at.cast("int")), alt, F.substring(window, (at + F.length(ref) + 1).cast("int"), F.length(window))))


def canonical(bases: Column) -> Column:
    return bases.rlike("^[ACGTNacgtn]*$")


def span_quality(quals: Column, op: Column, offset: Column, length: Column) -> Column:
    """Mean base quality of a span, floored; a deletion has the quality before it."""
    span = F.slice(quals, offset + 1, length)
    mean = F.floor(F.aggregate(span, F.lit(0), lambda t, q: t + q) / F.size(span)).cast("int")
    return F.when(op == "D", F.coalesce(F.get(quals, offset - 1), F.lit(0))).when(F.size(span) > 0, mean).otherwise(0)


def usable_bases(seq: Column, quals: Column, offset: Column, length: Column, min_quality: int, legacy: bool) -> Column:
    """(usable, is_low_quality) of a span of a read.

    A span must lie inside the read and hold canonical bases only. In legacy mode
    one base below min_quality makes it unusable, otherwise a low mean marks it.
    """
    span, q = F.substring(seq, offset + 1, length), F.slice(quals, offset + 1, length)
    inside = (offset >= 0) & (offset + length <= F.length(seq)) & (offset + length <= F.size(quals))
    mean = F.aggregate(q, F.lit(0), lambda t, x: t + x) / F.greatest(F.size(q), F.lit(1))
    low = F.exists(q, lambda x: x < min_quality) if legacy else mean < min_quality
    usable = inside & canonical(span)
    return F.struct((usable & ~low if legacy else usable).alias("usable"), (F.lit(False) if legacy else usable & low).alias("is_low_quality"))
