"""Diploid genotypes: order, counts, combinations of alternates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def num_genotypes(n_alts: Column) -> Column:
    """Diploid genotypes of n_alts alternates and the reference."""
    n = n_alts + 1
    return F.floor(n * (n + 1) / 2).cast("int")


def genotype_order(n_alts: Column) -> Column:
    """(first, second) allele numbers in the order of likelihoods."""
    return F.flatten(F.transform(F.sequence(F.lit(0), n_alts), lambda h1: F.transform(F.sequence(F.lit(0), h1), lambda h2: F.struct(h2.alias("first"), h1.alias("second")))))


def argmax(values: Column) -> Column:
    """The place of the greatest value, the first of equal ones."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def likeliest(probs: Column, n_alts: Column) -> Column:
    """[first, second] of the likeliest genotype."""
    pair = F.get(genotype_order(n_alts), argmax(probs))
    return F.array(pair["first"], pair["second"])


def alt_combinations(n_alts: Column, het_alts: bool) -> Column:
    """Arrays of alternates' numbers: each alone, and with het_alts each pair too, in the order of genotypes."""
    alone = F.transform(F.sequence(F.lit(0), n_alts - 1), lambda i: F.array(i))
    if not het_alts:
        return alone
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), n_alts - 1), lambda i: F.transform(F.filter(F.sequence(F.lit(0), n_alts - 1), lambda j: j > i), lambda j: F.array(i, j))))
    return F.concat(alone, pairs)


def alt_indices(alts: Column, combination: Column) -> Column:
    """Where a combination's alternates stand among alts; unknown ones are left out."""
    return F.filter(F.transform(combination, lambda a: (F.array_position(alts, a) - 1).cast("int")), lambda i: i >= 0)


def allele_phases(values: Column, n_alts: Column) -> Column:
    """Phases of the alternates from a list that begins with the reference's; 0 where there is none."""
    return F.transform(F.sequence(F.lit(1), n_alts), lambda i: F.coalesce(F.get(values, i), F.lit(0)))
