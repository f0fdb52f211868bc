"""List fields of calls that go by alleles, and their values when alternates are pruned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .genotype import genotype_order

#: A field has a value for each allele, the reference first (R), each alternate (A), or each genotype (G).
CARDINALITY = {"AD": "R", "MF": "R", "MD": "R", "NAD": "R", "VAF": "A", "NAF": "A", "GL": "G"}
WHOLE = ("AD", "MD", "NAD")


def reindexed(values: Column, keep: Column, kind: str) -> Column:
    """A field's values of what is left, keep saying for each alternate whether it stays; values beyond the alleles go."""
    stays = lambda i: F.when(i == 0, True).otherwise(F.coalesce(F.get(keep, i - 1), F.lit(False)))
    if kind == "R":
        return F.filter(values, lambda _, i: stays(i))
    if kind == "A":
        return F.filter(values, lambda _, i: stays(i + 1))
    order = genotype_order(F.size(keep))
    return F.filter(values, lambda _, i: stays(F.get(order, i)["first"]) & stays(F.get(order, i)["second"]))


def pruned(info: Column, keep: Column) -> Column:
    """A map of fields with the values of the alternates that stay; fields that don't go by alleles are unchanged."""
    of = lambda kind: [k for k, v in CARDINALITY.items() if v == kind]

    def value(key: Column, values: Column) -> Column:
        out = F.when(key.isin(of("R")), reindexed(values, keep, "R")).when(key.isin(of("A")), reindexed(values, keep, "A"))
        return out.when(key.isin(of("G")), reindexed(values, keep, "G")).otherwise(values)

    return F.transform_values(info, value)


def with_fields(calls: DataFrame, *keys: str, info: str = "info") -> DataFrame:
    """calls with a column for each key of its map of fields, named in lower case; null where the map lacks it."""
    found = {k.lower(): F.try_element_at(F.col(info), F.lit(k)) for k in keys}
    return calls.withColumns({k: v.cast("array<int>") if k.upper() in WHOLE else v for k, v in found.items()})
