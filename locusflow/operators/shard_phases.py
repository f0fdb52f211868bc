"""Joining phases of regions that were phased apart.

rows: shard, region, fragment, phase (0, 1 or 2). Groups (shard, region) follow
each other by region, then shard; a group whose common reads mostly disagree with
the group before is flipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MIN_MARGIN = 2


def group_numbers(rows: DataFrame) -> DataFrame:
    """Distinct (shard, region) with their number in order; as many rows as there are groups."""
    order = Window.orderBy("region", "shard")
    return rows.select("shard", "region").distinct().withColumn("g", F.row_number().over(order))


def compare_neighbours(rows: DataFrame) -> DataFrame:
    """g and verdict: whether a group agrees with the one before ('match'), disagrees ('switch'), or shares too few reads ('apart')."""
    numbered = rows.join(group_numbers(rows), ["shard", "region"])
    before = numbered.select((F.col("g") + 1).alias("g"), "fragment", F.col("phase").alias("other"))
    common = numbered.join(before, ["g", "fragment"]).where("phase > 0 AND other > 0")
    margin = common.groupBy("g").agg(F.sum(F.when(F.col("phase") == F.col("other"), 1).otherwise(-1)).alias("margin"))
    verdict = F.when(F.abs(F.coalesce("margin", F.lit(0))) < MIN_MARGIN, "apart").when(F.col("margin") < 0, "switch").otherwise("match")
    return numbered.select("g", "shard", "region").distinct().join(margin, "g", "left").select("g", "shard", "region", verdict.alias("verdict"))


def flips(verdicts: DataFrame) -> DataFrame:
    """verdicts with flip: the parity of disagreements since the last group that stands apart."""
    order = Window.orderBy("g")
    chained = verdicts.withColumn("chain", F.sum(F.when(F.col("verdict") == "apart", 1).otherwise(0)).over(order))
    own = Window.partitionBy("chain").orderBy("g")
    return chained.withColumn("flip", F.sum(F.when(F.col("verdict") == "switch", 1).otherwise(0)).over(own) % 2 == 1).drop("chain")


def merge_phases(rows: DataFrame) -> DataFrame:
    """Per fragment: first_phase (the first but 0), ones, twos, phase by majority (0 if equal), corrected."""
    turned = flips(compare_neighbours(rows)).select("shard", "region", "g", "flip")
    fixed = rows.join(turned, ["shard", "region"]).withColumn("phase", F.when(F.col("flip") & (F.col("phase") > 0), 3 - F.col("phase")).otherwise(F.col("phase")))
    votes = fixed.groupBy("fragment").agg(F.min_by("phase", F.when(F.col("phase") > 0, F.col("g"))).alias("first_phase"), F.count_if(F.col("phase") == 1).alias("ones"), F.count_if(F.col("phase") == 2).alias("twos"))
    phase = F.when(F.col("ones") > F.col("twos"), 1).when(F.col("ones") < F.col("twos"), 2).otherwise(0)
    first = F.coalesce("first_phase", F.lit(0))
    return votes.select("fragment", first.alias("first_phase"), "ones", "twos", phase.alias("phase"), (first != phase).alias("corrected"))
