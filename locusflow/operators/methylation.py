"""Phasing by methylation: informative sites, votes, and the loop of both.

levels: site, read, level (0 to 255, 0 for no data), one row per site and read.
phases: read, phase (0, 1 or 2).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.phred import normal_cdf
from ..plans.lineage import cut

P_THRESHOLD, MIN_VOTES, MIN_DIFFERENCE, MAX_DEVIATION, MIN_READS, MIN_ALL_READS = 0.05, 3, 0.25, 0.2, 2, 6


def known_levels(levels: DataFrame) -> DataFrame:
    """Levels as shares of 255, without those that say nothing."""
    return levels.where("level > 0").select("site", "read", (F.col("level") / 255.0).alias("m"))


def is_methylated(level: Column, threshold: Column | float, enabled: bool = True) -> Column:
    """Whether a level of 0 to 255 is above a threshold as a share; no data and 0 are not."""
    if not enabled:
        return F.lit(False)
    return F.coalesce((level > 0) & (level / 255.0 > threshold), F.lit(False))


def rank_sums(values: DataFrame) -> DataFrame:
    """site, p: the two-sided rank-sum test of m between groups (1 and 2), average ranks for ties; -1 if a group is empty."""
    ties = Window.partitionBy("site", "m")
    rank = F.rank().over(Window.partitionBy("site").orderBy("m")) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
    ranked = values.withColumn("r", rank).groupBy("site").agg(F.sum(F.when(F.col("hap") == 1, F.col("r"))).alias("s"), F.count_if(F.col("hap") == 1).cast("double").alias("a"), F.count_if(F.col("hap") == 2).cast("double").alias("b"))
    a, b = F.col("a"), F.col("b")
    u = F.col("s") - a * (a + 1.0) / 2.0
    least = F.least(u, a * b - u)
    z = (least - a * b / 2.0) / F.sqrt(a * b * (a + b + 1.0) / 12.0)
    return ranked.select("site", F.when((a == 0) | (b == 0), -1.0).otherwise((1.0 - normal_cdf(F.abs(z))) * 2.0).alias("p"))


def informative_sites(levels: DataFrame, phases: DataFrame) -> DataFrame:
    """site, mean_1, mean_2, p of sites whose haplotypes differ clearly and significantly."""
    own = known_levels(levels).join(phases.where("phase > 0").select("read", F.col("phase").alias("hap")), "read")
    haps = []
    for h in (1, 2):
        m = F.when(F.col("hap") == h, F.col("m"))
        haps += [F.count(m).alias(f"n_{h}"), F.avg(m).alias(f"mean_{h}"), F.stddev_pop(m).alias(f"sd_{h}")]
    sites = own.groupBy("site").agg(*haps)
    clear = sites.where((F.least("n_1", "n_2") >= MIN_READS) & (F.col("n_1") + F.col("n_2") >= MIN_ALL_READS) & (F.abs(F.col("mean_1") - F.col("mean_2")) >= MIN_DIFFERENCE) & (F.greatest("sd_1", "sd_2") <= MAX_DEVIATION))
    tested = clear.join(rank_sums(own), "site")
    return tested.where((F.col("p") >= 0) & (F.col("p") < P_THRESHOLD)).select("site", "mean_1", "mean_2", "p")


def methylation_votes(levels: DataFrame, phases: DataFrame, sites: DataFrame) -> DataFrame:
    """read, vote (1 or 2) of unphased reads with a clear majority of sites; a site as near to both counts for 2."""
    free = phases.where("phase = 0").select("read")
    seen = known_levels(levels).join(free, "read").join(sites, "site")
    near = F.abs(F.col("m") - F.col("mean_1")) < F.abs(F.col("m") - F.col("mean_2"))
    votes = seen.groupBy("read").agg(F.count_if(near).alias("one"), F.count_if(~near).alias("two"))
    vote = F.when((F.col("one") >= MIN_VOTES) & (F.col("one") > F.col("two")), 1).when((F.col("two") >= MIN_VOTES) & (F.col("two") > F.col("one")), 2)
    return votes.select("read", vote.alias("vote")).where("vote IS NOT NULL")


def phase_by_methylation(levels: DataFrame, phases: DataFrame, max_rounds: int = 10) -> DataFrame:
    """phases with unphased reads phased by votes, round by round until none is added."""
    at = phases.select("read", "phase")
    for _ in range(max_rounds):
        votes = methylation_votes(levels, at, informative_sites(levels, at))
        grown = cut(at.join(votes, "read", "left").select("read", F.coalesce("vote", "phase").alias("phase"), F.col("vote").isNotNull().alias("fresh")))
        at = grown.select("read", "phase")
        if not grown.where("fresh").limit(1).count():
            break
    return at
