"""Interval operators: overlap joins by bins, islands, merging, subtraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut


def _binned(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    first = F.floor(F.col(start) / width)
    last = F.floor((F.col(end) - 1) / width)
    return df.where(F.col(start) < F.col(end)).withColumn("__bin", F.explode(F.sequence(first, last)))


def interval_join(left: DataFrame, right: DataFrame, bin_width: int = 1024, buffer: int = 0, contig: str = "contig", how: str = "inner") -> DataFrame:
    """Pairs whose half-open intervals on the same contig overlap, right's columns with prefix r_.

    An equi-join on (contig, bin): both sides go to every bin they touch, and a
    pair is kept in the first bin that both touch, so it comes once without a
    distinct. Choose bin_width near the longer side's usual length. buffer widens
    the left intervals on both sides. Empty intervals overlap nothing. how:
    inner, left_semi or left_anti.
    """
    lo, hi = F.col("start") - buffer, F.col("end") + buffer
    own = left.withColumn("__lo", lo).withColumn("__hi", F.when(F.col("start") < F.col("end"), hi).otherwise(lo))
    other = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    same_bin = F.floor(F.greatest("__lo", "r_start") / bin_width) == F.col("__bin")
    overlap = (F.col("__lo") < F.col("r_end")) & (F.col("r_start") < F.col("__hi"))
    # the left side starts a buffer earlier, and bins before 0 are as good as others
    a = _binned(own, "__lo", "__hi", bin_width)
    b = _binned(other, "r_start", "r_end", bin_width).withColumnRenamed("__bin", "__rbin")
    on = (F.col(contig) == F.col(f"r_{contig}")) & (F.col("__bin") == F.col("__rbin")) & overlap
    if how == "inner":
        return a.join(b, on & same_bin).drop("__bin", "__rbin", "__lo", "__hi")
    # semi and anti look at whole rows, whatever bins they are in
    keyed = own.withColumn("__row", F.struct(*left.columns))
    hit = _binned(keyed, "__lo", "__hi", bin_width).join(b, on, "left_semi").select("__row").distinct().select(F.col("__row").alias("__hit"))
    return keyed.join(hit, F.col("__row").eqNullSafe(F.col("__hit")), how).select(*left.columns)


def point_join(points: DataFrame, intervals: DataFrame, position: str = "pos", bin_width: int = 1024) -> DataFrame:
    """Points inside intervals (start <= position < end) on the same contig, intervals' columns with prefix r_."""
    a = points.withColumn("__bin", F.floor(F.col(position) / bin_width))
    b = _binned(intervals.select(*(F.col(c).alias(f"r_{c}") for c in intervals.columns)), "r_start", "r_end", bin_width).withColumnRenamed("__bin", "__rbin")
    inside = (F.col("r_start") <= F.col(position)) & (F.col(position) < F.col("r_end"))
    return a.join(b, (F.col("contig") == F.col("r_contig")) & (F.col("__bin") == F.col("__rbin")) & inside).drop("__bin", "__rbin")


def in_ranges(df: DataFrame, *order: str) -> DataFrame:
    """df checkpointed in range partitions of the order, their number in a column __part."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))


def numbered_runs(intervals: DataFrame, touching: bool = True) -> DataFrame:
    """intervals (contig, start, end, ...) with __run: the same number for all that overlap (or touch) each other, directly or not.

    A segmented scan over range partitions: how far the intervals before reach is the greatest
    end within the partition and, of the partitions before, one row for each contig
    there; runs are numbered within partitions, and one row a partition shifts the numbers. So a
    contig is as many tasks' work as it has partitions.
    """
    ranged = in_ranges(intervals, "contig", "start", "end")
    ahead = Window.partitionBy("contig").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ranged.groupBy("contig", "__part").agg(F.max("end").alias("__far"))
    ends = ends.select(F.col("contig").alias("__contig"), F.col("__part").alias("__of"), F.max("__far").over(ahead).alias("__far"))
    own = Window.partitionBy("__part", "contig").orderBy("start", "end")
    met = ranged.join(ends, F.col("contig").eqNullSafe(F.col("__contig")) & (F.col("__part") == F.col("__of"))).drop("__contig", "__of")
    reach = F.greatest(F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.col("__far"))
    apart = F.col("start") > reach if touching else F.col("start") >= reach
    marked = met.withColumn("__new", F.when(reach.isNull() | apart, 1).otherwise(0)).drop("__far")
    counts = marked.groupBy("__part").agg(F.sum("__new").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("__part").alias("__of"), before.alias("__before"))  # a row a partition
    within = Window.partitionBy("__part").orderBy("contig", "start", "end").rowsBetween(Window.unboundedPreceding, 0)
    done = marked.withColumn("__run", F.sum("__new").over(within)).join(F.broadcast(counts), F.col("__part") == F.col("__of"))
    return done.withColumn("__run", F.col("__run") + F.col("__before")).drop("__part", "__of", "__before", "__new")


def islands(scores: DataFrame, least: Column | int) -> DataFrame:
    """Runs of consecutive positions whose score is least at least: contig, start, end (exclusive), n."""
    hot = scores.where(F.col("score") >= least).select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"))
    runs = numbered_runs(hot).groupBy("contig", "__run")
    return runs.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("__run")


def merge_intervals(intervals: DataFrame, pad: int = 0, touching: bool = True) -> DataFrame:
    """Intervals widened by pad (not below 0), overlapping ones as one, and touching ones too."""
    wide = intervals.select("contig", F.greatest(F.col("start") - pad, F.lit(0)).alias("start"), (F.col("end") + pad).alias("end"))
    # equal intervals are one before they are shuffled
    return numbered_runs(wide.distinct(), touching).groupBy("contig", "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")


def subtract_intervals(intervals: DataFrame, holes: DataFrame, bin_width: int = 1024, key: str = "block") -> DataFrame:
    """What the holes leave of each interval: intervals' columns with start and end of each rest.

    key names each interval uniquely.
    """
    merged = merge_intervals(holes)
    met = interval_join(intervals, merged, bin_width)
    order = Window.partitionBy(key).orderBy("r_start")
    before = F.greatest(F.coalesce(F.lag("r_end").over(order), F.col("start")), F.col("start"))
    gaps = met.select(*intervals.columns, before.alias("__from"), F.col("r_start").alias("__to"), F.lead("r_start").over(order).isNull().alias("__last"), F.col("r_end").alias("__after"))
    pieces = F.array(F.struct(F.col("__from").alias("s"), F.col("__to").alias("e")), F.struct(F.when(F.col("__last"), F.col("__after")).alias("s"), F.col("end").alias("e")))
    rest = gaps.withColumn("__piece", F.explode(pieces)).where("__piece.s < __piece.e")
    names = [F.col("__piece.s").alias("start") if c == "start" else F.col("__piece.e").alias("end") if c == "end" else F.col(c) for c in intervals.columns]
    whole = intervals.where("start < end").join(met.select(key).distinct(), key, "left_anti")
    return rest.select(*names).unionByName(whole.select(*intervals.columns))


def spans(ranges: DataFrame, group: str) -> DataFrame:
    """One range over each group's ranges; null where a group has several contigs."""
    found = ranges.groupBy(group).agg(F.min("contig").alias("lo"), F.max("contig").alias("hi"), F.min("start").alias("start"), F.max("end").alias("end"))
    one = F.col("lo") == F.col("hi")
    return found.select(group, *(F.when(one, F.col(c)).alias(a) for c, a in (("lo", "contig"), ("start", "start"), ("end", "end"))))
