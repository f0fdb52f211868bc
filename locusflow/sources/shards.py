"""Sharded file names and phase tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_spec(spec: str) -> tuple[str, int, str]:
    """'base@N' or 'base@N.suffix' as (base, N, suffix)."""
    found = re.fullmatch(r"(.*)@(\d+)(?:\.(.*))?", spec)
    if not found or not int(found[2]):
        raise ValueError(f"not a sharded file: {spec!r}")
    return found[1], int(found[2]), found[3] or ""


def shard_name(spec: str, shard: int) -> str:
    """'base-00003-of-00010.suffix'; the number has five digits, or as many as N has, nine at most; N five at least."""
    base, n, suffix = parse_spec(spec)
    width = min(max(5, len(str(n))), 9)
    return f"{base}-{shard:0{width}d}-of-{n:05d}{'.' + suffix if suffix else ''}"


def shard_names(spec: str) -> list[str]:
    return [shard_name(spec, i) for i in range(parse_spec(spec)[1])]


def read_phases(spark: SparkSession, path: str, shard: int = 0) -> DataFrame:
    """fragment, phase, region, shard of a tab-separated file with a header; a region below 1 is an error."""
    rows = spark.read.csv(path, sep="\t", header=True, schema="fragment string, phase int, region int", mode="FAILFAST")
    checked = F.when(F.col("region") > 0, F.col("region")).otherwise(F.raise_error(F.lit("a region is below 1")).cast("int"))
    return rows.where("fragment IS NOT NULL").select("fragment", "phase", checked.alias("region"), F.lit(shard).alias("shard"))
