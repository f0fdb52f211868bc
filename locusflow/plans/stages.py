"""Runs of several stages whose results are kept: a rerun goes on where the last one ended."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Stage:
    """A table made of tables: its name, those it reads, what makes it of them, and settings that change it."""

    name: str
    inputs: tuple[str, ...]
    make: Callable[..., DataFrame]
    settings: tuple = ()


def fingerprints(stages: list[Stage], sources: dict[str, str]) -> dict[str, str]:
    """By stage, a digest of its name, its settings and its inputs' digests; sources: what tells an outer input's state."""
    known = dict(sources)
    for stage in stages:
        said = json.dumps([stage.name, list(map(str, stage.settings)), [known[i] for i in stage.inputs]])
        known[stage.name] = hashlib.sha256(said.encode()).hexdigest()[:24]
    return {s.name: known[s.name] for s in stages}


def run_stages(spark: SparkSession, folder: str, stages: list[Stage], tables: dict[str, DataFrame], versions: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All tables by name, stages' results written under folder and read again.

    A stage's folder is named by its fingerprint, and counts as done when Spark has committed it (its marker of success
    is there): then it is read, not made. A stage that was cut off has no marker and is written anew; other settings or
    inputs give another folder. versions: of the given tables, their names by default.
    """
    marks = fingerprints(stages, {name: (versions or {}).get(name, name) for name in tables})
    known = dict(tables)
    for stage in stages:
        path = f"{folder}/{stage.name}-{marks[stage.name]}"
        if not _committed(spark, path):
            made = stage.make(*(known[i] for i in stage.inputs))
            made.write.mode("overwrite").parquet(path)
        known[stage.name] = spark.read.parquet(path)
    return known


def _committed(spark: SparkSession, path: str) -> bool:
    """Whether Spark's marker of a finished write is in the folder."""
    marker = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(marker)
