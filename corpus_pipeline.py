"""The corpus pipeline: quality, lines, near duplicates, substrings, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes every
stage's result as Parquet into the shared folder and reads it as the next one's
docs. All stages but the last keep the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.llm.common import materialise
from locusflow.llm.line_dedup import line_dedup
from locusflow.llm.ngram_join import first_of_component
from locusflow.llm.packing import pack
from locusflow.llm.quality import score_quality
from locusflow.llm.queries import tokenizer_file
from locusflow.llm.substring_dedup import substring_dedup


def _aside(docs: DataFrame) -> DataFrame:
    """docs with all columns but doc_id and text put aside in one, where no operator's own columns can replace them."""
    others = [F.col(c) for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*others, F.lit(None).cast("string").alias("__lf_none")).alias("__lf_aside"))


def _back(done: DataFrame, docs: DataFrame, new_text: bool = True) -> DataFrame:
    """done in the columns of docs, n_chars (where there is one) being that of a new text."""
    put = lambda c: F.col(c) if c in ("doc_id", "text") else F.col(f"__lf_aside.{c}").alias(c)
    columns = [F.length("text").cast(docs.schema[c].dataType).alias(c) if new_text and c == "n_chars" else put(c) for c in docs.columns]
    return done.select(*columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    scored = score_quality(_aside(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(scored.where("predicted = 1"), docs, new_text=False)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that three or more documents hold, but for one document."""
    return _back(line_dedup(_aside(docs)), docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return first_of_component(docs, width=5, num=80, den=100)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without runs of sentences that occurred before."""
    return _back(substring_dedup(_aside(docs)), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their places in sequences of 2048 ids."""
    return pack(docs, tokenizer_file("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", keep_one_of_each_group),
    ("substring_dedup", drop_repeated_passages),
    ("packing", pack_sequences),
]

#: A trained model and a tokenizer decide on rows: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
