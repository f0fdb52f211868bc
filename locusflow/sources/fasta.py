"""FASTA files as reference chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.intervals import in_ranges
from ..operators.pileup import CHUNK


def read_fasta(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(contig, chunk, bases) of FASTA files, upper-cased; each chunk has the next one's bases behind it.

    Lines are put in range partitions of (file, split, row). A line's contig is the last header before it, its place the
    letters since then: both are found within the partition, and from one row for each partition before. So neither
    contigs nor their number need fit in one row or task; letters above a file's first header are left out.
    """
    key = ["file", "block", "row"]
    text = F.regexp_replace("value", r"\s+$", "").alias("line")
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), text).where("line <> ''")
    is_head = F.startswith("line", F.lit(">"))
    lines = lines.withColumn("head", F.when(is_head, F.regexp_extract("line", r"^>(\S*)", 1))).withColumn("letters", F.when(is_head, 0).otherwise(F.length("line")).cast("long"))
    within = Window.partitionBy("__part").orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    ranged = in_ranges(lines, *key).withColumn("end", F.sum("letters").over(within))
    began = F.struct("file", F.col("head").alias("contig"), F.col("end").alias("at"))
    ranged = ranged.withColumn("own", F.last(F.when(F.col("head").isNotNull(), began), ignorenulls=True).over(within))
    # a row a partition: its letters, and its last header
    last = ranged.groupBy("__part").agg(F.sum("letters").alias("n"), F.max_by("own", F.struct(*key)).alias("own"))
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    last = last.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    shifted = F.when(F.col("own").isNotNull(), F.struct("own.file", "own.contig", (F.col("own.at") + F.col("base")).alias("at")))
    carried = last.select(F.col("__part").alias("of"), "base", F.last(shifted, ignorenulls=True).over(ahead).alias("carried"))
    met = ranged.where("head IS NULL").join(F.broadcast(carried), F.col("__part") == F.col("of"))
    here = F.when(F.col("own").isNotNull(), F.struct("own.file", "own.contig", (F.col("own.at") + F.col("base")).alias("at"))).otherwise(F.col("carried"))
    named = met.withColumn("head", here).where(F.col("head.file") == F.col("file"))
    letters = named.select("head.contig", (F.col("end") + F.col("base") - F.col("letters") - F.col("head.at")).alias("at"), F.upper("line").alias("line"))
    first, stop = F.floor(F.col("at") / CHUNK), F.floor((F.col("at") + F.length("line") - 1) / CHUNK)
    spread = letters.withColumn("chunk", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), stop)))
    lo = F.greatest(F.col("chunk") * CHUNK - F.col("at"), F.lit(0)).cast("int")
    hi = F.least((F.col("chunk") + 2) * CHUNK - F.col("at"), F.length("line")).cast("int")
    cut = spread.select("contig", "chunk", "at", F.substring(F.col("line"), lo + 1, hi - lo).alias("part"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "part"))), lambda p: p["part"]), "")
    return cut.groupBy("contig", "chunk").agg(joined.alias("bases"))


def fetch_range(chunks: DataFrame, contig: str, start: int, end: int) -> str | None:
    """Bases of [start, end): '' for an empty range, None where the contig lacks them. One range, for the driver's use."""
    if end <= start:
        return ""
    rows = chunks.where((F.col("contig") == contig) & F.col("chunk").between(start // CHUNK, (end - 1) // CHUNK)).orderBy("chunk").collect()
    text = "".join(r.bases[:CHUNK] for r in rows)
    at = start - start // CHUNK * CHUNK
    found = text[at : at + end - start]
    return found if len(found) == end - start and rows and rows[0].chunk == start // CHUNK else None
