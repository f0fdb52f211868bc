"""Alignment files: BAM by a splittable data source; other formats give a clear error."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .bam import READS_TYPE, BamSource
from .bgzf import pack_blocks, unpack_blocks
from .shards import parse_spec

__all__ = ["READS_TYPE", "format_of", "pack_blocks", "read_alignments", "unpack_blocks", "write_alignments"]


def format_of(path: str) -> str:
    """'bam' or 'cram' by the extension, in any case."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in ("bam", "cram"):
        raise ValueError(f"not an alignment file: {path!r}")
    return kind


def read_alignments(spark: SparkSession, paths: str | list[str], split_bytes: int = 32 << 20, region: tuple[str, int, int] | None = None) -> DataFrame:
    """Reads of BAM files, or of the .bam files of folders, in partitions of about split_bytes of a file each.

    region: (contig, start, end), half-open; a .bai file beside a file prunes what is read of
    it. read_ordinal is the record's virtual offset: it grows along a file, and the same
    record has the same one however the file is cut.
    """
    paths = [paths] if isinstance(paths, str) else paths
    for path in paths:
        if not path.lower().endswith(".bam") and "." in path.rsplit("/", 1)[-1] and format_of(path) == "cram":
            raise NotImplementedError("CRAM needs a codec library that is not part of this package; convert to BAM")
    spark.dataSource.register(BamSource)
    reader = spark.read.format("locus_bam").option("paths", json.dumps(paths)).option("split_bytes", split_bytes)
    if region:
        contig, start, end = region
        reader = reader.option("contig", contig).option("start", start).option("end", end)
    return reader.load()


def write_alignments(reads: DataFrame, spec: str, contigs: list[tuple[str, int]], block_bytes: int | None = None) -> None:
    """Reads as N sorted BAM files 'base-00000-of-0000N.bam' with an index each, written by N tasks; spec: 'base@N.bam'.

    Files are ranges of the whole order, and get their names when all of them are written.
    """
    spark, (_, shards, _) = reads.sparkSession, parse_spec(spec)
    spark.dataSource.register(BamSource)
    place = F.coalesce(F.array_position(F.array(*(F.lit(name) for name, _ in contigs)), F.col("contig")), F.lit(0)).cast("int")
    last = F.when(place > 0, place).otherwise(len(contigs) + 1)
    order = [last, F.col("ref_start"), F.col("name"), F.col("mate")]
    given = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in reads.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(READS_TYPE)]
    ordered = reads.repartitionByRange(shards, *order).sortWithinPartitions(*order).select(*given)
    writer = ordered.write.format("locus_bam").mode("append").option("contigs", json.dumps(contigs))
    (writer.option("block_bytes", block_bytes) if block_bytes else writer).save(spec)
