"""Half-open genomic ranges and their 1-based literals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_literal(text: str) -> tuple[str, int, int]:
    """'chr:1,000-2,000' as (contig, start, end), 0-based and half-open."""
    contig, _, span = text.rpartition(":")
    found = re.fullmatch(r"([0-9,]+)-([0-9,]+)", span)
    if not contig or not found:
        raise ValueError(f"not a region: {text!r}")
    start, end = (int(x.replace(",", "")) for x in found.groups())
    if start < 1 or end < start:
        raise ValueError(f"not a region: {text!r}")
    return contig, start - 1, end


def to_literal(contig: Column, start: Column, end: Column) -> Column:
    return F.concat(contig, F.lit(":"), (start + 1).cast("string"), F.lit("-"), end.cast("string"))


def literal_range(text: Column) -> Column:
    """(contig, start, end) of a literal; null for what isn't one."""
    pattern = r"^(.+):([0-9,]+)-([0-9,]+)$"
    number = lambda i: F.replace(F.regexp_extract(text, pattern, i), F.lit(","), F.lit("")).try_cast("bigint")
    first, last = number(2), number(3)
    found = F.struct(F.regexp_extract(text, pattern, 1).alias("contig"), (first - 1).alias("start"), last.alias("end"))
    return F.when(text.rlike(pattern) & (first >= 1) & (last >= first), found)


def contains(start: Column, end: Column, position: Column) -> Column:
    return (start <= position) & (position < end)


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start < other_end) & (other_start < end)


def overlap_length(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.least(end, other_end) - F.greatest(start, other_start), F.lit(0))


def around(start: Column, end: Column, half_width: int, n_bases: Column) -> tuple[Column, Column]:
    """The range widened on both sides and clipped to the contig."""
    return F.greatest(start - half_width, F.lit(0)), F.least(end + half_width, n_bases)


def parse_contigs(specs: list[str]) -> list[tuple[int, str, int]]:
    """'NAME:LEN' texts as (number, name, length)."""
    out = []
    for i, spec in enumerate(specs):
        name, _, length = spec.rpartition(":")
        if not name or not length.isdigit():
            raise ValueError(f"not a contig: {spec!r}")
        out.append((i, name, int(length)))
    return out
