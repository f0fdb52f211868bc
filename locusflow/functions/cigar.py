"""CIGAR strings as arrays of (op, len), with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "MIDNSHP=X"
#: Codes of the binary alignment format, in the order of OPS.
OP_CODE = {op: i for i, op in enumerate(OPS)}
REF_OPS = ("M", "=", "X", "D", "N")
READ_OPS = ("M", "=", "X", "I", "S")
CIGAR_TYPE = "array<struct<op:string,len:int>>"


def is_ref_advancing(op: Column) -> Column:
    return op.isin(*REF_OPS)


def is_read_advancing(op: Column) -> Column:
    return op.isin(*READ_OPS)


def parse_cigar(text: Column) -> Column:
    """(op, len) in order; an error for anything but lengths of one at least, each before a known op."""
    lens = F.regexp_extract_all(text, F.lit(r"([0-9]+)([MIDNSHP=X])"), F.lit(1))
    ops = F.regexp_extract_all(text, F.lit(r"([0-9]+)([MIDNSHP=X])"), F.lit(2))
    units = F.zip_with(ops, lens, lambda o, n: F.struct(o.alias("op"), n.cast("int").alias("len")))
    valid = text.rlike(r"^(?:0*[1-9][0-9]*[MIDNSHP=X])+$")
    return F.when(text.isNull(), F.lit(None).cast(CIGAR_TYPE)).when(valid, units).otherwise(F.raise_error(F.concat(F.lit("bad CIGAR: "), text)).cast(CIGAR_TYPE))


def format_cigar(units: Column) -> Column:
    return F.array_join(F.transform(units, lambda u: F.concat(u["len"].cast("string"), u["op"])), "")


def _span(units: Column, ops: tuple[str, ...]) -> Column:
    return F.aggregate(units, F.lit(0), lambda total, u: total + F.when(u["op"].isin(*ops), u["len"]).otherwise(0))


def ref_span(units: Column) -> Column:
    """Reference bases that the alignment covers."""
    return _span(units, REF_OPS)


def read_span(units: Column) -> Column:
    """Read bases that the alignment uses."""
    return _span(units, READ_OPS)


def with_offsets(units: Column) -> Column:
    """Each unit with its number and the reference and read bases before it: (idx, op, len, ref_off, read_off)."""
    start = F.struct(F.lit(0).alias("ref"), F.lit(0).alias("read"), F.array().cast("array<struct<idx:int,op:string,len:int,ref_off:int,read_off:int>>").alias("out"))

    def step(acc: Column, u: Column) -> Column:
        row = F.struct(F.size(acc["out"]).alias("idx"), u["op"].alias("op"), u["len"].alias("len"), acc["ref"].alias("ref_off"), acc["read"].alias("read_off"))
        return F.struct(
            (acc["ref"] + F.when(u["op"].isin(*REF_OPS), u["len"]).otherwise(0)).alias("ref"),
            (acc["read"] + F.when(u["op"].isin(*READ_OPS), u["len"]).otherwise(0)).alias("read"),
            F.concat(acc["out"], F.array(row)).alias("out"),
        )

    # most reads are one unit, which needs no fold
    one, only, none = F.size(units) == 1, F.get(units, F.lit(0)), F.lit(0)
    alone = F.array(F.struct(none.alias("idx"), only["op"].alias("op"), only["len"].alias("len"), none.alias("ref_off"), none.alias("read_off")))
    return F.when(one, alone).otherwise(F.aggregate(units, start, step, lambda acc: acc["out"]))


def trim_cigar(units: Column, ref_start: Column, ref_length: Column) -> Column:
    """The units over ref_length reference bases, after ref_start of them.

    Insertions and clips stay where as many reference bases as trimmed, or more,
    lie before them, up to the border after the last kept one. Units of no length
    are left out.
    """
    lo, hi = ref_start, ref_start + ref_length

    def cut(u: Column) -> Column:
        first, last = F.greatest(u["ref_off"], lo), F.least(u["ref_off"] + u["len"], hi)
        return F.struct(u["op"].alias("op"), F.when(u["op"].isin(*REF_OPS), last - first).when(u["ref_off"].between(lo, hi), u["len"]).otherwise(0).cast("int").alias("len"))

    return F.filter(F.transform(with_offsets(units), cut), lambda u: u["len"] > 0)


def trimmed_bases(units: Column, ref_start: Column) -> Column:
    """Read bases that trim_cigar drops before the first unit it keeps."""

    def dropped(u: Column) -> Column:
        onto = F.when(u["op"].isin(*REF_OPS), F.least(ref_start - u["ref_off"], u["len"])).when(u["ref_off"] < ref_start, u["len"])
        return F.when(u["op"].isin(*READ_OPS), F.greatest(onto, F.lit(0))).otherwise(0)

    return F.aggregate(with_offsets(units), F.lit(0), lambda total, u: (total + F.coalesce(dropped(u), F.lit(0))).cast("int"))


def haplotype_to_ref(units: Column, position: Column, start: Column) -> Column:
    """Where a haplotype's position lies on the reference; inside an insertion the base before it, outside null."""
    rows = F.filter(with_offsets(units), lambda u: u["op"].isin(*READ_OPS) & (u["read_off"] <= position) & (position < u["read_off"] + u["len"]))
    at = F.get(rows, F.lit(0))
    return F.when(at["op"].isin("M", "=", "X"), start + at["ref_off"] + position - at["read_off"]).when(at["op"] == "I", start + F.greatest(at["ref_off"] - 1, F.lit(0)))
