"""Composed runs, field maps, FASTA of many files, and look-ups that begin with sites."""

import random

import pytest
from pyspark.sql import functions as F

from locusflow.functions import fields
from locusflow.operators import methylation, phasing, pileup
from locusflow.plans import fixtures as fx
from locusflow.plans import stages
from locusflow.plans.queries import calling_stages
from locusflow.sources import fasta

DATA = "/root/testdata/sf0.001"


def lines_of(spark, folder, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        reads = fx.reads(spark, DATA).where("rid < 1200").repartition(parts)
        run = stages.run_stages(spark, folder, calling_stages(fx.reference(spark, DATA), ["chr1", "chr2", "chr3"]), {"reads": reads})
        return [r.line for r in run["lines"].orderBy(F.regexp_extract("contig", r"\d+", 0).cast("int"), "start").collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_a_run_does_not_depend_on_partitions(spark, tmp_path):
    one, five = lines_of(spark, f"{tmp_path}/one", 1), lines_of(spark, f"{tmp_path}/five", 5)
    assert sorted(one) == sorted(five) and len(one) > 100
    assert all(len(x.split("\t")) == 10 for x in one)


def test_a_run_goes_on_where_it_ended(spark, tmp_path):
    made = []

    def plan(fails, add=1):
        def first(t):
            made.append("first")
            return t.withColumn("x", F.col("id") + add)

        def second(t):
            made.append("second")
            if fails:
                raise RuntimeError("lost")
            return t.withColumn("y", F.col("x") * 2)

        return [stages.Stage("first", ("t",), first, (add,)), stages.Stage("second", ("first",), second)]

    table = {"t": spark.range(5).toDF("id")}
    with pytest.raises(RuntimeError):
        stages.run_stages(spark, str(tmp_path), plan(True), table)
    got = stages.run_stages(spark, str(tmp_path), plan(False), table)["second"]
    assert sorted(r.y for r in got.collect()) == [2, 4, 6, 8, 10]
    assert made == ["first", "second", "second"]
    stages.run_stages(spark, str(tmp_path), plan(False), table)
    assert made == ["first", "second", "second"]
    got = stages.run_stages(spark, str(tmp_path), plan(False, 3), table)["second"]
    assert sorted(r.y for r in got.collect()) == [6, 8, 10, 12, 14] and made == ["first", "second", "second", "first", "second"]
    # a write that was cut off has no marker
    (next(p for p in tmp_path.iterdir() if p.name.startswith("second")) / "_SUCCESS").unlink()
    stages.run_stages(spark, str(tmp_path), plan(False), table)
    stages.run_stages(spark, str(tmp_path), plan(False, 3), table)
    assert made.count("second") == 4 and made.count("first") == 2
    # other versions of a table are other inputs
    stages.run_stages(spark, str(tmp_path), plan(False), table, {"t": "another"})
    assert made.count("first") == 3


def test_fields_follow_their_alleles(spark):
    rows = [({"MD": [9.0, 1.0, 2.0, 3.0], "NAF": [0.1, 0.2, 0.3], "GL": [float(i) for i in range(10)], "OTHER": [7.0], "NAD": [1.0]}, keep) for keep in ([True, False, True], [True] * 3, [False] * 3, [False, True, False])]
    df = spark.createDataFrame(rows, "info map<string,array<double>>, keep array<boolean>")
    got = [r.p for r in df.select(fields.pruned(F.col("info"), F.col("keep")).alias("p")).collect()]
    pairs = [(a, b) for b in range(4) for a in range(b + 1)]
    for p, (info, keep) in zip(got, rows, strict=True):
        stays = [True, *keep]
        assert p["MD"] == [x for x, s in zip(info["MD"], stays, strict=True) if s]
        assert p["NAF"] == [x for x, s in zip(info["NAF"], keep, strict=True) if s]
        assert p["GL"] == [float(i) for i, (a, b) in enumerate(pairs) if stays[a] and stays[b]]
        assert p["OTHER"] == [7.0] and p["NAD"] == [1.0]
    r = fields.with_fields(df, "MD", "NAF", "PS").first()
    assert r.md == [9, 1, 2, 3] and r.naf == [0.1, 0.2, 0.3] and r.ps is None


def test_methylated(spark):
    level = F.col("level").cast("int")
    rows = spark.createDataFrame([(128,), (0,), (None,), (255,)], "level int").select(*(methylation.is_methylated(level, t, on).alias(f"c{i}") for i, (t, on) in enumerate(((0.5, True), (0.51, True), (0.0, True), (0.5, False)))))
    assert [tuple(r) for r in rows.collect()] == [(True, False, True, False), (False,) * 4, (False,) * 4, (True, True, True, False)]


def test_allele_types(spark):
    rows = [("c", 5, 7, a, f"{a}{n}", False) for a, k in (("AC", 3), ("AG", 2), ("A", 4), ("ACC", 1), (phasing.REF, 5), (phasing.UNCALLED, 2)) for n in range(k)] + [("c", 9, 10, phasing.REF, "x", False)]
    support = spark.createDataFrame(rows, "contig string, start long, end long, allele string, read_key string, is_low_quality boolean")
    got = {r.start: (r.n_substitutions, r.n_indels, r.substitution_depth) for r in phasing.allele_type_counts(support).collect()}
    assert got == {5: (2, 2, 5), 9: (0, 0, 0)}


@pytest.mark.parametrize("parts", ["1", "6"])
def test_fasta_of_many_files(spark, tmp_path, parts):
    rng, want = random.Random(5), {}
    for f in range(3):
        text = "lines above a header are of no contig\n" if f == 1 else ""
        for c in range(40):
            name, size = f"f{f}c{c}", rng.choice([0, 1, 59, 60, 61, 999, 1000, 1001, 4100])
            bases = "".join(rng.choices("acgtN", k=size))
            width = rng.choice([60, 70, 5000])
            text += f">{name} of file {f}\r\n" + "".join(bases[i : i + width] + rng.choice(["\n", "\r\n"]) for i in range(0, size, width)) + "\n" * rng.randint(0, 2)
            if size:
                want[name] = bases.upper()
        (tmp_path / f"{f}.fa").write_text(text, newline="")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        chunks = [tuple(r) for r in fasta.read_fasta(spark, str(tmp_path)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    expected = {(c, k, b[1000 * k : 1000 * k + 2000]) for c, b in want.items() for k in range(-(-len(b) // 1000))}
    assert len(chunks) == len(expected) and set(chunks) == expected


def test_bases_at_sites_are_those_of_all_bases(spark):
    reads = fx.reads(spark, DATA).where("rid < 900")
    sites = spark.range(0, 400, 7).select(F.lit("chr2").alias("contig"), F.col("id").alias("pos"))
    columns = ["contig", "pos", "base", "bq", "mapq", "is_rev"]
    want = pileup.aligned_bases(reads).join(sites, ["contig", "pos"]).select(*columns).collect()
    for width in (1, 8, 64, 1000):
        got = pileup.bases_at(sites.unionByName(sites), reads, width).select(*columns).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 50


def test_indel_quality_of_runs(spark):
    """A run's bases share the quality of the errors that its tags state; without any, or with tags that don't fit, it is the best."""
    from locusflow.operators import channels as ch

    df = spark.createDataFrame([("AAACC", [10, 20, 30, 11, 12], [-1, 0, -1, 1, 0]), ("AAACC", [10], [0]), ("", [], [])], "seq string, quals array<int>, tps array<int>")
    got = [tuple(r) for r in df.select(*(ch.homopolymer_indel_quality(F.col("seq"), F.col("quals"), F.col("tps"), d) for d in (True, False))).collect()]
    scale = lambda q: int(254 * q / 93)
    # 0.1 + 0.001 is 9.96 in phred, cut to 9; 11 may be cut to 10
    assert got[0][0] == [scale(9)] * 3 + [254] * 2
    assert got[0][1][:3] == [254] * 3 and got[0][1][3] == got[0][1][4] in (scale(10), scale(11))
    assert got[1] == ([254] * 5, [254] * 5) and got[2] == ([], [])
