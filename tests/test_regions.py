"""Segmented scans, regions of phasing and whole windows of assembly against brute force."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from locusflow.operators import assembly, intervals, phasing, pileup


@pytest.fixture(params=["1", "7"])
def parts(spark, request):
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    yield int(request.param)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def merged(rows, touching=True):
    out = []
    for contig, start, end in sorted(rows):
        last = out[-1] if out and out[-1][0] == contig else None
        if last and (start <= last[2] if touching else start < last[2]):
            last[2] = max(last[2], end)
        else:
            out.append([contig, start, end])
    return sorted(map(tuple, out))


@pytest.mark.parametrize("touching", [True, False])
def test_merge_intervals(spark, parts, touching):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "b", "c"]), s := rng.randint(0, 5000), s + rng.choice([1, 5, 30])) for _ in range(300)]
    # some reach over many partitions, one contig is one interval, equal rows are repeated
    rows += [("a", 10, 2500), ("b", 0, 5100), ("d", 7, 8)] + [("c", 100, 120)] * 50
    df = spark.createDataFrame(rows, "contig string, start long, end long")
    got = sorted((r.contig, r.start, r.end) for r in intervals.merge_intervals(df, touching=touching).collect())
    assert got == merged(rows, touching)
    padded = sorted((r.contig, r.start, r.end) for r in intervals.merge_intervals(df, pad=40).collect())
    assert padded == merged([(c, max(s - 40, 0), e + 40) for c, s, e in rows])


def test_islands(spark, parts):
    rng = random.Random(9)
    rows = [(c, p, rng.randint(1, 4)) for c in ("x", "y") for p in range(400) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, "contig string, pos long, score int")
    got = sorted((r.contig, r.start, r.end, r.n) for r in intervals.islands(df, 2).collect())
    assert got == [(c, s, e, e - s) for c, s, e in merged([(c, p, p + 1) for c, p, n in rows if n >= 2])]
    # one island over all partitions
    one = spark.range(1000).select(F.lit("z").alias("contig"), F.col("id").alias("pos"), F.lit(9).alias("score"))
    assert [tuple(r) for r in intervals.islands(one, 1).select("start", "end", "n").collect()] == [(0, 1000, 1000)]


def test_no_rows(spark, parts):
    none = spark.createDataFrame([], "contig string, start long, end long")
    assert intervals.merge_intervals(none).collect() == []


# regions of phasing

SUPPORT = "contig string, start long, end long, allele string, read_key string, is_low_quality boolean"


def random_support(seed, length=3000, reads=160):
    """Reads of two haplotypes over sites with gaps of all widths, some over the old borders of 400 bases."""
    rng = random.Random(seed)
    sites = sorted(rng.sample(range(5, length), 90))
    # the last ones are no candidates to phase, so that the contig's last region isn't its last candidate's
    rows = []
    for r in range(reads):
        at, hap = rng.randint(0, length), rng.randint(0, 1)
        size = rng.choice([20, 60, 150])
        for s in sites:
            if at <= s < at + size:
                allele = ("C", "G")[hap] if rng.random() < 0.95 else rng.choice(["C", "G", phasing.REF])
                rows.append(("c", s, s + 1, allele, f"r{r}", rng.random() < 0.05))
    return rows + [("c", length + 200 + n, length + 201 + n, "C", f"alone{n}", False) for n in range(0, 90, 30)] + [("c", 0, 1, "G", "first", False)]


def whole_contig(rows):
    """One programme over all candidates."""
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["contig", "start", "end", "allele", "read_key", "is_low_quality"])
    return phasing.Phaser(phasing._candidates(frame)).run(), sorted(set(frame["read_key"]))


@pytest.mark.parametrize("seed", range(3))
def test_regions_change_no_phase(spark, parts, seed):
    """Blocks and reads as of one programme over the contig, although regions run apart."""
    rows = random_support(seed)
    support = phasing.link_regions(spark.createDataFrame(rows, SUPPORT))
    regions = {r.region for r in support.select("region").distinct().collect()}
    assert len(regions) > 3
    whole, reads = whole_contig(rows)
    own = phasing.phase_sets(phasing.phase_regions(support)).collect()
    want = spark.createDataFrame([("c", *r) for r in whole.phased()], "region string, start long, phase_1 string, phase_2 string, is_first boolean")
    assert len(own) > 5
    columns = ("start", "phase_1", "phase_2", "ps")
    assert sorted(tuple(r[c] for c in columns) for r in own) == sorted(tuple(r[c] for c in columns) for r in phasing.phase_sets(want).collect())
    votes = defaultdict(set)
    for r in phasing.phase_reads(support).collect():
        votes[r.read_key].add(r.phase)
    assert {k: max(v) for k, v in votes.items()} == dict(zip(reads, whole.read_phases(reads), strict=True))
    # no read is in two regions
    assert support.where("NOT is_low_quality").groupBy("read_key").agg(F.countDistinct("region").alias("n")).where("n > 1").count() == 0


def test_links_over_old_borders(spark):
    """Sites at both sides of 400 and 800 that reads link are one block."""
    sites = [380, 390, 395, 405, 410, 790, 795, 805, 815]
    rows = []
    for hap in (0, 1):
        for n in range(4):
            for lo, hi in ((380, 411), (395, 411), (790, 816)):
                rows += [("c", s, s + 1, "TG"[hap], f"h{hap}n{n}at{lo}", False) for s in sites if lo <= s < hi]
    support = phasing.link_regions(spark.createDataFrame(rows, SUPPORT))
    assert {(r.start, r.region) for r in support.select("start", "region").distinct().collect()} == {(s, "c:380" if s < 500 else "c:790") for s in sites}
    sets = phasing.phase_sets(phasing.phase_regions(support)).collect()
    assert {(r.start, r.ps) for r in sets} == {(s, 380 if s < 500 else 790) for s in sites}
    for block in ((s for s in sites if s < 500), (s for s in sites if s > 500)):
        block = set(block)
        assert len({(r.phase_1, r.phase_2) for r in sets if r.start in block}) == 1


def test_an_indel_holds_sites_together(spark):
    """A candidate that lies across sites that no read links keeps them in one region, so its shadow isn't cut."""
    rows = [("c", 100, 140, "A" * 40, f"a{n}", False) for n in range(3)] + [("c", 120, 121, "T", f"b{n}", False) for n in range(3)] + [("c", 140, 141, "T", f"d{n}", False) for n in range(3)]
    support = phasing.link_regions(spark.createDataFrame(rows, SUPPORT))
    assert {(r.start, r.region) for r in support.select("start", "region").distinct().collect()} == {(100, "c:100"), (120, "c:100"), (140, "c:140")}


# windows of assembly


def windows_and_reads(spark, ref, reads):
    df = spark.createDataFrame(reads, "contig string, start long, end long, seq string, bq array<int>, mapq int")
    chunks = pileup.reference_chunks(spark.createDataFrame([("c", ref)], "contig string, bases string"))
    return df, chunks


@pytest.mark.parametrize("gone", [56, 80, 120, 200])
def test_deletions_longer_than_a_piece(spark, gone):
    rng = random.Random(gone)
    ref = "".join(rng.choices("ACGT", k=1500))
    at = 700
    alt = ref[:at] + ref[at + gone :]
    reads = [("c", s, s + 100, ref[s : s + 100], [30] * 100, 60) for s in range(500, 1000, 4)]
    reads += [("c", s, s + 100 + gone, alt[s : s + 100], [30] * 100, 60) for s in range(610, 690, 4) for _ in range(2)]
    df, chunks = windows_and_reads(spark, ref, reads)
    windows = intervals.merge_intervals(spark.createDataFrame([("c", at, at + gone)], "contig string, start long, end long"), pad=50)
    made = assembly.assemble_windows(windows, df, pileup.reference_windows(windows, chunks)).collect()
    lo, hi = at - 50, at + gone + 50
    graph = assembly.build_graph(ref[lo:hi], [(seq, bq, mapq) for _, s, e, seq, bq, mapq in reads if s < hi and e > lo])
    spelled = assembly.haplotypes(graph)
    # the deletion is a haplotype of the whole window; beyond 95 bases its gap costs more than a flank of 50 matches gives
    assert sorted(spelled) == sorted([ref[lo:hi], ref[lo:at] + ref[at + gone : hi]])
    want = {v for h in spelled if h != ref[lo:hi] for v in assembly.variants_of("c", lo, ref[lo:hi], h)}
    assert {(r.contig, r.start, r.end, r.ref, r.alts[0]) for r in made} == want
    assert gone > 95 or sum(e - s - 1 for _, s, e, _, _ in want) == gone


def test_window_over_many_chunks(spark):
    rng = random.Random(1)
    ref = "".join(rng.choices("ACGT", k=4300))
    chunks = pileup.reference_chunks(spark.createDataFrame([("c", ref)], "contig string, bases string"))
    spans = [(0, 10), (990, 1010), (5, 3900), (1000, 2000), (4000, 5000), (4299, 4301)]
    windows = spark.createDataFrame([("c", *s) for s in spans], "contig string, start long, end long")
    got = {(r.start, r.end): r.bases for r in pileup.reference_windows(windows, chunks).collect()}
    assert got == {(s, e): ref[s:e] for s, e in spans}


def test_deep_windows_are_counted(spark):
    """Ten thousand reads of few different texts are as many rows of a group as there are texts, and give the variants of few."""
    rng = random.Random(2)
    ref = "".join(rng.choices("ACGT", k=400))
    alt = ref[:200] + ("A" if ref[200] != "A" else "C") + ref[201:]
    few = [("c", s, s + 100, text[s : s + 100], [30] * 100, 60) for s in (120, 140, 160) for text in (ref, alt)]
    windows = spark.createDataFrame([("c", 100, 300)], "contig string, start long, end long")
    results = []
    for times in (2, 2000):
        df, chunks = windows_and_reads(spark, ref, few)
        many = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("copy")
        results.append(sorted(map(tuple, assembly.assemble_windows(windows, many, pileup.reference_windows(windows, chunks)).collect()), key=str))
    assert results[0] == results[1] == [("c", 200, 201, ref[200], [alt[200]])]


def test_good_stretches(spark):
    rows = [("c", 0, 40, "ACGTACGTACGTNACGTACGTACGTAAAA", [30] * 12 + [30] + [30] * 12 + [5] + [30] * 3, 60), ("c", 0, 9, "ACGTACGTACGTACGT", [30] * 16, 3), ("c", 0, 9, "", [], 60), ("c", 0, 9, "acgtacgtacgtac", [30] * 10, 60)]
    df = spark.createDataFrame(rows, "contig string, start long, end long, seq string, bq array<int>, mapq int")
    assert sorted(r.stretch for r in assembly.good_stretches(df).collect()) == ["ACGTACGTACGT", "ACGTACGTACGT"]


def test_graph_of_stretches_is_that_of_reads():
    rng = random.Random(5)
    ref = "".join(rng.choices("ACGT", k=160))
    reads = []
    for _ in range(60):
        s = rng.randint(0, 100)
        bases = [b if rng.random() > 0.02 else rng.choice("ACGTN") for b in ref[s : s + 60]]
        reads.append(("".join(bases), [rng.choice([30, 30, 30, 30, 30, 30, 30, 5]) if i % 20 == 0 else 30 for i in range(60)], 60))
    stretches = defaultdict(int)
    for bases, quals, _ in reads:
        text = "".join(b if b in "ACGT" and q >= 15 else " " for b, q in zip(bases, quals, strict=True))
        for part in text.split():
            stretches[part] += 1
    one, two = assembly.build_graph(ref, reads), assembly.build_graph(ref, [], stretches=sorted(stretches.items()))
    assert one.k == two.k and one.weight == two.weight
    assert assembly.haplotypes(one) == assembly.haplotypes(two)


def test_ranked_haplotypes(spark):
    """Scores, order and alignments of whole windows, reads one by one."""
    rng = random.Random(12)
    ref = "".join(rng.choices("ACGT", k=300))
    texts = [ref, ref[:120] + "T" + ref[121:], ref[:150] + ref[156:] + "ACGTAC", ref[:170] + "GGA" + ref[170:]]
    rows = [("c", s, s + 60, texts[k][s : s + 60], [30] * 59 + [rng.choice([5, 30])], rng.choice([60, 3])) for k in (0, 0, 1, 2, 3) for s in range(80, 200, 3) for _ in range(2)]
    df, chunks = windows_and_reads(spark, ref, rows)
    windows = spark.createDataFrame([("c", 90, 210), ("c", 100, 160)], "contig string, start long, end long")
    got = assembly.rank_haplotypes(windows, df, pileup.reference_windows(windows, chunks), bin_width=32).collect()
    for lo, hi in ((90, 210), (100, 160)):
        own = [(seq, bq, mapq) for _, s, e, seq, bq, mapq in rows if s < hi and e > lo]
        want = assembly.realign_window(ref[lo:hi], own)
        mine = sorted((r for r in got if r.start == lo), key=lambda r: r["rank"])
        assert [(r.haplotype, r.score, r.is_reference, r.n_aligned) for r in mine] == [(h.haplotype, h.score, h.is_reference, sum(a is not None for a in h.alignments)) for h in want]
        assert [r.to_reference for r in mine] == [assembly.cigar_text(h.to_reference.cigar) for h in want] and len(mine) > 1
