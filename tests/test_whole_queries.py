"""Queries without SQL against brute force over whole small tables."""

import hashlib
import random
from collections import defaultdict

from locusflow.operators import assembly, images, pileup
from locusflow.plans import fixtures as fx
from locusflow.plans.queries import QUERIES, _sites

DATA = "/root/testdata/sf0.001"


def references(spark):
    chunks = defaultdict(dict)
    for r in fx.reference(spark, DATA).collect():
        chunks[r.contig][r.chunk] = r.bases
    return {c: "".join(own[k][: pileup.CHUNK] if k < max(own) else own[k] for k in sorted(own)) for c, own in chunks.items()}


def test_every_candidate_has_an_image(spark):
    bases = references(spark)
    reads = defaultdict(list)
    for r in fx.reads(spark, DATA).where("mapq >= 10").orderBy("rid").collect():
        reads[r.contig].append((r.ref_start, r.ref_end, r.asDict() | {"cigar": [(u.op, int(u.len)) for u in r.cigar], "supports": r.rid % 2 == 0, "number": r.mate - 1}))
    opts, want = images.ImageOptions(width=41, height=30), {}
    for c in pileup.candidates(_sites(spark, DATA)).collect():
        own = [r for start, end, r in reads[c.contig] if start < c.start + 6 and c.start - 5 < end]
        window = bases[c.contig][c.start - 20 : c.start + 21] if c.start >= 20 else ""
        if len(window) == 41 and own:
            want[f"{c.contig}:{c.start}"] = hashlib.sha256(images.draw(c.start - 20, window, own, c.start, opts)).hexdigest()
    rows = QUERIES["q_pileup_images"](spark, DATA).collect()
    assert len(rows) == len(want) > 37
    assert {r.candidate: r.digest for r in rows} == want


def test_every_window_is_assembled(spark):
    at = _sites(spark, DATA)
    hot = defaultdict(set)
    for r in pileup.window_scores(at).where("score >= 3").collect():
        hot[r.contig].add(r.pos)
    bases, reads, found = references(spark), defaultdict(list), set()
    for r in fx.reads(spark, DATA).collect():
        reads[r.contig].append(r)
    for contig, positions in hot.items():
        windows = []
        for p in sorted(positions):
            lo, hi = max(p - 50, 0), p + 51
            if windows and lo <= windows[-1][1]:
                windows[-1][1] = hi
            else:
                windows.append([lo, hi])
        for lo, hi in windows:
            own = sorted((r for r in reads[contig] if r.ref_start < hi and lo < r.ref_end), key=lambda r: (r.ref_start, r.name))
            window = bases[contig][lo:hi]
            graph = assembly.build_graph(window, [(r.seq, list(r.bq), r.mapq) for r in own])
            for h in assembly.haplotypes(graph) if graph else []:
                found.update(assembly.variants_of(contig, lo, window, h) if h != window else ())
    known = [(c.contig, c.start, c.end, c.ref, tuple(c.alts)) for c in pileup.candidates(at).collect()]
    taken = {(c, s, r, tuple(sorted(alts))) for c, s, _, r, alts in known}
    fresh = [(c, s, e, r, (a,)) for c, s, e, r, a in found if (c, s, r, (a,)) not in taken]
    got = [(r.contig, r.start, r.end, r.ref, tuple(r.alts)) for r in QUERIES["q_assembled"](spark, DATA).collect()]
    assert sorted(got) == sorted(known + fresh)


def test_long_windows_are_assembled_whole(spark):
    rng = random.Random(3)
    ref = "".join(rng.choices("ACGT", k=600))
    places = [110, 165, 220, 275, 330, 385]
    alt = list(ref)
    for p in places:
        alt[p] = "ACGT"["ACGT".index(ref[p]) - 1]
    alt = "".join(alt)
    rows = [("c", s, s + 60, text[s : s + 60], [30] * 60, 60, f"{k}{n}{s}") for k, text in enumerate((ref, alt)) for n in range(2) for s in range(0, 541, 5)]
    reads = spark.createDataFrame(rows, "contig string, start long, end long, seq string, bq array<int>, mapq int, name string")
    windows = spark.createDataFrame([("c", 50, 450)], "contig string, start long, end long")
    texts = spark.createDataFrame([("c", 50, 450, ref[50:450])], "contig string, start long, end long, bases string")
    made = assembly.assemble_windows(windows, reads, texts, bin_width=64)
    assert sorted((r.start, r.ref, tuple(r.alts)) for r in made.collect()) == [(p, ref[p], (alt[p],)) for p in places]


def test_every_alternate_is_scored(spark):
    candidates = pileup.candidates(_sites(spark, DATA)).collect()
    got = sorted((r.contig, r.start, r.alt_idx[0]) for r in QUERIES["q_small_model_calls"](spark, DATA).collect())
    assert got == sorted((c.contig, c.start, i) for c in candidates for i in range(len(c.alts)))
    assert any(len(c.alts) > 1 for c in candidates)
