"""Operators against brute force, exact round trips and held-out accuracy."""

import itertools
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from locusflow.llm import bm25, common, components, fingerprints, langid, licenses, line_dedup, ngram_join, packing, quality, sp_nbest, substring_dedup

DATA = "/root/testdata/sf0.01"
WORDS = [f"w{i}" for i in range(400)]


def documents(spark, sf=DATA):
    return spark.read.parquet(f"{sf}/documents.parquet")


# line dedup


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(1)
    pool = [" ".join(rng.choices(WORDS, k=6)) for _ in range(30)] + ["short", ""]
    docs = [(i, "\n".join(rng.choice((str.upper, str.lower, lambda s: f"  {s}\t"))(rng.choice(pool)) for _ in range(rng.randint(0, 6)))) for i in range(80)]
    holders = {}
    for i, text in docs:
        for line in text.split("\n"):
            key = line_dedup.line_key(line)
            if len(key) >= 20:
                holders.setdefault(key, set()).add(i)
    want = {}
    for i, text in docs:
        lines = text.split("\n")
        kept = [x for x in lines if not (len(h := holders.get(line_dedup.line_key(x), ())) >= 3 and i != max(h))]
        want[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    got = line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got} == want


def test_lines_of_rows_that_share_a_doc_id(spark):
    """Documents are counted by doc_id, as the SQL does; rows without one count each."""
    line = "a line of more than twenty characters"
    docs = [(1, line), (3, line), (3, f"{line}\n{line}"), (4, f"other {line}"), (None, f"other {line}"), (None, f"other {line}")]
    got = [(r.doc_id, r.n_dropped) for r in line_dedup.line_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == [(1, 0), (3, 0), (3, 0), (4, 0), (None, 1), (None, 1)]


def test_filters_have_no_false_negative():
    hashes = np.random.default_rng(0).integers(0, 1 << 63, 5000).astype(np.uint64)
    bits = np.zeros(1 << 9, np.uint8)  # far too small: full, and still right
    pos = line_dedup._positions(hashes, 12)
    line_dedup._set(bits, pos)
    assert line_dedup._has(bits, pos).all()
    assert line_dedup.filter_bits(10**15, 16, 64) == 29


# packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 31), st.integers(1, 3), min_size=1, max_size=6))
def test_fullest_window(counts):
    found = packing.fullest(dict(counts), 32)
    longest = max(counts)
    items = [n for n, c in counts.items() for _ in range(c)]
    items.remove(longest)
    best = max(longest + sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if longest + sum(c) <= 32)
    assert sum(n * c for n, c in found) == best
    assert all(c <= counts[n] for n, c in found) and dict(found)[longest] >= 1


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 63), st.integers(1, 50), min_size=1, max_size=20))
def test_plan_uses_every_piece(counts):
    used = Counter()
    for p in packing.plan(dict(counts), 64):
        assert sum(n * c for n, c in p.lengths) <= 64
        for n, c in p.lengths:
            used[n] += c * p.windows
    assert dict(used) == counts


def test_packing_round_trip(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack(documents(spark), path).collect()
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    pieces, used = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, bytes(r.ids)))
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length
    for doc_id, text in texts.items():
        ids = np.frombuffer(b"".join(b for _, b in sorted(pieces[doc_id])), "<u4").tolist()
        assert ids == [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    total = sum(r.length for r in rows)
    for own in used.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(used) == math.ceil(total / 2048) or len(used) * 2048 / total < 1.01


def test_chunks_are_the_tokenizer():
    tokens = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    for text in ("It's we'll I'd!!! 12,5 Straße ÀÉ", "naïvé ﬁ 漢字 🙂", "tab\tnew\n line nbsp", "don't'S '''s", "İstanbul ŉ", ""):
        assert np.frombuffer(tokens.ids(text), "<u4").tolist() == tokens.whole.encode(text, add_special_tokens=False).ids


def test_packing_holds_little(spark, monkeypatch):
    tokens = packing.ChunkTokenizer(public_tokenizers.path("word_bpe_49k.json"), 500)
    for at in range(0, 6000, 100):
        tokens.ids(" ".join(f"{''.join('abcdefghij'[int(c)] for c in str(n))}!" for n in range(at, at + 100)))
    caches = [x for x in vars(tokens).values() if isinstance(x, common.BoundedCache)]
    assert sum(len(x.young) + len(x.old) for x in caches) <= 2 * (500 + 300)  # a text adds its 100 chunks and their words
    name, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(name)
    monkeypatch.setattr(packing, "materialise", lambda *x: seen.append(int(spark.conf.get(name))) or common.materialise(*x))
    assert packing.pack(documents(spark), public_tokenizers.path("word_bpe_49k.json")).count() > 0
    assert seen == [256] and spark.conf.get(name) == before


# near duplicates


def brute_components(docs, width, num):
    sets = {}
    for i, text in docs:
        words = (text or "").encode().lower().split()
        sets[i] = frozenset(tuple(words[j : j + width]) for j in range(max(1, len(words) - width + 1))) if words else frozenset()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b]:
            common = len(sets[a] & sets[b])
            if 100 * common >= num * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80)])
def test_jaccard_join_against_brute_force(spark, monkeypatch, width, num):
    rng = random.Random(width)
    docs, texts = [], []
    for _ in range(12):
        texts.append(rng.choices(WORDS, k=rng.choice((2, 9, 20, 60, 150, 800))))
    for i in range(150):
        words = list(rng.choice(texts))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        docs.append((i, " ".join(words[: len(words) - rng.choice((0, 0, 1))])))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs, width, num)
    if width == 3:  # every shared part is left out that can be spared
        monkeypatch.setattr(ngram_join, "_HOT", 1)
    got = ngram_join.jaccard_components(df, width, num, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    if width == 5:
        kept = ngram_join.first_of_component(df, width, num, 100).collect()
        assert sorted(r.doc_id for r in kept) == sorted(i for i, (_, c) in want.items() if i == c)


def test_jaccard_join_of_tables_that_are_not_small(spark, monkeypatch):
    """The shuffled joins give what the broadcast ones give."""
    rng = random.Random(11)
    texts = [rng.choices(WORDS, k=k) for k in (9, 60, 60, 700)]
    docs = []
    for i in range(80):
        words = list(texts[i % 4])
        for _ in range(rng.choice((0, 1, 2))):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        docs.append((i, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "is_small", lambda table: False)
    monkeypatch.setattr(ngram_join, "light", lambda table: table)
    got = ngram_join.jaccard_components(df, 3, 90, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs, 3, 90)


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(30, 300), st.sampled_from([(80, 100), (90, 100)]))
def test_similar_sets_share_a_part(seed, size, threshold):
    rng = np.random.default_rng(seed)
    bands = ngram_join.Bands(*threshold)
    a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
    most = bands.differences(2 * len(a)) // 2
    drop = rng.integers(0, most + 1)
    b = np.union1d(a[drop:], rng.integers(0, 1 << 62, most - drop).astype(np.uint64))
    common = len(np.intersect1d(a, b))
    if common * threshold[1] >= threshold[0] * (len(a) + len(b) - common):
        assert np.array_equal(a, b) or len(np.intersect1d(ngram_join.part_keys(a, bands)[0], ngram_join.part_keys(b, bands)[0]))
        apart = np.bitwise_count(ngram_join.small_sketch(a) ^ ngram_join.small_sketch(b)).sum()
        assert apart <= len(a) + len(b) - 2 * common


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(513, 3000), st.integers(513, 9000))
def test_wide_sketches_bound_the_difference(seed, n, m):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
    b = np.union1d(a[rng.integers(0, n // 2) :], rng.integers(0, 1 << 62, m).astype(np.uint64))
    assert ngram_join.wide_distance(ngram_join.wide_sketch(a), ngram_join.wide_sketch(b)) <= len(np.setxor1d(a, b))
    assert ngram_join.wide_distance(ngram_join.wide_sketch(a), ngram_join.wide_sketch(a)) == 0


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(30, 300), st.sampled_from([(80, 100), (90, 100)]))
def test_spared_parts_lose_no_pair(seed, size, threshold):
    """Similar sets still share a part when each leaves out its most frequent ones, as far as it has any to spare."""
    rng = np.random.default_rng(seed)
    bands = ngram_join.Bands(*threshold)
    a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
    half = bands.differences(2 * len(a)) // 2
    b = np.union1d(a[half:], rng.integers(0, 1 << 62, half).astype(np.uint64))
    heat, still, kept = {}, {}, []
    for tokens in (a, b):
        own, spare = ngram_join.part_keys(tokens, bands)
        left, best = set(own.tolist()), {}
        for key, most in zip(own.tolist(), spare.tolist(), strict=True):
            best.setdefault(key & 127, (most, []))[1].append((-heat.setdefault(key, int(rng.integers(0, 9))), key))
        for most, keys in best.values():
            key = keys[0][1]
            gone = int(rng.integers(0, most + 1))
            left -= {key for _, key in sorted(keys)[:gone]}
            still[key & 127, len(kept)] = most - gone
        kept.append(left)
    common = len(np.intersect1d(a, b))
    if common * threshold[1] >= threshold[0] * (len(a) + len(b) - common):
        shared = Counter(key & 127 for key in kept[0] & kept[1])
        assert np.array_equal(a, b) or any(n > min(still[band, 0], still[band, 1]) for band, n in shared.items())


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(200 + i, 201 + i) for i in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}
    shuffled = components.components(spark.createDataFrame(edges, "a long, b long"), small=0)
    assert {r.node: r.root for r in shuffled.collect()} == got


# substrings


def test_substrings_against_brute_force(spark):
    rng = random.Random(2)
    passage = " ".join(" ".join(rng.choices(WORDS, k=9)) + "." for _ in range(7))
    docs = []
    for i in range(30):
        own = [" ".join(rng.choices(WORDS, k=rng.randint(1, 12))) + rng.choice(".!?") for _ in range(rng.randint(0, 8))]
        if i % 3 == 0:
            own.insert(rng.randint(0, len(own)), passage)
        docs.append((i, rng.choice((" ", "\n")).join(own)))
    every, spans, first = {}, {}, {}
    for i, text in docs:
        every[i] = [x.strip() for x in re.sub(r"(?<=[.!?]) +|\n", "\0", text).split("\0") if x.strip()]
        spans[i] = [(a, a + k) for k, least in ((3, 12), (2, 16)) for a in range(len(every[i]) - k + 1) if sum(len(x.split(" ")) for x in every[i][a : a + k]) >= least]
        for a, b in spans[i]:
            first[tuple(every[i][a:b])] = min(first.get(tuple(every[i][a:b]), (i, a)), (i, a))
    gone = {i: {x for a, b in spans[i] if first[tuple(own[a:b])] != (i, a) for x in range(a, b)} for i, own in every.items()}
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs:
        assert (got[i].n_sentences, got[i].n_removed) == (len(every[i]), len(gone[i]))
        assert re.split(r"[ \n]+", got[i].text) == (" ".join(x for n, x in enumerate(every[i]) if n not in gone[i])).split(" ")
        if not gone[i]:
            assert got[i].text == text and got[i].first_doc_ids == []
        if i and i % 3 == 0:
            assert passage.split(". ")[3] not in got[i].text and 0 in got[i].first_doc_ids
    assert passage in got[0].text.replace("\n", " ")


def test_short_sentences_make_a_run(spark):
    passage = "One two three four. Five six seven eight. Nine ten eleven twelve thirteen."
    docs = [(1, f"Own words here. {passage} More of them."), (2, f"Other ones. {passage} Again others."), (3, "Alone. Yes. No. Own."), (4, "Yes. No. Alone.")]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i].n_removed for i in range(1, 5)] == [0, 3, 0, 0]
    assert got[2].text == "Other ones. Again others." and got[2].first_doc_ids == [1]


def test_rows_without_an_id_are_documents_of_their_own(spark):
    rng = random.Random(7)
    made = lambda n: " ".join(" ".join(rng.choices(WORDS, k=9)) + "." for _ in range(n))
    passage, long, twice = made(5), made(12), made(6)
    docs = [(1, passage), (None, f"{made(3)} {passage}"), (None, f"{made(8)} {passage}"), (None, long), (None, twice), (None, twice), (None, made(1)), (2, made(4)), (2, f"{made(6)} {passage}")]
    got = substring_dedup.substring_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == len(docs)
    kept = [r.text for r in got]
    assert sum(passage in t for t in kept) == 1 and long in kept and kept.count(twice) == 1 and docs[7][1] in kept and docs[6][1] in kept
    assert sorted((r.n_sentences, r.n_removed) for r in got) == [(1, 0), (4, 0), (5, 0), (6, 0), (6, 6), (8, 5), (11, 5), (12, 0), (13, 5)]
    assert sorted(r.first_doc_ids for r in got if r.n_removed) == [[1], [1], [1], [(1 << 63) - 1]]


# fingerprints


def brute_fingerprint(text):
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text.lower()) if w]
    hashed = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    if not hashed:
        return []
    shingles = []
    for i in range(len(hashed) - 4):
        h = 42
        for k in range(5):
            h = xxhash.xxh64_intdigest(struct.pack("<Q", hashed[i + k]), h)
        shingles.append(h >> 1)
    if not shingles:
        shingles = [xxhash.xxh64_intdigest(" ".join(str(signed(h)) for h in hashed).encode(), 42) >> 1]
    least = {}
    for x in shingles:
        least[x >> 56] = min(least.get(x >> 56, 1 << 70), x)
    out = []
    for e in range(128):
        if e in least:
            out.append(least[e] & 255)
        else:
            probe = lambda b: xxhash.xxh64_intdigest(struct.pack("<i", b), xxhash.xxh64_intdigest(struct.pack("<i", e), 42))  # noqa: B023, E731
            out.append(min(signed(probe(b) & ~255 | x & 255) for b, x in least.items()) & 255)
    return out


def test_fingerprints_against_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(["a b c d e f g h i j", "", "x", "a b c d e f g h i j k l m " * 9, "Über straße foo BAR baz qux quux " * 3])] + [(7, None), (9, "dup one"), (9, "dup one")]
    got = fingerprints.edited_fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    order = sorted({(-i, t or "") for i, t in docs})
    after = {key: order[(n + 1) % len(order)][1] for n, key in enumerate(order)}
    hexed = lambda v: "".join(f"{x:02X}" for x in v)
    want = []
    for i, t in docs:
        t, nxt = t or "", after[-i, t or ""]
        edited = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        want.append((i, edited, hexed(brute_fingerprint(t)), hexed(brute_fingerprint(edited))))
    assert sorted((r.doc_id, r.edited_text, r.fingerprint, r.edited_fingerprint) for r in got) == sorted(want)


def test_likeness_estimates_jaccard(spark):
    rng = random.Random(3)
    pairs = []
    for _ in range(20):
        a = rng.choices(WORDS, k=300)
        b = list(a)
        for _ in range(rng.randint(0, 30)):
            b[rng.randrange(300)] = rng.choice(WORDS)
        shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        x, y = shingles(a), shingles(b)
        pairs.append((" ".join(a), " ".join(b), len(x & y) / len(x | y)))
    df = spark.createDataFrame(pairs, "a string, b string, j double")
    prints = df.select(fingerprints.fingerprint(F.col("a")).alias("fa"), fingerprints.fingerprint(F.col("b")).alias("fb"), "j")
    errors = [r.e for r in prints.select((fingerprints.likeness(F.col("fa"), F.col("fb")) - F.col("j")).alias("e")).collect()]
    assert max(map(abs, errors)) < 0.2 and abs(sum(errors) / len(errors)) < 0.05


# licences


def test_licences(spark):
    mit = ". ".join(s for name, s in licenses.SENTENCES if name in ("MI2", "MI3", "MI4"))
    docs = [
        (1, "Licensed under the Apache License, Version 2.0.\ntext follows."),
        (2, f"Intro.\n{mit}.\nReleased under the MIT License."),
        (3, "You may not use this file except in compliance with the License."),
        (4, "A line.\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.\n"),
        (5, "nothing about licensing here"),
    ]
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.n_matches) for r in licenses.scan_licenses(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == ("AP1  -", "Apache-2.0", 1)
    assert got[2] == ("-  MI2  MI3  MI4  MI1", "MIT", 2)
    assert got[3][1:] == ("", 0)  # one sentence of a rule of three
    assert got[4][1:] == ("CC-BY-NC-4.0", 2)
    assert got[5] == ("-", "", 0)
    assert all(any(a in s for a in licenses.ANCHORS) for _, s in licenses.SENTENCES)


APACHE = """Copyright 2020 A. Author

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""
MIT = """MIT License

Copyright (c) 2020 A. Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
BSD = """Copyright (c) 2020, A. Author
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
"""


def test_verbatim_licences(spark):
    gpl2 = GPL.replace("software: you", "software; you").replace("Foundation, either version 3", "Foundation; either version 2")
    commented = "".join(f"# {line}".rstrip() + "\n" for line in APACHE.splitlines())
    texts = [APACHE, MIT, BSD, GPL, gpl2, commented, "SPDX-License-Identifier: MIT\nint main() {}", BSD[: BSD.index("3.")]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.sentence_ids, r.licenses, r.n_matches) for r in licenses.scan_licenses(docs).collect()}
    assert [got[i][1:] for i in range(8)] == [(x, 1) for x in ("Apache-2.0", "MIT", "BSD-3-Clause", "GPL-3.0", "GPL-2.0", "Apache-2.0", "MIT", "BSD-2-Clause")]
    assert got[2][0] == "-  BS1  BS2  BS3  BS4  -" and got[3][0] == "GP2  GP4  GP3  -" and got[0][0] == got[5][0] == "-  AP2  AP3  AP4  -"


# classifiers


def test_quality_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scored = quality.score_quality(documents(spark), labels).join(labels, "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % 4 == 2)
    rows = scored.select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_language_on_held_out_rows(spark):
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    done = langid.identify_language(documents(spark), ~held_out).where(held_out)
    assert done.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.96


def test_texts_without_a_letter_have_no_language(spark):
    texts = ["\u00b2 \u2167", "12 \u00bd", "\u00e9", None]
    docs = spark.createDataFrame([(i, t, "fr") for i, t in enumerate(["bonjour le monde", *texts])], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify_language(docs, F.col("doc_id") == 0).collect()}
    assert [got[i] for i in range(5)] == ["fr", "und", "und", "fr", "und"]


def test_scorer_is_the_network():
    rng = np.random.default_rng(0)
    windows = [bytes(rng.integers(97, 97 + 3 + 9 * (i % 2), langid.WINDOW + 3).tolist()) for i in range(80)]
    net = langid.fit(windows, ["a", "b"] * 40, epochs=2)
    text = windows[0][:100]
    got = langid.Scorer(net).texts([text, windows[1] * 3])
    padded = np.zeros(langid.WINDOW + 3, np.int64)
    padded[:100] = net.classes[np.frombuffer(text, np.uint8)]
    pooled = []
    for w in langid.WIDTHS:
        for f in range(langid.FILTERS):
            pooled.append(max(sum(net.tables[w, k][f, padded[i + k]] for k in range(w)) for i in range(langid.WINDOW)))
    assert np.allclose(net.head(np.array([pooled]))[0], got[0], atol=1e-5)
    assert got.shape == (2, 2) and np.allclose(got.sum(axis=1), 1)


# search


def brute_search(docs, queries, k, terms):
    tf = {i: Counter(re.findall(r"[^\W_]+", t.lower())) for i, t in docs.items()}
    size = {i: sum(c.values()) for i, c in tf.items()}
    average = sum(size.values()) / len(size)
    df = Counter(t for c in tf.values() for t in c)
    idf = {t: math.log1p((len(docs) - n + 0.5) / (n + 0.5)) for t, n in df.items()}
    out = {}
    for q in queries:
        own = sorted(tf[q], key=lambda t: (-tf[q][t] * idf[t], np.uint64(xxhash.xxh3_64_intdigest(t)).astype(np.int64)))[:terms]
        scores = []
        for i, c in tf.items():
            s = sum(idf[t] * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * size[i] / average)) for t in own if t in c)
            if s > 0:
                scores.append((-s, i))
        out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def test_search_against_brute_force(spark):
    docs = {r.doc_id: r.text for r in documents(spark).collect()}
    df = documents(spark)
    found = bm25.search(df, df.where("doc_id % 100 = 0"), k=7, query_terms=12, shard_docs=90).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = brute_search(docs, [i for i in docs if i % 100 == 0], 7, 12)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-9 for q in want for (_, a), (_, b) in zip(got[q], want[q], strict=True))


def test_search_takes_every_term_of_a_query(spark):
    rng = random.Random(5)
    texts = {i: " ".join(rng.choices(WORDS, k=rng.randint(60, 400))) for i in range(120)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {}
    for r in sorted(bm25.search(df, df.where("doc_id % 10 = 0"), k=7, shard_docs=50).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.doc_id, r.score))
    want = brute_search(texts, range(0, 120, 10), 7, None)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(a - b) < 1e-9 for q in want for (_, a), (_, b) in zip(got[q], want[q], strict=True))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_wand_is_exhaustive(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 3000)), int(rng.integers(1, 12))
    rows, scores = [], Counter()
    vocabulary = np.sort(rng.choice(1 << 40, 9, replace=False)).astype(np.uint64)
    idf = rng.uniform(0.1, 5, 9)
    for t, number in zip(vocabulary, range(9), strict=True):
        for d in rng.choice(n, int(rng.integers(0, n)), replace=False).tolist():
            rows.append((d, t, round(float(rng.uniform(0.1, 2)), 1)))
            if number % 2:
                scores[d] += idf[number] * rows[-1][2]
    rows += [(int(d), np.uint64(3), 9.0) for d in rng.integers(0, n, 5)]  # a term that isn't asked for
    rows.sort()
    shard = bm25.Shard(np.array([t for _, t, _ in rows], np.uint64), np.array([d for d, _, _ in rows], np.int64), np.array([x for _, _, x in rows], float), n, vocabulary, idf)
    want = sorted((-s, d) for d, s in scores.items())[:k]
    lists = shard.lists(np.array([1, 3, 5, 7]))
    best, where = bm25.block_max_wand(*lists, k)
    assert where.tolist() == [d for _, d in want] and np.allclose(best, [-s for s, _ in want], atol=1e-9)
    # a threshold that is right from the start changes nothing, one above the k-th best leaves the better ones
    if want:
        for floor in (best[-1], best[len(best) // 2]):
            again, there = bm25.block_max_wand(*lists, k, floor)
            assert there.tolist() == where[best >= floor].tolist() and (again == best[best >= floor]).all()


def test_wand_skips_blocks():
    """Blocks whose maxima don't reach the threshold are never read."""
    docs = np.arange(0, 40 * bm25.BLOCK, 8)
    adds = np.where(docs // bm25.BLOCK == 20, 5.0, 1.0)
    starts = np.searchsorted(docs, np.arange(41) * bm25.BLOCK)[None]
    most = np.maximum.reduceat(adds, starts[0, :-1])[None].astype(np.float32)
    spoiled = np.where(docs // bm25.BLOCK == 20, adds, np.nan)
    best, where = bm25.block_max_wand(docs, spoiled, starts, most, 3, 2.0)
    assert best.tolist() == [5.0] * 3 and where.tolist() == [20 * bm25.BLOCK + 8 * i for i in range(3)]


def test_search_in_blocks_of_queries(spark, monkeypatch):
    """Small shards, small blocks of queries and ties give what one shard gives; null and repeated ids too."""
    rng = random.Random(6)
    rows = [(i // 2, " ".join(rng.choices(WORDS[:40], k=rng.randint(0, 12)))) for i in range(200)] + [(None, "w1 w2 w3"), (None, "w1 w2 w3")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(bm25.search(df, F.col("doc_id") % 10 == 0, k=5).collect(), key=str)
    got = bm25.search(df.repartition(5), F.col("doc_id") % 10 == 0, k=5, shard_docs=7, block_mb=0.0001).collect()
    assert sorted(got, key=str) == want and len(want) > 20


# segmentation


@pytest.fixture(scope="module")
def segmenter():
    return sp_nbest.Segmenter(public_tokenizers.path("piece_bpe_32k.model"), 4)


@settings(max_examples=120, deadline=None)
@given(text=st.lists(st.sampled_from(["a", "b", " ", "th", "é", "\n", "the", "梦", "☃", ".", "*"]), min_size=1, max_size=6).map("".join))
def test_nbest_against_enumeration(segmenter, text):
    m, marked, every = segmenter, sp_nbest.BLANK + text.replace(" ", sp_nbest.BLANK), []

    def go(i, score, ids):
        if i == len(marked):
            every.append((score, ids))
            return
        if marked[i] not in m.pieces:
            go(i + 1, score + m.spelled, ids + m.spell(marked[i]))
        for j in range(i + 1, len(marked) + 1):
            if marked[i:j] in m.pieces:
                go(j, score + m.pieces[marked[i:j]][0], ids + m.pieces[marked[i:j]][1])

    go(0, 0.0, b"")
    every.sort(key=lambda x: -x[0])
    got = m.encode(text)
    assert [round(s, 6) for s, _ in got] == [round(s, 6) for s, _ in every[:4]]
    assert len({i for _, i in got}) == len(got) and {i for _, i in got} <= {i for _, i in every}
    assert m.decode(got[0][1]) == text


def test_parts_are_scanned_once():
    m, seen = sp_nbest.Segmenter(public_tokenizers.path("piece_bpe_32k.model"), 4), []
    scan, text = m.scan, "boos 梦 boos☃ boos☃☃ reads reads☃boos 梦☃ boos"
    m.scan = lambda part: seen.append(part) or scan(part)
    got = [m.encode(text), m.encode(text), m.encode(text[::-1])]
    assert "▁boos" in seen and len(m.parts("▁boos☃")) > 1
    assert len(seen) == len(set(seen))
    assert got == [sp_nbest.Segmenter(public_tokenizers.path("piece_bpe_32k.model"), 4).encode(t) for t in (text, text, text[::-1])]


def test_segmentation_round_trip(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    done = sp_nbest.segmentation_digests(documents(spark, "/root/testdata/sf0.001"), path)
    assert done.where("NOT decoded_ok OR size(scores) = 0").count() == 0
    best = sp_nbest.encode_nbest(documents(spark, "/root/testdata/sf0.001"), path, 2).select("text", F.col("nbest")[0]["ids"].alias("ids"))
    assert sp_nbest.decode_ids(best, path).where("decoded <> text").count() == 0
