"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from locusflow.llm import bm25, fingerprints, langid, licenses, line_dedup, ngram_join, packing, quality, sp_nbest, substring_dedup

SCHEMA = "doc_id long, text string, lang string, score string, keys int, text_key string, node int, __x int, n_lines string"
LONG = "wort " * 30_000
ROWS = [
    (1, "A first line that is long enough\nshort\nA first line that is long enough", "en"),
    (2, "A FIRST line that is long enough  \nother", "en"),
    (3, "\tA first line that is long enough", None),
    (3, "\tA first line that is long enough", None),
    (None, "A first line that is long enough", "en"),
    (None, None, None),
    (4, "", "de"),
    (5, None, "de"),
    (6, LONG, "de"),
    (7, LONG, "de"),
    (8, "!!! 123 ???", "de"),
]

OPERATORS = {
    "substring": lambda d: substring_dedup.substring_dedup(d),
    "bm25": lambda d: bm25.search(d, d, k=2),
    "langid": lambda d: langid.identify_language(d, F.lit(True)),
    "licenses": licenses.scan_licenses,
    "packing": lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
    "quality": lambda d: quality.score_quality(d, d.select("doc_id", (F.col("doc_id") % 2).alias("quality"))),
    "ngram": lambda d: ngram_join.jaccard_components(d),
    "one_of_each": lambda d: ngram_join.first_of_component(d),
    "lines": lambda d: line_dedup.line_dedup(d),
    "sentencepiece": lambda d: sp_nbest.encode_nbest(d, public_tokenizers.path("piece_bpe_32k.model")),
    "digests": lambda d: sp_nbest.segmentation_digests(d, public_tokenizers.path("piece_bpe_32k.model")),
    "fingerprints": lambda d: fingerprints.edited_fingerprints(d),
}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, "y", 2, 3, "z") for i, t, lang in rows], SCHEMA)


@pytest.fixture(scope="module")
def results(spark):
    docs = frame(spark, ROWS)
    return {name: run(docs).collect() for name, run in OPERATORS.items()}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](frame(spark, [])).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n not in ("bm25", "packing", "one_of_each")])
def test_one_result_a_row(results, name):
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in results[name]) == sorted((i is None, i or 0) for i, _, _ in ROWS)


def test_line_dedup(results):
    got = {(r.doc_id, r.text): (r.n_lines, r.n_dropped) for r in results["lines"]}
    assert got[1, "short"] == (3, 2)
    assert got[2, "other"] == (2, 1)
    # the largest doc_id that holds the line keeps it, in both of its rows
    assert got[3, "\tA first line that is long enough"] == (1, 0)
    assert got[None, ""] == (1, 0) or got[None, ""] == (1, 1)
    assert got[5, ""] == got[4, ""] == (1, 0)
    assert all(r.lang is not None or r.doc_id in (3, None) for r in results["lines"])


def test_ngram(results):
    got = {}
    for r in results["ngram"]:
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id))
    assert got[6] == got[7] == {(1, 6)}
    assert got[4] == {(0, 4)} and got[5] == {(0, 5)}
    assert {c for _, c in got[3]} == {3}
    # a null doc_id joins the component of equal texts
    assert (0, None) in got[None] and any(c == 3 for _, c in got[None])


def test_one_of_each_group(results):
    # of the repeated row one stays, and its copy without a doc_id goes; rows without words stay
    assert sorted(r.doc_id for r in results["one_of_each"] if r.doc_id is not None) == [1, 2, 3, 4, 5, 6, 8]
    assert [r.text for r in results["one_of_each"] if r.doc_id is None] == [None]


def test_packing(results):
    rows = results["packing"]
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert [(r.start, r.length, r.doc_tokens) for r in by_doc[4]] == [(0, 1, 1)]
    assert sum(r.length for r in by_doc[6]) == by_doc[6][0].doc_tokens == 30_001
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_language(results):
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in results["langid"]}
    assert got[5, None] == got[4, ""] == got[8, "!!! 123 ???"] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())


def test_quality(results):
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in results["quality"])


def test_fingerprints(results):
    by_text = {}
    for r in results["fingerprints"]:
        by_text.setdefault(r.text, set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    assert by_text[""] == {""}


def test_substring(results):
    got = {(r.doc_id, r.text): r for r in results["substring"]}
    assert got[5, ""].n_sentences == 0
    assert [r.n_removed for r in results["substring"] if r.doc_id == 6] == [0]
    # one sentence is no run, however long
    assert [(r.n_removed, r.first_doc_ids) for r in results["substring"] if r.doc_id == 7] == [(0, [])]


def test_sentencepiece(results):
    assert all(r.decoded_ok for r in results["digests"])
    assert [r.n_ids for r in results["digests"] if r.doc_id == 4] == [0]
    assert all(sorted((x.score for x in r.nbest), reverse=True) == [x.score for x in r.nbest] for r in results["sentencepiece"])


def test_search(results):
    first = {r.query_id: r for r in results["bm25"] if r["rank"] == 1}
    assert first[6].doc_id == 6 and first[7].doc_id == 6  # equal scores: the least doc_id
    assert 4 not in first and 5 not in first
