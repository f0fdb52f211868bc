"""Resampling, source mixing and conversation repair against brute force."""

import hashlib
import itertools
import math
import random
import re
import struct
import zlib
from collections import Counter

import duckdb
import pytest
import xxhash
from pyspark.sql import functions as F

from locusflow.llm import conversations, mixing, resample
from locusflow.llm.sql import ORACLE_SQL

CLASH = "doc_id long, text string, source string, weight string, rank int, features int, row string, size string, target string, block int, text_key string"


def documents(spark, rows):
    """(doc_id, text, source) with columns named like the operators' own."""
    return spark.createDataFrame([(i, t, s, "w", 1, 2, "r", "s", "t", 3, "k") for i, t, s in rows], CLASH)


# resampling


def resampled(docs, target, percent, min_words, longest, buckets, seed):
    """Plain loops over characters and documents."""

    def words(text):
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)

    def features(text):
        w = words(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s = Counter(b for _, text in docs for b in features(text))
    t = Counter(b for text in target for b in features(text))
    total_s, total_t = sum(s.values()), sum(t.values())
    out, scores = [], []
    for doc_id, text in docs:
        found = features(text)
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * (total_s + buckets) / ((s[b] + 1) * (total_t + buckets)))) for b in found)
        weight = gain // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(found), weight, score))
        if len(words(text)) >= min_words:
            scores.append((-score, doc_id is None, doc_id or 0, -weight, -len(found)))
    ranks = {}
    for n, key in enumerate(sorted(scores)[: percent * len(scores) // 100], 1):
        ranks.setdefault(key, []).append(n)
    rows = []
    for (doc_id, text), (_, n, weight, score) in zip(docs, out, strict=True):
        own = ranks.get((-score, doc_id is None, doc_id or 0, -weight, -n)) if len(words(text)) >= min_words else None
        rows.append((doc_id, n, weight, score, own.pop(0) if own else None))
    return rows


RESAMPLED = [
    (1, "Some words of one text, 12 of them; ça va ÉTÉ Zürich 12 a b c d"),
    (2, ""),
    (3, None),
    (4, "\x00-..,!?"),
    (None, "a text without an id of its own and of more than ten words here"),
    (None, "a text without an id of its own and of more than ten words here"),
    (None, None),
    (5, "repeated id with a text of ten words and then some others"),
    (5, "repeated id with another text of ten words and a few more"),
    (5, "repeated id with another text of ten words and a few more"),
    (6, "long " * 40_000),
    (7, "x" * 200_000),
]


@pytest.mark.parametrize(("longest", "percent", "buckets"), [(1, 10, 10_000), (2, 50, 70_000), (3, 100, 64)])
def test_resample(spark, longest, percent, buckets):
    rng = random.Random(longest)
    pool = [f"w{i}" for i in range(50)]
    docs = RESAMPLED + [(100 + i, " ".join(rng.choices(pool, k=rng.randint(0, 40)))) for i in range(60)] + [(i, "copies of one text that many hold, word by word by word") for i in range(200, 260)]
    target = ["w1 w2 w3 W4 w5", None, "", "Some words of one text, words again"]
    got = resample.resample(documents(spark, [(i, t, "x") for i, t in docs]), spark.createDataFrame([(t,) for t in target], "text string"), percent, 10, longest, buckets, 7).collect()
    order = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=order) == sorted(resampled(docs, target, percent, 10, longest, buckets, 7), key=order)


def test_resample_hot_and_cold_texts_agree(spark, monkeypatch):
    docs = documents(spark, [(i, ("one text of a large group " if i % 3 else f"text {i} ") * 5, "x") for i in range(90)])
    target = docs.where("doc_id < 9")
    plain = sorted(map(tuple, resample.resample(docs, target, 50, 5).collect()), key=str)
    monkeypatch.setattr(resample, "_HOT_COPIES", 2)
    assert sorted(map(tuple, resample.resample(docs, target, 50, 5).collect()), key=str) == plain


def test_resample_empty_tables(spark):
    none = documents(spark, [])
    assert resample.resample(none, none).collect() == []
    assert resample.resample(documents(spark, [(1, "a b", "x")]), none, 100, 1).first()["rank"] == 1


# mixing


def spark_hash(*values):
    """xxhash64 of longs and of ints, as Spark chains them."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(struct.pack("<q" if isinstance(v, int) else "<i", v if isinstance(v, int) else v[0]), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def int32(x):
    return (x,)


def test_permutation(spark):
    for n in (1, 2, 7, 64, 1000):
        got = [r.at for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5).cast("long")).alias("at"), "id").orderBy("id").collect()]
        assert sorted(got) == list(range(n))
        want = []
        for x in range(n):
            for r in range(mixing.ROUNDS):
                other = (spark_hash(5, int32(r)) % n - x) % n
                x = other if spark_hash(5, int32(r), max(x, other)) & 1 else x
            want.append(x)
        assert got == want
        assert n < 64 or got != list(range(n))


def filled(sizes, weights, total):
    """Targets by handing out what is left, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free = dict.fromkeys(order, 0.0), set(order)
    left = total
    while left > 1e-9 and free:
        whole = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / whole
        left = sum(max(target[s] - 2 * sizes[s], 0.0) for s in free)
        for s in [s for s in free if target[s] >= 2 * sizes[s]]:
            target[s] = 2.0 * sizes[s]
            free.discard(s)
    return target


MIXED = [(1, "a b c", "s1"), (2, None, "s1"), (3, "", None), (4, "one\x0btwo\x00three", None), (None, "no id here", "s2"), (None, "no id here", "s2"), (None, "other", "s2"), (5, "same id", "s1"), (5, "same id", ""), (6, "Ü ", "é"), (7, "w " * 50_000, "hot"), (8, None, "empty")]


def brute_mix(docs, mix):
    """The whole mix by loops; equal rows may change places."""
    rows = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), s) for i, t, s in docs]
    sizes = Counter()
    for _, size, s in rows:
        sizes[s] += size
    target = filled(sizes, mix.weights, sum(sizes.values()) * mix.percent / 100)
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    blocks = {s: -(-sizes[s] // mix.block_words) for s in order}
    quota = {s: min(mix.most * blocks[s], math.floor(target[s] / sizes[s] * blocks[s] + 0.5 + 1e-9)) if sizes[s] else 0 for s in order}
    total, drawn = sum(quota.values()), Counter()
    for i in range(total):
        at = spark_hash(i, int32(mix.seed)) % total
        for s in order:
            at -= quota[s]
            if at < 0:
                drawn[s, i // mix.shard_slots] += 1
                break
    times = Counter()
    for no, s in enumerate(order):
        for slot in range(quota[s]):
            turn, x = divmod(slot, blocks[s])
            key = spark_hash(int32(mix.seed), int32(no), turn)
            for r in range(mixing.ROUNDS):
                other = (spark_hash(key, int32(r)) % blocks[s] - x) % blocks[s]
                x = other if spark_hash(key, int32(r), max(x, other)) & 1 else x
            times[s, x] += 1
    taken = [0] * len(rows)
    for s in order:
        own = [(spark_hash(i, int32(mix.seed)) if i is not None else spark_hash(int32(mix.seed)), i is not None, i or 0, size, n) for n, (i, size, of) in enumerate(rows) if of == s and size]
        at = 0
        for *_, size, n in sorted(own):
            taken[n] = sum(times[s, w // mix.block_words] for w in range(at, at + size))
            at += size
    return [(i, size, sizes[s], round(target[s], 6), taken[n]) for n, (i, size, s) in enumerate(rows)], drawn


def test_words_taken_against_brute_force(spark):
    rng = random.Random(3)
    docs = MIXED + [(100 + i, "word " * rng.randint(0, 300), rng.choice(["s1", "s2", "s3", "hot", "hot", "hot", None])) for i in range(120)]
    mix = mixing.Mix(block_words=16, shard_slots=512)
    got = [(r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in mixing.words_taken(documents(spark, docs), mix).collect()]
    want, _ = brute_mix(docs, mix)
    assert sorted(got, key=str) == sorted(want, key=str)
    for size in {(r[2], r[3]) for r in got}:
        taken = sum(r[4] for r in got if (r[2], r[3]) == size)
        assert abs(taken - size[1]) <= 2 * mix.block_words
    assert all(r[4] <= 2 * r[1] for r in got)
    again = mixing.words_taken(documents(spark, docs).repartition(3), mix).collect()
    assert sorted(str((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken)) for r in again) == sorted(map(str, got))


def test_mix_is_the_words_taken(spark):
    """Slots are whole, shards are as long as asked, their source counts those that were drawn but for few settled ones."""
    rng = random.Random(4)
    docs = [(i, "word " * rng.randint(1, 200), rng.choice(["a", "b", "b", "b", "c"])) for i in range(150)]
    mix = mixing.Mix(block_words=8, shard_slots=256)
    rows = mixing.mixed(documents(spark, docs), mix).collect()
    want, drawn = brute_mix(docs, mix)
    taken = Counter()
    for r in rows:
        taken[r.doc_id] += r.words
    assert {i: t for i, _, _, _, t in want if t} == dict(taken)
    slots = {(r.shard, r.source_no, r.slot) for r in rows}
    per_shard = Counter(shard for shard, _, _ in slots)
    assert all(n == mix.shard_slots for shard, n in per_shard.items() if shard < max(per_shard))
    by_source = Counter((shard, no) for shard, no, _ in slots)
    sources = sorted({s for _, _, s in docs})
    moved = sum(abs(by_source[shard, no] - drawn[s, shard]) for no, s in enumerate(sources) for shard in per_shard)
    assert moved < 0.1 * len(slots)
    for no in range(3):
        own = sorted(slot for _, n, slot in slots if n == no)
        assert own == list(range(len(own)))


def test_mix_without_words(spark):
    assert mixing.words_taken(documents(spark, [])).collect() == []
    got = mixing.words_taken(documents(spark, [(1, None, None), (2, " \n", "x")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# conversation repair


def hit(conv, turn):
    return zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20


def brute_repair(rows):
    """Every sequence of edits of at most the least cost, by depth-first search without tables."""
    turns = []
    for conv, turn, role, text in rows:
        role, text, h = " " if role is None else role, " " if text is None else text, hit(conv, turn)
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        turns += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.md5(t[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in turns:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = [2 * len(turns), "D" * len(turns), []]

    def search(i, roles, audit, cost, lines):
        if cost > best[0]:
            return
        if i == len(turns) and re.fullmatch("(s?(ua)+)?", roles):
            if (cost, audit) <= (best[0], best[1]):
                best[:] = [cost, audit, lines]
            return
        wants = "a" if roles.endswith("u") else "u"
        name = {"u": "user", "a": "assistant"}[wants]
        if cost + 5 <= best[0]:
            search(i, roles + wants, audit + "I", cost + 5, [*lines, f"{name}:"])
        if i == len(turns):
            return
        _, role, text = turns[i]
        search(i + 1, roles, audit + "D", cost + 2, lines)
        if faults[i] in ("blank", "duplicate"):
            return
        more = 5 if faults[i] == "truncated" else 0
        if role[:1] == wants or role[:1] == "s" and not roles:
            search(i + 1, roles + role[0], audit + "K", cost + more, [*lines, f"{role}:{text}"])
        search(i + 1, roles + wants, audit + "R", cost + 1 + more, [*lines, f"{name}:{text}"])

    search(0, "", "", 0, [])
    known = [t for t, _, _ in turns if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, best[0], best[1], hashlib.sha256("\n".join(best[2]).encode()).hexdigest()


def random_turns(rng, conv, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "unknown"]
    texts = ["Yes.", "No!", "cut off", "Why?  \n", "", " \t", None, "Same.", "a" * 50 + "."]
    return [(conv, rng.choice([None, *range(n + 2)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


CONVERSATIONS = "conv_id long, turn long, role string, text string, code int, part string, first string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "f", 2) for r in rows], CONVERSATIONS)


def test_repair_against_brute_force(spark):
    rng = random.Random(5)
    rows = [r for conv in [None, *range(150)] for r in random_turns(rng, conv, rng.randint(1, 7))]
    # rows that are all dropped, and repeated rows
    rows += [(1000 + i, t, "user", "Hi.") for i in range(40) for t in (0,) if hit(1000 + i, t) == 0] + [(2000, 0, "user", "Same.")] * 6
    got = {r.conv_id: tuple(r)[1:] for r in conversations.repair_damaged(frame(spark, rows)).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()}
    by_conv = {}
    for r in rows:
        by_conv.setdefault(r[0], []).append(r)
    assert got == {conv: brute_repair(own) for conv, own in by_conv.items()}
    assert ("", hashlib.sha256(b"").hexdigest()) in {(v[6], v[7]) for v in got.values()}


def test_one_long_conversation_crosses_partitions(spark):
    """A conversation over all range partitions has the same repair as in one, and the SQL's."""
    rng = random.Random(6)
    roles = ["user", "assistant", "user", "assistant", "system", "user"]
    rows = [(7, t, rng.choice(roles), rng.choice([f"Text {t % 97}.", f"cut {t}", "", f"More {t}!"])) for t in range(400)] + [(c, 0, "user", "Only.") for c in (1, 2, 900)]
    rows += [(7, 11, "assistant", "Again.")] * 9
    con = duckdb.connect()
    con.sql("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    for row in rows:
        con.execute("insert into conversations values (?, ?, ?, ?)", row)
    found = con.sql(ORACLE_SQL["op13_conversation_repair"])
    columns = list(found.columns)
    want = sorted(map(tuple, found.fetchall()))
    for parts in ("1", "6"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            codes = conversations.turn_codes(conversations.spaced(frame(spark, rows)))
            assert conversations.chunks(codes).where("conv_id = 7").count() >= (1 if parts == "1" else 4)
            got = conversations.repair_damaged(frame(spark, rows)).select(*columns).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert sorted(map(tuple, got)) == want


def test_repair_of_an_empty_table(spark):
    assert conversations.repair_damaged(frame(spark, [])).collect() == []


def test_repair_edge_texts(spark):
    rows = [(1, 0, "user", "wort " * 100_000 + "."), (1, 1, "assistant", "Ja."), (2, None, None, None), (3, None, "user", "?")]
    rows = [r for r in rows if hit(r[0], r[1]) > 4]
    got = {r.conv_id: r for r in conversations.repair_damaged(frame(spark, rows)).collect()}
    assert all(got[c].audit == brute_repair([r for r in rows if r[0] == c])[6] for c in got)
