"""N-gram Jaccard join by parity sketches.

A document is the set of its word shingles. Jaccard similarity of num/den at
least means a symmetric difference of at most (den - num) / (den + num) of both
sizes' sum. Sets of like size (a band) are hashed into the same number of parts;
in each part every token toggles a bit of a wide parity sketch, of which the XOR
of the tokens' 64-bit hashes is kept. Two sketches differ in no more bits, and so
in no more parts, than the symmetric difference has tokens, which are fewer than
there are parts: some part is equal in both (pigeonhole), and equal parts are
what documents are joined by.

Empty parts are shared by strangers. A band has so many more parts than
differences that a document may leave its empty parts out (a pair then still
agrees in another one); if it has more of them than that, it keeps them all, so
no pair is ever lost.

Parts that many strangers share (a common passage fills some) are left out in
the same way: a set has spare parts beyond the needed ones, its empty parts and
then its most frequent ones are the spare ones, and as two sets that are similar
agree in more parts than are spare, the least frequent part they agree in is left
out by neither.

Sets that left out fewer parts than they could must share the more: one part more
than the lesser of what they could still spare.

Identical sets are one node. In a few turns, every node is compared with some of
the nodes that it stands beside in its parts, in an order that changes; what a
turn links is contracted, so that groups of copies become components by about as
many comparisons as they have texts. Only then pairs that share a part and are
still in different components are compared, all of them. Candidates pass a
1024-bit parity sketch, a wide one that grows with the set, and an exact count on
the texts. No bucket is ever held in
memory.

Defined cases: null or empty texts (and ones without words) are linked with
nothing; fewer words than a shingle are one shingle; rows are documents, equal
doc_ids with different texts are different nodes; a null doc_id is never the
name of a component unless there is no other.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import may_hold
from .common import is_small, light, materialise, mix64, portions, release, spread, text_of
from .components import components

_GROWTH = 1.5
_SKETCH = tuple(f"s{k}" for k in range(16))
#: A key's low bits name its band.
_BAND_BITS = 7
#: Parts with more sets than this are left out first, as far as a set has parts to spare.
_HOT = 64
#: Bits of a wide sketch at most, as a power of two.
_WIDEST = 20
#: Turns in which a node meets a few partners, before all pairs that are left.
_TURNS = 4
#: Pairs of one node that are checked in one group.
_STAR = 4096


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of the ASCII-lower-cased words."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    width = min(width, n)
    out = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + hashed[k : n - width + 1 + k])
    return np.unique(out)


class Bands:
    """Size bands, and how many parts a band's sets are dealt into."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.starts = [1]
        while self.starts[-1] < 1 << 40:
            self.starts.append(max(self.starts[-1] + 1, math.ceil(self.starts[-1] * _GROWTH)))

    def differences(self, total: int) -> int:
        """The largest symmetric difference that two sets of this total size may have."""
        return (self.den - self.num) * total // (self.den + self.num)

    def parts(self, band: int) -> tuple[int, int]:
        """Parts of a band, and how many of them a set may leave out."""
        least, most = self.starts[band], self.starts[band + 1] - 1
        needed = self.differences(2 * most) + 1
        mean = least / needed
        spare = math.ceil(needed * max(0.1, min(0.25, 1.5 * math.exp(-mean)))) if needed > 1 else 0
        return needed + spare, spare

    def of(self, size: int) -> list[int]:
        """A set's own band, and those above that hold larger partners."""
        own = bisect_right(self.starts, size) - 1
        return list(range(own, bisect_right(self.starts, size * self.den // self.num)))


def part_keys(tokens: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """A key for each part's parity sketch, in each of the set's bands, and how many more of the band's keys may go.

    Of the empty parts so many go that the most are spared.
    """
    keys, left = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    dealt = mix64(tokens + np.uint64(0xD1B54A32D192ED03))
    hashed = mix64(tokens ^ np.uint64(0x8EBC6AF09C88C6E3))
    for band in bands.of(len(tokens)):
        parts, spare = bands.parts(band)
        if parts == 1:  # no difference is allowed, and equal sets are one node
            continue
        words = np.zeros(parts, np.uint64)
        np.bitwise_xor.at(words, (dealt % np.uint64(parts)).astype(np.int64), hashed)
        gone = np.flatnonzero(words == 0)[:spare]
        at = np.delete(np.arange(parts, dtype=np.uint64), gone)
        own = mix64(mix64(at + np.uint64(band << 40)) + words[at])
        keys.append(own >> np.uint64(_BAND_BITS) << np.uint64(_BAND_BITS) | np.uint64(band))
        left.append(np.full(len(own), spare - len(gone)))
    return np.concatenate(keys), np.concatenate(left)


def small_sketch(tokens: np.ndarray) -> np.ndarray:
    """1024 parity bits as sixteen words."""
    words = np.zeros(len(_SKETCH), np.uint64)
    dealt = mix64(tokens ^ np.uint64(0xA0761D6478BD642F))
    np.bitwise_xor.at(words, ((dealt >> np.uint64(6)) & np.uint64(len(_SKETCH) - 1)).astype(np.int64), np.uint64(1) << (dealt & np.uint64(63)))
    return words


def wide_sketch(tokens: np.ndarray) -> bytes | None:
    """Parity bits, about twice as many as tokens (a power of two), of a set for which 1024 say little; else none."""
    if len(tokens) <= 512:
        return None
    bits = 1 << min((2 * len(tokens) - 1).bit_length(), _WIDEST)
    at = (mix64(tokens ^ np.uint64(0xE7037ED1A0B428DB)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_distance(a: bytes, b: bytes) -> int:
    """Bits in which two wide sketches differ, the longer one folded to the shorter one's bits."""
    small, large = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    folded = np.bitwise_xor.reduce(large.reshape(-1, len(small)), axis=0)
    return int(np.bitwise_count(small ^ folded).sum())


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    hi, lo = np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64).tolist()
    return hi, lo


def _keyed_texts(docs: DataFrame) -> DataFrame:
    """The texts, and two hashes that tell them apart."""
    text = text_of()
    return docs.select(F.col("doc_id").cast("long"), text.cast("binary").alias("text"), F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2"))


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """One row a document: what identifies its text and its set, the set's size and sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                sizes, digests, sketches, wide = [], [], [], []
                for text in part.column(1).to_pylist():
                    tokens = shingle_set(text, width)
                    sizes.append(len(tokens))
                    digests.append(_digest(tokens))
                    sketches.append(small_sketch(tokens))
                    wide.append(wide_sketch(tokens))
                words, both = np.stack(sketches).view(np.int64), np.array(digests, np.int64)
                arrays = [part.column(0), part.column(2), part.column(3), pa.array(sizes, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(wide, pa.binary())]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(words[:, k]) for k in range(len(_SKETCH)))], names=["doc_id", "t1", "t2", "n", "hi", "lo", "wide", *_SKETCH])

    words = ", ".join(f"{s} long" for s in _SKETCH)
    return _keyed_texts(docs).mapInArrow(run, f"doc_id long, t1 long, t2 long, n long, hi long, lo long, wide binary, {words}")


def _keys(docs: DataFrame, width: int, bands: Bands, known: int = 1 << 18) -> DataFrame:
    """(key, spare, lo) of the parts of each set; a task gives a set once, as far as it remembers (known sets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for part in portions(batch, 0, size=1 << 20):
                keys, left, names = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for text in part.column(0).to_pylist():
                    tokens = shingle_set(text, width)
                    digest = _digest(tokens)
                    if digest in seen or not len(tokens):
                        continue
                    if len(seen) >= known:
                        seen.clear()
                    seen.add(digest)
                    own, spare = part_keys(tokens, bands)
                    keys.append(own)
                    left.append(spare)
                    names.append(np.full(len(own), digest[1]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(left).astype(np.int32)), pa.array(np.concatenate(names))], names=["key", "spare", "lo"])

    return docs.select(text_of().cast("binary")).mapInArrow(run, "key long, spare int, lo long")


def _members(docs: DataFrame, nodes: DataFrame, width: int, bands: Bands) -> DataFrame:
    """(key, node, spare) of parts that several sets share, without frequent ones that their sets can spare.

    spare: how many more of the band's parts the set could have left out; so similar
    sets share more parts than the lesser one's spare ones.
    """
    by_key = Window.partitionBy("key").orderBy("lo")
    dealt = _keys(docs, width, bands).select("key", "spare", "lo", F.first("lo").over(by_key).alias("least"), F.lead("lo").over(by_key).alias("after"))
    # the last row of each set, if there is another set
    shared = dealt.where("(after IS NULL OR after <> lo) AND (lo <> least OR after IS NOT NULL)")
    every = materialise(shared.select("key", "spare", "lo").join(nodes.select("lo", "node"), "lo").select("key", "spare", "node"), "ngram-parts")
    hot = materialise(every.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where(F.col("sets") > _HOT), "ngram-hot")
    band = F.col("key").bitwiseAND(F.lit((1 << _BAND_BITS) - 1))
    nth = F.row_number().over(Window.partitionBy("node", band).orderBy(F.desc("sets"), "key"))
    gone = materialise(every.join(light(hot), "key").withColumn("nth", nth).where("nth <= spare").select("key", "node"), "ngram-gone")
    lost = gone.groupBy("node", band.alias("band")).agg(F.count(F.lit(1)).alias("lost"))
    few = is_small(gone)
    gone_from = lambda table: F.broadcast(table) if few else table
    left = every.join(gone_from(gone), ["key", "node"], "left_anti").withColumn("band", band).join(gone_from(lost), ["node", "band"], "left")
    kept = materialise(left.select("key", "node", (F.col("spare") - F.coalesce("lost", F.lit(0))).cast("int").alias("spare")), "ngram-members")
    release(gone)
    release(every, hot)
    return kept


def _may_link(a: str, b: str, bands: Bands) -> Column:
    """Sizes and small sketches allow the link."""
    size_a, size_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in _SKETCH), F.lit(0))
    near = apart * (bands.den + bands.num) <= (size_a + size_b) * (bands.den - bands.num)
    return near & (F.least(size_a, size_b) * bands.den >= F.greatest(size_a, size_b) * bands.num)


def _dealt(pairs: DataFrame) -> DataFrame:
    """(a, node, salt, nth) of pairs (a, b): the second nodes of each first one (nth 1), and itself (nth 0).

    The pairs of a node that has very many are dealt into several salts. Few
    pairs are dealt by one task and broadcast to what they are joined with.
    """
    few = is_small(pairs)
    if few:
        pairs = pairs.coalesce(1)
    stars = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / _STAR).cast("int").alias("salts"))
    others = pairs.join(stars, "a").select("a", F.col("b").alias("node"), F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("nth"))
    dealt = others.unionByName(stars.select("a", F.col("a").alias("node"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("nth")))
    return F.broadcast(dealt) if few else dealt


def _sharp(pairs: DataFrame, nodes: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a, b) that wide sketches allow, where both sets have one."""
    num, den = bands.num, bands.den

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for part in portions(batch, 5, rows=4096):
                for a, node, salt, nth, n, wide in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if nth == 0:
                        held = (a, salt, n, wide)
                    elif wide is None or held[3] is None or wide_distance(wide, held[3]) * (den + num) <= (n + held[2]) * (den - num):
                        found.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    grouped = spread(_dealt(pairs).join(nodes.select("node", "n", "wide"), "node").select("a", "node", "salt", "nth", "n", "wide"), "a", "salt")
    return materialise(grouped.sortWithinPartitions("a", "salt", "nth").mapInArrow(check, "a long, b long"), "ngram-sharp")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, width: int, bands: Bands) -> DataFrame:
    """Those of the pairs (a, b) whose texts' sets are similar enough.

    Each text goes to the groups of its pairs' first nodes, whose own text comes
    first; large groups are dealt into several, each with that text.
    """
    num, den = bands.num, bands.den
    sharp = _sharp(pairs, nodes, bands)
    wanted = materialise(_dealt(sharp).join(nodes.select("node", "t1", "t2", "hi", "lo"), "node"), "ngram-wanted")
    release(sharp)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = None, None
        for batch in batches:
            found: list[tuple[int, int]] = []
            for part in portions(batch, 4):
                for a, node, salt, nth, text, hi, lo in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    own = shingle_set(text, width)
                    if _digest(own) != (hi, lo):  # another text with both hashes
                        continue
                    if nth == 0:
                        held, tokens = (a, salt), own
                    elif held == (a, salt):
                        common = len(np.intersect1d(tokens, own, assume_unique=True))
                        if den * common >= num * (len(tokens) + len(own) - common):
                            found.append((a, node))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    texts = _keyed_texts(docs).select("text", "t1", "t2")
    if few := is_small(wanted):
        texts = texts.join(F.broadcast(wanted.select("t1", "t2")), ["t1", "t2"], "left_semi")
    else:
        name = F.col("t1").cast("string").alias("name")
        texts = texts.withColumn("name", name).where(may_hold(wanted.select(name), "name")).drop("name")
    texts = texts.dropDuplicates(["t1", "t2"])
    grouped = spread((F.broadcast(wanted) if few else wanted).join(texts, ["t1", "t2"]).select("a", "node", "salt", "nth", "text", "hi", "lo"), "a", "salt")
    done = materialise(grouped.sortWithinPartitions("a", "salt", "nth").mapInArrow(check, "a long, b long"), "ngram-links")
    release(wanted)
    return done


def _rooted(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """members with the root that links lead to."""
    if links is None:
        return members.withColumn("root", F.col("node"))
    return members.join(light(components(links)), "node", "left").select("key", "node", "spare", F.coalesce("root", "node").alias("root"))


def _neighbours(rooted: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of different roots that stand side by side in a part, in an order that changes by turn.

    A node has one partner in the first turn and up to three later, those it
    stands beside most often; and none that it stands beside too rarely for sets
    with so many parts to spare, unless they have very many copies.
    """
    order = Window.partitionBy("key").orderBy(F.xxhash64("node", F.lit(turn)), "node")
    beside = rooted.select("node", "root", "spare", *(F.lag(c).over(order).alias(a) for c, a in (("node", "other"), ("root", "other_root"), ("spare", "other_spare")))).where("root <> other_root")
    met = beside.groupBy(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).agg(F.count(F.lit(1)).alias("parts"), F.max(F.least("spare", "other_spare")).alias("spare")).where("parts * 16 > spare")
    nth = F.row_number().over(Window.partitionBy("b").orderBy(F.desc("parts"), F.xxhash64("a", F.lit(turn))))
    return met.withColumn("nth", nth).where(F.col("nth") <= (3 if turn else 1)).select("a", "b")


def _likely(pairs: DataFrame, facts: DataFrame, bands: Bands) -> DataFrame:
    """The pairs (a written table) that sizes and sketches allow."""
    if is_small(pairs):  # the nodes stay where they are, and only those of pairs move
        x, y = (facts.join(F.broadcast(pairs), F.col("node") == F.col(end)).alias(alias) for end, alias in (("a", "x"), ("b", "y")))
        both = x.join(y, (F.col("x.a") == F.col("y.a")) & (F.col("x.b") == F.col("y.b")))
        return both.where(_may_link("x", "y", bands)).select("x.a", "x.b")
    both = pairs.alias("p").join(facts.alias("x"), F.col("p.a") == F.col("x.node")).join(facts.alias("y"), F.col("p.b") == F.col("y.node"))
    return both.where(_may_link("x", "y", bands)).select("p.a", "p.b")


def jaccard_links(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, nodes, links): documents with their node, distinct sets, links that join all similar sets.

    rows: doc_id, n, node (null for an empty set). nodes: node, n, least (doc_id).
    links: pairs (a, b) of nodes that are similar; any two similar nodes are joined by a path of links.
    """
    bands = Bands(num, den)
    prints = materialise(_prints(docs, width), "ngram-prints")
    same = [F.first(c).alias(c) for c in ("n", "wide", *_SKETCH)]
    sets = prints.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("least"), F.min(F.struct("t1", "t2")).alias("t"), *same)
    nodes = materialise(sets.select("hi", "lo", "least", "t.t1", "t.t2", "n", "wide", *_SKETCH, F.monotonically_increasing_id().alias("node")), "ngram-nodes")
    members = _members(docs, nodes, width, bands)
    facts = nodes.select("node", "n", *_SKETCH)

    links: DataFrame | None = None
    for turn in range(_TURNS):
        rooted = _rooted(members, links)
        met = materialise(_neighbours(rooted, turn), "ngram-met")
        pairs = materialise(_likely(met, facts, bands), "ngram-pairs")
        release(met)
        if pairs.isEmpty():
            break
        near = _verified(pairs, nodes, docs, width, bands)
        links = near if links is None else links.unionByName(near)
        release(pairs)

    rooted = materialise(_rooted(members, links), "ngram-rooted")
    release(members)
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    rest = materialise(rooted.join(open_keys, "key", "left_semi").join(facts, "node"), "ngram-rest")
    release(rooted)
    x, y = rest.alias("x"), rest.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    band = F.col("x.key").bitwiseAND(F.lit((1 << _BAND_BITS) - 1)).alias("band")
    met = x.join(y, apart & _may_link("x", "y", bands)).groupBy(F.col("x.node").alias("a"), F.col("y.node").alias("b"), band)
    met = met.agg(F.count(F.lit(1)).alias("parts"), F.min(F.least("x.spare", "y.spare")).alias("spare")).where("parts > spare")
    more = materialise(met.select("a", "b").distinct(), "ngram-pairs")
    last = _verified(more, nodes, docs, width, bands)
    release(rest, more)
    links = last if links is None else links.unionByName(last)
    rows = prints.select("doc_id", "t1", "t2", "n", "hi", "lo").join(nodes.select("hi", "lo", "node"), ["hi", "lo"], "left").select("doc_id", "t1", "t2", "n", "node")
    return rows, nodes.select("node", "n", "least"), links


def _named(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Rows of documents with their node and component_id."""
    rows, nodes, links = jaccard_links(docs, width, num, den)
    roots = components(links)
    rooted = nodes.join(light(roots), "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialise(rooted.join(names, "root").select("node", "root", "component_id"), "ngram-named")
    return rows.join(named, "node", "left")


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id, the smallest doc_id that links lead to, of every row."""
    out = _named(docs, width, num, den)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def first_of_component(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs with one row of each component of similar documents, and all rows that are linked with nothing.

    The row of the smallest doc_id stays, null being the greatest; of equal
    doc_ids the least hash of the text decides, and of equal rows one stays.
    """
    rows = _named(docs, width, num, den)
    none, own = F.col("doc_id").isNull(), F.coalesce(F.col("doc_id").cast("long"), F.lit(0))
    order = F.struct(none.alias("none"), own.alias("own"), "t1", "t2")
    first = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("o"))
    names = {"none": "__lf_none", "own": "__lf_own", "t1": "__lf_t1", "t2": "__lf_t2"}
    firsts = materialise(first.select(*(F.col(f"o.{c}").alias(a) for c, a in names.items())), "ngram-firsts")
    text = text_of()
    keyed = docs.withColumns(dict(zip(names.values(), (none, own, F.xxhash64(text), F.xxhash64(F.lit(1), text)), strict=True)))
    # rows without words are in no component: they stay whatever repeats them
    bare = ~text.rlike(r"[^ \t\n\x0B\f\r]")
    nth = F.row_number().over(Window.partitionBy(*names.values()).orderBy("__lf_own"))
    kept = keyed.where(~bare).join(light(firsts), list(names.values()), "left_semi").withColumn("__lf_nth", nth).where("__lf_nth = 1")
    return kept.select(*docs.columns).unionByName(docs.where(bare))
