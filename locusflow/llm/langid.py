"""Language identification by a byte convolutional network.

Bytes of the UTF-8 text are put in at most 64 classes (A-Z fold to a-z, rare
bytes share classes). Filters of widths two, three and four slide over windows of
a fixed length, each filter's maximum over the window is kept, and a softmax over
languages follows. The network is trained in numpy on windows of labelled texts.
A text's probabilities are the mean over all its windows, side by side over the
whole text.

For scoring, what a filter adds for a pair of classes is tabled (64 * 64
entries), so a filter costs one or two look-ups a byte, in batches of windows.

The fit reads a bounded sample (sample_rows texts, windows_per_text windows of
each, all chosen by hashes); scores are for all rows.

Defined cases: a null text, or one without a letter (str.isalpha), is `und` with
score 0; a
text of fewer bytes than a window is filled up with zero bytes; with no labelled
text every prediction is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASSES = 64
WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
UNKNOWN = "und"
_MORE = max(WIDTHS) - 1


@dataclass(frozen=True)
class Network:
    languages: tuple[str, ...]
    classes: np.ndarray  # of each byte
    tables: dict  # (width, place in the filter) -> (FILTERS, CLASSES)
    bias: np.ndarray  # (len(WIDTHS) * FILTERS,)
    out: np.ndarray  # (len(WIDTHS) * FILTERS, languages)
    out_bias: np.ndarray

    def paired(self) -> list[tuple[np.ndarray, int | None, np.ndarray | None]]:
        """For each filter: a table over pairs, and what its later bytes add: (table, offset, table)."""
        t, found = self.tables, []
        for w in WIDTHS:
            first = (t[w, 0][:, :, None] + t[w, 1][:, None, :]).reshape(FILTERS, -1)
            if w == 2:
                later = None
            elif w == 3:
                later = np.repeat(t[w, 2], CLASSES, axis=1)
            else:
                later = (t[w, 2][:, :, None] + t[w, 3][:, None, :]).reshape(FILTERS, -1)
            found += [(first[f].astype(np.float32), None if later is None else 2, None if later is None else later[f].astype(np.float32)) for f in range(FILTERS)]
        return found

    def head(self, pooled: np.ndarray) -> np.ndarray:
        return _softmax(np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def byte_classes(sample: bytes) -> np.ndarray:
    """Class of each byte: 0 the zero byte, 1 rare ASCII, 2 rare others, the rest of the classes to frequent ones."""
    lower = np.arange(256)
    lower[65:91] += 32
    counts = np.bincount(lower[np.frombuffer(sample, np.uint8)], minlength=256)
    out = np.where(np.arange(256) < 128, 1, 2)
    counts[0] = 0
    frequent = [b for b in np.argsort(-counts, kind="stable")[: CLASSES - 3] if counts[b]]
    out[frequent] = np.arange(3, 3 + len(frequent))
    out[0] = 0
    return out[lower].astype(np.int64)


def fit(windows: list[bytes], labels: list[str], epochs: int = 4, batch: int = 64, width: int = 8, rate: float = 4e-3, seed: int = 11) -> Network:
    """A network trained on windows of WINDOW + _MORE bytes (shorter ones are filled up)."""
    rng = np.random.default_rng(seed)
    languages = tuple(sorted(set(labels)))
    classes = byte_classes(b"".join(windows))
    x = np.zeros((len(windows), WINDOW + _MORE), np.int64)
    for i, w in enumerate(windows):
        own = classes[np.frombuffer(w[: WINDOW + _MORE], np.uint8)]
        x[i, : len(own)] = own
    y = np.array([languages.index(lang) for lang in labels])
    n = len(WIDTHS) * FILTERS
    params = {"embed": rng.normal(0, 0.5, (CLASSES, width)), "bias": np.zeros(n), "out": rng.normal(0, 0.2, (n, len(languages))), "out_bias": np.zeros(len(languages))}
    params |= {(w, k): rng.normal(0, 1 / np.sqrt(w * width), (width, FILTERS)) for w in WIDTHS for k in range(w)}
    one, two = {k: np.zeros_like(v) for k, v in params.items()}, {k: np.zeros_like(v) for k, v in params.items()}
    step, rows = 0, np.arange(batch)[:, None]
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order) - batch + 1, batch) if len(order) >= batch else [0]:
            pick = np.resize(order[at : at + batch], batch)
            b, goal = x[pick], y[pick]
            pooled, where = [], []
            for w in WIDTHS:
                conv = sum((params["embed"] @ params[w, k]).astype(np.float32)[b[:, k : k + WINDOW]] for k in range(w))
                where.append(conv.argmax(axis=1))
                pooled.append(np.take_along_axis(conv, where[-1][:, None, :], 1)[:, 0])
            pre = np.concatenate(pooled, 1) + params["bias"]
            h = np.maximum(pre, 0)
            p = _softmax(h @ params["out"] + params["out_bias"])
            p[np.arange(batch), goal] -= 1
            p /= batch
            grads = {"out": h.T @ p, "out_bias": p.sum(0)}
            dh = (p @ params["out"].T) * (pre > 0)
            grads["bias"] = dh.sum(0)
            grads["embed"] = np.zeros_like(params["embed"])
            for i, w in enumerate(WIDTHS):
                d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                for k in range(w):
                    at_class = b[rows, where[i] + k]
                    grads[w, k] = np.einsum("bfe,bf->ef", params["embed"][at_class], d)
                    np.add.at(grads["embed"], at_class, d[:, :, None] * params[w, k].T[None])
            step += 1
            for k, g in grads.items():
                one[k] = 0.9 * one[k] + 0.1 * g
                two[k] = 0.999 * two[k] + 0.001 * g * g
                params[k] = params[k] - rate * (one[k] / (1 - 0.9**step)) / (np.sqrt(two[k] / (1 - 0.999**step)) + 1e-8)
    tables = {(w, k): (params["embed"] @ params[w, k]).T for w in WIDTHS for k in range(w)}
    return Network(languages, classes, tables, params["bias"], params["out"], params["out_bias"])


class Scorer:
    """Probabilities of whole texts, in blocks of windows."""

    def __init__(self, network: Network):
        self.network, self.filters = network, network.paired()

    def pooled(self, pairs: np.ndarray, later: np.ndarray) -> np.ndarray:
        out = np.empty((len(self.filters), len(pairs) // WINDOW), np.float32)
        held, more = np.empty(len(pairs), np.float32), np.empty(len(pairs), np.float32)
        for f, (table, _, extra) in enumerate(self.filters):
            np.take(table, pairs, out=held, mode="clip")
            if extra is not None:
                np.take(extra, later, out=more, mode="clip")
                np.add(held, more, out=held)
            held.reshape(-1, WINDOW).max(axis=1, out=out[f])
        return out.T

    def texts(self, texts: list[bytes], block: int = 128) -> np.ndarray:
        """Mean probabilities over all windows of each text; one row for each."""
        counts = [max(1, -(-len(t) // WINDOW)) for t in texts]
        flat = np.zeros(sum(counts) * WINDOW + _MORE, np.uint8)
        at = 0
        for t, c in zip(texts, counts, strict=True):
            flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
            at += c * WINDOW
        classes = self.network.classes[flat]
        pairs = classes[:-1] * CLASSES + classes[1:]
        # no filter sees the text behind: zero bytes follow each text
        ends = np.cumsum(counts) * WINDOW
        pairs[ends - 1] = classes[ends - 1] * CLASSES
        later = pairs[2:].copy()
        later[ends - 1] = later[ends - 2] = 0
        probs = np.empty((sum(counts), len(self.network.languages)))
        for w in range(0, len(probs), block):
            at = slice(w * WINDOW, min(w + block, len(probs)) * WINDOW)
            probs[w : w + block] = self.network.head(self.pooled(pairs[at], later[at]))
        starts = np.cumsum([0, *counts[:-1]])
        return np.add.reduceat(probs, starts, axis=0) / np.array(counts)[:, None]


def _blocks(texts: Iterator[str], rows: int = 128, chars: int = 1 << 20) -> Iterator[list[str]]:
    """Texts in lists of so many rows and about so many characters at most, a longer text by itself."""
    held, size = [], 0
    for t in texts:
        if held and (len(held) >= rows or size + len(t) > chars):
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def train(docs: DataFrame, learnable: Column, sample_rows: int = 4000, windows_per_text: int = 3) -> Network | None:
    """A network from about sample_rows of the learnable rows with a lang; None if there are none."""
    known = docs.where(learnable & F.col("lang").isNotNull() & (F.length("text") > 0))
    n = known.count()
    if not n:
        return None
    wheel = 1 << 30
    some = known.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(wheel)) < int(min(1.0, sample_rows / n) * wheel))
    # windows start anywhere in the text; what reaches the driver is a bounded number of bytes a row
    length = WINDOW + _MORE
    starts = F.transform(F.sequence(F.lit(1), F.lit(windows_per_text)), lambda k: 1 + F.pmod(F.xxhash64(F.col("doc_id").cast("long"), k), F.greatest(F.length("text") - length, F.lit(1))).cast("int"))
    cut = F.transform(starts, lambda s: F.substring(F.col("text"), s, F.lit(length)))
    rows = some.select(F.col("doc_id").cast("long"), "lang", cut.alias("windows")).collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.lang, r.windows))
    windows = [w.encode("utf-8", "surrogatepass")[:length] for r in rows for w in r.windows]
    return fit(windows, [r.lang for r in rows for _ in r.windows])


def identify_language(docs: DataFrame, learnable: Column, sample_rows: int = 4000) -> DataFrame:
    """docs with lang_pred and score (the mean probability), replacing columns so named.

    learnable: which rows' lang may be learned from.
    """
    network = train(docs, learnable, sample_rows)
    base = docs.drop("lang_pred", "score")
    if network is None:
        return base.withColumn("lang_pred", F.lit(UNKNOWN)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(network)
    result = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    @F.pandas_udf(result)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for texts in batches:
            names, scores = [], []
            for part in _blocks(t or "" for t in texts):
                probs = scorer.texts([t.encode("utf-8", "surrogatepass") for t in part])
                best = probs.argmax(axis=1)
                for t, b, p in zip(part, best, probs.max(axis=1), strict=True):
                    letters = any(map(str.isalpha, t))
                    names.append(scorer.network.languages[b] if letters else UNKNOWN)
                    scores.append(float(min(p, 1.0)) if letters else 0.0)
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return base.withColumn("__lf", predict("text")).select(*base.columns, "__lf.lang_pred", "__lf.score")
