"""A quality classifier from positive and unlabelled texts.

Documents labelled good are trusted positives; a plain sample of all documents,
whatever their label, is the unlabelled set. The class prior is estimated from
these two alone: a network tells positives from unlabelled rows, and on rows kept
back from it, the least ratio of the unlabelled share to the positive share above any
score (with a margin for small shares) is the share of good ones. A few small networks are then trained in numpy by the
non-negative unbiased risk: prior * R+(positives) + max(0, R-(unlabelled) - prior *
R-(positives)); where the second part falls below zero the step goes back. Only the last
step reads labels of both kinds: a logistic curve of two numbers, fitted on labelled training
rows, turns the networks' mean output into a probability. Features are byte frequencies and counts over whole texts.

The fit reads a bounded sample (sample_rows of each kind, chosen by a hash of
doc_id); scores are for all rows.

Defined cases: a null text is the empty text and gets a score like any other;
labels that contradict each other count as bad; without a positive in the
training rows nothing can be learned, and every score is the share of good labels,
(good + 1) / (labels + 2).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.7
_N = 128 + 16


def features(text: str) -> np.ndarray:
    """Square roots of byte frequencies, and counts, of the whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    n = max(len(raw), 1)
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) / n
    words = text.split()
    nw = max(len(words), 1)
    counts = Counter(words)
    lines = text.split("\n")
    out = np.empty(_N)
    out[:128] = np.sqrt(hist[:128])
    letters = hist[65:91].sum() + hist[97:123].sum() + hist[128:].sum()
    out[128:] = (
        np.log1p(len(raw)),
        np.log1p(len(words)),
        len(counts) / nw,
        max(counts.values(), default=0) / nw,
        sum(map(eq, words, words[1:])) / nw,
        len(raw) / nw / 16,
        hist[65:91].sum(),
        hist[97:123].sum(),
        hist[48:58].sum(),
        hist[128:].sum(),
        letters,
        1 - letters - hist[32] - hist[10],
        np.log1p(len(lines)),
        1 - len(set(lines)) / len(lines),
        sum(v > 1 for v in counts.values()) / nw,
        np.log1p(len(words) / len(lines)),
    )
    return out


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    networks: list[list[np.ndarray]]
    slope: float
    offset: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return outputs(self.networks, (x - self.mean) / self.scale)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(x) + self.offset)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """slope and offset of a logistic curve, by Newton steps with a weak ridge."""
    x = np.stack([z, np.ones_like(z)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(30):
        p = _sigmoid(x @ beta)
        grad = x.T @ (p - y) + 1e-3 * beta
        beta = beta - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), grad)
    return float(beta[0]), float(beta[1])


def outputs(networks: list[list[np.ndarray]], x: np.ndarray) -> np.ndarray:
    """The mean output of networks, which differ in their random start and batches."""
    return sum(np.tanh(x @ w1 + b1) @ w2 for w1, b1, w2 in networks) / len(networks)


def _trained(xp: np.ndarray, xu: np.ndarray, prior: float | None, hidden: int, steps: int, batch: int, rate: float, seed: int) -> list[np.ndarray]:
    """A network's weights: of the least non-negative risk under the prior, or without one, of the least loss in telling positives from unlabelled rows."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 1 / np.sqrt(xp.shape[1]), (xp.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.3, hidden)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        x = np.concatenate([xp[rng.integers(len(xp), size=batch)], xu[rng.integers(len(xu), size=batch)]])
        h = np.tanh(x @ params[0] + params[1])
        dz = risk_gradient(h @ params[2], batch, prior)[1]
        dh = dz[:, None] * params[2] * (1 - h * h)
        grads = [x.T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ dz + 1e-4 * params[2]]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return params


def risk_gradient(z: np.ndarray, n: int, prior: float | None) -> tuple[float, np.ndarray]:
    """The risk of outputs z, positives' n first, and the step's direction.

    Logistic losses: log(1 + exp(-z)) for good, log(1 + exp(z)) for bad. Where the part of
    the bad falls below zero it overfits, and the step goes up on it alone.
    """
    p, m = _sigmoid(z), len(z) - n
    good, bad = np.logaddexp(0, -z[:n]).mean(), np.logaddexp(0, z[n:]).mean()
    if prior is None:
        return float(good + bad), np.concatenate([(p[:n] - 1) / n, p[n:] / m])
    rest = bad - prior * np.logaddexp(0, z[:n]).mean()
    if rest < 0:
        return float(prior * good), np.concatenate([prior * p[:n] / n, -p[n:] / m])
    return float(prior * good + rest), np.concatenate([(prior * (p[:n] - 1) - prior * p[:n]) / n, p[n:] / m])


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of positives among unlabelled rows, from scores of both that grow with being positive.

    Above any score there are at least that share of the positives; where few others are, the ratio of shares is near it.
    """
    cuts = np.sort(positive)
    own = 1 - np.arange(len(cuts)) / len(cuts)
    every = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    margin = (1 + gamma) * sum(np.sqrt(np.log(4 / delta) / 2 / n) for n in (len(positive), len(unlabelled)))
    best = int(np.argmin((every + margin) / own))
    return float(np.clip(every[best] / own[best], 0.05, 0.95))


def fit(positive: np.ndarray, unlabelled: np.ndarray, labelled: np.ndarray, labels: np.ndarray, hidden: int = 24, steps: int = 600, batch: int = 512, rate: float = 3e-3, seed: int = 7, networks: int = 3) -> Model:
    """Networks of least non-negative risk on these features; labelled and labels give the curve alone."""
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    xp, xu = (positive - mean) / scale, (unlabelled - mean) / scale
    # every fifth row is kept back for the prior, all of few
    back_p, back_u = (np.arange(len(x)) % 5 == 0 for x in (xp, xu))
    some_p, some_u = (x[~b] if (~b).any() else x for x, b in ((xp, back_p), (xu, back_u)))
    apart = [_trained(some_p, some_u, None, hidden, steps // 2, batch, rate, seed + k) for k in range(networks)]
    prior = class_prior(outputs(apart, xp[back_p]), outputs(apart, xu[back_u]))
    model = Model(mean, scale, [_trained(xp, xu, prior, hidden, steps, batch, rate, seed + k) for k in range(networks)], 1.0, 0.0)
    return replace(model, **dict(zip(("slope", "offset"), _platt(model.raw(labelled), labels), strict=True)))


def _held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> Model | float:
    """The model from at most about sample_rows labelled and as many unlabelled rows; without a positive one score for all.

    labels: doc_id, quality (0 or 1); only those with crc32(doc_id) mod 4 other than 2 are read.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(~_held_out())
    wheel = 1 << 30
    sampled = lambda share, salt: F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(salt)), F.lit(wheel)) < int(share * wheel)
    n_known, n_docs = known.count(), docs.count()
    if not n_known or not n_docs:
        return 0.5
    some = known.where(sampled(min(1.0, sample_rows / n_known), 1)).groupBy(F.col("doc_id").alias("__lf_id")).agg(F.min("quality").alias("quality"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # the sample is about sample_rows rows, whatever the size of labels
    both = own.join(F.broadcast(some), F.col("doc_id") == F.col("__lf_id"), "left").withColumn("plain", F.coalesce(sampled(min(1.0, sample_rows / n_docs), 2), F.lit(False)))
    both = both.where("plain OR quality IS NOT NULL")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t or "").astype(np.float32).tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.binary()), batch.column(2), batch.column(3)], names=["doc_id", "x", "quality", "plain"])

    rows = both.select("doc_id", "text", F.col("quality").cast("int").alias("quality"), "plain").mapInArrow(extract, "doc_id long, x binary, quality int, plain boolean").collect()
    rows.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.x))
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows], float).reshape(-1, _N)
    quality = np.array([-1 if r.quality is None else r.quality for r in rows], int)
    plain = np.array([r.plain for r in rows], bool)
    labelled = quality >= 0
    if not (quality == 1).any() or not plain.any():
        return float(((quality == 1).sum() + 1) / (labelled.sum() + 2))
    return fit(x[quality == 1], x[plain], x[labelled], quality[labelled].astype(float))


def score_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold), replacing columns so named."""
    model = train(docs, labels, sample_rows)
    base = docs.drop("score", "predicted")
    if isinstance(model, float):
        return base.withColumn("score", F.lit(model)).withColumn("predicted", F.lit(int(model >= threshold)))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts):
        import pandas as pd

        out = np.empty(len(texts))
        for at in range(0, len(texts), 256):
            out[at : at + 256] = shared.value.score(np.stack([features(t or "") for t in texts.iloc[at : at + 256]]))
        return pd.Series(out)

    scored = base.withColumn("score", score("text"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0).cast("int"))
