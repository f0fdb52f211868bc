"""The quality classifier's risk, prior and features against plain loops."""

import math
from collections import Counter

import numpy as np
import pytest

from locusflow.llm import quality


@pytest.mark.parametrize("prior", [None, 0.3, 0.9])
def test_gradient_by_differences(prior):
    rng = np.random.default_rng(1)
    for scale in (0.5, 3.0):
        z = rng.normal(0, scale, 14)
        risk, slope = quality.risk_gradient(z, 6, prior)
        loss = lambda z: math.log1p(math.exp(-z))
        good, bad = sum(map(loss, z[:6])) / 6, sum(loss(-v) for v in z[6:]) / 8
        rest = bad if prior is None else bad - prior * sum(loss(-v) for v in z[:6]) / 6
        want = good + bad if prior is None else prior * good + max(rest, 0)
        assert risk == pytest.approx(want)
        if prior is None or rest >= 0:
            for k in range(14):
                up, down = z.copy(), z.copy()
                up[k] += 1e-5
                down[k] -= 1e-5
                numeric = (quality.risk_gradient(up, 6, prior)[0] - quality.risk_gradient(down, 6, prior)[0]) / 2e-5
                assert slope[k] == pytest.approx(numeric, abs=1e-6)


def test_a_step_goes_back_where_the_rest_is_negative():
    z = np.array([4.0, 5.0, -3.0, -4.0])
    _, slope = quality.risk_gradient(z, 2, 0.9)
    p = 1 / (1 + np.exp(-z))
    assert slope == pytest.approx([0.9 * p[0] / 2, 0.9 * p[1] / 2, -p[2] / 2, -p[3] / 2])


@pytest.mark.parametrize("share", [0.2, 0.6, 0.9])
def test_prior_of_a_mixture(share):
    rng = np.random.default_rng(2)
    positive = rng.normal(3, 1, 4000)
    mixed = np.where(rng.random(6000) < share, rng.normal(3, 1, 6000), rng.normal(-3, 1, 6000))
    assert quality.class_prior(positive, mixed) == pytest.approx(share, abs=0.04)


def test_features_by_loops():
    text = "Some words some WORDS words words\n\nça va 12, some words\n\nça va 12"
    x = quality.features(text)
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    for c in range(128):
        assert x[c] == pytest.approx(math.sqrt(sum(b == c for b in raw) / len(raw)))
    counts = Counter(words)
    share = lambda test: sum(map(test, raw)) / len(raw)
    letters = share(lambda b: chr(b).isalpha() and b < 128 or b >= 128)
    want = [
        math.log(1 + len(raw)), math.log(1 + len(words)), len(counts) / len(words), max(counts.values()) / len(words), sum(a == b for a, b in zip(words, words[1:])) / len(words), len(raw) / len(words) / 16,
        share(lambda b: 65 <= b <= 90), share(lambda b: 97 <= b <= 122), share(lambda b: 48 <= b <= 57), share(lambda b: b >= 128), letters, 1 - letters - share(lambda b: b in (10, 32)),
        math.log(1 + len(lines)), 1 - len(set(lines)) / len(lines), sum(v > 1 for v in counts.values()) / len(words), math.log(1 + len(words) / len(lines)),
    ]
    assert x[128:] == pytest.approx(want)


def test_nothing_learned_accepts_nothing(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    bad = docs.selectExpr("doc_id", "0 AS quality")
    got = quality.score_quality(docs, bad).collect()
    assert {r.predicted for r in got} == {0} and len({r.score for r in got}) == 1 and got[0].score < 0.1
    assert {(r.score, r.predicted) for r in quality.score_quality(docs, bad.limit(0)).collect()} == {(0.5, 0)}
