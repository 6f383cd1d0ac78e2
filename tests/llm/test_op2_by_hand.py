"""The fit and the scores against the cumulative-link likelihood, worked out independently."""

import math
import random

import numpy as np
import pyarrow as pa

from tidemark.llm import quality as Q
from tidemark.llm import text as W

TELLING_WORDS = {0: ["grim", "vile"], 1: ["dull", "flat"], 2: ["clear", "sound"]}
COMMON = ["river", "stone", "cloud", "plain", "paper"]


def rows():
    rng = random.Random(5)
    return [(i, i % 3, " ".join([*rng.choices(COMMON, k=6), rng.choice(TELLING_WORDS[i % 3] if rng.random() < 0.9 else COMMON)])) for i in range(300)]


def chosen(table, places):
    """Places whose share differs by TELLING standard errors across a grade boundary."""
    n = [sum(g == k for _, g, _ in table) for k in range(3)]
    out = set()
    for f in set().union(*places.values()):
        held = [sum(g == k and f in places[i] for i, g, _ in table) for k in range(3)]
        p = sum(held) / len(table)
        for k in (1, 2):
            low, high = sum(n[:k]), sum(n[k:])
            error = math.sqrt(max(p * (1 - p) * (1 / low + 1 / high), 1e-12))
            if sum(held) >= Q.LEAST and abs(sum(held[:k]) / low - sum(held[k:]) / high) >= Q.TELLING * error:
                out.add(f)
    return out


def plain_fit(x, grade, steps=3000):
    """Full-batch ascent on the likelihood: for logistic tails c, d log P / d s is 1 - c[g] - c[g + 1]."""
    w, t, n = np.zeros(x.shape[1]), np.array([-0.7, 0.7]), np.arange(len(grade))
    for _ in range(steps):
        c = np.column_stack([np.ones(len(n)), 1 / (1 + np.exp(t - (x @ w)[:, None])), np.zeros(len(n))])
        p = c[n, grade] - c[n, grade + 1]
        w += 0.05 * (x.T @ (1 - c[n, grade] - c[n, grade + 1]) / len(n) - Q.DECAY * w)
        d = c * (1 - c) / p[:, None]
        t += 0.05 * np.array([np.where(grade == k, d[:, k + 1], 0).mean() - np.where(grade == k + 1, d[:, k + 1], 0).mean() for k in range(2)])
    return w, t


def expected(s, t):
    return sum(1 / (1 + math.exp(x - s)) for x in t)


def test_by_hand(spark):
    table = rows()
    docs = spark.createDataFrame([(i, t) for i, _, t in table], "doc_id long, text string")
    grades = spark.createDataFrame([(i, g) for i, g, _ in table], "doc_id long, grade int")
    places = {i: {*next(iter(Q.features(*W.buffers(pa.array([t]))))).tolist()} for i, _, t in table}
    weights, thresholds = Q.fit(docs, grades)
    places_chosen = chosen(table, places)
    assert {*np.flatnonzero(weights).tolist()} == places_chosen

    got = {r.doc_id: r for r in Q.score(docs, (weights, thresholds)).collect()}
    for i, _, _ in table:
        s = math.fsum(float(weights[f]) for f in places[i])
        assert math.isclose(got[i].expected_grade, expected(s, thresholds), abs_tol=1e-6)
        assert math.isclose(got[i].p_good, 1 / (1 + math.exp(thresholds[-1] - s)), abs_tol=1e-6)

    order = sorted(places_chosen)
    x = np.array([[f in places[i] for f in order] for i, _, _ in table], float)
    w, t = plain_fit(x, np.array([g for _, g, _ in table]))
    ours, plain = np.array([got[i].expected_grade for i, _, _ in table]), np.array([expected(s, t) for s in x @ w])
    assert np.corrcoef(ours, plain)[0, 1] > 0.97
    assert np.abs(ours - plain).mean() < 0.2
    assert (np.sign(weights[order]) == np.sign(w))[np.abs(w) > 0.3].all()
