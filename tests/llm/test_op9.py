import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from tidemark.llm import ngram_lm as L
from tidemark.llm.trie import CODEBOOK, EliasFano, Trie, quantise


@pytest.mark.parametrize("top", [1, 10, 1 << 20, 1 << 40, (1 << 64) - 1])
def test_elias_fano(top):
    rng = np.random.default_rng(top % 1000)
    for n in (0, 1, 2, 500):
        v = np.sort(rng.integers(0, top, n, dtype=np.uint64, endpoint=True))
        packed = EliasFano.pack(v)
        e = EliasFano(b"xx" + packed, 2)
        assert (e.get(np.arange(n)) == v).all() and e.end == len(packed) + 2
        x = np.concatenate([v, rng.integers(0, top, 300, dtype=np.uint64, endpoint=True), np.array([0, top, (1 << 64) - 1], np.uint64)])
        for low, up in ((0, n), (n // 3, n // 2)):
            got = e.find(x, np.full(len(x), low), np.full(len(x), up))
            there = np.isin(x, v[low:up])
            assert ((got >= 0) == there).all() and (v[got[there]] == x[there]).all() and ((got[there] >= low) & (got[there] < up)).all()


def test_elias_fano_is_compact():
    v = np.sort(np.random.default_rng(0).integers(0, 1 << 44, 100_000, dtype=np.uint64))
    assert len(EliasFano.pack(v)) < 100_000 * 4.6


def test_trie(tmp_path):
    rng = np.random.default_rng(3)
    hashes = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    two = np.unique((rng.integers(0, 150, 4000) << 32) | rng.integers(0, 1 << 32, 4000))
    three = np.unique((rng.integers(0, len(two), 9000) << 24) | rng.integers(0, 1 << 24, 9000))
    p1, p2, w2, p3 = (rng.random(n) for n in (len(hashes), len(two), len(two), len(three)))
    n2, n3 = np.bincount(two >> 32, minlength=len(hashes)), np.bincount(three >> 24, minlength=len(two))
    packed = Trie.pack(hashes, np.arange(len(hashes)), p1, n2, two & 0xFFFFFFFF, p2, w2, n3, three & 0xFFFFFF, p3)
    (tmp_path / "t").write_bytes(packed)
    t = Trie.open(str(tmp_path / "t"))
    assert (t.ranks(hashes) == np.arange(len(hashes))).all() and t.ranks(np.array([5], np.uint64))[0] == -1
    assert (t.children(2, np.arange(len(hashes)), two & 0xFFFFFFFF, n2) == np.arange(len(two))).all()
    assert (t.children(3, np.arange(len(two)), three & 0xFFFFFF, n3) == np.arange(len(three))).all()
    assert (t.children(2, np.array([-1, 199, 3]), np.array([1, 1, 1]), np.array([1, 1, 1])) == -1).all()
    assert (t.weights == quantise(p1)).all() and (t.pairs == quantise(p2)).all() and (t.pair_weights == quantise(w2)).all() and (t.triples == quantise(p3)).all()
    assert np.abs(CODEBOOK[quantise(p3)] / p3 - 1).max() < 0.033
    assert len(packed) < len(hashes) * 24 + len(two) * 8.5 + len(three) * 6


def words(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]


def rounded(p):
    return float(CODEBOOK[quantise(np.array([p]))[0]])


def model(train):
    """P(w | u v) by counters; quantised as the trie has it, or exact."""
    grams = [Counter(), Counter(), Counter()]
    for x in train:
        for i, w in enumerate(x):
            full = ["<s>", *x[:i]][-2:]
            for k in range(3):
                if k <= len(full):
                    grams[k][(*full[len(full) - k :], w)] += 1
    n, v = sum(grams[0].values()), len(grams[0])
    after = [Counter(), Counter(), Counter()]
    types = [Counter(), Counter(), Counter()]
    for k in (1, 2):
        for g, c in grams[k].items():
            after[k][g[:-1]] += c
            types[k][g[:-1]] += 1

    def p(w, full, q=rounded):
        out = (grams[0][w,] + 1) / (n + v + 1)
        for k in (1, 2):
            if k <= len(full):
                c = (*full[len(full) - k :],)
                if all_ := after[k][c]:
                    out = q(max(grams[k][(*c, w)] - L.DISCOUNT, 0) / all_) + q(L.DISCOUNT * types[k][c] / all_) * out
        return out

    return p, grams[0], n, v


def brute(rows):
    p, uni, n, v = model([words(t) for i, t in rows if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2])
    out = []
    for i, t in rows:
        x = words(t)
        s = sum(log10(p(w, ["<s>", *x[:k]][-2:])) for k, w in enumerate(x))
        out.append((i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, len(x), sum(uni[w,] > 0 for w in x), n, pytest.approx(sum(log10((uni[w,] + 1) / (n + v + 1)) for w in x), rel=1e-9), pytest.approx(s, rel=1e-9)))
    return sorted(out, key=lambda r: str(r[:4]))


def check(spark, rows, **kw):
    got = sorted((tuple(r) for r in L.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **kw).collect()), key=lambda r: str(r[:4]))
    assert got == brute(rows)


def test_small(spark):
    rows = [(i, f"the cat {i % 5} sat on THE mat. the end {i}") for i in range(60)] + [(100, None), (101, ""), (102, " \t"), (None, "the dog"), (7, "the cat"), (7, "the cat"), (200, "w " * 30_000), (201, "é" * 9000)]
    check(spark, rows)


def test_small_batches_and_many_shards(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(i % 50))) for i in range(150)]
    check(spark, rows, shard_tokens=20)
    monkeypatch.setattr(L, "HOT", 0.05)
    check(spark, rows, shard_tokens=20)


def test_table_and_held_out(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in d.collect()])


def test_normalised():
    """The smoothed distribution over the vocabulary and one unknown word sums to 1, and by a few hundredths when quantised."""
    p, uni, _, _ = model([words(t) for t in ("a b a c", "a b b c a", "c a b", "b")])
    for context in (["<s>"], ["<s>", "a"], ["a", "b"], ["b", "b"], ["?", "c"], ["?", "?"], ["c", "c"]):
        assert sum(p(w, context, float) for w in [*(g[0] for g in uni), "?"]) == pytest.approx(1)
        assert sum(p(w, context) for w in [*(g[0] for g in uni), "?"]) == pytest.approx(1, abs=0.05)


def test_empty(spark):
    assert L.op9_elias_fano_lm(spark.createDataFrame([], "doc_id long, text string")).count() == 0
