import random
import re

import numpy as np

from tidemark.llm import bloom, near_dup
from tidemark.llm.components import components


def sets(t, k=2):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return {tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def brute(rows, k=2):
    s = [(i, sets(t, k)) for i, t in rows]
    up = {i: i for i, _ in s}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for i, x in s:
        for g in x:
            index.setdefault(g, []).append((i, x))
    for i, x in s:
        near = {}
        for g in x:
            for j, y in index[g]:
                if j < i:
                    near[j] = y
        for j, y in near.items():
            if 100 * len(x & y) >= 80 * len(x | y):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(x), root(i), root(i) == i) for i, x in s}


def made(n_groups, size, edits, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    rows = []
    for _ in range(n_groups):
        base = [word() for _ in range(r.randint(30, 200))]
        for _ in range(size):
            copy = list(base)
            for _ in range(int(len(base) * r.random() * edits)):
                copy[r.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy)))
    return rows


def run(spark, rows):
    got = near_dup.op5_chosen_path(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got}


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t"), (4, "One"), (5, "one"), (6, "one two"), (7, "ONE two"), (8, "a b c d e f g h i j"), (9, "a b c d e f g h i z"), (10, "a b c d e f g h i j k"), (11, "x" * 100_000), (12, "w v " * 50_000), (13, "w v " * 30_000)]
    assert run(spark, rows) == brute(rows)


def test_many_groups(spark):
    rows = made(60, 8, 0.25, 1)
    assert run(spark, rows) == brute(rows)


def test_large_group(spark):
    rows = made(1, 700, 0.3, 2) + [(10_000 + i, t) for i, t in made(20, 2, 0.1, 3)]
    assert run(spark, rows) == brute(rows)


def test_null_ids_repeated_rows_and_empty(spark):
    rows = [(None, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, "a b c d e f")]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, label long")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.op5_chosen_path(d).collect()), key=str)
    assert got == [(2, 2, True), (2, 2, True), (3, 2, False), (None, None, True)]
    assert sorted(str(r.doc_id) for r in near_dup.keep_first(d).collect()) == ["2", "2", "None"]
    assert near_dup.op5_chosen_path(d.limit(0)).count() == 0


def test_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert run(spark, rows) == brute(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 120), (110, 120), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 100: 100, 110: 100, 120: 100}


def test_bloom(spark):
    keys = np.random.default_rng(1).integers(-(1 << 63), (1 << 63) - 1, 4000)
    f = bloom.build(spark.createDataFrame([(int(x),) for x in keys[:2000]], "k long"), "k")
    said = bloom.passes(f, keys)
    assert said[:2000].all() and said[2000:].mean() < 0.01


def test_large_leaves_of_loose_documents(spark, monkeypatch):
    # small blocks and no tiny leaves: everything that the pivots leave open goes through block pairs, and the other way round
    rows = made(3, 120, 0.45, 4) + [(10_000 + i, t) for i, t in made(40, 3, 0.3, 5)]
    want = brute(rows)
    for tiny, block, tokens in ((0, 16, 1 << 18), (2, 256, 2000), (1 << 30, 256, 1 << 18)):
        monkeypatch.setattr(near_dup, "TINY", tiny)
        monkeypatch.setattr(near_dup, "BLOCK", block)
        monkeypatch.setattr(near_dup, "BLOCK_TOKENS", tokens)
        assert run(spark, rows) == want


def test_spanning_forest():
    r = np.random.default_rng(3)
    for n, m in ((1, 0), (2, 1), (50, 20), (50, 60), (300, 5000)):
        a, b = r.integers(0, n, m), r.integers(0, n, m)
        keep = near_dup.spanning_forest(a, b)
        up = {}

        def root(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for i in keep:
            x, y = root(a[i]), root(b[i])
            assert x != y
            up[x] = y
        assert all(root(x) == root(y) for x, y in zip(a, b, strict=True))
