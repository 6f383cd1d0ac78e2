import hashlib
import itertools
import random
import re

from tidemark.llm import decontam


def brute(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[k : k + n]), set()).update({str(i)} if i is not None else ())
    out = []
    for d, t in docs:
        w = words(t)
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := grams.get(tuple(w[k : k + n]))) is not None:
                    hit |= {*range(k, k + n)}
                    found |= g
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


ITEM = "One two three four five six seven eight nine ten eleven twelve"
DOCS = [(1, f"start {ITEM.upper()} end"), (2, None), (3, ""), (4, "only two, words"), (5, "x" * 50_000), (6, f"{ITEM} {ITEM}"), (6, f"{ITEM} {ITEM}"), (None, "zwölf Größe"), (7, "a a a a a a a a a a a a a a a")]
ITEMS = [(1, ITEM), (2, None), (3, ""), (4, "two words"), (5, "Größe"), (6, "a a a a a a a a a a a"), (7, ITEM), (10, "three FOUR five six seven eight nine ten eleven twelve thirteen"), (None, "zwölf")]


def test_small(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = sorted((tuple(r) for r in decontam.op6_suffix_decontam(docs, items).collect()), key=str)
    assert got == brute(DOCS, ITEMS)


def test_blocks_agree(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    whole = sorted(map(str, decontam.hits(docs, items).collect()))
    monkeypatch.setattr(decontam.blocks, "__defaults__", (decontam.WINDOW, 30))
    assert len([*decontam.blocks(items)]) > 2
    assert sorted(map(str, decontam.hits(docs, items).collect())) == whole
    kept = sorted(r.doc_id for r in decontam.remove(docs, items).collect())
    assert kept == [2, 3, 5]


def test_longest_match(spark):
    docs = spark.createDataFrame(DOCS[:1], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    assert [tuple(r) for r in decontam.matches(docs, items).drop("doc_row").collect()] == [(1, 1, "1", 0, 12)]


def test_longest_matches_by_brute_force(spark, monkeypatch):
    r = random.Random(4)
    text = lambda n: " ".join(r.choice("abc") for _ in range(n))
    docs, items = [(i, text(r.randint(0, 60))) for i in range(20)], [(i, text(r.randint(0, 40))) for i in range(12)]
    want = set()
    for d, x in docs:
        for i, y in items:
            x_, y_ = x.split(), y.split()
            for p, q in itertools.product(range(len(x_)), range(len(y_))):
                n = 0
                while p + n < len(x_) and q + n < len(y_) and x_[p + n] == y_[q + n]:
                    n += 1
                if n >= min(6, len(y_)) and (not p or not q or x_[p - 1] != y_[q - 1]):
                    want.add((d, p, str(i), q, n))
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = decontam.matches(*frames, 6).drop("doc_row").collect()
    assert {*map(tuple, got)} == want and len(got) == len(want)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.op6_suffix_decontam(docs, items).count() == 0
    some = spark.createDataFrame(DOCS, "doc_id long, text string")
    assert decontam.op6_suffix_decontam(some, items).where("contaminated").count() == 0


def test_table(spark, sf):
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = sorted((tuple(r) for r in decontam.op6_suffix_decontam(d, b).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()])
