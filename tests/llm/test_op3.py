import random
import re

from tidemark.llm import sentence_spans as S


def cut(text):
    """Sentences by the rules, without long ones."""
    words = [(m.start(), m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
    out, now = [], []
    for i, (at, w) in enumerate(words):
        now.append((at, w))
        after = text[at + len(w) : words[i + 1][0]] if i + 1 < len(words) else "\n"
        if w[-1] in ".!?" or "\n" in after:
            out.append(now)
            now = []
    assert all(len(s) <= S.LONG for s in out)
    return out


def brute(rows, least=12):
    runs, all_ = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        s = all_[d] = cut(t)
        for i in range(max(len(s) - S.SPAN + 1, 1) if s else 0):
            words = tuple(re.sub("[A-Z]", lambda m: m[0].lower(), w) for x in s[i : i + S.SPAN] for _, w in x)
            if len(words) >= least:
                runs.setdefault(words, []).append((d, i))
    gone = {}
    for places in runs.values():
        for d, i in sorted(places)[1:]:
            gone.setdefault(d, set()).update(range(i, min(i + S.SPAN, len(all_[d]))))
    out = {}
    for d, t in rows:
        s = all_[d]
        edge = [0, *(x[0][0] for x in s[1:]), len(t or "")]
        out[d] = (len(s), len(gone.get(d, ())), t if d not in gone else "".join(t[edge[i] : edge[i + 1]] for i in range(len(s)) if i not in gone[d]))
    return out


def run(spark, rows, least=S.LEAST):
    return {r.doc_id: (r.n_sentences, r.n_removed, r.text) for r in S.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least=least).collect()}


def test_brute(spark):
    r = random.Random(5)
    line = lambda: " ".join(r.choice(["Über", "ab", "cd", "efg", "Hi", "x"]) + r.choice("abcdefgh") for _ in range(r.randint(1, 12))) + r.choice([".", "!", "?", "\n", " .\n"])
    pool = [line() for _ in range(60)]
    rows = [(i, "  " * (i % 2) + " ".join(line() if r.random() < 0.6 else " ".join(pool[j : j + 5]) for j in (r.randrange(60) for _ in range(r.randint(0, 15))))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, rows[3][1]), (203, rows[3][1].upper())]
    assert run(spark, rows, 12) == brute(rows)


def test_passage_without_punctuation(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(120))
    rows = [(i, f"{' '.join(word() for _ in range(60))} {passage} {' '.join(word() for _ in range(60))}") for i in range(3)]
    got = run(spark, rows)
    assert got[0][1] == 0 and got[0][2] == rows[0][1]
    for i in (1, 2):
        assert sum(w in got[i][2] for w in passage.split()) < 60


def test_edge_cases(spark):
    a = "One two three four five. Six seven eight nine ten. Eleven twelve thirteen."
    rows = [(5, a), (None, a), (7, f"{a} {a}"), (7, "other"), (8, "x" * 200_000), (9, "y. " * 30_000), (4, "Short. Short. Short.")]
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_removed long")
    got = [(r.doc_id, r.n_removed) for r in S.dedup(d, least=12).collect()]
    assert (5, 0) in got and (None, 3) in got and (7, 6) in got and (7, 0) in got and (8, 0) in got and (4, 0) in got
    assert S.op3_sentence_spans(d.limit(0)).count() == 0


def test_passages_of_few_sentences(spark):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    words = lambda n: [word() for _ in range(n)]
    rows, passages = [], []
    for n in range(51, 61):
        one, two = words(n), words(n)
        one[-1] += "."
        two[n // 2] += "."
        two[-1] += "."
        inner = words(n)
        for passage, ends in ((one, "."), (two, "."), (inner, "")):
            passages.append(passage)
            rows += [(len(rows) + j, f"{' '.join(words(20))}{ends} {' '.join(passage)} {' '.join(words(20))}.") for j in range(2)]
    got = run(spark, rows)
    for i, passage in enumerate(passages):
        (a, old), (b, new) = rows[2 * i : 2 * i + 2]
        assert got[a][1:] == (0, old)
        left = got[b][2].split()
        stay = [w in left for w in passage]
        if i % 3 < 2:
            assert not any(stay), (i, stay)
        assert not any(stay[S.WINDOW + S.FEW : -S.WINDOW - S.FEW]) and got[b][1] > 0
        assert [w for w in new.split() if w not in passage] == [w for w in left if w not in passage]


def test_one_repeated_word(spark):
    rows = [(1, "no " * 1000), (2, "Start of it. " + "no " * 1000 + "and its end.")]
    got = run(spark, rows)
    assert S.GRAM <= got[1][2].count("no") < 60 and got[2][2].startswith("Start of it. ") and got[2][2].endswith("its end.")
    assert got[2][2].count("no") <= 2 * S.WINDOW


def test_documents_without_id(spark):
    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    passage, other = words(60), f"{words(30)}. {words(30)}."
    rows = [(None, f"{words(20)}. {passage}. {words(20)}.") for _ in range(4)] + [(None, other)] * 3 + [(None, None), (None, "")]
    d = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, n long").repartition(3)
    got = {x.n: x for x in S.dedup(d).collect()}
    assert len(got) == len(rows)
    for group, part in ((range(4), passage), (range(4, 7), other)):
        assert sum(part in got[n].text for n in group) == 1
        assert sum(got[n].n_removed > 0 for n in group) == len(group) - 1
    assert got[7].text is None and got[8].text == ""


def test_short_stock_runs_stay(spark):
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))
    stock = "The and attion. Eriner thanea of it. Licensed under the Apache License, Version 2.0."
    rows = [(i, f"{words(40)}. {stock} {words(40)}.") for i in range(5)]
    assert all(v[1] == 0 and v[2] == rows[i][1] for i, v in run(spark, rows).items())
