import hashlib
import re
from collections import defaultdict
from math import log2

from tidemark.llm import pii as P


def brute_base(t):
    out = [(m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], ["email", "ip", "card", "phone"].index(s[1])))


TEXTS = [
    None, "", "a@b.c@d.e x@y @z.w a.b@c", "1.2.3.4.5.6.7.8 999.1.1.1 010.0.0.255 1.2.3", "4111 1111 1111 1111 and 4111-1111-1111-1112 0 0", "+1 (555) 123-4567. +12 3 +44 20 7946 0958 ext",
    "é @ ü me@ex-ample.co.uk, 12345678901234 + 10.0.0.1:80", "x" * 50_000 + "@" * 2000, "1" * 30_000 + ".1.1.1", "+1" + " 2" * 3000, "a@" * 5000 + "b.c", "mail..x+y%z@-.- 00000000000000 \U0001f600 a_b@c.d_e",
]


def test_base(spark):
    rows = list(enumerate(TEXTS))
    got = P.op1_pmi_sanitiser(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    for (i, t), r in zip(rows, got, strict=True):
        base = brute_base(t or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in P.KINDS[:4]], i
        text = ",".join(f"{k}:{a}:{b}" for a, k, b in base)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.spans == text, i


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def test_near_words_have_no_reach():
    far = " ".join("w" * 90 + c for c in "abcdefghijkl")
    t = f"{far} x@y.z {far}"
    a = t.index("x@")
    assert P._near(t, a, a + 5) == far.split()[-8:] + far.split()[:8]


def brute(rows):
    """Spans by the definition, over dictionaries."""
    near, often, n = defaultdict(set), defaultdict(int), len(rows)
    for i, t in rows:
        t = t or ""
        for w in {*re.findall(WORD, lower(t))}:
            often[w] += 1
        for a, k, b in brute_base(t):
            value = t[a:b].lower() if k in ("email", "ip") else re.sub("[ ().-]", "", t[a:b])
            words = re.findall(WORD, lower(t[:a]))[-8:] + re.findall(WORD, lower(t[b:]))[:8]
            for w in {w for w in words if len(w) >= P.LEAST and not re.search("[0-9]", w)}:
                near[(k, value), w].add((i, " ".join(words)))
    docs_of = defaultdict(set)
    for (e, _), s in near.items():
        docs_of[e] |= {i for i, _ in s}
    best = defaultdict(float)
    for (e, w), s in near.items():
        if len({c for _, c in s}) >= P.CONTEXTS:
            own = log2(n / len(docs_of[e]))
            if own > 0:
                best[w] = max(best[w], log2(n * len({i for i, _ in s}) / (len(docs_of[e]) * often[w])) / own)
    mark = {w: "remove" if r >= P.REMOVE else "generalise" for w, r in best.items() if r >= P.GENERALISE}
    out = {}
    for i, t in rows:
        base = brute_base(t or "")
        extra = [(m.start(), mark[m[0]], m.end()) for m in re.finditer(WORD, lower(t or "")) if m[0] in mark]
        extra = [e for e in extra if not any(a < e[2] and e[0] < b for a, _, b in base)]
        out[i] = ",".join(f"{k}:{a}:{b}" for a, k, b in sorted(base + extra, key=lambda s: (s[0], P.KINDS.index(s[1]))))
    return out


ROWS = [(i, f"note{'abcdefgh'[i % 8] * 3} Büro Quentin writes {'a b c d e f'.split()[i % 6]} to boss@firm.example about plans") for i in range(6)]
ROWS += [(10 + i, f"plain words about plans and nothing else {i}") for i in range(30)] + [(50, "Quentin again, büro"), (51, None), (52, "copy secretword a@b.cd"), (53, "copy secretword a@b.cd"), (54, "copy secretword a@b.cd")]


def test_method(spark):
    got = {r.doc_id: r.spans for r in P.op1_pmi_sanitiser(spark.createDataFrame(ROWS, "doc_id long, text string")).collect()}
    want = brute(ROWS)
    assert got == want
    assert "remove" in want[0] or "generalise" in want[0]
    assert want[10] == "" and "52" not in want[52].split("email")[0] and want[52].startswith("email")


def test_sanitise(spark):
    d = spark.createDataFrame([(*r, "k") for r in ROWS], "doc_id long, text string, extra string")
    got = {r.doc_id: r.text for r in P.sanitise(d).collect()}
    assert all(r.extra == "k" for r in P.sanitise(d.withColumn("_key", d.extra)).select("extra", "_key").collect())
    assert "boss@" not in got[0] and "[EMAIL]" in got[0] and got[51] is None and got[12] == dict(ROWS)[12] and "secretword" in got[52]
    assert P.op1_pmi_sanitiser(d.limit(0)).count() == 0


def test_table(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in d.collect()]
    assert {r.doc_id: r.spans for r in P.op1_pmi_sanitiser(d).collect()} == brute(rows)


def test_linear():
    """Long runs that nearly match take no quadratic time."""
    import time

    t = time.time()
    for x in ("a" * 400_000, "@" * 400_000, "1." * 200_000, "+1" * 200_000, "a@b" * 100_000):
        P.base_spans(x)
    assert time.time() - t < 20
