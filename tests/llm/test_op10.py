import re
from collections import Counter, defaultdict

import pytest

from tidemark.llm import link_graph as L


def split(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def fits(host, path):
    found = [(len(h + p), h + p, v) for v, h, p in L.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(found)[1:] if found else (None, None)


def brute(rows):
    pages = [(i, *split(u), h or "") for i, u, h in rows]
    weight = Counter()
    for _, host, _, html in pages:
        for to in re.findall(r"""(?i)\bhref\s*=\s*["']?(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)""", html):
            to = re.sub("[A-Z]", lambda m: m[0].lower(), to)
            if host and to != host:
                weight[host, to] += 1
    up = set()
    for name in {p[1] for p in pages} | {b for _, b in weight}:
        labels = name.split(".")
        up |= {(".".join(labels[i:]), ".".join(labels[i + 1 :])) for i in range(len(labels) - 2)} if name else set()
    for a, b in up:
        weight[a, b] += 1
        weight[b, a] += 1
    scores = {}
    for side, want in (("trust", "allow"), ("distrust", "block")):
        edge = {(a, b) if side == "trust" else (b, a): w for (a, b), w in weight.items()}
        total = Counter()
        for (a, _), w in edge.items():
            total[a] += w
        seed = Counter(h for _, h, p, _ in pages if h and fits(h, p)[1] == want)
        state = dict(seed)
        for _ in range(L.ROUNDS):
            new = defaultdict(float, {h: s * (1 - L.DAMPING) for h, s in seed.items()})
            for (a, b), w in edge.items():
                if a in state:
                    new[b] += state[a] * w / total[a] * L.DAMPING
            state = new
        scores[side] = state
    out = []
    for i, h, p, _ in pages:
        r, v = fits(h, p)
        t, d = scores["trust"].get(h, 0), scores["distrust"].get(h, 0)
        out.append((i, h, p, r, v or ("block" if d > L.RATIO * t else "allow"), pytest.approx(t, abs=1e-5), pytest.approx(d, abs=1e-5)))
    return out


ROWS = [
    (1, "http://a.example.org/es/1?q", '<a href="http://bad.net/x"><A HREF=//C.example.com>'), (2, "https://bad.net/de/", None), (3, None, "<p>"), (4, "no scheme", ""), (5, "http://b.com/de/x", ""),
    (6, "http://spam.net/", '<a href="http://b.com/1"><a href="http://b.com/2">'), (7, "HTTP://WWW.Example.ORG/en/12#t", ""), (8, "http://org", ""), (9, "http://org/", ""), (10, "x://h?a/b", ""), (11, "http://x.com/fr/://y", ""), (11, "http://x.com/fr/://y", ""),
]


def test_small(spark):
    d = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    got = [tuple(r) for r in L.op10_link_graph(d).orderBy("page_id").collect()]
    assert got == brute(ROWS)
    assert dict((r[0], r[4]) for r in got)[6] == "block"  # it links to a blocked host


def test_table(spark, sf):
    d = spark.read.parquet(f"{sf}/pages.parquet")
    rows = [tuple(r) for r in d.select("page_id", "url", "html").orderBy("page_id").collect()]
    assert [tuple(r) for r in L.op10_link_graph(d).orderBy("page_id").collect()] == brute(rows)


def test_empty(spark):
    assert L.op10_link_graph(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
