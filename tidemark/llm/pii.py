"""PII: fixed patterns, and an information-theoretic sanitiser over them.

The patterns' matches are the protected entities. A term is as telling of an entity as its pointwise mutual information with it, over the
whole corpus: PMI(e; t) = log2(N n(e,t) / (n(e) n(t))), against the entity's own information IC(e) = log2(N / n(e)). N counts documents,
n(e,t) documents where the term stands near the entity, n(t) all documents with the term. Terms whose PMI / IC passes GENERALISE are
generalised, past REMOVE removed, wherever they stand. A term counts only after CONTEXTS different surroundings, so that copies of one
text are no evidence.

Null and empty texts have no spans. Positions count code points. Rows with one id and one text count once in n(e) and n(e,t). Repeated rows
give repeated results; extra columns pass through ``sanitise``.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm import text as W
from tidemark.llm.shared import own, written

KINDS = ("email", "ip", "card", "phone", "generalise", "remove")
#: The base patterns' parts.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
#: Words of lower-cased text.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

#: Words on each side of an entity that count as near, and characters of a text that are looked through for them at a time.
NEAR, REACH = 8, 300
#: Terms have so many characters at least and no digits.
LEAST = 4
CONTEXTS = 3
GENERALISE, REMOVE = 0.9, 0.98
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """From each @: the longest run before it, back to the last match, and the domain after it. So a text without matches takes linear time."""
    last, at = 0, t.find("@")
    while at >= 0:
        end = at + 1
        if m := DOMAIN.match(t, at + 1):
            start = at
            while start > last and t[start - 1] in LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                last = end = m.end()
        at = t.find("@", end)


def luhn(digits: str) -> bool:
    doubled = (2 * int(c) for c in digits[-2::-2])
    return (sum(int(c) for c in digits[::-2]) + sum(x - 9 * (x > 9) for x in doubled)) % 10 == 0


def base_spans(t: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all matches, sorted."""
    out = [(a, 0, b) for a, b in _emails(t)]
    if DIGIT.search(t):
        # no limit on the digits of int(): leading zeros are stripped, longer parts are over 255
        out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(len(x) <= 3 and int(x) <= 255 for x in ((p.lstrip("0") or "0") for p in m[0].split(".")))]
        for m in CARD.finditer(t):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def written_out(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _hash(words: list[str]) -> np.ndarray:
    """The words' hashes as ``text.words`` has them; none is empty."""
    return W.words(*W.buffers(pa.array(words, pa.large_string())), W.PUNCT)[0]


def _near(t: str, a: int, b: int) -> list[str]:
    """The NEAR words before a span and after it, however far they are: the stretches looked through double until they hold them."""
    reach = REACH
    while True:
        at = max(0, a - reach)
        before = [m[0] for m in WORD.finditer(t[at:a].translate(LOWER)) if m.start() > 0 or not at]
        if not at or len(before) >= NEAR:
            break
        reach *= 2
    reach = REACH
    while True:
        end = b + reach
        after = [m[0] for m in WORD.finditer(t[b:end].translate(LOWER)) if m.end() < reach or end >= len(t)]
        if end >= len(t) or len(after) >= NEAR:
            break
        reach *= 2
    return before[-NEAR:] + after[:NEAR]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: list[list[int]] = [[], [], [], []]
        texts, shas, contexts = [], [], []
        for t in b.column("text").to_pylist():
            t = t or ""
            spans = base_spans(t)
            for k in range(4):
                counts[k].append(sum(s[1] == k for s in spans))
            texts.append([{"start": a, "rank": k, "end": z} for a, k, z in spans])
            shas.append(hashlib.sha256(written_out(spans).encode()).hexdigest())
            own = []
            for a, k, z in spans:
                words = _near(t, a, z)
                terms = sorted({w for w in words if len(w) >= LEAST and not DIGIT.search(w)})
                if terms:
                    entity = hashlib.blake2b(f"{k}:{re.sub('[ ().-]', '', t[a:z]) if k > 1 else t[a:z].lower()}".encode(), digest_size=8).digest()
                    around = hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest()
                    e, c = (int.from_bytes(x, "little", signed=True) for x in (entity, around))
                    own += [{"e": e, "t": int(h), "c": c} for h in W.signed(_hash(terms))]
            contexts.append(own)
        yield pa.RecordBatch.from_arrays(
            [b.column("_key"), b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(shas, pa.string()), pa.array(texts, pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))), pa.array(contexts, pa.list_(pa.struct([("e", pa.int64()), ("t", pa.int64()), ("c", pa.int64())])))],
            names=["_key", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "contexts"],
        )


FOUND = "_key long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:int,rank:int,end:int>>, contexts array<struct<e:long,t:long,c:long>>"


def _frequencies(batches: Iterator[pa.RecordBatch], sieve: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in W.parts(batch):
            h, _, _, rows = W.words(*W.buffers(b.column("text")), W.PUNCT)
            at = np.flatnonzero(bloom.passes(sieve, h))
            row = np.searchsorted(rows, at, "right")
            # each term once a document
            order = np.lexsort((row, h[at]))
            new = np.ones(len(order), bool)
            new[1:] = (h[at][order[1:]] != h[at][order[:-1]]) | (row[order[1:]] != row[order[:-1]])
            terms, n = np.unique(h[at][order[new]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(terms)), pa.array(n)], names=["t", "n"])


def _places(batches: Iterator[pa.RecordBatch], sieve: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in W.parts(batch):
            data, offsets = W.buffers(b.column("text"))
            h, first, length, rows = W.words(data, offsets, W.PUNCT)
            at = np.flatnonzero(bloom.passes(sieve, h))
            if not len(at):
                continue
            row = np.searchsorted(rows, at, "right") - 1
            start = W.code_points(data, offsets, first[at], row)
            end = W.code_points(data, offsets, first[at] + length[at], row)
            yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(row)), pa.array(W.signed(h[at])), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["_key", "t", "start", "end"])


def telling(found: DataFrame, docs: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE, contexts: int = CONTEXTS) -> DataFrame:
    """(t, rank): terms that disclose some entity past a threshold, and what becomes of them."""
    near = found.select("_key", F.explode("contexts").alias("x")).select("_key", "x.e", "x.t", "x.c").distinct()
    pairs = near.groupBy("e", "t", "_key").agg(F.min("c").alias("c"), F.max("c").alias("c2"))
    pairs = pairs.groupBy("e", "t").agg(F.count("*").alias("n_et"), F.approx_count_distinct("c").alias("some"), F.min("c").alias("lo"), F.max("c2").alias("hi"))
    pairs = written(pairs.where("lo < hi"), "op1-pairs")
    around = near.join(pairs.select("e", "t"), ["e", "t"], "left_semi").select("e", "t", "c").distinct().groupBy("e", "t").agg(F.count("*").alias("n_c"))
    pairs = written(pairs.join(around.where(F.col("n_c") >= contexts), ["e", "t"]).select("e", "t", "n_et"), "op1-supported")
    entities = near.select("e", "_key").distinct().groupBy("e").agg(F.count("*").alias("n_e"))
    sieve = bloom.build(pairs.select("t").distinct(), "t")
    often = docs.select("text").mapInArrow(lambda it: _frequencies(it, sieve), "t long, n long").groupBy("t").agg(F.sum("n").alias("n_t"))
    n = float(found.count())
    scored = pairs.join(entities, "e").join(often, "t")
    own = F.log2(F.lit(n) / F.col("n_e"))
    pmi = F.log2(F.lit(n) * F.col("n_et") / (F.col("n_e") * F.col("n_t")))
    ratio = F.when(own > 0, pmi / own)
    return scored.groupBy("t").agg(F.max(ratio).alias("r")).where(F.col("r") >= generalise).select("t", F.when(F.col("r") >= remove, KINDS.index("remove")).otherwise(KINDS.index("generalise")).alias("rank"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def extra_spans(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(_key, extra): the places of telling terms, one row for each document that has any; docs has _key and text."""
    terms = written(terms, "op1-terms")
    sieve = bloom.build(terms, "t")
    places = docs.select("_key", "text").mapInArrow(lambda it: _places(it, sieve), "_key long, t long, start int, end int").join(terms, "t")
    return places.groupBy("_key").agg(F.array_sort(F.collect_set(F.struct("start", "rank", "end"))).alias("extra"))


def scan(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base results by row, extra spans by _key)."""
    own = keyed(docs.select("doc_id", "text"))
    found = written(own.mapInArrow(_found, FOUND), "op1-base")
    return found, written(extra_spans(own, telling(found, docs)), "op1-extra")


def op1_pmi_sanitiser(docs: DataFrame) -> DataFrame:
    found, extra = scan(docs)
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    clear = F.filter(F.coalesce("extra", none), lambda e: ~F.exists("base", lambda b: (b["start"] < e["end"]) & (e["start"] < b["end"])))
    kinds = F.array(*(F.lit(k) for k in KINDS))
    both = F.array_sort(F.concat("base", clear))
    text = F.array_join(F.transform(both, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.join(extra, "_key", "left").select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", text.alias("spans"))


def replaced(t: str, extra: list[tuple[int, int, int]]) -> str:
    """The text with each span's mark in its place; overlapping base spans are merged under the first one's mark, terms inside them go with them."""
    base = base_spans(t)
    spans = base + [e for e in extra if not any(a < e[2] and e[0] < z for a, _, z in base)]
    out, at = [], 0
    for a, k, z in sorted(spans):
        if a >= at:
            out += [t[at:a], MARKS[KINDS[k]]]
        at = max(at, z)
    return "".join([*out, t[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """The documents with their texts' personal data and telling terms replaced; null texts stay null."""
    _, extra = scan(docs)
    o, names, schema = own(docs), docs.columns, docs.schema

    def run(batches):
        for b in batches:
            texts = [t if t is None else replaced(t, [(s["start"], s["rank"], s["end"]) for s in e or ()]) for t, e in zip(b.column("text").to_pylist(), b.column(f"{o}extra").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names], names=names)

    keyed_docs = docs.withColumn(f"{o}key", F.xxhash64("doc_id", "text"))
    return keyed_docs.join(extra.select(F.col("_key").alias(f"{o}key"), F.col("extra").alias(f"{o}extra")), f"{o}key", "left").drop(f"{o}key").mapInArrow(run, schema)
