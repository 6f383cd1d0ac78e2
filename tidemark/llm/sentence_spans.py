"""Substring dedup by sliding sentence spans.

Every run of SPAN consecutive sentences is hashed and joined over the whole corpus; words that a non-first repeat covers are removed.
The first occurrence is the one in the document of the smallest id, there at the earliest place. A sentence ends with ``.``, ``!`` or
``?``, or at a line's end; one of more than LONG words is also cut after words that their own hash picks. Case and white space don't
count. Runs of fewer than LEAST words are left alone, so that stock phrases and license lines stay. A text of fewer than SPAN sentences is one run.

Repeats that hold fewer whole sentences are found by runs of one to SPAN uncut sentences with at least GRAM words, and by runs of exactly
GRAM words wherever they begin, of which the smallest hash in each WINDOW of starts is kept. So every repeat of at least GRAM + WINDOW - 1 words is
found, whatever surrounds it, and at most WINDOW - 1 words stay at each of its ends; where fewer than FEW words of a sentence would go
and others stay, these stay too. n_removed counts the sentences that lost words.

Null and empty texts have no sentences and come back as they are. Documents without id come after all others, in the order
of their texts' hashes; of equal texts among them one is the first. Two rows with the same
smallest id both count as first. Extra columns pass through; ones named n_sentences or n_removed are replaced.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import text as W
from tidemark.llm.shared import own

SPAN = 3
LEAST = 32
LONG = 40
GRAM = 32
WINDOW = 8
FEW = 3

_ENDS = np.zeros(256, bool)
_ENDS[[ord(c) for c in ".!?"]] = True
_P = 0x9E3779B97F4A7C15
_Q = pow(_P, -1, 1 << 64)


def _powers(p: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, np.uint64(p))]), dtype=np.uint64)


def sentences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, first byte of each word, the words that start a sentence, each row's first sentence, which sentences don't start at a cut)."""
    h, first, length, rows = W.words(data, offsets, W.WHITE)
    n = len(h)
    if not n:
        return h, first, np.zeros(0, np.int64), np.zeros(len(offsets), np.int64), np.zeros(0, bool)
    last = first + length - 1
    lines = np.concatenate([[0], np.cumsum(data == 10)])
    end = _ENDS[data[last]]
    end[:-1] |= lines[first[1:]] > lines[last[:-1]]
    end[rows[1:][rows[1:] > rows[:-1]] - 1] = True

    def starts(end):
        return np.concatenate([[0], np.flatnonzero(end[:-1]) + 1])

    at = starts(end)
    size = np.diff(np.append(at, n))
    end |= np.repeat(size > LONG, size) & (h & np.uint64(15) == 0)
    uncut, at = at, starts(end)
    return h, first, at, np.searchsorted(at, rows), np.isin(at, uncut, assume_unique=True)


def _sliding(x: np.ndarray, size: int, least: bool) -> np.ndarray:
    """The smallest of the ``size`` values from each place on, or the largest of those up to it; size is a power of two."""
    x, step = x.copy(), 1
    while step < size:
        if least:
            x[:-step] = np.minimum(x[:-step], x[step:])
        else:
            x[step:] = np.maximum(x[step:], x[:-step])
        step *= 2
    return x


def _grams(value: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The places kept of all GRAM-word runs: those with the smallest hash of some WINDOW of starts in a row. base: each row's first word."""
    starts = np.maximum(np.diff(base) - GRAM + 1, 0)
    place = np.arange(len(value))
    row = np.searchsorted(base, place, "right") - 1
    valid = place - base[row] < starts[row]
    lowest = _sliding(np.where(valid, value, np.uint64((1 << 64) - 1)), WINDOW, True)
    whole = valid & (place - base[row] <= np.maximum(starts[row] - WINDOW, 0))
    kept = valid & (_sliding(np.where(whole, lowest, np.uint64(0)), WINDOW, False) == value)
    # all runs of one repeated word are alike: every WINDOW-th will do
    alike = np.zeros(len(value), bool)
    alike[1:] = value[1:] == value[:-1]
    since = place - np.maximum.accumulate(np.where(alike, 0, place))
    return np.flatnonzero(kept & (~alike | (since % WINDOW == 0)))


def spans(data: np.ndarray, offsets: np.ndarray, span: int = SPAN, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word in the row, kind, hash) of each run. Kinds: 0 is GRAM words, others are numbers of sentences."""
    h, _, at, rows, uncut = sentences(data, offsets)
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), h
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * _powers(_P, n - 1), dtype=np.uint64)])
    back = _powers(_Q, n)
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    count = np.diff(rows)[owner]
    place = np.arange(len(at)) - rows[owner]
    edge = np.append(at, n)
    base = edge[rows]
    begin = np.flatnonzero((place + span <= count) | ((place == 0) & (count < span)))
    stop = np.minimum(begin + span, rows[owner[begin] + 1])
    runs = [(begin, stop, edge[stop] - at[begin] >= least)]
    whole = np.append(np.flatnonzero(uncut), len(at))
    for k in range(1, min(span, len(whole) - 1) + 1):
        begin, stop = whole[:-k], whole[k:]
        runs.append((begin, stop, (stop <= rows[owner[begin] + 1]) & (edge[stop] - at[begin] >= GRAM) & (stop - begin != span) & (stop - begin <= 63)))
    out = [(owner[i[ok]], at[i[ok]], edge[j[ok]], (j - i)[ok]) for i, j, ok in runs]
    if n >= GRAM:
        value = W.mix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1] + np.uint64(GRAM))
        first = _grams(value, base)
        out.append((np.searchsorted(base, first, "right") - 1, first, first + GRAM, np.zeros(len(first), np.int64)))
    row, first, stop, kind = (np.concatenate(c) for c in zip(*out, strict=True))
    value = W.mix((sums[stop] - sums[first]) * back[first] + (stop - first).astype(np.uint64))
    return row, first - base[row], kind, value


def _emit(batches: Iterator[pa.RecordBatch], span: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in W.parts(batch):
            row, place, kind, value = spans(*W.buffers(b.column("text")), span, least)
            # later runs of a document that repeat one of its own; runs of words must not overlap the first
            order = np.lexsort((place, value, row))
            r, v, p = row[order], value[order], place[order]
            new = np.ones(len(row), bool)
            new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
            again = np.zeros(len(row), bool)
            if len(row):
                since = p - p[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
                again[order] = since >= np.where(kind[order] == 0, GRAM, 1)
            ids, none = np.asarray(b.column("doc")), b.column("none").to_numpy(zero_copy_only=False)
            mark = np.asarray(b.column("mark"))
            # and those that repeat a run of an earlier document in the batch: they go whatever the corpus holds, so a common run doesn't gather in one task
            doc, none = ids[row], none[row]
            order = np.lexsort((doc, none, value))
            v, d, o = value[order], doc[order], none[order]
            new = np.ones(len(row), bool)
            new[1:] = v[1:] != v[:-1]
            if len(row):
                first = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
                again[order] |= (o > o[first]) | ((o == o[first]) & (d > d[first]))
            value[again] = W.mix(doc[again].astype(np.uint64) * np.uint64(_P) + place[again].astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(W.signed(value)), pa.array(doc), pa.array((mark[row].astype(np.int64) >> 4 << 36) | place << 6 | kind), pa.array(again), pa.array(none)], names=["hash", "doc", "place", "again", "none"])


def _gone(p: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Which of a row's n words go, by its places; at: the words that start a sentence."""
    first, kind = p >> 6, p & 63
    edge = np.append(at, n)
    stop = np.where(kind == 0, first + GRAM, edge[np.minimum(np.searchsorted(at, first) + kind, len(at))])
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, first, 1)
    np.add.at(depth, stop, -1)
    drop = np.cumsum(depth[:n]) > 0
    lost, words = np.add.reduceat(drop.astype(np.int64), at), np.diff(edge)
    return drop & ~np.repeat((lost < FEW) & (lost < words), words)


def _cut(batches: Iterator[pa.RecordBatch], names: list[str], o: str, span: int, least: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in W.parts(batch):
            data, offsets = W.buffers(b.column("text"))
            _, first, at, rows, _ = sentences(data, offsets)
            base = np.append(at, len(first))[rows]
            texts, total, gone = [], np.diff(rows), []
            marks, places, copies = (b.column(f"{o}{c}").to_pylist() for c in ("mark", "places", "copy"))
            for i, old in enumerate(b.column("text")):
                p = np.array(places[i] or [], np.int64)
                p = p[p >> 36 == marks[i] >> 4] & (1 << 36) - 1
                if copies[i]:
                    _, place, kind, _ = spans(*W.buffers(b.column("text").slice(i, 1)), span, least)
                    p = place << 6 | kind
                if not len(p):
                    gone.append(0)
                    texts.append(old.as_py())
                    continue
                a, z = base[i], base[i + 1]
                begins = at[rows[i] : rows[i + 1]] - a
                drop = _gone(p, begins, z - a)
                gone.append(int(np.logical_or.reduceat(drop, begins).sum()))
                edge = np.append(first[a:z], offsets[i + 1])
                edge[0] = offsets[i]
                turn = np.flatnonzero(np.diff(np.concatenate([[True], drop, [True]]).astype(np.int8)))
                texts.append(b"".join(data[edge[j] : edge[k]].tobytes() for j, k in turn.reshape(-1, 2)).decode())
            out = {n: b.column(n) for n in names} | {"text": pa.array(texts, pa.string()), "n_sentences": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))


def _numbered(marked: DataFrame, o: str) -> DataFrame:
    """Adds <o>copy: true for all but one of the documents without id that have the same text."""
    alone = F.col(f"{o}none") & F.coalesce(F.col("text") != "", F.lit(False))
    number = F.row_number().over(Window.partitionBy(f"{o}doc").orderBy("text"))
    return marked.where(~alone).withColumn(f"{o}copy", F.lit(False)).unionByName(marked.where(alone).withColumn(f"{o}copy", number > 1))


def dedup(docs: DataFrame, span: int = SPAN, least: int = LEAST) -> DataFrame:
    """The documents with their texts cut, and n_sentences and n_removed."""
    o = own(docs)
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed")]
    marked = docs.select(*names, F.hash("text").alias(f"{o}mark"), F.col("doc_id").isNull().alias(f"{o}none"), F.coalesce("doc_id", F.xxhash64("text")).alias(f"{o}doc"))
    # one shuffle serves the counts and the join: both read all columns, so that Spark reuses it; runs known to go are dealt by their places
    found = marked.select("text", *(F.col(f"{o}{c}").alias(c) for c in ("mark", "doc", "none"))).mapInArrow(lambda it: _emit(it, span, least), "hash long, doc long, place long, again boolean, none boolean").where("hash is not null and doc is not null and none is not null").repartition("hash")
    here = lambda none: F.when(~F.col("again") & (F.col("none") == none), F.col("doc"))
    repeated = found.groupBy("hash").agg(F.min(here(False)).alias("first"), F.max(here(False)).alias("last"), F.min(here(True)).alias("bare"), F.max(here(True)).alias("bare_last"), F.max("place").alias("place"))
    repeated = repeated.where("(first < last or bare < bare_last or (first is not null and bare is not null)) and place is not null").select("hash", "first", "bare")
    gone = found.join(repeated, "hash", "left").where("again or if(none, first is not null or doc > bare, doc > first)")
    remove = gone.groupBy(F.col("none").alias(f"{o}none"), F.col("doc").alias(f"{o}doc")).agg(F.collect_list("place").alias(f"{o}places"))
    joined = _numbered(marked, o).join(remove, [f"{o}none", f"{o}doc"], "left").drop(f"{o}none", f"{o}doc")
    schema = docs.limit(0).select(names).withColumns({"n_sentences": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    return joined.mapInArrow(lambda it: _cut(it, names, o, span, least), schema)


def op3_sentence_spans(docs: DataFrame) -> DataFrame:
    return dedup(docs.select("doc_id", "text")).select("doc_id", "n_sentences", "n_removed", "text")
