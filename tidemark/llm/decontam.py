"""Benchmark decontamination by suffix arrays over the training texts.

Each task turns its documents, shard by shard, into one sequence of word codes, sorts the shard's suffixes and binary-searches every
benchmark suffix in them; what starts alike is followed to its end on both sides, which gives the longest verbatim matches and where they
lie. A shard holds a bounded number of words (one document at least), so memory doesn't grow with the input, and no text is shuffled. The
benchmark goes to the tasks in blocks of bounded size, one pass over the documents each; the driver holds one block at a time, and with
several each pass is written before the next block is fetched.

Null and empty texts have no words and no hits. Items without words match nothing; items with one id and several texts count as one
item. Items without id make hits and remove documents, but are no members of id lists or counts. Repeated documents are judged alike, each row by
itself. Extra columns pass through ``remove``.
"""

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as W
from tidemark.llm.shared import written

#: Consecutive words that count as a match; an item of fewer words must occur whole.
WINDOW = 10
#: Words in a shard's suffix array, and in a block of the benchmark.
SHARD_WORDS = 1 << 20
BLOCK_CHARS = 16 << 20
#: Pairs of a training and a benchmark position that are followed at once.
PAIRS = 4 << 20

MATCHES = "doc_id long, doc_row long, doc_start long, item_id string, item_start long, n_words long"
HITS = "doc_id long, n_words long, n_hit long, items array<string>"


class Suffixes:
    """A benchmark block: its words' codes, and its distinct windows sorted by code."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW) -> None:
        self.window = window
        self.ids = [i for i, _ in items]
        data, offsets = W.buffers(pa.array([t for _, t in items], pa.large_string()))
        hashes, _, _, rows = W.words(data, offsets, W.PUNCT)
        self.lexicon = np.unique(hashes)
        self.codes = np.searchsorted(self.lexicon, hashes).astype(np.int32)
        self.item = np.repeat(np.arange(len(items)), np.diff(rows))
        self.place = np.arange(len(hashes)) - rows[self.item] if len(hashes) else np.zeros(0, np.int64)
        self.left = rows[1:][self.item] - np.arange(len(hashes)) if len(hashes) else self.place
        #: For each window length: the windows as rows of codes, sorted; all suffixes in the order of the windows that they start with, and where each window's begin.
        self.windows: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        length = np.minimum(np.diff(rows), window)[self.item] if len(hashes) else self.place
        for n in np.unique(length):
            at = np.flatnonzero((length == n) & (self.left >= n))
            grams = self.codes[at[:, None] + np.arange(n)]
            distinct, which = np.unique(grams, axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            self.windows.append((int(n), distinct, at[order], np.append(0, np.cumsum(np.bincount(which.ravel())))))

    def codes_of(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of a training text's words; -1 for words that no item has, which no match contains."""
        if not len(self.lexicon):
            return np.full(len(hashes), -1, np.int32)
        at = np.searchsorted(self.lexicon, hashes)
        at[at == len(self.lexicon)] = 0
        return np.where(self.lexicon[at] == hashes, at, -1).astype(np.int32)


def suffix_array(codes: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at ``starts`` in order of their first ``depth`` codes, which are known to be non-negative: ranks are doubled until they cover the depth."""
    if not len(starts):
        return starts
    rank = np.full(len(codes) + 1, -1, np.int64)
    rank[:-1] = codes
    done = 1
    while done < depth:
        step = min(done, depth - done)
        # the first `done` codes, then those up to `done + step` (overlapping is harmless)
        key = (rank[:-1] + 1) << 32
        key[: len(codes) - step] |= rank[step:-1] + 1
        key[rank[:-1] < 0] = 0
        values, again = np.unique(key, return_inverse=True)
        rank[:-1] = np.where(key == 0, -1, again)
        done += step
    return starts[np.argsort(rank[starts], kind="stable")]


def _search(codes: np.ndarray, array: np.ndarray, grams: np.ndarray, upper: bool) -> np.ndarray:
    """Binary search of all grams at once: where each one's suffixes begin (or end) in the suffix array."""
    low, high = np.zeros(len(grams), np.int64), np.full(len(grams), len(array), np.int64)
    span = np.arange(grams.shape[1])
    while (open_ := low < high).any():
        mid = (low + high) // 2
        here = codes[array[np.minimum(mid, len(array) - 1)][:, None] + span]
        differ = here != grams
        first = differ.argmax(axis=1)
        rows = np.arange(len(grams))
        less = np.where(differ.any(axis=1), here[rows, first] < grams[rows, first], upper)
        low = np.where(open_ & less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)
    return low


def find(codes: np.ndarray, block: Suffixes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window length: (length, positions in the shard, benchmark suffix that starts with the same window), some PAIRS at a time."""
    known = codes >= 0
    for n, grams, suffixes, begin in block.windows:
        run = np.concatenate([[0], np.cumsum(known)])
        starts = np.flatnonzero(run[n:] - run[:-n] == n) if len(codes) >= n else np.zeros(0, np.int64)
        array = suffix_array(codes, starts, n)
        if not len(array):
            continue
        low, high = _search(codes, array, grams, False), _search(codes, array, grams, True)
        found, size = high - low, np.diff(begin)
        which = np.repeat(np.arange(len(grams)), found)
        at = array[low[which] + _within(found)]
        part = np.cumsum(size[which]) // PAIRS
        for cut in np.split(np.arange(len(at)), np.flatnonzero(np.diff(part)) + 1) if len(at) else ():
            w = which[cut]
            yield n, np.repeat(at[cut], size[w]), suffixes[np.repeat(begin[w], size[w]) + _within(size[w])]


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def longest(codes: np.ndarray, block: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position in the shard, position in the benchmark, words) of each verbatim match that can't be made longer on either side."""
    own, last = np.append(block.codes, -2), np.append(block.item, -1)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for n, at, test in find(codes, block):
        left = (at == 0) | (test == 0) | (codes[at - 1] != own[test - 1]) | (last[test - 1] != last[test])
        at, test = at[left], test[left]
        size, grow = np.full(len(at), n), np.arange(len(at))
        while len(grow):
            x, y = at[grow] + size[grow], test[grow] + size[grow]
            more = (x < len(codes)) & (y < len(block.codes))
            more[more] = (codes[x[more]] == own[y[more]]) & (last[y[more]] == last[test[grow][more]])
            grow = grow[more]
            size[grow] += 1
        out.append((at, test, size))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """(doc ids, hashes of all words, where each document's words start) for runs of documents."""
    ids: list = []
    hashes: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    total = 0
    for batch in batches:
        for b in W.parts(batch):
            data, offsets = W.buffers(b.column("text"))
            h, _, _, rows = W.words(data, offsets, W.PUNCT)
            ids += b.column("doc_id").to_pylist()
            hashes.append(h)
            counts.append(np.diff(rows))
            total += len(h)
            if total >= SHARD_WORDS:
                yield ids, np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
                ids, hashes, counts, total = [], [], [], 0
    if ids:
        yield ids, np.concatenate(hashes), np.concatenate([[0], np.cumsum(np.concatenate(counts))])


def _spread(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes with a gap after each document, so that no match crosses documents; the new place of each word and the document of each place."""
    doc = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    place = np.arange(len(codes)) + doc
    out = np.full(len(codes) + len(rows) - 1, -1, np.int32)
    out[place] = codes
    owner = np.repeat(np.arange(len(rows) - 1), np.diff(rows) + 1)
    return out, owner, rows[:-1] + np.arange(len(rows) - 1)


def _hits(batches: Iterator[pa.RecordBatch], block: Suffixes) -> Iterator[pa.RecordBatch]:
    for ids, hashes, rows in _shards(batches):
        codes, owner, _ = _spread(block.codes_of(hashes), rows)
        at, test, size = longest(codes, block)
        cover = np.zeros(len(codes) + 1, np.int64)
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        hit = np.bincount(owner[np.flatnonzero(np.cumsum(cover[:-1]) > 0)], minlength=len(ids))
        items: list[set] = [set() for _ in ids]
        for x in np.unique(owner[at] * len(block.ids) + block.item[test]):
            items[x // len(block.ids)].add(block.ids[x % len(block.ids)])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(np.diff(rows), pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(x - {None}) for x in items], pa.list_(pa.string()))], names=["doc_id", "n_words", "n_hit", "items"]
        )


def _matches(batches: Iterator[pa.RecordBatch], block: Suffixes) -> Iterator[pa.RecordBatch]:
    row = 0
    for ids, hashes, rows in _shards(batches):
        codes, owner, begin = _spread(block.codes_of(hashes), rows)
        at, test, size = longest(codes, block)
        doc = owner[at]
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[d] for d in doc], pa.int64()), pa.array(row + doc, pa.int64()), pa.array(at - begin[doc], pa.int64()), pa.array([block.ids[block.item[t]] for t in test], pa.string()), pa.array(block.place[test], pa.int64()), pa.array(size, pa.int64())],
            names=["doc_id", "doc_row", "doc_start", "item_id", "item_start", "n_words"],
        )
        row += len(ids)


def blocks(benchmark: DataFrame, window: int = WINDOW, chars: int = BLOCK_CHARS) -> Iterator[Suffixes]:
    """The benchmark as blocks of at most ``chars`` characters (one item at least), one at a time; one empty block where there are no items."""
    rows, held, made = [], 0, False
    for r in benchmark.select(F.col("item_id").cast("string").alias("i"), F.coalesce("text", F.lit("")).alias("t")).toLocalIterator():
        if rows and held + len(r.t) > chars:
            yield Suffixes(rows, window)
            rows, held, made = [], 0, True
        rows.append((r.i, r.t))
        held += len(r.t)
    if rows or not made:
        yield Suffixes(rows, window)


def _passes(benchmark: DataFrame, window: int, run: Callable[[Suffixes], DataFrame], name: str) -> list[DataFrame]:
    """What ``run`` makes with each block; written, if there are several, before the next block is fetched."""
    todo = blocks(benchmark, window)
    first, second = next(todo), next(todo, None)
    if second is None:
        return [run(first)]
    out = [written(run(first), name)]
    del first
    while second is not None:
        out.append(written(run(second), name))
        second = next(todo, None)
    return out


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Longest verbatim matches of at least a window: document (and its row in the task), item, word positions in both, words."""
    texts = docs.select("doc_id", "text")
    return reduce(DataFrame.unionByName, _passes(benchmark, window, lambda b: texts.mapInArrow(lambda it: _matches(it, b), MATCHES), "op6-matches"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """A row for each document: words, words inside an occurrence of a window, items with occurring windows (as sorted strings).

    With several blocks ``n_hit`` needs each block's positions, so the documents pass once more for each block and the union of the
    covered words is taken from ``matches``."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("_k"))
    found = {}

    def run(block: Suffixes) -> DataFrame:
        found["whole"] = lambda: docs.select("doc_id", "text").mapInArrow(lambda it: _hits(it, block), HITS)
        return keyed.select(F.col("_k").alias("doc_id"), "text").mapInArrow(lambda it: _matches(it, block), MATCHES)

    parts = _passes(benchmark, window, run, "op6-matches")
    if len(parts) == 1:
        return found["whole"]()
    spans = reduce(DataFrame.unionByName, parts)
    covered = spans.select(F.col("doc_id").alias("_k"), "item_id", F.explode(F.sequence("doc_start", F.expr("doc_start + n_words - 1"))).alias("p")).groupBy("_k").agg(F.countDistinct("p").alias("n_hit"), F.array_sort(F.collect_set("item_id")).alias("items"))
    counts = keyed.select("doc_id", "_k", "text").mapInArrow(_counts, "doc_id long, _k long, n_words long")
    return counts.join(covered, "_k", "left").select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in W.parts(batch):
            rows = W.words(*W.buffers(b.column("text")), W.PUNCT)[3]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("_k"), pa.array(np.diff(rows), pa.int64())], names=["doc_id", "_k", "n_words"])


def remove(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without those that hold a window of the benchmark; the filter runs where the document is read, block after block on what is left."""
    left = [docs]

    def run(block: Suffixes) -> DataFrame:
        return left[-1].mapInArrow(lambda it: _clean(it, block), docs.schema)

    todo = blocks(benchmark, window)
    block, after = next(todo), next(todo, None)
    while after is not None:
        left.append(written(run(block), "op6-left"))
        block, after = after, next(todo, None)
    return run(block)


def _clean(batches: Iterator[pa.RecordBatch], block: Suffixes) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in W.parts(batch):
            row = pa.array(np.arange(b.num_rows), pa.int64())
            found = _hits(iter([pa.RecordBatch.from_arrays([row, b.column("text")], names=["doc_id", "text"])]), block)
            dirty = np.concatenate([np.asarray(h.column("n_hit")) for h in found]) > 0
            yield b.filter(pa.array(~dirty))


def _sha(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def op6_suffix_decontam(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = hits(docs, benchmark)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), _sha(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
