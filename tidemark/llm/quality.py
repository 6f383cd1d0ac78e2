"""Ordinal quality: cumulative-link regression on graded ratings.

Grades are ordered: 0 toxic, 1 poor, 2 good. One weight vector over hashed text features gives a score s, and thresholds t1 < t2 give
P(grade >= k) = sigmoid(s - t_k); the expected grade is the sum of these tail probabilities. Features are the distinct words and their
beginnings, the shapes of words (first and last characters) and how much the text repeats itself, hashed into 2^20 places.

The fit takes a bounded sample of labelled rows (MAX_LABELS, those with the smallest hashes of their ids), split over SPLITS tasks that
run stochastic gradient steps on their own rows; their weights are averaged after each round. Features in fewer than LEAST sampled
documents, and those as frequent on both sides of every grade boundary (by a two-proportion test), get no weight, so that a long text's
many ordinary words don't outweigh a few telling ones. Scoring reads every document whole.

Null and empty texts have no features and get score 0. Labels that are null, or whose document is missing, don't count; without any usable label
every document passes. Repeated rows give repeated results, and extra columns pass through (``score`` replaces ones named expected_grade or p_good).
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as W
from tidemark.llm.shared import written

BITS = 20
#: Bytes of the word beginnings that count as features.
PREFIXES = (4, 5, 6)
GRADES = 3
MAX_LABELS = 20_000
SPLITS = 4
ROUNDS = 10
LEAST = 4
#: Standard errors by which a feature's share must differ across a grade boundary.
TELLING = 5.0
RATE = 1.0
DECAY = 1e-4
#: A document is kept if it is at least of the best grade with this probability.
KEEP = 0.4

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[[*range(97, 123), *range(128, 256)]] = 97
_CLASS[65:91] = 65
_CLASS[48:58] = 48


def features(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """Each row's distinct feature places."""
    top = np.uint64(64 - BITS)
    words, head, size, rows = W.words(data, offsets, W.PUNCT)
    heads = []
    for n in PREFIXES:
        long = size > n
        h = np.zeros(len(words), np.uint64)
        h[long] = W.mix((W._BYTE[data[head[long][:, None] + np.arange(n)]] * W._power(n)[:n]).sum(axis=1) + np.uint64(n << 56)) >> top
        heads.append((h, long))
    tokens, first, length, at = W.words(data, offsets, W.WHITE)
    # the last byte of a word lies among non-white bytes, which are contiguous within it
    last = first + length - 1
    shape = (_CLASS[data[first]] << np.uint64(16)) | (_CLASS[data[np.maximum(last - 1, first)]] << np.uint64(8)) | _CLASS[data[last]] if len(first) else tokens
    shape = W.mix(shape + (np.uint64(1) << np.uint64(40))) >> top
    place = words >> top
    for a, b, c, d in zip(rows[:-1], rows[1:], at[:-1], at[1:], strict=True):
        if d == c:
            yield np.zeros(0, np.int64)
            continue
        repeats = int(10 * (1 - len(np.unique(tokens[c:d])) / (d - c))) + (20 if d - c >= 50 else 0)
        shapes, n = np.unique(shape[c:d], return_counts=True)
        # how common a shape is, on a coarse scale
        level = np.minimum(np.log2(n * 64 / (d - c)).clip(0, 6), 6).astype(np.uint64)
        scaled = W.mix(shapes + ((level + np.uint64(1)) << np.uint64(32))) >> top
        begun = [h[a:b][long[a:b]] for h, long in heads]
        yield np.unique(np.concatenate([place[a:b], *begun, scaled, W.mix(np.array([repeats + (1 << 50)], np.uint64)) >> top])).astype(np.int64)


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in W.parts(batch):
            found = [x.astype(np.uint32).tobytes() for x in features(*W.buffers(b.column("text")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("grade"), pa.array(found, pa.binary())], names=["doc_id", "grade", "places"])


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1, 2, ... as columns."""
    return 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -35, 35)))


def _pass(rows: list[tuple[int, np.ndarray]], weights: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One epoch of adaptive gradient steps over small batches."""
    weights, thresholds = weights.astype(np.float64), thresholds.copy()
    seen, seen_t = np.full(len(weights), 1e-6), np.full(len(thresholds), 1.0)
    for at in range(0, len(rows), 32):
        part = [r for r in rows[at : at + 32] if len(r[1])]
        if not part:
            continue
        grade, sizes, places = np.array([g for g, _ in part]), [len(p) for _, p in part], np.concatenate([p for _, p in part])
        owner = np.repeat(np.arange(len(part)), sizes)
        tail = tails(np.bincount(owner, weights[places]), thresholds)
        full = np.column_stack([np.ones(len(part)), tail, np.zeros(len(part))])
        slope = np.column_stack([np.zeros(len(part)), tail * (1 - tail), np.zeros(len(part))])
        n = np.arange(len(part))
        p = np.maximum(full[n, grade] - full[n, grade + 1], 1e-9)
        by_score = (slope[n, grade + 1] - slope[n, grade]) / p
        by_threshold = np.zeros_like(tail)
        for k in range(len(thresholds)):
            by_threshold[:, k] = np.where(grade == k + 1, slope[:, k + 1], np.where(grade == k, -slope[:, k + 1], 0)) / p
        g = np.bincount(places, by_score[owner], len(weights)) if len(places) > len(weights) // 8 else None
        if g is None:
            own, back = np.unique(places, return_inverse=True)
            g = np.bincount(back, by_score[owner])
        else:
            own = np.flatnonzero(g)
            g = g[own]
        g = g / len(part) + DECAY * weights[own]
        seen[own] += g * g
        weights[own] -= RATE * g / np.sqrt(seen[own]) * 0.1
        g = by_threshold.mean(axis=0)
        seen_t += g * g
        thresholds = np.sort(thresholds - RATE * g / np.sqrt(seen_t))
    return weights, thresholds


def fit(docs: DataFrame, grades: DataFrame, max_labels: int = MAX_LABELS) -> tuple[np.ndarray, np.ndarray] | None:
    """(weights, thresholds) from a frame of doc_id and grade."""
    chosen = grades.where("doc_id is not null and grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labels)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_sampled, "doc_id long, grade int, places binary")
    sample = written(sample.repartition(SPLITS, F.pmod(F.xxhash64("doc_id"), F.lit(SPLITS))), "op2-sample")

    def count(batches):
        n = np.zeros((GRADES, 1 << BITS), np.int64)
        for b in batches:
            for g, x in zip(b.column("grade").to_pylist(), b.column("places").to_pylist(), strict=True):
                n[g][np.frombuffer(x, np.uint32)] += 1
        at = np.flatnonzero(n.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(x[at]) for x in n)], names=["place", *(f"n{k}" for k in range(GRADES))])

    size = {r.grade: r["count"] for r in sample.groupBy("grade").count().collect()}
    rows = sum(size.values())
    held = sample.select("grade", "places").mapInArrow(count, "place long, " + ", ".join(f"n{k} long" for k in range(GRADES))).groupBy("place").agg(*(F.sum(f"n{k}").alias(f"n{k}") for k in range(GRADES)))
    total = sum((F.col(f"n{k}") for k in range(GRADES)), F.lit(0))
    tests = []
    for k in range(1, GRADES):
        n_low = sum(size.get(j, 0) for j in range(k))
        if 0 < n_low < rows:
            low = sum((F.col(f"n{j}") for j in range(k)), F.lit(0))
            p = total / rows
            tests.append(F.abs(low / n_low - (total - low) / (rows - n_low)) / F.sqrt(F.greatest(p * (1 - p) * (1 / n_low + 1 / (rows - n_low)), F.lit(1e-12))))
    if not tests:
        return None
    telling = held.where((total >= LEAST) & (F.greatest(*tests, F.lit(0.0)) >= TELLING))
    known = np.array(sorted(r.place for r in telling.select("place").toLocalIterator()), np.int64)
    mean = sample.agg(*(F.avg((F.col("grade") >= k).cast("double")).alias(f"t{k}") for k in range(1, GRADES))).first()
    share = np.clip(np.array([mean[f"t{k}"] for k in range(1, GRADES)]), 0.01, 0.99)
    weights, thresholds = np.zeros(len(known), np.float32), np.sort(-np.log(share / (1 - share)))
    for turn in range(ROUNDS):

        def run(batches, weights=weights, thresholds=thresholds, turn=turn):
            own = []
            for b in batches:
                for i, g, x in zip(b.column("doc_id").to_pylist(), b.column("grade").to_pylist(), b.column("places").to_pylist(), strict=True):
                    p = np.frombuffer(x, np.uint32).astype(np.int64)
                    own.append((i, g, np.flatnonzero(np.isin(known, p, assume_unique=True))))
            if own:
                own.sort(key=lambda r: (r[0], r[1], len(r[2])))
                order = np.random.default_rng(turn).permutation(len(own))
                w, t = _pass([own[i][1:] for i in order], weights, thresholds)
                yield pa.RecordBatch.from_arrays([pa.array([len(own)]), pa.array([w.astype(np.float32).tobytes()], pa.binary()), pa.array([list(t)])], names=["n", "w", "t"])

        parts = sorted(sample.mapInArrow(run, "n long, w binary, t array<double>").toLocalIterator(), key=lambda r: r.w)
        weights = sum(np.frombuffer(r.w, np.float32) * (r.n / rows) for r in parts).astype(np.float32)
        thresholds = sum(np.array(r.t) * (r.n / rows) for r in parts)
    full = np.zeros(1 << BITS, np.float32)
    full[known] = weights
    return full, thresholds


def _scores(b: pa.RecordBatch, weights: np.ndarray) -> np.ndarray:
    return np.array([weights[p].sum(dtype=np.float64) for p in features(*W.buffers(b.column("text")))])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None) -> DataFrame:
    """Adds expected_grade and p_good (the probability of the best grade)."""
    names = [c for c in docs.columns if c not in ("expected_grade", "p_good")]
    docs = docs.select(names)
    if model is None:
        return docs.withColumns({"expected_grade": F.lit(float(GRADES - 1)), "p_good": F.lit(1.0)})
    weights, thresholds = model
    schema = docs.limit(0).withColumns({"expected_grade": F.lit(0.0), "p_good": F.lit(0.0)}).schema

    def run(batches):
        for batch in batches:
            for b in W.parts(batch):
                t = tails(_scores(b, weights), thresholds)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(t.sum(axis=1)), pa.array(t[:, -1])], names=[*names, "expected_grade", "p_good"])

    return docs.mapInArrow(run, schema)


def good(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, least: float = KEEP) -> DataFrame:
    """The documents that are of the best grade with a probability of at least ``least``, with the columns they have."""
    if model is None:
        return docs
    weights, thresholds = model

    def run(batches):
        for batch in batches:
            for b in W.parts(batch):
                yield b.filter(pa.array(tails(_scores(b, weights), thresholds)[:, -1] >= least))

    return docs.mapInArrow(run, docs.schema)


def grades(labels: DataFrame) -> DataFrame:
    """Toxic is 0, else poor 1 and good 2."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).when(F.col("quality") == 0, 1).alias("grade"))


def op2_ordinal_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score(docs.select("doc_id", "text"), fit(docs, grades(labels)))
    return found.select("doc_id", F.round("expected_grade", 6).alias("expected_grade"), F.round("p_good", 6).alias("p_good"), (F.col("p_good") >= KEEP).alias("keep"))
