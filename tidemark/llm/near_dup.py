"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its word shingles. Documents with one set are one class, whose smallest id stands for it. Each class has a
signature of minwise tokens. In each of several independent trees a document takes, at every node, a few of its signature's coordinates,
which ones the node's path decides; the tokens there lead to its children. Documents that meet in a leaf are compared, and so that large
groups cost no quadratic work, in this order:

1. each with the most central document of its leaf, then with another one drawn at random; what links joins components;
2. in leaves that still hold several components, all pairs of different components: in tiny leaves by sketches, in larger ones block
   against block by their full sets, where only a spanning forest of the links leaves the task, since no more is needed for components.
   What is in the leaf's largest component isn't compared with itself. Blocks are bounded in documents and in tokens, and each pair of
   blocks is a row of its own key, so a large leaf spreads over tasks.

Sketches of a pair must agree in as many places as all but one linked pair in 200,000 does, before its full sets are compared.

A pair at the threshold meets in some leaf with a probability of over 0.99999, likelier above it, whatever the size of its leaves. Links are
confirmed on full sets, and components are taken over confirmed links in Spark. There is no cap on candidates, partners or group sizes.

Null and empty texts have an empty set and stand alone; so do documents without an id, which are kept. Rows with one id and one text are
one document; texts under one id are linked by it. Long texts count whole. Extra columns pass through ``keep_first``.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import bloom
from tidemark.llm import text as W
from tidemark.llm.components import components
from tidemark.llm.shared import written

PERCENT = 80
COORDINATES = 64
TREES = 16
#: Children that a node has for each document, by level; their product times TREES is a document's number of leaves.
FAN = (1, 2, 1)
#: Documents in a leaf that counts as tiny; documents and tokens in a block of a larger one; tokens that a block's overlaps are counted over at once.
TINY, BLOCK, BLOCK_TOKENS, COLUMNS = 16, 256, 1 << 18, 4096
#: Places of a sketch, a byte each, and the standard errors that a linked pair may fall short by.
PLACES, ERRORS = 256, 4.5

_rng = np.random.default_rng(58)
_WORD = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_XOR, _MUL = _rng.integers(0, 1 << 63, PLACES, dtype=np.uint64), _rng.integers(1, 1 << 63, PLACES, dtype=np.uint64) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingles of k words as hashes; fewer words make one shingle."""
    h, _, _, rows = W.words(data, offsets, W.WHITE)
    n = len(h) - k + 1
    runs = np.zeros(0, np.uint64)
    if n > 0:
        runs = h[:n] * _WORD[0]
        for j in range(1, k):
            runs = runs + h[j : j + n] * _WORD[j]
        runs = W.mix(runs)
    for a, b in zip(rows[:-1], rows[1:], strict=True):
        if b - a >= k:
            yield np.unique(runs[a : b - k + 1])
        elif b > a:
            yield W.mix((h[a:b] * _WORD[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            yield h[:0]


def signature(s: np.ndarray, n: int = COORDINATES) -> np.ndarray:
    """The smallest tokens under n hash functions, 32 bits of each; long sets go in pieces."""
    least = np.full(n, ~np.uint64(0))
    for i in range(0, len(s), 2048):
        least = np.minimum(least, ((s[i : i + 2048, None] ^ _XOR[:n]) * _MUL[:n]).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32)


def _least(percent: int) -> int:
    """Places in which the sketches of a linked pair agree at least."""
    p = percent / 100
    return int(np.floor(PLACES * (p - ERRORS * np.sqrt(p * (1 - p) / PLACES))))


def _describe(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in W.parts(batch):
            sizes, keys, signs = [], [], []
            for s in shingle_sets(*W.buffers(b.column("text")), k):
                sizes.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signs.append(signature(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signs, pa.binary())], names=["doc_id", "n_shingles", "set_key", "sig"])


def _branch(paths: np.ndarray, signs: np.ndarray, fan: int) -> np.ndarray:
    """The children of each document's nodes: rows are documents, columns nodes."""
    out = []
    for slot in range(fan):
        coordinate = (W.mix(paths + np.uint64(slot + 1) * np.uint64(0xA0761D6478BD642F)) % np.uint64(COORDINATES)).astype(np.int64)
        token = np.take_along_axis(signs, coordinate, axis=1).astype(np.uint64)
        out.append(W.mix(paths ^ W.mix((coordinate.astype(np.uint64) << np.uint64(32)) | token)))
    return np.concatenate(out, axis=1)


def _signs(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(len(col), COORDINATES)


def _sketches(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), PLACES)


def _leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        signs = _signs(b.column("sig"))
        paths = np.broadcast_to(W.mix(np.arange(1, TREES + 1, dtype=np.uint64)), (len(signs), TREES))
        for fan in FAN:
            paths = _branch(paths, signs, fan)
        ids = np.repeat(np.asarray(b.column("id")), paths.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(W.signed(paths.ravel())), pa.array(ids)], names=["node", "id"])


def _confirm(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        left, right = (shingle_sets(*W.buffers(b.column(c)), k) for c in ("text_a", "text_b"))
        ok = []
        for x, y in zip(left, right, strict=True):
            both = len(np.intersect1d(x, y, assume_unique=True))
            ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
        yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))


def _sketched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in W.parts(batch):
            sets = list(shingle_sets(*W.buffers(b.column("text")), k))
            sketches = [(signature(s, PLACES) & np.uint32(255)).astype(np.uint8).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sketches, pa.binary())], names=[*b.schema.names, "sketch"])


def _tokens(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in W.parts(batch):
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.tobytes() for s in shingle_sets(*W.buffers(b.column("text")), k)], pa.binary())], names=["id", "tokens"])


def _likely(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            ok = (_sketches(b.column("sketch_a")) == _sketches(b.column("sketch_b"))).sum(axis=1) >= least
            yield b.select(["a", "b"]).filter(pa.array(ok))


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def _compare_tiny(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Pairs of different components in a leaf whose sketches agree enough."""
    for b in batches:
        out = []
        for leaf in b.column("rows"):
            rows = leaf.values
            ids, labels, x = np.asarray(rows.field("id")), np.asarray(rows.field("label")), _sketches(rows.field("data"))
            agree = (x[:, None] == x[None]).sum(axis=2, dtype=np.int16)
            p, q = np.nonzero((agree >= least) & (labels[:, None] != labels[None]))
            out.append(np.sort(np.column_stack([ids[p], ids[q]]), axis=1))
        yield _pairs(out)


def _block(col: pa.Array, i: int) -> tuple[np.ndarray, ...]:
    """(ids, labels, set sizes, all tokens, the owner of each) of a block."""
    rows = col[i].values
    data = rows.field("data").to_pylist()
    size = np.array([len(x) // 8 for x in data])
    return np.asarray(rows.field("id")), np.asarray(rows.field("label")), size, np.frombuffer(b"".join(data), np.uint64), np.repeat(np.arange(len(data)), size)


def _overlaps(x: tuple, y: tuple) -> np.ndarray:
    """How many tokens each document of one block has in common with each of the other, a range of shared tokens at a time."""
    shared = np.intersect1d(x[3], y[3])
    out = np.zeros((len(x[0]), len(y[0])), np.float32 if max(x[2].max(), y[2].max()) < 1 << 24 else np.float64)
    for at in range(0, len(shared), COLUMNS):
        part = shared[at : at + COLUMNS]
        sides = []
        for _, _, size, tokens, owner in (x, y):
            place = np.minimum(np.searchsorted(part, tokens), len(part) - 1)
            hit = part[place] == tokens
            m = np.zeros((len(size), len(part)), np.float32)
            m[owner[hit], place[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def spanning_forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which edges a-b make a spanning forest of the graph of all: every root hooks one of its edges to a smaller root, until none is left."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b, at = place[: len(a)], place[len(a) :], np.arange(len(a))
    root, kept = np.arange(len(nodes)), []
    while len(at):
        x, y = root[a], root[b]
        open_ = x != y
        a, b, at, x, y = a[open_], b[open_], at[open_], x[open_], y[open_]
        high, first = np.unique(np.maximum(x, y), return_index=True)
        root[high] = np.minimum(x, y)[first]
        kept.append(at[first])
        while (root[root] != root).any():
            root = root[root]
    return np.concatenate([np.zeros(0, np.int64), *kept])


def _compare(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links that join all components which links between two blocks of a leaf join: fewer than the blocks have documents."""
    for b in batches:
        for i in range(b.num_rows):
            x, y = _block(b.column("left"), i), _block(b.column("right"), i)
            both, sizes = _overlaps(x, y), x[2][:, None] + y[2][None]
            p, q = np.nonzero((100.0 * both >= percent * (sizes - both)) & (both > 0) & (x[1][:, None] != y[1][None]))
            keep = spanning_forest(x[1][p], y[1][q])
            yield _pairs([np.sort(np.column_stack([x[0][p[keep]], y[0][q[keep]]]), axis=1)])


def classes(docs: DataFrame, k: int, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set_key, component (smallest id linked, directly or over others; null for empty sets and null ids): a row for each document."""
    sets = written(docs.select("doc_id", "text").mapInArrow(lambda it: _describe(it, k), "doc_id long, n_shingles long, set_key binary, sig binary"), "op5-sets")
    reps = sets.where("n_shingles > 0 and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n"))
    reps = written(reps, "op5-reps")

    leaves = reps.select("id", "sig").mapInArrow(_leaves, "node long, id long")
    shared = leaves.groupBy("node").agg(F.count("*").alias("members"), F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("node", "members")
    members = written(leaves.join(shared, "node").select("node", "id", "members"), "op5-leaves")
    # how central: a document that shares its leaves with many differs little from most
    rank = members.groupBy("id").agg(F.sum("members").alias("centre"))
    open_ = members.select("node", "id").join(rank, "id")

    ids = rank.select("id")
    hashed = F.xxhash64("id").alias("h")
    texts = bloom.sieve(docs.select(F.col("doc_id").alias("id"), "text").where("id is not null").select("*", hashed), "h", bloom.build(ids.select(hashed), "h"))
    texts = texts.join(ids, "id", "left_semi").select("id", "text")
    texts = written(texts.mapInArrow(lambda it: _sketched(it, k), "id long, text string, sketch binary"), "op5-texts")
    least = _least(percent)
    sketches = texts.select("id", "sketch")

    def likely(pairs: DataFrame) -> DataFrame:
        a, b = (sketches.select(F.col("id").alias(c), F.col("sketch").alias(f"sketch_{c}")) for c in "ab")
        return pairs.join(a, "a").join(b, "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(lambda it: _likely(it, least), "a long, b long").distinct()

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        a, b = (texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab")
        return written(pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(lambda it: _confirm(it, k, percent), "a long, b long"), name)

    links, tried, labels = None, None, None
    for turn, order in enumerate((F.struct("centre", F.xxhash64("id")), F.struct(F.xxhash64("id", F.lit(7))))):
        now = open_.withColumn("label", F.col("id")) if labels is None else open_.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
        pivots = now.groupBy("node").agg(F.max_by("id", order).alias("pivot"), F.max_by("label", order).alias("with"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("node", "pivot", "with")
        pairs = now.join(pivots, "node").where("label <> with").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).where("a < b").distinct()
        pairs = written(likely(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")), f"op5-pairs{turn}")
        found = confirmed(pairs, f"op5-links{turn}")
        tried, links = (pairs, found) if tried is None else (tried.unionByName(pairs), links.unionByName(found))
        labels = written(components(links).select("id", F.col("component").alias("label")), f"op5-labels{turn}")

    # leaves that still hold several components
    now = open_.drop("centre").join(labels, "id", "left").withColumn("label", F.coalesce("label", "id")).join(reps.groupBy("id").agg(F.first("n").alias("n")), "id")
    each = now.groupBy("node", "label").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    largest = F.struct("m", "label", "t")
    leaf = each.groupBy("node").agg(F.sum("m").alias("m"), F.sum("t").alias("t"), F.max(largest).alias("main"), F.count("*").alias("labels")).where("labels > 1")
    # blocks of the largest component come after the others
    blocks = lambda m, t: F.greatest(F.ceil(m / BLOCK), F.ceil(t / BLOCK_TOKENS))
    others, main = blocks(F.col("m") - F.col("main.m"), F.col("t") - F.col("main.t")), blocks(F.col("main.m"), F.col("main.t"))
    leaf = leaf.select("node", "m", F.col("main.label").alias("main"), others.alias("others"), (others + main).alias("blocks"))
    ready = written(now.drop("n").join(leaf, "node"), "op5-open")
    data = lambda c: F.struct("id", "label", F.col(c).alias("data")).alias("row")
    tiny = ready.where(f"m <= {TINY}").join(sketches, "id").select("node", data("sketch")).groupBy("node").agg(F.collect_list("row").alias("rows"))
    large = ready.where(f"m > {TINY}")
    tokens = texts.select("id", "text").join(large.select("id").distinct(), "id").mapInArrow(lambda it: _tokens(it, k), "id long, tokens binary")
    block = F.when(F.col("label") == F.col("main"), F.col("others") + F.pmod(F.xxhash64("id"), F.col("blocks") - F.col("others"))).otherwise(F.pmod(F.xxhash64("id"), "others"))
    packed = large.join(tokens, "id").select("node", "others", "blocks", block.alias("block"), data("tokens"))
    packed = written(packed.groupBy("node", "others", "blocks", "block").agg(F.collect_list("row").alias("rows")), "op5-blocks")
    # a block of the others goes to every later block and itself, each of which has its own key
    left = packed.where("block < others").select("node", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("to"), F.col("rows").alias("left"))
    both = left.join(packed.select("node", F.col("block").alias("to"), F.col("rows").alias("right")), ["node", "to"]).select("left", "right")
    found = written(both.mapInArrow(lambda it: _compare(it, percent), "a long, b long"), "op5-links")
    near = tiny.select("rows").mapInArrow(lambda it: _compare_tiny(it, least), "a long, b long").distinct()
    found = found.unionByName(confirmed(written(near.join(tried, ["a", "b"], "left_anti"), "op5-pairs"), "op5-links"))
    if not found.isEmpty():
        labels = components(links.unionByName(found)).select("id", F.col("component").alias("label"))
    by_set = reps.select("set_key", "id").join(labels, "id", "left").select("set_key", F.coalesce("label", "id").alias("component"))
    return sets.drop("sig").join(by_set, "set_key", "left").select("doc_id", "n_shingles", "set_key", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component"))


def keep_first(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents whose id is their component's; of repeated rows under one id all stay. Documents without id stay."""
    found = classes(docs, k, percent).where("doc_id = component").select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_semi").select(docs.columns).unionByName(docs.where("doc_id is null"))


def op5_chosen_path(docs: DataFrame) -> DataFrame:
    found = classes(docs, 2)
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))
