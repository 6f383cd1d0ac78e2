"""LM scoring: a trigram model in Elias-Fano trie shards, trained and queried over packed messages.

Interpolated absolute discounting: P(w | u v) = max(c(u v w) - D, 0) / c(u v) + b(u v) P(w | v), where b(u v) = D t(u v) / c(u v) and t counts the different
words after u v; P(w | v) likewise over P(w) = (c(w) + 1) / (N + V + 1); a context never seen in training leaves all to the shorter one. It sums to 1 but
for quantisation: the trie holds the first terms and the weights b in a byte each. A text is its words and an end; its first word follows a
start. Words are lower-cased over A-Z and split at ASCII white space.

1. Tasks turn documents into batches of about BATCH_TOKENS tokens: distinct words, and the tokens as places among them.
2. Each batch sends each shard its distinct words, pairs and triples that belong there, with their training counts. A word's shard follows from its
   hash, a pair's from its first word, a triple's from its pair; where that word or pair makes up over HOT of all tokens (at most about 1/HOT of them
   do), it follows from the last word instead, so that no shard holds all that follows a common word or pair.
3. A shard sums the counts, packs them as a trie and answers every batch from it: exact counts of words, bytes for pairs, triples and weights.
4. Batches and answers meet again, and each document's score is summed.

All counts cover all training documents. Fingerprints of successors have 32 bits in pairs and 24 in triples, so one may rarely be taken for
another. Null and empty texts are an end alone. Documents without id train (their id is the empty text). Repeated rows count each time.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import text as W
from tidemark.llm.shared import written
from tidemark.llm.trie import CODEBOOK, Trie, at, quantise

DISCOUNT = 0.75
BATCH_TOKENS = 1 << 20
SHARD_TOKENS = 1 << 20
HOT = 0.001
#: The documents whose crc32 of the id leaves this remainder are held out.
FOLDS, HELD_OUT = 7, 2

START, END = (int(x) for x in W.mix(np.array([0x5354415254, 0x454E44], np.uint64)))


def _zip(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unzip(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def held_out(doc_id) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _before(places: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The place of the word before each token (n, the start, before a text's first), and each text's first token."""
    first = np.cumsum(sizes) - sizes
    before = np.empty(len(places), np.int64)
    before[1:] = places[:-1]
    before[first] = n
    return before, first


BATCHES = "batch long, tokens long, ids array<long>, train binary, sizes binary, words binary, places binary, common array<struct<u:long,w:long,n:long>>"


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, number = TaskContext.get().partitionId(), 0
    ids: list = []
    tokens: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    held = 0

    def flush():
        words, places = np.unique(np.concatenate(tokens), return_inverse=True)
        n, size = np.bincount(places), np.concatenate(sizes)
        train = np.array([not held_out(i) for i in ids])
        trained = int(size[train].sum())
        # words and pairs that are common in the batch; pairs of a word and an end are no contexts
        least = max(2, HOT * len(places))
        often = n >= least
        common = [(None, w, c) for w, c in zip(W.signed(words[often]).tolist(), n[often].tolist(), strict=True)]
        before, _ = _before(places, size, len(words))
        may = np.flatnonzero(np.append(often, len(size) >= least)[before] & often[places] & (words[places] != np.uint64(END)))
        pair, c = np.unique(before[may] * len(words) + places[may], return_counts=True)
        named = W.signed(np.append(words, np.uint64(START)))
        common += [(int(named[k // len(words)]), int(named[k % len(words)]), int(x)) for k, x in zip(pair[c >= least], c[c >= least], strict=True)]
        row = {
            "batch": (task << 32) | number, "tokens": trained, "ids": list(ids), "train": np.packbits(train).tobytes(), "sizes": _zip(size.astype(np.int32)), "words": words.tobytes(),
            "places": _zip(places.astype(np.uint32)), "common": [{"u": u, "w": w, "n": c} for u, w, c in common],
        }
        kinds = {"ids": pa.list_(pa.int64()), "common": pa.list_(pa.struct([("u", pa.int64()), ("w", pa.int64()), ("n", pa.int64())]))}
        return pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k)) for k, v in row.items()], names=list(row))

    for batch in batches:
        for b in W.parts(batch):
            h, _, _, rows = W.words(*W.buffers(b.column("text")), W.WHITE)
            ids += b.column("doc_id").to_pylist()
            tokens.append(np.insert(h, rows[1:], np.uint64(END)))
            sizes.append(np.diff(rows) + 1)
            held += len(tokens[-1])
            if held >= BATCH_TOKENS:
                yield flush()
                number, ids, tokens, sizes, held = number + 1, [], [], [], 0
    if ids:
        yield flush()


class Hot:
    """The common words and pairs of words, as sorted hashes; a pair's first word can be the start."""

    def __init__(self, words: np.ndarray, pairs: np.ndarray) -> None:
        self.words, self.pairs = words, pairs.reshape(-1, 2)

    def here(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Their places among a batch's words (-1: not here; the start comes after the last)."""

        def place(x):
            if not len(words):
                return np.where(x == np.uint64(START), 0, -1)
            i = np.minimum(np.searchsorted(words, x), len(words) - 1)
            return np.where(words[i] == x, i, np.where(x == np.uint64(START), len(words), -1))

        return place(self.words), np.column_stack([place(self.pairs[:, 0]), place(self.pairs[:, 1])])


def _which(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each value in ``wanted``, -1 for none; negative entries of ``wanted`` match nothing."""
    order = np.argsort(wanted)
    if not len(order):
        return np.full(len(values), -1)
    i = order[np.minimum(np.searchsorted(wanted, values, sorter=order), len(order) - 1)]
    return np.where(wanted[i] == values, i, -1)


class Grams:
    """A batch's distinct pairs and triples in the order of its messages.

    Pairs go by shard, then home contexts before common ones, then context and successor; triples by their pair, but those of common pairs by shard, pair
    and last word. of2, of3 and of_hot say which one each token (of all, ``tokens3``, ``tokens_hot``) ends."""

    def __init__(self, places: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, hot: np.ndarray, pairs: np.ndarray) -> None:
        """places: tokens as places among the batch's words; bounds: the shards' first words; hot, pairs: see ``Hot.here``."""
        n = int(bounds[-1])
        self.before, first = _before(places, sizes, n)
        common = np.full(n + 1, -1, np.int64)
        common[hot[hot >= 0]] = np.flatnonzero(hot >= 0)
        common[n] = len(hot)
        home = np.append(np.searchsorted(bounds, np.arange(n), "right") - 1, 0)
        self.common = common[self.before]
        c = self.common
        shard = np.where(c < 0, home[self.before], home[places])
        context = np.where(c < 0, self.before - bounds[home[self.before]], c)
        bits = max(n, len(hot) + 1).bit_length()
        group, of_pair = np.unique((shard * 2 + (c >= 0)) << bits | context, return_inverse=True)
        del shard, context
        of_pair <<= bits
        of_pair |= places
        pair, of_pair = np.unique(of_pair, return_inverse=True)
        self.of2 = of_pair.astype(np.int32)
        group = group[pair >> bits]
        self.word, self.context = pair & ((1 << bits) - 1), group & ((1 << bits) - 1)
        self.is_common, self.shard = (group >> bits) & 1 == 1, group >> (bits + 1)
        inner = np.ones(len(places), bool)
        inner[first] = False
        t = np.flatnonzero(inner)
        key = np.where((pairs >= 0).all(axis=1), pairs[:, 0] * (n + 1) + pairs[:, 1], -1)
        which = _which(self.before[t - 1] * (n + 1) + places[t - 1], key)
        self.tokens3, self.tokens_hot, self.pair_hot_of = t[which < 0], t[which >= 0], which[which >= 0]
        triple, of_triple = np.unique(of_pair[self.tokens3 - 1] << bits | places[self.tokens3], return_inverse=True)
        self.of3 = of_triple.astype(np.int32)
        del of_pair, of_triple
        self.parent3, self.word3 = triple >> bits, triple & ((1 << bits) - 1)
        width = max(1, len(pairs))
        triple, self.of_hot = np.unique((home[places[self.tokens_hot]] * width + self.pair_hot_of) << bits | places[self.tokens_hot], return_inverse=True)
        self.word_hot, self.pair_hot, self.shard_hot = triple & ((1 << bits) - 1), (triple >> bits) % width, (triple >> bits) // width


def _open(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return _unzip(row["places"], np.uint32).astype(np.int64), _unzip(row["sizes"], np.int32).astype(np.int64)


def _trained(row: dict, sizes: np.ndarray) -> np.ndarray:
    return np.repeat(np.unpackbits(np.frombuffer(row["train"], np.uint8), count=len(sizes)).astype(bool), sizes)


def _count_hot(batches: Iterator[pa.RecordBatch], hot: Hot) -> Iterator[pa.RecordBatch]:
    """(k, n): how often each common word, then the start, then each common pair is a context in training."""
    for b in batches:
        for i in range(b.num_rows):
            (row,) = b.slice(i, 1).to_pylist()
            words = np.frombuffer(row["words"], np.uint64)
            places, sizes = _open(row)
            train = _trained(row, sizes)
            at_words, at_pairs = hot.here(words)
            n = np.bincount(places[train], minlength=len(words))
            before, first = _before(places, sizes, len(words))
            key = np.where((at_pairs >= 0).all(axis=1), at_pairs[:, 0] * (len(words) + 1) + at_pairs[:, 1], -1)
            pair = _which((before * (len(words) + 1) + places)[train], key)
            out = np.concatenate([np.where(at_words >= 0, n[at_words], 0), [train[first].sum()], np.bincount(pair[pair >= 0], minlength=len(key))])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out, pa.int64())], names=["k", "n"])


def _three(x: np.ndarray) -> bytes:
    """24-bit numbers in three bytes each."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]).tobytes()


def _of_three(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 3, 4), np.uint8)
    out[:, :3] = np.frombuffer(x, np.uint8).reshape(-1, 3)
    return out.view("<u4").ravel()


MESSAGE = ("words", "word_n", "home", "common", "prints2", "n2", "many3", "prints3", "n3", "many_hot", "prints_hot", "n_hot")
ASKED = "shard int, batch long, " + ", ".join(f"{c} binary" for c in MESSAGE)


def _ask(batches: Iterator[pa.RecordBatch], bits: int, hot: Hot) -> Iterator[pa.RecordBatch]:
    count = lambda x, n: np.bincount(x, minlength=n).astype(np.uint32)
    for b in batches:
        for i in range(b.num_rows):
            (row,) = b.slice(i, 1).to_pylist()
            words = np.frombuffer(row["words"], np.uint64)
            places, sizes = _open(row)
            train = _trained(row, sizes)
            edges = (np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(1, np.uint64)
            bounds = np.append(np.searchsorted(words, edges), len(words))
            g = Grams(places, sizes, bounds, *hot.here(words))
            word_n = count(places[train], len(words))
            n2, n3, n_hot = count(g.of2[train], len(g.word)), count(g.of3[train[g.tokens3]], len(g.word3)), count(g.of_hot[train[g.tokens_hot]], len(g.word_hot))
            prints = W.mix(words)
            shards = np.arange((1 << bits) + 1)
            cuts, cuts_hot = np.searchsorted(g.shard, shards), np.searchsorted(g.shard_hot, shards)
            cuts3 = np.searchsorted(g.parent3, cuts)
            out = []
            for s in range(1 << bits):
                w, e, t, h = (slice(x[s], x[s + 1]) for x in (bounds, cuts, cuts3, cuts_hot))
                if w.start == w.stop and e.start == e.stop and h.start == h.stop:
                    continue
                c = g.is_common[e]
                values = (
                    words[w].tobytes(), _zip(word_n[w]), _zip(count(g.context[e][~c], w.stop - w.start)), _zip(count(g.context[e][c], len(hot.words) + 1)), prints[g.word[e]].astype(np.uint32).tobytes(), _zip(n2[e]),
                    _zip(count(g.parent3[t] - e.start, e.stop - e.start)), _three(prints[g.word3[t]] >> np.uint64(40)), _zip(n3[t]), _zip(count(g.pair_hot[h], len(hot.pairs))), _three(prints[g.word_hot[h]] >> np.uint64(40)), _zip(n_hot[h]),
                )
                out.append((s, row["batch"], *values))
            kinds = [pa.int32(), pa.int64(), *[pa.binary()] * len(MESSAGE)]
            for k in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out[k : k + 64], strict=True), kinds, strict=True)], names=["shard", "batch", *MESSAGE])


def _messages(table: pa.Table) -> Iterator[dict]:
    """The messages to a shard, unpacked one at a time."""
    for r in table.to_batches(max_chunksize=16):
        for m in r.to_pylist():
            yield {
                "batch": m["batch"], "words": np.frombuffer(m["words"], np.uint64), "prints2": np.frombuffer(m["prints2"], np.uint32), "prints3": _of_three(m["prints3"]), "prints_hot": _of_three(m["prints_hot"]),
                **{c: _unzip(m[c], np.uint32).astype(np.int64) for c in ("word_n", "home", "common", "n2", "many3", "n3", "many_hot", "n_hot")},
            }


def _summed(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their counts, and which one each key is."""
    known, back = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_inverse=True)
    return known, np.bincount(back, np.concatenate([np.zeros(0), *n]), len(known)), back


def train_shard(table: pa.Table, hot: Hot, hot_n: np.ndarray) -> tuple[bytes, bytes, dict]:
    """A shard's trie, that of the common pairs, and its shares of N, V and the words after each common context."""
    contexts = np.append(hot.words, np.uint64(START))
    words, word_n, groups = [], [], []
    for m in _messages(table):
        words.append(m["words"][m["word_n"] > 0])
        word_n.append(m["word_n"][m["word_n"] > 0])
        groups.append(np.concatenate([m["words"][m["home"] > 0], contexts[m["common"] > 0]]))
    known, place = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(place, np.concatenate(word_n), len(known)).astype(np.uint64)
    level = np.unique(np.concatenate([known, *groups]))
    counts = np.zeros(len(level), np.uint64)
    counts[np.searchsorted(level, known)] = total
    keys2, n2, keys_hot, n_hot = [], [], [], []
    for m in _messages(table):
        rank = np.repeat(np.searchsorted(level, np.concatenate([m["words"], contexts])), np.concatenate([m["home"], m["common"]]))
        some = m["n2"] > 0
        keys2.append((rank << 32 | m["prints2"])[some])
        n2.append(m["n2"][some])
        some = m["n_hot"] > 0
        keys_hot.append((np.repeat(np.arange(len(hot.pairs)), m["many_hot"]) << 24 | m["prints_hot"])[some])
        n_hot.append(m["n_hot"][some])
    pairs, pair_n, back = _summed(keys2, n2)
    keys3, n3, done = [], [], 0
    for m in _messages(table):
        some = m["n2"] > 0
        node = np.full(len(some), -1)
        node[some] = back[done : done + int(some.sum())]
        done += int(some.sum())
        some = m["n3"] > 0
        keys3.append((np.repeat(node, m["many3"]) << 24 | m["prints3"])[some])
        n3.append(m["n3"][some])
    triples, triple_n, _ = _summed(keys3, n3)

    def probabilities(context: np.ndarray, n: np.ndarray, size: int, given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(successors of each context, discounted probabilities, back-off weights); ``given`` has counts of contexts that aren't whole here."""
        many, all_ = np.bincount(context, minlength=size), np.bincount(context, n, size)
        all_ = all_ if given is None else np.where(given > 0, given, all_)
        return many, (n - DISCOUNT) / all_[context], np.where(all_ > 0, DISCOUNT * many / np.maximum(all_, 1), 0)

    given = np.zeros(len(level))
    there = np.searchsorted(level, contexts)
    here = np.append(level, np.uint64(0))[there] == contexts
    given[there[here]] = hot_n[: len(contexts)][here]
    many2, p2, weights = probabilities(pairs >> 32, pair_n, len(level), given)
    many3, p3, weights2 = probabilities(triples >> 24, triple_n, len(pairs))
    packed = Trie.pack(level, counts, weights, many2, pairs & 0xFFFFFFFF, p2, weights2, many3, triples & 0xFFFFFF, p3)
    of_hot, n, _ = _summed(keys_hot, n_hot)
    size = len(hot.pairs)
    many, p, _ = probabilities(of_hot >> 24, n, size, hot_n[len(contexts) :])
    none = np.zeros(0)
    packed_hot = Trie.pack(np.arange(size), np.zeros(size), np.zeros(size), many, of_hot & 0xFFFFFF, p, np.zeros(len(p)), np.zeros(len(p), np.int64), none, none)
    return packed, packed_hot, {"n": int(total.sum()), "v": len(known), "after": np.concatenate([np.where(here, np.append(many2, 0)[there], 0), many]).astype(np.int64)}


ANSWER = ("counts", "weights", "pairs", "pair_weights", "triples", "hot")
ANSWERED = "batch long, shard int, n long, v long, after array<long>, trie_bytes long, " + ", ".join(f"{c} binary" for c in ANSWER)


def _answer(table: pa.Table, hot: Hot, hot_n: np.ndarray) -> pa.Table:
    packed, packed_hot, share = train_shard(table, hot, hot_n)
    trie, common = Trie(packed), Trie(packed_hot)
    contexts = np.append(hot.words, np.uint64(START))
    shard = table.column("shard")[0].as_py()
    rows = [(-1, shard, share["n"], share["v"], share["after"].tolist(), len(packed), *[b""] * len(ANSWER))]
    own = trie.ranks(contexts)
    for m in _messages(table):
        nodes = trie.ranks(m["words"])
        pairs = trie.children(2, np.concatenate([nodes, own]), m["prints2"], np.concatenate([m["home"], m["common"]]))
        triples = trie.children(3, pairs, m["prints3"], m["many3"])
        after = common.children(2, np.arange(len(hot.pairs)), m["prints_hot"], m["many_hot"])
        found = (at(trie.counts, nodes), at(trie.weights, nodes), at(trie.pairs, pairs), at(trie.pair_weights, pairs), at(trie.triples, triples), at(common.pairs, after))
        rows.append((m["batch"], shard, 0, 0, [], 0, *map(_zip, found)))
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), *[pa.binary()] * len(ANSWER)]
    names = ["batch", "shard", "n", "v", "after", "trie_bytes", *ANSWER]
    return pa.table([pa.array(v, kind) for v, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def weight(codes: np.ndarray) -> np.ndarray:
    """Back-off weights of codes; a context that training hasn't leaves all to the shorter one."""
    return np.where(codes > 0, CODEBOOK[codes], 1.0)


def _score(batch: pa.Table, answers: pa.Table, shards: int, n: int, v: int, hot_weights: np.ndarray) -> pa.Table:
    """hot_weights: codes of the common words', the start's and the common pairs' back-off weights."""
    out = []
    for i in range(batch.num_rows):
        (row,) = batch.slice(i, 1).to_pylist()
        places, sizes = _open(row)
        found: dict[str, list] = {c: [np.zeros(0, np.uint64 if c == "counts" else np.uint8)] * shards for c in ANSWER}
        for part in answers.to_batches(max_chunksize=16):
            for c in ANSWER:
                for s, x in zip(part.column("shard").to_pylist(), part.column(c), strict=True):
                    found[c][s] = _unzip(x.as_buffer(), np.uint64 if c == "counts" else np.uint8)
        bounds = np.append(0, np.cumsum([len(x) for x in found["counts"]]))
        joined = {c: np.concatenate(x) for c, x in found.items()}
        hot = np.array(row["hot"], np.int64)
        g = Grams(places, sizes, bounds, hot, np.array(row["hot_pairs"], np.int64).reshape(-1, 2))
        c = joined["counts"][places].astype(np.float64)
        uni = (c + 1) / (n + v + 1)
        p = CODEBOOK[joined["pairs"][g.of2]] + weight(np.where(g.common >= 0, hot_weights[g.common], np.append(joined["weights"], np.uint8(0))[g.before])) * uni
        t, h = g.tokens3, g.tokens_hot
        p[t] = CODEBOOK[joined["triples"][g.of3]] + weight(joined["pair_weights"][g.of2[t - 1]]) * p[t]
        p[h] = CODEBOOK[joined["hot"][g.of_hot]] + weight(hot_weights[len(hot) + 1 + g.pair_hot_of]) * p[h]
        first = np.cumsum(sizes) - sizes
        out.append(pa.table([
            pa.array(row["ids"], pa.int64()), pa.array([held_out(i) for i in row["ids"]]), pa.array(sizes), pa.array(np.add.reduceat((c > 0).astype(np.int64), first)),
            pa.array(np.add.reduceat(np.log10(uni), first)), pa.array(np.add.reduceat(np.log10(p), first)),
        ], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"]))
    return pa.concat_tables(out)


def _placed(batches: Iterator[pa.RecordBatch], hot: Hot) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [hot.here(np.frombuffer(w, np.uint64)) for w in b.column("words").to_pylist()]
        lists = [pa.array([x[k].ravel().tolist() for x in found], pa.list_(pa.int64())) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("batch", "ids", "sizes", "places")), *lists], names=["batch", "ids", "sizes", "places", "hot", "hot_pairs"])


def score(docs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """SCORES and train_tokens for each document; the training documents are those not held out."""
    made = written(docs.select("doc_id", "text").mapInArrow(_batches, BATCHES), "op9-batches")
    total = made.agg(F.sum("tokens")).first()[0] or 0
    bits = max(3, int(total // shard_tokens).bit_length())
    common = made.select(F.explode("common").alias("c")).groupBy("c.u", "c.w").agg(F.sum("c.n").alias("n")).where(F.col("n") >= max(2.0, HOT * total)).select("u", "w").collect()
    own = np.sort(np.array([r.w for r in common if r.u is None], np.int64).view(np.uint64))
    hot = Hot(own, np.array(sorted((r.u, r.w) for r in common if r.u is not None), np.int64).view(np.uint64))
    hot_n = np.zeros(len(own) + 1 + len(hot.pairs))
    for r in made.select("train", "sizes", "words", "places").mapInArrow(lambda it: _count_hot(it, hot), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        hot_n[r.k] = r.n
    asked = made.select("batch", "train", "sizes", "words", "places").mapInArrow(lambda it: _ask(it, bits, hot), ASKED)
    answers = written(asked.groupBy("shard").applyInArrow(lambda t: _answer(t, hot, hot_n), ANSWERED), "op9-answers")
    meta = answers.where("batch = -1")
    sums = meta.agg(F.sum("n").alias("n"), F.sum("v").alias("v")).first()
    n, v = sums.n or 0, sums.v or 0
    after = np.zeros(len(hot_n))
    for r in meta.select(F.posexplode("after").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
        after[r.k] = r.n
    hot_weights = quantise(np.where(hot_n > 0, DISCOUNT * after / np.maximum(hot_n, 1), 0))
    left = made.select("batch", "ids", "sizes", "words", "places").mapInArrow(lambda it: _placed(it, hot), "batch long, ids array<long>, sizes binary, places binary, hot array<long>, hot_pairs array<long>")
    right = answers.where("batch >= 0").select("batch", "shard", *ANSWER)
    shards = 1 << bits
    scored = left.groupBy("batch").cogroup(right.groupBy("batch")).applyInArrow(lambda a, b: _score(a, b, shards, n, v, hot_weights), SCORES)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_elias_fano_lm(docs: DataFrame) -> DataFrame:
    return score(docs)
