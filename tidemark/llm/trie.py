"""A trigram trie in compact levels: Elias-Fano sequences over flat little-endian buffers, which can be a memory-mapped file.

Level 1 holds words' hashes and exact counts, levels 2 and 3 the successors of each node above as fingerprints relative to it. Every node of
levels 2 and 3 has its smoothed probability, every context its back-off weight, both quantised to a byte. Pointers from one level into the next are
monotone; successors are too, since each context's fingerprints are added to the last number of the context before. A lookup takes the
bounds of a context's range from the pointers and finds the successor within them.
"""

import struct

import numpy as np

#: Codes 1 to 255 are DECADES powers of ten up to 1, at equal ratios; 0 is nothing.
DECADES = 7
_STEPS = 254 / DECADES
CODEBOOK = np.append(0.0, 10.0 ** ((np.arange(1, 256) - 255) / _STEPS))

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.uint8)
_ONES = _BITS.sum(axis=1, dtype=np.uint8)
#: The place of the k-th set bit of each byte.
_PLACE = np.argsort(1 - _BITS, axis=1, kind="stable")


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of numbers in [0, 1]."""
    p = np.asarray(p, np.float64)
    return np.where(p > 0, np.clip(255 + np.rint(np.log10(np.maximum(p, 1e-300)) * _STEPS), 1, 255), 0).astype(np.uint8)


class EliasFano:
    """A non-decreasing sequence of 64-bit numbers. Low bits, in whole bytes, lie side by side; high bits are unary gaps in a bit vector, with the
    number of set bits before each 64 of them, by which the k-th set or clear bit is found without unpacking it."""

    HEAD = struct.Struct("<QQQ")  # numbers, bytes of low bits each, words of the bit vector

    def __init__(self, buffer, at: int = 0) -> None:
        self.n, self.width, words = self.HEAD.unpack_from(buffer, at)
        at += self.HEAD.size
        # eight bytes from each number's low ones on, of which those are taken
        self._low = np.ndarray((self.n,), "<u8", buffer, at, (self.width,)) if self.width else None
        self._mask = np.uint64((1 << 8 * self.width) - 1)
        at += self.n * self.width + 8
        self._bits = np.frombuffer(buffer, np.uint8, 8 * words, at).reshape(words, 8)
        at += 8 * words
        self._ones = np.frombuffer(buffer, "<u4", words, at)
        self._clear = 64 * np.arange(words) - self._ones
        self.end = at + 4 * words

    @classmethod
    def pack(cls, values: np.ndarray) -> bytes:
        values = np.asarray(values).astype(np.uint64)
        n = len(values)
        top = int(values[-1]) + 1 if n else 1
        width = -(-max(0, (top // max(n, 1)).bit_length() - 1) // 8)
        high = (values >> np.uint64(8 * width)).astype(np.int64) if width < 8 else np.zeros(n, np.int64)
        words = ((int(high[-1]) if n else 0) + n + 64) // 64
        bits = np.zeros(64 * words, np.uint8)
        bits[high + np.arange(n)] = 1
        ones = np.append(0, np.cumsum(bits.reshape(words, 64).sum(axis=1)))[:-1].astype("<u4")
        low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width])
        return cls.HEAD.pack(n, width, words) + low.tobytes() + bytes(8) + np.packbits(bits, bitorder="little").tobytes() + ones.tobytes()

    def _select(self, k: np.ndarray, one: bool) -> np.ndarray:
        """The place of the k-th set (or clear) bit, for each k."""
        before = self._ones if one else self._clear
        word = np.searchsorted(before, k, "right") - 1
        rest = (k - before[word]).astype(np.uint8)
        bytes_ = self._bits[word] if one else ~self._bits[word]
        count = np.cumsum(_ONES[bytes_], axis=1, dtype=np.uint8)
        byte = (count <= rest[:, None]).sum(axis=1)
        rows = np.arange(len(k))
        own = bytes_[rows, byte]
        return 64 * word + 8 * byte + _PLACE[own, rest + _ONES[own] - count[rows, byte]]

    def _lows(self, i: np.ndarray) -> np.ndarray:
        return self._low[i] & self._mask if self.width else np.zeros(len(i), np.uint64)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, np.int64)
        if self.width == 8:
            return self._lows(i)
        return ((self._select(i, True) - i).astype(np.uint64) << np.uint64(8 * self.width)) | self._lows(i)

    def find(self, x: np.ndarray, low: np.ndarray, up: np.ndarray) -> np.ndarray:
        """The place of each x within [low, up), -1 where it isn't there. High bits give a short range, which low bits are searched in."""
        x, low, up = np.asarray(x, np.uint64), np.asarray(low, np.int64), np.asarray(up, np.int64)
        if not self.n or not len(x):
            return np.full(len(x), -1)
        want = x
        if self.width < 8:
            last = 64 * len(self._ones) - self.n - 1  # clear bits, but the last
            high = np.minimum(x >> np.uint64(8 * self.width), np.uint64(last + 1)).astype(np.int64)
            want = x & np.uint64((1 << (8 * self.width)) - 1)
            h = np.minimum(high, last)
            low = np.maximum(low, np.where(h > 0, self._select(np.maximum(h - 1, 0), False) - (h - 1), 0))
            up = np.where(high > last, low, np.minimum(up, self._select(h, False) - h))
        place, open_ = low.copy(), np.flatnonzero(low < up)
        low, top = low[open_], up[open_]
        while len(open_):
            mid = (low + top) // 2
            less = self._lows(mid) < want[open_]
            low, top = np.where(less, mid + 1, low), np.where(less, top, mid)
            place[open_] = low
            more = low < top
            open_, low, top = open_[more], low[more], top[more]
        at = np.minimum(place, self.n - 1)
        return np.where((place < up) & (self._lows(at) == want), at, -1)


def _relative(prints: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Fingerprints, n of each context and rising within it, as one monotone sequence."""
    stop = np.cumsum(n)
    last = np.where(n > 0, prints[np.maximum(stop - 1, 0)] if len(prints) else 0, 0).astype(np.uint64)
    return prints.astype(np.uint64) + np.repeat(np.cumsum(last, dtype=np.uint64) - last, n)


class Trie:
    """A shard of the model. ``pack`` makes the flat buffer; reading needs no more than views of it."""

    MAGIC = b"EFTRIE02"

    def __init__(self, buffer) -> None:
        if bytes(buffer[:8]) != self.MAGIC:
            raise ValueError("not a trie")
        self.words = EliasFano(buffer, 8)
        at, self.levels = self.words.end, []
        for _ in (2, 3):
            pointers = EliasFano(buffer, at)
            successors = EliasFano(buffer, pointers.end)
            self.levels.append((pointers, successors))
            at = successors.end
        (_, second), (_, third) = self.levels
        self.counts = np.frombuffer(buffer, "<u8", self.words.n, at)
        at += 8 * self.words.n
        sizes = [self.words.n, second.n, second.n, third.n]
        cuts = np.append(0, np.cumsum(sizes))
        flat = np.frombuffer(buffer, np.uint8, int(cuts[-1]), at)
        #: Back-off weights of words; probabilities and back-off weights of pairs; probabilities of triples.
        self.weights, self.pairs, self.pair_weights, self.triples = (flat[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True))

    @classmethod
    def open(cls, path: str) -> "Trie":
        return cls(np.memmap(path, np.uint8, "r"))

    @classmethod
    def pack(cls, words: np.ndarray, counts: np.ndarray, weights: np.ndarray, n2: np.ndarray, prints2: np.ndarray, p2: np.ndarray, weights2: np.ndarray, n3: np.ndarray, prints3: np.ndarray, p3: np.ndarray) -> bytes:
        """words: sorted distinct hashes; n2, n3: the successors of each node above, whose fingerprints rise within it; p2, p3 and the weights are quantised here."""
        out = [cls.MAGIC, EliasFano.pack(words)]
        for n, prints in ((n2, prints2), (n3, prints3)):
            out += [EliasFano.pack(np.append(0, np.cumsum(n))), EliasFano.pack(_relative(prints, n))]
        return b"".join([*out, counts.astype("<u8").tobytes(), *(quantise(x).tobytes() for x in (weights, p2, weights2, p3))])

    def ranks(self, hashes: np.ndarray) -> np.ndarray:
        """Each word's node, -1 for none."""
        return self.words.find(hashes, np.zeros(len(hashes), np.int64), np.full(len(hashes), self.words.n))

    def children(self, level: int, nodes: np.ndarray, prints: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The nodes of successors on level 2 or 3, -1 for none: n fingerprints for each of the nodes above."""
        pointers, successors = self.levels[level - 2]
        out = np.full(len(prints), -1)
        if not successors.n or not len(prints):
            return out
        at = np.maximum(nodes, 0)
        low, up = pointers.get(at).astype(np.int64), pointers.get(at + 1).astype(np.int64)
        base = np.where(low > 0, successors.get(np.maximum(low - 1, 0)), np.uint64(0))
        low, up, base = (np.repeat(x, n) for x in (low, np.where(nodes >= 0, up, low), base))
        some = np.flatnonzero(low < up)
        out[some] = successors.find(base[some] + prints[some].astype(np.uint64), low[some], up[some])
        return out


def at(values: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """values[nodes], 0 for no node."""
    return np.where(nodes >= 0, values[np.maximum(nodes, 0)], 0) if len(values) else np.zeros(len(nodes), values.dtype)
