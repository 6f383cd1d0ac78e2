"""Words of Arrow text columns as 64-bit hashes, computed over whole byte buffers."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_R = np.uint64(0x9E3779B97F4A7C15)

#: Bytes that end a word: ASCII white space, or all ASCII but letters and digits. Other bytes, all of UTF-8's above 127 among them, are in words.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
PUNCT = np.zeros(256, bool)
PUNCT[:128] = True
PUNCT[48:58] = PUNCT[65:91] = PUNCT[97:123] = False

#: Bytes of text handled at once; a longer text is handled alone.
CHUNK = 4 << 20
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1024) - 1, _R)]), dtype=np.uint64)
    return _powers


def parts(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most CHUNK bytes of text each, one row at least."""
    sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    ends, at = np.cumsum(sizes), 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + CHUNK, "right")))
        yield batch.slice(at, to - at)
        at = to


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and where each row starts (one more entry than rows); a null is empty."""
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32, len(col) + 1, col.offset * (8 if wide else 4)).astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2]
    bytes_ = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return bytes_, offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, length of each word; where each row's words start). ``ends`` marks the bytes between words."""
    inside = ~ends[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    start[edge] = inside[edge]
    first = np.flatnonzero(start)
    rows = np.searchsorted(first, offsets)
    if not len(first):
        return np.zeros(0, np.uint64), first, first, rows
    at = np.flatnonzero(inside)
    lead = np.flatnonzero(start[at])
    length = np.diff(np.append(lead, len(at)))
    place = np.arange(len(at)) - np.repeat(lead, length)
    value = _BYTE[data[at]] * _power(int(length.max()))[place]
    return mix(np.add.reduceat(value, lead) + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), first, length, rows


def code_points(data: np.ndarray, offsets: np.ndarray, at: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Byte positions as code-point positions in their rows."""
    count = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return count[at] - count[offsets[row]]


def signed(x: np.ndarray) -> np.ndarray:
    """Hashes as Spark longs."""
    return x.astype(np.uint64).view(np.int64)
