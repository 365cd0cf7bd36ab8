"""Words, word hashes and window hashes of Arrow string columns, in whole-array NumPy steps.

Hashes are polynomials modulo 2**64 over prefix sums, mixed afterwards, so that a window's hash costs two lookups
whatever its length. A chunk's hashes travel as sorted unique numbers, as byte planes of their differences: the high
planes are nearly all zero, and the shuffle's compression takes them away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SEGMENT = 1 << 18


def _table(extra: list[tuple[int, int]]) -> np.ndarray:
    t = np.ones(256, dtype=bool)
    for a, b in extra:
        t[a : b + 1] = False
    return t


#: Bytes of words `[^\x20\x09-\x0D]+`.
PLAIN = _table([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z.
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


class Base:
    """Powers of an odd number and of its inverse modulo 2**64, as long as any caller has needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            up, down = np.full(n, self.base, dtype=U), np.full(n, self.inverse, dtype=U)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
        return self.up, self.down


BYTES = Base(0x9E3779B97F4A7C15)
WORDS = Base(0xC2B2AE3D27D4EB4F)
WORDS2 = Base(0xD6E8FEB86659FD93)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    h = h ^ U(salt)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the rows' offsets; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    return raw, off - off[0]


class Words:
    """The words of some texts: byte ranges, 64-bit hashes, and bounds[i]:bounds[i+1] for text i."""

    def __init__(self, column, kind: np.ndarray = PLAIN, lower: bool = False):
        self.data, self.offsets = buffers(column)
        if lower:
            self.data = LOWER[self.data]
        is_word = kind[self.data]
        n = len(is_word)
        first = is_word.copy()
        first[1:] &= ~is_word[:-1]
        cut = self.offsets[1:-1]
        cut = cut[cut < n]
        first[cut] = is_word[cut]
        last = is_word.copy()
        last[:-1] &= ~is_word[1:]
        cut = cut[cut > 0] - 1
        last[cut] = is_word[cut]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.n = len(self.starts)
        self.hashes = self._hash()

    def _hash(self) -> np.ndarray:
        out = np.empty(self.n, dtype=U)
        k = 0
        while k < self.n:
            a = self.starts[k]
            j = max(k + 1, int(np.searchsorted(self.ends, a + SEGMENT, side="right")))
            b = self.ends[j - 1]
            up, down = BYTES.get(int(b - a) + 1)
            sums = np.zeros(b - a + 1, dtype=U)
            np.cumsum((self.data[a:b].astype(U) + U(1)) * up[: b - a], out=sums[1:])
            s, e = self.starts[k:j] - a, self.ends[k:j] - a
            out[k:j] = (sums[e] - sums[s]) * down[s]
            k = j
        return mix(out)

    def rows(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def places(self) -> np.ndarray:
        """Each word's place in its text."""
        return np.arange(self.n) - np.repeat(self.bounds[:-1], np.diff(self.bounds))

    def left(self) -> np.ndarray:
        """How many words there are from each word to its text's end."""
        return np.repeat(self.bounds[1:], np.diff(self.bounds)) - np.arange(self.n)

    def windows(self, length: int, base: Base = WORDS, salt: int = 0) -> np.ndarray:
        """Hash of `length` words from each word on; right where left() >= length."""
        n = self.n
        up, down = base.get(n + 1)
        sums = np.zeros(n + 1, dtype=U)
        np.cumsum((mix(self.hashes, salt) if salt else self.hashes) * up[:n], out=sums[1:])
        out = np.zeros(n, dtype=U)
        if n >= length:
            out[: n - length + 1] = mix((sums[length:] - sums[: n - length + 1]) * down[: n - length + 1], length)
        return out

    def sequences(self) -> np.ndarray:
        """One hash for all of each text's words."""
        up, down = WORDS.get(self.n + 1)
        sums = np.zeros(self.n + 1, dtype=U)
        np.cumsum(self.hashes * up[: self.n], out=sums[1:])
        a, b = self.bounds[:-1], self.bounds[1:]
        return mix((sums[b] - sums[a]) * down[a], 0) ^ mix((b - a).astype(U), 99)


def pack(values: np.ndarray, width: int) -> bytes:
    """Sorted numbers as `width` byte planes of their differences."""
    if not len(values):
        return b""
    d = np.empty(len(values), dtype="<u8")
    d[0] = values[0]
    np.subtract(values[1:], values[:-1], out=d[1:])
    return np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(blob: bytes, width: int) -> np.ndarray:
    n = len(blob) // width
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(blob, dtype=np.uint8).reshape(width, n).T
    return np.cumsum(out.reshape(-1).view("<u8"), dtype=U)


def bits(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def unbits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, dtype=np.uint8), count=n).astype(bool)


def edges(values: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted values."""
    if not len(values):
        return np.zeros(0, dtype=np.int64)
    return np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))


def cuts(values: np.ndarray, buckets: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted values of `width` bytes fall in, equal ranges of them, and where each begins and ends."""
    shift = U(8 * width - 32)
    b = ((values >> shift) * U(buckets)) >> U(32)
    at = edges(b)
    return b[at].astype(np.int64), np.append(at, len(values))


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted known ones."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    i = np.searchsorted(known, values)
    i[i == len(known)] = 0
    return known[i] == values


class Spans(Words):
    """The words of some texts without hashes: byte ranges, and bounds[i]:bounds[i+1] for text i."""

    def _hash(self) -> None:
        return None

    def strings(self, pick: np.ndarray | None = None) -> pa.Array:
        """The words themselves, or those picked."""
        starts, ends = (self.starts, self.ends) if pick is None else (self.starts[pick], self.ends[pick])
        size = ends - starts
        offsets = np.zeros(len(starts) + 1, dtype=np.int64)
        np.cumsum(size, out=offsets[1:])
        step = np.zeros(len(self.data) + 1, dtype=np.int8)
        step[starts] += 1
        step[ends] -= 1
        data = self.data[np.cumsum(step[:-1], dtype=np.int8).view(bool)]
        return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def pieces(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows with about `size` bytes of the text column, at least a row each."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right")))
        yield batch.slice(at, to - at)
        at = to
