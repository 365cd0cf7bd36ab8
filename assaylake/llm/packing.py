"""Packing of documents into fixed-length token sequences along a space-filling curve.

Each document's words are hashed to random signs and added up: a few projected dimensions, in which documents that share
words lie near each other. The place of that point on a Hilbert curve is the sort key. One range shuffle deals the texts
out along the curve (with a hash of the id behind the key, so that a key of many copies is spread over partitions); in each
partition rows are sorted and tokens run on from one document to the next through sequences of `length` tokens. Where the
partition ends, what is left is cut into sequences whose lengths are powers of two, which need no padding.

Tokens are made once, after the shuffle, a document at a time; a partition holds one open sequence in memory.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import shuffle_partitions, table, text_bytes
from .memory import lean

LENGTH = 2048
END = 1
DIMENSIONS = 4
BITS = 8
#: Text that a task packs, at most some times that where one text is longer.
PARTITION_BYTES = 128 << 20
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_SQL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole numbers under 2**bits (transposed axes, then their bits in turn)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def vectors(words: K.Words, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Each text's words as random signs in a few dimensions, summed, by the root of their number."""
    n = np.diff(words.bounds)
    out = np.zeros((len(n), dimensions))
    for d in range(dimensions):
        sums = np.concatenate(([0], np.cumsum(((words.hashes >> K.U(7 * d + 3)) & K.U(1)).astype(np.int64) * 2 - 1)))
        out[:, d] = (sums[words.bounds[1:]] - sums[words.bounds[:-1]]) / np.sqrt(np.maximum(n, 1))
    return out


def curve_keys(words: K.Words, dimensions: int = DIMENSIONS, bits: int = BITS) -> np.ndarray:
    """Hilbert key of each text; coordinates are squeezed to whole numbers by x / (1 + |x|)."""
    v = vectors(words, dimensions)
    cells = np.clip(((v / (1 + np.abs(v)) + 1) / 2 * (1 << bits)).astype(np.int64), 0, (1 << bits) - 1)
    return hilbert(cells, bits)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, len(whole), 1000):
            batch = whole.slice(k, 1000)
            keys = curve_keys(K.Words(batch.column("text"), K.PLAIN, lower=True))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], names=["doc_id", "text", "key"])


class Ids:
    """Token ids (little-endian unsigned 32-bit) of texts, as `tokenizers` makes them from a byte-level BPE file.

    Where the file's merges are in the order of their ids, merging by the lowest id is the same thing; the vocabulary then
    runs in a faster library, and tests hold its ids against those of `tokenizers`. Any other file, and any text that holds a
    string of an added token, which `tokenizers` turns into that token, is left to `tokenizers`.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())
        vocabulary = model["model"].get("vocab", {})
        merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "", 1), -1) for m in model["model"].get("merges", ())]
        split = (model.get("pre_tokenizer") or {}) | {"trim_offsets": None}
        plain = model.get("normalizer") is None and split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": None, "use_regex": True}
        self.fast, self.added = None, [t["content"] for t in model["added_tokens"]]
        if plain and merged and merged == sorted(merged):
            import tiktoken
            from public_tokenizers import PATTERN

            byte = {c: b for b, c in _visible().items()}
            ranks = {bytes(byte[ord(c)] for c in t): i for t, i in vocabulary.items() if t not in self.added}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        fast = self.fast and not any(t in text for t in self.added)
        ids = self.fast.encode_ordinary(text) if fast else self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


def _visible() -> dict[int, int]:
    """The sign that stands for each byte in a byte-level vocabulary: itself where it prints, else the next above 255."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in prints]
    return {b: b for b in prints} | {b: 256 + i for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _ids(path: str) -> Ids:
    """One for all tasks of a worker."""
    return Ids(path)


class Packer:
    """Sequences of one partition: pieces go out as their sequence fills."""

    def __init__(self, first_id: int, length: int):
        self.id, self.length, self.open, self.filled = first_id, length, [], 0

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        n, start = len(ids) // 4, 0
        while start < n:
            take = min(n - start, self.length - self.filled)
            self.open.append((doc, start, ids[4 * start : 4 * (start + take)], n))
            self.filled += take
            start += take
            if self.filled == self.length:
                yield from self._close(self.open)
                self.open, self.filled = [], 0

    def _close(self, pieces: list) -> Iterator[tuple]:
        offset = 0
        for doc, start, ids, n in pieces:
            yield doc, start, len(ids) // 4, zlib.crc32(ids), n, self.id, offset
            offset += len(ids) // 4
        self.id += 1

    def end(self) -> Iterator[tuple]:
        left, rest = self.filled, list(self.open)
        while left:
            size = 1 << (left.bit_length() - 1)
            left -= size
            own = []
            while size:
                doc, start, ids, n = rest.pop(0)
                if len(ids) > 4 * size:
                    rest.insert(0, (doc, start + size, ids[4 * size :], n))
                    ids = ids[: 4 * size]
                own.append((doc, start, ids, n))
                size -= len(ids) // 4
            yield from self._close(own)
        self.open, self.filled = [], 0


def _pack(path: str, length: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, last, out = _ids(path), (None, b""), []
        packer = Packer(TaskContext.get().partitionId() << 40, length)
        stop = np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                if text != last[0]:
                    last = (text, ids.encode(text) + stop)
                out.extend(packer.add(doc, last[1]))
                if len(out) >= 10_000:
                    yield _batch(out)
                    out = []
        out.extend(packer.end())
        yield _batch(out)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [()] * len(PIECES), PIECES, strict=True)], schema=PIECES)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """One row per piece of each row of docs (doc_id, text; other columns are not read).

    A text's ids and then `end` are cut at sequence ends only; each id lies in one piece. Null and empty texts are the one id
    `end`. Rows that repeat are packed as often as they are there; a null id stays null; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.mapInArrow(lean(_keyed), T.StructType([*rows.schema.fields, T.StructField("key", T.LongType())]))
    spread = keyed.withColumn("salt", F.xxhash64("doc_id"))
    parts = max(shuffle_partitions(docs.sparkSession), -(-text_bytes(rows) // PARTITION_BYTES))
    dealt = spread.repartitionByRange(parts, "key", "salt").sortWithinPartitions("key", "text", "salt", "doc_id")
    return dealt.select("doc_id", "text").mapInArrow(lean(_pack(tokenizer, length, end)), PIECES_SQL)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
