"""Benchmark passages in training texts, by an FM-index for each shard of the training table.

A shard is a bounded run of a partition's rows. Its words that occur in no test phrase can be part of no match, so each
run of them is one separator; the other words are symbols. The shard's suffix array (by prefix doubling, only suffixes
that still tie are sorted again), the Burrows-Wheeler transform in a wavelet matrix, and every eighth suffix position make
the index. All test phrases are searched backwards at once, their occurrences are located through the sampled positions,
and the words they cover are merged to spans.

Texts never move: the phrases do. They are a stated query set, sent in blocks of at most `block_bytes` of benchmark text;
each block is one more pass of the same rows through Python within the same stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernel as K
from .common import Scratch, table, text_bytes
from .memory import lean

WINDOW = 10
SAMPLE = 8
SHARD_BYTES = 4 << 20
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("first_byte", pa.int64()), ("last_byte", pa.int64())]))
FOUND = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("spans", SPANS), ("items", pa.list_(pa.string()))])
FOUND_SQL = "doc_id long, text string, n_words long, spans array<struct<start:long,end:long,first_byte:long,last_byte:long>>, items array<string>"
CARRIED = "row"


class Bits:
    """Bits with the count of ones before any place."""

    def __init__(self, mask: np.ndarray):
        packed = np.packbits(mask, bitorder="little")
        self.words = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(K.U)) & K.U(1) == 1

    def rank(self, i: np.ndarray) -> np.ndarray:
        below = (K.U(1) << (i & 63).astype(K.U)) - K.U(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below).astype(np.int64)


class Wavelet:
    """A wavelet matrix: one row of bits for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, kinds: int):
        self.rows, self.zeros = [], []
        for level in range(max(1, (kinds - 1).bit_length()) - 1, -1, -1):
            bit = (symbols >> level) & 1 == 1
            self.rows.append(Bits(bit))
            self.zeros.append(len(bit) - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before place i."""
        start = np.zeros_like(i)
        for level, (row, zeros) in enumerate(zip(self.rows, self.zeros, strict=True)):
            one = (symbol >> (len(self.rows) - 1 - level)) & 1 == 1
            a, b = row.rank(start), row.rank(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def get(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for row, zeros in zip(self.rows, self.zeros, strict=True):
            one, r = row.get(i), row.rank(i)
            out = (out << 1) | one
            i = np.where(one, zeros + r, i - r)
        return out


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes of a text in order; each 0 in it is a separator of its own, and the last symbol is one."""
    n, is_sep = len(text), text == 0
    before = np.cumsum(is_sep) - is_sep
    bits, wide = int(text.max()).bit_length() or 1, int(before[-1] + 1).bit_length()
    many = max(1, min(8, (63 - wide) // bits))
    key, open_, which = np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool), np.zeros(n, dtype=np.int64)
    padded, place = np.concatenate([text, np.zeros(many, text.dtype)]).astype(np.int64), np.concatenate([before, np.full(many, before[-1])])
    for j in range(many):
        s = padded[j : j + n]
        key = (key << bits) | np.where(open_, s, 0)
        end = open_ & (s == 0)
        which[end] = place[j : j + n][end] + 1
        open_ &= ~end
    key = (key << wide) | which
    order = np.argsort(key)
    rank = np.empty(n, dtype=np.int64)
    new = K.edges(key[order])
    size = np.diff(np.append(new, n))
    rank[order] = np.repeat(new, size)
    at = np.flatnonzero(np.repeat(size > 1, size))
    k = many
    while len(at):
        i = order[at]
        key = rank[i] * (n + 1) + rank[i + k]
        o = np.argsort(key)
        i, key = i[o], key[o]
        order[at] = i
        new = K.edges(key)
        size = np.diff(np.append(new, len(at)))
        rank[i] = np.repeat(at[new], size)
        at = at[np.repeat(size > 1, size)]
        k *= 2
    return order


class FMIndex:
    def __init__(self, text: np.ndarray, kinds: int):
        order = suffix_array(text)
        bwt = text[order - 1]
        self.tree = Wavelet(bwt, kinds)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=kinds), dtype=np.int64)))
        kept = (order % SAMPLE == 0) | (bwt == 0)
        self.kept, self.places = Bits(kept), order[kept]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases (right-aligned rows of symbols) that occur, and the place of each occurrence: two equally long arrays."""
        which = np.arange(len(phrases))
        c = phrases[:, -1]
        lo, hi = self.first[c], self.first[c + 1]
        done = []
        for step in range(1, phrases.shape[1] + 1):
            alive = hi > lo
            which, lo, hi = which[alive], lo[alive], hi[alive]
            over = sizes[which] == step
            done.append((which[over], lo[over], hi[over]))
            which, lo, hi = which[~over], lo[~over], hi[~over]
            if not len(which):
                break
            c = phrases[which, phrases.shape[1] - 1 - step]
            lo, hi = self.first[c] + self.tree.rank(c, lo), self.first[c] + self.tree.rank(c, hi)
        which, lo, hi = (np.concatenate(x) for x in zip(*done, strict=True))
        n = hi - lo
        rows = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
        return np.repeat(which, n), self.locate(rows)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, at, walked = np.zeros(len(rows), dtype=np.int64), np.arange(len(rows)), 0
        while len(at):
            found = self.kept.get(rows)
            out[at[found]] = self.places[self.kept.rank(rows[found])] + walked
            at, rows = at[~found], rows[~found]
            c = self.tree.get(rows)
            rows = self.first[c] + self.tree.rank(c, rows)
            walked += 1
        return out


class Phrases:
    """The distinct windows of some benchmark items as rows of symbols, and the items of each."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        words = K.Words(pa.array([t for _, t in items], type=pa.large_string()), K.ALNUM, lower=True)
        self.known, symbol = np.unique(words.hashes, return_inverse=True)
        symbol = symbol + 1
        of: dict[tuple, set[str]] = {}
        for (item, _), a, b in zip(items, words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
            own = symbol[a:b].tolist()
            for i in range(max(1, len(own) - window + 1)) if own else ():
                of.setdefault(tuple(own[i : i + window]), set()).add(item)
        self.sizes = np.array([len(p) for p in of], dtype=np.int64)
        self.symbols = np.zeros((len(of), window), dtype=np.int64)
        for row, p in zip(self.symbols, of, strict=True):
            row[window - len(p) :] = p
        self.items = [sorted(x) for x in of.values()]

    def find(self, words: K.Words) -> tuple[np.ndarray, np.ndarray]:
        """Phrases and the word at which each occurrence begins."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.known) or not words.n:
            return none
        i = np.minimum(np.searchsorted(self.known, words.hashes), len(self.known) - 1)
        own = np.flatnonzero(self.known[i] == words.hashes)
        if not len(own):
            return none
        begins = np.zeros(words.n + 1, dtype=bool)
        begins[words.bounds[:-1]] = True
        parted = (own[1:] != own[:-1] + 1) | begins[own[1:]]
        place = np.arange(len(own)) + np.concatenate(([0], np.cumsum(parted)))
        text, word = np.zeros(place[-1] + 2, dtype=np.int64), np.zeros(place[-1] + 2, dtype=np.int64)
        text[place], word[place] = i[own] + 1, own
        which, at = FMIndex(text, len(self.known) + 1).search(self.symbols, self.sizes)
        return which, word[at]


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `most` bytes of text, or one longer row."""
    for batch in batches:
        _, off = K.buffers(batch.column("text"))
        i = 0
        while i < len(batch):
            j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
            yield batch.slice(i, j - i)
            i = j


def _scan(phrases: Phrases, first: bool, last: bool):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _shards(batches, SHARD_BYTES):
            words = K.Words(batch.column("text"), K.ALNUM, lower=True)
            which, at = phrases.find(words)
            doc = np.searchsorted(words.bounds, at, side="right") - 1
            hit = np.zeros(words.n, dtype=bool)
            before = [(None, ())] * len(batch) if first else list(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True))
            for a, (spans, _) in zip(words.bounds[:-1].tolist(), before, strict=True):
                for s in spans or ():
                    hit[a + s["start"] : a + s["end"]] = True
            step = np.zeros(words.n + 1, dtype=np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + phrases.sizes[which], -1)
            hit |= np.cumsum(step)[:-1] > 0
            found: dict[int, set] = {i: set(x) for i, (_, x) in enumerate(before) if x}
            for d, w in np.unique(np.stack([doc, which], axis=1), axis=0).tolist():
                found.setdefault(d, set()).update(phrases.items[w])
            spans = [[] for _ in range(len(batch))]
            edge = np.zeros(words.n + 1, dtype=bool)
            edge[words.bounds[:-1]] = True
            start = np.flatnonzero(hit & ~np.concatenate(([False], hit[:-1])) | hit & edge[:-1])
            end = np.flatnonzero(hit & ~np.concatenate((hit[1:], [False])) | hit & edge[1:] ) + 1
            for s, e, d in zip(start.tolist(), end.tolist(), (np.searchsorted(words.bounds, start, side="right") - 1).tolist(), strict=True):
                a = int(words.bounds[d])
                spans[d].append({"start": s - a, "end": e - a, "first_byte": int(words.starts[s] - words.offsets[d]), "last_byte": int(words.ends[e - 1] - words.offsets[d])})
            carried = [n for n in batch.schema.names if n == CARRIED]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.nulls(len(batch), pa.string()) if last else batch.column("text"),
                    pa.array(np.diff(words.bounds)),
                    pa.array(spans, type=SPANS),
                    pa.array([sorted(found.get(i, ())) for i in range(len(batch))], type=pa.list_(pa.string())),
                    *map(batch.column, carried),
                ],
                schema=pa.schema([*FOUND, *map(batch.schema.field, carried)]),
            )

    return scan


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, with_text: bool = False, block_bytes: int = 16 << 20, carry: bool = False) -> DataFrame:
    """Per row of docs (doc_id, text, others unread): its words, the spans of words that occur in a benchmark item, and those items.

    Words are runs of lower-cased letters, digits and all that is not ASCII. A phrase is `window` consecutive words of an
    item; an item of fewer is one phrase. Null or empty texts and items have no words; an item without an id goes by the
    empty string; equal items are found together; with no items nothing is hit; an empty table gives no rows. With
    `carry` a column `row` holds all of the row's own columns, whatever their names.
    """
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(CARRIED)] * carry
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *whole)
    schema = T.StructType.fromDDL(FOUND_SQL)
    if carry:
        schema = schema.add(docs.schema[CARRIED])
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    blocks = max(1, -(-text_bytes(items) // block_bytes))
    scratch = Scratch(docs.sparkSession)
    for b in range(blocks):
        # One block of items at a time is on the driver and in the workers; what is found with it is written before the next.
        own = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toLocalIterator()]
        docs = docs.mapInArrow(lean(_scan(Phrases(own, window), b == 0, b == blocks - 1 and not with_text)), schema)
        if b < blocks - 1:
            before, docs = docs, scratch.write(docs)
            scratch.drop(before)
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with benchmark passages cut out of the texts, all columns kept; rows of which no word is left go."""
    found = find_leaks(docs, benchmark, window, with_text=True, carry=True)
    text = F.when(F.size("spans") > 0, _without(found)).otherwise(F.col("text"))
    found = found.where((F.size("spans") == 0) | (_hits() < F.col("n_words")))
    return found.select(*[text.alias(c) if c == "text" else F.col(f"{CARRIED}.`{c}`").alias(c) for c in docs.columns])


def _hits():
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def _without(found: DataFrame):
    raw = F.col("text").cast("binary")
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("spans", lambda s: s["last_byte"]))
    starts = F.concat(F.transform("spans", lambda s: s["first_byte"]), F.array(F.octet_length("text").cast("long")))
    pieces = F.zip_with(ends, starts, lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string"))
    return F.array_join(pieces, "")


def op2_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", _hits().alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))
