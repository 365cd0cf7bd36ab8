"""Spelling variants of words, by bands of letter-parity masks.

A word's mask has a bit for each letter: whether it has an odd number of them. One inserted or deleted letter flips one bit, one
replaced letter two, or none where both letters share a bit. So of three bands of a mask at least one stays as it is: words meet
in the units (band, its value, length), a word of one letter more among them, and pairs whose masks differ as one edit would
have it are verified letter by letter. A pair that agrees in more bands counts in the first.

Plan: words are counted where they are read and summed by Spark. A unit with over `UNIT` entries is cut into blocks, and each pair
of blocks is a unit of its own, so no task holds a hot band value whole; which units those are is at most 3 * 1024 * 58 numbers,
as lengths from 64 on are one. Units stream through sorted partitions, with one unit at a time in memory, and send one row a word.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import Scratch, shuffle_partitions, table
from .memory import lean

LEAST_POINTS, LEAST_SEEN, FORM_TIMES, ONE_IN = 7, 2, 10, 31
#: Bytes of text read at a time, entries of a unit, and the length from which on words share their units.
PIECE, UNIT, LONG = 4 << 20, 1 << 15, 64
BANDS, BAND_BITS = 3, 10
WORDS = pa.schema([("word", pa.string()), ("n", pa.int64())])
ENTRIES = pa.schema([("band", pa.int32()), ("value", pa.int32()), ("size", pa.int32()), ("longer", pa.bool_()), ("mask", pa.int64()), ("word", pa.string()), ("n", pa.int64())])
ENTRIES_SQL = "band int, value int, size int, longer boolean, mask long, word string, n long"
NEAR = pa.schema([("word", pa.string()), ("near", pa.int64()), ("top", pa.int64()), ("form", pa.string())])


class _Letters:
    """Bytes of runs `[A-Za-z\\u00C0-\\u00FF]+`: ASCII letters, and what begins with byte C3."""

    def __getitem__(self, data: np.ndarray) -> np.ndarray:
        lead = data == 0xC3
        out = lead | ((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A)
        out[1:] |= lead[:-1]
        return out


LETTERS = _Letters()
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def _crc32(start: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of data[begin : begin + size], each carried on from its start."""
    order = np.argsort(-size, kind="stable")
    begin, size, out = begin[order], size[order], start[order].astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    k = len(size)
    for at in range(int(size[0]) if k else 0):
        k = int(np.searchsorted(-size[:k], -at, side="left"))
        out[:k] = _CRC[(out[:k] ^ data[begin[:k] + at]) & np.uint32(0xFF)] ^ (out[:k] >> np.uint32(8))
    back = np.empty_like(out)
    back[order] = out ^ np.uint32(0xFFFFFFFF)
    return back


def _strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = K.buffers(column)
    return data, offsets


def _found(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Words of a batch with their occurrences; of one in 31 pairs of document and word a letter is gone."""
    words = K.Spans(batch.column("text"), LETTERS, lower=True)
    leads = np.concatenate(([0], np.cumsum(words.data == 0xC3)))
    pick = np.flatnonzero(words.ends - words.starts - leads[words.ends] + leads[words.starts] >= LEAST_POINTS)
    coded = words.strings(pick).dictionary_encode()
    size = max(1, len(coded.dictionary))
    key, n = np.unique(words.rows()[pick] * size + coded.indices.to_numpy(), return_counts=True)
    row, at = key // size, key % size
    data, offsets = _strings(coded.dictionary)
    start = np.array([zlib.crc32(f"{'' if d is None else d}:".encode()) for d in batch.column("doc_id").to_pylist()], dtype=np.uint32)
    h = _crc32(start[row], data, offsets[at], np.diff(offsets)[at])
    hit = h % ONE_IN == 0
    plain = np.bincount(at[~hit], weights=n[~hit], minlength=size).astype(np.int64)
    there = np.flatnonzero(plain[: len(coded.dictionary)])
    less: Counter[str] = Counter()
    for word, code, m in zip(coded.dictionary.take(pa.array(at[hit])).to_pylist(), h[hit].tolist(), n[hit].tolist(), strict=True):
        cut = code % len(word)
        if len(word) > LEAST_POINTS:
            less[word[:cut] + word[cut + 1 :]] += m
    kept = coded.dictionary.take(pa.array(there)).cast(pa.string())
    return pa.RecordBatch.from_arrays([pa.concat_arrays([kept, pa.array(list(less), pa.string())]), pa.concat_arrays([pa.array(plain[there]), pa.array(list(less.values()), pa.int64())])], schema=WORDS)


@lean
def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in K.pieces(batch, "text", PIECE):
            yield _found(piece)


def _bit_table() -> np.ndarray:
    """A letter's bit by its last UTF-8 byte. Letters of the alphabet are dealt to the bands in turn; others share what is left."""
    out = np.zeros(256, dtype=np.int64)
    for k in range(26):
        out[0x61 + k] = 1 << (k % BANDS * BAND_BITS + k // BANDS)
    spare = [9, 19, 28, 29]
    for b in range(0x80, 0xC0):
        out[b] = 1 << spare[b & 3]
    return out


BIT = _bit_table()


def masks(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Parity masks and lengths of words (none is empty)."""
    data, offsets = _strings(words)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.bitwise_xor.reduceat(BIT[data], offsets[:-1]), np.add.reduceat((data != 0xC3).astype(np.int64), offsets[:-1])


@lean
def _enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The units that each word is in: those of its own length, and as the longer one those of a letter less."""
    for batch in batches:
        mask, size = masks(batch.column("word"))
        for longer in (False, True):
            own = np.flatnonzero((size > LEAST_POINTS) & (size <= LONG)) if longer else np.arange(len(size))
            for band in range(BANDS):
                value, n = mask[own] >> (band * BAND_BITS) & ((1 << BAND_BITS) - 1), len(own)
                columns = [np.full(n, band, np.int32), value.astype(np.int32), (np.minimum(size[own], LONG) - longer).astype(np.int32), np.full(n, longer), mask[own]]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *(c.take(pa.array(own)) for c in batch.columns)], schema=ENTRIES)


def _verified(i: np.ndarray, j: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the rows left[i] and right[j], of as many letters or of one more on the right, differ by one edit."""
    out, size = np.zeros(len(i), dtype=bool), left.shape[1]
    step = max(1, (4 << 20) // size)
    for at in range(0, len(i), step):
        a, b = left[i[at : at + step]], right[j[at : at + step]]
        if right.shape[1] == size:
            out[at : at + step] = (a != b).sum(axis=1) == 1
            continue
        front, back = a != b[:, :size], (a != b[:, 1:])[:, ::-1]
        run = lambda m: np.where(m.any(axis=1), m.argmax(axis=1), size)
        out[at : at + step] = run(front) + run(back) >= size
    return out


def _equal(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of equal numbers of a and b, at most one for each of a at a time."""
    order = np.argsort(b, kind="stable")
    at, end = (np.searchsorted(b[order], a, side) for side in ("left", "right"))
    on = np.flatnonzero(at < end)
    while len(on):
        yield on, order[at[on]]
        at[on] += 1
        on = on[at[on] < end[on]]


def _hashed(letters: np.ndarray) -> np.ndarray:
    up, _ = K.BYTES.get(letters.shape[1] + 1)
    return letters.astype(K.U) @ up[: letters.shape[1]]


def _pairs(unit: int, mask: np.ndarray, longer: np.ndarray, block: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of the near pairs of one unit.

    Verification begins with halves: words one edit apart agree in all before the middle letter or in all from it on, so only such
    have their masks and then their letters compared.
    """
    band, split = unit >> 57, (unit >> 20 & 0xFFFFF) != (unit & 0xFFFFF)
    data, offsets = _strings(words)
    letters = np.where(np.concatenate(([False], data[:-1] == 0xC3)), data + np.uint8(0x40), data)
    real = data != 0xC3
    size = np.add.reduceat(real.astype(np.int64), offsets[:-1])
    found = []
    wide = np.diff(offsets)
    for n in np.unique(size[~longer]).tolist():
        short, long = np.flatnonzero((size == n) & ~longer), np.flatnonzero(size == n + 1)
        rows = [letters[np.repeat(w, wide) & real].reshape(-1, k) for k, w in ((n, (size == n) & ~longer), (n + 1, size == n + 1))]
        front, back = [_hashed(r[:, : n // 2]) for r in rows], [_hashed(rows[0][:, n // 2 :]), _hashed(rows[1][:, n // 2 + 1 :])]
        # Two words of n letters: the first half or what follows it; with one of n + 1, its middle letter is the one too many.
        for other, own, right, flips in ((short, 0, rows[0], (0, 2)), (long, 1, rows[1], (1, 1))):
            for k, (x, y) in enumerate(((front[0], front[own]), (back[0], back[own]))):
                for i, j in _equal(x, y):
                    apart = mask[short[i]] ^ mask[other[j]]
                    bits = np.bitwise_count(apart)
                    good = (bits == flips[0]) | (bits == flips[1])
                    good &= i < j if other is short else (k == 0) | (front[0][i] != front[1][j])
                    for b in range(band):
                        good &= (apart >> np.uint32(b * BAND_BITS)) & np.uint32((1 << BAND_BITS) - 1) != 0
                    if split:
                        good &= block[short[i]] != block[other[j]]
                    i, j = i[good], j[good]
                    good = _verified(i, j, rows[0], right)
                    found.append((short[i[good]], other[j[good]]))
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def _summed(unit: int, rows: pa.Table) -> pa.Table | None:
    """For each word of a unit that has near ones there: how many, and the most frequent of them, or the first of those."""
    column = lambda c: rows.column(c).to_numpy()
    words, n = rows.column("word").combine_chunks(), column("n")
    i, j = _pairs(unit, column("mask").astype(np.uint32), rows.column("longer").to_numpy(zero_copy_only=False), column("block"), words)
    if not len(i):
        return None
    to, near = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((near, -n[near], to))
    to, near = to[order], near[order]
    at = K.edges(to)
    return pa.Table.from_arrays([words.take(pa.array(to[at])), pa.array(np.diff(np.append(at, len(to)))), pa.array(n[near[at]]), words.take(pa.array(near[at]))], schema=NEAR)


@lean
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted entries, one unit after the other."""
    open_: list[pa.Table] = []

    def closed(last: bool) -> Iterator[pa.RecordBatch]:
        rows = pa.concat_tables(open_).combine_chunks()
        unit = rows.column("unit").to_numpy()
        at = np.append(K.edges(unit), len(unit))
        open_.clear()
        if not last:
            open_.append(rows.slice(at[-2]))
        for a, b in zip(at[: -1 if last else -2], at[1 : len(at) if last else -1], strict=True):
            if b - a > 1 and (out := _summed(int(unit[a]), rows.slice(a, b - a))) is not None:
                yield from out.to_batches()

    for batch in batches:
        if batch.num_rows:
            open_.append(pa.Table.from_batches([batch]))
            yield from closed(False)
    if open_:
        yield from closed(True)


def words_of(docs: DataFrame) -> DataFrame:
    """word, n: words of at least 7 letters that occur at least twice in docs (doc_id, text)."""
    return docs.mapInArrow(_find, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_SEEN)


def near_words(words: DataFrame, unit: int = UNIT) -> DataFrame:
    """word, n_near, top (the largest n of a near word) and form (the first word that has it) for words (word, n) that have near ones; words are distinct."""
    entries = words.mapInArrow(_enter, ENTRIES_SQL)
    key = ["band", "value", "size"]
    hot = entries.groupBy(*key).agg(F.count("*").alias("m")).where(F.col("m") > unit).select(*key, F.ceil(F.col("m") / unit).cast("int").alias("blocks"))
    cut = entries.join(F.broadcast(hot), key, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("y", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bits = [("band", 57), ("value", 47), ("size", 40)]
    number = sum((F.shiftleft(F.col(c).cast("long"), k) for c, k in bits), F.shiftleft(F.least("block", "y").cast("long"), 20) + F.greatest("block", "y"))
    units = dealt.select(number.alias("unit"), "mask", "longer", "block", "word", "n")
    met = units.repartition(shuffle_partitions(words.sparkSession), "unit").sortWithinPartitions("unit", "word").mapInArrow(_compare, "word string, near long, top long, form string")
    best = met.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("top")).alias("top"), "form")).alias("best"))
    return best.select("word", "n_near", (-F.col("best.top")).alias("top"), F.col("best.form").alias("form"))


def variants(docs: DataFrame, form_times: int = FORM_TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n for the words of docs (doc_id, text; others unread).

    A word's form is its most frequent near word, the first of equals, where that is form_times as frequent or more; root follows
    forms to the last. A form's count is that many times its word's, so chains are short, and doubling steps end at once.

    A null text has no words, a null id reads as an empty one where letters are left out. Rows that repeat whole count as often
    as they are there. A table without words gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    words = scratch.write(words_of(docs.select("doc_id", F.col("text").cast("string").alias("text"))))
    near = words.join(near_words(words), "word", "left")
    good = F.col("top") >= form_times * F.col("n")
    told = scratch.write(near.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("form")).alias("form"), F.when(good, F.col("top")).alias("form_n")))
    roots = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = scratch.write(roots.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            break
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH RECURSIVE k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, s: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
d AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
c AS (SELECT id, w, count(*) AS n FROM d WHERE length(w) >= {LEAST_POINTS} GROUP BY 1, 2),
b AS (SELECT w, n, flatten(list_transform(string_split(id || ':' || w, ''), lambda s: CASE WHEN unicode(s) < 128 THEN [unicode(s)::BIGINT] ELSE [195::BIGINT, unicode(s)::BIGINT - 64] END)) AS bytes FROM c),
h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda x, y: xor(x // 256, t[xor(x, y) % 256 + 1])), 4294967295) AS h FROM b, k),
w AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= {LEAST_POINTS} AND sum(n) >= {LEAST_SEEN}),
e AS (SELECT word, n, p, word[:p - 1] || word[p + 1:] AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM w)),
o AS (SELECT DISTINCT e.word AS long, w.word AS short, e.n AS long_n, w.n AS short_n FROM e JOIN w ON w.word = e.less),
m AS (SELECT a.word, b.word AS other, b.n FROM e a JOIN e b ON a.less = b.less AND a.p = b.p AND a.word <> b.word
      UNION ALL SELECT long, short, short_n FROM o UNION ALL SELECT short, long, long_n FROM o),
g AS (SELECT word, count(*) AS n_near, max(n) AS top, arg_min(other, (-n, other)) AS other FROM m GROUP BY 1),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= {FORM_TIMES} * w.n THEN other END AS form, CASE WHEN top >= {FORM_TIMES} * w.n THEN top END AS form_n FROM w LEFT JOIN g USING (word)),
r AS (SELECT word, word AS last, 0 AS steps FROM f UNION ALL SELECT r.word, f.form, steps + 1 FROM r JOIN f ON f.word = r.last WHERE form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(last, steps) AS root FROM r GROUP BY 1) USING (word)
"""
