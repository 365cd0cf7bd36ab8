"""Removal of words in passages that occur more than once (fixed-block anchors).

Any `window` words hold a whole aligned block of `(window + 1) // 2` words of their document. So the aligned blocks are
the index, every rolling window of a block's length is a probe, and where a probe meets a block that lies elsewhere, both
places are anchors. Around anchors each candidate window of full length is compared by content; runs of windows that
occur elsewhere are the maximal exact repeats.

Plan: texts are dealt once into chunks of a few MB. A chunk sends each distinct hash once, with two flags (it is an
aligned block here; it occurs more than once here), to the bucket that owns its range of hashes; the bucket answers with
a bitmap. A passage that a third of all documents share is one entry a chunk, so no key is hot. Chunks do this twice,
with 48-bit probe hashes as a filter and 96-bit hashes of whole windows as identity, and then cut their texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import bucket_count, chunk_count, chunk_of, table, text_bytes
from .memory import lean_cogroup, lean_group

WINDOW = 35
SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("blob", pa.binary()), ("flags", pa.binary()), ("extra", pa.binary())])
SENT_SQL = "bucket long, chunk long, n long, blob binary, flags binary, extra binary"
REPLY = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])
REPLY_SQL = "chunk long, bucket long, n long, bits binary"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
RESULT_SQL = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start:long,end:long>>"
CARRY = -1


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def _sent(chunk: int, values: np.ndarray, width: int, buckets: int, flags: list[np.ndarray], extra: np.ndarray | None = None) -> list[tuple]:
    names, at = K.cuts(values, buckets, width)
    return [
        (int(b), chunk, int(j - i), K.pack(values[i:j], width), b"".join(K.bits(f[i:j]) for f in flags), extra[i:j].tobytes() if extra is not None else b"")
        for b, i, j in zip(names, at[:-1], at[1:], strict=True)
    ]


def _flags(blob: bytes, n: int, k: int) -> np.ndarray:
    size = (n + 7) // 8
    return K.unbits(blob[k * size : (k + 1) * size], n)


def _anchors(words: K.Words, block: int, known: np.ndarray) -> np.ndarray:
    """Which words a rolling window begins at that is a known anchor."""
    return (words.left() >= block) & K.member(words.windows(block) >> K.U(16), known)


def _candidates(words: K.Words, window: int, block: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where windows of full length around anchors begin, their order by hash, the distinct hashes (64 and 32 bits), and where each distinct one begins in that order."""
    hit = np.concatenate(([0], np.cumsum(_anchors(words, block, known), dtype=np.int64)))
    n, reach = words.n, window - block + 1
    last = np.minimum(np.arange(n) + reach, n)
    at = np.flatnonzero((words.left() >= window) & (hit[last] > hit[:-1])) if n else np.zeros(0, np.int64)
    if not len(at):
        return at, at, np.zeros(0, K.U), np.zeros(0, np.uint32), at
    h, x = words.windows(window)[at], (words.windows(window, K.WORDS2, 0x5851F42D4C957F2D)[at] >> K.U(32)).astype(np.uint32)
    order = np.lexsort((x, h))
    h, x = h[order], x[order]
    new = np.flatnonzero(np.concatenate(([True], (h[1:] != h[:-1]) | (x[1:] != x[:-1]))))
    return at, order, h[new], x[new], new


def _probe(window: int, buckets: int):
    block = (window + 1) // 2

    def send(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        words = K.Words(group.column("text"))
        ok = words.left() >= block
        value = words.windows(block) & ~K.U(0xFFFF) | (words.places() % block != 0).astype(K.U)
        value = np.sort(value[ok])
        short = value >> K.U(16)
        new = K.edges(short)
        many = np.diff(np.append(new, len(short))) > 1
        return _table(_sent(key[0].as_py(), short[new], 6, buckets, [(value[new] & K.U(1)) == 0, many]), SENT)

    return send


def _meet(_key: tuple, group: pa.Table) -> pa.Table:
    """Anchors of one range of hashes: an aligned block, and another place with the same hash."""
    rows = [(c, b, n, K.unpack(v, 6), _flags(f, n, 0), _flags(f, n, 1)) for b, c, n, v, f in zip(*(group.column(x).to_pylist() for x in ("bucket", "chunk", "n", "blob", "flags")), strict=True)]
    values, aligned, many = (np.concatenate([r[k] for r in rows]) for k in (3, 4, 5))
    order = np.argsort(values, kind="stable")
    new = K.edges(values[order])
    size = np.diff(np.append(new, len(order)))
    good = np.logical_or.reduceat(aligned[order], new) & ((size > 1) | np.logical_or.reduceat(many[order], new))
    hit = np.empty(len(order), dtype=bool)
    hit[order] = np.repeat(good, size)
    return _replies(rows, hit)


def _replies(rows: list[tuple], hit: np.ndarray, more: list[tuple] = ()) -> pa.Table:
    out, at = list(more), 0
    for c, b, n, *_ in rows:
        if (own := hit[at : at + n]).any():
            out.append((c, b, n, K.bits(own)))
        at += n
    return _table(out, REPLY)


def _extend(window: int, buckets: int):
    block = (window + 1) // 2
    probe = _probe(window, buckets)

    def send(key: tuple[pa.Scalar, ...], texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows or not replies.num_rows:
            return _table([], SENT)
        chunk = key[0].as_py()
        own = {b: (v, n) for b, v, n in zip(*(probe(key, texts).column(x).to_pylist() for x in ("bucket", "blob", "n")), strict=True)}
        known = [K.unpack(own[b][0], 6)[K.unbits(x, n)] for b, n, x in sorted(zip(*(replies.column(x).to_pylist() for x in ("bucket", "n", "bits")), strict=True))]
        known = np.concatenate(known)
        at, _, h, x, new = _candidates(K.Words(texts.column("text")), window, block, known)
        if not len(at):
            return _table([], SENT)
        many = np.diff(np.append(new, len(at))) > 1
        carry = (chunk % buckets, chunk, CARRY, K.pack(known, 6), b"", b"")
        return _table([carry, *_sent(chunk, h, 8, buckets, [many], x)], SENT)

    return send


def _repeats(_key: tuple, group: pa.Table) -> pa.Table:
    """Windows of one range of hashes that occur more than once; what chunks carry for themselves passes through."""
    every = list(zip(*(group.column(x).to_pylist() for x in ("bucket", "chunk", "n", "blob", "flags", "extra")), strict=True))
    carried = [(c, CARRY, n, v) for _, c, n, v, _, _ in every if n == CARRY]
    rows = [(c, b, n, K.unpack(v, 8), _flags(f, n, 0), np.frombuffer(x, np.uint32)) for b, c, n, v, f, x in every if n != CARRY]
    if not rows:
        return _table(carried, REPLY)
    h, many, x = (np.concatenate([r[k] for r in rows]) for k in (3, 4, 5))
    order = np.lexsort((x, h))
    a, b = h[order], x[order]
    new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
    size = np.diff(np.append(new, len(order)))
    hit = np.empty(len(order), dtype=bool)
    hit[order] = np.repeat((size > 1) | np.logical_or.reduceat(many[order], new), size)
    return _replies(rows, hit, carried)


def _cut(window: int, buckets: int, with_text: bool):
    block = (window + 1) // 2

    def cut(key: tuple[pa.Scalar, ...], texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _table([], RESULT)
        words = K.Words(texts.column("text"))
        said = sorted(zip(*(replies.column(x).to_pylist() for x in ("bucket", "n", "bits")), strict=True)) if replies.num_rows else []
        start = np.zeros(words.n, dtype=bool)
        if len(said) > 1:
            at, order, h, _, new = _candidates(words, window, block, K.unpack(said[0][2], 6))
            names, ends = K.cuts(h, buckets, 8)
            repeated, place = np.zeros(len(h), dtype=bool), {int(b): (i, j) for b, i, j in zip(names, ends[:-1], ends[1:], strict=True)}
            for b, n, x in said[1:]:
                repeated[slice(*place[b])] = K.unbits(x, n)
            start[at[order]] = np.repeat(repeated, np.diff(np.append(new, len(at))))
        step = np.zeros(words.n + window + 1, dtype=np.int64)
        begin = np.flatnonzero(start)
        np.add.at(step, begin, 1)
        np.add.at(step, begin + window, -1)
        gone = np.cumsum(step)[: words.n] > 0
        raw, out = words.data, []
        for i, doc in enumerate(texts.column("doc_id").to_pylist()):
            a, b = words.bounds[i], words.bounds[i + 1]
            here = np.flatnonzero(~gone[a:b]) + a
            kept = b" ".join([raw[s:e].tobytes() for s, e in zip(words.starts[here].tolist(), words.ends[here].tolist(), strict=True)]) if len(here) < b - a else _joined(raw, words, a, b)
            g = np.diff(np.concatenate(([0], gone[a:b].view(np.int8), [0])))
            spans = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(g == 1), np.flatnonzero(g == -1), strict=True)]
            out.append((doc, int(b - a), int(b - a - len(here)), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None, spans))
        return _table(out, RESULT)

    return cut


def _joined(raw: np.ndarray, words: K.Words, a: int, b: int) -> bytes:
    """All words a:b joined by one space; a run of bytes as it is where no space needs to change."""
    if a == b:
        return b""
    s, e = words.starts[a:b], words.ends[a:b]
    if len(s) == 1 or ((s[1:] - e[:-1]) == 1).all():
        text = raw[s[0] : e[-1]].copy()
        text[(e[:-1] - s[0])] = 0x20
        return text.tobytes()
    return b" ".join([raw[i:j].tobytes() for i, j in zip(s.tolist(), e.tolist(), strict=True)])


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = True, chunk_bytes: int = 4 << 20) -> DataFrame:
    """Per row of docs (doc_id, text, any other columns): words, words removed, and what is kept.

    A word goes if any `window` consecutive words around it also start anywhere else, in this text or another; windows
    are judged on the texts as given. Null and empty texts have no words; rows that repeat whole are copies like any
    others; an empty table gives no rows. Other columns are not read. `spans` are the maximal repeats as word ranges.
    """
    spark = docs.sparkSession
    # Only these columns leave the reader.
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = text_bytes(docs)
    chunks, buckets = chunk_count(spark, total, chunk_bytes), bucket_count(spark, total)
    base = docs.withColumn("chunk", chunk_of(F.col("doc_id"), F.col("text"), chunks))
    sent = base.groupBy("chunk").applyInArrow(lean_group(_probe(window, buckets)), SENT_SQL)
    anchors = sent.groupBy("bucket").applyInArrow(lean_group(_meet), REPLY_SQL)
    long = base.groupBy("chunk").cogroup(anchors.groupBy("chunk")).applyInArrow(lean_cogroup(_extend(window, buckets)), SENT_SQL)
    repeats = long.groupBy("bucket").applyInArrow(lean_group(_repeats), REPLY_SQL)
    return base.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(lean_cogroup(_cut(window, buckets, with_text)), RESULT_SQL)


def op1_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256", F.size("spans").alias("n_repeats"))


OP1_SQL = f"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT rid, i, sha256(array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY h) AS c FROM p) WHERE c > 1),
g AS (SELECT DISTINCT rid, i + k AS j FROM r, range({WINDOW}) t(k)),
x AS (SELECT rid, j, word, g.j IS NOT NULL AS gone FROM (SELECT rid, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM w) LEFT JOIN g USING (rid, j)),
y AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY rid ORDER BY j), false) AS begins FROM x),
k AS (SELECT rid, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_repeats, string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM y GROUP BY rid)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(n_repeats, 0) AS n_repeats, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (rid)
"""
