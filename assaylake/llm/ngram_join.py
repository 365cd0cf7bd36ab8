"""Documents whose sets of word shingles overlap by a Jaccard similarity or more, by a grouped prefix join.

1. Chunks of texts count each distinct shingle's documents: sorted hashes go to the bucket of their range, which answers
   with a one-byte rank of the count. Shingles of one document alone can't be shared and rank first.
2. In the order (rank, hash) any two sets that link share a shingle of their prefixes, of `size - ceil(75 % of size) + 1`.
   Equal sets collapse to a class, classes with equal prefixes and size to a group, which stands for them in the index.
3. Pairs are looked for between groups of different components only. Star rounds first let each part of a group meet the part
   that has the least before a shingle they share, the one nearest to what the group has in common; members are expanded and
   verified by the size of their intersection, and links merge components. Then all pairs left, whose components differ, are
   joined at the first prefix shingle they share, where sizes, the shingle's places and a bitmap of each set leave room for a
   link, and verified, by short hashes first. So a large group of near copies costs a few links a member, and no link between
   components is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel as K
from .common import Scratch, bucket_count, chunk_count, chunk_of, table, text_bytes
from .components import components
from .memory import lean_cogroup, lean_group

SHINGLE, PERCENT = 5, 75
STAR_ROUNDS = 6
#: 64-bit words of a set's bitmap.
BITS = 8
SENT = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int64()), ("blob", pa.binary()), ("many", pa.binary()), ("counts", pa.binary())])
SENT_SQL = "bucket long, chunk long, n long, blob binary, many binary, counts binary"
RANKS = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("ranks", pa.binary())])
RANKS_SQL = "chunk long, bucket long, ranks binary"
SETS = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("size", pa.int64()), ("node", pa.binary()), ("group", pa.binary()), ("prefix", pa.list_(pa.int64())), ("shared", pa.list_(pa.int64())), ("bits", pa.list_(pa.int64()))])
SETS_SQL = "doc_id long, th long, size long, node binary, `group` binary, prefix array<long>, shared array<long>, bits array<long>"


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)


def shingles(column, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, text by text and in order, and where each text's begin (one more at the end)."""
    words = K.Words(column, K.PLAIN, lower=True)
    ok = words.left() >= n
    size = np.diff(words.bounds)
    short = np.flatnonzero((size > 0) & (size < n))
    row = np.concatenate([words.rows()[ok], short])
    h = np.concatenate([words.windows(n)[ok], words.sequences()[short]])
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])))[: len(h)]
    row, h = row[new], h[new]
    return h, np.searchsorted(row, np.arange(len(size) + 1))


def _count(n: int, buckets: int):
    def send(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        h, _ = shingles(group.column("text"), n)
        short = np.sort(h >> K.U(16))
        new = K.edges(short)
        count = np.diff(np.append(new, len(short)))
        value = short[new]
        names, at = K.cuts(value, buckets, 6)
        out = []
        for b, i, j in zip(names, at[:-1], at[1:], strict=True):
            many = count[i:j] > 1
            out.append((int(b), key[0].as_py(), int(j - i), K.pack(value[i:j], 6), K.bits(many), count[i:j][many].astype("<u4").tobytes()))
        return _rows(out, SENT)

    return send


def _rank(_key: tuple, group: pa.Table) -> pa.Table:
    """For each chunk's shingles of one range of hashes: 0 where one document has it, else 1 and more as more have it."""
    rows = list(zip(*(group.column(c).to_pylist() for c in SENT.names), strict=True))
    value, count = [], []
    for _, _, n, blob, many, counts in rows:
        value.append(K.unpack(blob, 6))
        own = np.ones(n, dtype=np.int64)
        own[K.unbits(many, n)] = np.frombuffer(counts, "<u4")
        count.append(own)
    value, count = np.concatenate(value), np.concatenate(count)
    order = np.argsort(value, kind="stable")
    new = K.edges(value[order])
    total = np.add.reduceat(count[order], new)
    rank = np.where(total == 1, 0, np.minimum(255, 1 + (4 * np.log2(total)).astype(np.int64))).astype(np.uint8)
    out = np.empty(len(order), dtype=np.uint8)
    out[order] = np.repeat(rank, np.diff(np.append(new, len(order))))
    replies, at = [], 0
    for b, c, n, *_ in rows:
        if (own := out[at : at + n]).any():
            replies.append((c, b, own.tobytes()))
        at += n
    return _rows(replies, RANKS)


def _bitmap(h: np.ndarray) -> np.ndarray:
    """Which bits an odd number of hashes fall on: two sets' bitmaps differ in no more bits than the sets in elements."""
    odd = np.bincount((h >> K.U(20) & K.U(64 * BITS - 1)).astype(np.int64), minlength=64 * BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(n: int, percent: int, buckets: int):
    def sets(key: tuple[pa.Scalar, ...], texts: pa.Table, replies: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _rows([], SETS)
        h, bounds = shingles(texts.column("text"), n)
        short = h >> K.U(16)
        order = np.argsort(short)
        new = K.edges(short[order])
        value = short[order][new]
        ranks = np.zeros(len(value), dtype=np.uint8)
        names, at = K.cuts(value, buckets, 6)
        place = {int(b): (i, j) for b, i, j in zip(names, at[:-1], at[1:], strict=True)}
        for b, r in zip(replies.column("bucket").to_pylist(), replies.column("ranks").to_pylist(), strict=True):
            ranks[slice(*place[b])] = np.frombuffer(r, np.uint8)
        rank = np.empty(len(h), dtype=np.uint8)
        rank[order] = np.repeat(ranks, np.diff(np.append(new, len(h))))
        one, two = K.mix(h.copy(), 11), K.mix(h.copy(), 23)
        out = []
        for i, (doc, th) in enumerate(zip(texts.column("doc_id").to_pylist(), texts.column("th").to_pylist(), strict=True)):
            a, b = bounds[i], bounds[i + 1]
            size = int(b - a)
            if not size:
                out.append((doc, th, 0, b"none" + str(doc).encode(), None, None, None, None))
                continue
            node = one[a:b].sum(dtype=K.U).tobytes() + two[a:b].sum(dtype=K.U).tobytes()
            own = np.flatnonzero(rank[a:b]) + a
            least = -(-percent * size // 100)
            take = size - least + 1 - (size - len(own))
            if take <= 0:
                out.append((doc, th, size, node, None, None, None, None))
                continue
            own = own[np.lexsort((h[own], rank[own]))]
            prefix = own[:take]
            group = one[prefix].sum(dtype=K.U).tobytes() + two[prefix].sum(dtype=K.U).tobytes() + size.to_bytes(5, "little")
            out.append((doc, th, size, node, group, h[prefix].view(np.int64), h[own].view(np.int64), _bitmap(h[own])))
        return _rows(out, SETS)

    return sets


def _links(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Label pairs of the pairs (a, b, la, lb: nodes and their labels) whose sets link."""
    left = nodes.select(F.col("node").alias("a"), F.col("size").alias("sa"), F.col("shared").alias("xa"))
    right = nodes.select(F.col("node").alias("b"), F.col("size").alias("sb"), F.col("shared").alias("xb"))
    both = F.size(F.array_intersect("xa", "xb"))
    found = pairs.join(left, "a").join(right, "b").where((100 + percent) * both >= percent * (F.col("sa") + F.col("sb")))
    return found.select(F.col("la").alias("a"), F.col("lb").alias("b"))


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs that link as far as 31 bits of each shingle's hash tell. Shorter hashes can only add to an intersection, so no link
    is lost, and half as many bytes go with each pair; what is left is verified with whole hashes.
    """
    brief = F.transform("shared", lambda x: x.bitwiseAND(F.lit(0x7FFFFFFF).cast("long")).cast("int"))
    left = nodes.select(F.col("node").alias("a"), F.col("size").alias("sa"), brief.alias("xa"))
    right = nodes.select(F.col("node").alias("b"), F.col("size").alias("sb"), brief.alias("xb"))
    # Equal short hashes within one set count once on both sides; the larger side's repeats are added back.
    repeats = F.greatest(F.size("xa") - F.size(F.array_distinct("xa")), F.size("xb") - F.size(F.array_distinct("xb")))
    enough = (100 + percent) * (F.size(F.array_intersect("xa", "xb")) + repeats) >= percent * (F.col("sa") + F.col("sb"))
    return pairs.join(left, "a").join(right, "b").where(enough).select("a", "b", "la", "lb")


def _relabel(labels: DataFrame, links: DataFrame, write) -> DataFrame:
    if links.isEmpty():
        return labels
    roots = components(links)
    return write(labels.join(roots.withColumnRenamed("node", "label"), "label", "left").select("node", F.coalesce("root", "label").alias("label")))


def linked(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS, chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, th (hash of text), n_shingles, label for each row of docs (doc_id, text; others unread): rows that links reach have one label.

    Two texts link when 100 * |intersection| >= percent * |union| of their distinct shingles of lower-cased words. Fewer words than
    a shingle are one shingle. Null and empty texts link with nothing; those of one id have one label. Rows that repeat are copies.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    total = text_bytes(docs)
    chunks, buckets = chunk_count(spark, total, chunk_bytes), bucket_count(spark, total)
    scratch = Scratch(spark)
    write = scratch.write

    base = docs.withColumn("chunk", chunk_of(F.col("doc_id"), F.col("text"), chunks)).withColumn("th", F.xxhash64("text"))
    ranks = base.groupBy("chunk").applyInArrow(lean_group(_count(shingle, buckets)), SENT_SQL).groupBy("bucket").applyInArrow(lean_group(_rank), RANKS_SQL)
    rows = write(base.groupBy("chunk").cogroup(ranks.groupBy("chunk")).applyInArrow(lean_cogroup(_sets(shingle, percent, buckets)), SETS_SQL))
    nodes = write(rows.where(F.col("prefix").isNotNull()).groupBy("node", "size").agg(*[F.first(c).alias(c) for c in ("group", "prefix", "shared", "bits")]))
    ids = write(rows.select("doc_id", "th", F.col("size").alias("n_shingles"), "node"))
    scratch.drop(rows)
    # A bitmap speaks for a group only where the group is one set.
    groups = nodes.groupBy("group", "size").agg(F.first("prefix").alias("prefix"), F.when(F.count("*") == 1, F.first("bits")).alias("bits"))
    # A shingle's place in its set: the set's own shingles, which no other has, come before those of the prefix.
    own = F.col("size") - F.ceil(F.lit(percent) * F.col("size") / 100) + 1 - F.size("prefix")
    entries = groups.select("group", "size", own.alias("own"), "bits", "prefix", F.posexplode("prefix").alias("i", "token"))
    names = ["token", "group", "size", "own", "place", "prev", *(f"x{k}" for k in range(BITS))]
    entries = entries.select("token", "group", "size", "own", (F.col("own") + F.col("i")).alias("place"), F.get("prefix", F.col("i") - 1).alias("prev"), *[F.get("bits", F.lit(k)).alias(f"x{k}") for k in range(BITS)])
    # A shingle that only one group has in its prefix pairs with nothing but within that group.
    wide = entries.groupBy("token").agg(F.count("*").alias("n")).where("n > 1").select("token")
    # Members of a group share its whole prefix, so the first shingle that two of them share stands behind their own ones.
    none = F.lit(None).cast("long")
    inner = nodes.groupBy("group", "size").agg(F.count("*").alias("n"), F.first("prefix").alias("prefix")).where("n > 1").select(F.xxhash64("group", "size").alias("token"), "group", "size", own.alias("own"), own.alias("place"), *[none.alias(c) for c in names[5:]])
    index = write(entries.join(wide, "token").select(*names).unionByName(inner))
    labels = write(nodes.select("node", F.col("node").alias("label")))

    for _ in range(star_rounds):
        parts, open_ = _open(nodes, index, labels)
        hubs = open_.groupBy("token").agg(F.min(F.struct("place", "label", "node", "size")).alias("hub"))
        met = open_.join(hubs, "token").where((F.col("label") != F.col("hub.label")) & _fits("size", "hub.size", "place", "hub.place", percent))
        met = met.select("group", "label", F.struct("hub.label", "hub.node", "hub.size").alias("hub"))
        best = met.groupBy("group", "label", "hub").agg(F.count("*").alias("n")).groupBy("group", "label").agg(F.max(F.struct("n", "hub")).alias("top"))
        pairs = best.join(parts, ["group", "label"]).select(F.col("node").alias("a"), F.col("top.hub.node").alias("b"), F.col("label").alias("la"), F.col("top.hub.label").alias("lb"))
        links = write(_links(pairs, nodes, percent).distinct())
        # Where a round joins few of the labels that are still open, the exact step has no more to do than another round.
        few = 10 * links.count() < open_.select("label").distinct().count()
        old, labels = labels, _relabel(labels, links, write)
        scratch.drop(links, *([old] if old is not labels else []))
        if few:
            break

    parts, open_ = _open(nodes, index, labels)
    main = open_.groupBy("token", "label").agg(F.count("*").alias("n")).groupBy("token").agg(F.max(F.struct("n", "label")).alias("top")).select("token", F.col("top.label").alias("main"))
    sided = lambda s: [F.col(c).alias(f"{c}_{s}") for c in ("group", "label", *names[2:])]
    minor = open_.join(main, "token").where("label <> main").select("token", "main", *sided("a"))
    met = minor.join(open_.select("token", *sided("b")), "token").where(
        # Two minor labels meet once; only where the shingle before is not the same, as the pair meets there otherwise.
        ((F.col("label_b") == F.col("main")) | (F.col("label_a") < F.col("label_b"))) & ~F.coalesce(F.col("prev_a") == F.col("prev_b"), F.lit(False))
        & _fits("size_a", "size_b", "place_a", "place_b", percent) & _alike(percent)
    )
    swap = F.col("label_a") > F.col("label_b")
    names = (("group_b", "group_a", "ga"), ("label_b", "label_a", "la"), ("group_a", "group_b", "gb"), ("label_a", "label_b", "lb"))
    met = met.select(*[F.when(swap, F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in names]).distinct()
    left = parts.select(F.col("group").alias("ga"), F.col("label").alias("la"), F.col("node").alias("a"))
    right = parts.select(F.col("group").alias("gb"), F.col("label").alias("lb"), F.col("node").alias("b"))
    pairs = met.join(left, ["ga", "la"]).join(right, ["gb", "lb"]).select("a", "b", "la", "lb")
    links = write(_links(_near(pairs, nodes, percent), nodes, percent).distinct())
    old, labels = labels, _relabel(labels, links, write)
    scratch.drop(links, index, nodes, *([old] if old is not labels else []))

    return ids.join(labels, "node", "left").select("doc_id", "th", "n_shingles", F.coalesce("label", "node").alias("label"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, star_rounds: int = STAR_ROUNDS, chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs, by `linked`.

    component_id is the smallest doc_id that links reach; a null id is never the smallest unless all are null.
    """
    own = linked(docs, shingle, percent, star_rounds, chunk_bytes).drop("th")
    least = own.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return own.join(least, "label").select("doc_id", "n_shingles", "component_id")


def _fits(a: str, b: str, place_a: str, place_b: str, percent: int):
    """Whether sets of sizes a and b can link where these are the places of the first shingle that they share: what stands from there on must be enough."""
    a, b, place_a, place_b = map(F.col, (a, b, place_a, place_b))
    return (100 + percent) * F.least(a, b, a - place_a, b - place_b) >= percent * (a + b)


def _alike(percent: int):
    """Whether the sets of entries a and b can link for all that their bitmaps and the shingles that no other set has tell; no bitmap tells nothing."""
    apart = sum((F.bit_count(F.col(f"x{k}_a").bitwiseXOR(F.col(f"x{k}_b"))) for k in range(BITS)), F.col("own_a") + F.col("own_b"))
    return F.coalesce((100 + percent) * apart <= (100 - percent) * (F.col("size_a") + F.col("size_b")), F.lit(True))


def _open(nodes: DataFrame, index: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of groups with their labels, and the index entries of parts of groups (one row a label, with a member) whose shingle has more than one label."""
    parts = nodes.select("node", "group", "size").join(labels, "node")
    stand = parts.groupBy("group", "size", "label").agg(F.min("node").alias("node"))
    entries = index.join(stand, ["group", "size"])
    mixed = entries.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    return parts, entries.join(mixed, "token")


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT rid, sha256(array_to_string(w[i:i + {SHINGLE - 1}], ' ')) AS h FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.rid AS x, b.rid AS y, count(*) AS k FROM s a JOIN s b ON a.h = b.h AND a.rid < b.rid GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * k >= {PERCENT} * (a.n + b.n - k)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT rid, doc_id AS c FROM w UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.rid JOIN w ON w.rid = e.y WHERE r.c < w.doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (rid) JOIN (SELECT rid, min(c) AS component_id FROM r GROUP BY 1) USING (rid)
"""
