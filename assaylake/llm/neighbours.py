"""Nearest neighbours: a neighbour graph by NN-descent, and greedy search in it.

Equal vectors are one node, so a vector of a third of all rows is no hub. The first lists come from blocks of nodes that lie
together in the order of random hyperplanes' signs. In each round every node meets its neighbours' neighbours: its list and a
sample of those that list it are joined with their vectors, all pairs of them that hold a new entry are measured at once, and a
pair nearer than one's farthest neighbour is a candidate for its list. Rounds end when few lists change.

A query begins at the nearest of a sample of nodes, and at its own node where it is in the index. Of its `beam` nearest so far
the best that are not expanded yet are, along the graph in both directions, until the whole beam is. The beam is then measured on
the original vectors in double precision, and copies take their places by vec_id.

Lists and beams are of fixed length and so is the sample of pivots, the one thing broadcast; every node is in the index. Vectors
travel centred and scaled, as 16-bit numbers; these decide what is in a list, never a score. Each round is a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel as K
from .common import Scratch, shuffle_partitions, table
from .memory import lean, lean_cogroup

TOP, EVERY = 10, 100
#: Neighbours in a list, of them those that meet in a round with as many that list the node, most rounds, and the share of changed entries that ends them.
LIST, MEET, ROUNDS, STILL = 40, 32, 9, 0.01
#: Trees of hyperplanes for the first lists, and nodes in a block.
TREES, BLOCK, SIGNS = 4, 96, 24
#: Candidates that one meeting yields for a node at most; others come by other meetings.
YIELD = 8
#: Nearest nodes that a query keeps, those it expands in a step, and nodes sampled as its first ones.
BEAM, EXPAND, PIVOTS = 128, 48, 1024
NODES_A_GROUP = 2048
PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("d", pa.float32())])
PAIRS_SQL = "a long, b long, d float"
STATE = pa.schema([("node", pa.int64()), ("code", pa.binary()), ("near", pa.list_(pa.int64())), ("d", pa.list_(pa.float32())), ("fresh", pa.list_(pa.bool_())), ("far", pa.float32()), ("changed", pa.int64())])
STATE_SQL = "node long, code binary, near array<long>, d array<float>, fresh array<boolean>, far float, changed long"


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Codes as rows of 32-bit numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not len(column):
        return np.zeros((0, 1), np.float32)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.float16, count=(off[-1] - off[0]) // 2, offset=off[0]).reshape(len(column), -1).astype(np.float32)


def _table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums by place, of components and of their squares."""
    one = two = None
    n = 0
    for batch in batches:
        if batch.num_rows:
            x = np.stack(batch.column("vector").to_numpy(zero_copy_only=False)).astype(np.float64)
            one, two = (x.sum(0), (x * x).sum(0)) if one is None else (one + x.sum(0), two + (x * x).sum(0))
            n += len(x)
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(one))), pa.array(one), pa.array(two), pa.array(np.full(len(one), n))], names=["place", "one", "two", "n"])


def _coded(mean: np.ndarray, scale: float):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = (np.stack(batch.column("vector").to_numpy(zero_copy_only=False)) - mean) * scale
                rows = np.clip(x, -60000, 60000).astype(np.float16)
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([r.tobytes() for r in rows], pa.binary())], names=["node", "code"])

    return code


def _keyed(tree: int, signs: int):
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("code"))
                planes = np.random.default_rng([tree, x.shape[1]]).standard_normal((x.shape[1], signs)).astype(np.float32)
                keys = (x @ planes > 0) @ (1 << np.arange(signs)[::-1])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.astype(np.int64))], names=["node", "code", "key"])

    return key


def _blocks(block: int, keep: int):
    """The nearest of each node in blocks of consecutive ones."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("node").to_numpy()
            x = _matrix(batch.column("code")) if len(ids) else None
            for at in range(0, len(ids), block):
                own, d = ids[at : at + block], _distances(x[at : at + block], x[at : at + block])
                np.fill_diagonal(d, np.inf)
                best = np.argsort(d, axis=1)[:, : min(keep, len(own) - 1)]
                rows = np.arange(len(own))[:, None]
                yield _table(PAIRS, np.repeat(own, best.shape[1]), own[best].ravel(), d[rows, best].ravel())

    return run


def _met(yields: int):
    """Candidates from meetings: rows (u, b, fresh, code, far), sorted by u."""

    def one(ids: np.ndarray, fresh: np.ndarray, x: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        if not fresh.any():
            return None
        order = np.lexsort((~fresh, ids))
        order = order[K.edges(ids[order])]
        ids, fresh, x, far = ids[order], fresh[order], x[order], far[order]
        d = _distances(x, x)
        d[~(fresh[:, None] | fresh[None])] = np.inf
        np.fill_diagonal(d, np.inf)
        few = min(yields, len(ids) - 1)
        if few < 1:
            return None
        best = np.argpartition(d, few - 1, axis=1)[:, :few]
        near = np.take_along_axis(d, best, 1)
        a, k = np.nonzero(near < far[:, None])
        return ids[a], ids[best[a, k]], near[a, k]

    def closed(rows: pa.Table, last: bool) -> tuple[pa.RecordBatch | None, pa.Table | None]:
        u = rows.column("u").to_numpy()
        at = np.append(K.edges(u), len(u))
        ends = at if last else at[:-1]
        ids, fresh, far = (rows.column(c).to_numpy() for c in ("b", "fresh", "far"))
        x = _matrix(rows.column("code"))
        found = [f for i, j in zip(ends[:-1], ends[1:], strict=True) if (f := one(ids[i:j], fresh[i:j], x[i:j], far[i:j])) is not None]
        out = None
        if found:
            a, b, d = (np.concatenate([f[k] for f in found]) for k in range(3))
            order = np.lexsort((d, b, a))
            a, b, d = a[order], b[order], d[order]
            new = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))[: len(a)])
            out = _table(PAIRS, a[new], b[new], d[new])
        return out, None if last else rows.slice(at[-2])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch])
                out, open_ = closed(rows if open_ is None else pa.concat_tables([open_, rows]).combine_chunks(), False)
                if out is not None:
                    yield out
        if open_ is not None:
            out, _ = closed(open_, True)
            if out is not None:
                yield out

    return run


def _merged(size: int, used: int):
    """Lists with candidates taken in; entries that have met (the first `used`) are fresh no more."""

    def merge(_key: tuple, state: pa.Table, found: pa.Table) -> pa.Table:
        nodes = state.column("node").to_numpy()
        order = np.argsort(nodes)
        near, d, fresh = (state.column(c).combine_chunks() for c in ("near", "d", "fresh"))
        count = np.diff(near.offsets.to_numpy())
        owner = np.repeat(np.arange(len(nodes)), count)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        flags = fresh.flatten().to_numpy(zero_copy_only=False).astype(bool) & (rank >= used)
        to = order[np.searchsorted(nodes[order], found.column("a").to_numpy())] if found.num_rows else np.zeros(0, np.int64)
        who = np.concatenate([owner, to])
        other = np.concatenate([near.flatten().to_numpy(), found.column("b").to_numpy()])
        dist = np.concatenate([d.flatten().to_numpy(), found.column("d").to_numpy()])
        add = np.concatenate([np.zeros(len(owner), bool), np.ones(len(to), bool)])
        flags = np.concatenate([flags, np.ones(len(to), bool)])
        by = np.lexsort((add, other, who))
        by = by[np.concatenate(([True], (who[by][1:] != who[by][:-1]) | (other[by][1:] != other[by][:-1])))[: len(by)]]
        by = by[np.lexsort((other[by], dist[by], who[by]))]
        first = np.searchsorted(who[by], np.arange(len(nodes)))
        by = by[np.arange(len(by)) - first[who[by]] < size]
        n = np.bincount(who[by], minlength=len(nodes))
        offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
        far = np.full(len(nodes), np.inf, np.float32)
        full = n == size
        far[full] = dist[by][np.cumsum(n)[full] - 1]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (other[by], dist[by].astype(np.float32), flags[by])]
        changed = np.bincount(who[by], weights=add[by], minlength=len(nodes)).astype(np.int64)
        return pa.Table.from_arrays([pa.array(nodes), state.column("code"), *lists, pa.array(far), pa.array(changed)], schema=STATE)

    return lean_cogroup(merge)


class Index:
    """nodes (node, vector), rows (node, vec_id) and graph (node, code, near and more), all in the shared folder."""

    def __init__(self, scratch: Scratch, nodes: DataFrame, rows: DataFrame, graph: DataFrame, size: int):
        self.scratch, self.nodes, self.rows, self.graph, self.size = scratch, nodes, rows, graph, size

    def drop(self) -> None:
        """Removes the index; what reads it has to be written before."""
        self.scratch.drop(self.nodes, self.rows, self.graph)


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, vector for rows (vec_id, embedding) whose vector has components, all of them finite, one not zero."""
    vector = F.col("embedding").cast("array<double>")
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where((F.size("vector") > 0) & ~odd & F.exists("vector", lambda x: x != 0))


def build(rows: DataFrame, size: int = LIST, meet: int = MEET, rounds: int = ROUNDS, still: float = STILL) -> Index:
    """The index of rows (vec_id, embedding; others unread).

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than the
    most frequent one (of equals, the longest). Equal vectors are one node. An empty table gives an empty index.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    good = usable(rows)
    length = good.groupBy(F.size("vector").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    good = good.where(F.size("vector") == (length["length"] if length else 0))
    nodes = scratch.write(good.groupBy("vector").agg(F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("node"), "vector", F.xxhash64("vector").alias("h")))
    on = good.withColumn("h", F.xxhash64("vector")).alias("r").join(nodes.alias("n"), (F.col("r.h") == F.col("n.h")) & (F.col("r.vector") == F.col("n.vector")))
    members = scratch.write(on.select("node", "vec_id"))
    total = nodes.count()

    sums = nodes.select("vector").mapInArrow(_moments, "place long, one double, two double, n long").groupBy("place").agg(*[F.sum(c).alias(c) for c in ("one", "two", "n")])
    sums = sums.orderBy("place").collect()  # a row a component
    mean = np.array([s["one"] / s["n"] for s in sums])
    spread = float(np.mean([max(s["two"] / s["n"] - m * m, 0) for s, m in zip(sums, mean, strict=True)])) if sums else 0
    codes = scratch.write(nodes.select("node", "vector").mapInArrow(_coded(mean, 1 / np.sqrt(spread) if spread > 0 else 1.0), "node long, code binary"))

    parts, groups = shuffle_partitions(spark), max(shuffle_partitions(spark), -(-total // NODES_A_GROUP))
    in_group = lambda d, c: d.groupBy(F.pmod(F.xxhash64(c), F.lit(groups).cast("long")).alias("part"))
    none = [F.array().cast(t).alias(c) for c, t in (("near", "array<long>"), ("d", "array<float>"), ("fresh", "array<boolean>"))]
    state = codes.select("node", "code", *none, F.lit(float("inf")).cast("float").alias("far"), F.lit(0).cast("long").alias("changed"))
    found = None
    for tree in range(TREES):
        keyed = codes.mapInArrow(_keyed(tree, SIGNS), "node long, code binary, key long").repartitionByRange(parts, "key", "node").sortWithinPartitions("key", "node")
        near = keyed.select("node", "code").mapInArrow(_blocks(BLOCK, meet // 2), PAIRS_SQL)
        found = near if found is None else found.unionByName(near)
    take = lambda s, f, used: scratch.write(in_group(s, "node").cogroup(in_group(f, "a")).applyInArrow(_merged(size, used), STATE_SQL))
    state = take(state, found, 0)
    for k in range(rounds):
        ahead = state.select(F.col("node").alias("u"), F.explode(F.arrays_zip(F.slice("near", 1, meet).alias("b"), F.slice("fresh", 1, meet).alias("fresh"))).alias("e")).select("u", "e.b", "e.fresh")
        back = ahead.select(F.col("b").alias("u"), F.col("u").alias("b"), "fresh")
        back = back.withColumn("k", F.row_number().over(Window.partitionBy("u").orderBy(F.xxhash64("u", "b", F.lit(k)), "b"))).where(F.col("k") <= meet).drop("k")
        with_code = ahead.unionByName(back).join(state.select(F.col("node").alias("b"), "code", "far"), "b").select("u", "b", "fresh", "code", "far")
        found = with_code.repartition(parts, "u").sortWithinPartitions("u").mapInArrow(_met(YIELD), PAIRS_SQL)
        old, state = state, take(state, found, meet)
        scratch.drop(old)
        changed = state.agg(F.sum("changed")).first()[0] or 0
        if changed <= still * size * total:
            break
    scratch.drop(codes)
    return Index(scratch, nodes.drop("h"), members, state, total)


BEAMS = pa.schema([("query", pa.int64()), ("code", pa.binary()), ("near", pa.list_(pa.int64())), ("d", pa.list_(pa.float32())), ("open", pa.list_(pa.bool_())), ("going", pa.bool_())])
BEAMS_SQL = "query long, code binary, near array<long>, d array<float>, open array<boolean>, going boolean"


def _beams(beam: int, expand: int):
    """Beams with the nodes found taken in; those expanded in the step before are open no more."""

    def take(_key: tuple, state: pa.Table, found: pa.Table) -> pa.Table:
        rows = []
        ids = found.column("asked").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids, nodes = ids[order], found.column("node").to_numpy()[order]
        x = _matrix(found.column("code"))[order] if len(ids) else None
        own = _matrix(state.column("code"))
        for i, (q, code, near, d, open_) in enumerate(zip(*(state.column(c).to_pylist() for c in ("query", "code", "near", "d", "open")), strict=True)):
            a, b = np.searchsorted(ids, q, "left"), np.searchsorted(ids, q, "right")
            near, d, open_ = np.array(near, np.int64), np.array(d, np.float32), np.array(open_, bool)
            done = np.flatnonzero(open_)[:expand]
            open_[done] = False
            if b > a:
                new, at = np.unique(nodes[a:b], return_index=True)
                fresh = ~np.isin(new, near)
                new, at = new[fresh], at[fresh] + a
                near, d, open_ = np.concatenate([near, new]), np.concatenate([d, _distances(own[i : i + 1], x[at])[0]]), np.concatenate([open_, np.ones(len(new), bool)])
            best = np.lexsort((near, d))[:beam]
            rows.append((q, code, near[best], d[best].astype(np.float32), open_[best], bool(open_[best].any())))
        return pa.Table.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(BEAMS)], schema=BEAMS)

    return lean_cogroup(take)


def _seeded(codes: np.ndarray, nodes: np.ndarray, keep: int):
    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column("code")), codes)
                best = np.argsort(d, axis=1)[:, :keep]
                ids = batch.column("query").to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, best.shape[1])), pa.array(nodes[best].ravel())], names=["query", "node"])

    return seed


def search(index: Index, queries: DataFrame, beam: int = BEAM, expand: int = EXPAND) -> DataFrame:
    """query, node: the nodes that greedy search finds nearest to each of the queries (query, code, node); node is the query's own, or null.

    Each step reaches only as many nodes a query as its expanded ones have neighbours, so that a step's work grows with the queries.
    """
    spark, scratch = queries.sparkSession, index.scratch
    parts = shuffle_partitions(spark)
    # At most PIVOTS rows, by hash.
    pivots = index.graph.select("node", "code").orderBy(F.xxhash64("node"), "node").limit(PIVOTS).collect()
    if not pivots:
        return queries.select("query", F.lit(0).cast("long").alias("node")).limit(0)
    codes, names = np.stack([np.frombuffer(p["code"], np.float16) for p in pivots]).astype(np.float32), np.array([p["node"] for p in pivots])
    listed = index.graph.select("node", F.explode("near").alias("other"))
    # Both directions; of those that list a node no more than it lists itself.
    back = listed.select(F.col("other").alias("node"), F.col("node").alias("other")).withColumn("k", F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("node", "other"), "other")))
    edges = scratch.write(listed.unionByName(back.where(F.col("k") <= LIST).drop("k")).distinct())
    first = queries.select("query", "code").mapInArrow(_seeded(codes, names, expand // 4), "query long, node long").unionByName(queries.where("node IS NOT NULL").select("query", "node"))
    none = [F.array().cast(t).alias(c) for c, t in (("near", "array<long>"), ("d", "array<float>"), ("open", "array<boolean>"))]
    state, found = queries.select("query", "code", *none, F.lit(True).alias("going")), first.distinct()
    in_group = lambda d, c: d.groupBy(F.pmod(F.xxhash64(c), F.lit(parts).cast("long")).alias("part"))
    while True:
        near = found.join(index.graph.select("node", "code"), "node").select(F.col("query").alias("asked"), "node", "code")
        old, state = state, scratch.write(in_group(state, "query").cogroup(in_group(near, "asked")).applyInArrow(_beams(beam, expand), BEAMS_SQL))
        scratch.drop(old)
        going = state.where("going")
        if going.isEmpty():
            break
        best = F.slice(F.filter(F.arrays_zip("near", "open"), lambda x: x["open"]), 1, expand)
        found = going.select("query", F.explode(best).alias("e")).select("query", F.col("e.near").alias("node")).join(edges, "node").select("query", F.col("other").alias("node")).distinct()
    out = scratch.write(state.select("query", F.explode("near").alias("node")))
    scratch.drop(state, edges)
    return out


def nearest(rows: DataFrame, every: int = EVERY, top: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by `every`, the `top` nearest other rows found.

    Nearest first, ties to the smaller vec_id; a row without vec_id is no query, and comes last of equals. Rows that repeat whole
    are rows of their own: copies of a query are its neighbours at distance 0. With fewer other rows, all those found.
    """
    index = build(rows)
    scratch = index.scratch
    # A row stands for itself by its place among those of its node.
    placed = index.rows.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.col("vec_id").asc_nulls_last())))
    asked = scratch.write(placed.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("query"), "node", F.col("vec_id").alias("query_id"), "place"))
    # Copies of one vector ask once.
    once = scratch.write(asked.groupBy("node").agg(F.min("query").alias("query")).join(index.graph.select("node", "code"), "node").select("query", "code", "node"))
    found = search(index, once).join(once.select("query", F.col("node").alias("own")), "query")
    left, right = index.nodes.select(F.col("node").alias("own"), F.col("vector").alias("x")), index.nodes.select("node", F.col("vector").alias("y"))
    square = F.aggregate(F.zip_with("x", "y", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)
    scored = found.join(left, "own").join(right, "node").select("own", "node", F.sqrt(square).alias("score"))
    # Of a node's rows the first top + 1 can count, the query's own among them.
    few = index.rows.withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy(F.col("vec_id").asc_nulls_last()))).where(F.col("place") <= top + 1)
    ranked = scored.join(few, "node").withColumn("k", F.row_number().over(Window.partitionBy("own").orderBy("score", F.col("vec_id").asc_nulls_last(), "place"))).where(F.col("k") <= top + 1)
    same = (F.col("own") == F.col("node")) & (F.col("place") == F.col("self"))
    each = asked.select(F.col("node").alias("own"), "query", "query_id", F.col("place").alias("self")).join(ranked, "own").where(~same)
    out = each.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("score", F.col("vec_id").asc_nulls_last(), "place"))).where(F.col("rank") <= top)
    return out.select("query_id", "rank", "vec_id", "score")


def op11_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


#: The exact answer, which the search gives on small tables.
OP11_SQL = f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0 AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda e: NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
d AS (SELECT q.rid, q.vec_id AS query_id, v.vec_id, list_distance(q.x, v.x) AS score, row_number() OVER (PARTITION BY q.rid ORDER BY list_distance(q.x, v.x), v.vec_id) AS rank FROM v q JOIN v ON q.rid <> v.rid WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM d WHERE rank <= {TOP}
"""
