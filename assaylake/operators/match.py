"""One-to-one matching of records within identity buckets, and precision and recall from it."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def match_stable(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """keys, left_id, right_id: the i-th record of each side by its id, in each bucket; those left over have a null."""
    a = left.select(*keys, left_id).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(left_id)))
    b = right.select(*keys, right_id).withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(right_id)))
    return a.join(b, [*keys, "__rank"], "full").drop("__rank")


def match_context_then_stable(left: DataFrame, right: DataFrame, keys: list[str], context: str, left_id: str, right_id: str) -> DataFrame:
    """keys, left_id, right_id, context_equal: in each bucket records of one context by their ids, then those left over, whatever their context."""
    same = match_stable(left, right, [*keys, context], left_id, right_id)
    paired = same.where(F.col(left_id).isNotNull() & F.col(right_id).isNotNull()).select(*keys, left_id, right_id)
    rest = match_stable(left.join(paired.select(left_id), left_id, "left_anti"), right.join(paired.select(right_id), right_id, "left_anti"), keys, left_id, right_id)
    both = F.when(F.col(left_id).isNotNull() & F.col(right_id).isNotNull(), False)
    return paired.withColumn("context_equal", F.lit(True)).unionByName(rest.withColumn("context_equal", both))


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the least total cost (Hungarian method with potentials)."""
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    u, v, of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        of[0], j = i, 0
        least, came, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while True:
            used[j] = True
            free = np.flatnonzero(~used[1:]) + 1
            gap = cost[of[j] - 1, free - 1] - u[of[j]] - v[free]
            better = gap < least[free]
            least[free[better]], came[free[better]] = gap[better], j
            k = free[np.argmin(least[free])]
            delta = least[k]
            u[of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = k
            if of[j] == 0:
                break
        while j:
            of[j], j = of[came[j]], came[j]
    return sorted((of[j] - 1, j - 1) for j in range(1, m + 1) if of[j])


class _Flow:
    """Flow of least cost between classes: rounds of all shortest ways at once, of which there are as many as there are different costs."""

    def __init__(self):
        self.out, self.to, self.left, self.cost = [], [], [], []

    def node(self) -> int:
        self.out.append([])
        return len(self.out) - 1

    def edge(self, u: int, v: int, most: int, cost: int = 0) -> int:
        for a, b, n, c in ((u, v, most, cost), (v, u, 0, -cost)):
            self.out[a].append(len(self.to))
            self.to.append(b)
            self.left.append(n)
            self.cost.append(c)
        return len(self.to) - 2

    def sent(self, edge: int) -> int:
        return self.left[edge ^ 1]

    def _costs(self, start: int) -> list[float]:
        far, waits, held = [float("inf")] * len(self.out), deque([start]), [False] * len(self.out)
        far[start] = 0
        while waits:
            u = waits.popleft()
            held[u] = False
            for e in self.out[u]:
                v = self.to[e]
                if self.left[e] and far[u] + self.cost[e] < far[v]:
                    far[v] = far[u] + self.cost[e]
                    if not held[v]:
                        held[v] = True
                        waits.append(v)
        return far

    def run(self, start: int, end: int) -> None:
        while True:
            far = self._costs(start)
            if far[end] == float("inf"):
                return
            fits = lambda u, e, far=far: self.left[e] and far[self.to[e]] == far[u] + self.cost[e]
            while True:
                level, ring = {start: 0}, [start]
                while ring and end not in level:
                    ring = [v for u in ring for e in self.out[u] if fits(u, e) and (v := self.to[e]) not in level and not level.update({v: level[u] + 1})]
                if end not in level:
                    break
                tried, way = [0] * len(self.out), []
                while True:
                    u = self.to[way[-1]] if way else start
                    if u == end:
                        most = min(self.left[e] for e in way)
                        for e in way:
                            self.left[e] -= most
                            self.left[e ^ 1] += most
                        way = way[: next(k for k, e in enumerate(way) if not self.left[e])]
                        continue
                    while tried[u] < len(self.out[u]) and not (fits(u, e := self.out[u][tried[u]]) and level.get(self.to[e]) == level[u] + 1):
                        tried[u] += 1
                    if tried[u] < len(self.out[u]):
                        way.append(self.out[u][tried[u]])
                    elif way:
                        tried[self.to[way.pop() ^ 1]] += 1
                    else:
                        break


def _dealt(ways_in: list[tuple[int, int]], ways_out: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Who in came through a node to whom out, in order: (in, out, how many)."""
    out, rest = [], [list(w) for w in ways_out if w[1]]
    for who, n in ways_in:
        while n:
            m = min(n, rest[0][1])
            out.append((who, rest[0][0], m))
            n -= m
            rest[0][1] -= m
            if not rest[0][1]:
                rest.pop(0)
    return out


def pair_classes(left: list[tuple], right: list[tuple]) -> list[tuple[int, int, int]]:
    """Pairs of classes (value, context, n) with how many of each: as many equal values as can be, then as many compatible contexts.

    As many pairs as the smaller side has records. A null in a left context fits anything; a null value equals none. Edges are
    few: equal values and compatible contexts each meet in nodes of their own, and contexts are looked up by the fields present.
    """
    f = _Flow()
    start, end = f.node(), f.node()
    most = min(sum(x[2] for x in left), sum(x[2] for x in right))
    a, b = [f.node() for _ in left], [f.node() for _ in right]
    for node, x in zip(a, left, strict=True):
        f.edge(start, node, x[2])
    for node, x in zip(b, right, strict=True):
        f.edge(node, end, x[2])
    contexts = sorted({x[1] for x in right}, key=str)
    looked: dict[tuple, dict] = {}

    def fitting(pattern: tuple) -> list[tuple]:
        there = tuple(k for k, x in enumerate(pattern) if x is not None)
        if there not in looked:
            looked[there] = {}
            for c in contexts:
                looked[there].setdefault(tuple(c[k] for k in there), []).append(c)
        return looked[there].get(tuple(pattern[k] for k in there), [])

    whole = most + 1
    ends: dict = {}
    for j, (v, c, _) in enumerate(right):
        ends.setdefault(v, {}).setdefault(c, []).append(j)
    flows, hubs = [], {}

    def hub(name: tuple) -> tuple[int, list, list]:
        return hubs.setdefault(name, (f.node(), [], []))

    pool = hub(("any",))
    for j in range(len(right)):
        pool[2].append((j, f.edge(pool[0], b[j], most)))
        own = hub(("context", right[j][1]))
        own[2].append((j, f.edge(own[0], b[j], most)))
    for i, (v, p, _) in enumerate(left):
        pool[1].append((i, f.edge(a[i], pool[0], most)))
        if v is not None and v in ends:
            for c in fitting(p):
                flows += [(i, j, f.edge(a[i], b[j], most, -whole - 1)) for j in ends[v].get(c, ())]
            new = ("value", v) not in hubs
            h = hub(("value", v))
            if new:
                h[2].extend((j, f.edge(h[0], b[j], most)) for at in ends[v].values() for j in at)
            h[1].append((i, f.edge(a[i], h[0], most, -whole)))
        if fits := fitting(p):
            new = ("pattern", p) not in hubs
            h = hub(("pattern", p))
            if new:
                h[2].extend((c, f.edge(h[0], hub(("context", c))[0], most, -1)) for c in fits)
            h[1].append((i, f.edge(a[i], h[0], most)))
    f.run(start, end)
    told = lambda ways: [(x, f.sent(e)) for x, e in ways]
    pairs = [(i, j, f.sent(e)) for i, j, e in flows]
    into: dict = {}
    for name, (_, come, go) in sorted(hubs.items(), key=str):
        if name[0] == "pattern":
            for i, c, n in _dealt(told(come), told(go)):
                into.setdefault(c, []).append((i, n))
        elif name[0] != "context":
            pairs += _dealt(told(come), told(go))
    for c, come in into.items():
        pairs += _dealt(come, told(hubs["context", c][2]))
    return [x for x in pairs if x[2]]


#: How many pairs of one class with another one row stands for at most while they are dealt to records.
RUN = 4096


def match_compatible(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, value: str, context: str) -> DataFrame:
    """keys, left_id, right_id, value_equal, context_equal: one to one in each bucket, as many pairs as its smaller side has records.

    Most equal values first, then most contexts that fit: context is an array of fields, and a null field on the left fits any,
    while one on the right fits a null only. A null value equals none. Records of one value and context are one class; classes are
    counted and dealt natively, and only they are paired in Python, so a bucket costs as many steps as it has classes, whatever
    its records; a bucket's classes are in one task. Within a class the smaller ids go first. Ids are unique; those left over have nulls.
    """
    parts = 8 * int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = []
    for d, i, s in ((left, left_id, "a"), (right, right_id, "b")):
        own = d.select(*[F.col(k).alias(k) for k in keys], F.to_json(F.struct(*keys)).alias(f"of_{s}"), F.col(i).alias(f"id_{s}"), F.col(value).alias(f"v_{s}"), F.col(context).alias(f"c_{s}"))
        sides.append(own.withColumn(f"place_{s}", F.row_number().over(Window.partitionBy(f"of_{s}", f"v_{s}", f"c_{s}").orderBy(f"id_{s}"))))
    a, b = sides
    counts = [d.groupBy(f"of_{s}", f"v_{s}", f"c_{s}").agg(F.count("*").alias("n")).withColumn("part", F.pmod(F.xxhash64(f"of_{s}"), F.lit(parts).cast("long"))) for d, s in ((a, "a"), (b, "b"))]
    names = ["of_a", "v_a", "c_a", "v_b", "c_b", "n"]
    schema = T.StructType([*(counts[0].schema[c] for c in names[:3]), *(counts[1].schema[c] for c in names[3:5]), T.StructField("n", T.LongType())])

    def run(_key: tuple, p: pa.Table, q: pa.Table) -> pa.Table:
        """The classes of a share of the buckets, bucket by bucket."""
        classes: list[dict] = []
        for d, s in ((p, "a"), (q, "b")):
            own: dict = {}
            for bucket, v, c, n in zip(*(d.column(x).to_pylist() for x in (f"of_{s}", f"v_{s}", f"c_{s}", "n")), strict=True):
                own.setdefault(bucket, []).append((v, tuple(c), n))
            classes.append(own)
        out = []
        for bucket in sorted(classes[0].keys() & classes[1].keys()):
            x, y = (sorted(own[bucket], key=lambda r: str(r[:2])) for own in classes)
            out += [(bucket, *x[i][:2], *y[j][:2], n) for i, j, n in pair_classes(x, y)]
        types = [p.schema.field(c).type for c in names[:3]] + [q.schema.field(c).type for c in names[3:5]] + [pa.int64()]
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names=names)

    dealt = counts[0].groupBy("part").cogroup(counts[1].groupBy("part")).applyInArrow(run, schema)
    before = lambda s, o: F.sum("n").over(Window.partitionBy("of_a", f"v_{s}", f"c_{s}").orderBy(f"v_{o}", f"c_{o}").rowsBetween(Window.unboundedPreceding, -1))
    dealt = dealt.groupBy(*names[:-1]).agg(F.sum("n").alias("n")).withColumns({f"at_{s}": F.coalesce(before(s, o), F.lit(0)) for s, o in ("ab", "ba")})
    runs = dealt.withColumn("from", F.explode(F.sequence(F.lit(1).cast("long"), "n", F.lit(RUN).cast("long"))))
    each = runs.withColumn("k", F.explode(F.sequence("from", F.least(F.col("from") + RUN - 1, "n")))).withColumns({f"place_{s}": F.col(f"at_{s}") + F.col("k") for s in "ab"})
    key = lambda d, s: [F.col("e.of_a") == F.col(f"{d}.of_{s}")] + [F.col(f"e.{c}_{s}").eqNullSafe(F.col(f"{d}.{c}_{s}")) for c in ("v", "c", "place")]
    pairs = each.alias("e").join(a.alias("x"), key("x", "a")).join(b.drop(*keys).alias("y"), key("y", "b"))
    fits = F.forall(F.zip_with("x.c_a", "y.c_b", lambda p, q: p.isNull() | F.coalesce(p == q, F.lit(False))), lambda t: t)
    same = F.coalesce(F.col("x.v_a") == F.col("y.v_b"), F.lit(False))
    paired = pairs.select(*[F.col(f"x.{k}").alias(k) for k in keys], "x.id_a", "y.id_b", same.alias("value_equal"), fits.alias("context_equal"))
    none = lambda n, t: F.lit(None).cast(t).alias(n)
    flags = [none("value_equal", "boolean"), none("context_equal", "boolean")]
    alone = a.join(paired.select("id_a"), "id_a", "left_anti").select(*keys, "id_a", none("id_b", b.schema["id_b"].dataType), *flags)
    spare = b.join(paired.select("id_b"), "id_b", "left_anti").select(*keys, none("id_a", a.schema["id_a"].dataType), "id_b", *flags)
    return paired.unionByName(alone).unionByName(spare).withColumnsRenamed({"id_a": left_id, "id_b": right_id})


def match_by_value(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str, value: str, context: str) -> DataFrame:
    """keys, left_id, right_id, value_equal, context_equal: most equal values first, then most equal contexts; null equals null.

    `match_compatible` with one field that nothing leaves out, at any size of a bucket.
    """
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    a, b = (d.select(*keys, i, text(value).alias("__value"), F.array(text(context)).alias("__context")) for d, i in ((left, left_id), (right, right_id)))
    return match_compatible(a, b, keys, left_id, right_id, "__value", "__context")


def dispositions(pairs: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """pairs with what became of each record: matched, missing (left alone) or extra (right alone)."""
    return pairs.withColumn("status", F.when(F.col(left_id).isNotNull() & F.col(right_id).isNotNull(), "matched").when(F.col(left_id).isNotNull(), "missing").otherwise("extra"))


def precision_recall(pairs: DataFrame, keys: list[str], left_id: str, right_id: str, correct) -> DataFrame:
    """tp, fn, fp, precision and recall in percent; a pair that isn't correct counts as missing and as extra."""
    both = F.col(left_id).isNotNull() & F.col(right_id).isNotNull()
    ok = both & F.coalesce(correct, F.lit(False))
    out = pairs.groupBy(*keys).agg(F.count_if(ok).alias("tp"), F.count_if(F.col(left_id).isNotNull() & ~ok).alias("fn"), F.count_if(F.col(right_id).isNotNull() & ~ok).alias("fp"))
    return out.select("*", F.round(F.try_divide(100 * F.col("tp"), F.col("tp") + F.col("fp")), 2).alias("precision"), F.round(F.try_divide(100 * F.col("tp"), F.col("tp") + F.col("fn")), 2).alias("recall"))
