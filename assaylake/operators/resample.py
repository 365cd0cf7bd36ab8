"""Resampling that gives the same draws however the rows are dealt: each draw's generator is seeded by its own number."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.numbers import finite
from . import joins

#: Steps of the distribution function of Poisson(1).
POISSON = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(11)]).tolist()


def uniform(seed: int, *columns) -> F.Column:
    """A number in [0, 1) from the MD5 of the seed and columns, which other engines have too."""
    return F.conv(F.substring(_hash(seed, *columns), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _hash(seed: int, *columns) -> F.Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]))


#: MD5's shifts and constants.
SHIFTS, SINES = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)], [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
#: Hashes that are in memory at once, and keys whose sums are.
BLOCK, KEYS = 16_384, 256


def _message_parts(own: list[bytes], at: int, width: int) -> np.ndarray:
    """Words of messages of 64 bytes that hold each text, all of one length, from a place on."""
    out = np.zeros((len(own), 64), np.uint8)
    out[:, at : at + width] = np.frombuffer(b"".join(own), np.uint8).reshape(len(own), width)
    return out.view("<u4")


def md5_uniform(texts: list[bytes], draws: np.ndarray) -> np.ndarray:
    """For each text and draw, the first 52 bits of the MD5 of <text>|<draw> as a number in [0, 1), as `uniform` has it.

    Texts are of one length and draws have as many digits; messages of one block of MD5 are hashed many at once.
    """
    tails = [b"|%d" % d for d in draws.tolist()]
    n, k = len(texts[0]), len(tails[0])
    if n + k > 55:
        heads = [[hashlib.md5(t + d).hexdigest()[:13] for d in tails] for t in texts]
        return np.array([[int(h, 16) for h in own] for own in heads], float) / float(1 << 52)
    left, right = _message_parts(texts, 0, n), _message_parts([d + b"\x80" for d in tails], n, k + 1)
    right[:, 14] = (n + k) * 8
    words = [(left[:, w, None] if left[:, w].any() else np.uint32(0)) | (right[None, :, w] if right[:, w].any() else np.uint32(0)) for w in range(16)]
    shape = len(texts), len(draws)
    a, b, c, d, t, s = (np.full(shape, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476, 0, 0))
    for i in range(64):
        kind = i // 16
        if kind < 2:
            x, y, z = (b, c, d) if kind == 0 else (d, b, c)
            np.bitwise_xor(y, z, out=t)
            t &= x
            t ^= z
        elif kind == 2:
            np.bitwise_xor(b, c, out=t)
            t ^= d
        else:
            np.invert(d, out=t)
            t |= b
            t ^= c
        t += a
        t += words[(i, 5 * i + 1, 3 * i + 5, 7 * i)[kind] % 16] + np.uint32(SINES[i])
        turn = SHIFTS[kind][i % 4]
        np.left_shift(t, np.uint32(turn), out=s)
        t >>= np.uint32(32 - turn)
        t |= s
        t += b
        a, b, c, d, t = d, t, b, c, a
    high, low = (a + np.uint32(0x67452301)).byteswap(), (b + np.uint32(0xEFCDAB89)).byteswap() >> np.uint32(12)
    return (high * float(1 << 20) + low) / float(1 << 52)


def _counted(u: np.ndarray) -> np.ndarray:
    """How often Poisson(1) takes each number."""
    out = np.zeros(u.shape, np.uint8)
    for step in POISSON:
        out += u >= step
    return out


def _means_by_draw(draws: int, kind):
    """Sums by key and draw of a task's rows (__m the text hashed, __k, __v): what it sends grows with its keys, not with its rows."""
    spans = [np.arange(10 ** (d - 1) if d > 1 else 0, min(10**d, draws)) for d in range(1, len(str(max(draws - 1, 0))) + 1)]

    def sent(held: dict) -> Iterator[pa.RecordBatch]:
        for key, (s, n, has) in held.items():
            yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(key, kind), draws), pa.array(np.arange(draws)), pa.array(s), pa.array(n), pa.repeat(has, draws)], names=["k", "draw", "s", "n", "has"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for batch in batches:
            texts, keys, values = (batch.column(c) for c in ("__m", "__k", "__v"))
            there, value = values.is_valid().to_numpy(zero_copy_only=False), values.fill_null(0.0).to_numpy(zero_copy_only=False)
            groups: dict = {}
            for i, (text, key) in enumerate(zip(texts.to_pylist(), keys.to_pylist(), strict=True)):
                groups.setdefault((key, len(own := text.encode())), []).append((i, own))
            for (key, _), own in groups.items():
                if key not in held and len(held) == KEYS:
                    yield from sent(held)
                    held = {}
                s, n, has = held.setdefault(key, [np.zeros(draws), np.zeros(draws, np.int64), 0])
                held[key][2] = has + int(there[[i for i, _ in own]].sum())
                for span in spans:
                    for f in range(0, len(span), BLOCK // 8):
                        some = span[f : f + BLOCK // 8]
                        rows = BLOCK // len(some)
                        for g in range(0, len(own), rows):
                            part = own[g : g + rows]
                            w = _counted(md5_uniform([x for _, x in part], some))
                            s[some] += value[[i for i, _ in part]] @ w.astype(float)
                            n[some] += w.sum(axis=0, dtype=np.int64)
        yield from sent(held)

    return run


def bootstrap_means(df: DataFrame, key: str, row: str, value: str, draws: int, seed: int) -> DataFrame:
    """key, draw, mean of Poisson bootstrap samples: each row counts as often as its own draw from Poisson(1) says.

    No sample is gathered and no row is multiplied by draws: a task hashes blocks of rows and draws, and sends its sums by key and draw.
    """
    text = F.concat_ws("|", F.lit(str(seed)), F.col(row).cast("string"))
    rows = joins.dealt(df.select(text.alias("__m"), F.col(key).alias("__k"), F.col(value).cast("double").alias("__v")), "__m")
    kind = rows.schema["__k"].dataType
    sums = rows.mapInArrow(_means_by_draw(draws, to_arrow_type(kind)), f"k {kind.simpleString()}, draw long, s double, n long, has long").groupBy("k", "draw")
    out = sums.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("has").alias("has"))
    return out.select(F.col("k").alias(key), "draw", F.when(F.col("has") > 0, F.try_divide("s", "n")).alias("mean"))


#: A row's two numbers and a draw's two are below this prime; a draw's number for a row is the sum of their products modulo it.
PRIME = (1 << 31) - 1
#: The least numbers below PRIME that reach the steps of Poisson(1) as shares of it.
_STEPS = [next(u for u in range(int(s * PRIME) - 2, PRIME + 3) if u / PRIME >= s) for s in POISSON]
#: Rows and draws whose weights are in memory at once.
ROWS, DRAWS = 2048, 512


def _numbers(seed: int, *columns) -> list[F.Column]:
    """Two numbers below PRIME from the MD5 of the seed and columns."""
    h = _hash(seed, *columns)
    return [(F.conv(F.substring(h, at, 8), 16, 10).cast("long") % PRIME).alias(n) for at, n in ((1, "__x"), (9, "__y"))]


def draw_numbers(draws: int, seed: int) -> np.ndarray:
    """Each draw's two numbers, as `_numbers` has them for the text draw."""
    own = [hashlib.md5(f"{seed}|draw|{d}".encode()).hexdigest() for d in range(draws)]
    return np.array([[int(h[:8], 16) % PRIME, int(h[8:16], 16) % PRIME] for h in own], dtype=np.int64).reshape(-1, 2)


def weights(x: np.ndarray, y: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """How often each row is in each draw: Poisson(1), a row a row and a column a draw."""
    out = np.zeros((len(x), len(draws)), np.uint8)
    for at in range(0, len(x), 64):  # what stays in a core's cache
        u = x[at : at + 64, None] * draws[:, 0]
        u += y[at : at + 64, None] * draws[:, 1]
        for _ in range(2):  # 2^31 is 1 modulo PRIME
            over = u >> 31
            u &= PRIME
            u += over
        u[u >= PRIME] -= PRIME
        u = u.astype(np.uint32)
        for step in _STEPS:
            out[at : at + 64] += u >= np.uint32(step)
    return out


def _by_draw(columns: list[str], draws: int, seed: int):
    """Sums of weights and of weighted columns by draw, a row a batch's key and draw: what a task sends does not grow with its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = draw_numbers(draws, seed)
        for batch in batches:
            key = batch.column("__p").to_numpy(zero_copy_only=False)
            x, y = (batch.column(c).to_numpy() for c in ("__x", "__y"))
            values = np.stack([np.ones(len(key)), *[batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]], axis=1)
            for k in np.unique(key):
                own = np.flatnonzero(key == k)
                for d in range(0, draws, DRAWS):
                    some, sums = every[d : d + DRAWS], 0
                    for at in range(0, len(own), ROWS):
                        i = own[at : at + ROWS]
                        sums = sums + weights(x[i], y[i], some).T @ values[i]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k)), pa.array(np.arange(d, d + len(some))), *map(pa.array, sums.T)], names=["__p", "draw", "w", *columns])

    return run


def enrichment_draws(df: DataFrame, score: str, passes: str, row: str, low: bool, shares: list[float], draws: int, seed: int) -> DataFrame:
    """share, draw, factor: the enrichment of the best share of each bootstrap sample; all shares are taken of the same samples.

    A row counts as often as Poisson(1) has it in a draw. A sample's best k rows are told by its rows' weights summed in order of
    rank, so that no sample is gathered and rows are not multiplied by draws: rows are dealt by ranges of rank, sums by range and
    draw give what goes before a range, and each range adds what it has within k. Factors of samples in which nothing passes are
    null. Rows without a score or outcome take no part; ties as in `topk.ranked`.
    """
    from . import topk

    rows = df.where(finite(F.col(score), F.col(passes))).select(F.col(score).alias("s"), F.col(passes).cast("double").alias("pass"), F.col(row).alias("r"))
    r = topk.ranked(rows, "s", "r", low).withColumn("__p", F.floor((F.col("k") - 1) / ROWS)).select("__p", "k", "pass", *_numbers(seed, "r"))
    sums = r.select("__p", "pass", "__x", "__y").mapInArrow(_by_draw(["pass"], draws, seed), "__p long, draw long, w double, pass double").groupBy("__p", "draw").agg(F.sum("w").alias("w"), F.sum("pass").alias("pass"))
    along = Window.partitionBy("draw")
    told = sums.select("__p", "draw", (F.sum("w").over(along.orderBy("__p")) - F.col("w")).alias("before"), F.sum("w").over(along).alias("w"), F.sum("pass").over(along).alias("pass"))
    arrays = told.groupBy("__p").agg(F.array_sort(F.collect_list(F.struct("draw", "before", "w"))).alias("a")).select("__p", *[F.col(f"a.{c}").alias(c) for c in ("before", "w")])

    def run(key: tuple, own: pa.Table, totals: pa.Table) -> pa.Table:
        own = own.sort_by("k")
        x, y, good = (own.column(c).to_numpy() for c in ("__x", "__y", "pass"))
        every = draw_numbers(draws, seed)
        before, total = (np.array(totals.column(c)[0].as_py()) for c in ("before", "w"))
        hits = np.zeros((len(shares), draws))
        for d in range(0, draws, DRAWS):
            w = weights(x, y, every[d : d + DRAWS])
            ahead = before[d : d + DRAWS] + np.cumsum(w, axis=0) - w
            for i, s in enumerate(shares):
                most = np.maximum(1, np.rint(s * total[d : d + DRAWS]))
                hits[i, d : d + DRAWS] = good @ np.clip(most - ahead, 0, w)
        i, d = np.nonzero(hits)
        return pa.table({"i": i, "draw": d, "hits": hits[i, d]})

    groups = r.groupBy("__p").cogroup(arrays.groupBy("__p"))
    hits = groups.applyInArrow(run, "i long, draw long, hits double").groupBy("i", "draw").agg(F.sum("hits").alias("hits"))
    of = told.where("__p = 0").select("draw", "w", "pass", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(shares) - 1).cast("long"))).alias("i"))
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), (F.col("i") + 1).cast("int"))
    most = F.greatest(F.lit(1.0), F.rint(share * F.col("w")))
    factor = F.try_divide(F.coalesce("hits", F.lit(0.0)) / most, F.try_divide("pass", "w"))
    return of.join(hits, ["i", "draw"], "left").select(share.alias("share"), "draw", factor.alias("factor"))


def compounded(draws: list[DataFrame]) -> DataFrame:
    """draw, factor: the product of several gates' factors (draw, factor), draw by draw."""
    out = draws[0].select("draw", "factor")
    for d in draws[1:]:
        out = out.join(d.select("draw", F.col("factor").alias("__f")), "draw").select("draw", (F.col("factor") * F.col("__f")).alias("factor"))
    return out


def intervals(draws: DataFrame, by: list[str], value: str, places: int = 4) -> DataFrame:
    """by, n, low, median, high: the 95 % interval of the draws that have a value."""
    at = {"low": 0.025, "median": 0.5, "high": 0.975}
    return draws.groupBy(*by).agg(F.count(value).alias("n"), *[F.round(F.expr(f"percentile({value}, {q}D)") + 1e-9, places).alias(n) for n, q in at.items()])


def rate_draws(spark: SparkSession, rates: list[float], sizes: list[int], draws: int, seed: int, slices: int = 16) -> DataFrame:
    """draw, rates: binomial resamples of pass rates, a generator per draw."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            out = [np.random.default_rng([seed, int(i)]).binomial(sizes, rates) / np.maximum(sizes, 1) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x.tolist() for x in out], pa.list_(pa.float64()))], names=["draw", "rates"])

    return spark.range(draws, numPartitions=slices).mapInArrow(run, "draw long, rates array<double>")


def cost_draws(spark: SparkSession, costs: list[float], draws: int, seed: int, low: float = 0.5, high: float = 1.5) -> DataFrame:
    """draw, costs: each stage's cost times a number between low and high of its own."""
    each = [F.lit(float(c)) * (low + (high - low) * uniform(seed, F.col("id"), F.lit(i))) for i, c in enumerate(costs)]
    return spark.range(draws).select(F.col("id").alias("draw"), F.array(*each).alias("costs"))


def fold_draws(spark: SparkSession, folds: DataFrame, columns: list[str], n: int, draws: int, seed: int) -> DataFrame:
    """draw and, for each column of folds (fold from 0 to n - 1, a handful of rows), its value in a fold that the draw picks."""
    out = spark.range(draws).select(F.col("id").alias("draw"), *[F.floor(uniform(seed, "id", F.lit(i)) * n).alias(f"__{c}") for i, c in enumerate(columns)])
    for c in columns:
        out = out.join(F.broadcast(folds.select(F.col("fold").alias(f"__{c}"), c)), f"__{c}")
    return out.select("draw", *columns)


def permuted(df: DataFrame, key: str, row: str, value: str, seed: int) -> DataFrame:
    """df with value dealt anew within each key: rows in order of row take values in order of a hash."""
    w = Window.partitionBy(key)
    a = df.withColumn("__k", F.row_number().over(w.orderBy(row)))
    b = df.select(F.col(key), F.col(value).alias("shuffled"), F.row_number().over(w.orderBy(_hash(seed, row), row)).alias("__k"))
    return a.join(b, [key, "__k"]).drop("__k")


def sample_groups(df: DataFrame, stratum: str, group: str, row: str, n: int, seed: int) -> DataFrame:
    """n groups of each stratum and one row of each, by hashes of the seed."""

    one = Window.partitionBy(stratum, group).orderBy(_hash(seed, row), row)
    some = Window.partitionBy(stratum).orderBy(_hash(seed, group), group)
    first = df.withColumn("__k", F.row_number().over(one)).where("__k = 1").drop("__k")
    return first.withColumn("__k", F.row_number().over(some)).where(F.col("__k") <= n).drop("__k")
