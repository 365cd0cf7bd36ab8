"""Links between items: connected components and near-duplicate pairs."""

from __future__ import annotations

import math
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import gestalt

#: Lengths of texts count in so many steps an e-fold. Characters of a run of texts, and runs of guests in a cell.
STEPS, LEAST, MOST, GUESTS = 50, 250_000, 4_000_000, 4


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that executors share; a local session without one gets its own."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="assaylake-"))
    return spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()


def scratch(spark: SparkSession) -> str:
    """The name of a new folder in the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df written to the cluster's shared checkpoint folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def _large(e: DataFrame) -> DataFrame:
    """Each neighbour above u goes to u's least neighbour or u itself."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    """u and its neighbours below it go to the least of them."""
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def roots(edges: DataFrame) -> DataFrame:
    """node, root for each node of edges (a, b) that is not its component's least node, by alternating stars.

    Loops and repeated edges are fine; no edges give no rows. Each pass is written to the shared folder.
    """
    e = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last = None
    while True:
        e = checkpointed(_small(_large(e)))
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == last:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = now


def components(items: DataFrame, edges: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """item, component: the least item that edges reach from each; an item without edges is its own."""
    found = roots(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))).select(F.col("node").alias(item), "root")
    return items.select(item).distinct().join(found, item, "left").select(item, F.coalesce("root", item).alias("component"))


def preview(c, lines: int = 200):
    """The first lines of a text."""
    return F.array_join(F.slice(F.split(c, "\n"), 1, lines), "\n")


def gestalt_pairs(df: DataFrame, block: str, item: str, text: str, least: float = 0.90, length: str | None = None) -> DataFrame:
    """a, b, ratio: pairs of one block whose texts' gestalt ratio is at least `least`; a is the lower item.

    A block is cut into runs of near lengths, some characters each. A cell has one run and, as guests, longer texts that can reach the
    ratio with it, of GUESTS runs at most. `gestalt.pairs` tells by shared runs of characters which pairs of a cell can reach it. `length` names a column with the texts' lengths, so that texts
    aren't read for the runs.
    """
    from . import joins

    reach = math.ceil(STEPS * math.log((2 - least) / least)) + 1
    own = df.select(F.col(block).alias("k"), F.col(item).alias("i"), F.col(text).alias("t"), (F.col(length) if length else F.length(text)).alias("n")).where("n > 0").withColumn("step", F.floor(F.log(F.col("n").cast("double")) * STEPS).cast("int"))
    w = Window.partitionBy("k").orderBy("step")
    upto = F.sum("mass").over(w.rangeBetween(Window.unboundedPreceding, 0))
    size = F.least(F.greatest(F.sum("mass").over(Window.partitionBy("k")) / 6, F.lit(LEAST)), F.lit(MOST))
    steps = own.groupBy("k", "step").agg(F.sum("n").alias("mass")).select("k", "step", ((upto - F.col("mass")) / size).alias("start"), (upto / size).alias("stop"))
    steps = steps.select("*", F.floor(F.min("start").over(w.rangeBetween(-reach, 0))).alias("low"), F.floor(F.max("stop").over(w.rangeBetween(0, reach))).alias("high"))
    steps = checkpointed(steps)
    share = F.pmod(F.xxhash64("i"), F.lit(1 << 20)) / float(1 << 20)
    run = F.floor(F.col("start") + share * (F.col("stop") - F.col("start")))
    cells = F.concat(
        F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("high") - F.col("run")) / GUESTS)), lambda p: F.struct(F.col("run").alias("r"), p.alias("p"), F.lit(False).alias("guest"))),
        F.transform(F.sequence(F.col("low"), F.col("run")), lambda r: F.struct(r.alias("r"), F.floor((F.col("run") - r) / GUESTS).alias("p"), (r < F.col("run")).alias("guest"))),
    )
    placed = own.join(joins.small(steps), ["k", "step"]).withColumn("run", run).select("k", "i", "t", F.explode(F.array_distinct(F.filter(cells, lambda c: c["guest"] | (c["r"] == F.col("run"))))).alias("c"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        return gestalt.pairs(list(rows["i"]), list(rows["t"]), rows["guest"].to_numpy(), least, rows["p"].iloc[0] == 0)

    kind = df.schema[item].dataType.simpleString()
    # A cell's time is not in its bytes: cells are dealt to twice as many tasks as there are runs, which are not put together by size.
    runs = steps.agg(F.sum(F.col("stop") - F.col("start"))).first()[0] or 0
    dealt = placed.select("k", "i", "t", "c.*").repartition(max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(2 * runs)), "k", "r", "p")
    return dealt.groupBy("k", "r", "p").applyInPandas(compare, f"a {kind}, b {kind}, ratio double")
