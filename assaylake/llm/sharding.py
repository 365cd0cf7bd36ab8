"""Placement of rows on shards by a lookup table that shards fill in turns (consistent hashing).

Each shard has an order of preference over the slots of a table of prime size, `(offset + j * skip) mod slots` from two
hashes of its name. Shards take turns; each claims the first slot of its order that is still free, until all are taken.
A row's slot is a hash of its key modulo the table's size, and the table, which has a fixed number of rows whatever the
data, is broadcast. The table is filled by one SQL aggregate over an array; there is no Python on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SLOTS = 4093
SHARDS = 32


def hashed(key: Column, salt: str = "") -> Column:
    """The first 60 bits of the MD5 of a key's text."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key.cast("string"))), 1, 15), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard: one row for each slot. `slots` must be a prime over the number of shards; shard names must differ."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("a prime number of slots and at most as many shards, all different, are needed")
    names = F.array(*map(F.lit, shards))
    n = len(shards)
    prefs = F.transform(names, lambda s: F.struct(F.pmod(hashed(s, "offset:"), F.lit(slots)).cast("int").alias("offset"), (F.pmod(hashed(s, "skip:"), F.lit(slots - 1)) + 1).cast("int").alias("skip")))
    spark_one = spark.range(1, numPartitions=1).select(prefs.alias("prefs"))
    # State: a string of slots, blank where free; each shard's next preference. One turn a step, each turn claims a slot.
    step = f"""
        aggregate(
          sequence(0, {slots - 1}),
          named_struct('owner', array_repeat(-1, {slots}), 'next', array_repeat(0, {n})),
          (s, k) -> transform(array(
              named_struct('i', k % {n}, 'o', prefs[k % {n}].offset, 'p', prefs[k % {n}].skip)),
            t -> transform(array(
                aggregate(sequence(s.next[t.i], {slots - 1}), -1,
                  (f, j) -> CASE WHEN f >= 0 THEN f WHEN s.owner[cast((t.o + cast(j AS bigint) * t.p) % {slots} AS int)] < 0 THEN j ELSE -1 END)),
              j -> named_struct(
                'owner', transform(s.owner, (o, q) -> CASE WHEN q = cast((t.o + cast(j AS bigint) * t.p) % {slots} AS int) THEN t.i ELSE o END),
                'next', transform(s.next, (x, q) -> CASE WHEN q = t.i THEN j + 1 ELSE x END)))[0])[0],
          s -> s.owner)
    """
    filled = spark_one.select(F.posexplode(F.expr(step)).alias("slot", "i"))
    return filled.select(F.col("slot").cast("long").alias("slot"), F.element_at(names, F.col("i") + 1).alias("shard"))


def assign(df: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """All rows and columns of df, with `slot` and `shard` (columns of these names are replaced).

    A null key goes where the empty text goes; equal keys go together; an empty table stays empty.
    """
    lookup = lookup_table(df.sparkSession, shards, slots)
    slot = F.pmod(hashed(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), "key:"), F.lit(slots))
    # The key may be one of the columns that are replaced. The others go in one struct, so that no name of theirs can clash.
    names = [c for c in df.columns if c.lower() not in ("slot", "shard")]
    dealt = df.select(slot.alias("slot"), F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).alias("row"))
    return dealt.join(F.broadcast(lookup), "slot").select(*[F.col("row")[f"c{k}"].alias(c) for k, c in enumerate(names)], "slot", "shard")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i:03d}" for i in range(n)]


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", shard_names())


OP6_SQL = f"""
WITH RECURSIVE shards AS (
  SELECT i, printf('shard-%03d', i) AS shard,
         ('0x' || substr(md5('offset:' || printf('shard-%03d', i)), 1, 15))::BIGINT % {SLOTS} AS o,
         ('0x' || substr(md5('skip:' || printf('shard-%03d', i)), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS p
  FROM range({SHARDS}) t(i)
),
fill AS (
  SELECT 0 AS k, CAST(-1 AS BIGINT) AS i, CAST(-1 AS BIGINT) AS slot, bitstring('0', {SLOTS}) AS taken
  UNION ALL
  SELECT k + 1, s.i, f.slot, set_bit(taken, f.slot::INT, 1)
  FROM (SELECT fill.*, s.i AS turn, s.o, s.p,
               list_filter(list_transform(range({SLOTS}), lambda j: (s.o + j * s.p) % {SLOTS}), lambda q: get_bit(fill.taken, q::INT) = 0)[1] AS free
        FROM fill JOIN shards s ON s.i = fill.k % {SHARDS} WHERE fill.k < {SLOTS}) x,
       LATERAL (SELECT x.free AS slot) f, LATERAL (SELECT x.turn AS i) s
)
SELECT d.doc_id, d.slot, s.shard
FROM (SELECT doc_id, ('0x' || substr(md5('key:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents) d
JOIN fill f ON f.slot = d.slot AND f.k > 0 JOIN shards s ON s.i = f.i
"""
