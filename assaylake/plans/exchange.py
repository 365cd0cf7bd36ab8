"""Files written and read again: CSV with line numbers, JSON, releases in splits, ledgers, printed grids, sequences and manifests.

Files go to a new folder below the cluster's checkpoint folder, which executors share.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..sources import readers, sinks
from .registry import Tables, query


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal, 'a \"b\", ' || c_mktsegment AS c_mktsegment FROM customer")
def csv_round_trip(t: Tables):
    """Quotes, commas and missing numbers through compressed CSV."""
    path = graph.scratch(t.spark)
    value = F.when(F.col("c_custkey") % 6 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    sinks.csv(t.customer.select("c_custkey", "c_name", value.alias("c_acctbal"), F.concat(F.lit('a "b", '), F.col("c_mktsegment")).alias("c_mktsegment")), path, gzip=True)
    return readers.csv(t.spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, row_number() OVER (ORDER BY n_nationkey) + 1 AS line, row_number() OVER (ORDER BY n_nationkey) - 1 AS _ord, 'neuro' AS endpoint FROM nation")
def csv_line_numbers(t: Tables):
    """A small dimension as one file; its rows' numbers are those of its lines."""
    path = graph.scratch(t.spark)
    sinks.csv(t.nation.select("n_nationkey", "n_name").repartition(1).sortWithinPartitions("n_nationkey"), path)
    own = readers.csv_with_lines(t.spark, path, "n_nationkey long, n_name string", "neuro")
    part = lambda i: F.element_at(F.split("raw_row_id", ":"), i)
    return own.select("n_nationkey", "n_name", part(-1).cast("long").alias("line"), "_ord", part(1).alias("endpoint"))


@query("SELECT event_id, user_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS value, event_type FROM events")
def json_round_trip(t: Tables):
    """Nulls and NaN are null in JSON lines."""
    path = graph.scratch(t.spark)
    value = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    sinks.json_lines(t.events.select("event_id", "user_id", value.alias("value"), "event_type"), path)
    return t.spark.read.schema("event_id long, user_id long, value double, event_type string").json(path)


@query("SELECT p_partkey, p_brand, CASE p_partkey % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS release_split FROM part")
def release_round_trip(t: Tables):
    path = graph.scratch(t.spark)
    for i, s in enumerate(("train", "validation", "test")):
        sinks.parquet(t.part.where(F.col("p_partkey") % 3 == i), f"{path}/part/{s}.parquet", ["p_partkey", "p_brand"])
    return readers.release(t.spark, path, "part")


@query("SELECT c_custkey, c_nationkey::VARCHAR AS dose, c_mktsegment AS cell FROM customer")
def ledger_round_trip(t: Tables):
    path = graph.scratch(t.spark)
    own = t.customer.select("c_custkey", F.to_json(F.struct(F.col("c_nationkey").cast("string").alias("dose"), F.col("c_mktsegment").alias("cell"))).alias("identity_json"))
    sinks.csv(own, path)
    ledger = readers.ledger(t.spark, path, "c_custkey long, identity_json string", rows=own.count())
    return ledger.select("c_custkey", F.col("identity")["dose"].alias("dose"), F.col("identity")["cell"].alias("cell"))


@query("""SELECT c_custkey, (c_custkey % 40 + 1)::VARCHAR AS num, row, cell, CASE WHEN row = 0 THEN CASE cell WHEN 0 THEN 'ISIS No.' ELSE 'Dose (µM) < 5' END WHEN cell = 0 THEN (c_custkey + 100000)::VARCHAR ELSE CASE WHEN c_custkey % 3 = 0 THEN '' ELSE replace(c_acctbal::VARCHAR, '-', '−') END END AS text
FROM customer, (SELECT unnest([0, 0, 1, 1]) AS row, unnest([0, 1, 0, 1]) AS cell)""")
def printed_grids(t: Tables):
    """Cells of tables as they are printed: tags, character references, empty cells closed by themselves, typographic minus."""
    k = F.col("c_custkey")
    value = F.when(k % 3 == 0, F.lit('<entry colname="2"/>')).otherwise(F.concat(F.lit("<entry><b>"), F.replace(F.col("c_acctbal").cast("string"), F.lit("-"), F.lit("&#x2212;")), F.lit("</b></entry>")))
    xml = F.concat(
        F.lit('<doc><tables id="T" num="'), F.lpad((k % 40 + 1).cast("string"), 5, "0"), F.lit('"><table><row><entry>ISIS&#x2003;No.</entry><entry>Dose (&#181;M) &lt; 5</entry></row><row><entry>'),
        (k + 100000).cast("string"), F.lit("</entry>"), value, F.lit("</row></table></tables></doc>"),
    )
    rows = t.customer.select("c_custkey", F.inline(readers.tables(xml))).select("c_custkey", "num", F.posexplode("rows").alias("row", "cells"))
    return rows.select("c_custkey", "num", "row", F.posexplode("cells").alias("cell", "text"))


@query("SELECT 'c' || p_partkey AS contig, upper(translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'acgtacgtacgtacgt')) AS sequence FROM part")
def fasta_round_trip(t: Tables):
    path = graph.scratch(t.spark)
    seq = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "acgtacgtacgtacgt")
    record = F.concat(F.lit(">c"), F.col("p_partkey").cast("string"), F.lit(" a part\n"), F.substring(seq, 1, 20), F.lit("\n"), F.substring(seq, 21, 12))
    t.part.select(record).write.text(path)
    return readers.fasta(t.spark, path)


@query("""SELECT l_returnflag AS "table", count(*) AS rows, count(*) FILTER (l_quantity > 5) AS eligible, count(DISTINCT l_partkey) AS items, count(DISTINCT l_orderkey) AS patents, count(DISTINCT l_suppkey) AS targets FROM lineitem GROUP BY 1""")
def release_manifest(t: Tables):
    own = t.lineitem.withColumn("model_eligible", F.col("l_quantity") > 5)
    return sinks.manifest({f: own.where(F.col("l_returnflag") == f) for f in ("A", "N", "R")}, "l_partkey", "l_orderkey", "l_suppkey")


@query("SELECT c_custkey, c_nationkey, c_acctbal + CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS c_acctbal FROM customer")
def upserted(t: Tables):
    own = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return sinks.upsert(own, own.where("c_custkey % 4 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), ["c_custkey"])


@query("SELECT conv_id, turn, sha256(coalesce(role, '') || '|||' || coalesce(text, '') || '|||' || turn) AS key FROM conversations")
def answer_keys(t: Tables):
    return t.conversations.select("conv_id", "turn", sinks.cache_key(F.col("role"), F.col("text"), F.col("turn")).alias("key"))


@query("SELECT l.l_orderkey, l.l_linenumber, coalesce(s.s_name, 'label ' || l.l_returnflag) AS label FROM lineitem l LEFT JOIN supplier s ON s.s_suppkey = l.l_suppkey AND l.l_discount > 0.03")
def label_cascade(t: Tables):
    """Labels by a left join of one row a key, then, for what that leaves, by position in a list."""
    names = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    own = t.lineitem.withColumn("l_suppkey", F.when(F.col("l_discount") > 0.03, F.col("l_suppkey"))).join(names, "l_suppkey", "left")
    labels = t.lineitem.select("l_returnflag").distinct().select("l_returnflag", F.concat(F.lit("label "), F.col("l_returnflag")).alias("other"))
    return own.join(labels, "l_returnflag", "left").select("l_orderkey", "l_linenumber", F.coalesce("s_name", "other").alias("label"))
