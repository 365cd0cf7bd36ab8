"""The corpus pipeline: language, repeated lines, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last returns packed pieces. What a
stage returns is written as Parquet and read again as the next one's documents.

Rows that repeat whole go through each stage alike until near duplicates, where one of equal rows stays. A row without an id
stays where no row with one is in its group. A null or empty text has no language and goes in the first stage. Empty tables
stay empty. Other columns than text and n_chars pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm import decontaminate, language_id, line_dedup, ngram_join, packing
from assaylake.llm.common import shared_dir, table


def _with_text(docs: DataFrame, columns: list[str], text: str) -> DataFrame:
    """The given columns, with another column as their text and its length as n_chars."""
    new = {"text": F.col(text), "n_chars": F.length(F.col(text)).cast("long")}
    return docs.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in columns])


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; those whose text has no letter, or whose two best languages are close, go."""
    return language_id.predict(docs, language_id.train(docs)).where(~F.col("rejected")).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of lines; a document of nothing else goes."""
    found = line_dedup.dedup_lines(docs)
    left = found.where((F.col("n_removed") == 0) | (F.translate("text_kept", " \t\r\n", "") != ""))
    return _with_text(left, docs.columns, "text_kept")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that similarity links reach, the document with the smallest id (none comes last), then hash of text."""
    # A null or empty text links with nothing, whatever label it shares.
    alone = F.when(F.col("n_shingles") == 0, F.col("th"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first")
    keep = ngram_join.linked(docs).groupBy("label", alone.alias("alone")).agg(first).select(F.col("first.doc_id").alias("__d"), F.col("first.th").alias("__t"))
    keyed = docs.withColumn("__id", F.col("doc_id").cast("long")).withColumn("__th", F.xxhash64(F.col("text").cast("string")))
    kept = keyed.join(keep, (F.col("__th") == F.col("__t")) & F.col("__id").eqNullSafe(F.col("__d")), "left_semi")
    return kept.dropDuplicates(["__id", "__th"]).select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; a document of nothing else goes."""
    return _with_text(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")), docs.columns, "text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return packing.pack(docs, packing.tokenizer_path())


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmarks),
    ("packing", packed),
]
#: Compression, suffix arrays and tokens are not for SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder before the next reads it."""
    docs, root = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{root}/{k}")
            docs = spark.read.schema(docs.schema).parquet(f"{root}/{k}")
    return docs
