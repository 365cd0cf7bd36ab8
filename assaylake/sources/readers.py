"""Readers: declared schemas, line numbers as order, NaN as null."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID = "`USPTO ID` string, `Table Number` int, `Compound ID` string, `HELM Annotation` string"
CELL = "cell_line string, cell_line_species string, target_RNA string, Inhibition_pct double, cells_per_well double, transfection_method string, treatment_period_hrs double"
#: Columns of the raw files.
RAW = {
    "in_vitro": f"{ID}, {CELL}, dosage_nm double",
    "dose_response": f"{ID}, {CELL}, dosage double",
    "neuro": f"{ID}, FOB_score string, dosage_ug double, species string, species_strain string, latency_time_hours double, administration_method string, tolerability_score_type string",
    "hepatic": f"{ID}, dosage string, num_doses double, dosing_period_days double, species string, species_strain string, measurement_source string, adminstration_method string, ALB double, ALT double, AST double, BUN double, CREA double, TBIL double, PC_ratio double, target_RNA string",
}
MAP_COLUMNS = ("table_ref", "canonical_ref", "relationship")


def nan_to_null(df: DataFrame) -> DataFrame:
    kinds = (T.DoubleType, T.FloatType)
    return df.select(*[F.nullif(F.col(f"`{f.name}`"), F.lit(float("nan")).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, kinds) else F.col(f"`{f.name}`") for f in df.schema])


def csv(spark: SparkSession, path: str, schema: str, columns: list[str] | None = None, **options) -> DataFrame:
    """A CSV file or folder, gzip or not, with a head line. With multiLine=True quoted line feeds are read, a file in one task."""
    df = nan_to_null(spark.read.schema(schema).options(**{"header": True, "escape": '"', "mode": "FAILFAST"} | options).csv(path))
    return df.select(*columns) if columns else df


def csv_with_lines(spark: SparkSession, path: str, schema: str, endpoint: str, **options) -> DataFrame:
    """csv() with _ord (the order of lines over all files by name) and raw_row_id `endpoint:file:line`; the first data line is 2.

    A row's line is its number in its split of the file and the rows of the file's splits before. Rows of a split are in one
    partition, in order; the table of splits, one row each, is small enough to broadcast.
    """
    read = spark.read.schema(schema).options(**{"header": True, "escape": '"'} | options).csv(path)
    rows = read.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b"), F.monotonically_increasing_id().alias("__m"))
    splits = rows.groupBy("__f", "__b").agg(F.min("__m").alias("__least"), F.count("*").alias("__n"))
    earlier = lambda w: F.coalesce(F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("__f", "__b", "__least", earlier(Window.partitionBy("__f").orderBy("__b")).alias("__in_file"), earlier(Window.orderBy("__f", "__b")).alias("__in_all"))
    at = F.col("__m") - F.col("__least")
    name = F.regexp_extract("__f", "[^/]+$", 0)
    out = rows.join(F.broadcast(splits), ["__f", "__b"]).withColumn("_ord", at + F.col("__in_all"))
    return nan_to_null(out.withColumn("raw_row_id", F.concat_ws(":", F.lit(endpoint), name, (at + F.col("__in_file") + 2).cast("string"))).drop("__f", "__b", "__m", "__least", "__in_file", "__in_all"))


def scaled_union(nano: DataFrame, micro: DataFrame, dose: str = "dosage", name: str = "dosage_nm") -> DataFrame:
    """Rows in nM and, after them, rows in uM times 1000, with the dose renamed."""
    both = nano.unionByName(micro.withColumn(dose, F.col(dose) * 1000), allowMissingColumns=True)
    return both.withColumnRenamed(dose, name)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, by the file system that Spark reads it with."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def release(spark: SparkSession, folder: str, name: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> DataFrame:
    """A flat table, or the union of its splits with release_split; an error where one split is missing."""
    flat = f"{folder}/{name}.parquet"
    if exists(spark, flat):
        return spark.read.parquet(flat).withColumn("release_split", F.lit(None).cast("string"))
    missing = [s for s in splits if not exists(spark, f"{folder}/{name}/{s}.parquet")]
    if missing:
        raise FileNotFoundError(f"{name}: no {', '.join(missing)}")
    parts = [spark.read.parquet(f"{folder}/{name}/{s}.parquet").withColumn("release_split", F.lit(s)) for s in splits]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def json_objects(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Whole files of one JSON object each."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON files of a folder with the patent and the table that their names tell."""
    df = json_objects(spark, path, schema).withColumn("__f", F.input_file_name())
    return df.withColumn("patent", F.regexp_extract("__f", r"(US\w+?)_", 1)).withColumn("table_number", F.regexp_extract("__f", r"_t(?:able_)?0*(\d+)", 1).cast("int")).drop("__f")


def texts(spark: SparkSession, path: str, glob: str = "*.xml*") -> DataFrame:
    """path, text of whole files, gzip or not, without context files; bytes that aren't UTF-8 are replaced."""
    df = spark.read.option("pathGlobFilter", glob).option("wholetext", True).text(path)
    return df.select(F.input_file_name().alias("path"), F.col("value").alias("text")).where(~F.col("path").endswith("_context.txt"))


def entities(c: Column) -> Column:
    """Text of a cell: tags off, character references decoded (by number or HTML 4 name; others stay), wide spaces as one space."""
    bare = F.when(c.contains("<"), F.regexp_replace(c, "<[^>]*>", "")).otherwise(c)
    names = F.create_map(*[F.lit(x) for k, v in (name2codepoint | {"apos": 0x27}).items() for x in (k, v)])

    def sign(ref: Column) -> Column:
        code = F.when(ref.rlike("^&#[xX]"), F.conv(F.substring(ref, F.lit(4), F.length(ref) - 4), 16, 10).cast("int")).when(ref.startswith("&#"), F.substring(ref, F.lit(3), F.length(ref) - 3).try_cast("int"))
        code = F.coalesce(code, F.element_at(names, F.substring(ref, F.lit(2), F.length(ref) - 2)))
        # Twice eight digits of UTF-16 where one unit is too few.
        high, low = 0xD800 + F.shiftright(code - 0x10000, 10), 0xDC00 + F.pmod(code - 0x10000, F.lit(0x400))
        units = F.when(code < 0x10000, F.lpad(F.hex(code), 4, "0")).otherwise(F.concat(F.hex(high), F.hex(low)))
        return F.when(code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF), F.decode(F.unhex(units), "UTF-16BE")).otherwise(ref)

    # Text and references in turn, so that what one reference gives is no part of another.
    reference = "&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,9});"
    between = F.split(bare, reference)
    signs = F.transform(F.regexp_extract_all(bare, F.lit(f"({reference})"), F.lit(1)), sign)
    whole = F.array_join(F.zip_with(between, signs, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    out = F.when(c.contains("&"), whole).otherwise(bare)
    return F.trim(F.regexp_replace(out, r"[\s\u00a0\u2000-\u200b\u202f\u205f\u3000]+", " "))


def grid(text: Column) -> Column:
    """array<array<string>>: rows of a printed table's cells; an empty cell, closed by itself or not, is the empty text."""
    rows = F.regexp_extract_all(text, F.lit(r"(?s)<row\b[^>]*>(.*?)</row>"), F.lit(1))
    cell = lambda r: F.regexp_extract_all(F.regexp_replace(r, r"<entry\b[^>]*/>", "<entry></entry>"), F.lit(r"(?s)<entry\b[^>]*>(.*?)</entry>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(cell(r), entities))


def tables(text: Column) -> Column:
    """array<struct<num, rows>> of the tables in a document."""
    found = F.regexp_extract_all(text, F.lit(r"(?s)<tables\b[^>]*>.*?</tables>"), F.lit(0))
    return F.transform(found, lambda t: F.struct(F.regexp_extract(t, r'<tables\b[^>]*\bnum="0*(\d+)"', 1).alias("num"), grid(t).alias("rows")))


def reviewed_rows(rows: Column) -> Column:
    """array<struct<id, sequence, printed, value>> of rows of eight cells with an id and a sequence; value is 100 - printed."""
    ok = F.filter(rows, lambda r: (F.size(r) == 8) & F.get(r, F.lit(0)).rlike(r"^\d{6}[†‡]?$") & F.exists(r, lambda c: c.rlike("^[ACGT]{5,}$")))
    value = lambda r: F.element_at(F.filter(F.slice(r, F.lit(2), F.lit(7)), lambda c: c.rlike(r"^\d+$")), -1)
    return F.transform(ok, lambda r: F.struct(F.regexp_extract(F.get(r, F.lit(0)), r"\d{6}", 0).alias("id"), F.get(F.filter(r, lambda c: c.rlike("^[ACGT]{5,}$")), F.lit(0)).alias("sequence"), value(r).cast("double").alias("printed"), (100 - value(r).cast("double")).alias("value")))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig, sequence (upper case) of FASTA files, gzip or not. Records are cut at `>`, so that a reader's row is a contig."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.length("value") > 0)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\s", "")
    return raw.select(F.regexp_extract("value", r"^(\S+)", 1).alias("contig"), F.upper(body).alias("sequence"))


def ledger(spark: SparkSession, path: str, schema: str, rows: int | None = None) -> DataFrame:
    """A ledger with its identity decoded to a map; an error where it hasn't the rows it must have."""
    df = csv(spark, path, schema).withColumn("identity", F.from_json("identity_json", "map<string,string>"))
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{n} rows of {rows}")
    return df


def checked(df: DataFrame, required: list[str], paired: list[tuple[str, str]] = ()) -> DataFrame:
    """df; an error where a column is missing or, in evaluation, one of two paired columns is null and the other not."""
    if missing := [c for c in required if c not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    for a, b in paired:
        df = df.where(F.when(F.col(a).isNull() != F.col(b).isNull(), F.raise_error(F.lit(f"{a} without {b}")).cast("boolean")).otherwise(F.lit(True)))
    return df
