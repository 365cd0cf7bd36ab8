"""Writers: tables, ledgers, reports, manifests and metadata."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parquet(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    (df.select(*columns) if columns else df).write.mode("overwrite").parquet(path)


def csv(df: DataFrame, path: str, gzip: bool = False) -> None:
    """CSV with a head line; arrays, maps and structs as JSON."""
    flat = [F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else F.col(f"`{f.name}`") for f in df.schema]
    df.select(*flat).write.mode("overwrite").options(header=True, escape='"', **({"compression": "gzip"} if gzip else {})).csv(path)


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line; nulls and NaN are null."""
    df.select(F.to_json(F.struct(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`") for f in df.schema]), {"ignoreNullFields": "false"})).write.mode("overwrite").text(path)


def clean(value):
    """A report's value with NaN and infinity as None, at any depth."""
    if isinstance(value, dict):
        return {k: clean(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [clean(v) for v in value]
    return None if isinstance(value, float) and not math.isfinite(value) else value


def report(values: dict) -> str:
    return json.dumps(clean(values), indent=2, sort_keys=True)


def gate(df: DataFrame, item: str, flag: str, notation: str) -> None:
    """An error where a table is empty, an id is null or the flag isn't that of the notation; one pass."""
    r = df.agg(F.count("*").alias("n"), F.count_if(F.col(item).isNull()).alias("ids"), F.count_if(F.col(flag) != F.col(notation).isNotNull()).alias("flags")).first()
    if not r.n or r.ids or r.flags:
        raise ValueError(f"rows {r.n}, null ids {r.ids}, wrong flags {r.flags}")


def manifest(tables: dict[str, DataFrame], item: str, patent: str, target: str) -> DataFrame:
    """table, rows, eligible, items, patents, targets of each table."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("rows"), F.count_if("model_eligible").alias("eligible"), F.countDistinct(item).alias("items"), F.countDistinct(patent).alias("patents"), F.countDistinct(target).alias("targets")).select(F.lit(name).alias("table"), "*")
        out = one if out is None else out.unionByName(one)
    return out


#: Names of types in published metadata.
PUBLISHED = {"boolean": "sc:Boolean", "double": "sc:Float", "float": "sc:Float", "string": "sc:Text", "int": "sc:Integer", "bigint": "sc:Integer", "smallint": "sc:Integer", "tinyint": "sc:Integer", "decimal": "sc:Float"}


def fields(schema: T.StructType) -> list[dict]:
    """Metadata of columns: type and whether a list."""
    out = []
    for f in schema:
        many = isinstance(f.dataType, T.ArrayType)
        kind = (f.dataType.elementType if many else f.dataType).simpleString().split("(")[0]
        out.append({"name": f.name, "dataType": PUBLISHED.get(kind, "sc:Text"), "repeated": many})
    return out


def hashes(df: DataFrame) -> DataFrame:
    """path, size, sha256 of binary files read with format("binaryFile")."""
    return df.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def render(template: str, values: dict[str, str]) -> str:
    """A template with its <<TOKENS>> filled; an error where one is left."""
    out = re.sub(r"<<(\w+)>>", lambda m: str(values.get(m[1], m[0])), template)
    if left := re.findall(r"<<\w+>>", out):
        raise ValueError(f"unfilled: {', '.join(left)}")
    return out


def stale(remote: list[str], allowed: list[str]) -> list[str]:
    """Published files that no longer belong."""
    return sorted(set(remote) - set(allowed) - {".gitattributes"})


def cache_key(*parts: F.Column) -> F.Column:
    """The key of a stored answer: a hash over all that it depends on."""
    return F.sha2(F.concat_ws("|||", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with new's rows in place of those of the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
