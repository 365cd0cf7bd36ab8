"""Printed tables to long entries: headers over several rows, rows that spill over, properties carried down, texts split over rows,
and tables with a compound a column.

A printed table is one document's, so its rows stay together; nothing here gathers more than one table's rows of one column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.helm import let
from ..functions.text import header

#: How a cell prints a compound's number; a piece of a sequence; headers of properties that hold for the rows below.
COMPOUND = r"^(?:[A-Za-z]+[ -]?)?(\d{4,7})[†‡*]?$"
PIECE = r"^[ACGTUacgtu]{2,}$"
CARRIED = r"(?:^|_)(?:dose|dosage|treatment|concentration|conc|time)(?:_|$)"


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _cells(row: Column) -> Column:
    """All cells but the first."""
    return F.slice(row, F.lit(2), F.greatest(F.size(row) - 1, F.lit(0)))


def _some(cells: Column, test) -> Column:
    return F.size(F.filter(cells, test))


def typed(rows: DataFrame) -> DataFrame:
    """A row a table of rows (table_id, position, cells): its rows in order, kind, start and names. A: a compound a row, start is its first data row; B: a compound a column, start is the row that names them.

    A row names compounds where its first cell is none and half or more of its other cells that aren't blank are. A table with neither
    has no kind. names: of A, each column's header, its parts of all rows above the data in order, null where all are blank; of B, the cells of start.
    """
    own, rest = F.coalesce(F.get("cells", F.lit(0)).rlike(COMPOUND), F.lit(False)), _cells(F.col("cells"))
    named, there = _some(rest, lambda c: c.rlike(COMPOUND)), _some(rest, lambda c: ~blank(c))
    seen = rows.withColumn("is_compound", own)
    across = ~own & (named > 0) & (2 * named >= there)
    line = F.struct("position", "cells", "is_compound")
    whole = seen.groupBy("table_id").agg(F.array_sort(F.collect_list(line)).alias("rows"), F.min(F.when(own, F.col("position"))).alias("__a"), F.min(F.when(across, F.col("position"))).alias("__b"))
    across = F.col("__b").isNotNull() & (F.col("__a").isNull() | (F.col("__b") < F.col("__a")))
    whole = whole.withColumns({"kind": F.when(across, "B").when(F.col("__a").isNotNull(), "A"), "start": F.when(across, F.col("__b")).otherwise(F.col("__a"))}).where("kind IS NOT NULL")
    above = F.filter("rows", lambda r: r["position"] < F.col("start"))
    parts = lambda k: F.filter(F.transform(above, lambda r: F.get(r["cells"], k)), lambda c: ~blank(c))
    width = F.array_max(F.transform("rows", lambda r: F.size(r["cells"])))
    heads = F.transform(F.sequence(F.lit(0), width - 1), lambda k: let(parts(k), lambda x: F.when(F.size(x) > 0, header(F.array_join(x, " ")))))
    at = F.get(F.filter("rows", lambda r: r["position"] == F.col("start")), F.lit(0))["cells"]
    return whole.select("table_id", "rows", "kind", "start", F.when(F.col("kind") == "A", heads).otherwise(at).alias("names"))


def entries(rows: DataFrame) -> DataFrame:
    """table_id, kind, position, compound, field, value: a row for each value of rows (table_id, position, cells).

    A: rows without a compound belong to the one above. Such a row that prints nothing but pieces of sequences carries on those of
    its compound and is no entry; any other is an entry of its own. Pieces join in order and hold for all of a compound's entries.
    Properties (CARRIED) take the last value printed for the compound. B: one entry a row and compound; the first cell is the field.
    Blank values, rows above the data and tables without a kind give nothing; a cell beyond the headers is column_<k>. A table's rows
    meet once, in one task, and move no more.
    """
    number = lambda c: F.regexp_extract(F.trim(c), COMPOUND, 1)
    is_a = F.col("kind") == "A"
    data = F.filter("rows", lambda r: F.when(F.col("kind") == "A", r["position"] >= F.col("start")).otherwise(r["position"] > F.col("start")))
    row = typed(rows).select("table_id", "kind", "names", F.explode(data).alias("r")).select("table_id", "kind", "names", "r.*")
    up = Window.partitionBy("table_id").orderBy("position")
    filled = F.filter("cells", lambda c: ~blank(c))
    pieces = is_a & ~F.col("is_compound") & (F.size(filled) > 0) & F.forall(filled, lambda c: c.rlike(PIECE))
    row = row.withColumn("first", F.get("cells", F.lit(0))).withColumns({"above": F.last(F.when(is_a & F.col("is_compound"), number(F.col("first"))), ignorenulls=True).over(up), "island": F.sum(F.col("is_compound").cast("long")).over(up), "pieces": pieces})
    row = row.withColumn("label", F.when(~is_a, header(F.col("first"))))

    each = F.filter(F.transform("cells", lambda c, k: F.struct(k.alias("k"), F.get("names", k).alias("name"), c.alias("cell"))), lambda x: (x["k"] > 0) & ((F.col("kind") == "A") | x["name"].rlike(COMPOUND)))
    cell = row.select("table_id", "kind", "position", "above", "island", "is_compound", "pieces", "label", F.explode(each).alias("x")).select("*", "x.*").drop("x")
    cell = cell.withColumn("compound", F.when(is_a, F.col("above")).otherwise(number(F.col("name")))).withColumn("field", F.when(is_a, F.coalesce("name", F.concat(F.lit("column_"), F.col("k").cast("string")))).otherwise(F.col("label")))
    cell = cell.withColumn("own", F.when(~blank(F.col("cell")), F.trim("cell"))).drop("above", "name", "label", "cell")
    at = Window.partitionBy("table_id", "island", "k")
    piece = F.when(is_a & (F.col("is_compound") | F.col("pieces")) & F.col("own").rlike(PIECE), F.struct("position", "own"))
    cell = cell.withColumns({"__pieces": F.collect_list(piece).over(at), "__last": F.last("own", ignorenulls=True).over(at.orderBy("position"))})
    joined = F.array_join(F.array_sort("__pieces")["own"], "")
    carried = F.when(is_a & F.col("field").rlike(CARRIED), F.col("__last"))
    value = F.coalesce(F.nullif(joined, F.lit("")), carried, F.col("own"))
    return cell.where(~F.col("pieces")).select("table_id", "kind", "position", "compound", "field", value.alias("value")).where(~blank(F.col("value")))
