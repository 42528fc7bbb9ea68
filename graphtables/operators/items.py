"""Many small tables at once, in long form: item, table, row, place, column, value, kind.

Ten thousand items with a few tables each are one job of grouped aggregates, not a job for every table. A group is a
column of a table or a key of an entity and is added up on the map side, so a large table is no large group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import iso_date, number, stripped, truth, value
from ..sources.shared import parts as parts_for
from ..sources.shared import saved

ROW = ("item", "table", "row")
CELL = ("item", "table", "row", "place", "column", "value", "kind")

def cells(rows: DataFrame, item: Column, table: str, row: Column, columns: Sequence[str]) -> DataFrame:
    """A table in long form, one row a cell; cells are text but for booleans, and `item` deals rows to items."""
    kind = lambda c: F.when(F.col(c).isNull(), "null").otherwise(F.lit("boolean" if rows.schema[c].dataType.typeName() == "boolean" else "text"))
    parts = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), kind(c).alias("kind")) for k, c in enumerate(columns)))
    return rows.select(item.alias("item"), F.lit(table).alias("table"), row.cast("long").alias("row"), F.explode(parts).alias("c")).select("item", "table", "row", "c.*")


def normalised(found: DataFrame) -> DataFrame:
    """Column names in lower case; of names that are equal then, the first column of the table stays, the others go."""
    names = found.groupBy("item", "table", F.lower("column").alias("column")).agg(F.min("place").alias("place"))
    return found.withColumn("column", F.lower("column")).join(names, ["item", "table", "column", "place"], "left_semi").select(*CELL)


def column_types(found: DataFrame) -> DataFrame:
    """item, table, column, type, n, nulls: STRING without values, then BOOL, INT64, DOUBLE, DATE by all values, else STRING."""
    boolean = F.col("kind") == "boolean"
    read = found.select("item", "table", "column", "kind", value(F.col("value")).alias("v"), F.when(~boolean, number(F.col("value"))).alias("x"), F.col("value"))
    v, n = F.col("v"), F.col("x")
    every = lambda e: F.coalesce(F.bool_and(F.when(v.isNotNull(), F.coalesce(e, F.lit(False)))), F.lit(False))
    whole = n.isNotNull() & (n == F.floor(n)) & (F.abs(n) < 9.3e18)
    kind = F.when(F.count(v) == 0, "STRING").when(every(boolean), "BOOL").when(every(whole), "INT64").when(every(n.isNotNull()), "DOUBLE").when(every(iso_date(F.col("value")).isNotNull()), "DATE").otherwise("STRING")
    return read.groupBy("item", "table", "column").agg(kind.alias("type"), F.count("*").alias("n"), (F.count("*") - F.count(v)).alias("nulls"))


def typed_cells(found: DataFrame, types: DataFrame) -> DataFrame:
    """Cells with their column's type and one typed value beside the text: as_long, as_double, as_date, as_bool.

    Missing cells have no typed value. types: item, table, column, type, inferred or declared; where a declared type does
    not fit, integers and doubles are 0, dates null, and a boolean is true for `true`, `1`, `yes` and `y` alone."""
    v, t = value(F.col("value")), F.col("type")
    typed = lambda kind, e: F.when(v.isNotNull() & (t == kind), e)
    return found.join(types.select("item", "table", "column", "type"), ["item", "table", "column"]).select(
        "item",
        "table",
        "row",
        "column",
        v.alias("value"),
        "type",
        typed("INT64", F.coalesce(number(v).try_cast("long"), F.lit(0).cast("long"))).alias("as_long"),
        typed("DOUBLE", F.coalesce(number(v), F.lit(0.0))).alias("as_double"),
        typed("DATE", iso_date(v)).alias("as_date"),
        typed("BOOL", truth(v)).alias("as_bool"),
    )


def row_keys(found: DataFrame, keys: DataFrame) -> DataFrame:
    """item, table, row, id: the key of every row that has all parts of its table's key. keys: item, table, place, column.

    Rows of tables without a key, and rows that lack a part, have none and are left out."""
    of = keys.select("item", "table", F.lower("column").alias("column"), F.col("place").alias("part"))
    parts = of.groupBy("item", "table").agg(F.count("*").alias("parts"))
    cells = found.join(of, ["item", "table", "column"]).select(*ROW, "part", stripped(value(F.col("value"))).alias("v"))
    rows = cells.groupBy(*ROW).agg(F.count("v").alias("n"), F.sort_array(F.collect_list(F.struct("part", "v"))).alias("id"))  # a cell a part of the key
    return rows.join(parts, ["item", "table"]).where("n = parts").select("item", "table", "row", F.array_join("id.v", "|").alias("id"))


def identified(found: DataFrame, ids: DataFrame) -> DataFrame:
    """Cells with their row's key; found is best a saved table, as its cells are counted first to deal them out."""
    n = parts_for(found.sparkSession, found.count())
    return found.repartition(n, *ROW).join(ids.repartition(n, *ROW), list(ROW))


def key_conflicts(found: DataFrame, ids: DataFrame) -> DataFrame:
    """item, table, column, conflicting: whether a column takes two values, a missing one among them, for one key."""
    cells = identified(found, ids).select("item", "table", "column", "id", value(F.col("value")).alias("v"))
    groups = cells.groupBy("item", "table", "column", "id").agg(((F.min("v") != F.max("v")) | ((F.count("v") > 0) & (F.count("v") < F.count("*")))).alias("differs"))
    return groups.groupBy("item", "table", "column").agg(F.coalesce(F.bool_or("differs"), F.lit(False)).alias("conflicting"))


def resolved_cells(found: DataFrame, ids: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """item, entity, id, column, value, table, row, kind: for each property of an entity the first value present.

    classes: item, table, entity, rank tells which tables describe one class and in which order they are asked; without
    it every table is a class of its own."""
    rows = identified(found.withColumn("value", value(F.col("value"))).where("value IS NOT NULL"), ids)
    rows = rows.withColumn("entity", F.col("table")).withColumn("rank", F.lit(0)) if classes is None else rows.join(classes, ["item", "table"])
    first = F.min(F.struct("rank", "table", "row", "place", "value", "kind"))
    return rows.groupBy("item", "entity", "id", "column").agg(first.alias("x")).select("item", "entity", "id", "column", "x.value", "x.table", "x.row", "x.kind")


def typed_items(found: DataFrame, keys: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Typed entities of all items: item, entity, id, column, value, type, as_long, as_double, as_date, as_bool.

    Types are those of an entity's column over all entities of the class in the item, after resolution."""
    clean = saved(normalised(found), "cells")
    merged = resolved_cells(clean, row_keys(clean, keys), classes)
    kind = F.when(F.col("kind") == "boolean", "boolean").otherwise("text")
    entity = saved(merged.select("item", F.col("entity").alias("table"), F.col("id").alias("row"), "column", "value", kind.alias("kind")), "entities")
    return typed_cells(entity, column_types(entity)).withColumnsRenamed({"table": "entity", "row": "id"})
