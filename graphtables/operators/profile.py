"""Profiles of raw columns, their store types, and dependencies between tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import iso_date, number, present, truth


def _unpivot(df: DataFrame, names: Sequence[str], key: str) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(c).alias(key), F.col(f"`{c}`").alias("v")) for c in names))
    return df.select(F.explode(parts).alias("x")).select(f"x.{key}", "x.v.*")


def column_profile(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row a column: n, nulls, different, least and greatest value as text. One pass over the table."""
    stats = [F.struct(F.count("*").alias("n"), (F.count("*") - F.count(c)).alias("nulls"), F.count_distinct(c).alias("different"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("greatest")).alias(c) for c in columns]
    return _unpivot(rows.agg(*stats), columns, "column")


def inferred_types(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, type: STRING without values, then BOOL, INT64, DOUBLE, DATE by all values, else STRING."""

    def kind(c: str):
        x = F.col(c)
        n = number(x) if rows.schema[c].dataType.typeName() != "boolean" else F.lit(None).cast("double")
        every = lambda e: F.coalesce(F.bool_and(F.when(x.isNotNull(), F.coalesce(e, F.lit(False)))), F.lit(False))
        boolean = F.lit(rows.schema[c].dataType.typeName() == "boolean")
        return (
            F.when(F.count(x) == 0, "STRING").when(boolean, "BOOL").when(every(n.isNotNull() & (n == F.floor(n)) & (F.abs(n) < 9.3e18)), "INT64").when(every(n.isNotNull()), "DOUBLE").when(every(iso_date(x).isNotNull()), "DATE").otherwise("STRING")
        )

    return _unpivot(rows.agg(*(F.struct(kind(c).alias("type")).alias(c) for c in columns)), columns, "column")


def typed(rows: DataFrame, declared: dict[str, str] | None = None) -> DataFrame:
    """Columns of text cast to the types inferred from all their values; names lower-cased, the first of equals wins.

    A declared type is taken as it is: values that are no number are 0 then, those that are no date null, and a boolean
    is true for the texts that `values.truth` knows; missing values stay null."""
    columns = {}
    for c in rows.columns:
        columns.setdefault(c.lower(), c)
    given = {low: kind for low, kind in ((k.lower(), v) for k, v in (declared or {}).items()) if low in columns}
    open_ = [c for low, c in columns.items() if low not in given]
    kinds = {r["column"]: r["type"] for r in inferred_types(rows, open_).collect()} if open_ else {}  # a row a column
    cast = {"INT64": lambda c: number(c).cast("long"), "DOUBLE": number, "DATE": iso_date}
    zero = lambda kind: lambda c: F.when(present(c), F.coalesce(cast[kind](c), F.lit(0).cast("double" if kind == "DOUBLE" else "long")))
    forced = {"INT64": zero("INT64"), "DOUBLE": zero("DOUBLE"), "DATE": iso_date, "BOOL": truth}
    how = {low: forced.get(given[low]) if low in given else cast.get(kinds[c]) for low, c in columns.items()}
    return rows.select(*((how[low](F.col(c)) if how[low] else F.col(c)).alias(low) for low, c in columns.items()))


def missing_parents(children: DataFrame, column: str, parents: DataFrame, key: str) -> DataFrame:
    """Different child values, and how many of them no parent has: 0 means the foreign key holds."""
    values = children.select(F.col(column).alias("v")).where("v IS NOT NULL").distinct()
    known = parents.select(F.col(key).alias("v"), F.lit(1).alias("known")).distinct()
    return values.join(known, "v", "left").agg(F.count("*").alias("child_values"), F.sum(F.when(F.col("known").isNull(), 1).otherwise(0)).alias("missing"))


def sample_values(rows: DataFrame, column: str, order: str, k: int = 3) -> DataFrame:
    """The first k different values by the least `order` at which they occur."""
    return rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.min(order).alias("at")).orderBy("at", "value").limit(k)


def seeded_sample(rows: DataFrame, by: str, column: str, seed: int, k: int = 3) -> DataFrame:
    """k different values of each group (`by`), chosen by a seeded hash, so that every run chooses the same: by, value, place."""
    values = rows.where(F.col(column).isNotNull()).select(F.col(by).alias("group"), F.col(column).cast("string").alias("value")).distinct()
    order = Window.partitionBy("group").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), "value").cast("binary")), "value")
    return values.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def seeded_rows(rows: DataFrame, table: str, order: str, k: int = 3) -> DataFrame:
    """k rows of a table by a hash of its name and their place, in their own order; all of a table that has no more."""
    return rows.withColumn("_h", F.xxhash64(F.lit(table), order)).orderBy("_h", order).limit(k).drop("_h").orderBy(order)
