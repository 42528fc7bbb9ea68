"""Fragments of entities from many tables, resolved into one row an entity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import identifier, stripped, value


@dataclass(frozen=True)
class Cluster:
    """A vertical slice of a table that describes entities: key columns, and property -> source columns."""

    table: str
    name: str
    key: Sequence[str]
    properties: dict[str, Sequence[str]] = field(default_factory=dict)


def placed(rows: DataFrame, order: Column, rank: tuple[int, int]) -> Column:
    """Where a fragment stands: table, row, cluster. Numbers are ordered by value, everything else by text."""
    numeric = isinstance(rows.select(order).schema[0].dataType, T.NumericType)
    number = order.cast("decimal(38,9)") if numeric else F.lit(None).cast("decimal(38,9)")
    text = F.lit(None).cast("string") if numeric else order.cast("string")
    return F.struct(F.lit(rank[0]).alias("table"), number.alias("row"), text.alias("row_text"), F.lit(rank[1]).alias("cluster"))


def fragments(rows: DataFrame, cluster: Cluster, order: Column, rank: tuple[int, int] = (0, 0)) -> DataFrame:
    """One row for each row of the table that names the entity: id, _order, properties as text.

    A property takes the first of its source columns that is present; where the cluster names none that the table has,
    the column of the property's own name, if there is one. order: the row's place within its table, from columns that
    identify it; rank: places of table and cluster."""
    known = {c.lower(): c for c in rows.columns}
    of = {p: [known[c.lower()] for c in sources if c.lower() in known] or [known[c] for c in (p.lower(),) if c in known] for p, sources in cluster.properties.items()}
    props = [(F.coalesce(*(value(F.col(c)).cast("string") for c in sources)) if sources else F.lit(None).cast("string")).alias(p) for p, sources in of.items()]
    return rows.select(identifier([F.col(c) for c in cluster.key]).alias("id"), placed(rows, order, rank).alias("_order"), *props).where("id IS NOT NULL")


def rekeyed(found: DataFrame, reference: DataFrame, column: str, key: str, order: str, on: str = "id") -> DataFrame:
    """Rows whose id (`on`) is a secondary key of the reference table get that row's primary key; others keep theirs.

    Of rows with the same secondary key the last by `order` counts."""
    pairs = reference.select(stripped(F.col(column)).alias(on), stripped(F.col(key)).alias("_key"), F.col(order).alias("_at")).where(f"`{on}` <> '' AND _key <> ''")
    pairs = pairs.groupBy(on).agg(F.max_by("_key", F.struct("_at", "_key")).alias("_key"))
    columns = found.columns
    return found.join(pairs, on, "left").withColumn(on, F.coalesce("_key", on)).select(*columns)


def resolved(parts: Sequence[DataFrame]) -> DataFrame:
    """One row an id: for each property the first value present by table, row and cluster."""
    long = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    props = [c for c in long.columns if c not in ("id", "_order")]
    first = [F.expr(f"min_by(`{p}`, _order) FILTER (WHERE `{p}` IS NOT NULL)").alias(p) for p in props]
    return long.groupBy("id").agg(F.count("*").alias("fragments"), *first)


def provenance(parts: Sequence[DataFrame]) -> DataFrame:
    """id, source (the table's rank), fragments: from which tables an entity was put together."""
    long = reduce(lambda a, b: a.union(b), (p.select("id", F.col("_order.table").alias("source")) for p in parts))
    return long.groupBy("id", "source").agg(F.count("*").alias("fragments"))


def lineage(parts: Sequence[tuple[Cluster, DataFrame]]) -> DataFrame:
    """id, table, row, cluster, key: every fragment that an entity was put together from, a row each, however many."""
    rows = [p.select("id", F.lit(c.table).alias("table"), F.coalesce(F.regexp_replace(F.col("_order.row").cast("string"), r"\.?0+$", ""), "_order.row_text").alias("row"), F.lit(c.name).alias("cluster"), F.lit("|".join(c.key)).alias("key")) for c, p in parts]
    return reduce(DataFrame.union, rows)


def naturally_ordered(entities: DataFrame) -> DataFrame:
    """Numeric ids first, by value, then the others by text."""
    n = F.col("id").try_cast("double")
    return entities.orderBy(n.asc_nulls_last(), "id")
