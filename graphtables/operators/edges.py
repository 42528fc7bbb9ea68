"""Edges between entities, from rows that name both ends or from equal identifiers across tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import identifier


def same_table_edges(rows: DataFrame, source: Sequence[str], target: Sequence[str], properties: dict[str, str] | None = None) -> DataFrame:
    """src, dst and properties of every row that names both; both ids come from the row, so nothing is joined."""
    props = [F.col(c).alias(p) for p, c in (properties or {}).items()]
    return rows.select(identifier([F.col(c) for c in source]).alias("src"), identifier([F.col(c) for c in target]).alias("dst"), *props).where("src IS NOT NULL AND dst IS NOT NULL")


def cross_table_edges(sources: DataFrame, targets: DataFrame, order: str) -> DataFrame:
    """src, dst of fragments (id, value) that share a value; a value stands for one target, the last one by `order`."""
    ends = targets.groupBy("value").agg(F.max_by("id", F.struct(order, "id")).alias("dst"))
    return sources.join(ends, "value").select(F.col("id").alias("src"), "dst").distinct()


def deduplicated(edges: DataFrame) -> DataFrame:
    """Parallel edges survive where their properties differ."""
    return edges.distinct()


def traced_edges(rows: DataFrame, table: str, order: str, source: Sequence[str], target: Sequence[str], properties: dict[str, str] | None = None) -> DataFrame:
    """As `same_table_edges`, with the table and the row that an edge comes from."""
    props = [F.col(c).alias(p) for p, c in (properties or {}).items()]
    found = rows.select(identifier([F.col(c) for c in source]).alias("src"), identifier([F.col(c) for c in target]).alias("dst"), F.lit(table).alias("table"), F.col(order).cast("long").alias("row"), *props)
    return found.where("src IS NOT NULL AND dst IS NOT NULL")


def unique_edges(parts: Sequence[DataFrame], label: str) -> DataFrame:
    """Edges (src, dst, table, row, properties) with an identity: edge_id, src, dst, properties, table, row, copies.

    Of edges with equal ends and equal properties (as text, a property that a part lacks is null) the one with the least
    row stays, then the one of the earlier part; `copies` says how many it stands for. Parallel edges with different
    properties keep identities of their own. One aggregation with partial sums, so a hot pair of ends is no hot task."""
    placed = [p.withColumn("_part", F.lit(k)) for k, p in enumerate(parts)]
    long = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)
    props = [c for c in long.columns if c not in ("src", "dst", "table", "row", "_part")]
    first = F.min(F.struct("row", "_part", "table", *props)).alias("_first")
    found = long.groupBy("src", "dst", *(F.col(p).cast("string").alias(f"_as_text_{k}") for k, p in enumerate(props))).agg(first, F.count("*").alias("copies"))
    columns = [F.col(f"_first.{c}").alias(c) for c in (*props, "table", "row")]
    edge_id = F.concat_ws("|", "src", F.lit(label), "dst", "table", F.col("row").cast("string"))
    return found.select("src", "dst", *columns, "copies").select(edge_id.alias("edge_id"), "src", "dst", *props, "table", "row", "copies")


def anchored(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges whose two ends exist as entities."""
    out = edges.join(sources.select(F.col("id").alias("src")), "src", "left_semi")
    return out.join(targets.select(F.col("id").alias("dst")), "dst", "left_semi").select(edges.columns)


def materialised(edges: dict[str, DataFrame]) -> DataFrame:
    """predicate, edges of all predicates that have an edge at all."""
    counts = [df.groupBy().agg(F.count("*").alias("edges")).select(F.lit(p).alias("predicate"), "edges") for p, df in edges.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out.where("edges > 0")
