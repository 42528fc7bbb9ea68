"""Writers: graphs, CSV tables, result logs that can be resumed, and column mappings."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.graph import ENDS, Edge, PropertyGraph


def write_graph(graph: PropertyGraph, path: str) -> None:
    """One parquet folder for each label and each relationship."""
    for label, rows in graph.nodes.items():
        rows.write.mode("overwrite").parquet(f"{path}/nodes/{label}")
    for name, edge in graph.edges.items():
        edge.rows.write.mode("overwrite").parquet(f"{path}/edges/{edge.source}-{name}-{edge.target}")


def read_graph(spark: SparkSession, path: str, labels: list[str], edges: dict[str, tuple[str, str]]) -> PropertyGraph:
    nodes = {label: spark.read.parquet(f"{path}/nodes/{label}") for label in labels}
    return PropertyGraph(nodes, {n: Edge(spark.read.parquet(f"{path}/edges/{a}-{n}-{b}"), a, b) for n, (a, b) in edges.items()})


def write_csv(rows: DataFrame, path: str) -> bool:
    """Writes a table unless it has no rows."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").csv(path, header=True)
    return True


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store Spark reads it from."""
    try:
        spark.read.format("binaryFile").load(path).limit(0).count()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise
    return True


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Appends one row for each key that the log does not hold yet, so that a run can be resumed; of rows with equal keys
    the least is taken, and a null key is a key."""
    spark = rows.sparkSession
    columns = rows.columns
    new = rows.groupBy(F.col(key).alias("_key")).agg(F.min(F.struct(*columns)).alias("_row"))
    if exists(spark, path):
        done = spark.read.schema(rows.schema).parquet(path).select(F.col(key).alias("_done")).distinct()
        new = new.join(done, F.col("_key").eqNullSafe(F.col("_done")), "left_anti")
    new.select("_row.*").write.mode("append").parquet(path)


def write_document(spark: SparkSession, content: dict | list, path: str) -> None:
    """A small JSON document (a schema, a report, key relations) as a folder with one text file."""
    spark.createDataFrame([(json.dumps(content, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_rows(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Result rows as JSON lines, for each value of `by` in a folder of its own."""
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def graph_report(graph: PropertyGraph) -> dict:
    """Labels and relationships with their properties and instances, and sums."""
    counts = {(r.kind, r.name): r.n for r in graph.counted().collect()}  # a row a label or relationship
    nodes = {n: {"instances": counts[("node", n)], "properties": [c for c in rows.columns if c != "id"]} for n, rows in graph.nodes.items()}
    edges = {n: {"instances": counts[("edge", n)], "source": e.source, "target": e.target, "properties": [c for c in e.rows.columns if c not in ENDS]} for n, e in graph.edges.items()}
    return {"nodes": nodes, "edges": edges, "num_nodes": sum(x["instances"] for x in nodes.values()), "num_edges": sum(x["instances"] for x in edges.values())}


def key_relations(references: DataFrame, keys: dict[str, list[str]]) -> dict:
    """Primary keys and references of every table, as the document that stands beside exported tables."""
    out = {t: {"primary_keys": list(k), "foreign_keys": []} for t, k in keys.items()}
    for r in references.orderBy("table", "column", "to_table", "to_column").collect():  # a row a declared reference
        out.setdefault(r.table, {"primary_keys": [], "foreign_keys": []})["foreign_keys"].append({"column": r.column, "references": f"{r.to_table}.{r.to_column}"})
    return out
