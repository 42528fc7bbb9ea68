"""Registered queries over the driver's tables, their SQL, and the tables as a property graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.graph import Edge, PropertyGraph
from .sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def keep(f: Callable[[PropertyGraph, Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            t = Tables(spark, sf_dir)
            return f(commerce(t), t)

        QUERIES[f.__name__], SQL[f.__name__] = run, sql
        return f

    return keep


class Tables:
    """The tables of a folder by name, each opened when it is first needed and once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        rows = self.__dict__[name] = table(self.spark, self.folder, name)
        return rows


def commerce(t: Tables) -> PropertyGraph:
    """The tables as a property graph; ids are the business keys. No table is opened before a pattern needs it."""
    node = lambda name, key: lambda: getattr(t, name).withColumnRenamed(key, "id")
    line = [F.col(f"l_{c}").alias(c) for c in ("quantity", "extendedprice", "discount", "shipdate", "linenumber")]

    def edge(name: str, src: str, dst: str, source: str, target: str, key: tuple[str, ...], props: list[Column] = []) -> Edge:
        return Edge(lambda: getattr(t, name).select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.struct(*key).alias("edge_id"), *props), source, target)

    return PropertyGraph(
        {"Region": node("region", "r_regionkey"), "Nation": node("nation", "n_nationkey"), "Customer": node("customer", "c_custkey"), "Supplier": node("supplier", "s_suppkey"), "Part": node("part", "p_partkey"), "Order": node("orders", "o_orderkey"), "Event": node("events", "event_id")},
        {
            "in_region": edge("nation", "n_nationkey", "n_regionkey", "Nation", "Region", ("n_nationkey",)),
            "lives_in": edge("customer", "c_custkey", "c_nationkey", "Customer", "Nation", ("c_custkey",)),
            "based_in": edge("supplier", "s_suppkey", "s_nationkey", "Supplier", "Nation", ("s_suppkey",)),
            "places": edge("orders", "o_custkey", "o_orderkey", "Customer", "Order", ("o_orderkey",)),
            "contains": edge("lineitem", "l_orderkey", "l_partkey", "Order", "Part", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), line),
            "supplied_by": edge("lineitem", "l_orderkey", "l_suppkey", "Order", "Supplier", ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")),
            "performs": edge("events", "user_id", "event_id", "Customer", "Event", ("event_id",)),
        },
    )
