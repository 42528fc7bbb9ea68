"""Queries over many tables at once in long form: types, keys, entities, dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import dependencies, items
from .plans import alignment
from .registry import Tables, query
from .sources.shared import saved

#: The key columns of the tables, among which inclusions are looked for.
COLUMNS = {
    "region": ("r_regionkey",),
    "nation": ("n_nationkey", "n_regionkey"),
    "customer": ("c_custkey", "c_nationkey"),
    "supplier": ("s_suppkey", "s_nationkey"),
    "part": ("p_partkey", "p_size"),
    "orders": ("o_orderkey", "o_custkey"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey"),
    "events": ("user_id", "event_type"),
}
VALUES = " UNION ALL ".join(f"SELECT '{t}' AS t, '{c}' AS c, {k} AS place, CAST({c} AS VARCHAR) AS x FROM {t}" for t, names in COLUMNS.items() for k, c in enumerate(names))
INCLUDED = f"""v AS ({VALUES}), d AS (SELECT t, c, x, count(*) AS k FROM v WHERE x IS NOT NULL GROUP BY 1, 2, 3), n AS (SELECT t, c, count(*) AS different, max(k) = 1 AS single FROM d GROUP BY 1, 2),
  pairs AS (SELECT a.t, a.c, b.t AS u, b.c AS e, count(*) AS shared FROM d a JOIN d b ON a.x = b.x AND (a.t, a.c) <> (b.t, b.c) GROUP BY 1, 2, 3, 4),
  found AS (SELECT p.t, p.c, n.different, p.u, p.e, m.different AS to_different, p.shared, m.single FROM pairs p JOIN n ON n.t = p.t AND n.c = p.c JOIN n m ON m.t = p.u AND m.c = p.e WHERE p.shared = n.different)"""


def key_cells(t: Tables) -> DataFrame:
    parts = [items.cells(getattr(t, name), F.lit(0), name, F.lit(0), columns) for name, columns in COLUMNS.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def nation_items(t: Tables) -> DataFrame:
    """Every nation as an item of two tables: its customers, and their orders."""
    customer = t.customer.withColumn("mixed", F.when(F.col("c_nationkey") % 2 == 0, F.col("c_custkey").cast("string")).otherwise(F.col("c_mktsegment")))
    one = items.cells(customer, F.col("c_nationkey"), "customer", F.col("c_custkey"), ["c_custkey", "c_acctbal", "c_mktsegment", "mixed"])
    repeated = items.cells(customer, F.col("c_nationkey"), "customer", F.col("c_custkey"), ["mixed"]).withColumns({"column": F.lit("C_MktSegment"), "place": F.lit(9)})  # a name that is taken
    wide = t.orders.join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    wide = wide.select("c_nationkey", "o_orderkey", F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"))
    two = items.cells(wide, F.col("c_nationkey"), "orders", F.col("o_orderkey"), ["c_custkey", "status", "day", "urgent"])
    return one.unionByName(repeated).unionByName(two)


def item_tables(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Keys and classes of the items' tables: both are keyed by the customer and describe one class."""
    tables = found.select("item", "table").distinct()
    keys = tables.select("item", "table", F.lit(0).alias("place"), F.lit("c_custkey").alias("column"))
    return keys, tables.select("item", "table", F.lit("Customer").alias("entity"), F.when(F.col("table") == "customer", 0).otherwise(1).alias("rank"))


@query(
    """WITH c AS (SELECT c_nationkey AS item, CAST(c_custkey AS VARCHAR) AS id, CAST(c_acctbal AS VARCHAR) AS b, c_mktsegment AS m, CASE WHEN c_nationkey % 2 = 0 THEN CAST(c_custkey AS VARCHAR) ELSE c_mktsegment END AS x FROM customer),
o AS (SELECT c_nationkey AS item, CAST(o_custkey AS VARCHAR) AS id, min_by(o_orderstatus, o_orderkey) AS s, min_by(strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) AS d, CAST(min_by(o_orderpriority = '1-URGENT', o_orderkey) AS VARCHAR) AS u FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
long AS (SELECT item, id, 'c_custkey' AS c, id AS v, false AS b FROM c UNION ALL SELECT item, id, 'c_acctbal', b, false FROM c UNION ALL SELECT item, id, 'c_mktsegment', m, false FROM c UNION ALL SELECT item, id, 'mixed', x, false FROM c
  UNION ALL SELECT item, id, 'status', s, false FROM o UNION ALL SELECT item, id, 'day', d, false FROM o UNION ALL SELECT item, id, 'urgent', u, true FROM o),
types AS (SELECT item, c, CASE WHEN bool_and(b) THEN 'BOOL' WHEN coalesce(bool_and(TRY_CAST(v AS DOUBLE) = floor(TRY_CAST(v AS DOUBLE))), false) AND bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'INT64' WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'DOUBLE' WHEN bool_and(regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}')) THEN 'DATE' ELSE 'STRING' END AS type FROM long GROUP BY 1, 2)
SELECT long.item, long.id, long.c AS "column", v AS value, type, CASE type WHEN 'INT64' THEN CAST(TRY_CAST(v AS DOUBLE) AS BIGINT) END AS as_long, CASE type WHEN 'DOUBLE' THEN TRY_CAST(v AS DOUBLE) END AS as_double, CASE type WHEN 'DATE' THEN v END AS as_date, CASE type WHEN 'BOOL' THEN v = 'true' END AS as_bool
FROM long JOIN types ON types.item = long.item AND types.c = long.c WHERE v IS NOT NULL"""
)
def typed_items(g, t):
    """Typed entities of every item at once: keys, first values over two tables, and types by item and column."""
    found = nation_items(t)
    out = items.typed_items(found, *item_tables(found))
    return out.select("item", "id", "column", "value", "type", "as_long", "as_double", F.col("as_date").cast("string").alias("as_date"), "as_bool")


@query(
    """WITH r AS (SELECT c_nationkey AS item, o_custkey AS k, o_orderstatus AS s, o_orderdate AS d, o_orderpriority = '1-URGENT' AS u FROM orders JOIN customer ON o_custkey = c_custkey),
g AS (SELECT item, k, count(DISTINCT s) > 1 AS s, count(DISTINCT d) > 1 AS d, count(DISTINCT u) > 1 AS u FROM r GROUP BY 1, 2)
SELECT item, 'orders' AS "table", 'status' AS "column", bool_or(s) AS conflicting FROM g GROUP BY 1 UNION ALL SELECT item, 'orders', 'day', bool_or(d) FROM g GROUP BY 1 UNION ALL SELECT item, 'orders', 'urgent', bool_or(u) FROM g GROUP BY 1 UNION ALL SELECT item, 'orders', 'c_custkey', false FROM g GROUP BY 1
UNION ALL SELECT DISTINCT c_nationkey, 'customer', unnest(['c_custkey', 'c_acctbal', 'c_mktsegment', 'mixed']), false FROM customer"""
)
def item_key_conflicts(g, t):
    """Columns that contradict the declared key, for every table of every item in one job."""
    found = saved(items.normalised(nation_items(t)), "cells")
    return items.key_conflicts(found, items.row_keys(found, item_tables(found)[0]))


@query(f"WITH {INCLUDED} SELECT t AS \"table\", c AS \"column\", different, u AS to_table, e AS to_column, to_different, shared, single AS \"unique\" FROM found")
def inclusion_candidates(g, t):
    """All inclusion dependencies among the key columns of eight tables, found in one shuffle of their values."""
    return dependencies.inclusions(key_cells(t)).drop("item")


@query(
    f"""WITH {INCLUDED}, words AS (SELECT *, list_distinct(string_split(c, '_')) AS own, list_distinct(list_concat([u], string_split(e, '_'))) AS far FROM found WHERE single AND t <> u),
scored AS (SELECT *, round(len(list_intersect(own, far)) / len(list_distinct(list_concat(own, far))), 4) AS alike FROM words)
SELECT t AS "table", c AS "column", u AS to_table, e AS to_column FROM scored WHERE alike > 0 QUALIFY row_number() OVER (PARTITION BY t, c ORDER BY alike DESC, to_different, u, e) = 1"""
)
def discovered_references(g, t):
    """The foreign keys that the inclusions and the columns' names speak for."""
    return dependencies.likely_references(dependencies.inclusions(key_cells(t))).drop("item")


@query(
    f"""WITH v AS ({VALUES}), s AS (SELECT t, c, x FROM (SELECT DISTINCT t, c, x FROM v WHERE x IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY t, c ORDER BY md5(concat_ws(':', '42', t, c, x)), x) <= 3),
l AS (SELECT t, c, string_agg(x, ',' ORDER BY md5(concat_ws(':', '42', t, c, x)), x) AS samples FROM s GROUP BY 1, 2)
SELECT v.t AS "table", v.c AS "column", min(place) AS place, CASE WHEN v.c = 'c_nationkey' THEN 'where the customer lives' ELSE '' END AS description, CASE WHEN v.c = 'c_nationkey' THEN 'reference' ELSE 'categorical' END AS semantic_type,
  CASE WHEN v.c = 'c_nationkey' THEN 'foreign_key' ELSE '' END AS identifier_kind, CASE WHEN bool_and(TRY_CAST(x AS BIGINT) IS NOT NULL) FILTER (x IS NOT NULL) THEN 'INT64' ELSE 'STRING' END AS type, count(*) AS n, count(*) - count(x) AS nulls, any_value(l.samples) AS samples
FROM v LEFT JOIN l ON l.t = v.t AND l.c = v.c GROUP BY v.t, v.c"""
)
def column_understanding(g, t):
    """Every column once, with defaults for what nobody proposed, its type and seeded samples."""
    proposed = t.spark.createDataFrame([(0, "CUSTOMER", "C_NationKey", " where the customer lives ", "reference", "Foreign_Key"), (0, "customer", "c_nationkey", "", "", ""), (0, "customer", "no_such", "x", "y", "z")], "item int, table string, column string, description string, semantic_type string, identifier_kind string")
    return dependencies.understood(key_cells(t), proposed).drop("item").withColumn("samples", F.array_join("samples", ","))


@query(
    """WITH v AS (SELECT 's' AS side, 's_suppkey' AS c, 0 AS place, CAST(s_suppkey AS VARCHAR) AS x FROM supplier UNION ALL SELECT 's', 's_name', 1, s_name FROM supplier UNION ALL SELECT 's', 's_nationkey', 2, CAST(s_nationkey AS VARCHAR) FROM supplier
  UNION ALL SELECT 'c', 'c_custkey', 0, CAST(c_custkey AS VARCHAR) FROM customer UNION ALL SELECT 'c', 'c_name', 1, c_name FROM customer UNION ALL SELECT 'c', 'c_nationkey', 2, CAST(c_nationkey AS VARCHAR) FROM customer UNION ALL SELECT 'c', 'c_mktsegment', 3, c_mktsegment FROM customer),
d AS (SELECT * FROM (SELECT DISTINCT * FROM v) QUALIFY row_number() OVER (PARTITION BY c ORDER BY md5(concat_ws(':', '42', 't', c, x)), x) <= 20),
p AS (SELECT side, c, place, list(x) AS xs, string_split(c, '_') AS w FROM d GROUP BY 1, 2, 3),
s AS (SELECT a.c AS name, b.c AS known, b.place, round(least(1.0, len(list_filter(a.w, lambda x: len(list_filter(b.w, lambda y: x = y OR (len(x) >= 3 AND len(y) >= 3 AND (starts_with(x, y) OR starts_with(y, x))))) > 0)) / least(len(a.w), len(b.w))), 4) AS n,
  len(list_intersect(a.xs, b.xs)) / len(list_distinct(list_concat(a.xs, b.xs))) AS o FROM p a JOIN p b ON a.side = 's' AND b.side = 'c')
SELECT name, known, round(0.35 * n + 0.30 * n + 0.15 * o, 4) AS score FROM s WHERE n > 0"""
)
def alignment_scores(g, t):
    """How alike the columns of suppliers and customers are, by name and by seeded samples of their values."""

    def properties(rows: DataFrame, names: list[str]) -> DataFrame:
        meanings = dependencies.understood(items.cells(rows, F.lit(0), "t", F.lit(0), names), samples=20)
        return meanings.select("item", F.col("column").alias("name"), "place", "samples", F.array("column").alias("columns"), "description")

    new, known = properties(t.supplier, ["s_suppkey", "s_name", "s_nationkey"]), properties(t.customer, ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return alignment.scored_pairs(new, known).select("name", "known", "score")
