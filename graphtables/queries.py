"""Queries of graph patterns, entities and answers; those of tables and of generation are in modules of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import generation_queries, table_queries  # noqa: F401  they register themselves
from .functions.values import identifier, jaccard, name_tokens, present, snake_case, value
from .operators import answers, benchmarks, edges, entities, keys, profile
from .plans import schema
from .plans.graph import Match, PropertyGraph, numbered, winners
from .registry import QUERIES, SQL, query  # noqa: F401

# paths

@query("SELECT DISTINCT c_name AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 3")
def hop1_distinct(g, t):
    return g.match("n", "Nation", id=3).into("n", "lives_in", "c", ("c_name",)).rows.select(F.col("c_c_name").alias("answer")).distinct()


@query("SELECT DISTINCT c_mktsegment AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region)")
def hop2_distinct(g, t):
    first = t.region.agg(F.min("r_name").alias("n_r_name"))
    rows = g.match("n", "Region", ("r_name",)).rows.join(first, "n_r_name", "left_semi")
    return Match(g, rows).into("n", "in_region", "a").into("a", "lives_in", "c", ("c_mktsegment",)).rows.select(F.col("c_c_mktsegment").alias("answer")).distinct()


@query("SELECT count(DISTINCT o_orderkey) AS answer FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def hop3_count_distinct(g, t):
    m = g.match("r", "Region", id=1).into("r", "in_region", "n").into("n", "lives_in", "c").out("c", "places", "o")
    return m.rows.agg(F.count_distinct("o_id").alias("answer"))


@query("SELECT DISTINCT p_brand AS answer FROM part JOIN lineitem ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def hop4_distinct(g, t):
    m = g.match("r", "Region", id=2).into("r", "in_region", "n").into("n", "lives_in", "c").out("c", "places", "o").frontier("o").out("o", "contains", "p").frontier("p")
    return m.rows.join(g.node("p", "Part", ("p_brand",), {}), "p_id").select(F.col("p_p_brand").alias("answer")).distinct()


@query("SELECT DISTINCT c_name AS answer FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_partkey = 7")
def hop_reverse(g, t):
    return g.match("p", "Part", id=7).into("p", "contains", "o").into("o", "places", "c", ("c_name",)).rows.select(F.col("c_c_name").alias("answer")).distinct()


@query("SELECT l_partkey AS part, l_quantity AS quantity FROM lineitem WHERE l_orderkey = 5")
def edge_property(g, t):
    return g.match("o", "Order", id=5).out("o", "contains", "p", edge=("quantity",)).rows.select(F.col("p_id").alias("part"), F.col("contains_quantity").alias("quantity"))


@query("SELECT count(*) AS answer FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_mktsegment = 'BUILDING'")
def two_anchors(g, t):
    return g.match("c", "Customer", c_mktsegment="BUILDING").out("c", "places", "o", o_orderstatus="O").rows.agg(F.count("*").alias("answer"))


@query("SELECT l.l_orderkey AS o, count(*) AS n FROM lineitem l JOIN lineitem s ON l.l_orderkey = s.l_orderkey JOIN part ON l.l_partkey = p_partkey JOIN supplier ON s.l_suppkey = s_suppkey WHERE p_size = 10 AND s_nationkey = 4 GROUP BY 1")
def branch_pattern(g, t):
    parts = g.match("p", "Part", p_size=10).into("p", "contains", "o")
    suppliers = g.match("s", "Supplier", s_nationkey=4).into("s", "supplied_by", "o")
    return parts.join(suppliers).rows.groupBy(F.col("o_id").alias("o")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS answer FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_pattern(g, t):
    urgent = g.match("o", "Order", o_orderpriority="1-URGENT").into("o", "places", "c")
    return g.match("c", "Customer").without(urgent, "c").rows.agg(F.count("*").alias("answer"))


@query("SELECT count(*) AS answer FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand = (SELECT min(p_brand) FROM part))")
def exists_pattern(g, t):
    brand = t.part.agg(F.min("p_brand").alias("p_p_brand"))
    parts = Match(g, g.match("p", "Part", ("p_brand",)).rows.join(brand, "p_p_brand", "left_semi"))
    return g.match("o", "Order").having(parts.into("p", "contains", "o"), "o").rows.agg(F.count("*").alias("answer"))


@query("SELECT count(*) AS answer FROM (SELECT DISTINCT l_partkey, l_orderkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey)")
def unanchored_match(g, t):
    """Every customer, order and part that hang together: no anchor, whole tables."""
    placed = g.match("c", "Customer").out("c", "places", "o").dealt("o", g.edges["contains"].rows.count())
    return placed.out("o", "contains", "p").frontier("c", "o", "p").rows.agg(F.count("*").alias("answer"))


@query("SELECT a.l_partkey AS part, count(*) AS pairs, count(DISTINCT b.l_partkey) AS others, round(sum(a.l_quantity - b.l_quantity), 2) AS difference FROM (SELECT *, row_number() OVER () AS k FROM lineitem) a JOIN (SELECT *, row_number() OVER () AS k FROM lineitem) b ON a.l_orderkey = b.l_orderkey WHERE (a.l_linenumber, a.l_partkey, a.l_suppkey, a.l_quantity, a.l_extendedprice) <> (b.l_linenumber, b.l_partkey, b.l_suppkey, b.l_quantity, b.l_extendedprice) GROUP BY 1")
def bought_together(g, t):
    """(a)<-[r:contains]-(o)-[s:contains]->(b): two variables of one relationship, which never bind the same edge."""
    m = g.match("a", "Part", unique_edges=True).into("a", "contains", "o", edge=("quantity",), rel="r").out("o", "contains", "b", edge=("quantity",), rel="s")
    return m.rows.groupBy(F.col("a_id").alias("part")).agg(F.count("*").alias("pairs"), F.count_distinct("b_id").alias("others"), F.round(F.sum(F.col("r_quantity") - F.col("s_quantity")), 2).alias("difference"))


@query("WITH b AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p, o_orderstatus AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey) SELECT c AS customer, count(*) AS parts FROM (SELECT c, p FROM b WHERE s = 'O' INTERSECT SELECT c, p FROM b WHERE s = 'F' EXCEPT SELECT c, p FROM b WHERE s = 'P') GROUP BY 1")
def correlated_paths(g, t):
    """Parts that a customer has in an open order and in a finished one, but in none that is pending: both variables at once."""
    bought = lambda status: g.match("c", "Customer").out("c", "places", "o", o_orderstatus=status).out("o", "contains", "p").frontier("c", "p")
    found = bought("O").having(bought("F"), "c", "p").without(bought("P"), "c", "p")
    return found.rows.groupBy(F.col("c_id").alias("customer")).agg(F.count("*").alias("parts"))


@query("SELECT 'lives_in runs from Customer to Nation: turn it round' AS problem, count(*) AS edges FROM customer UNION ALL SELECT 'contains has no property colour', count(*) FROM lineitem UNION ALL SELECT 'Part.p_size is int, no text', (SELECT count(*) FROM part) UNION ALL SELECT 'Part has no property p_colour', (SELECT count(*) FROM part)")
def pattern_problems(g, t):
    """What is wrong with four patterns, and how many instances the edge or label has that each was meant for."""
    found = [(p, "edge", "lives_in") for p in g.problems("lives_in", "Nation", "Customer")] + [(p, "edge", "contains") for p in g.problems("contains", props=("quantity", "colour"))]
    found += [(p, "node", "Part") for p in g.node_problems("Part", ("p_name", "p_colour"), ("p_name", "p_size"))]
    part = PropertyGraph({"Part": g.nodes["Part"]}, {n: g.edges[n] for n in ("lives_in", "contains")})
    return t.spark.createDataFrame(found, "problem string, kind string, name string").join(part.counted(), ["kind", "name"]).select("problem", F.col("n").alias("edges"))


@query("SELECT r_name AS anchor, count(DISTINCT o_orderkey) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def anchor_fields(g, t):
    """Anchors by a property at the end of the path."""
    return g.anchors("Order", [("places", False), ("lives_in", True), ("in_region", True)], "r_name").groupBy("anchor").agg(F.count("*").alias("orders"))


# aggregates

@query("SELECT n_name AS nation, count(*) AS orders, count(DISTINCT c_custkey) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY n_nationkey, n_name")
def count_bag_and_distinct(g, t):
    m = g.match("n", "Nation", ("n_name",)).into("n", "lives_in", "c").out("c", "places", "o")
    return m.rows.groupBy("n_id", "n_n_name").agg(F.count("o_id").alias("orders"), F.count_distinct("c_id").alias("customers")).select(F.col("n_n_name").alias("nation"), "orders", "customers")


@query("SELECT l_orderkey AS o, round(sum(l_quantity * p_retailprice), 2) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def sum_expr(g, t):
    m = g.match("o", "Order").out("o", "contains", "p", ("p_retailprice",), ("quantity",))
    return m.rows.groupBy(F.col("o_id").alias("o")).agg(F.round(F.sum(F.col("contains_quantity") * F.col("p_p_retailprice")), 2).alias("total"))


@query("SELECT p_brand AS brand, round(avg(l_discount), 6) AS discount FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1")
def avg_edge(g, t):
    m = g.match("p", "Part", ("p_brand",)).into("p", "contains", "o", edge=("discount",))
    return m.rows.groupBy(F.col("p_p_brand").alias("brand")).agg(F.round(F.avg("contains_discount"), 6).alias("discount"))


@query("SELECT l_orderkey AS o, CAST(CAST(max(l_shipdate) AS DATE) AS VARCHAR) AS latest, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS earliest FROM lineitem GROUP BY 1")
def min_max_date(g, t):
    m = g.match("o", "Order").out("o", "contains", "p", edge=("shipdate",))
    day = F.to_date("contains_shipdate")
    return m.rows.groupBy(F.col("o_id").alias("o")).agg(F.max(day).cast("string").alias("latest"), F.min(day).cast("string").alias("earliest"))


@query("SELECT coalesce(sum(o_totalprice), 0) AS zero_sum, sum(o_totalprice) AS null_sum FROM orders WHERE o_orderkey < 0")
def sum_empty_dialects(g, t):
    none = g.match("o", "Order", ("o_totalprice",)).where("o_id < 0").rows
    return none.agg(F.coalesce(F.sum("o_o_totalprice"), F.lit(0.0)).alias("zero_sum"), F.sum("o_o_totalprice").alias("null_sum"))


@query("SELECT round(sum(o_totalprice), 2) AS answer FROM (SELECT DISTINCT o_orderkey, o_totalprice FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size < 5)")
def with_distinct_then_sum(g, t):
    m = g.match("p", "Part", ("p_size",)).where("p_p_size < 5").into("p", "contains", "o").frontier("o")
    return m.rows.join(g.node("o", "Order", ("o_totalprice",), {}), "o_id").agg(F.round(F.sum("o_o_totalprice"), 2).alias("answer"))


@query("SELECT n_name AS nation, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name HAVING count(*) > 50")
def having_after_with(g, t):
    m = g.match("n", "Nation", ("n_name",)).into("n", "lives_in", "c")
    return m.rows.groupBy("n_id", "n_n_name").agg(F.count("*").alias("customers")).where("customers > 50").select(F.col("n_n_name").alias("nation"), "customers")


@query("SELECT count(*) > 0 AS answer FROM orders WHERE o_orderstatus = 'P'")
def yes_no(g, t):
    return g.match("o", "Order", o_orderstatus="P").rows.agg((F.count("*") > 0).alias("answer"))


@query("SELECT s_nationkey AS nation, avg(n)::DOUBLE AS mean_lines, max(n) AS most_lines FROM (SELECT s_suppkey, s_nationkey, count(*) AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2) GROUP BY 1")
def two_level_aggregation(g, t):
    inner = g.match("s", "Supplier", ("s_nationkey",)).into("s", "supplied_by", "o").rows.groupBy("s_id", "s_s_nationkey").agg(F.count("*").alias("n"))
    return inner.groupBy(F.col("s_s_nationkey").alias("nation")).agg(F.avg("n").alias("mean_lines"), F.max("n").alias("most_lines"))


# the greatest, ties included

@query("WITH c AS (SELECT c_custkey, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT c_custkey AS answer, n AS score FROM c WHERE n = (SELECT max(n) FROM c)")
def superlative_count(g, t):
    scored = g.match("c", "Customer").out("c", "places", "o").rows.groupBy(F.col("c_id").alias("answer")).agg(F.count("*").alias("score"))
    return winners(scored, "score")


@query("WITH s AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT l_orderkey AS answer, q AS score FROM s WHERE q = (SELECT max(q) FROM s)")
def superlative_sum(g, t):
    scored = g.match("o", "Order").out("o", "contains", "p", edge=("quantity",)).rows.groupBy(F.col("o_id").alias("answer")).agg(F.sum("contains_quantity").alias("score"))
    return winners(scored, "score")


@query("WITH s AS (SELECT n_name, round(avg(c_acctbal), 6) AS a FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name) SELECT n_name AS answer, a AS score FROM s WHERE a = (SELECT max(a) FROM s)")
def superlative_avg(g, t):
    m = g.match("n", "Nation", ("n_name",)).into("n", "lives_in", "c", ("c_acctbal",))
    scored = m.rows.groupBy("n_id", F.col("n_n_name").alias("answer")).agg(F.round(F.avg("c_c_acctbal"), 6).alias("score")).drop("n_id")
    return winners(scored, "score")


@query("WITH s AS (SELECT n_regionkey, n_name, count(DISTINCT o_orderkey) AS k FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY 1, n_nationkey, n_name) SELECT n_regionkey AS region, n_name AS answer, k AS score FROM s WHERE (n_regionkey, k) IN (SELECT n_regionkey, max(k) FROM s GROUP BY 1)")
def superlative_scoped_distinct(g, t):
    m = g.match("n", "Nation", ("n_name", "n_regionkey")).into("n", "lives_in", "c").out("c", "places", "o")
    scored = m.rows.groupBy(F.col("n_n_regionkey").alias("region"), "n_id", F.col("n_n_name").alias("answer")).agg(F.count_distinct("o_id").alias("score")).drop("n_id")
    return winners(scored, "score", ("region",)).select("region", "answer", "score")


@query("WITH s AS (SELECT s_suppkey, max(CAST(l_shipdate AS DATE)) AS d FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1) SELECT s_suppkey AS answer, CAST(d AS VARCHAR) AS score FROM s WHERE d = (SELECT max(d) FROM s)")
def superlative_latest(g, t):
    scored = t.lineitem.groupBy(F.col("l_suppkey").alias("answer")).agg(F.max(F.to_date("l_shipdate")).alias("score"))
    return winners(scored, "score").withColumn("score", F.col("score").cast("string"))


@query("WITH s AS (SELECT p_brand, sum(l_quantity * l_extendedprice) / CAST(count(*) AS DOUBLE) AS r FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY 1), x AS (SELECT p_brand, round(r, 4) AS r FROM s) SELECT p_brand AS answer, r AS score FROM x WHERE r = (SELECT max(r) FROM x)")
def superlative_ratio(g, t):
    m = g.match("p", "Part", ("p_brand",)).into("p", "contains", "o", edge=("quantity", "extendedprice"))
    ratio = F.sum(F.col("contains_quantity") * F.col("contains_extendedprice")) / F.count("*").cast("double")
    return winners(m.rows.groupBy(F.col("p_p_brand").alias("answer")).agg(F.round(ratio, 4).alias("score")), "score")


@query("SELECT c_name AS answer, c_acctbal AS score FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer WHERE c_nationkey = 6) AND c_nationkey = 6")
def superlative_property(g, t):
    return winners(g.match("c", "Customer", ("c_name", "c_acctbal"), c_nationkey=6).rows.select(F.col("c_c_name").alias("answer"), F.col("c_c_acctbal").alias("score")), "score")


@query("SELECT n_name AS answer, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name ORDER BY n DESC, n_name LIMIT 5")
def topk_order_limit(g, t):
    m = g.match("n", "Nation", ("n_name",)).into("n", "lives_in", "c")
    return m.rows.groupBy("n_id", F.col("n_n_name").alias("answer")).agg(F.count("*").alias("n")).drop("n_id").orderBy(F.desc("n"), "answer").limit(5)


@query("SELECT o_orderkey AS answer, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5")
def skip_limit(g, t):
    return g.match("o", "Order", ("o_totalprice",)).rows.select(F.col("o_id").alias("answer"), F.col("o_o_totalprice").alias("price")).orderBy(F.desc("price"), "answer").offset(5).limit(10)


@query("SELECT c_nationkey AS nation, c_name AS customer, c_acctbal AS balance FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3")
def top_of_each(g, t):
    rows = g.match("c", "Customer", ("c_nationkey", "c_name", "c_acctbal")).rows
    return numbered(rows, ("c_c_nationkey",), (F.desc("c_c_acctbal"), F.col("c_id")), 3).select(F.col("c_c_nationkey").alias("nation"), F.col("c_c_name").alias("customer"), F.col("c_c_acctbal").alias("balance"))


@query("SELECT o_orderpriority AS priority, c_nationkey AS nation, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2")
def unwind_collect(g, t):
    m = g.match("c", "Customer", ("c_nationkey",)).out("c", "places", "o", ("o_orderpriority",))
    counted = m.rows.groupBy("o_o_orderpriority", "c_c_nationkey").agg(F.count("*").alias("n"))
    lists = counted.groupBy(F.col("o_o_orderpriority").alias("priority")).agg(F.collect_list(F.struct(F.col("c_c_nationkey").alias("nation"), "n")).alias("rows"))  # a row a nation
    return lists.select("priority", F.explode("rows").alias("row")).select("priority", "row.nation", "row.n")


# predicates and scalar functions

@query("SELECT p_partkey AS answer FROM part WHERE p_name LIKE 'red %'")
def starts_with(g, t):
    return g.match("p", "Part", ("p_name",)).where(F.col("p_p_name").startswith("red ")).rows.select(F.col("p_id").alias("answer"))


@query("SELECT p_partkey AS answer FROM part WHERE contains(p_name, 'e') AND p_name LIKE '%g'")
def contains_and_ends(g, t):
    return g.match("p", "Part", ("p_name",)).where(F.col("p_p_name").contains("e") & F.col("p_p_name").endswith("g")).rows.select(F.col("p_id").alias("answer"))


@query("SELECT p_partkey AS answer FROM part WHERE regexp_full_match(p_brand, 'Brand#[1-2].*')")
def regex_full(g, t):
    return g.match("p", "Part", ("p_brand",)).where(F.col("p_p_brand").rlike("^(?:Brand#[1-2].*)$")).rows.select(F.col("p_id").alias("answer"))


@query("SELECT p_partkey AS answer FROM part WHERE p_size IN (1, 5, 9) AND NOT (p_size = 5 OR p_retailprice < 0)")
def in_list_and_not(g, t):
    return g.match("p", "Part", ("p_size", "p_retailprice")).where(F.col("p_p_size").isin(1, 5, 9) & ~((F.col("p_p_size") == 5) | (F.col("p_p_retailprice") < 0))).rows.select(F.col("p_id").alias("answer"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1")
def not_equal(g, t):
    return g.match("o", "Order", ("o_orderstatus",)).where("o_o_orderstatus <> 'F'").rows.groupBy(F.col("o_o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS answer FROM orders WHERE CAST(o_orderdate AS DATE) >= DATE '1995-01-01' AND CAST(o_orderdate AS DATE) <= DATE '1996-12-31'")
def date_range(g, t):
    day = F.to_date("o_o_orderdate")
    return g.match("o", "Order", ("o_orderdate",)).where((day >= F.lit("1995-01-01").cast("date")) & (day <= F.lit("1996-12-31").cast("date"))).rows.agg(F.count("*").alias("answer"))


@query("SELECT n_nationkey AS nation, round(count(DISTINCT s_suppkey) / CAST(count(DISTINCT c_custkey) AS DOUBLE), 6) AS ratio FROM nation JOIN supplier ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def ratio(g, t):
    s = g.match("n", "Nation").into("n", "based_in", "s").rows.groupBy("n_id").agg(F.count_distinct("s_id").alias("s"))
    c = g.match("n", "Nation").into("n", "lives_in", "c").rows.groupBy("n_id").agg(F.count_distinct("c_id").alias("c"))
    return s.join(c, "n_id").select(F.col("n_id").alias("nation"), F.round(F.col("s") / F.col("c").cast("double"), 6).alias("ratio"))


@query("SELECT event_type AS kind, count(json_extract_string(props, '$.page')) AS with_page, count(*) AS n FROM events GROUP BY 1")
def events_json_prop(g, t):
    page = F.get_json_object("e_props", "$.page")
    return g.match("e", "Event", ("event_type", "props")).rows.groupBy(F.col("e_event_type").alias("kind")).agg(F.count(page).alias("with_page"), F.count("*").alias("n"))


# key repair, entities and edges

@query("WITH g AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) > 1 AS a, count(DISTINCT l_suppkey) > 1 AS b, count(DISTINCT l_shipdate) > 1 AS c FROM lineitem GROUP BY 1, 2) SELECT 'l_partkey' AS \"column\", bool_or(a) AS conflicting FROM g UNION ALL SELECT 'l_suppkey', bool_or(b) FROM g UNION ALL SELECT 'l_shipdate', bool_or(c) FROM g")
def pk_conflicts(g, t):
    return keys.conflicts(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_shipdate"])


@query("SELECT count(*) AS rows_in, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS keys_before, (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)) AS keys_after, 4::BIGINT AS key_columns FROM lineitem")
def pk_expand_profile(g, t):
    key = keys.repaired_key(t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey"])
    before, after = (t.lineitem.select(*k).distinct().agg(F.count("*").alias(n)) for k, n in ((["l_orderkey", "l_linenumber"], "keys_before"), (key, "keys_after")))
    return t.lineitem.agg(F.count("*").alias("rows_in")).crossJoin(before).crossJoin(after).withColumn("key_columns", F.lit(len(key)).cast("long"))


@query("SELECT concat_ws('|', c_custkey, trim(c_name)) AS id, c_nationkey AS nation FROM customer WHERE c_custkey IS NOT NULL AND trim(coalesce(c_name, '')) <> ''")
def identifier_render(g, t):
    return t.customer.select(identifier([F.col("c_custkey"), F.col("c_name")]).alias("id"), F.col("c_nationkey").alias("nation")).where("id IS NOT NULL")


@query("SELECT 'customer' AS source, count(*) AS fragments FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(user_id) FROM events")
def fragment_counts(g, t):
    parts = [("customer", t.customer, "c_custkey"), ("orders", t.orders, "o_custkey"), ("events", t.events, "user_id")]
    counted = [entities.fragments(df, entities.Cluster(n, "c", [k]), F.lit(0)).groupBy().agg(F.count("*").alias("fragments")).select(F.lit(n).alias("source"), "fragments") for n, df, k in parts]
    return counted[0].union(counted[1]).union(counted[2])


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 1 + coalesce(o.n, 0) + coalesce(e.n, 0) AS fragments, c_name AS name, o.p AS priority, e.k AS kind FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, min_by(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1) o ON o_custkey = c_custkey LEFT JOIN (SELECT user_id, count(*) AS n, min_by(event_type, event_id) AS k FROM events GROUP BY 1) e ON user_id = c_custkey")
def entity_resolution(g, t):
    parts = [
        entities.fragments(t.customer, entities.Cluster("customer", "c", ["c_custkey"], {"name": ["c_name"]}), F.col("c_custkey"), (0, 0)),
        entities.fragments(t.orders, entities.Cluster("orders", "c", ["o_custkey"], {"priority": ["o_orderpriority"]}), F.col("o_orderkey"), (1, 0)),
        entities.fragments(t.events, entities.Cluster("events", "c", ["user_id"], {"kind": ["event_type"]}), F.col("event_id"), (2, 0)),
    ]
    return entities.resolved(parts)


@query("SELECT CAST(o_custkey AS VARCHAR) AS id, count(*) AS fragments, min_by(o_orderstatus, o_orderkey) AS status, min_by(strftime(o_orderdate, '%Y-%m-%d'), o_orderkey) FILTER (o_orderstatus = 'F') AS day, CAST(min_by(o_orderkey, o_orderkey) AS VARCHAR) AS first_order FROM orders GROUP BY 1")
def built_first_values(g, t):
    """A graph built from one table whose properties differ between the rows of an entity: the first row's value counts."""
    wide = t.orders.select("o_custkey", "o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.col("o_orderkey").alias("first_order"))
    declared = schema.Schema([schema.Proposal("wide", "c", "Customer", ("o_custkey",), ("status", "day", "first_order"))])
    return schema.built({"wide": wide}, {"wide": "o_orderkey"}, declared, repair=False).nodes["Customer"].select("id", "fragments", "status", "day", "first_order")


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 'customer' AS \"table\", CAST(c_custkey AS VARCHAR) AS \"row\", 'c' AS cluster, 'c_custkey' AS key FROM customer UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'orders', CAST(o_orderkey AS VARCHAR), 'buyer', 'o_custkey' FROM orders UNION ALL SELECT CAST(user_id AS VARCHAR), 'events', strftime(ts, '%Y-%m-%d'), 'user', 'user_id' FROM events WHERE user_id IS NOT NULL")
def entity_lineage(g, t):
    """Every fragment of every entity: from which table, row and cluster it comes, and by which key."""
    parts = [(entities.Cluster("customer", "c", ["c_custkey"]), t.customer, F.col("c_custkey")), (entities.Cluster("orders", "buyer", ["o_custkey"]), t.orders, F.col("o_orderkey")), (entities.Cluster("events", "user", ["user_id"]), t.events, F.to_date("ts"))]
    return entities.lineage([(c, entities.fragments(rows, c, order, (k, 0))) for k, (c, rows, order) in enumerate(parts)])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def fk_rekey(g, t):
    wide = t.customer.join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    found = entities.fragments(wide, entities.Cluster("wide", "nation", ["n_name"]), F.col("c_custkey"))
    return entities.rekeyed(found, t.nation, "n_name", "n_nationkey", "n_nationkey").groupBy("id").agg(F.count("*").alias("n"))


@query("SELECT CAST(k AS VARCHAR) AS id, count(*) AS n FROM supplier JOIN (SELECT c_nationkey, max(c_custkey) AS k FROM customer GROUP BY 1) ON s_nationkey = c_nationkey GROUP BY 1")
def fk_rekey_last_row(g, t):
    """Many rows of the reference table share a secondary key: the last row's primary key counts, by number and not by text."""
    found = entities.fragments(t.supplier, entities.Cluster("supplier", "nation", ["s_nationkey"]), F.col("s_suppkey"))
    return entities.rekeyed(found, t.customer, "c_nationkey", "c_custkey", "c_custkey").groupBy("id").agg(F.count("*").alias("n"))


@query("WITH n AS (SELECT c_custkey, n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT CAST(n_nationkey AS VARCHAR) AS nation, count(*) AS customers, 1 + count(*) AS fragments FROM n GROUP BY 1")
def built_with_secondary_keys(g, t):
    """Customers name their nation by its name, a secondary key: entities and edges get the nation's primary key."""
    rows = t.customer.join(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation_name")), "c_nationkey").select("c_custkey", "nation_name")
    declared = schema.Schema(
        [schema.Proposal("nation", "n", "Nation", ("n_nationkey",), ("n_regionkey",)), schema.Proposal("nation", "m", "Name", ("n_name",)), schema.Proposal("customer", "c", "Customer", ("c_custkey",)), schema.Proposal("customer", "n", "Nation", ("nation_name",))],
        [schema.Relation("customer", "c", "n", "lives_in")],
        references=[("customer", "nation_name", "nation", "n_name")],
    )
    own = schema.built({"nation": t.nation, "customer": rows}, {"nation": "n_nationkey", "customer": "c_custkey"}, declared, repair=False)
    m = own.match("n", "Nation", ("fragments",)).into("n", "lives_in", "c")
    return m.rows.groupBy(F.col("n_id").alias("nation"), F.col("n_fragments").alias("fragments")).agg(F.count("*").alias("customers"))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS src, CAST(l_partkey AS VARCHAR) AS dst, l_quantity AS quantity FROM lineitem")
def same_table_edges(g, t):
    return edges.same_table_edges(t.lineitem, ["l_orderkey"], ["l_partkey"], {"quantity": "l_quantity"})


@query("SELECT CAST(c_custkey AS VARCHAR) AS src, CAST(s AS VARCHAR) AS dst FROM customer JOIN (SELECT s_nationkey, s_suppkey AS s FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey DESC) = 1) ON c_nationkey = s_nationkey")
def cross_table_edges(g, t):
    targets = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("value"), "s_acctbal")
    found = edges.cross_table_edges(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("value")), targets, "s_acctbal")
    return found.select(F.col("src").cast("string"), F.col("dst").cast("string"))


@query("WITH e AS (SELECT CAST(o_custkey AS VARCHAR) AS src, o_orderpriority AS dst, 'orders' AS t, o_orderkey AS r, o_orderstatus AS status, 0 AS part FROM orders UNION ALL SELECT CAST(user_id AS VARCHAR), event_type, 'events', event_id, NULL, 1 FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL) SELECT concat_ws('|', src, 'shows', dst, t, r) AS edge_id, src, dst, status, t AS \"table\", r AS \"row\", n AS copies FROM (SELECT *, count(*) OVER (PARTITION BY src, dst, status) AS n, row_number() OVER (PARTITION BY src, dst, status ORDER BY r, part) AS k FROM e) WHERE k = 1")
def unique_edges(g, t):
    """Edges of two tables with an identity of their own: parallel ones survive where their properties differ."""
    parts = [edges.traced_edges(t.orders, "orders", "o_orderkey", ["o_custkey"], ["o_orderpriority"], {"status": "o_orderstatus"}), edges.traced_edges(t.events, "events", "event_id", ["user_id"], ["event_type"])]
    return edges.unique_edges(parts, "shows")


@query("SELECT count(*) AS edges FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)")
def edge_dedupe(g, t):
    return edges.deduplicated(g.edges["supplied_by"].rows.drop("edge_id")).agg(F.count("*").alias("edges"))


@query("SELECT count(*) AS edges FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25) AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')")
def edge_endpoints(g, t):
    orders, parts = g.nodes["Order"].where("o_orderstatus = 'O'"), g.nodes["Part"].where("p_size > 25")
    return edges.anchored(g.edges["contains"].rows, orders, parts).agg(F.count("*").alias("edges"))


@query("SELECT 'in_region' AS predicate, count(*) AS edges FROM nation UNION ALL SELECT 'lives_in', count(*) FROM customer UNION ALL SELECT 'contains', count(*) FROM lineitem")
def materialized_schema(g, t):
    return edges.materialised({n: g.edges[n].rows for n in ("in_region", "lives_in", "contains")} | {"never": g.edges["places"].rows.where("src < 0")})


@query("WITH v AS (SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS n, CAST(c_acctbal AS VARCHAR) AS b, strftime(DATE '2020-01-01' + c_nationkey, '%Y-%m-%d') AS d FROM customer), long AS (SELECT 'c_custkey' AS c, k AS v FROM v UNION ALL SELECT 'c_name', n FROM v UNION ALL SELECT 'c_acctbal', b FROM v UNION ALL SELECT 'day', d FROM v) SELECT c AS \"column\", CASE WHEN bool_and(coalesce(TRY_CAST(v AS DOUBLE) = floor(TRY_CAST(v AS DOUBLE)), false)) THEN 'INT64' WHEN bool_and(TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'DOUBLE' WHEN bool_and(TRY_CAST(v AS DATE) IS NOT NULL) THEN 'DATE' ELSE 'STRING' END AS type FROM long GROUP BY 1")
def type_inference(g, t):
    text = t.customer.select(F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("c_nationkey").cast("int")).cast("string").alias("day"))
    return profile.inferred_types(text, text.columns)


@query("SELECT 'o_orderstatus' AS \"column\", count(*) AS n, count(*) - count(o_orderstatus) AS nulls, count(DISTINCT o_orderstatus) AS different, min(o_orderstatus) AS least, max(o_orderstatus) AS greatest FROM orders UNION ALL SELECT 'o_custkey', count(*), count(*) - count(o_custkey), count(DISTINCT o_custkey), CAST(min(o_custkey) AS VARCHAR), CAST(max(o_custkey) AS VARCHAR) FROM orders")
def column_profile(g, t):
    return profile.column_profile(t.orders, ["o_orderstatus", "o_custkey"])


@query("SELECT count(DISTINCT user_id) AS child_values, count(DISTINCT user_id) FILTER (WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')) AS missing FROM events")
def inclusion_dependency(g, t):
    return profile.missing_parents(t.events, "user_id", t.orders.where("o_orderstatus = 'P'"), "o_custkey")


@query("SELECT event_type AS value, min(event_id) AS at FROM events WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY 2, 1 LIMIT 3")
def sample_values(g, t):
    return profile.sample_values(t.events, "event_type", "event_id")


@query("WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split_regex(lower(p_brand), '[^a-z0-9]+'), lambda x: x <> '')) AS b FROM part) SELECT p_partkey AS part, CASE WHEN len(list_distinct(list_concat(a, b))) = 0 THEN 0.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) END AS score FROM t")
def name_jaccard(g, t):
    tokens = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != ""))
    return t.part.select(F.col("p_partkey").alias("part"), jaccard(tokens("p_name"), tokens("p_brand")).alias("score"))


@query("SELECT DISTINCT lower(regexp_replace(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name FROM orders")
def snake_names(g, t):
    return t.orders.select(snake_case(F.col("o_orderpriority")).alias("name")).distinct()


@query("SELECT n_name AS nation, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name")
def wide_table_graph(g, t):
    """A graph induced from one wide table without keys, then asked over two hops."""
    wide = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    clusters = [schema.Proposal("wide", "o", "Order", ("o_orderkey",), ("o_orderstatus",)), schema.Proposal("wide", "c", "Customer", ("c_custkey",), ("c_name",)), schema.Proposal("wide", "n", "Nation", ("n_nationkey",), ("n_name",))]
    relations = [schema.Relation("wide", "c", "o", "places"), schema.Relation("wide", "c", "n", "lives_in"), schema.Relation("wide", "o", "o", "itself")]
    declared = schema.checked(schema.Schema(clusters, relations), {})
    own = schema.built({"wide": wide}, {"wide": "o_orderkey"}, declared, repair=False)
    m = own.match("n", "Nation", ("n_name",)).into("n", "lives_in", "c").out("c", "places", "o")
    return m.rows.groupBy("n_id", F.col("n_n_name").alias("nation")).agg(F.count("*").alias("orders"), F.count_distinct("c_id").alias("customers")).drop("n_id")


def regional_pairs(t, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sources (id, nation) at their region, and the nations of each region."""
    at = sources.join(t.nation, F.col("nation") == F.col("n_nationkey")).select("id", F.col("n_regionkey").alias("anchor"))
    return at, t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("anchor"))


@query("SELECT s_suppkey AS supplier, n_regionkey AS anchor, true AS sound, true AS clean FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def sampled_edges_hold(g, t):
    """Seeded edges between suppliers and nations of their region: one to three a supplier, checked edge by edge."""
    sources, targets = regional_pairs(t, t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation")))
    found = benchmarks.sampled_edges(benchmarks.allowed_pairs(sources, targets), 1, 3, 0, 1_000_000, 11)
    ends = found.join(targets.toDF("dst", "there"), "dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.count_distinct("dst").alias("different"), F.min("there").alias("low"), F.max("there").alias("high"))
    return sources.join(ends, "id", "left").select(F.col("id").alias("supplier"), "anchor", (F.col("n").between(1, 3) & (F.col("n") == F.col("different"))).alias("sound"), ((F.col("low") == F.col("anchor")) & (F.col("high") == F.col("anchor"))).alias("clean"))


@query("SELECT 'src' AS \"end\", c_custkey AS id, true AS sound FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT 'dst', n_nationkey, true FROM nation WHERE n_regionkey IN (SELECT n_regionkey FROM nation JOIN customer ON c_nationkey = n_nationkey)")
def sampled_edges_bind(g, t):
    """As above with customers, and bounds so near to the nations' share of a region that some of them bind, at both ends."""
    sources, targets = regional_pairs(t, t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation")))
    share = sources.groupBy("anchor").agg(F.count("*").alias("s")).join(targets.groupBy("anchor").agg(F.count("*").alias("t")), "anchor")
    bounds = share.agg(F.min(F.floor(F.col("s") / F.col("t"))).alias("least"), F.max(F.ceil(F.col("s") / F.col("t"))).alias("most")).first()
    found = benchmarks.sampled_edges(benchmarks.allowed_pairs(sources, targets), 1, 3, bounds.least, bounds.most, 11)
    good = found.subtract(benchmarks.violations(found, sources, targets).select("src", "dst"))
    degree = lambda nodes, end: nodes.select(F.col("id").cast("long").alias("id")).join(good.groupBy(F.col(end).cast("long").alias("id")).agg(F.count("*").alias("n")), "id", "left")
    out = degree(sources, "src").select(F.lit("src").alias("end"), "id", F.coalesce(F.col("n").between(1, 3), F.lit(False)).alias("sound"))
    reached = targets.join(sources.select("anchor").distinct(), "anchor", "left_semi")
    return out.union(degree(reached, "dst").select(F.lit("dst"), "id", F.coalesce(F.col("n").between(bounds.least, bounds.most), F.lit(False))))


@query("SELECT 'node' AS kind, 'Region' AS name, count(*) AS n FROM region UNION ALL SELECT 'node', 'Nation', count(*) FROM nation UNION ALL SELECT 'node', 'Customer', count(*) FROM customer UNION ALL SELECT 'node', 'Supplier', count(*) FROM supplier UNION ALL SELECT 'node', 'Part', count(*) FROM part UNION ALL SELECT 'node', 'Order', count(*) FROM orders UNION ALL SELECT 'node', 'Event', count(*) FROM events UNION ALL SELECT 'edge', 'in_region', count(*) FROM nation UNION ALL SELECT 'edge', 'lives_in', count(*) FROM customer UNION ALL SELECT 'edge', 'based_in', count(*) FROM supplier UNION ALL SELECT 'edge', 'places', count(*) FROM orders UNION ALL SELECT 'edge', 'contains', count(*) FROM lineitem UNION ALL SELECT 'edge', 'supplied_by', count(*) FROM lineitem UNION ALL SELECT 'edge', 'performs', count(*) FROM events")
def graph_stats(g, t):
    return g.counted()


@query("SELECT CAST(c_custkey AS VARCHAR) AS id, 0 AS source, count(*) AS fragments FROM customer GROUP BY 1 UNION ALL SELECT CAST(o_custkey AS VARCHAR), 1, count(*) FROM orders GROUP BY 1 UNION ALL SELECT CAST(user_id AS VARCHAR), 2, count(*) FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def entity_provenance(g, t):
    parts = [(t.customer, "c_custkey"), (t.orders, "o_custkey"), (t.events, "user_id")]
    return entities.provenance([entities.fragments(df, entities.Cluster("any", "c", [key]), F.lit(0), (rank, 0)) for rank, (df, key) in enumerate(parts)])


@query("SELECT event_type AS kind, CAST(user_id AS VARCHAR) AS value, place FROM (SELECT event_type, user_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(concat('7:', user_id)), CAST(user_id AS VARCHAR)) AS place FROM (SELECT DISTINCT event_type, user_id FROM events WHERE user_id IS NOT NULL)) WHERE place <= 3")
def seeded_sample(g, t):
    return profile.seeded_sample(t.events, "event_type", "user_id", seed=7).withColumnRenamed("group", "kind")


@query("SELECT r_regionkey AS anchor, count(DISTINCT o_orderkey) AS orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def anchor_paths(g, t):
    return g.anchors("Order", [("places", False), ("lives_in", True), ("in_region", True)]).groupBy("anchor").agg(F.count("*").alias("orders"))


@query("SELECT 'either' AS kind, count(*) AS nations FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'both', count(*) FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers alone', count(*) FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier)")
def set_operations(g, t):
    one, two = t.customer.select("c_nationkey"), t.supplier.select("s_nationkey")
    found = {"either": one.union(two).distinct(), "both": one.intersect(two), "customers alone": one.subtract(two)}
    counted = [df.agg(F.count("*").alias("nations")).select(F.lit(kind).alias("kind"), "nations") for kind, df in found.items()]
    return counted[0].union(counted[1]).union(counted[2])


# denormalised tables and benchmark data

@query("SELECT c_name AS customer, o_orderkey AS o, o_totalprice AS price FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey, min_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def denorm_first_edge(g, t):
    first = benchmarks.first_edges(t.orders.select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("o"), F.col("o_totalprice").alias("price")), "o")
    return benchmarks.denormalised(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("customer")), "id", first).select("customer", "o", "price")


@query("SELECT n_regionkey AS item, count(*) AS n_questions, string_agg(concat(n_name, '=', k), '; ' ORDER BY n_name) AS pairs FROM nation JOIN (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1) ON c_nationkey = n_nationkey GROUP BY 1")
def qa_items(g, t):
    m = g.match("n", "Nation", ("n_name", "n_regionkey")).into("n", "lives_in", "c")
    asked = m.rows.groupBy(F.col("n_n_regionkey").alias("item"), F.col("n_n_name").alias("question")).agg(F.count("*").cast("string").alias("answer"))
    pairs = F.array_join(F.transform("qa_pairs", lambda p: F.concat(p["question"], F.lit("="), p["answer"])), "; ")
    return benchmarks.assembled(asked, "item").select("item", "n_questions", pairs.alias("pairs"))


@query("SELECT c_name AS customer, o_orderkey AS o, o_totalprice AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def denorm_expand(g, t):
    open_orders = t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("src"), F.col("o_orderkey").alias("o"), F.col("o_totalprice").alias("price"))
    return benchmarks.denormalised(t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("customer")), "id", open_orders).select("customer", "o", "price")


@query("SELECT l_quantity AS quantity, o_orderstatus AS status, p_brand AS brand FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey")
def denorm_relation(g, t):
    rows = benchmarks.relation_rows(g.edges["contains"].rows.select("src", "dst", "quantity"), g.nodes["Order"].select("id", F.col("o_orderstatus").alias("status")), g.nodes["Part"].select("id", F.col("p_brand").alias("brand")))
    return rows.select("quantity", "status", "brand")


@query("SELECT min(n) AS least, max(n) AS most, sum(n)::BIGINT AS edges FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1)")
def degree_bounds(g, t):
    return benchmarks.degrees(g.nodes["Customer"], t.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("src")), "src")


@query("SELECT count(*) AS pairs FROM (SELECT DISTINCT s_suppkey, b.n_nationkey FROM supplier JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON a.n_regionkey = b.n_regionkey) x")
def allowed_pairs(g, t):
    sources = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.col("n_regionkey").alias("anchor"))
    return benchmarks.allowed_pairs(sources, t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("anchor"))).agg(F.count("*").alias("pairs"))


@query("SELECT count(*) AS violations FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey")
def anchor_violations(g, t):
    sources = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("id"), F.col("c_nationkey").alias("anchor"))
    targets = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("anchor"))
    return benchmarks.violations(g.edges["supplied_by"].rows, sources, targets).agg(F.count("*").alias("violations"))


@query("SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def repeated_ids(g, t):
    return benchmarks.repeated(t.lineitem.withColumnRenamed("l_orderkey", "k"), "k")


@query("SELECT n_name AS parameter, count(*) AS n_answers, string_agg(a, ', ' ORDER BY a) AS answer, concat('Which segments buy in ', n_name, '?') AS question FROM (SELECT DISTINCT n_name, c_mktsegment AS a FROM nation JOIN customer ON c_nationkey = n_nationkey) GROUP BY 1")
def qa_batch(g, t):
    m = g.match("n", "Nation", ("n_name",)).into("n", "lives_in", "c", ("c_mktsegment",))
    return benchmarks.questions(m.rows, "n_n_name", "c_c_mktsegment", F.concat(F.lit("Which segments buy in "), F.col("parameter"), F.lit("?")))


@query("SELECT r_regionkey AS col1, r_name AS col2 FROM region")
def rename_columns(g, t):
    return benchmarks.renamed(t.region.select("r_regionkey", "r_name"), {"r_regionkey": "col1", "r_name": "col2"})


# answers

@query("SELECT n_name AS nation, coalesce(string_agg(c_mktsegment, ', ' ORDER BY c_mktsegment), '(no result)') AS answer FROM nation LEFT JOIN (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_acctbal > 9000) ON c_nationkey = n_nationkey GROUP BY 1")
def answer_format(g, t):
    rich = t.customer.where("c_acctbal > 9000").select("c_nationkey", "c_mktsegment")
    rows = t.nation.join(rich, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_name").alias("nation"), "c_mktsegment")
    return answers.formatted(rows, ["nation"], ["c_mktsegment"], ["c_mktsegment"])


@query("SELECT r_name AS region, concat((SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey), '; ', (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = r_regionkey)) AS answer FROM region")
def answer_combine(g, t):
    base = g.match("r", "Region", ("r_name",)).into("r", "in_region", "n")
    one = base.rows.groupBy(F.col("r_r_name").alias("region")).agg(F.count("*").cast("string").alias("answer"))
    two = base.into("n", "lives_in", "c").rows.groupBy(F.col("r_r_name").alias("region")).agg(F.count("*").cast("string").alias("answer"))
    return answers.combined(one, two, ["region"])


@query("SELECT o_orderpriority AS kind, count(*) AS total, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END)::BIGINT AS correct, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 4) AS accuracy FROM orders GROUP BY 1")
def accuracy_report(g, t):
    rows = t.orders.select(F.col("o_orderpriority").alias("kind"), F.concat(F.lit("['"), F.lower("o_orderstatus"), F.lit("']")).alias("got"), F.lit("F").alias("want"))
    return answers.accuracy(rows, ["kind"], "got", "want")


@query("SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_nationkey % 4 = 3 UNION ALL SELECT c_custkey, '0' FROM customer WHERE c_nationkey % 4 = 2")
def present_values(g, t):
    """Null and blank values are missing, zero is not."""
    v = F.when(F.col("c_nationkey") % 4 == 1, " \t").when(F.col("c_nationkey") % 4 == 2, "0").when(F.col("c_nationkey") % 4 == 3, F.col("c_name"))
    return t.customer.withColumn("v", v).where(present(F.col("v"))).select(F.col("c_custkey").alias("k"), value(F.col("v")).alias("v"))


@query("SELECT p_partkey AS part, len(list_distinct(list_filter(string_split_regex(lower(p_type), '[^a-z0-9]+'), lambda x: x <> ''))) AS tokens FROM part")
def type_tokens(g, t):
    return t.part.select(F.col("p_partkey").alias("part"), F.size(name_tokens(F.lower("p_type"))).cast("long").alias("tokens"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["hop3_count_distinct"](spark, sf_dir)
