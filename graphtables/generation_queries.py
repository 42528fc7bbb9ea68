"""Queries of generated data: edges by degree stubs, draws, natural keys, denormalised tables, questions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import denormalise, generation, questions
from .operators.generation import Bounds, Kind
from .plans.graph import PropertyGraph
from .registry import Tables, query
from .sources.shared import scratch


def regional(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Customers and nations, both anchored at their region."""
    sources = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("id"), F.col("n_regionkey").alias("anchor"))
    return sources, t.nation.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("anchor"))


@query(
    """WITH s AS (SELECT c_custkey AS id, n_regionkey AS a FROM customer JOIN nation ON c_nationkey = n_nationkey), n AS (SELECT a, count(*) AS s, (SELECT count(*) FROM nation WHERE n_regionkey = a) AS t FROM s GROUP BY 1)
SELECT 'src' AS "end", id, least(2, t) AS degree, true AS sound, a AS anchor FROM s JOIN n USING (a) UNION ALL SELECT 'dst', n_nationkey, NULL, true, n_regionkey FROM nation JOIN n ON n.a = n_regionkey"""
)
def stub_edges_exact(g, t):
    """Two nations of the own region for every customer, and for every nation between half and double its share."""
    sources, targets = regional(t)
    share = sources.groupBy("anchor").agg(F.count("*").alias("s")).join(targets.groupBy("anchor").agg(F.count("*").alias("t")), "anchor")
    bounds = share.agg(F.min(F.floor(F.col("s") / F.col("t"))).alias("least"), F.max(F.ceil(4 * F.col("s") / F.col("t"))).alias("most")).first()  # one row
    drawn = generation.edges_by_stubs(sources, targets, Bounds(2, 2, bounds.least, bounds.most), seed=11)
    anchors = drawn.join(sources.toDF("src", "a"), "src").join(targets.toDF("dst", "b"), "dst").where("a = b").select("src", "dst").distinct()  # what is sound counts alone
    out = anchors.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    into = anchors.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("degree"))
    one = sources.join(out, "id", "left").select(F.lit("src").alias("end"), "id", "degree", (F.col("degree") == 2).alias("sound"), "anchor")
    two = targets.join(into, "id", "left").select(F.lit("dst").alias("end"), F.col("id").cast("long").alias("id"), F.lit(None).cast("long").alias("degree"), F.col("degree").between(bounds.least, bounds.most).alias("sound"), "anchor")
    return one.union(two)


@query("SELECT p_partkey AS part, true AS sound, (SELECT count(*) FROM supplier) > 0 AS reached FROM part WHERE p_size % 7 IN (SELECT s_nationkey % 7 FROM supplier)")
def stub_edges_range(g, t):
    """One to three suppliers of its class for each part, at least one part for each supplier: every bound holds."""
    sources = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_size") % 7).alias("anchor"))
    targets = t.supplier.select(F.col("s_suppkey").alias("id"), (F.col("s_nationkey") % 7).alias("anchor"))
    sources = sources.join(targets.select("anchor").distinct(), "anchor", "left_semi").select("id", "anchor")
    targets = targets.join(sources.select("anchor").distinct(), "anchor", "left_semi").select("id", "anchor")
    bounds = Bounds(1, 3, 1, None)
    drawn = generation.edges_by_stubs(sources, targets, bounds, seed=5)
    problems = generation.degree_problems(drawn, sources, targets, bounds).agg((F.count("*") == 0).alias("sound"))
    degrees = drawn.groupBy(F.col("src").alias("part")).agg(F.count("*").between(1, 3).alias("own"))
    reached = targets.join(drawn.select(F.col("dst").alias("id")), "id", "left_anti").agg((F.count("*") == 0).alias("reached"))
    return degrees.crossJoin(F.broadcast(problems)).crossJoin(F.broadcast(reached)).select("part", (F.col("own") & F.col("sound")).alias("sound"), "reached")  # one row each


@query("SELECT o_custkey AS customer, count(*) AS orders, count(*) AS different, count(*) AS aligned FROM orders GROUP BY 1")
def unique_draws(g, t):
    """Every order draws a part that no other order of its customer draws, with the part's own name."""
    values = generation.ranked(t.part.select("p_partkey", "p_name").withColumn("_all", F.lit(0)), ["_all"], generation.seeded(3, "p_partkey"), "p_partkey", "position").select("position", F.col("p_partkey").alias("part"), F.col("p_name").alias("name"))
    drawn = generation.unique_draws(t.orders.select("o_custkey", "o_orderkey"), "o_orderkey", values, 7, ["o_custkey"])
    checked = drawn.join(t.part.select(F.col("p_partkey").alias("part"), "p_name"), "part", "left")
    return checked.groupBy(F.col("o_custkey").alias("customer")).agg(F.count("*").alias("orders"), F.count_distinct("part").alias("different"), F.count_if(F.col("p_name") == F.col("name")).alias("aligned"))


@query("SELECT c_custkey AS id, true AS in_range, true AS typed, concat('Customer ', c_custkey, ' of ', c_mktsegment) AS label FROM customer")
def drawn_properties(g, t):
    """Typed seeded properties of every customer, each within its range, and a template of its own columns."""
    specs = {"age": {"type": "integer", "range": [18, 80]}, "rate": {"type": "float", "range": [0.5, 1.5], "decimals": 3}, "since": {"type": "date", "range": ["2020-01-01", "2020-12-31"]}, "active": {"type": "boolean"}, "tier": {"values": ["a", "b", "c"]}, "label": {"template": "Customer {c_custkey} of {c_mktsegment}"}}
    drawn = generation.drawn_properties(t.customer, "c_custkey", specs, 42)
    inside = F.col("age").between(18, 80) & F.col("rate").between(0.5, 1.5) & F.col("since").between("2020-01-01", "2020-12-31")
    typed = F.col("active").isNotNull() & F.col("tier").isin("a", "b", "c") & (F.round("rate", 3) == F.col("rate"))
    return drawn.select(F.col("c_custkey").alias("id"), inside.alias("in_range"), typed.alias("typed"), "label")


def hierarchy(t: Tables) -> dict[str, Kind]:
    """Regions, nations of a region, segments of a nation, and customers by id."""
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("n_name").alias("nation"), F.col("r_name").alias("parent_Region"))
    customers = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    segments = customers.select(F.col("c_mktsegment").alias("segment"), F.col("nation").alias("parent_Nation"), "parent_Region").distinct()
    people = customers.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("parent_Segment"), F.col("nation").alias("parent_Nation"), "parent_Region")
    return {"Region": Kind(t.region.select(F.col("r_name").alias("name")), "name"), "Nation": Kind(nations.drop("n_nationkey"), "nation", "Region"), "Segment": Kind(segments, "segment", "Nation"), "Customer": Kind(people, "id", "Segment")}


@query("SELECT 'Nation' AS kind, r_name AS src, concat_ws('|', n_name, r_name) AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT 'Segment', concat_ws('|', n_name, r_name), concat_ws('|', c_mktsegment, n_name, r_name) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION SELECT 'Customer', concat_ws('|', c_mktsegment, n_name, r_name), CAST(c_custkey AS VARCHAR) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def natural_key_chain(g, t):
    """Edges from parents to children down four levels, with composite keys, made of each child's own columns."""
    parts = [edges.select(F.lit(kind).alias("kind"), "src", "dst") for kind, edges in generation.parent_edges(hierarchy(t)).items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT 'Region' AS kind, count(*) AS keys FROM region UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Segment', count(*) FROM (SELECT DISTINCT c_nationkey, c_mktsegment FROM customer) UNION ALL SELECT 'Customer', count(*) FROM customer UNION ALL SELECT 'orphan', (SELECT count(*) FROM customer WHERE c_acctbal < 0)")
def natural_key_nodes(g, t):
    """How many different keys each level has, and the children that are left without a parent if some are taken away."""
    kinds = hierarchy(t)
    parts = [df.agg(F.count("*").alias("keys")).select(F.lit(kind).alias("kind"), "keys") for kind, df in generation.natural_keys(kinds).items()]
    lost = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("id"), F.lit("nowhere").alias("parent_Segment"), F.lit("NATION_0").alias("parent_Nation"), F.lit("none").alias("parent_Region"))
    orphans = generation.orphans(kinds | {"Customer": Kind(kinds["Customer"].rows.union(lost), "id", "Segment")}).agg(F.count("*").alias("keys"))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(orphans.select(F.lit("orphan").alias("kind"), "keys"))


#: The types at the ends of the relations, whose ids overlap.
ENDS = {"places": ("Customer", "Order"), "contains": ("Order", "Part"), "lives_in": ("Customer", "Nation")}


def placed_relations(g: PropertyGraph) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    return {n: g.nodes[n] for n in ("Customer", "Order", "Part", "Nation")}, {n: g.edges[n].rows.withColumnRenamed("edge_id", "place") for n in ENDS}


@query(
    """WITH l AS (SELECT * FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1)
SELECT o_orderkey AS o, o_orderstatus AS status, c_name AS customer, c_mktsegment AS segment, l_quantity AS quantity, p_brand AS brand, p_size AS size, CAST(NULL AS VARCHAR) AS nothing FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey"""
)
def value_sources(g, t):
    """A table of orders with columns of five sources: own fields, the customer at the other end, the first line and its part."""
    columns = {"o": "entity.Order.id", "status": "entity.Order.o_orderstatus", "customer": "relation.places.source.Customer.c_name", "segment": "relation.places.source.Customer.c_mktsegment", "quantity": "relation.contains.quantity", "brand": "relation.contains.target.Part.p_brand", "size": "relation.contains.target.Part.p_size", "nothing": "entity.Order.no_such"}
    return denormalise.entity_table(*placed_relations(g), "Order", columns, types=ENDS)


@query("SELECT c_name AS customer, o_orderkey AS o, o_orderstatus AS status, o_totalprice AS price, n_name AS nation FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def value_sources_expanded(g, t):
    """Customers expanded to one row an order, with fields of the edge's end and of another relation."""
    columns = {"customer": "entity.Customer.c_name", "o": "target.Order.id", "status": "target.Order.o_orderstatus", "price": "relation.places.target.Order.o_totalprice", "nation": "relation.lives_in.target.Nation.n_name"}
    return denormalise.entity_table(*placed_relations(g), "Customer", columns, expand="places", types=ENDS)


@query("SELECT o_orderkey AS o, p_brand AS brand, l_quantity AS quantity, c_name AS customer FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN customer ON o_custkey = c_custkey")
def value_sources_relation(g, t):
    """A row for each edge, with fields of the edge, of both ends, and of a relation of its source."""
    columns = {"o": "source.Order.id", "brand": "target.Part.p_brand", "quantity": "relation.contains.quantity", "customer": "relation.places.source.Customer.c_name"}
    return denormalise.relation_table(*placed_relations(g), "contains", columns, types=ENDS)


def templates() -> list[questions.Template]:
    def living(g: PropertyGraph, params: DataFrame):
        return questions.bound(g, params, "n", "Nation", n_name="nation").into("n", "lives_in", "c", ("c_mktsegment",)).rows

    def greatest(g: PropertyGraph, params: DataFrame) -> DataFrame:
        m = questions.bound(g, params, "r", "Region", r_name="region").into("r", "in_region", "n", ("n_name",)).into("n", "lives_in", "c")
        counted = m.rows.groupBy("pid", F.col("n_n_name").alias("answer")).agg(F.count("*").alias("k"))
        best = counted.groupBy("pid").agg(F.max("k").alias("k"))
        return counted.join(best, ["pid", "k"])

    def balance(g: PropertyGraph, params: DataFrame) -> DataFrame:
        m = questions.bound(g, params, "c", "Customer", ("c_acctbal",), c_name="customer", c_mktsegment="segment")
        return m.rows.select("pid", F.col("c_c_acctbal").alias("answer"))

    nation, region = {"nation": ("Nation", "n_name")}, {"region": ("Region", "r_name")}
    return [
        questions.Template("count", "How many customers live in {nation}?", lambda g, p: living(g, p).groupBy("pid").agg(F.count("*").alias("answer")), nation),
        questions.Template("list", "Which segments buy in {nation}?", lambda g, p: living(g, p).select("pid", F.col("c_c_mktsegment").alias("answer")), nation),
        questions.Template("top", "Which nation of {region} has most customers?", greatest, region, unique=True),
        questions.Template("linked", "What is the balance of {customer}, who buys in {segment}?", balance, {"customer": ("Customer", "c_name")}, {"segment": ("customer", "c_mktsegment")}),
    ]


@query(
    """WITH c AS (SELECT n_name, n_regionkey, c_mktsegment FROM nation JOIN customer ON c_nationkey = n_nationkey), k AS (SELECT n_regionkey, n_name, count(*) AS k FROM c GROUP BY 1, 2), best AS (SELECT * FROM k QUALIFY k = max(k) OVER (PARTITION BY n_regionkey))
SELECT 'count' AS kind, concat('How many customers live in ', n_name, '?') AS question, CAST(count(*) AS VARCHAR) AS answer FROM c GROUP BY n_name
UNION ALL SELECT 'list', concat('Which segments buy in ', n_name, '?'), string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) FROM c GROUP BY n_name
UNION ALL SELECT 'top', concat('Which nation of ', r_name, ' has most customers?'), any_value(n_name) FROM best JOIN region ON n_regionkey = r_regionkey GROUP BY r_name HAVING count(*) = 1"""
)
def generated_questions(g, t):
    """Three templates asked for every parameter at once; ties of the superlative are dropped."""
    return questions.generated_questions(g, templates(), {"count": 100, "list": 100, "top": 100}, seed=42).select("kind", "question", "answer")


@query("SELECT kind, questions, true AS sound FROM (SELECT 'count' AS kind, least(7, count(DISTINCT c_nationkey)) AS questions FROM customer UNION ALL SELECT 'linked', least(20, count(*)) FROM customer)")
def question_quotas(g, t):
    """Quotas cut a seeded order of draws; linked parameters come from one customer, so each question has its answer."""
    asked = questions.generated_questions(g, templates(), {"count": 7, "linked": 20}, seed=42)
    rows = t.customer.select(F.concat(F.lit("What is the balance of "), "c_name", F.lit(", who buys in "), "c_mktsegment", F.lit("?")).alias("question"), F.col("c_acctbal").cast("string").alias("right"))
    checked = asked.join(rows, "question", "left").withColumn("sound", (F.col("kind") == "count") | (F.col("answer") == F.col("right")))
    return checked.groupBy("kind").agg(F.count("*").alias("questions"), F.bool_and("sound").alias("sound"))


@query(
    """SELECT item, question, 'ok' AS status, answer, answer = expected AS correct FROM (
SELECT 'counts' AS item, 'customers' AS question, CAST((SELECT count(*) FROM customer) AS VARCHAR) AS answer, CAST((SELECT count(*) FROM customer) AS VARCHAR) AS expected
UNION ALL SELECT 'counts', 'orders', CAST((SELECT count(*) FROM orders) AS VARCHAR), '-1'
UNION ALL SELECT 'names', 'segments', (SELECT string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) FROM customer), (SELECT string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) FROM customer)
UNION ALL SELECT 'names', 'nobody', '(no result)', NULL) UNION ALL SELECT 'names', 'broken', 'error', NULL, NULL"""
)
def question_batch(g, t):
    """Five questions over one graph, one of them broken; the second run asks only that one again."""
    count = lambda label: lambda: g.match("x", label).rows.agg(F.count("*").alias("answer"))
    segments = t.customer.select("c_mktsegment").distinct()
    expected = str(t.customer.count()), ", ".join(sorted(r[0] for r in segments.collect()))  # five segments
    asked = [
        questions.Question("counts", "customers", count("Customer"), expected[0]),
        questions.Question("counts", "orders", count("Order"), "-1"),
        questions.Question("names", "segments", lambda: g.match("c", "Customer", ("c_mktsegment",)).rows.select("c_c_mktsegment"), expected[1]),
        questions.Question("names", "nobody", lambda: g.match("c", "Customer", ("c_name",), c_mktsegment="none").rows.select("c_c_name")),
        questions.Question("names", "broken", lambda: g.match("c", "Customer").out("c", "owns", "x").rows),
    ]
    log = f"{scratch(t.spark)}/question-log-{uuid.uuid4().hex}"
    questions.question_batch(t.spark, asked[:3], log)
    return questions.question_batch(t.spark, asked, log).select("item", "question", "status", "answer", F.when(F.col("expected").isNotNull() & (F.col("status") == "ok"), F.col("answer") == F.col("expected")).alias("correct"))
