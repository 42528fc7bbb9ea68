"""Small fixtures for values, keys, entities, schemas, patterns, answers, generators, sources and sinks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphtables.functions import values
from graphtables.operators import answers, benchmarks, edges, entities, keys, profile
from graphtables.plans import schema
from graphtables.plans.graph import Edge, PropertyGraph, winners
from graphtables.sources import sinks, tables


def column(spark, rows, e):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "c string").select(e(F.col("c"))).collect()]


def test_numbers_and_dates(spark):
    assert column(spark, ["4.0", " 7\t", "1_000", "1.0d", "3f", "x", None, "-2e3", ".5", ""], values.number) == [4.0, 7.0, 1000.0, None, None, None, None, -2000.0, 0.5, None]
    assert [d and str(d) for d in column(spark, ["2024-01-01", "2024", "2024-1-1", "2024-01-01T10:00:00", "2024-13-01"], values.iso_date)] == ["2024-01-01", None, None, None, None]


def test_identifiers(spark):
    df = spark.createDataFrame([("a", "b"), (" a\t", "b"), ("", "b"), (None, "b")], "x string, y string")
    both = [F.col("x"), F.col("y")]
    assert [r[0] for r in df.select(values.identifier(both)).collect()] == ["a|b", "a|b", None, None]
    assert [r[0] for r in df.select(values.rendered_key(both)).collect()] == ["a|b", " a\t|b", "|b", "|b"]


def test_shown_values(spark):
    row = spark.range(1).select(values.shown(F.lit(4.0), "double"), values.shown(F.lit(2.5), "double"), values.shown(F.lit(None).cast("string"), "string"), values.shown(F.lit(True), "boolean"), values.snake_case(F.lit("OrderRef No")), values.padded_id("ord", "-", F.lit(7), 4)).first()
    assert list(row) == ["4", "2.5", "", "true", "order_ref_no", "ord-0007"]


def test_inferred_types(spark):
    df = spark.createDataFrame([("1", "1.5", "2024-01-01", "x", None, "1_000"), ("2.0", "2", "2024-02-01", "1", None, "2")], "i string, d string, day string, s string, n string, u string")
    assert {r["column"]: r["type"] for r in profile.inferred_types(df, df.columns).collect()} == {"i": "INT64", "d": "DOUBLE", "day": "DATE", "s": "STRING", "n": "STRING", "u": "INT64"}
    assert dict(profile.typed(df).dtypes) == {"i": "bigint", "d": "double", "day": "date", "s": "string", "n": "string", "u": "bigint"}


def test_key_repair(spark):
    df = spark.createDataFrame([(1, "a", "x", None), (1, "b", "x", None), (2, "c", "y", 1)], "k int, p string, q string, r int")
    assert keys.repaired_key(df, ["k"], ["p", "q", "r"]) == ["k", "p"]
    null = spark.createDataFrame([(1, None), (1, "a")], "k int, p string")
    assert keys.repaired_key(null, ["k"], ["p"]) == ["k", "p"]
    with pytest.raises(ValueError):
        keys.repaired_key(df.withColumns({"a": F.lit(1), "b": F.lit(1)}), ["k", "a", "b"], ["p"])
    assert keys.repaired_key(df.limit(0), ["k"], ["p"]) == ["k"]


def test_one_repair_is_enough(spark):
    r = random.Random(1)
    for _ in range(5):
        df = spark.createDataFrame([tuple(r.choice([None, 0, 1]) for _ in range(4)) for _ in range(12)], "k int, a int, b int, c int")
        key = keys.repaired_key(df, ["k"], ["a", "b", "c"])
        rest = [c for c in "abc" if c not in key]
        assert not rest or not keys.conflicts(df, key, rest).where("conflicting").count()


def test_entities_take_the_first_value_present(spark):
    a = spark.createDataFrame([(1, "7", " "), (2, "7", "late"), (3, None, "z")], "n int, id string, name string")
    b = spark.createDataFrame([(1, "7", "other", "new")], "n int, ref string, title string, city string")
    parts = [entities.fragments(a, entities.Cluster("a", "c", ["id"], {"name": ["name"]}), F.col("n"), (0, 0)), entities.fragments(b, entities.Cluster("b", "c", ["ref"], {"name": ["title"], "city": ["city"]}), F.col("n"), (1, 0))]
    assert [tuple(r) for r in entities.resolved(parts).collect()] == [("7", 3, "late", "new")]
    ids = spark.createDataFrame([("10",), ("9",), ("x",)], "id string")
    assert [r.id for r in entities.naturally_ordered(ids).collect()] == ["9", "10", "x"]


def test_rekeying_by_a_secondary_key(spark):
    found = spark.createDataFrame([("ann",), ("5",)], "id string")
    reference = spark.createDataFrame([("ann", "9", 9), ("ann", "10", 10), ("bob", "3", 1)], "name string, key string, row long")
    assert sorted(r.id for r in entities.rekeyed(found, reference, "name", "key", "row").collect()) == ["10", "5"]


def test_edges(spark):
    e = spark.createDataFrame([("a", "b", 1), ("a", "b", 1), ("a", "b", 2), ("a", "c", 1)], "src string, dst string, p int")
    assert edges.deduplicated(e).count() == 3 == edges.deduplicated(edges.deduplicated(e)).count()
    a, b = spark.createDataFrame([("a",)], "id string"), spark.createDataFrame([("b",)], "id string")
    assert edges.anchored(e, a, b).count() == 3
    assert [tuple(r) for r in edges.materialised({"x": e, "none": e.limit(0)}).collect()] == [("x", 4)]
    t = spark.createDataFrame([("t9", "v", 9), ("t10", "v", 10)], "id string, value string, row long")
    assert [tuple(r) for r in edges.cross_table_edges(spark.createDataFrame([("s", "v")], "id string, value string"), t, "row").collect()] == [("s", "t10")]


def test_winners_keep_ties_and_skip_nulls(spark):
    s = spark.createDataFrame([("a", 2), ("b", 2), ("c", 1), ("d", None)], "x string, s int")
    assert sorted(r.x for r in winners(s, "s").collect()) == ["a", "b"]
    assert winners(s.where("s IS NULL"), "s").count() == 0 and winners(s.limit(0), "s").count() == 0


def test_pattern_without_node_joins_equals_the_full_one(spark):
    nodes = {"A": spark.createDataFrame([(1, "x"), (2, "y")], "id int, n string"), "B": spark.createDataFrame([(5, "u"), (6, "v")], "id int, n string")}
    g = PropertyGraph(nodes, {"r": Edge(spark.createDataFrame([(1, 5), (1, 6), (2, 6)], "src int, dst int"), "A", "B")})
    lean, full = g.match("a", "A").out("a", "r", "b"), g.match("a", "A", ("n",)).out("a", "r", "b", ("n",))
    assert sorted(lean.rows.collect()) == sorted(full.rows.select("a_id", "b_id").collect())
    assert "Join" in lean.rows._jdf.queryExecution().optimizedPlan().toString()
    two = g.match("b", "B", n="v").into("b", "r", "a").out("a", "r", "b2")
    assert two.rows.count() == 3
    assert g.match("a", "A").without(g.match("b", "B", n="u").into("b", "r", "a"), "a").rows.first().a_id == 2
    assert g.problems("r", "B", "A") == ["r runs from A to B: turn it round"] and g.problems("q") == ["unknown relationship q"]
    assert len(g.described()) == 3


def test_answers(spark):
    df = spark.createDataFrame([("q1", "a", 1.0), ("q1", "b", 2.5), ("q1", "a", 1.0), ("q2", None, None), ("q3", "z", 3.0)], "q string, x string, y double")
    assert {r.q: r.answer for r in answers.formatted(df, ["q"], ["x", "y"], ["x"]).collect()} == {"q1": "a, 1 | b, 2.5", "q2": "(no result)", "q3": "z, 3"}
    one = answers.formatted(df, ["q"], ["x"], ["x"])
    assert {r.q: r.answer for r in answers.combined(one, one, ["q"]).collect()} == {"q1": "a, b; a, b", "q2": "(no result)", "q3": "z; z"}


@pytest.mark.parametrize(("got", "want", "good"), [("['a','b']", "b, a", True), ("1", "1.0000001", True), ("1", "1.1", False), ("(no result)", "", True), ("x.", "X", True), ("a | b", "b;a", True), ("a", "b", False), ("['2,000 Man']", "2,000 man", True), (None, None, True)])
def test_agreement(got, want, good):
    assert answers.agree(got, want) == good


def test_schema_checks_and_build(spark):
    rows = spark.createDataFrame([(1, "o1", "10", "c1", "ann", "berlin"), (2, "o2", "20", "c1", "ann", "berlin"), (3, "o3", "5", "c2", "bob", None)], "n int, order_ref string, amount string, client_no string, client_name string, client_city string")
    t = {"wide": rows.drop("n")}
    s = schema.Schema([schema.Proposal("wide", "o", "Order", ("order_ref",), ("amount",)), schema.Proposal("wide", "c", "Client", ("client_no",), ("client_name", "client_city"))], [schema.Relation("wide", "o", "c", "placed_by"), schema.Relation("wide", "o", "o", "self"), schema.Relation("wide", "c", "o", "placed_by")])
    good = schema.checked(s, {"wide": t["wide"].columns})
    assert [r.label for r in good.relations] == ["placed_by", "placed_by_Order"] and len(good.issues) == 2
    g = schema.built({"wide": rows}, {"wide": "n"}, good)
    assert g.nodes["Client"].count() == 2 and g.match("c", "Client", client_no="c1").into("c", "placed_by", "o").rows.count() == 2
    found = schema.guessed("wide", t["wide"])
    assert [c.entity for c in found.clusters] == ["Order", "Client"] and found.relations[0].label == "has_client"
    assert schema.coverage("wide", ["a", "b"], [schema.Proposal("wide", "x", "X", ("a",), ("z",))]) == ["wide: unknown column z", "wide: column b is in no cluster"]


def test_generators(spark):
    a = benchmarks.generated(spark, 30, "plant", 7, {"city": ["x", "y"]})
    assert sorted(a.collect()) == sorted(benchmarks.generated(spark, 30, "plant", 7, {"city": ["x", "y"]}).collect()) and {r.city for r in a.collect()} == {"x", "y"}
    assert benchmarks.repeated(a, "entity_id").count() == 0
    kids = benchmarks.children(a, "entity_id", 1, 3, 7).groupBy("entity_id").count().agg(F.min("count"), F.max("count")).first()
    assert 1 <= kids[0] <= kids[1] <= 3
    ids = spark.range(20).withColumn("anchor", F.col("id") % 2)
    pairs = benchmarks.allowed_pairs(ids, ids)
    e = benchmarks.sampled_edges(pairs, 1, 3, 1, 6, 5)
    assert benchmarks.violations(e, ids, ids).count() == 0
    assert benchmarks.degrees(ids, e, "dst").first().least >= 1 and benchmarks.degrees(ids, e, "src").first().most <= 3
    assert benchmarks.denormalised(ids.withColumnRenamed("anchor", "x"), "id", e).count() >= 20
    with pytest.raises(ValueError):
        benchmarks.renamed(ids, {"id": "anchor"})


def test_sampled_edges_keep_every_bound_or_raise(spark):
    rows = [(s, 0) for s in range(30)] + [(s, 1 + s % 10) for s in range(30)]  # target 0 is open to all
    pairs = spark.createDataFrame(rows, "src long, dst long")
    ends = [pairs.select(F.col(c).alias("id")).distinct() for c in ("src", "dst")]
    e = benchmarks.sampled_edges(pairs, 1, 2, 2, 4, 5)
    out, into = (benchmarks.degrees(n, e, c).first() for n, c in zip(ends, ("src", "dst")))
    assert 1 <= out.least <= out.most <= 2 <= into.least <= into.most <= 4 and e.distinct().count() == e.count()
    with pytest.raises(ValueError):
        benchmarks.sampled_edges(pairs, 1, 2, 4, 6, 5)
    with pytest.raises(ValueError):
        benchmarks.sampled_edges(pairs.where("dst = 0"), 1, 1, 1, 4, 5, attempts=2)


def test_sources_and_sinks(spark, tmp_path):
    doc = [{"id_": 1, "question": "q", "answer": "a", "table_names": ["t", "u"], "tables": [{"table_columns": ["x", "y"], "table_content": [["1", "2"], ["3"]]}]}, {"id_": 2, "question": "r", "qa_pairs": [{"question": "r1", "answer": "b"}, {"question": "r2", "answer": "c"}]}]
    (tmp_path / "items.json").write_text(json.dumps(doc))
    found = tables.items(spark, str(tmp_path / "items.json"))
    assert sorted((r.row, r["column"], r.value) for r in tables.item_rows(found).collect()) == [(0, "x", "1"), (0, "y", "2"), (1, "x", "3"), (1, "y", None)]
    assert sorted((r.id_, r.question) for r in tables.item_questions(found).collect()) == [(1, "q"), (2, "r1"), (2, "r2")]
    assert tables.items(spark, str(tmp_path / "items.json"), 2, 2).count() == 1
    with pytest.raises(ValueError):
        tables.items(spark, "x", 3, 2)
    (tmp_path / "t.csv").write_text("﻿a , b\n1,\n x,2\n", encoding="utf-8")
    got = tables.csv(spark, str(tmp_path / "t.csv"))
    assert got.columns == ["a", "b"] and [tuple(r) for r in got.collect()] == [("1", None), ("x", "2")]
    for rows in ([(1,)], [(1,), (2,)]):
        sinks.append_new(spark.createDataFrame(rows, "k int"), str(tmp_path / "log"), "k")
    assert sorted(r.k for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [1, 2]
    g = PropertyGraph({"A": spark.createDataFrame([(1,)], "id int")}, {"r": Edge(spark.createDataFrame([(1, 1)], "src int, dst int"), "A", "A")})
    sinks.write_graph(g, str(tmp_path / "g"))
    assert sinks.read_graph(spark, str(tmp_path / "g"), ["A"], {"r": ("A", "A")}).match("a", "A").out("a", "r", "b").rows.count() == 1
    assert not sinks.write_csv(got.limit(0), str(tmp_path / "none")) and sinks.write_csv(got, str(tmp_path / "some"))


def test_key_kinds_and_references():
    headers = {"Orders": ["Id", "cust", "note"], "Customers": ["key", "name"]}
    found = schema.sound_references([("orders", "cust", "customers", "KEY"), ("Orders", "cust", "Nowhere", "key"), ("Orders", "gone", "Customers", "key")], headers)
    assert found == [("Orders", "cust", "Customers", "KEY")]
    kinds = [schema.key_kind("Orders", c, {"Orders": ["id"]}, found) for c in headers["Orders"]]
    assert kinds == ["primary_key", "foreign_key", "descriptive"] and schema.key_kind("Customers", "name", {}, found) == "unknown"


def test_clusters_of_one_class_unite_their_properties():
    merged = schema.merged_classes([schema.Proposal("a", "x", "Site", ("site",), ("City",)), schema.Proposal("b", "y", "SITE", ("place",), ("city", "size")), schema.Proposal("b", "z", "Part", ("no",))])
    assert set(merged) == {"Site", "Part"} and merged["Site"].key == ("site",)
    assert merged["Site"].properties == {"site": ["a.site"], "city": ["a.City", "b.city"], "place": ["b.place"], "size": ["b.size"]}


def test_placeholders_and_quotas():
    assert benchmarks.placeholders("MATCH (a {k: $site, d: $day}) WHERE a.x = $site") == ["site", "day"]
    assert benchmarks.quotas(8, ["a", "b", "c"]) == {"a": 3, "b": 3, "c": 2}
    assert benchmarks.quotas(8, ["a", "b"], {"b": 5}) == {"a": 0, "b": 5}
    with pytest.raises(ValueError):
        benchmarks.quotas(8, ["a"], {"z": 1})


def test_answers_of_every_form(spark):
    forms = {None: "", "plain": "plain", '{"columns": ["a"], "data": [["x"], ["y"]]}': "x, y", '["p", "q"]': "p, q", '[["one", 2]]': "one", "": ""}
    df = spark.createDataFrame([(f,) for f in forms], "answer string")
    assert {r.answer: r.text for r in df.select("answer", tables.answer_text(df["answer"]).alias("text")).collect()} == forms


def test_sampled_edges_take_few_rounds_where_both_ends_bind(spark, monkeypatch):
    """2000 sources of one edge each, four targets that must hold a quarter: what is lacking moves at once, not an edge a round."""
    pairs = spark.range(2000).withColumnRenamed("id", "src").crossJoin(spark.range(4).withColumnRenamed("id", "dst"))
    written = []
    save = benchmarks.saved
    monkeypatch.setattr(benchmarks, "saved", lambda df, label: (written.append(label), save(df, label))[1])
    for hot in (benchmarks.HOT, 100):  # by one task, and in runs of the hash
        monkeypatch.setattr(benchmarks, "HOT", hot)
        written.clear()
        e = benchmarks.sampled_edges(pairs, 1, 1, 500, 500, 5)
        assert e.distinct().count() == e.count() == 2000 and e.select("src").distinct().count() == 2000
        assert [r["count"] for r in e.groupBy("dst").count().collect()] == [500] * 4
        assert written.count("edges-chosen") < 30


def test_anchors_tell_apart_each_step_once(spark):
    """The label's own nodes are told apart by one aggregate, not by one for each step of the path."""
    edge = lambda rows, s, t: Edge(spark.createDataFrame(rows, "src long, dst long"), s, t)
    node = lambda rows: spark.createDataFrame(rows, "id long, name string")
    g = PropertyGraph({"A": node([(1, "a"), (2, "b"), (3, "c")]), "B": node([(1, "x"), (2, "y")]), "C": node([(1, "u"), (2, None), (3, "u")])}, {"r": edge([(1, 1), (1, 2), (2, 2), (9, 1)], "A", "B"), "s": edge([(1, 1), (3, 1), (2, 2), (1, 2)], "C", "B")})
    path = [("r", True), ("s", False)]
    assert sorted(map(tuple, g.anchors("A", path).collect())) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2)]
    named = g.anchors("A", path, "name")
    assert sorted(map(tuple, named.collect())) == [(1, "u"), (2, "u")]
    assert sorted(map(tuple, g.anchors("A", [], "name").collect())) == [(1, "a"), (2, "b"), (3, "c")]
    # a repartition marks the label's own edges in the plan
    marked = PropertyGraph(dict(g.nodes), {"r": Edge(g.edges["r"].rows.repartition(7), "A", "B"), "s": g.edges["s"]})
    lines = marked.anchors("A", path, "name")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    at = next(k for k, line in enumerate(lines) if "Repartition" in line)
    depth, above = lines[at].index("Rep"), 0
    for line in reversed(lines[:at]):
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth:
            depth, above = indent, above + ("Aggregate [" in line)
    assert above == 1
