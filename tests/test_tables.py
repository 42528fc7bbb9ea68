"""Many tables at once: items, types, keys, dependencies, alignment, classes, readers and sinks."""

import json

import pytest

from graphtables.functions import values
from graphtables.operators import answers, benchmarks, dependencies, edges, entities, items, profile
from graphtables.plans import alignment, classes
from graphtables.plans.graph import Edge, PropertyGraph
from graphtables.plans.schema import Proposal, Relation
from graphtables.sources import shared, sinks, tables
from pyspark.sql import functions as F

CELL = "item long, table string, row long, place int, column string, value string, kind string"


def cells(spark, rows):
    return spark.createDataFrame([(1, t, r, p, c, v, "boolean" if v in ("true", "false") else "text") for t, r, p, c, v in rows], CELL)


def test_items_of_all_forms(spark, tmp_path):
    doc = [
        {"id_": 3, "Question": "Q?", "SQL": "select", "table_names": ["T", "U"], "primary_keys": ["A, B"], "tables": [{"table_columns": ["A", "a", "B"], "table_content": [["1", True, None], [2.5, False]]}, {"table_columns": ["x"], "table_content": []}], "answer": {"columns": ["c"], "data": [[5], ["x"]]}},
        {"id_": 4, "question": "own", "qa_pairs": [{"Question": "p", "SQL": "s", "answer": ["a", 1, True, None], "source_item_id": 9}, {"question": "", "answer": None}], "source_item_ids": [9, 8], "descriptions": {"T": "text"}},
        {"id_": 5, "question": "none", "answer": True},
    ]
    (tmp_path / "a.json").write_text(json.dumps(doc))
    (tmp_path / "b.json").write_text(json.dumps({"id_": 9, "question": "single", "answer": None}))
    found = tables.items(spark, str(tmp_path))
    rows = {r.id_: r for r in found.collect()}
    assert [(rows[i].question, rows[i].sql, rows[i].answer, rows[i].is_merged, rows[i].ordinal) for i in (3, 4, 5, 9)] == [("Q?", "select", "5, x", False, 0), ("p", "s", "a, 1, True, None", True, 1), ("none", "", "True", False, 2), ("single", "", "", False, 0)]
    assert rows[4].source_item_ids == [9, 8] and json.loads(rows[4].descriptions) == {"T": "text"} and rows[4].qa_pairs[0].source_item_id == 9 and rows[4].qa_pairs[1].original_answer == ""
    assert sorted((r.number, r.question, r.sql, r.answer) for r in tables.item_questions(found.where("id_ = 4")).collect()) == [(0, "p", "s", "a, 1, True, None"), (1, "p", "s", "")]
    assert sorted((r.row, r.place, r["column"], r.value, r.kind) for r in tables.item_rows(found).collect()) == [(0, 0, "A", "1", "text"), (0, 1, "a", "true", "boolean"), (0, 2, "B", None, "null"), (1, 0, "A", "2.5", "number"), (1, 1, "a", "false", "boolean"), (1, 2, "B", None, "null")]
    assert sorted((r.table, r.place, r["column"]) for r in tables.item_keys(found).collect()) == [("T", 0, "A"), ("T", 1, "B")]
    assert [r.id_ for r in tables.items(spark, str(tmp_path), most=2).orderBy("id_").collect()] == [3, 4]
    assert [r.id_ for r in tables.items(spark, str(tmp_path / "a.json"), start=1, end=2).collect()] == [4]
    assert {r.id_ for r in tables.sampled_items(found, 2, 7).collect()} == {r.id_ for r in tables.sampled_items(found.repartition(3), 2, 7).collect()}


def test_types_and_typed_cells(spark):
    rows = [("T", 0, 0, "A", "1"), ("T", 1, 0, "A", "2.0"), ("T", 0, 1, "a", "x"), ("T", 0, 2, "B", "true"), ("T", 1, 2, "B", None), ("T", 0, 3, "C", "2020-01-01"), ("T", 1, 3, "C", " "), ("T", 0, 4, "D", "1.5"), ("T", 0, 5, "E", None), ("T", 0, 6, "F", "true"), ("T", 1, 6, "F", "no")]
    clean = items.normalised(cells(spark, rows))
    types = items.column_types(clean)
    assert {r["column"]: (r.type, r.n, r.nulls) for r in types.collect()} == {"a": ("INT64", 2, 0), "b": ("BOOL", 2, 1), "c": ("DATE", 2, 1), "d": ("DOUBLE", 1, 0), "e": ("STRING", 1, 1), "f": ("STRING", 2, 0)}
    got = {(r["column"], r.row): (r.as_long, r.as_double, str(r.as_date), r.as_bool) for r in items.typed_cells(clean, types).collect()}
    assert got[("a", 1)] == (2, None, "None", None) and got[("b", 0)][3] is True and got[("b", 1)][3] is None and got[("c", 0)][2] == "2020-01-01" and got[("d", 0)][1] == 1.5
    forced = items.typed_cells(clean, types.withColumn("type", F.when(F.col("column") == "f", "BOOL").when(F.col("column") == "c", "INT64").otherwise("STRING")))
    got = {(r["column"], r.row): (r.as_long, r.as_bool) for r in forced.collect()}
    assert got[("f", 1)] == (None, False) and got[("c", 0)] == (0, None) and got[("c", 1)] == (None, None)


def test_entities_of_items(spark):
    rows = [("T", r, 0, "k", v) for r, v in enumerate(["a", "b", "a", None])] + [("T", r, 1, "p", v) for r, v in enumerate([None, "x", "late", "z"])] + [("U", r, 0, "K", "a") for r in (9, 10)] + [("U", 9, 1, "q", "nine"), ("U", 10, 1, "q", "ten"), ("U", 9, 2, "p", "other")]
    found = items.normalised(cells(spark, rows))
    keys = spark.createDataFrame([(1, "T", 0, "K"), (1, "U", 0, "k")], "item long, table string, place int, column string")
    ids = items.row_keys(found, keys)
    assert sorted((r.table, r.row, r.id) for r in ids.collect()) == [("T", 0, "a"), ("T", 1, "b"), ("T", 2, "a"), ("U", 9, "a"), ("U", 10, "a")]
    assert {(r.table, r["column"]): r.conflicting for r in items.key_conflicts(found, ids).collect()} == {("T", "k"): False, ("T", "p"): True, ("U", "k"): False, ("U", "p"): False, ("U", "q"): True}
    of = spark.createDataFrame([(1, "T", "E", 0), (1, "U", "E", 1)], "item long, table string, entity string, rank int")
    assert {(r.id, r["column"]): r.value for r in items.resolved_cells(found, ids, of).collect()} == {("a", "k"): "a", ("b", "k"): "b", ("a", "p"): "late", ("b", "p"): "x", ("a", "q"): "nine"}
    assert items.typed_items(found.limit(0), keys).count() == 0


def test_cells_keep_their_parts(spark):
    """Spark merged the shuffles of cells and keys until a task had 64 MB of compressed rows to sort."""
    rows = [("T", r, p, c, v) for r in range(40) for p, c, v in ((0, "k", str(r % 7)), (1, "p", "x"), (2, "q", str(r)))]
    found = items.normalised(cells(spark, rows))
    ids = items.row_keys(found, spark.createDataFrame([(1, "T", 0, "k")], "item long, table string, place int, column string"))
    dealt = items.identified(found, ids.hint("shuffle_hash"))
    assert dealt.count() == 120 and dealt.rdd.getNumPartitions() == shared.parts(spark, 120) == 4
    assert {r["column"]: r.conflicting for r in items.key_conflicts(found, ids).collect()} == {"k": False, "p": False, "q": True}
    assert [shared.parts(spark, n) for n in (0, 2_000_000, 19_000_001, 10**10)] == [4, 10, 96, 200] and shared.parts(spark, 30_000_000) == 200


def test_typed_entities_are_made_once(spark):
    """every cell was resolved twice, once for the types and once for the values, and looked up again for its kind."""
    rows = [("T", r, p, c, v) for r in range(30) for p, c, v in ((0, "k", str(r % 5)), (1, "b", "true" if r % 5 else None), (2, "n", None if r < 7 else str(r)))]
    keys = spark.createDataFrame([(1, "T", 0, "k")], "item long, table string, place int, column string")
    out = items.typed_items(cells(spark, rows), keys)
    assert "ObjectHashAggregate" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "SortMergeJoin [item" not in plan and plan.count("/entities-") <= 2
    got = {(r.id, r["column"]): (r.type, r.as_long, r.as_bool) for r in out.collect()}
    assert got == {(str(k), "k"): ("INT64", k, None) for k in range(5)} | {(str(k), "b"): ("BOOL", None, True) for k in range(1, 5)} | {(str(k), "n"): ("INT64", k + (10 if k < 2 else 5), None) for k in range(5)}


def test_row_order_is_numeric(spark):
    rows = spark.createDataFrame([("k", 9, "early"), ("k", 10, "late")], "id string, row long, p string")
    part = entities.fragments(rows, entities.Cluster("t", "c", ["id"], {"p": ["p"], "q": ["no_such"], "row": []}), F.col("row"))
    assert tuple(entities.resolved([part]).select("p", "q", "row").first()) == ("early", None, "9")
    assert [tuple(r) for r in entities.lineage([(entities.Cluster("t", "c", ["id"]), part)]).orderBy("row").collect()] == [("k", "t", "10", "c", "id"), ("k", "t", "9", "c", "id")]


def test_edges_have_an_identity(spark):
    rows = spark.createDataFrame([("a", "b", 1, 9), ("a", "b", 1, 10), ("a", "b", 2, 3), ("a", "b", None, 4), ("a", " ", 5, 5)], "s string, t string, p int, row long")
    one = edges.traced_edges(rows, "T", "row", ["s"], ["t"], {"p": "p"})
    two = edges.traced_edges(rows.where("row = 10").withColumn("row", F.lit(9)), "U", "row", ["s"], ["t"], {"p": "p"})
    got = sorted((r.edge_id, r.p, r.copies) for r in edges.unique_edges([one, two], "r").collect())
    assert got == [("a|r|b|T|3", 2, 1), ("a|r|b|T|4", None, 1), ("a|r|b|T|9", 1, 3)]
    g = PropertyGraph({"A": spark.createDataFrame([("a",)], "id string"), "B": lambda: spark.createDataFrame([("b",)], "id string")}, {"r": Edge(lambda: edges.unique_edges([one, two], "r"), "A", "B"), "bare": Edge(one.select("src", "dst"), "A", "B")})
    pairs = g.match("b", "B", unique_edges=True).into("b", "r", "x", edge=("p",), rel="e").into("b", "r", "y", edge=("p",), rel="f")
    assert pairs.rows.count() == 6 and g.match("b", "B").into("b", "r", "x").into("b", "r", "y").rows.count() == 9
    assert {"e_p", "f_p", "e_id", "f_id"} <= set(pairs.rows.columns) and pairs.types == {"e": "r", "f": "r"}
    assert g.match("b", "B", unique_edges=True).into("b", "r", "x").into("b", "r", "y").rows.count() == 6
    with pytest.raises(ValueError):
        g.match("b", "B").into("b", "r", "x", edge=("p",)).into("b", "r", "y", edge=("p",))
    with pytest.raises(ValueError):
        g.match("b", "B", unique_edges=True).into("b", "bare", "x")
    assert sorted(tuple(r) for r in g.absent(["A", "C"], ["r", "s"]).collect()) == [("edge", "s"), ("node", "C")]
    assert sinks.graph_report(g)["edges"]["r"] == {"instances": 3, "source": "A", "target": "B", "properties": ["p", "table", "row", "copies"]}


def test_frontier_and_filters_by_variable(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 3)], "src int, dst int")
    g = PropertyGraph({"N": spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, x string")}, {"r": Edge(e, "N", "N")})
    m = g.match("a", "N").out("a", "r", "a_x").frontier("a")
    assert m.rows.columns == ["a_id"] and m.rows.count() == 2
    pairs = g.match("a", "N").out("a", "r", "b")
    some = g.match("a", "N").out("a", "r", "b").where("b_id = 3")
    assert sorted((r.a_id, r.b_id) for r in pairs.without(some, "a", "b").rows.collect()) == [(1, 2)]
    assert pairs.having(some, "a", "b").rows.count() == 2
    with pytest.raises(ValueError):
        pairs.having(g.match("c", "N"), "a")
    with pytest.raises(ValueError):
        pairs.join(g.match("c", "N"))


def test_bindings_keep_their_parts(spark):
    """Spark merged the shuffles of whole edge tables until a task had 64 MB of compressed rows to sort and tell apart."""
    e = spark.range(60).selectExpr("id % 9 AS src", "id % 5 AS dst")
    g = PropertyGraph({"N": spark.range(9).toDF("id")}, {"r": Edge(e, "N", "N")})
    m = g.match("a", "N").dealt("a", 60)
    m = m._with(m.rows.hint("merge")).out("a", "r", "b").frontier("a", "b")
    assert m.rows.count() == 45 and m.rows.rdd.getNumPartitions() == 4


def test_graphs_describe_and_check_themselves(spark):
    g = PropertyGraph({"N": spark.createDataFrame([(1, "x", 5), (2, None, 6)], "id int, x string, y int")}, {"r": Edge(spark.createDataFrame([(1, 2, "p")], "src int, dst int, p string"), "N", "N")})
    assert g.described() == ["(N {id int, x string, y int})", "(N)-[r {p string}]->(N)"]
    assert g.described(2)[0] == "(N {id int (1, 2), x string (x), y int (5, 6)})"
    assert g.node_problems("M") == ["unknown label M"] and g.node_problems("N", ("x", "z"), ("x", "y")) == ["N has no property z", "N.y is int, no text"]
    assert [tuple(r) for r in g.anchors("N", [("r", False)], "x").collect()] == [(2, "x")] and g.anchors("N", [("r", True)], "x").count() == 0


def test_inclusions_and_references(spark):
    rows = [("child", r, 0, "parent_id", v) for r, v in enumerate(["1", "2.0", " 2", None])] + [("parent", r, 0, "id", v) for r, v in enumerate(["01", "2", "3"])] + [("other", r, 0, "x", v) for r, v in enumerate(["1", "2", "2"])] + [("empty", 0, 0, "y", None)]
    found = cells(spark, rows)
    got = {(r.table, r.to_table): (r.different, r.to_different, r.shared, r.unique) for r in dependencies.inclusions(found).collect()}
    assert got == {("child", "parent"): (2, 3, 2, True), ("child", "other"): (2, 2, 2, False), ("other", "child"): (2, 2, 2, False), ("other", "parent"): (2, 3, 2, True)}
    assert {(r.table, r.to_table) for r in dependencies.inclusions(found, 0.6).collect()} == {*got, ("parent", "child"), ("parent", "other")}
    assert [tuple(r) for r in dependencies.likely_references(dependencies.inclusions(found)).collect()] == [(1, "child", "parent_id", "parent", "id")]
    declared = spark.createDataFrame([(1, "CHILD", "Parent_ID", "Parent", "ID"), (1, "child", "no", "parent", "id"), (1, "child", "parent_id", "no", "id"), (1, "child", "parent_id", "parent", "no")], "item long, table string, column string, to_table string, to_column string")
    checked = dependencies.checked_references(declared, found)
    assert sorted((r.table, r["column"], r.to_table, r.to_column, r.problem or "") for r in checked.collect()) == [("child", "no", "parent", "id", "column"), ("child", "parent_id", "no", "id", "to_table"), ("child", "parent_id", "parent", "id", ""), ("child", "parent_id", "parent", "no", "to_column")]
    meanings = dependencies.understood(found, spark.createDataFrame([(1, "PARENT", "ID", "", "", " PRIMARY_KEY ")], "item long, table string, column string, description string, semantic_type string, identifier_kind string"))
    assert {r["column"]: (r.identifier_kind, r.semantic_type, len(r.samples)) for r in meanings.collect()} == {"id": ("primary_key", "categorical", 3), "parent_id": ("", "categorical", 3), "x": ("", "categorical", 2), "y": ("", "categorical", 0)}
    clusters = spark.createDataFrame([(1, "child", 0, "parent_id", True), (1, "child", 1, "parent_id", False)], "item long, table string, place int, column string, keyed boolean")
    asked = spark.createDataFrame([(1, "t", "c", "parent", "id"), (1, "t", "c", "child", "parent_id"), (1, "t", "c", "other", "x"), (1, "t", "c", "no", "x")], "item long, table string, column string, to_table string, to_column string")
    assert {r.to_table: r.kind for r in dependencies.target_kinds(asked, meanings, clusters).collect()} == {"parent": "primary_key", "child": "primary_key", "other": "descriptive", "no": "unknown"}
    assert dependencies.inclusions(found.limit(0)).count() == 0


def test_property_alignment(spark):
    schema = "item int, name string, place int, columns array<string>, description string, samples array<string>, role boolean"
    known = spark.createDataFrame([(1, "student_id", 0, ["stu_nr"], "the number of a student", ["1", "2"], False), (1, "city", 1, ["town"], "", [], False), (1, "city_name", 2, ["town"], "", [], False)], schema)
    new = spark.createDataFrame([(1, "studentNo", 0, ["studentID"], "number of the student", ["2", "1"], False), (1, "CITY", 1, ["c"], "", None, False), (1, "zip", 2, ["zip"], "", [], False), (1, "town_city", 3, ["town"], None, [], False), (1, "student_key", 4, ["stu_nr"], "", [], True)], schema)
    got = {r.name: (r.aligned, r.score) for r in alignment.property_alignment(new, known).collect()}
    assert got == {"studentNo": ("student_id", 1.0), "CITY": ("city", None), "zip": (None, None), "town_city": ("city", 0.65), "student_key": (None, None)}
    one = spark.range(1)
    say = lambda c: one.select(c.alias("x")).first().x
    assert say(alignment.snake(F.lit("HTTPServerID"))) == "http_server_id" and say(alignment.without_table(F.lit("dept_department_id"), F.lit("dept_registry"))) == "id" and say(alignment.without_table(F.lit("dept"), F.lit("dept"))) == "dept"
    assert say(alignment.similarity_of_words(F.array(F.lit("cust"), F.lit("name")), F.array(F.lit("customer"), F.lit("custom")))) == 0.5
    assert say(alignment.similarity_of_words(F.array(F.lit("ab")), F.array(F.lit("abc")))) == 0.0


def test_classes_by_decisions():
    clusters = [Proposal("t", "a", "Person", ("id",), ("name",)), Proposal("u", "b", "Human", ("nr",), ("full", "age")), Proposal("u", "c", "Person", ("pid",)), Proposal("v", "d", "Dog", ("x",))]
    decisions = {("u", "b"): classes.Decision("merge", "person", names={"nr": "id", "full": "name"}), ("v", "d"): classes.Decision("merge", "cat"), ("t", "a"): classes.Decision("shape")}
    details = {"t.name": classes.Property("name", samples=("x",)), "u.full": classes.Property("full", description="a name", samples=("x", "y"))}
    found, of, issues = classes.decided(clusters, decisions, details)
    assert [(c.name, c.key) for c in found] == [("Person", ("id",)), ("Dog", ("x",))] and len(issues) == 3
    name = next(p for p in found[0].properties if p.name == "name")
    assert name.sources == ("t.name", "u.full") and name.description == "a name" and name.samples == ("x", "y")
    assert of[("u", "c")] == "Person" and classes.unmapped(clusters, found, of) == [] and len(classes.unmapped([*clusters, Proposal("w", "e", "E", ("k",))], found[:1], of)) == 2
    profiles = {"t.name": classes.Property("name", description=" of  t ", semantic_type="text", samples=("1",)), "u.full": classes.Property("full", samples=("1", "2"))}
    best = classes.resolved_property(found[0], name, profiles)
    assert (best.description, best.semantic_type, best.samples) == ("of t", "text", ("1", "2"))
    assert classes.resolved_property(found[0], classes.Property("z"), {}).description == "Canonical entity property."
    assert classes.sound_columns(Relation("t", "a", "b", "r", ("P", "p", "q", "z")), {"p": ("a",), "q": ("a", "c")}) == (("p",), ["t: q of r depends on c", "t: z is no relation property"])
    parts, kept = classes.reassigned([Proposal("t", "a", "A", ("k",), ())], {"p": ("a",), "q": ("a", "b"), "z": ()}, "t")
    assert parts[0].columns == ("k", "p") and kept == {"q": ("a", "b")}
    pair = lambda label, n: (Relation("t", "a", "b", label), n)
    assert len(classes.first_relations([pair("r", "1:n"), pair("R ", "1:N"), pair("r", "n:n")])) == 2
    assert classes.invariants([classes.EntityClass("", ()), classes.EntityClass("A", (), (classes.Property("x"), classes.Property("X")))], [("A", "r", "B", ("p", "P"))]) == ["a class has no name", "A repeats a property", "r refers to the unknown class B", "r repeats a property"]


def test_values_profiles_and_answers(spark):
    df = spark.createDataFrame([("a_1", "Yes"), ("1a", "no"), (None, " "), ("a b", None)], "n string, b string")
    assert [(r.i, r.t) for r in df.select(values.is_identifier(F.col("n")).alias("i"), values.truth(F.col("b")).alias("t")).collect()] == [(True, True), (False, False), (False, None), (False, None)]
    got = profile.typed(spark.createDataFrame([("1", "y", "x", "2.5"), (" ", None, "2020-01-01", "z")], "A string, b string, c string, d string"), {"a": "INT64", "B": "BOOL", "c": "DATE", "d": "DOUBLE"})
    assert [tuple(map(str, r)) for r in got.collect()] == [("1", "True", "None", "2.5"), ("None", "None", "2020-01-01", "0.0")]
    rows = spark.createDataFrame([(k, str(k)) for k in range(9)], "k int, v string")
    assert profile.seeded_rows(rows, "t", "k").collect() == profile.seeded_rows(rows.repartition(4), "t", "k").collect() and profile.seeded_rows(rows.limit(2), "t", "k").count() == 2
    one = spark.createDataFrame([("q", "a"), ("q", "b"), ("r", "c"), ("s", "(no result)")], "id string, answer string")
    two = spark.createDataFrame([("q", "1"), ("q", "2"), ("s", "1"), ("t", "3")], "id string, answer string")
    got = sorted(tuple(r) for r in answers.products([one, two], ["id"]).collect())
    assert got == [("q", "a; 1"), ("q", "a; 2"), ("q", "b; 1"), ("q", "b; 2"), ("r", "(no result)"), ("s", "(no result)"), ("t", "(no result)")]


def test_name_mapping_is_one_to_one(spark):
    columns = spark.createDataFrame([("a", "x", 0), ("a", "y", 1), ("b", "z", 0), ("c", "w", 0)], "table string, column string, place int")
    proposed = spark.createDataFrame([("a", "x", "alpha", "one"), ("a", "y", "alpha", "two"), ("b", "z", "table1", "Z"), ("c", "w", "Table1", "new")], "table string, column string, new_table string, new_column string")
    got = {(r.table, r["column"]): (r.new_table, r.new_column, r.given) for r in benchmarks.name_mapping(columns, proposed).collect()}
    assert got == {("a", "x"): ("alpha", "one", True), ("a", "y"): ("alpha", "two", True), ("b", "z"): ("table2", "col1", False), ("c", "w"): ("Table1", "new", True)}
    assert {r.new_table for r in benchmarks.name_mapping(columns).collect()} == {"table1", "table2", "table3"}


def test_documents_and_logs(spark, tmp_path):
    (tmp_path / "i.json").write_text(json.dumps({"entities": {"A": [{"id": "1", "n": 2}, {"id": "2"}]}, "relations": {"r": [{"from": "1", "to": "2"}]}}))
    found = tables.instances(spark, str(tmp_path / "i.json"))
    assert [tuple(r) for r in tables.instance_table(found, "entity", "A").orderBy("place").collect()] == [(0, "1", "2"), (1, "2", None)]
    assert tables.instance_table(found, "relation", "r").columns == ["place", "from", "to"]
    (tmp_path / "s.yaml").write_text("a: {b: 1, c: 2}\n")
    assert tables.merged_settings(tables.settings(spark, str(tmp_path / "s.yaml")), {"a": {"c": 3}, "d": 4}) == {"a": {"b": 1, "c": 3}, "d": 4}
    refs = spark.createDataFrame([("c", "p", "d", "k")], "table string, column string, to_table string, to_column string")
    doc = sinks.key_relations(refs, {"d": ["k"]})
    sinks.write_document(spark, doc, str(tmp_path / "keys"))
    assert json.loads(spark.read.text(str(tmp_path / "keys")).first().value) == {"d": {"primary_keys": ["k"], "foreign_keys": []}, "c": {"primary_keys": [], "foreign_keys": [{"column": "p", "references": "d.k"}]}}
    sinks.write_rows(refs, str(tmp_path / "rows"), by="table")
    assert spark.read.json(str(tmp_path / "rows")).count() == 1
    log = str(tmp_path / "log")
    for rows in ([(1, "a"), (1, "b"), (None, "c")], [(1, "z"), (2, "d"), (None, "e")]):
        sinks.append_new(spark.createDataFrame(rows, "k int, v string"), log, "k")
    assert sorted((str(r.k), r.v) for r in spark.read.parquet(log).collect()) == [("1", "a"), ("2", "d"), ("None", "c")]
    assert not sinks.exists(spark, str(tmp_path / "nothing"))


def test_inclusions_write_a_row_a_set_of_columns(spark, monkeypatch):
    """130 columns take three words of bits; what is written before sets are taken apart is a row a set, not a row a value."""
    written = {}
    save = dependencies.saved
    monkeypatch.setattr(dependencies, "saved", lambda df, label: written.setdefault(label, save(df, label)))
    values = {k: [str(v) for v in range(k % 3, 300)] for k in range(130)}
    values[5] = ["+7", " 07 ", "8.0", "", "-0"]
    found = spark.createDataFrame([(1, "t", r, k, f"c{k:03d}", v, "text") for k, vs in values.items() for r, v in enumerate(vs)], "item int, table string, row long, place int, column string, value string, kind string")
    rows = dependencies.inclusions(found)
    plain = {k: set(vs) for k, vs in values.items()} | {5: {"7", "8", "-0"}}
    want = {(f"c{a:03d}", f"c{b:03d}", len(plain[a])) for a in plain for b in plain if a != b and plain[a] <= plain[b]}
    assert {(r["column"], r.to_column, r.shared) for r in rows.collect()} == want
    assert {r.to_column: r.unique for r in rows.collect()} == {c: True for _, c, _ in want}
    assert written["inclusions-sets"].count() < 10


def test_samples_rank_few_values(spark, monkeypatch):
    """The samples are those of the least hashes, and all but a few values are left out before they are told apart."""
    from hashlib import md5

    bounds = {}
    save = dependencies.saved
    monkeypatch.setattr(dependencies, "saved", lambda df, label: bounds.setdefault(label, save(df, label)))
    found = spark.range(20000).selectExpr("1 AS item", "'t' AS table", "id AS row", "0 AS place", "'c' AS column", "cast(id % 5000 AS string) AS value", "'text' AS kind")
    got = dependencies.understood(found, samples=4).first()
    digest = lambda v: md5(f"42:t:c:{v}".encode()).hexdigest()
    assert got.samples == sorted(map(str, range(5000)), key=digest)[:4] and got.type == "INT64" and got.n == 20000
    most = bounds["samples-bounds"].first()["_most"]
    assert 4 <= sum(int(digest(v)[:15], 16) <= most for v in range(5000)) < 50
