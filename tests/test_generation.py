"""Generated data: ranks, draws, stubs, hierarchies, denormalised tables, questions."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from graphtables.operators import denormalise, generation, questions
from graphtables.operators.generation import Bounds, Kind
from graphtables.plans.graph import Edge, PropertyGraph


def test_ranks_of_a_hot_scope_are_gapless(spark):
    rows = spark.range(3000).withColumn("s", F.when(F.col("id") < 2900, "hot").when(F.col("id") < 2999, "small"))
    got = generation.ranked(rows, ["s"], generation.seeded(1, "id"), "id", major=F.col("id") % 3).groupBy("s").agg(F.sort_array(F.collect_list("rank")).alias("r"), F.count("*").alias("n")).collect()
    assert all(r.r == list(range(r.n)) for r in got) and {r.s for r in got} == {"hot", "small", None}
    first = generation.ranked(rows, ["s"], generation.seeded(1, "id"), "id", major=F.col("id") % 3).where("s = 'hot' AND rank < 900").select((F.col("id") % 3).alias("m")).distinct().collect()
    assert [r.m for r in first] == [0]


def test_draws_without_replacement(spark):
    rows = spark.range(40).withColumn("s", F.col("id") % 4)
    values = generation.listed(spark, {"name": [f"n{k}" for k in range(12)], "code": list(range(12))})
    got = generation.unique_draws(rows, "id", values, 3, ["s"]).collect()
    assert len(got) == 40 and all(r.name == f"n{r.code}" for r in got) and max(Counter((r.s, r.code) for r in got).values()) == 1
    assert sorted(map(tuple, got)) == sorted(map(tuple, generation.unique_draws(rows.repartition(5), "id", values, 3, ["s"]).collect()))
    with pytest.raises(ValueError):
        generation.unique_draws(rows, "id", values, 3)
    assert generation.unique_draws(rows.where("id < 12"), "id", values, 3).select("code").distinct().count() == 12
    with pytest.raises(ValueError):
        generation.listed(spark, {"a": [1], "b": []})


def test_properties_are_typed_and_in_range(spark):
    specs = {"i": {"type": "integer", "range": [3, 5]}, "f": {"type": "float", "range": [0, 1], "decimals": 1}, "b": {"type": "boolean"}, "d": {"type": "date", "range": ["2020-01-30", "2020-02-02"]}, "v": {"values": ["x"]}, "t": {"template": "{v}-{id}!"}, "s": {}}
    rows = generation.drawn_properties(spark.range(200), "id", specs, 1).collect()
    assert {r.i for r in rows} == {3, 4, 5} and {r.b for r in rows} == {True, False} and len({r.d for r in rows}) == 4 and {r.f for r in rows} == {k / 10 for k in range(11)}
    assert rows[7].t == f"x-{rows[7].id}!" and rows[7].s == f"s_{rows[7].id}"
    for bad in ({"x": {"type": "odd"}}, {"x": {"values": []}}, {"x": {"type": "integer", "range": [2, 1]}}):
        with pytest.raises(ValueError):
            generation.drawn_properties(spark.range(1), "id", bad, 1)


@pytest.mark.parametrize(
    ("sources", "targets", "bounds"),
    [
        ([(k, 0) for k in range(50)], [(k, 0) for k in range(7)], Bounds(1, 4, 5, 30)),
        ([(k, k % 2) for k in range(30)], [(k, k % 2) for k in range(8)], Bounds(4, 4, 0, None)),  # every pair
        ([(k, 0) for k in range(9)], [(k, 0) for k in range(9)], Bounds(3, 3, 3, 3)),
        ([(k, 0) for k in range(40)], [(k, 0) for k in range(3)], Bounds(0, None, 10, 25)),
        ([(k, 0) for k in range(5)] + [(9, 1)], [(k, 0) for k in range(20)] + [(99, 2)], Bounds(0, 8, 0, 3)),
    ],
)
def test_stubs_keep_all_bounds(spark, sources, targets, bounds):
    s, t = (spark.createDataFrame(x, "id int, anchor int") for x in (sources, targets))
    got = generation.edges_by_stubs(s, t, bounds, 5)
    assert generation.degree_problems(got, s, t, bounds).count() == 0 and got.count() > 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, generation.edges_by_stubs(s.repartition(3), t, bounds, 5).collect()))


def test_stubs_of_few_targets_take_no_rounds(spark):
    """Two of five targets each: neighbours' rounds meet often, which took rounds of swaps over all edges, 159 jobs in all."""
    s, t = (spark.createDataFrame([(k, 0) for k in range(n)], "id int, anchor int") for n in (600, 5))
    spark.sparkContext.setJobGroup("few targets", "")
    try:
        got = generation.edges_by_stubs(s, t, Bounds(2, 2, 120, 480), 11)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("few targets")) <= 80
    assert generation.degree_problems(got, s, t, Bounds(2, 2, 120, 480)).count() == 0
    rows = got.collect()
    own = {k: frozenset(r.dst for r in rows if r.src == k) for k in range(600)}
    assert len(rows) == 1200 and len(set(own.values())) == 10 and len(set(Counter(r.dst for r in rows).values())) > 1  # all choices, unlike degrees


@pytest.mark.parametrize("bounds", [Bounds(1, 3, 1, None), Bounds(0, None, 0, None), Bounds(2, 2, 1, 12), Bounds(0, 3, 6, 6), Bounds(1, 2, 5, 9)])
def test_stubs_deal_whatever_the_numbers_of_ends(spark, bounds):
    t = [(100 * a + k, a) for a in range(3, 14) for k in range(a)]
    s = [(100 * a + k, a) for a in range(3, 14) for k in range(5 * a + a % 4)]
    s, t = (spark.createDataFrame(x, "id int, anchor int") for x in (s, t))
    got = generation.edges_by_stubs(s, t, bounds, 3)
    assert generation.degree_problems(got, s, t, bounds).count() == 0 and got.select("dst").distinct().count() == t.count()


@pytest.mark.parametrize(("degree", "n"), [(1, 30), (2, 41), (5, 9), (7, 6)])
def test_blocks_keep_degrees_equal_where_bounds_leave_no_room(spark, degree, n):
    targets = spark.createDataFrame([(k, 0) for k in range(7)], "id int, anchor int")
    begun = spark.createDataFrame([(0, k, degree, k * degree) for k in range(n)], "anchor int, id int, degree long, begin long")
    least, most = n * degree // 7, -(-n * degree // 7)
    totals = spark.createDataFrame([(0, n * degree, 7, most)], "anchor int, total long, t long, most_in long")
    rows = generation.dealt(begun, targets, totals, Bounds(degree, degree, least, most), 2).collect()
    assert len(set(rows)) == len(rows) == n * degree and set(Counter(r.dst for r in rows).values()) <= {least, most}


def test_ranks_add_up_weights(spark):
    rows = spark.range(500).withColumns({"s": F.col("id") % 2, "w": F.col("id") % 5})
    got = generation.ranked(rows, ["s"], generation.seeded(1, "id"), "id", "before", weight="w").collect()
    for s in (0, 1):
        at = 0
        for r in sorted((r for r in got if r.s == s), key=lambda r: (r.before, r.before + r.w)):
            assert r.before == at
            at += r.w
        assert at == 500


def test_stubs_refuse_what_cannot_be(spark):
    s, t = (spark.createDataFrame([(k, 0) for k in range(n)], "id int, anchor int") for n in (4, 3))
    for bounds in (Bounds(4, 4), Bounds(0, 1, 2, None), Bounds(2, 2, 0, 1)):
        with pytest.raises(ValueError):
            generation.edges_by_stubs(s, t, bounds, 1)
    with pytest.raises(ValueError):
        generation.edges_by_stubs(s.union(s.withColumn("anchor", F.lit(1))), t, Bounds(1, 1), 1)
    bad = spark.createDataFrame([(0, 0), (0, 0), (1, 7)], "src int, dst int")
    assert {r.problem for r in generation.degree_problems(bad, s, t, Bounds(1, 1, 0, 1)).collect()} == {"repeated edge", "different anchors", "src below its least", "src above its most", "dst above its most"}


def test_collisions_are_swapped_away(spark):
    rows = [(0, k, k // 4, k % 3) for k in range(24)]
    edges = spark.createDataFrame(rows, "anchor int, at long, src int, dst int")
    got = generation.swapped(edges.withColumn("dst", F.when(F.col("at") == 1, 0).otherwise(F.col("dst") + 3 * (F.col("at") % 4))), 1, 30).collect()
    assert max(Counter((r.src, r.dst) for r in got).values()) == 1 and Counter(r.src for r in got) == Counter(r[2] for r in rows)


def test_hierarchies(spark):
    plants = Kind(spark.createDataFrame([("p1",), ("p2",), (None,)], "name string"), "name")
    lines = Kind(spark.createDataFrame([("l", "p1"), ("l", "p2"), ("m", "p1"), ("m", "p1")], "line string, parent_Plant string"), "line", "Plant")
    machines = Kind(spark.createDataFrame([("x1", "l", "p2"), ("x2", "q", "p1")], "id string, parent_Line string, parent_Plant string"), "id", "Line")
    kinds = {"Plant": plants, "Line": lines, "Machine": machines}
    keys = generation.natural_keys(kinds)
    assert {k: sorted(r.key for r in df.collect()) for k, df in keys.items()} == {"Plant": ["p1", "p2"], "Line": ["l|p1", "l|p2", "m|p1"], "Machine": ["x1", "x2"]}
    edges = generation.parent_edges(kinds)
    assert sorted(map(tuple, edges["Machine"].collect())) == [("l|p2", "x1"), ("q|p1", "x2")] and edges["Line"].count() == 3
    assert [tuple(r) for r in generation.orphans(kinds).collect()] == [("Machine", "x2", "q|p1")]
    refs = spark.createDataFrame([("x1",), ("z",)], "v string")
    assert {r.v: r.key for r in generation.bare_references(kinds, "Machine", refs, "v").collect()} == {"x1": "x1", "z": None}
    with pytest.raises(ValueError):
        generation.bare_references(kinds, "Line", refs, "v")
    with pytest.raises(ValueError):
        generation.ancestors({"A": Kind(plants.rows, "name", "B"), "B": Kind(plants.rows, "name", "A")}, "A")
    kids = generation.scoped_children(plants.rows, "Plant", "name", 2, 3, 1, "line", ["a", "b", "c"]).collect()
    assert {r.parent_Plant for r in kids} == {"p1", "p2"} and max(Counter((r.parent_Plant, r.line) for r in kids).values()) == 1 and 4 <= len(kids) <= 6


def test_column_sources(spark):
    people = spark.createDataFrame([("a", "Ann"), ("b", "Bob")], "id string, name string")
    cars = spark.createDataFrame([("c", "red"), ("d", "blue")], "id string, colour string")
    owns = spark.createDataFrame([("a", "d", 2, "late"), ("a", "c", 1, "early"), ("x", "c", 0, "gone")], "src string, dst string, place int, since string")
    entities, relations = {"P": people, "C": cars}, {"owns": owns}
    columns = {"n": "entity.P.name", "colour": "relation.owns.target.C.colour", "since": "relation.owns.since", "car": "relation.owns.target.C.id", "odd": "relation.owns.target.P.name"}
    assert sorted(map(tuple, denormalise.entity_table(entities, relations, "P", columns).collect()), key=str) == [("Ann", "red", "early", "c", None), ("Bob", None, None, None, None)]
    rows = denormalise.entity_table(entities, relations, "P", columns | {"t": "target.C.colour"}, expand="owns")
    assert sorted(map(tuple, rows.select("n", "colour", "since", "t").collect()), key=str) == [("Ann", "blue", "late", "blue"), ("Ann", "red", "early", "red"), ("Bob", None, None, None)]
    back = denormalise.entity_table(entities, relations, "C", {"c": "entity.C.id", "since": "relation.owns.since", "who": "relation.owns.source.P.name"})
    assert sorted(map(tuple, back.collect()), key=str) == [("c", "gone", None), ("d", "late", "Ann")]
    edge = denormalise.relation_table(entities, relations, "owns", {"who": "source.P.name", "car": "target.C.colour", "since": "relation.owns.since"})
    assert sorted(map(tuple, edge.collect()), key=str) == [("Ann", "blue", "late"), ("Ann", "red", "early"), (None, "red", "gone")]
    for bad in ("entity.P", "relation.no.x", "relation.owns.up.C.id", "relation.owns.target.Z.id"):
        with pytest.raises(ValueError):
            denormalise.entity_table(entities, relations, "P", {"x": bad})


def small_graph(spark):
    nodes = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", "y"), (4, None, "y")], "id int, name string, kind string")
    return PropertyGraph({"N": nodes}, {"r": Edge(spark.createDataFrame([(1, 2), (1, 3), (2, 3), (3, 1), (3, 1)], "src int, dst int"), "N", "N")})


def test_questions_for_all_parameters(spark):
    g = small_graph(spark)
    out = lambda g, p: questions.bound(g, p, "a", "N", name="n").out("a", "r", "b", ("name",)).rows.select("pid", F.col("b_name").alias("answer"))
    linked = questions.Template("l", "{n} of {k}", lambda g, p: questions.bound(g, p, "a", "N", ("id",), name="n", kind="k").rows.select("pid", F.col("a_id").alias("answer")), {"n": ("N", "name")}, {"k": ("n", "kind")})
    ts = [questions.Template("t", "From {n}?", out, {"n": ("N", "name")}), questions.Template("u", "One from {n}?", out, {"n": ("N", "name")}, unique=True), linked, questions.Template("t", "All?", lambda g, p: p.select("pid", F.lit(7).alias("answer")))]
    got = questions.generated_questions(g, ts, {"t": 10, "u": 10, "l": 10}, 1).collect()
    assert {(r.kind, r.question, r.answer) for r in got} == {("t", "From a?", "b, c"), ("t", "From b?", "c"), ("t", "From c?", "a"), ("t", "All?", "7"), ("u", "One from b?", "c"), ("u", "One from c?", "a"), ("l", "a of x", "1"), ("l", "b of x", "2"), ("l", "c of y", "3")}
    two = questions.generated_questions(g, ts, {"t": 2}, 1).orderBy("number").collect()
    assert [r.number for r in two] == [1, 2] and {r.template for r in two} == {0, 3}  # templates take turns
    with pytest.raises(ValueError):
        questions.generated_questions(g, ts, {"no": 1}, 1)
    with pytest.raises(ValueError):
        questions.generated_questions(g, [questions.Template("t", "{z}", out)], {"t": 1}, 1)


def test_a_batch_goes_on_where_it_stopped(spark, tmp_path):
    g, asked = small_graph(spark), []

    def ask(name, frame):
        def run():
            asked.append(name)
            return frame()

        return questions.Question("i", name, run, "a, b, c")

    names = lambda: g.match("a", "N", ("name",)).rows.select("a_name")
    broken = lambda: g.match("a", "N").out("a", "no", "b").rows
    log = str(tmp_path / "log")
    got = {r.question: r for r in questions.question_batch(spark, [ask("q", names), ask("bad", broken)], log).collect()}
    assert got["q"].answer == "a, b, c" and got["bad"].status == "error" and "no" in got["bad"].error and got["bad"].answer is None
    got = {r.question: r.status for r in questions.question_batch(spark, [ask("q", names), ask("bad", names), ask("none", lambda: names().where("a_name = 'z'"))], log).collect()}
    assert got == {"q": "ok", "bad": "ok", "none": "ok"} and sorted(asked) == ["bad", "bad", "none", "q"]
    row = questions.batch_summary(questions.read_log(spark, log)).first()
    assert (row.item, row.questions, row.ok, row.errors, row.correct) == ("i", 3, 3, 0, 2)
    many = questions.question_batch(spark, [questions.Question("i", "many", lambda: spark.range(20))], log, most_answers=10).where("question = 'many'").first()
    assert many.status == "error" and "10" in many.error
