"""Seeded generation that scales: ranks, draws without replacement, typed properties, edges by degree stubs, natural keys."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import identifier, present
from ..sources.shared import saved


def seeded(seed: int, *columns: str | Column) -> Column:
    """A hash that only the seed and the columns decide."""
    return F.xxhash64(F.lit(seed), *columns)


def ranked(rows: DataFrame, scope: Sequence[str], by: Column, tie: str, name: str = "rank", major: Column | None = None, weight: str | None = None) -> DataFrame:
    """rows with their rank (from 0) within a scope, ordered by `major`, the hash `by`, and `tie`; with a column `weight`, the
    sum of the weights before a row stands in place of its rank.

    Rows of a scope are dealt by the hash's upper bits into 256 runs that are ranked on their own; the sums of the runs
    before, at most 256 a scope and value of `major`, are added. So a scope with a third of all rows is no single task."""
    split = F.shiftright(by, 56)
    marked = rows.withColumns({"_major": F.lit(0) if major is None else major, "_by": by, "_run": split})
    run = [*scope, "_major", "_run"]
    order = Window.partitionBy(*run).orderBy("_by", tie)
    inner = marked.withColumn("_k", F.row_number().over(order) - 1 if weight is None else F.coalesce(F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    before = Window.partitionBy(*scope).orderBy("_major", "_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = marked.groupBy(*run).agg((F.count("*") if weight is None else F.sum(weight)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    names = [f"_s{k}" for k in range(len(run))]
    keyed = sums.toDF(*names, "_before")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(run, names)]
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return inner.join(keyed, condition).withColumn(name, (F.col("_k") + F.col("_before")).cast("long")).drop("_major", "_by", "_run", "_k", "_before", *names)


def unique_draws(rows: DataFrame, key: str, values: DataFrame, seed: int, scope: Sequence[str] = ()) -> DataFrame:
    """rows with the columns of one row of `values` each, of which no two rows of a scope get the same.

    values: `position` without gaps from 0, and columns that stay aligned with each other. A scope's draw is a seeded
    permutation of the positions (an affine one, with a step that shares no factor with their number) read at the row's
    seeded rank, so a draw is a join by position. Raises if a scope has more rows than there are values."""
    n = values.count()
    fullest = rows.groupBy(*scope).count().agg(F.max("count")).first()[0] or 0
    if fullest > n:
        raise ValueError(f"{fullest} rows of a scope draw from {n} values without replacement")
    steps = sorted({a for a in (1 + k * 2654435761 % max(1, n) for k in range(2000)) if gcd(a, n) == 1}) or [1]
    salt = [F.col(c).cast("string") for c in scope]
    step = F.element_at(F.array(*map(F.lit, steps)), (F.pmod(seeded(seed, F.lit("step"), *salt), F.lit(len(steps))) + 1).cast("int")).cast("decimal(38,0)")
    place = (F.col("_rank") * step + F.pmod(seeded(seed, F.lit("shift"), *salt), F.lit(max(1, n)))) % F.lit(max(1, n))
    drawn = ranked(rows.withColumn("_all", F.lit(0)), ["_all", *scope], seeded(seed, key), key, "_rank").withColumn("_position", place.cast("long"))
    return drawn.join(values.withColumnRenamed("position", "_position"), "_position").drop("_all", "_rank", "_position")


def listed(spark: SparkSession, lists: dict[str, Sequence]) -> DataFrame:
    """Lists of one length as rows of values for a draw."""
    if len({len(v) for v in lists.values()}) != 1 or not all(lists.values()):
        raise ValueError("the lists must have one length, of at least one value")
    return spark.createDataFrame([(k, *v) for k, v in enumerate(zip(*lists.values()))], ["position", *lists])


def drawn_properties(rows: DataFrame, key: str, specs: dict[str, dict], seed: int) -> DataFrame:
    """rows with seeded properties. A spec has `values`, or a `template` with {column} places, or a `type`: integer, float
    (with `decimals`), boolean, date, each with a `range` of both ends, or string. A property may name earlier ones."""
    for name, spec in specs.items():
        draw = lambda n, name=name: F.pmod(seeded(seed, F.lit(name), key), F.lit(n))
        kind = spec.get("type", "string")
        low, high = spec.get("range", {"integer": (0, 100), "float": (0.0, 100.0), "date": ("2024-01-01", "2025-12-31")}.get(kind, (0, 0)))
        if kind != "string" and high < low:
            raise ValueError(f"the range of {name} is empty")
        if "values" in spec:
            if not spec["values"]:
                raise ValueError(f"{name} has no values")
            made = F.element_at(F.array(*map(F.lit, spec["values"])), (draw(len(spec["values"])) + 1).cast("int"))
        elif "template" in spec:
            made = F.lit("")
            for k, part in enumerate(str(spec["template"]).replace("}", "{").split("{")):
                made = F.concat(made, F.coalesce(F.col(part).cast("string"), F.lit("")) if k % 2 else F.lit(part))
        elif kind == "integer":
            made = F.lit(int(low)) + draw(int(high) - int(low) + 1)
        elif kind == "float":
            made = F.round(F.lit(float(low)) + draw(1_000_000_007) / F.lit(1_000_000_006.0) * F.lit(float(high) - float(low)), int(spec.get("decimals", 2)))
        elif kind == "boolean":
            made = draw(2) == 1
        elif kind == "date":
            made = F.date_add(F.lit(date.fromisoformat(str(low))), draw((date.fromisoformat(str(high)) - date.fromisoformat(str(low))).days + 1).cast("int"))
        elif kind == "string":
            made = F.concat(F.lit(f"{name}_"), F.col(key).cast("string"))
        else:
            raise ValueError(f"{name} has the unknown type {kind}")
        rows = rows.withColumn(name, made)
    return rows


@dataclass(frozen=True)
class Bounds:
    """Degrees allowed: of every source and of every target; no upper bound is None."""

    least_out: int = 0
    most_out: int | None = None
    least_in: int = 0
    most_in: int | None = None


def edges_by_stubs(sources: DataFrame, targets: DataFrame, bounds: Bounds, seed: int) -> DataFrame:
    """src, dst: a seeded draw of edges within each anchor (id, anchor; one anchor an id) that keeps every degree bound.

    Every source has stubs: those it must have, those of a seeded quota, and those it may have besides; an anchor takes as
    many, in this order, as its targets can hold. They are numbered through the anchor, and `dealt` gives each its target by
    arithmetic on that number, so no edge is repeated, no pair is looked at, and work grows with edges. Raises if bounds
    contradict each other in an anchor or if an id has two anchors; an anchor without targets, or sources, fails only if the
    others need edges."""
    for side, rows in (("source", sources), ("target", targets)):
        if n := rows.groupBy("id").count().where("count > 1").count():
            raise ValueError(f"{n} {side}s have several anchors or rows")
    a = sources.groupBy("anchor").agg(F.count("*").alias("s"))
    b = targets.groupBy("anchor").agg(F.count("*").alias("t"))
    both = a.join(b, "anchor", "full").fillna(0, ["s", "t"])
    most_out = F.least(F.col("t"), F.lit(bounds.most_out if bounds.most_out is not None else 2**31))
    most_in = F.least(F.col("s"), F.lit(bounds.most_in if bounds.most_in is not None else 2**31))
    both = saved(both.withColumns({"most_out": most_out, "most_in": most_in}), "stubs-anchors")
    least, most = F.greatest(F.col("s") * bounds.least_out, F.col("t") * bounds.least_in), F.least(F.col("s") * F.col("most_out"), F.col("t") * F.col("most_in"))
    if n := both.where((least > most) | ((F.col("s") > 0) & (F.col("most_out") < bounds.least_out)) | ((F.col("t") > 0) & (F.col("most_in") < bounds.least_in))).count():
        raise ValueError(f"the degree bounds cannot hold in {n} anchors")
    caps = both.select("anchor", "s", "t", "most_out", "most_in")

    span = F.col("most_out") - bounds.least_out + 1
    owned = sources.select("id", "anchor").join(caps, "anchor").where("t > 0").withColumn("quota", bounds.least_out + F.pmod(seeded(seed, "id"), span))
    wanted = owned.groupBy("anchor").agg(F.sum("quota").alias("wanted"))
    # as many edges as the quotas ask for, within what the targets must and may take
    total = F.least(F.greatest(F.col("wanted"), F.col("t") * bounds.least_in), F.col("t") * F.col("most_in"))
    totals = saved(wanted.join(caps, "anchor").select("anchor", "wanted", total.alias("total"), "t", "most_in"), "stubs-totals")
    asking = owned.join(totals.select("anchor", "wanted", "total"), "anchor")
    out = asking.where("wanted = total AND quota > 0").select("anchor", "id", F.col("quota").alias("degree"))  # quotas as they are
    # without an upper bound a source has no more stubs than twice its share or its quota
    share = F.col("most_out") if bounds.most_out is not None else F.least(F.col("most_out"), F.greatest(F.col("quota"), 2 * F.ceil(F.col("total") / F.col("s"))))
    exploded = asking.where((F.col("wanted") != F.col("total")) & (share > 0)).select("id", "anchor", "quota", "total", F.explode(F.sequence(F.lit(0), share.cast("int") - 1)).alias("k"))
    tier = F.when(F.col("k") < bounds.least_out, 0).when(F.col("k") < F.col("quota"), 1).otherwise(2)
    taken = ranked(exploded, ["anchor"], seeded(seed, F.lit("out"), "id", "k"), "id", "r", tier).where(F.col("r") < F.col("total"))
    out = out.unionByName(taken.groupBy("anchor", "id").agg(F.count("*").alias("degree")))
    begun = saved(ranked(out, ["anchor"], seeded(seed, F.lit("source"), "id"), "id", "begin", weight="degree"), "stubs-out")
    return saved(dealt(begun, targets, totals, bounds, seed), "stubs-result")


STEPS = [p for p in range(65537, 65880) if all(p % q for q in range(2, 257))][:32]  # primes; two of them divide no number below 2**32


def permutation(size: Column, *salt: str | Column) -> tuple[Column, Column]:
    """step, shift of a seeded permutation of the places below size: (place * step + shift) % size. Step and size share no factor."""
    first = F.pmod(seeded(1, *salt), F.lit(len(STEPS))).cast("int")
    one, other = (F.element_at(F.array(*map(F.lit, STEPS)), (first + k) % len(STEPS) + 1).cast("long") for k in (0, 1))
    return F.when(size % one == 0, other).otherwise(one), F.pmod(seeded(2, *salt), size)


def dealt(begun: DataFrame, targets: DataFrame, totals: DataFrame, bounds: Bounds, seed: int) -> DataFrame:
    """src, dst: a target for each stub of (anchor, id, degree, begin), where `begin` numbers a source's first stub.

    Stub p would have target p modulo their number t, in one seeded order: no source, having t stubs at most, meets a target
    twice, and all targets have equal degrees but for one. Sources that begin within one and a half rounds of the targets are
    a block, which deals its round anew: the targets that its stubs meet once more than the others come first, both in an
    order of their own, so degrees stay. For degrees that differ, as many blocks as the bounds leave room for choose at
    random whom they meet once more; each changes a degree by one at most."""
    t, total = F.col("t"), F.col("total")
    size = t + F.expr("(t + 1) div 2")
    blocks = F.expr("(total - 1) div size + 1")
    room = F.least(F.expr("total div t") - bounds.least_in, F.col("most_in") - F.expr("(total + t - 1) div t"))
    plan = totals.where(total > 0).select("anchor", "t", "total", size.alias("size"), room.alias("room")).withColumn("blocks", blocks)
    plan = plan.select("anchor", "t", "size", "blocks", F.least("room", "blocks").alias("loose"))
    marked = begun.join(plan, "anchor").withColumn("block", F.expr("begin div size"))
    loose = F.expr("(block + 1) * loose div blocks > block * loose div blocks")  # so many blocks, evenly
    met = marked.groupBy("anchor", "block", "t", "blocks", "loose").agg(F.min("begin").alias("first"), F.sum("degree").alias("n")).withColumn("more", F.when(loose, F.lit(0)).otherwise(F.col("n") % t))
    step, shift = permutation(F.greatest("more", F.lit(1)), F.lit(seed), F.lit("more"), "anchor", "block")
    rest_step, rest_shift = permutation(t - F.col("more"), F.lit(seed), F.lit("rest"), "anchor", "block")
    # tables of known size: Spark sends them to all tasks while they are small, as their keys are few and hot then
    met = saved(met.select("anchor", "block", "first", "more", step.alias("step"), shift.alias("shift"), rest_step.alias("rest_step"), rest_shift.alias("rest_shift")), "stubs-blocks")
    order = saved(ranked(targets.select("id", "anchor"), ["anchor"], seeded(seed, F.lit("cycle"), "id"), "id", "turn").select("anchor", "turn", F.col("id").alias("dst")), "stubs-order")

    stubs = marked.select("anchor", "block", "t", "id", "begin", "degree").join(met, ["anchor", "block"])
    stubs = stubs.select("*", F.explode(F.sequence(F.lit(0), F.col("degree").cast("int") - 1)).alias("k"))
    stubs = stubs.withColumn("place", (F.col("begin") - F.col("first") + F.col("k")) % t)
    place = F.expr("IF(place < more, (place * step + shift) % greatest(more, 1), more + ((place - more) * rest_step + rest_shift) % (t - more))")
    turned = stubs.select("anchor", F.col("id").alias("src"), ((F.col("first") + place) % t).alias("turn"))
    return turned.join(order, ["anchor", "turn"]).select("src", "dst")


def swapped(edges: DataFrame, seed: int, rounds: int) -> DataFrame:
    """Edges (anchor, at, src, dst; `at` without gaps) whose repetitions swapped targets with other edges of the anchor.

    Each round, every edge that repeats another asks one edge of its anchor, chosen by a hash; the swap is made if no other
    edge asks the same one, neither new edge exists, and no other swap of the round makes it too."""
    sizes = edges.groupBy("anchor").agg(F.count("*").alias("size"))
    for k in range(rounds):
        first = edges.groupBy("anchor", "src", "dst").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
        extra = edges.join(first, ["anchor", "src", "dst"]).where("at <> first").select("anchor", "at", "src", "dst")
        asked = extra.join(sizes, "anchor").withColumn("other", F.pmod(seeded(seed + k, "at", "src"), F.col("size")))
        found = asked.join(edges.select("anchor", F.col("at").alias("other"), F.col("src").alias("other_src"), F.col("dst").alias("other_dst")), ["anchor", "other"])
        found = found.where("src <> other_src AND dst <> other_dst")
        found = saved(found, "stubs-asked")
        if found.isEmpty():
            if extra.isEmpty():
                return edges
            continue
        busy = found.select("anchor", F.explode(F.array("at", "other")).alias("at")).groupBy("anchor", "at").count().where("count > 1").drop("count")
        for c in ("at", "other"):
            found = found.join(busy.withColumnRenamed("at", c), ["anchor", c], "left_anti")
        new = [("src", "other_dst"), ("other_src", "dst")]
        made = found.select("anchor", "at", F.explode(F.array(*(F.struct(F.col(s).alias("s"), F.col(d).alias("d")) for s, d in new))).alias("e")).select("anchor", "at", F.col("e.s").alias("src"), F.col("e.d").alias("dst"))
        known = made.join(edges.select("anchor", "src", "dst"), ["anchor", "src", "dst"], "left_semi").select("anchor", "at")
        twice = made.join(made.groupBy("anchor", "src", "dst").count().where("count > 1").drop("count"), ["anchor", "src", "dst"], "left_semi").select("anchor", "at")
        good = saved(found.join(known.union(twice).distinct(), ["anchor", "at"], "left_anti"), "stubs-swaps")
        moves = good.select("anchor", "at", F.col("other_dst").alias("to")).union(good.select("anchor", F.col("other").alias("at"), F.col("dst").alias("to")))
        edges = saved(edges.join(moves, ["anchor", "at"], "left").select("anchor", "at", "src", F.coalesce("to", "dst").alias("dst")), "stubs-edges")
    return edges


def degree_problems(edges: DataFrame, sources: DataFrame, targets: DataFrame, bounds: Bounds) -> DataFrame:
    """problem, n: ends outside their bounds, repeated edges, and edges whose ends have different anchors; all without is sound."""
    ends = []
    for end, nodes, low, high in (("src", sources, bounds.least_out, bounds.most_out), ("dst", targets, bounds.least_in, bounds.most_in)):
        n = F.coalesce("n", F.lit(0))
        degree = nodes.select("id").distinct().join(edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n")), "id", "left")
        for name, bad in ((f"{end} below its least", n < low), (f"{end} above its most", n > (high if high is not None else 2**62))):
            ends.append(degree.where(bad).agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n"))
    repeated = edges.groupBy("src", "dst").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("repeated edge").alias("problem"), "n")
    placed = edges.join(sources.select(F.col("id").alias("src"), F.col("anchor").alias("a")), "src", "left").join(targets.select(F.col("id").alias("dst"), F.col("anchor").alias("b")), "dst", "left")
    apart = placed.where(~F.coalesce(F.col("a") == F.col("b"), F.lit(False))).agg(F.count("*").alias("n")).select(F.lit("different anchors").alias("problem"), "n")
    out = repeated.union(apart)
    for e in ends:
        out = out.union(e)
    return out.where("n > 0")


@dataclass(frozen=True)
class Kind:
    """A type of entities in a hierarchy: rows with an own identity column and `parent_<kind>` of every ancestor."""

    rows: DataFrame
    identity: str  # "id" names an entity alone; any other column does so among its parent's children
    parent: str | None = None


def ancestors(kinds: dict[str, Kind], name: str) -> list[str]:
    """From the parent up to the root; raises where the hierarchy turns back on itself."""
    out: list[str] = []
    while (name := kinds[name].parent) is not None:
        if name in out:
            raise ValueError(f"{name} is its own ancestor")
        out.append(name)
    return out


def _key(kinds: dict[str, Kind], name: str, own: str) -> Column:
    if kinds[name].identity == "id":
        return identifier([F.col(own)])
    return identifier([F.col(own), *(F.col(f"parent_{a}") for a in ancestors(kinds, name))])


def natural_keys(kinds: dict[str, Kind]) -> dict[str, DataFrame]:
    """For each kind its rows under `key`: the id, or the own identity followed by all ancestors' identities.

    Rows that lack a part have no key and are left out; of rows with one key the least stays."""
    out = {}
    for name, kind in kinds.items():
        columns = kind.rows.columns
        keyed = kind.rows.withColumn("key", _key(kinds, name, kind.identity)).where("key IS NOT NULL")
        out[name] = keyed.groupBy("key").agg(F.min(F.struct(*columns)).alias("r")).select("key", "r.*")
    return out


def parent_edges(kinds: dict[str, Kind]) -> dict[str, DataFrame]:
    """For each kind with a parent, (src, dst) from the parent to the child, made of the child's own columns without a join."""
    out = {}
    for name, kind in kinds.items():
        if kind.parent:
            parent = _key(kinds, kind.parent, f"parent_{kind.parent}")
            out[name] = kind.rows.select(parent.alias("src"), _key(kinds, name, kind.identity).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    return out


def orphans(kinds: dict[str, Kind]) -> DataFrame:
    """kind, key, parent: children whose parent no row describes."""
    nodes, found = natural_keys(kinds), None
    for name, edges in parent_edges(kinds).items():
        parents = nodes[kinds[name].parent or ""].select(F.col("key").alias("src"))
        lost = edges.join(parents, "src", "left_anti").select(F.lit(name).alias("kind"), F.col("dst").alias("key"), F.col("src").alias("parent"))
        found = lost if found is None else found.union(lost)
    if found is None:
        raise ValueError("no kind has a parent")
    return found


def bare_references(kinds: dict[str, Kind], name: str, values: DataFrame, column: str) -> DataFrame:
    """values with the `key` that a bare value stands for; raises for kinds that a bare value cannot name."""
    if kinds[name].identity != "id" and kinds[name].parent:
        raise ValueError(f"{name} is named only together with its ancestors")
    keys = natural_keys(kinds)[name].select("key")
    return values.join(keys, identifier([F.col(column)]) == F.col("key"), "left")


def scoped_children(parents: DataFrame, parent: str, key: str, least: int, most: int, seed: int, identity: str, values: Sequence[str]) -> DataFrame:
    """least to most children of each parent, named by `identity` from the values without replacement within the parent;
    `parent_*` columns of the parent are handed down, with `parent_<parent>` for the parent's own key."""
    handed = [c for c in parents.columns if c.startswith("parent_")]
    n = F.lit(least) + F.pmod(seeded(seed, key), F.lit(most - least + 1)).cast("int")
    grown = parents.where(present(F.col(key))).select(F.col(key).alias(f"parent_{parent}"), *handed, n.alias("_n")).where("_n > 0")
    grown = grown.select("*", F.explode(F.sequence(F.lit(1), "_n")).alias("child_no")).drop("_n").withColumn("_child", F.concat_ws("|", f"parent_{parent}", *handed, "child_no"))
    return unique_draws(grown, "_child", listed(parents.sparkSession, {identity: values}), seed, [f"parent_{parent}", *handed]).drop("_child")
