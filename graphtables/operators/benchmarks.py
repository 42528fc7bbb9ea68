"""Benchmark data: entities, constrained relations, denormalised tables, and questions with answers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.values import is_identifier, padded_id
from ..sources.shared import saved
from .generation import ranked


def generated(spark: SparkSession, n: int, prefix: str, seed: int, values: dict[str, Sequence[str]], width: int = 4) -> DataFrame:
    """n entities with padded ids; each property picks from its values by a seeded hash, the same on every run."""
    pick = lambda p, vs: F.element_at(F.array(*map(F.lit, vs)), (F.pmod(F.xxhash64(F.lit(seed), F.lit(p), "id"), F.lit(len(vs))) + 1).cast("int"))
    return spark.range(1, n + 1).select(padded_id(prefix, "-", F.col("id"), width).alias("entity_id"), *(pick(p, v).alias(p) for p, v in values.items()))


def children(parents: DataFrame, key: str, least: int, most: int, seed: int) -> DataFrame:
    """least to most children for each parent, with its fields and child_no from 1."""
    n = F.lit(least) + F.pmod(F.xxhash64(F.lit(seed), key), F.lit(most - least + 1)).cast("int")
    return parents.select("*", F.explode(F.sequence(F.lit(1), n)).alias("child_no"))


def denormalised(base: DataFrame, key: str, edges: DataFrame | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Base rows, expanded to one row for each outgoing edge (src, dst, ...); no edge leaves one row with nulls."""
    out = base if edges is None else base.join(edges.withColumnRenamed("src", key), key, "left")
    return out if targets is None else out.join(targets.withColumnRenamed("id", "dst"), "dst", "left")


def relation_rows(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """One row an edge with the fields of both ends."""
    return edges.join(sources.withColumnRenamed("id", "src"), "src", "left").join(targets.withColumnRenamed("id", "dst"), "dst", "left")


def first_edges(edges: DataFrame, order: str) -> DataFrame:
    """One edge a source, the least by `order`: what a table shows of a relation that it does not expand."""
    rest = [c for c in edges.columns if c != "src"]
    return edges.groupBy("src").agg(F.min_by(F.struct(*rest), order).alias("e")).select("src", "e.*")


def degrees(nodes: DataFrame, edges: DataFrame, end: str) -> DataFrame:
    """Least, greatest and mean number of edges at this end, entities without edges included."""
    n = edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias("n"))
    return nodes.select("id").join(n, "id", "left").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.max(F.coalesce("n", F.lit(0))).alias("most"), F.sum(F.coalesce("n", F.lit(0))).alias("edges"))


def allowed_pairs(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Different (src, dst) whose anchors meet; both sides are (id, anchor)."""
    a = sources.select(F.col("id").alias("src"), "anchor").distinct()
    return a.join(targets.select(F.col("id").alias("dst"), "anchor").distinct(), "anchor").select("src", "dst").distinct()


def violations(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges whose ends share no anchor."""
    a, b = (x.select(F.col("id").alias(c), "anchor").distinct() for x, c in ((sources, "src"), (targets, "dst")))
    good = edges.select("src", "dst").distinct().join(a, "src").join(b, ["dst", "anchor"]).select("src", "dst")
    return edges.join(good, ["src", "dst"], "left_anti")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def questions(bindings: DataFrame, parameter: str, answer: str, text: Column, unique: bool = False) -> DataFrame:
    """A template asked for every parameter at once: parameter, question, answers sorted and joined, n_answers."""
    rows = bindings.select(F.col(parameter).alias("parameter"), F.col(answer).cast("string").alias("a")).where("a IS NOT NULL").distinct()
    out = rows.groupBy("parameter").agg(F.count("*").alias("n_answers"), F.concat_ws(", ", F.sort_array(F.collect_list("a"))).alias("answer"))
    return (out.where("n_answers = 1") if unique else out).withColumn("question", text)


def placeholders(template: str) -> list[str]:
    """The names of a template's $parameters, each once, in order."""
    return list(dict.fromkeys(re.findall(r"\$([A-Za-z_]\w*)", template)))


def quotas(total: int, types: Sequence[str], declared: dict[str, int] | None = None) -> dict[str, int]:
    """Questions of each type: as declared, else an equal share of the total, the first types taking what is left over."""
    if declared:
        if unknown := set(declared) - set(types):
            raise ValueError(f"no templates of the types {sorted(unknown)}")
        return {t: declared.get(t, 0) for t in types}
    return {t: total // len(types) + (k < total % len(types)) for k, t in enumerate(types)}


def assembled(rows: DataFrame, item: str) -> DataFrame:
    """Items with their questions: item, n_questions, qa_pairs in order of the question. rows: item, question, answer."""
    pairs = F.sort_array(F.collect_list(F.struct("question", "answer")))
    return rows.groupBy(item).agg(F.count("*").alias("n_questions"), pairs.alias("qa_pairs"))


def renamed(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """One-to-one renaming; refuses names that clash, repeat or leave a column as it was."""
    new = [names.get(c, c) for c in rows.columns]
    if len(set(map(str.lower, new))) != len(new) or any(k == v for k, v in names.items()) or set(names) - set(rows.columns):
        raise ValueError("the renaming is not one to one")
    return rows.toDF(*new)


def name_mapping(columns: DataFrame, proposed: DataFrame | None = None) -> DataFrame:
    """table, column, new_table, new_column, given: one-to-one new names for all tables and columns, to hide a schema.

    columns: table, column, place; proposed: table, column, new_table, new_column. The proposed names of a table are taken
    if they are plain names, all changed, all different in any case, one for each column, and no other table's; else
    the table gets the next `tableN` that no taken name has, by name, with its columns as `colN` by place."""
    low = lambda c: F.lower(F.trim(c))
    tables = columns.groupBy("table").agg(F.count("*").alias("n"))
    given = None
    if proposed is not None:
        sound = is_identifier(F.col("new_table")) & is_identifier(F.col("new_column")) & (low("new_column") != low("column")) & (low("new_table") != low("table"))
        known = columns.join(proposed, ["table", "column"])
        good = known.groupBy("table").agg(F.bool_and(sound).alias("sound"), F.count("*").alias("k"), F.count_distinct(low("new_column")).alias("different"), F.count_distinct(low("new_table")).alias("names"), F.min(low("new_table")).alias("name"))
        good = good.join(tables, "table").where("sound AND k = n AND different = n AND names = 1")
        alone = good.groupBy("name").agg(F.count("*").alias("holders")).where("holders = 1")
        given = known.join(good.join(alone, "name").select("table"), "table", "left_semi").select("table", "column", "new_table", "new_column", F.lit(True).alias("given"))
        tables = tables.join(given.select("table").distinct(), "table", "left_anti")
    taken = [] if given is None else [r[0] for r in given.select(low("new_table")).distinct().collect()]  # names of tables
    free = [r.table for r in tables.orderBy("table").select("table").collect()]
    numbers = (n for n in range(1, len(free) + len(taken) + 1) if f"table{n}" not in taken)
    names = columns.sparkSession.createDataFrame([(t, f"table{n}") for t, n in zip(free, numbers)], "table string, new_table string")
    place = F.row_number().over(Window.partitionBy("table").orderBy("place", "column"))
    made = columns.join(names, "table").select("table", "column", "new_table", F.concat(F.lit("col"), place).alias("new_column"), F.lit(False).alias("given"))
    return made if given is None else given.union(made)


#: Above this many allowed pairs, an end's pairs are ranked in runs of their hash and no longer by one task.
HOT = 100_000


def sampled_edges(pairs: DataFrame, least_out: int, most_out: int, least_in: int, most_in: int, seed: int, attempts: int = 50) -> DataFrame:
    """A seeded choice among allowed (src, dst) that respects the degrees of every source and target in the pairs.

    First every source takes `least_out` targets, then targets below `least_in` take sources, then sources fill up to
    their quota, in rounds over pairs not yet chosen; ends that still lack edges take some from ends that have some to
    spare, as many at once as there are. A draw that misses a least
    bound is drawn anew with another seed; the last one raises. Rounds are tables in the
    shared folder, so a lost executor costs none of them. For ends with one anchor each, `generation.edges_by_stubs` needs
    no table of pairs; this one is for ends whose several anchors make the pairs."""
    pairs = saved(pairs.select("src", "dst").distinct(), "edges-pairs")
    nodes, hot = {}, set()
    for end, least in (("src", least_out), ("dst", least_in)):
        sizes = saved(pairs.groupBy(end).agg(F.count("*").alias("n")), "edges-ends")
        seen = sizes.agg(F.count_if(F.col("n") < least).alias("starved"), F.max("n").alias("most")).first()
        if seen.starved:
            raise ValueError(f"{seen.starved} values of {end} have fewer than {least} allowed pairs")
        nodes[end] = sizes.select(end)
        hot |= {end} if (seen.most or 0) > HOT else set()
    for attempt in range(attempts):
        chosen = drawn(pairs, nodes, hot, least_out, most_out, least_in, most_in, seed + attempt)
        short = sum(degrees(nodes[end].select(F.col(end).alias("id")), chosen, end).where(F.col("least") < least).count() for end, least in (("src", least_out), ("dst", least_in)))
        if not short:
            return chosen
    raise ValueError(f"no draw of {attempts} has {least_out} to {most_out} edges a source and {least_in} to {most_in} a target")


def drawn(pairs: DataFrame, nodes: dict[str, DataFrame], hot: set[str], least_out: int, most_out: int, least_in: int, most_in: int, seed: int) -> DataFrame:
    """One draw of `sampled_edges`: rounds until no bound improves; the greatest degrees always hold.

    nodes: the ids of each end; hot: the ends of which some have many pairs. Every round makes all the changes that do
    not disturb each other, so rounds grow with the logarithm of what is lacking."""
    chosen = saved(pairs.limit(0), "edges-chosen")
    quota = F.lit(least_out) + F.pmod(F.xxhash64(F.lit(seed), "src"), F.lit(most_out - least_out + 1))
    h, named = F.xxhash64(F.lit(seed), "src", "dst"), {"src": "out", "dst": "into"}

    def placed(rows: DataFrame, end: str, name: str, major: Column | None = None) -> DataFrame:
        """rows with their place from 0 among those of an end, by `major`, their hash and the other end."""
        tie = "dst" if end == "src" else "src"
        if end in hot:
            return ranked(saved(rows, "edges-placed"), [end], F.col("h"), tie, name, major)
        by = ([] if major is None else [major]) + [F.col("h"), F.col(tie)]
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(end).orderBy(*by)) - 1)

    def degree(end: str) -> DataFrame:
        n = chosen.groupBy(end).agg(F.count("*").alias("n"))
        return nodes[end].join(n, end, "left").select(end, F.coalesce("n", F.lit(0)).alias(named[end]))

    def free(*ends: DataFrame) -> DataFrame:
        """Pairs not yet chosen of these sources or targets."""
        rows = pairs
        for e in ends:
            rows = rows.join(e, e.columns[0])
        return rows.join(chosen, ["src", "dst"], "left_anti").withColumn("h", h)

    def taken() -> DataFrame:
        """Targets below their least take sources: those below theirs first, then those below their quota."""
        tier = F.when(F.col("out") < least_out, 0).when(F.col("out") < quota, 1).otherwise(2)
        asked = free(degree("dst").where((F.col("into") < least_in) & (F.col("into") < most_in)), degree("src").where(F.col("out") < most_out))
        asked = placed(asked, "dst", "k", tier).where(F.col("k") < F.least(F.lit(least_in), F.lit(most_in)) - F.col("into"))
        return placed(asked, "src", "m").where(F.col("m") < most_out - F.col("out"))

    def filled(goal: Column) -> DataFrame:
        """Sources below their goal take targets; where too many ask, sources below their least go first."""
        asked = free(degree("src").where(F.col("out") < goal), degree("dst").where(F.col("into") < most_in))
        asked = placed(asked, "src", "k").where(F.col("k") < goal - F.col("out"))
        return placed(asked, "dst", "m", (F.col("out") >= least_out).cast("int")).where(F.col("m") < most_in - F.col("into"))

    def swapped(end: str, other: str, least: int) -> DataFrame:
        """Pairs for ends below their least, each in place of an edge at the same other end that can be spared.

        What is lacking and what can be spared at an other end meet rank to rank, not all with all; then no end takes more
        than it lacks, and none gives more than it can spare. If any swap is possible, one is made."""
        low, high = degree(end).where(F.col(named[end]) < least), degree(end).where(F.col(named[end]) > least)
        lacks = placed(free(low), other, "k").withColumnRenamed(named[end], "has")
        spare = placed(chosen.join(high, end).withColumn("h", h), other, "k").select(F.col(end).alias("from"), other, "k", F.col(named[end]).alias("held"))
        met = placed(saved(lacks.join(spare, [other, "k"]).drop("k"), "edges-met"), end, "k").where(F.col("k") < least - F.col("has")).drop("k")
        given = met.select(F.col("from").alias(end), other, "held", "h", F.col(end).alias("to"))
        given = placed(given, end, "k").where(F.col("k") < F.col("held") - least)
        return saved(given.select(F.col(end).alias("from"), F.col("to").alias(end), other), "edges-swapped")

    while True:
        moved = False
        for step in (lambda: filled(F.lit(least_out)), taken, lambda: filled(quota)):
            while not (new := saved(step().select("src", "dst"), "edges-new")).isEmpty():
                chosen = saved(chosen.union(new), "edges-chosen")
        for end, other, least in (("src", "dst", least_out), ("dst", "src", least_in)):
            while not (new := swapped(end, other, least)).isEmpty():
                dropped = new.select(F.col("from").alias(end), other)
                kept = chosen.join(dropped, ["src", "dst"], "left_anti").select("src", "dst")
                chosen = saved(kept.union(new.select("src", "dst")), "edges-chosen")
                moved = True
        if not moved:
            return chosen
