"""Questions over a graph: templates asked for many parameters at once, and batches of questions with a log."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.graph import Match, PropertyGraph
from ..sources.shared import saved
from ..sources.sinks import exists
from .benchmarks import placeholders

LOG = "item string, question string, status string, answer string, expected string, error string, seconds double"


@dataclass(frozen=True)
class Template:
    """A question in words with {places}, and its pattern.

    ask: from the graph and a table of parameters (pid and a column a parameter) to rows pid, answer. sources: for a
    parameter the label and property it is drawn from; links: for a parameter another one whose entity gives it too."""

    kind: str
    text: str
    ask: Callable[[PropertyGraph, DataFrame], DataFrame]
    sources: dict[str, tuple[str, str]] = field(default_factory=dict)
    links: dict[str, tuple[str, str]] = field(default_factory=dict)
    unique: bool = False


def bound(graph: PropertyGraph, params: DataFrame, var: str, label: str, props: tuple[str, ...] = (), **equal: str) -> Match:
    """A pattern that begins at nodes whose properties equal parameters, for all rows of the table at once; bindings keep pid."""
    nodes = graph.node(var, label, tuple(dict.fromkeys((*props, *equal))), {}, alone=True)
    keyed = params.select("pid", *(F.col(p).alias(f"{var}_{name}") for name, p in equal.items()))
    rows = nodes.join(keyed, [f"{var}_{name}" for name in equal])
    return Match(graph, rows, {var: nodes.columns, "pid": ["pid"]})


def parameters(graph: PropertyGraph, template: Template, seed: int, most: int) -> DataFrame:
    """pid and the template's parameters: at most `most` different draws, in order of a seeded hash.

    Independent parameters are drawn by rank, the k-th of one beside the k-th of another, so nothing is crossed; linked
    ones come from the same entity as their anchor. Draws with a missing part are left out."""
    names = placeholders(template.text.replace("{", "$"))
    linked = {p: template.links[p] for p in names if p in template.links and template.links[p][0] in names}
    drawn = None
    for p in (n for n in names if n not in linked):
        if p not in template.sources:
            raise ValueError(f"the parameter {p} has no source")
        label, prop = template.sources[p]
        own = {p: prop} | {q: attribute for q, (anchor, attribute) in linked.items() if anchor == p}
        rows = graph.nodes[label].select("id", *(F.col(c).alias(q) for q, c in own.items())).where(" AND ".join(f"`{q}` IS NOT NULL" for q in own))
        first = rows.select(*own).distinct().withColumn("_h", F.xxhash64(F.lit(seed), F.lit(p), *own)).orderBy("_h", *own).limit(most)
        placed = first.withColumn("_k", F.row_number().over(Window.orderBy("_h", *own))).drop("_h")  # at most `most` rows
        drawn = placed if drawn is None else drawn.join(placed, "_k")
    if drawn is None:
        return graph.nodes[next(iter(graph.nodes))].sparkSession.range(1).select(F.lit(1).alias("pid"))
    return drawn.withColumnRenamed("_k", "pid")


def generated_questions(graph: PropertyGraph, templates: Sequence[Template], quotas: dict[str, int], seed: int, tries: int = 20) -> DataFrame:
    """number, kind, question, answers, answer: answered questions, as many of each kind as its quota says, if there are.

    All draws of a template are asked at once. Questions without an answer, repeated ones, and those of templates marked
    `unique` with more than one answer are dropped. The templates of a kind take turns, each in its order of draws.
    Raises for a quota whose kind has no template."""
    if unknown := set(quotas) - {t.kind for t in templates}:
        raise ValueError(f"no templates of the kinds {sorted(unknown)}")
    parts = []
    for k, t in enumerate(templates):
        if not (quota := quotas.get(t.kind, 0)):
            continue
        drawn = saved(parameters(graph, t, seed + k, quota * tries), "question-parameters")
        rows = t.ask(graph, drawn).select("pid", F.col("answer").cast("string").alias("answer")).where("answer IS NOT NULL").distinct()
        answers = rows.groupBy("pid").agg(F.sort_array(F.collect_list("answer")).alias("answers"))  # the answers of one question
        answers = answers.where("size(answers) = 1") if t.unique else answers
        text, given = F.lit(""), [c for c in drawn.columns if c != "pid"]
        for place, part in enumerate(t.text.replace("}", "{").split("{")):
            text = F.concat(text, F.col(part).cast("string") if place % 2 else F.lit(part))
        asked = answers.join(drawn, "pid").select(F.lit(t.kind).alias("kind"), F.lit(k).alias("template"), "pid", text.alias("question"), F.to_json(F.struct(*given) if given else F.create_map()).alias("params"), "answers")
        parts.append(asked.withColumn("turn", F.row_number().over(Window.partitionBy("template").orderBy("pid"))))  # at most quota * tries rows
    if not parts:
        raise ValueError("all quotas are zero")
    every = reduce(DataFrame.union, parts).groupBy("kind", "question").agg(F.min(F.struct("turn", "template", "params", "answers")).alias("x")).select("kind", "question", "x.*")
    chosen = every.withColumn("number", F.row_number().over(Window.partitionBy("kind").orderBy("turn", "template", "question")))
    limit = F.create_map(*(F.lit(x) for pair in quotas.items() for x in pair))
    return chosen.where(F.col("number") <= limit[F.col("kind")]).select("kind", "number", "template", "question", "params", "answers", F.array_join("answers", ", ").alias("answer"))


@dataclass(frozen=True)
class Question:
    item: str
    name: str
    ask: Callable[[], DataFrame]  # a frame whose first column is the answer
    expected: str | None = None


def question_batch(spark, questions: Sequence[Question], log: str, at_once: int = 4, most_answers: int = 1000) -> DataFrame:
    """Answers questions and appends them to a log: item, question, status (ok or error), answer, expected, error, seconds.

    Each question is isolated: one that fails leaves its message and no other is touched. Questions that the log holds with
    status ok are not asked again, so a run that broke off goes on where it stopped. Jobs run side by side; answers are
    formatted in Spark: different ones sorted and joined, `(no result)` for none. An answer of more than `most_answers`
    different values is an error, not a cut list."""
    done = {(r.item, r.question) for r in read_log(spark, log).where("status = 'ok'").select("item", "question").distinct().collect()}  # a row a question

    def answered(q: Question) -> tuple:
        began = time.perf_counter()
        try:
            rows = q.ask()
            values = rows.select(F.col(rows.columns[0]).cast("string").alias("a")).where("a IS NOT NULL").distinct().orderBy("a").limit(most_answers + 1)
            found = [r.a for r in values.collect()]
            if len(found) > most_answers:
                raise ValueError(f"more than {most_answers} answers")
            return q.item, q.name, "ok", ", ".join(found) or "(no result)", q.expected, None, time.perf_counter() - began
        except Exception as e:  # one question's fault is a row of the log
            return q.item, q.name, "error", None, q.expected, str(e).split("\n")[0][:500], time.perf_counter() - began

    todo = [q for q in questions if (q.item, q.name) not in done]
    with ThreadPoolExecutor(at_once) as pool:
        for begin in range(0, len(todo), 4 * at_once):  # the log grows as the run goes on
            rows = list(pool.map(answered, todo[begin : begin + 4 * at_once]))
            spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(log)
    return read_log(spark, log)


def read_log(spark, log: str) -> DataFrame:
    """The log, one row a question: the last success, else the last error."""
    if not exists(spark, log):
        return spark.createDataFrame([], LOG)
    rows = spark.read.schema(LOG).parquet(log)
    best = F.max_by(F.struct(*rows.columns), F.struct(F.col("status") == "ok", "seconds"))
    return rows.groupBy("item", "question").agg(best.alias("x")).select("x.*")


def batch_summary(log: DataFrame) -> DataFrame:
    """item, questions, ok, errors, correct, seconds: what a batch gave for each item; without an expected answer nothing is correct."""
    right = (F.col("status") == "ok") & (F.lower(F.trim("answer")) == F.lower(F.trim("expected")))
    return log.groupBy("item").agg(F.count("*").alias("questions"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(right).alias("correct"), F.round(F.sum("seconds"), 3).alias("seconds"))
