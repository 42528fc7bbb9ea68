"""Answers as text, and their comparison with expected ones."""

from __future__ import annotations

import ast
import math
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import shown

NOTHING = "(no result)"


def formatted(rows: DataFrame, by: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """One row a question (`by`): answer. Different rows only; one row or one column is comma-separated, else bars.

    A question whose rows are null throughout answers `(no result)`."""
    kinds = dict(rows.dtypes)
    cells = F.concat_ws(", ", *(shown(F.col(c), kinds[c]) for c in columns))
    some = F.coalesce(*(F.col(c).cast("string") for c in columns)).isNotNull()
    kept = rows.where(some).select(*by, F.struct(*order).alias("_order"), cells.alias("cells")).groupBy(*by, "cells").agg(F.min("_order").alias("_order"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("_order", "cells"))), lambda x: x["cells"])
    answers = kept.groupBy(*by).agg(F.concat_ws(", " if len(columns) == 1 else " | ", lines).alias("answer"))
    return rows.select(*by).distinct().join(answers, by, "left").withColumn("answer", F.coalesce("answer", F.lit(NOTHING)))


def combined(first: DataFrame, second: DataFrame, by: list[str]) -> DataFrame:
    """Two partial answers of a question in one, `(no result)` if either has none."""
    both = first.withColumnRenamed("answer", "a").join(second.withColumnRenamed("answer", "b"), by)
    none = (F.col("a") == NOTHING) | (F.col("b") == NOTHING)
    return both.select(*by, F.when(none, NOTHING).otherwise(F.concat_ws("; ", "a", "b")).alias("answer"))


def products(parts: list[DataFrame], by: list[str], separator: str = "; ") -> DataFrame:
    """Every combination of the answers of a question's parts (by, answer), one row each, in order of the parts.

    A question that lacks an answer in any part has the one answer `(no result)`; parts are joined by question."""
    asked = parts[0].select(*by)
    for p in parts[1:]:
        asked = asked.union(p.select(*by))
    out = asked.distinct()
    for k, p in enumerate(parts):
        out = out.join(p.where(F.col("answer") != NOTHING).select(*by, F.col("answer").alias(f"_a{k}")), by, "left")
    names = [f"_a{k}" for k in range(len(parts))]
    none = F.lit(False)
    for n in names:
        none = none | F.col(n).isNull()
    return out.select(*by, F.when(none, NOTHING).otherwise(F.concat_ws(separator, *names)).alias("answer")).distinct()


def _flat(x) -> list:
    return [z for y in x for z in _flat(y)] if isinstance(x, (list, tuple, set)) else [x]


def _literal(text: str) -> list[str] | None:
    if text[:1] in "[({":
        try:
            return [str(x) for x in _flat(ast.literal_eval(text))]
        except (ValueError, SyntaxError, TypeError):
            return None
    return None


def _tokens(text: str) -> set[str]:
    parts = _literal(text)
    if parts is None:
        parts = re.split(r"[|;]", text) if re.search(r"[|;]", text) else text.split(",")
    return {t for t in (p.strip().lower().rstrip(".").strip() for p in parts) if t}


def agree(got: str | None, want: str | None) -> bool:
    """Numbers within 1e-6 (or 1e-9), else equal token sets; no result agrees with an empty expectation."""
    got, want = (got or "").strip(), (want or "").strip()
    if got == NOTHING and not want:
        return True
    try:
        return math.isclose(float(got), float(want), rel_tol=1e-6, abs_tol=1e-9)
    except ValueError:
        pass
    a, b = _tokens(got), _tokens(want)
    if a == b:
        return True
    if (_literal(got) is None) != (_literal(want) is None):  # one side is a literal: compare loosely
        loose = lambda t: {x for x in re.split(r"[\s,;|'\"\[\](){}]+", t.lower()) if x}
        return loose(got) == loose(want)
    return False


def checked(rows: DataFrame, got: str, want: str) -> DataFrame:
    """rows with `correct`."""

    @F.pandas_udf("boolean")
    def correct(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([agree(x, y) for x, y in zip(a, b)])

    return rows.withColumn("correct", correct(F.col(got), F.col(want)))


def accuracy(rows: DataFrame, by: list[str], got: str, want: str) -> DataFrame:
    """total, correct and accuracy for each `by`; equal pairs of answers are compared once."""
    pairs = checked(rows.groupBy(*by, got, want).agg(F.count("*").alias("n")), got, want)
    hits = F.sum(F.when(F.col("correct"), F.col("n")).otherwise(0))
    return pairs.groupBy(*by).agg(F.sum("n").alias("total"), hits.alias("correct"), F.round(hits / F.sum("n"), 4).alias("accuracy"))
