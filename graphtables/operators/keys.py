"""Key repair: columns that contradict a key, and the key that explains them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_LIMIT = 3


def conflicts(rows: DataFrame, key: Sequence[str], properties: Sequence[str]) -> DataFrame:
    """One row a property: column, conflicting (it takes two values, null among them, for one key).

    Least and greatest value with a null count tell more than one value apart, so partial aggregates stay small."""
    differ = {c: (F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count("*"))) for c in properties}
    groups = rows.groupBy(*key).agg(*(F.coalesce(e, F.lit(False)).alias(c) for c, e in differ.items()))
    flags = groups.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in properties))
    return flags.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("conflicting")) for c in properties))).alias("x")).select("x.*")


def repaired_key(rows: DataFrame, key: Sequence[str], properties: Sequence[str]) -> list[str]:
    """The key with all contradicting columns appended in table order, if it has fewer than three columns.

    One step suffices: columns that never differed within a group don't within a finer one. Raises if a key that may
    not grow is contradicted."""
    found = {r["column"] for r in conflicts(rows, key, properties).where("conflicting").collect()}  # a row a column
    if not found:
        return list(key)
    if len(key) >= KEY_LIMIT:
        raise ValueError(f"{sorted(found)} contradict the key {list(key)}")
    return [*key, *(c for c in rows.columns if c in found)]
