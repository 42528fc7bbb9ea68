"""Readers: parquet tables, text-only CSV, and item documents with embedded tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an item holds beside its tables, and the type of each as it is read.
PAIR = "source_item_id bigint, old_item_id bigint, old_item_index bigint, question string, sql string, answer string, original_answer string, execution_status string"
TABLES = "array<struct<table_columns array<string>, table_content array<array<variant>>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def csv(spark: SparkSession, path: str) -> DataFrame:
    """Cells as text, blank cells null, header names trimmed; types come from `operators.profile.typed`."""
    rows = spark.read.csv(path, header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return rows.toDF(*(c.strip().lstrip("﻿") for c in rows.columns))


def _field(of: str, name: str, kind: str) -> Column:
    return F.expr(f"try_variant_get({of}, '$.{name}', '{kind}')")


def _text(v: Column) -> Column:
    """A scalar as text: booleans are True and False, null is None."""
    kind = F.schema_of_variant(v)
    return F.when(kind == "BOOLEAN", F.initcap(v.cast("string"))).when(v.isNull() | (kind == "VOID"), "None").otherwise(v.cast("string"))


def _answer(v: Column) -> Column:
    """An answer of any form as text: null is empty; of {"data": [[...]]} the first cells, of a list all, comma-separated."""
    kind = F.schema_of_variant(v)
    data = F.try_variant_get(v, "$.data", "array<variant>")
    cells = F.filter(F.transform(data, lambda r: F.try_variant_get(r, "$[0]", "variant")), lambda c: c.isNotNull())
    joined = lambda array: F.array_join(F.transform(array, _text), ", ")
    return F.when(v.isNull() | (kind == "VOID"), "").when(kind.startswith("OBJECT"), F.coalesce(joined(cells), F.lit(""))).when(kind.startswith("ARRAY"), joined(v.try_cast("array<variant>"))).otherwise(_text(v))


def items(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, most: int | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Items of JSON arrays or of single objects, one row each: id_, ordinal (its place in its file), question, sql,
    answer, table_names, tables, primary_keys, foreign_keys, qa_pairs, is_merged, source_item_ids, descriptions.

    `Question` and `SQL` count as question and sql, in items and in their pairs; an item without its own question, and
    every answer and sql of a merged item, is its first pair's. Cells keep their JSON type. first and last bound the id,
    start and end (not included) the ordinal; `most` keeps the first items in order of file and ordinal."""
    if (first is not None and last is not None and last < first) or (first or 0) < 0:
        raise ValueError("the range of items is empty")
    whole = spark.read.option("singleVariantColumn", "v").option("multiLine", True).json(path).select("v", F.col("_metadata.file_path").alias("file"))
    many = F.when(F.schema_of_variant("v").startswith("ARRAY"), F.col("v").try_cast("array<variant>")).otherwise(F.array("v"))
    rows = whole.select("file", F.posexplode(many).alias("ordinal", "x")).where(F.schema_of_variant("x").startswith("OBJECT"))
    pairs = F.transform(_field("x", "qa_pairs", "array<variant>"), _pair)
    own = lambda *names: F.coalesce(*(F.nullif(_field("x", n, "string"), F.lit("")) for n in names), F.lit(""))
    rows = rows.withColumn("pairs", pairs).withColumn("one", F.when(F.size("pairs") > 0, F.col("pairs")[0]))
    found = rows.select(
        _field("x", "id_", "bigint").alias("id_"),
        "file",
        "ordinal",
        F.coalesce(F.nullif("one.question", F.lit("")), own("Question", "question")).alias("question"),
        F.coalesce(F.nullif("one.sql", F.lit("")), own("SQL", "sql")).alias("sql"),
        F.when(F.col("one").isNotNull(), F.col("one.answer")).otherwise(_answer(F.try_variant_get("x", "$.answer", "variant"))).alias("answer"),
        *(_field("x", n, "array<string>").alias(n) for n in ("table_names", "primary_keys", "foreign_keys")),
        _field("x", "tables", TABLES).alias("tables"),
        F.coalesce("pairs", F.array().cast(f"array<struct<{PAIR.replace(' ', ': ').replace(',:', ',')}>>")).alias("qa_pairs"),
        F.try_variant_get("x", "$.qa_pairs", "variant").isNotNull().alias("is_merged"),
        _field("x", "source_item_ids", "array<bigint>").alias("source_item_ids"),
        F.to_json(F.try_variant_get("x", "$.descriptions", "variant")).alias("descriptions"),
    )
    for low, high, c in ((first, None if last is None else last + 1, "id_"), (start, end, "ordinal")):
        found = found if low is None else found.where(F.col(c) >= low)
        found = found if high is None else found.where(F.col(c) < high)
    return (found if most is None else found.orderBy("file", "ordinal").limit(most)).drop("file")


def _pair(v: Column) -> Column:
    text = lambda *names: F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names), F.lit(""))
    number = lambda n: F.try_variant_get(v, f"$.{n}", "bigint").alias(n)
    answer, original = (F.try_variant_get(v, f"$.{n}", "variant") for n in ("answer", "original_answer"))
    return F.struct(
        *map(number, ("source_item_id", "old_item_id", "old_item_index")),
        text("Question", "question").alias("question"),
        text("SQL", "sql").alias("sql"),
        _answer(answer).alias("answer"),
        F.when(original.isNull(), _answer(answer)).otherwise(_answer(original)).alias("original_answer"),
        text("execution_status").alias("execution_status"),
    )


def sampled_items(found: DataFrame, k: int, seed: int) -> DataFrame:
    """k items by a seeded hash of their id: the same ones on every run."""
    return found.orderBy(F.xxhash64(F.lit(seed), "id_"), "id_").limit(k)


def item_rows(found: DataFrame) -> DataFrame:
    """Long form of all embedded tables: id_, table, row, place, column, value, kind (of the JSON value: boolean, number,
    text or null); rows shorter than the header give nulls."""
    pairs = F.arrays_zip(F.col("table_names").alias("name"), F.col("tables").alias("body"))
    tables = found.select("id_", F.explode(pairs).alias("t")).where("t.name IS NOT NULL AND t.body IS NOT NULL")
    rows = tables.select("id_", F.col("t.name").alias("table"), F.col("t.body.table_columns").alias("columns"), F.posexplode("t.body.table_content").alias("row", "cells"))
    cells = rows.select("id_", "table", "row", "cells", F.posexplode("columns").alias("place", "column")).select("id_", "table", "row", "place", "column", F.try_element_at("cells", F.col("place") + 1).alias("v"))
    of = F.schema_of_variant("v")
    kind = F.when(F.col("v").isNull() | (of == "VOID"), "null").when(of == "BOOLEAN", "boolean").when(of == "STRING", "text").when(of.rlike("^(ARRAY|OBJECT)"), "text").otherwise("number")
    nested = of.rlike("^(ARRAY|OBJECT)")
    return cells.select("id_", "table", "row", "place", "column", F.when(nested, F.to_json("v")).otherwise(F.col("v").try_cast("string")).alias("value"), kind.alias("kind"))


def item_keys(found: DataFrame) -> DataFrame:
    """id_, table, place, column of the declared primary keys: one text a table, a key of several columns with commas."""
    pairs = F.arrays_zip(F.col("table_names").alias("name"), F.col("primary_keys").alias("key"))
    keys = found.select("id_", F.explode(pairs).alias("t")).where("t.name IS NOT NULL AND t.key IS NOT NULL")
    return keys.select("id_", F.col("t.name").alias("table"), F.posexplode(F.split("t.key", r"\s*,\s*")).alias("place", "column")).where("column <> ''")


def item_questions(found: DataFrame) -> DataFrame:
    """One row a question: a merged item has many, a single item its own."""
    own = F.array(F.struct(F.col("question").alias("question"), F.col("sql").alias("sql"), F.col("answer").alias("answer")))
    many = F.transform("qa_pairs", lambda p: F.struct(F.coalesce(F.nullif(p["question"], F.lit("")), F.col("question")).alias("question"), F.coalesce(F.nullif(p["sql"], F.lit("")), F.col("sql")).alias("sql"), p["answer"].alias("answer")))
    return found.select("id_", F.posexplode(F.when(F.size("qa_pairs") > 0, many).otherwise(own)).alias("number", "q")).select("id_", "number", "q.question", "q.sql", "q.answer")


def instances(spark: SparkSession, path: str) -> DataFrame:
    """Entities and relations of instance documents, a row each: file, kind (entity or relation), type, place, fields (a map)."""
    whole = spark.read.option("singleVariantColumn", "v").option("multiLine", True).json(path).select("v", F.col("_metadata.file_path").alias("file"))
    parts = [
        whole.select("file", F.lit(kind).alias("kind"), F.explode(_field("v", name, "map<string, array<map<string, string>>>")).alias("type", "rows")).select("file", "kind", "type", F.posexplode("rows").alias("place", "fields"))
        for kind, name in (("entity", "entities"), ("relation", "relations"))
    ]
    return parts[0].union(parts[1])


def instance_table(found: DataFrame, kind: str, name: str) -> DataFrame:
    """The rows of one type as a table: `place` and a column for each field that any row has, by name."""
    rows = found.where((F.col("kind") == kind) & (F.col("type") == name))
    fields = [r.f for r in rows.select(F.explode(F.map_keys("fields")).alias("f")).distinct().orderBy("f").collect()]  # a row a field
    return rows.select("place", *(F.try_element_at("fields", F.lit(f)).alias(f) for f in fields))


def settings(spark: SparkSession, path: str) -> dict:
    """A YAML document, from any store that Spark reads."""
    import yaml

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).limit(1).collect())  # one settings file
    return yaml.safe_load(text) or {}


def merged_settings(base: dict, override: dict) -> dict:
    """base with the override's values; dictionaries in both are merged, anything else is replaced."""
    return base | {k: merged_settings(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in override.items()}


def answer_text(answer: Column) -> Column:
    """Answers of any form as text: null is empty; of {"data": [[...]]} and of lists the first cells, comma-separated."""
    raw = F.trim(answer)
    body = F.when(raw.startswith("{"), F.get_json_object(raw, "$.data")).otherwise(raw)
    rows, flat = F.from_json(body, "array<array<string>>"), F.from_json(body, "array<string>")
    cells = F.when(body.rlike(r"^\[\s*\["), F.transform(rows, lambda r: F.try_element_at(r, F.lit(1)))).otherwise(flat)
    return F.when(raw.isNull(), "").when(body.startswith("["), F.concat_ws(", ", cells)).otherwise(answer)
