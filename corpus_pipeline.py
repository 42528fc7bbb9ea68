"""A corpus pipeline: quality, exact dedup, near-dedup, packing. Each stage's rows are the next one's docs."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphtables.llm import exact_dedup, near_dedup, packing, quality
from graphtables.llm.common import saved, scratch, table
from graphtables.llm.queries import vocabulary


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior says good; the rest goes."""
    rest = F.struct(*(c for c in docs.columns if c != "text")).alias("rest")  # no name in it clashes with the operator's
    scored = quality.scored(docs.select("doc_id", "text", "source", "lang", rest), table(spark, sf_dir, "labels"), keep=("rest", "text"))
    return scored.where("kept").select(*(F.col("text") if c == "text" else F.col("rest")[c].alias(c) for c in docs.columns))


def chosen(docs: DataFrame, decisions: DataFrame, **keys: Column) -> DataFrame:
    """The rows of docs that decisions name by all keys (null equals null); of those with equal keys the longest text.

    decisions: a row for each combination of keys, with the number n of rows that it names. keys: for each key the
    expression over docs that it stands for."""
    decisions = saved(decisions.select("n", *keys).toDF("_chosen_n", *(f"_chosen_{k}" for k in keys)), "chosen")
    marked = docs.select(F.struct(*docs.columns).alias("row"), *(e.alias(f"_own_{k}") for k, e in keys.items()))
    found = marked.join(decisions, reduce(and_, (F.col(f"_own_{k}").eqNullSafe(F.col(f"_chosen_{k}")) for k in keys)))
    out = found.where("_chosen_n = 1").select("row.*")
    if decisions.where("_chosen_n > 1").isEmpty():
        return out
    longest = F.max_by("row", F.struct(F.length("row.text"), "row.text"))
    return out.union(found.where("_chosen_n > 1").groupBy(*(f"_chosen_{k}" for k in keys)).agg(longest.alias("row")).select("row.*"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of all with equal texts stays: the longest original, then the smallest doc_id.

    That holds for rows that repeat a doc_id too; a row without a doc_id stays if none with one has its text."""
    keeper, named = F.max("keep_id"), F.count_if(F.col("doc_id") == F.col("keep_id"))
    stays = exact_dedup.exact_duplicates(docs).groupBy("text_sha256").agg(keeper.alias("id"), F.when(keeper.isNull(), F.count("*")).otherwise(named).alias("n"))
    sha = F.sha2(exact_dedup.normalised(F.col("text")).cast("binary"), 256)
    return chosen(docs, stays.withColumnRenamed("id", "doc_id"), doc_id=F.col("doc_id").cast("long"), text_sha256=sha)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, similarity 0.8).

    A doc_id that is repeated with other texts is judged text by text; rows without one stay, equal ones once."""
    kept = near_dedup.near_duplicates(docs).where("kept").groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    return chosen(docs, kept, doc_id=F.col("doc_id").cast("long"), text_hash=F.xxhash64("text"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 ids, with the ids."""
    return packing.packed(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("near dedup", near_stage), ("packing", packing_stage)]

#: SQL can express neither the trained classifier nor MinHash components; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{scratch(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
