"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; in local mode alone a temporary one if unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def saved(df: DataFrame, label: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession, rows: int, each: int = 200_000) -> int:
    """Into how many parts so many rows are to be dealt by `repartition`, whose number Spark keeps: adaptive execution merges
    other shuffles until a task has 64 MB of compressed rows, which it then sorts or hashes at a multiple of that size.

    About `each` rows a part, but at least one for each core. At most 200, or the session's own number if that is larger: up
    to 200 are written as rows come, beyond that a task collects and sorts them first. From half of the most on it is the
    most, as a join deals a number just below the session's anew."""
    most = max(200, int(spark.conf.get("spark.sql.shuffle.partitions") or 200))
    wanted = max(spark.sparkContext.defaultParallelism, -(-rows // each))
    return wanted if 2 * wanted < most else most
