"""Exact dedup by deterministic block naming, in DataFrame operations alone.

A normalised text is cut into blocks of fixed size. Distinct blocks are sorted and numbered; each pair of adjacent
numbers is then sorted and numbered in turn, so the numbers of a text halve every round until one is left. Two
texts get the same last number in the same round if and only if they are equal: names never collide, whatever the
texts are. A text whose (length, 64-bit hash) nobody shares differs from every other text and needs no name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

WHITE = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def named(keys: DataFrame, label: str) -> DataFrame:
    """The distinct rows of keys in sorted order, each with an integer name.

    Ranges are cut by a short head and a hash, so that sampling them never carries whole blocks to the driver."""
    first = F.col(keys.columns[0])
    head = [F.substring(first.cast("string"), 1, 16), F.xxhash64(*keys.columns)]
    ordered = keys.distinct().repartitionByRange(*head).sortWithinPartitions(*head, *keys.columns)
    return saved(ordered.withColumn("name", F.monotonically_increasing_id()), label)


def identities(texts: DataFrame, block: int) -> DataFrame:
    """(doc_id, sha, level, name) for texts (doc_id, sha, norm): equal (level, name) means equal text."""
    cut = F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block}}}"), F.lit(0))
    blocks = saved(texts.select("doc_id", "sha", cut.alias("cut")).select("doc_id", "sha", F.size("cut").alias("n"), F.posexplode("cut").alias("pos", "block")), "exact-blocks")
    rows = saved(blocks.join(named(blocks.select("block"), "exact-names"), "block").select("doc_id", "sha", "n", "pos", "name"), "exact-level")
    done, level = [], 0
    while True:
        done.append(rows.where("n = 1").select("doc_id", "sha", F.lit(level).alias("level"), "name").distinct())
        longer = rows.where("n > 1")
        if longer.isEmpty():
            break
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = saved(
            longer.groupBy("doc_id", "sha", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.floor(F.col("pos") / 2).cast("int").alias("pos")).agg(side(0).alias("one"), F.coalesce(side(1), F.lit(-1)).alias("two")),
            "exact-pairs",
        )
        rows = saved(pairs.join(named(pairs.select("one", "two"), "exact-names"), ["one", "two"]).select("doc_id", "sha", "n", "pos", "name"), "exact-level")
        level += 1
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def exact_duplicates(docs: DataFrame, block: int = 4096) -> DataFrame:
    """One row a row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting white space (space and U+0009 to U+000D); null counts as empty and
    empty texts equal each other. The row with the most code points in its original text stays, then the smallest
    doc_id. A row that repeats another's doc_id and text is counted in group_size and marked as the other is. A row
    without doc_id can't name what stays: it is kept as a group of its own, with a null keep_id.
    Further columns are ignored; an empty table gives an empty result."""
    text = docs.select(F.col("doc_id").cast("long"), "text").withColumn("norm", normalised(F.col("text")))
    text = text.withColumn("sha", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)))
    slim = saved(
        text.select("doc_id", "sha", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("points"), F.length("norm").alias("size"), F.xxhash64("norm").alias("print")),
        "exact-slim",
    )
    shared = saved(slim.groupBy("size", "print").agg(F.count("*").alias("copies")).where("copies > 1 AND size > 0").select("size", "print"), "exact-shared")
    candidates = slim.join(shared, ["size", "print"]).select("doc_id").distinct()
    names = identities(text.select("doc_id", "sha", "norm").join(candidates, "doc_id"), block)
    empty = (F.col("size") == 0) & F.col("doc_id").isNotNull()
    members = saved(
        slim.join(names, ["doc_id", "sha"], "left").select("doc_id", "sha", "points", F.when(empty, F.lit(-1)).otherwise(F.col("level")).alias("level"), F.when(empty, F.lit(0)).otherwise(F.col("name")).alias("name")),
        "exact-members",
    )
    grouped = members.where("level IS NOT NULL")
    groups = saved(
        grouped.groupBy("level", "name").agg(F.count("*").alias("group_size"), (-F.max(F.struct("points", (-F.col("doc_id")).alias("id")))["id"]).alias("keep_id")),
        "exact-groups",
    )
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = members.where("level IS NULL").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
    return grouped.join(groups, ["level", "name"]).select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), sha).union(alone)


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""
