"""What the corpus operators share: tables, the shared folder, Arrow slices, words and connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import saved, scratch  # noqa: F401  the other modules import them from here

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
MIX = np.uint64(0xFF51AFD7ED558CCD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that a slice holds about max_bytes of the column, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        col = batch.column(at).cast(pa.binary()) if pa.types.is_string(batch.column(at).type) else batch.column(at)
        sizes = np.nan_to_num(pc.binary_length(col).to_numpy(zero_copy_only=False)).astype(np.int64)
        ends, begin = np.cumsum(sizes), 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, before + max_bytes, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def binary(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """A string column as UTF-8 bytes; null counts as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * MIX
    return x ^ (x >> np.uint64(29))


def packed(x: np.ndarray) -> bytes:
    """Integers by byte planes, compressed: the upper planes of small numbers vanish."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(x), np.uint8).reshape(8, -1).T).view("<i8").reshape(-1)


class WordHashes:
    """64-bit hashes of words, remembered for up to `most` different words of 32 bytes on average."""

    def __init__(self, most: int = 400_000):
        self.most, self.known, self.size = most, {}, 0

    def __call__(self, words: list[bytes]) -> list[int]:
        known = self.known
        if len(known) > self.most or self.size > 32 * self.most:
            known.clear()
            self.size = 0
        try:
            return [known[w] for w in words]
        except KeyError:
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
                self.size += len(w)
            return [known[w] for w in words]


_kept: dict[str, Any] = {}


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from one task to the next; one thing at a time, so that stages don't add up."""
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def word_hashes() -> WordHashes:
    return kept("word hashes", WordHashes)


def components(edges: DataFrame, label: str) -> DataFrame:
    """(id, component) for every end of the edges (a, b): the smallest id reachable.

    Each round hooks every id to its least neighbour, follows the hooks to their roots by doubling, and keeps only
    the edges between different roots, so a round works on what is not joined yet. Rounds are written tables;
    nothing but the question whether rows are left comes to the driver."""
    left = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{label}-edges")
    labels = None
    while True:
        hooks = saved(left.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")), f"{label}-hooks")
        moving = True
        while moving:
            up = hooks.select(F.col("a").alias("root"), F.col("root").alias("up"))
            step = saved(hooks.join(up, "root").select("a", F.col("up").alias("root"), (F.col("up") != F.col("root")).alias("moved")), f"{label}-hooks")
            hooks, moving = step.select("a", "root"), not step.where("moved").isEmpty()
        if labels is None:
            labels = hooks.select(F.col("a").alias("id"), F.col("root").alias("component"))
        else:
            labels = saved(labels.join(hooks.withColumnRenamed("a", "component"), "component", "left").select("id", F.coalesce("root", "component").alias("component")), f"{label}-labels")
        ends = left.join(hooks.withColumnRenamed("root", "root_a"), "a").join(hooks.select(F.col("a").alias("b"), F.col("root").alias("root_b")), "b")
        left = saved(ends.where("root_a <> root_b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), f"{label}-edges")
        if left.isEmpty():
            return labels
