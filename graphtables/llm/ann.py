"""Nearest neighbours by a block matrix join with int8 tiles and proven error bounds.

A vector x is held as scale * q + error with q in int8, and the norm of the error is kept. For two vectors
|<x, y> - sx * sy * <qx, qy>| <= |x| * ey + ex * |sy * qy|, which bounds their distance from both sides. Queries are
dealt into groups and candidates into tiles; each cell of that grid is a task, which holds the blocks of its group and
reads the blocks of its tile one after another. An int8 product tile gives bounds for all pairs of two blocks. A pair
survives when its lower bound is not above the k-th smallest upper bound its query has seen so far; survivors are
recomputed from the original floats in double precision and merged into the nearest of each query. No true neighbour
is ever lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = pa.schema([("part", pa.int32()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("codes", pa.binary()), ("facts", pa.binary())])
FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
CELL_BYTES = 2**25  # of the vectors of a group of queries, and of a tile of candidates
PAIR_BYTES = 2**23  # of the differences of surviving pairs that are taken at once


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part: a vector without null or non-finite components and not zero throughout."""
    x = F.col("embedding")
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    return vectors.select(F.col("vec_id").cast("long"), x.cast("array<double>").alias("embedding")).where(F.col("vec_id").isNotNull() & x.isNotNull()).where(sound)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """int8 codes, and rows of (scale, norm, norm of the coded vector, norm of the error)."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    norm = lambda a: np.sqrt((a * a).sum(axis=1))
    return codes, np.stack([scale, norm(x), norm(coded), norm(x - coded)], axis=1)


def blocks(vectors: DataFrame, size: int, parts: int) -> DataFrame:
    """Rows packed in blocks of at most `size` vectors of one length; the blocks of a task are dealt to `parts` parts in turn."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        part = TaskContext.get().partitionId()

        def block(dim: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            nonlocal part
            codes, facts = quantised(x)
            row = {"part": part % parts, "dim": dim, "ids": ids.tobytes(), "vectors": x.tobytes(), "codes": codes.tobytes(), "facts": facts.tobytes()}
            part += 1
            return pa.RecordBatch.from_pylist([row], BLOCK)

        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)).to_numpy()
            for dim in np.unique(lengths).tolist():
                rows = batch.filter(pa.array(lengths == dim))
                ids, x = rows.column(0).to_numpy(), rows.column(1).flatten().to_numpy().reshape(-1, dim)
                if dim in waiting:
                    ids, x = np.concatenate([waiting[dim][0], ids]), np.concatenate([waiting[dim][1], x])
                whole = len(ids) - len(ids) % size
                for at in range(0, whole, size):
                    yield block(dim, ids[at : at + size], x[at : at + size])
                waiting[dim] = ids[whole:], x[whole:]
        for dim, (ids, x) in waiting.items():
            if len(ids):
                yield block(dim, ids, x)

    return vectors.mapInArrow(build, "part int, dim int, ids binary, vectors binary, codes binary, facts binary")


def unpacked(row: dict) -> tuple[np.ndarray, ...]:
    """ids, vectors, codes and facts of a block; codes as floats in which their products are exact."""
    dim = row["dim"]
    # float32 while dim * 127 * 127 < 2**24, double beyond
    return (
        np.frombuffer(row["ids"], "<i8"),
        np.frombuffer(row["vectors"], "<f8").reshape(-1, dim),
        np.frombuffer(row["codes"], np.int8).reshape(-1, dim).astype(np.float32 if dim <= 1024 else np.float64),
        np.frombuffer(row["facts"], "<f8").reshape(-1, 4),
    )


class Asked:
    """A block of queries with the k nearest that each has met so far."""

    def __init__(self, row: dict, k: int):
        self.k = k
        self.ids, self.x, self.codes, self.facts = unpacked(row)
        self.limit = np.full(len(self.ids), np.inf)  # of the squared distance: what is surely beyond is no neighbour
        self.place = {query: i for i, query in enumerate(self.ids.tolist())}
        self.query, self.score, self.vec_id = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)

    def meet(self, c_ids: np.ndarray, c: np.ndarray, c_codes: np.ndarray, cf: np.ndarray) -> None:
        qf, limit = self.facts, self.limit
        own = [(self.place[v], j) for j, v in enumerate(c_ids.tolist()) if v in self.place]
        own = tuple(np.array(own, np.int64).reshape(-1, 2).T)
        product = (self.codes @ c_codes.T).astype(np.float64)
        product *= 2 * qf[:, :1]
        product *= cf[:, 0]
        # the squares less 1e-9 of them for the rounding of the double sums, and twice the bound, as one product
        q_side = np.stack([(1 - 1e-9) * qf[:, 1] ** 2, np.ones(len(qf)), -2 * qf[:, 1], -2 * qf[:, 3]], axis=1)
        low = q_side @ np.stack([np.ones(len(cf)), (1 - 1e-9) * cf[:, 1] ** 2, cf[:, 3], cf[:, 2]])
        low -= product
        near = ~(low > limit[:, None])
        near[own] = False
        many = np.flatnonzero(np.count_nonzero(near, axis=1) > 4 * self.k)
        if len(many) and len(cf) > self.k:
            high = low[many] + 4 * (qf[many, 1:2] * cf[:, 3] + qf[many, 3:4] * cf[:, 2]) + 2e-9 * (qf[many, 1:2] ** 2 + cf[:, 1] ** 2)
            high[~near[many]] = np.inf
            limit[many] = np.fmin(limit[many], np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
            near[many] &= ~(low[many] > limit[many, None])
        rows, cols = np.nonzero(near)
        step = max(1, PAIR_BYTES // self.x.itemsize // self.x.shape[1])
        for at in range(0, len(rows), step):
            self.add(rows[at : at + step], c[cols[at : at + step]], c_ids[cols[at : at + step]])

    def add(self, rows: np.ndarray, c: np.ndarray, c_ids: np.ndarray) -> None:
        """Merges pairs by their true distances."""
        score = np.sqrt(np.cumsum((c - self.x[rows]) ** 2, axis=1)[:, -1])  # summed in order, as anyone would
        query, score, vec_id = np.concatenate([self.query, rows]), np.concatenate([self.score, score]), np.concatenate([self.vec_id, c_ids])
        order = np.lexsort((vec_id, score, query))
        query, score, vec_id = query[order], score[order], vec_id[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        last = rank == self.k - 1
        self.limit[query[last]] = np.fmin(self.limit[query[last]], score[last] ** 2 * (1 + 1e-9))
        self.query, self.score, self.vec_id = query[rank < self.k], score[rank < self.k], vec_id[rank < self.k]

    def found(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.query]), pa.array(self.vec_id), pa.array(self.score)], schema=FOUND)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, query_block: int = 256, block: int = 1024, held: int = 65_536) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows of `vectors` for every row of `queries`, exactly.

    Score is the Euclidean distance in double precision; ties go to the smaller vec_id; a query's own vec_id is no
    candidate; fewer candidates give fewer rows. Vectors that are null, zero or hold null or non-finite components
    take no part, and vectors are compared with those of their length alone. Repeated rows are candidates each;
    repeated queries give one answer, of one of their rows. An empty table of
    queries gives an empty result, one without candidates too. Further columns are ignored.

    A task holds a group of about `held` queries, of 32 MB of vectors at most, and a tile of as many MB of candidates
    passes through it. A query is copied once for each tile and a candidate once for each group, by a shuffle: there is
    no join, whose smaller side Spark would send to all executors through the driver, as it reckons the size of the
    copies by that of the table before it was copied."""
    # rows that take no part are counted too: these numbers only decide how many tasks there are
    (count, components), (asked, of_queries) = (x.agg(F.count("*"), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first() for x in (vectors, queries))
    vectors, queries = usable(vectors), usable(queries).dropDuplicates(["vec_id"])
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    tiles = max(1, min(-(-count // (8 * block)), 4 * cores), -(-8 * components // CELL_BYTES))
    groups = max(1, -(-asked // held), -(-8 * of_queries // CELL_BYTES))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = blocks(queries.repartition(max(1, -(-asked // query_block))), query_block, groups)
    left = left.withColumn("tile", each(tiles)).select((F.col("part") * tiles + F.col("tile")).alias("cell"), F.lit(0).alias("side"), *BLOCK.names[1:])
    right = blocks(vectors, block, tiles)
    right = right.withColumn("group", each(groups)).select((F.col("group") * tiles + F.col("part")).alias("cell"), F.lit(1).alias("side"), *BLOCK.names[1:])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one cell: all blocks of queries come before those of candidates."""
        asked: dict[int, list[Asked]] = {}
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                if row["side"] == 0:
                    asked.setdefault(row["dim"], []).append(Asked(row, k))
                elif row["dim"] in asked:
                    candidates = unpacked(row)
                    for queries in asked[row["dim"]]:
                        queries.meet(*candidates)
        for queries in (q for some in asked.values() for q in some):
            yield queries.found()

    cells = left.union(right).repartitionById(groups * tiles, F.col("cell")).sortWithinPartitions("side")
    found = cells.mapInArrow(search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")  # k rows from each cell at most
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


ORACLE_SQL = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
             AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INTEGER AS rank, vec_id, score FROM d)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
