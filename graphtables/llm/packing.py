"""Packing token ids into windows by Karmarkar-Karp multiway differencing.

Each text is cut into full windows and a rest; rests are cut into small parts. Parts are gathered until they fill
`windows` windows, and then differenced: a heap holds partial partitions (sums in descending order), the two most
unbalanced are merged with the largest sums of one on the smallest of the other, until a single one is left. If a
window exceeds the capacity, the number of windows rises and the group is differenced again.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import encoder

PACKED = "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Members of k near-equal parts. A partial partition keeps its non-empty cells, largest first."""
    heap = [(-size, i, [(size, [i])]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)
        order, b = b[1], b[2]
        lone = k - len(b)
        cells = a[:lone] + b[: max(0, k - len(a))]
        cells += [(x + y, p + q) for (x, p), (y, q) in zip(a[lone:], reversed(b[max(0, k - len(a)) :]))]
        cells.sort(key=lambda cell: -cell[0])
        heapq.heappush(heap, (-(cells[0][0] - (cells[-1][0] if len(cells) == k else 0)), order, cells))
    return [members for _, members in heap[0][2]] if heap else []


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most `capacity`, as few as differencing finds."""
    k = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, k)
        if all(sum(sizes[i] for i in members) <= capacity for members in found):
            return found
        k += 1


def packed(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 1024, part: int = 256, windows: int = 128, slack: float = 0.003) -> DataFrame:
    """One row a piece: doc_id, start, ids (little-endian uint32), doc_tokens, sequence_id, offset.

    Every id of every text (null: empty) and its end id lies in one piece; pieces of a sequence follow each other
    from offset 0 and hold at most `capacity` ids. `slack` is the share of a group left open so that near-equal
    windows fit. Groups form inside a task as rows stream by, so nothing is shuffled. Repeated rows are packed each, rows
    without a doc_id too, under a null one; an empty table gives an empty result; further columns are ignored."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sequence, waiting, held = encoder(tokenizer), TaskContext.get().partitionId() << 33, [], 0
        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array(c, pa.binary() if i == 2 else pa.int64()) for i, c in enumerate(zip(*out))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "ids", "doc_tokens", "sequence_id", "offset"])

        def close() -> None:
            nonlocal sequence, held
            for members in windows_of([len(w[2]) // 4 for w in waiting], capacity):
                offset = 0
                for i in sorted(members):
                    doc_id, start, ids, total = waiting[i]
                    out.append((doc_id, start, ids, total, sequence, offset))
                    offset += len(ids) // 4
                sequence += 1
            waiting.clear()
            held = 0

        for rows in slices(batches, "text", 2_000_000):
            ids, counts = encode([t or "" for t in rows.column(1).to_pylist()])
            ends = np.cumsum(counts)
            for doc_id, end, count in zip(rows.column(0).to_pylist(), ends.tolist(), counts.tolist()):
                own = np.append(ids[end - count : end], np.int32(end_id)).astype("<u4").tobytes()
                full = (count + 1) // capacity * capacity
                for start in range(0, full, capacity):
                    out.append((doc_id, start, own[4 * start : 4 * (start + capacity)], count + 1, sequence, 0))
                    sequence += 1
                for start in range(full, count + 1, part):
                    piece = own[4 * start : 4 * (start + part)]
                    waiting.append((doc_id, start, piece, count + 1))
                    held += len(piece) // 4
                if held >= capacity * windows * (1 - slack) - part:
                    close()
            if out:
                yield batch()
        close()
        if out:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, PACKED)


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
