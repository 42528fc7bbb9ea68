"""A token store: canonical length-limited Huffman codes over global counts, in independent blocks.

Texts are sorted by doc_id over range partitions and encoded in blocks of whole texts. The counts of all blocks give
one code of at most 20 bits, written beside them as the lengths alone. A stored block is one record: its texts, the
packed bits and a bit-offset checkpoint every `STEP` ids. A block is read by a table of 2**20 entries that gives the
id and code length at any bit position; all checkpoints of the block are decoded side by side.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, scratch, slices
from .tokens import encoder

LIMIT, STEP = 20, 128
RAW = "part long, before long, doc_ids binary, named binary, counts binary, ids binary, used binary, seen binary"
STORED = "part long, before long, n_ids long, doc_ids binary, named binary, counts binary, bits binary, marks binary"
READ = "part long, start long, doc_id long, ids binary"


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch one by one, binary values as buffers that are not copied."""
    for n in range(batch.num_rows):
        yield {c: v.as_buffer() if pa.types.is_binary(v.type) else v.as_py() for c, v in zip(batch.schema.names, (col[n] for col in batch.columns))}


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits, 0 for ids that never occur (package-merge)."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    rows, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        sort = np.argsort(both, kind="stable")
        rows.append(sort < len(weights))
        both = both[sort]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(order) - 2
    for leaf in reversed(rows):
        leaves = int(leaf[:take].sum())
        lengths[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id), each the one before plus one, shifted to its length."""
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for i in order[lengths[order] > 0]:
        code <<= int(lengths[i]) - last
        codes[i], last = code, int(lengths[i])
        code += 1
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of ids end to end, highest bit first, and the bit offset of each id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    begin, total = ends - n, int(ends[-1]) if len(ends) else 0
    wide = codes[ids] << (64 - (begin & 31) - n).astype(np.uint64)  # a code spans two 32-bit words at most
    word, words = begin >> 5, total // 32 + 2
    out = np.bincount(word, (wide >> np.uint64(32)).astype(np.float64), words)  # sums of disjoint bits are exact
    out += np.bincount(word + 1, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), words)
    return out.astype(np.uint64).astype(">u4").tobytes(), begin


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.ids, self.sizes = np.zeros(1 << LIMIT, np.uint32), np.zeros(1 << LIMIT, np.uint8)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spans = 1 << (LIMIT - lengths[order].astype(np.int64))
        filled = int(spans.sum())
        self.ids[:filled] = np.repeat(order, spans)
        self.sizes[:filled] = np.repeat(lengths[order], spans)

    def __call__(self, bits: bytes, marks: np.ndarray, n: int) -> np.ndarray:
        words = np.frombuffer(bits, ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at, out = marks.astype(np.int64), np.zeros((STEP, len(marks)), np.uint32)
        for i in range(min(STEP, n)):
            if i == n - (len(marks) - 1) * STEP:
                at = at[:-1]  # the last stretch ends here
            peek = (pairs[at >> 5] >> (64 - LIMIT - (at & 31)).astype(np.uint64)) & np.uint64((1 << LIMIT) - 1)
            out[i, : len(at)] = self.ids[peek]
            at = at + self.sizes[peek]
        return out.T.reshape(-1)[:n]


def tokenised(docs: DataFrame, tokenizer: str, end_id: int, block_ids: int, partitions: int) -> DataFrame:
    """Blocks of ids (little-endian uint32) of whole texts, in ascending doc_id order over (part, before).

    before counts the ids of the part's earlier blocks; used and seen are the block's different ids and their counts.
    Rows are ranged by doc_id and a hash of the text, so rows that share a doc_id, or have none, are no single task."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, part, before = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            nonlocal before
            doc_ids, named, counts, ids = (np.concatenate(c) for c in zip(*held))
            held.clear()
            before += len(ids)
            seen = np.bincount(ids)
            used = np.flatnonzero(seen)
            values = (part, before - len(ids), doc_ids.tobytes(), named.tobytes(), counts.tobytes(), ids.tobytes(), used.astype("<u4").tobytes(), seen[used].astype("<i8").tobytes())
            names = [c.split()[0] for c in RAW.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], names=names)

        for rows in slices(batches, "text", 1_000_000):
            ids, counts = encode_texts([t or "" for t in rows.column(1).to_pylist()])
            ids = np.insert(ids, np.cumsum(counts), end_id)
            doc_ids = rows.column(0)
            named = doc_ids.is_valid().to_numpy(zero_copy_only=False)
            held.append((doc_ids.fill_null(0).to_numpy().astype("<i8"), named, (counts + 1).astype("<i8"), ids.astype("<u4")))
            if sum(len(h[3]) for h in held) >= block_ids:
                yield row()
        if held:
            yield row()

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange(partitions, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return ordered.mapInArrow(encode, RAW)


def frequencies(blocks: DataFrame) -> np.ndarray:
    """Counts of all ids, from the blocks' own counts; one row an id and task leaves the tasks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for row in (r for batch in batches for r in rows_of(batch)):
            used, seen = np.frombuffer(row["used"], "<u4"), np.frombuffer(row["seen"], "<i8")
            if len(used) and used[-1] >= len(total):
                total = np.append(total, np.zeros(int(used[-1]) + 1 - len(total), np.int64))
            total[used] += seen
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = blocks.select("used", "seen").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row an id of the vocabulary
    out = np.zeros(max((r.id for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r.id] = r.n
    return out


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block_ids: int = 250_000) -> None:
    """Writes path/blocks (one record a block) and path/code (the code length of each id)."""
    spark = docs.sparkSession
    blocks = saved(tokenised(docs, tokenizer, end_id, block_ids, int(spark.conf.get("spark.sql.shuffle.partitions"))), "ids", compression="zstd")
    lengths = code_lengths(frequencies(blocks))
    codes = canonical(lengths)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in STORED.split(", ")]
        for row in (r for batch in batches for r in rows_of(batch)):
            ids = np.frombuffer(row["ids"], "<u4")
            bits, begin = pack_bits(ids, codes, lengths)
            values = (row["part"], row["before"], len(ids), row["doc_ids"].to_pybytes(), row["named"].to_pybytes(), row["counts"].to_pybytes(), bits, begin[::STEP].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for v in values], names=names)

    blocks.mapInArrow(encode, STORED).write.option("compression", "uncompressed").parquet(f"{path}/blocks")
    spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all texts before it) and ids of every stored text, decoded block by block."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/code").first().lengths), np.uint8)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for row in (r for batch in batches for r in rows_of(batch)):
            ids = decoder(row["bits"], np.frombuffer(row["marks"], "<u4"), row["n_ids"]).astype("<u4").tobytes()
            ends = np.concatenate([[0], np.cumsum(np.frombuffer(row["counts"], "<i8"))])
            own = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype("<i4")), pa.py_buffer(ids)])
            start = ends[:-1] + row["before"]
            doc_ids = pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=~np.frombuffer(row["named"], bool))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(start), row["part"])), pa.array(start), doc_ids, own], names=["part", "start", "doc_id", "ids"])

    stored = spark.read.schema(STORED).parquet(f"{path}/blocks")
    before, total = [], 0
    for part, n in sorted((r.part, r.n) for r in stored.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()):  # a row a partition
        before.append((part, total))
        total += n
    parts = F.broadcast(spark.createDataFrame(before, "part long, part_start long"))
    return stored.mapInArrow(decode, READ).join(parts, "part").select("doc_id", (F.col("start") + F.col("part_start")).alias("start"), "ids")


def token_digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes a store of docs in the shared folder and digests what is read back from it.

    Null texts count as empty and still have their end id; rows with equal doc_id are stored next to each other,
    those without one first; further columns are ignored; an empty table makes an empty store."""
    path = f"{scratch(docs.sparkSession)}/store-{uuid.uuid4().hex}"
    write_store(docs, path, tokenizer)
    return read_store(docs.sparkSession, path).select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
