"""Resharding by minimum-cost flow.

Rows lie in old shards. Every shard gets the same capacity in bytes, and a minimum-cost flow from old sizes to new
capacities says how many bytes each pair of shards exchanges; a byte that stays costs nothing, so the fewest bytes
move. Bytes move as blocks: rows of a shard fall into `cells` blocks by their text, so equal texts move together. A
block of more than a quarter of a shard, such as a hot text makes, falls into `parts` by doc_id. Only the table of
blocks comes to the driver: its size follows the number of cells, not of rows.

A shard's files lie in folders of some blocks each, and a row carries its place within its block. The folders that
lose blocks are rewritten without them, the blocks that move become new files of their new shard, and all other files
stay as they are: the plan, a row a block, tells where a block belongs and at which slot it begins.
"""

from __future__ import annotations

import bisect
import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK = ["old_shard", "cell", "part"]
STORED = "doc_id long, text string, cell int, part int, place long, old_shard int, folder int"


def flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> dict[tuple[int, int], int]:
    """Minimum-cost flow from supplies to capacities (of at least their sum) by successive shortest paths."""
    n, m = len(supply), len(capacity)
    sent: dict[tuple[int, int], int] = defaultdict(int)
    left, room, height = list(supply), list(capacity), [0] * (n + m)
    while any(left):
        distance = [0 if i < n and left[i] else float("inf") for i in range(n + m)]
        came: list[int | None] = [None] * (n + m)
        heap = [(0, i) for i in range(n) if left[i]]
        goal = None
        while heap:
            d, u = heapq.heappop(heap)
            if d > distance[u]:
                continue
            steps = ((n + j, cost[u][j]) for j in range(m)) if u < n else ((i, -cost[i][u - n]) for i in range(n) if sent.get((i, u - n)))
            for w, c in steps:
                new = d + c + height[u] - height[w]
                if new < distance[w]:
                    distance[w], came[w] = new, u
                    heapq.heappush(heap, (new, w))
        goal = min((j for j in range(n, n + m) if room[j - n]), key=lambda j: distance[j] + height[j])
        top = max(d for d in distance if d < float("inf"))
        height = [h + min(d, top) for h, d in zip(height, distance)]
        path, v = [goal], goal
        while came[v] is not None:
            v = came[v]
            path.append(v)
        path.reverse()
        amount = min(left[path[0]], room[goal - n], *(sent[(path[i + 1], path[i] - n)] for i in range(1, len(path) - 1, 2)))
        for i in range(len(path) - 1):
            a, b = path[i], path[i + 1]
            if a < n:
                sent[(a, b - n)] += amount
            else:
                sent[(b, a - n)] -= amount
        left[path[0]] -= amount
        room[goal - n] -= amount
    return {pair: amount for pair, amount in sent.items() if amount}


Units = list[tuple[int, list[tuple[int, int, int]]]]


def moves(blocks: dict[tuple[int, int, int], int], shards: int) -> dict[tuple[int, int, int], int]:
    """Block -> new shard. A cell moves whole; one larger than a quarter of a shard moves by its parts.

    Blocks follow the flow to whichever destination has room for them. What the flow leaves over, less than a block for
    each pair of shards, is levelled by blocks that move anyway, and only then by others."""
    total, cells = sum(blocks.values()), defaultdict(list)
    for b in sorted(blocks):
        cells[b[:2]].append(b)
    units: Units = []
    for own in cells.values():
        whole = sum(blocks[b] for b in own)
        units += [(blocks[b], [b]) for b in own] if 4 * whole * shards > total else [(whole, own)]
    units.sort(key=lambda u: (-u[0], u[1]))
    n = max([shards, *(b[0] + 1 for b in blocks)])
    old = [0] * n
    for size, own in units:
        old[own[0][0]] += size
    capacity = [total // shards + (s < total % shards) for s in range(shards)]
    room = flow(old, capacity, [[int(i != j) for j in range(shards)] for i in range(n)])
    held: list[Units] = [[] for _ in range(shards)]
    homeless: Units = []
    for size, own in units:  # largest first
        i = own[0][0]
        to = max((j for j in range(shards) if j != i and room.get((i, j), 0) >= size), key=lambda j: room[(i, j)], default=None)
        if to is not None:
            room[(i, to)] -= size
            held[to].append((size, own))
        elif i < shards:
            held[i].append((size, own))
        else:
            homeless.append((size, own))
    for size, own in homeless:  # of shards that are given up
        held[min(range(shards), key=lambda s: sum(x[0] for x in held[s]))].append((size, own))
    strangers = [[u for u in own if u[1][0][0] != s] for s, own in enumerate(held)]
    natives = [[u for u in own if u[1][0][0] == s] for s, own in enumerate(held)]
    level(strangers, [sum(u[0] for u in own) for own in natives])
    held = [a + b for a, b in zip(strangers, natives)]
    level(held, [0] * shards, total // shards // 400)  # files that nothing leaves stay, if that costs no more than a quarter of a percent
    return {b: s for s in range(shards) for _, own in held[s] for b in own}


def level(held: list[Units], fixed: list[int], enough: int = 0) -> None:
    """A full shard hands one of the held blocks to the emptiest while that narrows a gap of more than `enough` bytes;
    `fixed` bytes stay in each. Every step lowers the sum of squared sizes, so the steps come to an end."""
    for own in held:
        own.sort()
    sizes = [f + sum(x[0] for x in own) for f, own in zip(fixed, held)]
    while True:
        low = min(range(len(sizes)), key=sizes.__getitem__)
        if max(sizes) - sizes[low] <= enough:
            return
        for full in sorted(range(len(sizes)), key=lambda s: -sizes[s]):  # one that holds a single huge row can't help
            gap = sizes[full] - sizes[low]
            at = bisect.bisect(held[full], (gap / 2,))
            near = [i for i in (at - 1, at) if 0 <= i < len(held[full]) and 0 < held[full][i][0] < gap]
            if near:
                break
        else:
            return
        unit = held[full].pop(min(near, key=lambda i: abs(held[full][i][0] - gap / 2)))
        bisect.insort(held[low], unit)
        sizes[full] -= unit[0]
        sizes[low] += unit[0]


def moved_bytes(blocks: dict[tuple[int, int, int], int], placed: dict[tuple[int, int, int], int], shards: int) -> tuple[int, int]:
    """Bytes that a plan moves, and the fewest that any plan to equal shards could: what lies beyond the capacities."""
    total, old = sum(blocks.values()), defaultdict(int)
    for b, size in blocks.items():
        old[b[0]] += size
    least = sum(max(0, size - (total // shards + (s < total % shards) if s < shards else 0)) for s, size in old.items())
    return sum(size for b, size in blocks.items() if placed[b] != b[0]), least


class Layout:
    """A table in shard folders path/old, and after `rewrite` also path/new."""

    def __init__(self, spark: SparkSession, path: str, shards: int, cells: int, parts: int):
        self.spark, self.path, self.shards, self.parts = spark, path.rstrip("/"), shards, parts
        self.folders = max(8, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // shards))  # of one shard; more, if it has large cells
        self.cells = max(cells, self.folders)
        self.blocks: dict[tuple[int, int, int], tuple[int, int]] = {}
        self.large: set[tuple[int, int]] = set()

    def folder(self, block: tuple[int, int, int]) -> int:
        return self.folders + block[2] if block[:2] in self.large else block[1] % self.folders

    def write(self, docs: DataFrame, old_shard: Column | None = None) -> None:
        """Writes doc_id and text of docs into their old shards, by default a hash of the text, and counts the blocks."""
        text = F.coalesce(F.col("text"), F.lit(""))
        h = F.xxhash64(text)
        rows = docs.select(
            F.col("doc_id").cast("long"),
            "text",
            (F.octet_length(text).cast("long") + 16).alias("size"),
            (F.pmod(h, F.lit(self.shards)) if old_shard is None else old_shard).cast("int").alias("old_shard"),
            F.pmod(F.shiftright(h, 20), F.lit(self.cells)).cast("int").alias("cell"),
        ).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(self.parts)).cast("int"))
        measures = F.sum("size").alias("bytes"), F.count("*").alias("n")
        cells = rows.groupBy("old_shard", "cell").agg(*measures).collect()  # a row a cell
        total = sum(r.bytes for r in cells)
        self.large = {(r.old_shard, r.cell) for r in cells if 4 * r.bytes * self.shards > total}  # at most 4 * shards
        split = F.broadcast(self.spark.createDataFrame([(*c, True) for c in sorted(self.large)], "old_shard int, cell int, large boolean"))
        self.blocks = {(r.old_shard, r.cell, 0): (r.bytes, r.n) for r in cells if (r.old_shard, r.cell) not in self.large}
        if self.large:
            self.blocks |= {(r.old_shard, r.cell, r.part): (r.bytes, r.n) for r in rows.join(split, ["old_shard", "cell"]).groupBy(*BLOCK).agg(*measures).collect()}  # a row a part
        folder = F.when(F.col("large"), self.folders + F.col("part")).otherwise(F.pmod("cell", F.lit(self.folders)))
        rows = rows.join(split, ["old_shard", "cell"], "left").withColumn("folder", folder).withColumn("part", F.when(F.col("large"), F.col("part")).otherwise(0))
        within = Window.partitionBy("old_shard", "folder", "cell", "part").orderBy("doc_id", "text")
        dealt = rows.repartition("old_shard", "folder").withColumn("place", F.row_number().over(within) - 1)
        dealt.select("doc_id", "text", "cell", "part", "place", "old_shard", "folder").write.partitionBy("old_shard", "folder").option("compression", "zstd").parquet(f"{self.path}/old")

    def read(self, folders: list[tuple[int, int]]) -> DataFrame:
        paths = [f"{self.path}/old/old_shard={s}/folder={f}" for s, f in folders]
        reader = self.spark.read.schema(STORED)
        return reader.option("basePath", f"{self.path}/old").parquet(*paths) if paths else self.spark.createDataFrame([], STORED)

    def rewrite(self) -> DataFrame:
        """Moves blocks; doc_id, text, size, slot, shard and old_shard of all rows, from the files that stay and the new ones."""
        placed = moves({b: size for b, (size, _) in self.blocks.items()}, self.shards)
        used, plan = [0] * self.shards, []
        for b in sorted(placed):
            plan.append((*b, placed[b], used[placed[b]]))
            used[placed[b]] += self.blocks[b][1]
        plan = F.broadcast(self.spark.createDataFrame(plan, "old_shard int, cell int, part int, shard int, first long"))  # a row a block
        every = {(b[0], self.folder(b)) for b in placed}
        self.touched = sorted({(b[0], self.folder(b)) for b, to in placed.items() if to != b[0]})
        stay = self.read(sorted(every.difference(self.touched))).join(plan, BLOCK)
        size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
        columns = ["doc_id", "text", size.alias("size"), (F.col("first") + F.col("place")).alias("slot"), "shard", "old_shard"]
        if not self.touched:
            return stay.select(*columns)
        again = self.read(self.touched).join(plan, BLOCK).repartition("shard", "folder")
        again.select("doc_id", "text", "cell", "part", "place", "old_shard", "folder", "shard").write.partitionBy("shard", "folder").option("compression", "zstd").parquet(f"{self.path}/new")
        new = self.spark.read.schema(f"{STORED}, shard int").parquet(f"{self.path}/new").drop("shard").join(plan, BLOCK)
        return stay.select(*columns).union(new.select(*columns))


def resharded(docs: DataFrame, path: str, shards: int = 40, cells: int = 256, parts: int = 256, old_shard: Column | None = None) -> DataFrame:
    """Lays docs out in their old shards, reshards them to near-equal bytes, and returns what the files hold.

    Returns doc_id, text, size, slot, shard, old_shard. A row weighs its text's UTF-8 bytes (null: none) plus 16. Slots are
    gapless from 0 in each shard, in order of block and doc_id. Equal texts of an old shard lie in one shard unless their
    block exceeds a quarter of a shard. Without `old_shard` a row's old shard is the hash of its text. Repeated rows are
    rows of their own, those without a doc_id too; columns besides doc_id and text stay out; an empty table gives an empty result."""
    layout = Layout(docs.sparkSession, path, shards, cells, parts)
    layout.write(docs, old_shard)
    return layout.rewrite()


def digest(stored: DataFrame) -> DataFrame:
    """Digest of what the shard files hold; no row has a grown shard under the law `bytes`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 16
    return stored.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
