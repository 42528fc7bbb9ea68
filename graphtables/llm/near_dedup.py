"""MinHash near-dedup with b-bit signatures.

Every text becomes its set of distinct word shingles. Band keys over the minima propose candidates; only the low
bits of the minima are kept, packed in bit planes, and a bit count gives a collision-corrected similarity that
decides which pairs are worth an exact comparison of the full sets.

Texts with the same words are folded into one vertex first. Band buckets are joined as stars around their smallest
vertex, so a bucket of m texts makes m - 1 rows; the connected components of the stars are families. The first
quarter of the bands joins most of a family, and later bands only see which families still differ.

A family of up to `block` texts is compared as a whole. A larger one is dealt in blocks, each of which also gets the
family's pivots, about sixteen of its texts, which tie the blocks together: a group of near copies, however large, is
one cluster after this single pass. Where a large family is still in several clusters, the texts outside of its largest
cluster are compared with all others, in tiles. A family of more than `tiled` blocks would make too many tiles: there
the same is done within each band bucket, as texts that share no band key are no candidates.
No comparison returns more links than connect what it has compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, WordHashes, binary, components, mixed, saved, slices, word_hashes

SLICE = 4_000_000
PIVOTS, BOTH = 16, 2
SIGNED = "doc_id long, text_hash long, digest binary, n_shingles long, planes binary, bands array<long>"


def shingle_sets(texts: list[bytes], width: int, hashes: WordHashes) -> tuple[list[np.ndarray], list[bytes]]:
    """For each text the sorted distinct 64-bit hashes of its shingles, and a digest of its word sequence."""
    weights = mixed(np.arange(1, width + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    sets, digests = [], []
    for text in texts:
        words = text.translate(LOWER).split()
        digests.append(blake2b(b" ".join(words), digest_size=16).digest())
        h, n = np.array(hashes(words), dtype=np.uint64), min(width, len(words))
        if not n:
            sets.append(h)
            continue
        s = h[: len(h) - n + 1] * weights[0]
        for k in range(1, n):
            s = s + h[k : len(h) - n + 1 + k] * weights[k]
        sets.append(np.unique(mixed(s + np.uint64(n))))
    return sets, digests


class MinHasher:
    """bands x rows minima of a set; band keys and the low `bits` bits of each minimum as bit planes."""

    def __init__(self, bands: int, rows: int, bits: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits, k = bands, rows, bits, bands * rows
        self.a = (rng.integers(1, 2**32, k, dtype=np.uint64) | 1).astype(np.uint32)[:, None]
        self.b = rng.integers(0, 2**32, k, dtype=np.uint64).astype(np.uint32)[:, None]
        self.fold = rng.integers(1, 2**63, rows, dtype=np.uint64) | np.uint64(1)
        self.salt = rng.integers(1, 2**63, bands, dtype=np.uint64)
        self.work = np.empty((k, 1024), dtype=np.uint32)

    def minima(self, hashes: np.ndarray) -> np.ndarray:
        h, low = (hashes >> np.uint64(32)).astype(np.uint32), None
        for i in range(0, len(h), 1024):
            part = h[i : i + 1024]
            work = np.multiply(self.a, part, out=self.work[:, : len(part)])
            work += self.b
            least = work.min(axis=1)
            low = least if low is None else np.minimum(low, least)
        return low

    def keys(self, minima: np.ndarray) -> np.ndarray:
        return mixed((mixed(minima.astype(np.uint64).reshape(self.bands, self.rows)) * self.fold).sum(axis=1, dtype=np.uint64) + self.salt).view(np.int64)

    def planes(self, minima: np.ndarray) -> bytes:
        return b"".join(np.packbits((minima >> np.uint32(bit)) & np.uint32(1)).tobytes() for bit in range(self.bits))


def similarity(one: np.ndarray, many: np.ndarray, k: int) -> np.ndarray:
    """Collision-corrected Jaccard estimates. one: (bits, words), many: (n, bits, words), as uint64 bit planes."""
    differ = np.bitwise_or.reduce(many ^ one, axis=1)
    agree = 1 - np.bitwise_count(differ).sum(axis=1) / k
    chance = 0.5 ** many.shape[1]
    return (agree - chance) / (1 - chance)


def signatures(docs: DataFrame, width: int, bands: int, rows: int, bits: int) -> DataFrame:
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, hashes = MinHasher(bands, rows, bits), word_hashes()
        for part in slices(batches, "text", SLICE):
            sets, digests = shingle_sets(binary(part, "text"), width, hashes)
            minima = [hasher.minima(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array(digests, pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([m if m is None else hasher.planes(m) for m in minima], pa.binary()),
                    pa.array([m if m is None else hasher.keys(m) for m in minima], pa.list_(pa.int64())),
                ],
                names=["doc_id", "text_hash", "digest", "n_shingles", "planes", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text")).mapInArrow(sign, SIGNED)


class Clusters:
    """Which texts of a group are linked already; equal labels are."""

    def __init__(self, labels: np.ndarray):
        self.root = np.unique(labels, return_inverse=True)[1]

    def apart(self, i: int, others: np.ndarray) -> np.ndarray:
        return others[self.root[others] != self.root[i]]

    def link(self, i: int, j: int) -> None:
        self.root[self.root == self.root[j]] = self.root[i]


def links_within(rows: dict[str, np.ndarray], sets: list[np.ndarray], percent: int, k: int, margin: float, small: int) -> Iterator[tuple[int, int]]:
    """Pairs of one group that hold on the full sets, enough to connect what is connected.

    Texts are compared across sides; a text of side BOTH is compared with every other."""
    side, planes, sizes = rows["side"], rows["planes"], np.array([len(s) for s in sets])
    clusters, full = Clusters(rows["cluster"]), {}
    for i in range(len(sets) - 1):
        js = clusters.apart(i, np.arange(i + 1, len(sets)))
        js = js[(side[js] != side[i]) | (side[js] == BOTH) | (side[i] == BOTH)]
        js = js[100 * np.minimum(sizes[js], sizes[i]) >= percent * np.maximum(sizes[js], sizes[i])]
        if not len(js):
            continue
        near = similarity(planes[i], planes[js], k)
        order = np.argsort(-near, kind="stable")
        for j in js[order[(near[order] >= percent / 100 - margin) | (sizes[js[order]] <= small)]].tolist():
            if clusters.root[i] != clusters.root[j]:
                for x in (i, j):
                    if x not in full:
                        full[x] = frozenset(sets[x].tolist())
                both = len(full[i] & full[j])
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    yield i, j
                    clusters.link(i, j)


def confirmed(dealt: DataFrame, width: int, percent: int, k: int, margin: float, small: int) -> DataFrame:
    """Links (a, b) among the vertices of each group and tile; dealt: group, tile, family, v, side, cluster, digest, planes, text.

    A group may hold several families. Texts have come by doc_id and a hash; the digest tells whether they are meant."""

    def links(group: pd.DataFrame) -> pd.DataFrame:
        sets, digests = shingle_sets([t or b"" for t in group["text"]], width, word_hashes())
        group["at"] = np.arange(len(group))
        group = group[[d == bytes(e) for d, e in zip(digests, group["digest"])]].sort_values(["family", "v", "side"], ignore_index=True)
        group = group.drop_duplicates(["family", "v", "side"], ignore_index=True)
        twice = group.duplicated(["family", "v"], keep=False)
        group.loc[twice, "side"] = BOTH
        group = group.drop_duplicates(["family", "v"], ignore_index=True)
        if group.empty:
            return pd.DataFrame([], columns=["a", "b"], dtype="int64")
        planes = np.frombuffer(b"".join(group["planes"]), np.uint8).reshape(len(group), -1, k // 8).view(np.uint64)
        columns = {c: group[c].to_numpy() for c in ("v", "side", "cluster", "at", "family")} | {"planes": planes}
        found, edges = [], np.flatnonzero(np.append(True, columns["family"][1:] != columns["family"][:-1]))
        for begin, end in zip(edges.tolist(), [*edges[1:].tolist(), len(group)]):
            own = {c: x[begin:end] for c, x in columns.items()}
            ids = own["v"].tolist()
            found += [(ids[i], ids[j]) for i, j in links_within(own, [sets[at] for at in own["at"]], percent, k, margin, small)]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    columns = ("group", "tile.*", "family", "v", "side", "cluster", "digest", "planes", "text")
    return dealt.select(*columns).groupBy("group", "i", "j").applyInPandas(links, "a long, b long")


def stars(texts: DataFrame) -> DataFrame:
    """Edges (a, b) from all that share a band key to the smallest among them, where they are not the same already."""
    keyed = texts.select("v", F.explode("bands").alias("key"))
    least = keyed.groupBy("key").agg(F.min("v").alias("b"), F.max("v").alias("most")).where("b < most").select("key", "b")
    return keyed.join(least, "key").where("v > b").select(F.col("v").alias("a"), "b").distinct()


def families_of(texts: DataFrame, first: int, bands: int) -> DataFrame:
    """(id, component) of every text that shares a band key with another, whatever links them over."""
    found = components(stars(texts.select("v", F.slice("bands", 1, first).alias("bands"))), "near-family")
    later = texts.join(found.withColumnRenamed("id", "v"), "v", "left").select(F.coalesce("component", "v").alias("v"), F.slice("bands", first + 1, bands).alias("bands"))
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(stars(later)), "near-family")


def whole_families(members: DataFrame, n: int, block: int) -> DataFrame:
    """Groups of about `block` texts: small families many to a group, blocks of a large one with its pivots."""
    large = F.col("blocks") > 1
    pivot = F.pmod(F.xxhash64("v", F.lit("pivot")), F.col("blocks") * max(1, block // PIVOTS)) == 0  # PIVOTS texts of a family on average
    own = F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int")
    pack = F.pmod(F.xxhash64("family"), F.lit(-(-n // block)))
    tile = F.when(large & pivot, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    return members.select(
        F.when(large, F.col("family")).otherwise(pack).alias("group"),
        F.explode(F.transform(tile, lambda x: F.struct(F.when(large, x).otherwise(-1).alias("i"), F.lit(0).alias("j")))).alias("tile"),
        *("family", "v", F.lit(BOTH).alias("side"), F.col("v").alias("cluster"), "digest", "planes", "text"),
    )


def divided(members: DataFrame, linked: DataFrame, block: int) -> DataFrame:
    """Tiles of the buckets that hold several clusters: texts outside of the largest cluster against all.

    members: v, digest, planes, text, buckets; linked: id, component of what is known to be linked."""
    labelled = members.join(linked.withColumnRenamed("id", "v"), "v", "left").withColumn("cluster", F.coalesce("component", "v"))
    keyed = labelled.select("v", "cluster", F.explode("buckets").alias("family"))
    counts = keyed.groupBy("family", "cluster").agg(F.count("*").alias("n"))
    buckets = counts.groupBy("family").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("core"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("rest")).where("rest > 0")
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    rows = keyed.join(buckets, "family").select("family", "v", "cluster", (F.col("cluster") != F.col("core")).alias("apart"), blocks("n").alias("all"), blocks("rest").alias("rests"))
    place = lambda n: F.pmod(F.xxhash64("v", F.lit(n)), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = F.transform(upto("rests"), lambda i: F.struct(i.alias("i"), place("all").alias("j"), F.lit(0).alias("side")))
    two = F.transform(upto("all"), lambda j: F.struct(place("rests").alias("i"), j.alias("j"), F.lit(1).alias("side")))
    dealt = rows.select("family", "v", "cluster", F.explode(F.when(F.col("apart"), F.concat(one, two)).otherwise(one)).alias("t"))
    tiles = dealt.select(F.col("family").alias("group"), F.struct("t.i", "t.j").alias("tile"), "family", "v", "t.side", "cluster")
    return tiles.join(members.select("v", "digest", "planes", "text"), "v")


def joined(linked: DataFrame, more: DataFrame) -> DataFrame:
    """linked (id, component) after further links (a, b): only the components that they touch are worked on."""
    if more.isEmpty():
        return linked
    named = lambda c: linked.select(F.col("id").alias(c), F.col("component").alias(f"of_{c}"))
    edges = more.join(named("a"), "a", "left").join(named("b"), "b", "left").select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b"))
    found = components(edges, "near-joined")
    moved = linked.join(found.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    return saved(moved.union(found.join(linked, "id", "left_anti").select("id", "component")), "near-linked")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 64, rows: int = 8, bits: int = 2, block: int = 256, margin: float = 0.15, small: int = 64, tiled: int = 16) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept, text_hash.

    A link: 100 * |A and B| >= percent * |A or B| on the full shingle sets. With 64 bands of 8 rows a pair at
    0.8 is missed by all bands with a chance of 8e-6; `margin` is six standard deviations of the estimate there. Sets
    of up to `small` shingles have few different minima, so the estimate wavers: those are compared in full at once.
    Null texts and texts without words have empty sets and link with nothing. Fewer words than `width` make one
    shingle. Equal texts are one vertex, so copies are never expanded into pairs. A doc_id that is repeated with
    another text is a row of its own with its own links; a row without doc_id links with nothing, has a null
    component_id and is kept; an empty table gives an empty result; further columns are ignored."""
    signed = saved(signatures(docs, width, bands, rows, bits), "near-signed")
    different = signed.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min_by(F.struct("doc_id", "text_hash", "planes", "bands"), F.struct("doc_id", "text_hash")).alias("s"))
    texts = saved(different.select(F.monotonically_increasing_id().alias("v"), "digest", "s.*"), "near-texts")
    first = max(1, bands // 4)
    families = families_of(texts, first, bands)
    sizes = families.groupBy(F.col("component").alias("family")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("n"), F.lit(0)).alias("most")).first()
    members = families.select(F.col("id").alias("v"), F.col("component").alias("family")).join(sizes, "family").withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    wording = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    wording = wording.where("doc_id IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))  # rows may repeat
    members = saved(members.drop("n").join(texts, "v").join(wording, ["doc_id", "text_hash"]).drop("doc_id", "text_hash"), "near-members", compression="zstd")
    check = lambda dealt: confirmed(dealt, width, percent, bands * rows, margin, small)
    linked = components(check(whole_families(members.drop("bands"), max(1, total.n), block)), "near-linked")
    if total.most > block:
        large, kept = members.where("blocks > 1"), ("v", "digest", "planes", "text")
        passes = [large.where(F.col("blocks") <= tiled).select(*kept, F.array("family").alias("buckets"))]
        if total.most > block * tiled:
            passes += [large.where(F.col("blocks") > tiled).select(*kept, F.slice("bands", begin, n).alias("buckets")) for begin, n in ((1, first), (first + 1, bands - first)) if n]
        for part in passes:
            linked = joined(linked, saved(check(divided(part, linked, block)), "near-links"))
    named = texts.select("digest", "v", "doc_id").join(linked.withColumnRenamed("id", "v"), "v", "left")
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("doc_id").alias("least"))
    classes = named.join(least, "component", "left").select("digest", F.coalesce("least", "doc_id").alias("component_id"))
    return (
        signed.select("doc_id", "n_shingles", "text_hash", "digest")
        .join(classes, "digest", "left")
        .select("doc_id", "n_shingles", "text_hash", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
        .select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "text_hash")
    )
