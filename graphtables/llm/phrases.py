"""Phrase collocation mining by SETM: relations of occurrences, merge-joined by piece and adjacent position.

Texts become chunks: for each language of a slice of texts, an occurrence relation sorted by piece and position. It is
held as a dense array, one entry a position with the number of the chunk's gram that begins there, or 0; a 0 stands
between pieces too, so that equal pieces and adjacent positions are neighbours in it. One length after the other:

* group-count: each chunk deals its different grams to spans by a hash, and one group adds up a span over all chunks,
* semi-join: the group answers each chunk in the chunk's own order, the number of each frequent gram, 0 for the others,
* merge-join: neighbours that both survive make the occurrences of the next length, written as the next relation.

A gram longer than a word is a pair of numbers, of the grams that it begins and ends with, so it can only be frequent
where both are. Words are compared as they are, and no count is cut off. What travels are sorted, packed arrays; a gram
occurs in a group once for each chunk, however frequent it is. There are never more rows than grams of chunks, as a
row holds one at least, and the number of spans grows with the grams, so a group does not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mixed, packed, saved, slices, unpacked

#: Bytes of UTF-8 texts: A-Z in lower case, and ends of pieces as a byte that UTF-8 never has.
BREAK = b"\xff"
CUT = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + BREAK * 10)
RELATION = "chunk long, lang string, positions long, places binary, first binary, second binary, n binary, grams long"
DEALT = "lang string, span long, chunk long, first binary, second binary, n binary"
COUNTED = "lang string, span long, chunk long, reply binary, number long, word string, p long, s long, f long"
LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def packed_pairs(p: np.ndarray, s: np.ndarray) -> tuple[bytes, bytes]:
    """Pairs sorted by both: differences, of the second ones within runs of equal first ones."""
    step = np.diff(p, prepend=0)
    return packed(step), packed(np.where(step == 0, np.diff(s, prepend=0), s))


def unpacked_pairs(first: bytes, second: bytes) -> tuple[np.ndarray, np.ndarray]:
    step, s = unpacked(first), unpacked(second)
    if not len(step):
        return step, s
    sums, begins = np.cumsum(s), np.flatnonzero(np.append(True, step[1:] != 0))
    before = np.append(0, sums)[begins]
    return np.cumsum(step), sums - np.repeat(before, np.diff(np.append(begins, len(s))))


def narrowed(places: np.ndarray) -> np.ndarray:
    """The relation with one 0 in place of many: what was adjacent stays so, and nothing else becomes so."""
    held = places > 0
    return places[held | np.append(True, held[:-1])]


def words(docs: DataFrame, chunk_bytes: int) -> DataFrame:
    """Occurrences of words: chunks of whole texts of one language, with the words (first) and how often each occurs."""
    schema = arrow(RELATION)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for rows in slices(batches, "text", chunk_bytes):
            texts: dict[str, list[bytes]] = {}
            for lang, text in zip(rows.column(0).to_pylist(), rows.column(1).cast(pa.binary()).to_pylist()):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                found = BREAK.join(own).translate(CUT).replace(BREAK, b" \xff ").split()
                encoded = pa.array(found, pa.binary()).dictionary_encode()
                del found
                ids, vocabulary = encoded.indices.to_numpy().astype(np.int64) + 1, encoded.dictionary.to_pylist()
                if BREAK in vocabulary:  # its number goes to the breaks, and the others close up
                    at = vocabulary.index(BREAK) + 1
                    ids = np.where(ids == at, 0, ids - (ids > at))
                    del vocabulary[at - 1]
                if vocabulary:
                    n = np.bincount(ids, minlength=len(vocabulary) + 1)[1:]
                    row = [number, lang, int(n.sum()), packed(narrowed(ids)), zstandard.compress(BREAK.join(vocabulary), 1), None, packed(n), len(n)]
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)
                    number += 1

    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(build, RELATION)


def spans_of(row: dict, spans: int) -> tuple[np.ndarray, list[bytes] | None, np.ndarray | None, np.ndarray | None]:
    """The span of each of a chunk's grams, and the grams: words, or pairs of numbers."""
    if row["second"] is None:
        own = zstandard.decompress(row["first"]).split(BREAK)
        return np.array([xxhash.xxh3_64_intdigest(w) for w in own], np.uint64) % np.uint64(spans), own, None, None
    p, s = unpacked_pairs(row["first"], row["second"])
    return mixed(p.astype(np.uint64) * LEFT + s.astype(np.uint64) * RIGHT) % np.uint64(spans), None, p, s


def dealt(relation: DataFrame, spans: int) -> DataFrame:
    """A row for each chunk and span: the chunk's grams of the span, in the chunk's order, and their counts."""
    schema = arrow(DEALT)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for r in batch.to_pylist()):
            span, own, p, s = spans_of(row, spans)
            n, order = unpacked(row["n"]), np.argsort(span, kind="stable")
            cuts = np.flatnonzero(np.diff(span[order], prepend=np.uint64(spans)))
            out = []
            for at in np.split(order, cuts[1:]) if len(order) else []:
                first, second = (zstandard.compress(BREAK.join([own[k] for k in at.tolist()]), 1), None) if own is not None else packed_pairs(p[at], s[at])
                out.append({"lang": row["lang"], "span": int(span[at[0]]), "chunk": row["chunk"], "first": first, "second": second, "n": packed(n[at])})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return relation.select("chunk", "lang", "first", "second", "n").mapInArrow(deal, DEALT)


def counted(relation: DataFrame, spans: int, least: int, label: str) -> DataFrame:
    """Frequent grams with a number within their span, and for each chunk and span the numbers of its grams, from 1."""
    schema = arrow(COUNTED)

    def add_up(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        n = [unpacked(r["n"]) for r in rows]
        sizes = np.cumsum([len(x) for x in n])[:-1]
        if rows[0]["second"] is None:
            encoded = pa.array([w for r in rows for w in zstandard.decompress(r["first"]).split(BREAK)], pa.binary()).dictionary_encode()
            code, different = encoded.indices.to_numpy().astype(np.int64), len(encoded.dictionary)
        else:
            p, s = (np.concatenate(x) for x in zip(*(unpacked_pairs(r["first"], r["second"]) for r in rows)))
            order = np.lexsort((s, p))
            new = np.append(True, (p[order][1:] != p[order][:-1]) | (s[order][1:] != s[order][:-1]))
            code, different = np.empty(len(p), np.int64), int(new.sum())
            code[order] = np.cumsum(new) - 1
            at = order[new]
        f = np.zeros(different, np.int64)
        np.add.at(f, code, np.concatenate(n))
        frequent = np.flatnonzero(f >= least)
        number = np.zeros(different, np.int64)
        number[frequent] = np.arange(1, len(frequent) + 1)
        given = {"lang": rows[0]["lang"], "span": rows[0]["span"]}
        out = [given | {"chunk": r["chunk"], "reply": packed(x)} for r, x in zip(rows, np.split(number[code], sizes))]
        if rows[0]["second"] is None:
            named = encoded.dictionary.take(pa.array(frequent)).to_pylist()
            out += [given | {"number": k, "word": w.decode(), "f": c} for k, (w, c) in enumerate(zip(named, f[frequent].tolist()), 1)]
        else:
            out += [given | {"number": k, "p": x, "s": y, "f": c} for k, (x, y, c) in enumerate(zip(p[at][frequent].tolist(), s[at][frequent].tolist(), f[frequent].tolist()), 1)]
        return pa.Table.from_pylist(out, schema)

    return saved(dealt(relation, spans).groupBy("lang", "span").applyInArrow(add_up, COUNTED), label)


def extended(relation: DataFrame, replies: DataFrame, spans: int, width: int) -> DataFrame:
    """The relation of the next length; a frequent gram's id is its span's place, `width` numbers wide, and its number."""
    schema = arrow(RELATION)

    def merge(own: pa.Table, answers: pa.Table) -> pa.Table:
        row = own.to_pylist()[0]
        span, ids = spans_of(row, spans)[0].astype(np.int64), np.zeros(row["grams"], np.int64)
        order = np.argsort(span, kind="stable")
        begins = dict(zip(*np.unique(span[order], return_index=True)))
        for r in answers.to_pylist():
            number = unpacked(r["reply"])
            at = order[begins[r["span"]] : begins[r["span"]] + len(number)]
            ids[at] = np.where(number > 0, r["span"] * width + number, 0)
        alive = np.flatnonzero(ids)
        alive = alive[np.argsort(ids[alive])]
        number = np.zeros(len(ids) + 1, np.int64)
        number[alive + 1] = np.arange(1, len(alive) + 1)
        places, ids = number[unpacked(row["places"])], ids[alive]
        first = np.flatnonzero((places[:-1] > 0) & (places[1:] > 0))
        keys, gram, n = np.unique((places[first] - 1) * max(1, len(ids)) + places[first + 1] - 1, return_inverse=True, return_counts=True)
        out = np.zeros(len(places), np.int64)
        out[first] = gram + 1
        p, s = np.divmod(keys, max(1, len(ids)))
        found = [row["chunk"], row["lang"], 0, packed(narrowed(out)), *packed_pairs(ids[p], ids[s]), packed(n), len(n)]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(found, schema)], schema=schema)

    return relation.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(merge, RELATION).where("grams > 0")


def lowest_cut(length: int) -> Column:
    """Of the ways to cut a phrase in two, the one with the lowest score, then with the fewest words in front."""
    score = lambda left, right: F.expr(f"CAST(CAST(f AS DECIMAL(28, 0)) * 2000000BD div (CAST({left} AS DECIMAL(28, 0)) + {right}) AS BIGINT)")
    ends = [(k, f"heads[{k - 1}]", f"tails[{length - k - 1}]") for k in range(1, length)]
    return F.array_min(F.array(*(F.struct(score(left, right).alias("score"), F.lit(k).alias("k"), F.expr(left).alias("l"), F.expr(right).alias("r")) for k, left, right in ends)))


def phrases(docs: DataFrame, least: int = 30, longest: int = 4, covered: int = 80, top: int = 2000, chunk_bytes: int = 16_000_000, span_grams: int = 1_000_000) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Phrases have 2 to `longest` words and occur `least` times or more; one that lies in a longer such phrase with at
    least `covered` percent of its occurrences is dropped. score is floor(2000000 a / (l + r)) at the lowest cut.
    A null lang is `und`, a null text empty; rows count as often as they occur, whatever their ids; other columns
    are ignored. Ties in score go by a, then by the phrase's bytes. An empty table, or one without a frequent phrase,
    gives an empty result. `span_grams` grams of all chunks are added up in one group on average."""
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    relation = saved(words(docs, chunk_bytes), "phrases-1")
    totals = relation.groupBy("lang").agg(F.sum("positions").alias("n"))

    def frequent(length: int) -> tuple[DataFrame, DataFrame, int, int]:
        """Frequent grams with ids, and what the chunks are told of theirs."""
        spans = max(tasks, (relation.agg(F.sum("grams")).first()[0] or 0) // span_grams)
        out = counted(relation, spans, least, f"phrases-counts-{length}")
        width = (out.agg(F.max("number")).first()[0] or 0) + 1
        found = out.where("chunk IS NULL").withColumn("id", F.col("span") * width + F.col("number"))
        return found, out.where("chunk IS NOT NULL").select("chunk", "span", "reply"), spans, width

    found, replies, spans, width = frequent(1)
    known = found.select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), F.array("f").alias("heads"), F.array("f").alias("tails"), F.array(F.array("id")).alias("parts"))
    candidates, inside = [], []
    for length in range(2, longest + 1):
        relation = saved(extended(relation, replies, spans, width), f"phrases-{length}")
        found, replies, spans, width = frequent(length)
        # parts: for each length up to its own, the numbers of the grams that lie in the phrase, from left to right
        front = known.select(F.col("id").alias("p"), "lang", F.col("phrase").alias("front"), F.col("heads").alias("front_heads"), F.col("parts").alias("front_parts"))
        back = known.select(F.col("id").alias("s"), "lang", F.col("last"), F.col("tails").alias("back_tails"), F.col("parts").alias("back_parts"))
        parts = F.concat(F.zip_with("front_parts", "back_parts", lambda a, b: F.concat(a, F.slice(b, -1, 1))), F.array(F.array("id")))
        known = found.select("id", "lang", "p", "s", "f").join(front, ["lang", "p"]).join(back, ["lang", "s"]).select(
            "id", "lang", "f", F.concat_ws(" ", "front", "last").alias("phrase"), "last", F.concat("front_heads", F.array("f")).alias("heads"), F.concat("back_tails", F.array("f")).alias("tails"), parts.alias("parts")
        )
        known = saved(known, f"phrases-known-{length}")
        candidates.append(known.select("id", "lang", "phrase", F.col("f").alias("a"), F.lit(length).alias("words"), lowest_cut(length).alias("cut")))
        for shorter in range(2, length):
            inside.append(known.select("lang", F.lit(shorter).alias("words"), F.explode(F.col("parts")[shorter - 1]).alias("id"), "f"))
    every = candidates[0]
    for c in candidates[1:]:
        every = every.union(c)
    if inside:
        longer = inside[0]
        for x in inside[1:]:
            longer = longer.union(x)
        longer = longer.groupBy("lang", "words", "id").agg(F.max("f").alias("longer"))
        every = every.join(longer, ["lang", "words", "id"], "left")
        whole = lambda c: F.col(c).cast("decimal(38,0)")
        every = every.where(F.col("longer").isNull() | (whole("longer") * 100 < whole("a") * covered))
    scored = every.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    best = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))  # so that no task sorts all phrases of a language
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top).drop("part")
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY 1),
sizes AS (SELECT unnest([1, 2, 3, 4]) AS k),
f AS (
  SELECT lang, g, len(g) AS k, count(*) AS a FROM (
    SELECT lang, unnest(list_transform(range(1, greatest(len(w) - k + 2, 1)::BIGINT), lambda i: w[i : i + k - 1])) AS g FROM pieces, sizes)
  GROUP BY 1, 2 HAVING count(*) >= 30),
candidates AS (SELECT * FROM f WHERE k > 1),
cuts AS (
  SELECT c.lang, c.g, c.k, c.a, x.j, x.l, x.r, ((2000000::HUGEINT * c.a) // (x.l::HUGEINT + x.r))::BIGINT AS score
  FROM candidates c JOIN (
    SELECT o.lang, o.g, o.j, p.a AS l, q.a AS r FROM (SELECT lang, g, unnest(range(1, k)) AS j FROM candidates) o
    JOIN f p ON p.lang = o.lang AND p.g = o.g[1 : o.j] JOIN f q ON q.lang = o.lang AND q.g = o.g[o.j + 1 : len(o.g)]) x ON x.lang = c.lang AND x.g = c.g),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, j) = 1),
inside AS (
  SELECT lang, g, max(a) AS longer FROM (
    SELECT lang, a, unnest(list_transform(range(1, k - s + 2), lambda i: c.g[i : i + s - 1])) AS g FROM candidates c, (SELECT unnest([2, 3]) AS s) WHERE s < k)
  GROUP BY 1, 2),
held AS (
  SELECT low.lang, array_to_string(low.g, ' ') AS phrase, a, l, r, score FROM low LEFT JOIN inside i ON i.lang = low.lang AND i.g = low.g
  WHERE longer IS NULL OR 100 * longer::HUGEINT < 80 * a::HUGEINT)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM held) JOIN total USING (lang) WHERE rank <= 2000
"""
