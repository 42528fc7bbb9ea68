"""Conversation structure repair by rank-convergence parallel Viterbi.

Turns are lines in order of conversation, turn, role and text. A repaired conversation has the role initials
`(s?(ua)+)?`, four states: nothing yet, system said, user said, pair closed. Every line is kept, given another role or
deleted, and empty turns may be inserted. The costs to go from the four states are a vector; a line turns the vector
after it into the one before it.

Range partitioning cuts the ordered lines wherever it likes, and long conversations are cut again, so a conversation
may lie in many parts. Every part first runs from a speculative vector, the one of a conversation's end. Fix-up passes
then compare each part's assumed vector with what the next part really begins with: if the two differ by more than a
constant, the part runs again, old and new vector side by side, and stops as soon as they do differ by a constant only
(the rank of the step's product is one then, and everything before it stays right). Vectors are kept with their least
component at zero, so that differing by a constant is being equal. With the stitched costs, each part knows for any
state that it may be entered in where it leaves; one ordered pass over those maps hands every part its state, and all
parts trace their edits at once, the ASCII-least initial first among the cheapest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

INSERT, DELETE, REROLE, CUT = 5, 2, 1, 5
#: By state: the state after a line with initial s, u, a (-1: not allowed), and the role that it takes next.
STEP = ((1, 2, -1), (-1, 2, -1), (-1, -1, 3), (-1, 2, -1))
WANTED = (1, 1, 2, 1)
ROLES = ("", "user", "assistant")
END = (0, 10, 5, 0)
LEGAL = {"su", "ua", "au"}
#: Classes of lines: a line that must go, or 1 + initial (s, u, a, other) + 4 if it is truncated.
GONE = 0

SUMS = ("cost", "blank", "duplicate", "truncated", "illegal")
PART = "conv_id long, part long, whole boolean, audit string, cost long, blank long, duplicate long, truncated long, illegal long, least long, most long, turns long, roles array<string>, texts array<string>, codes array<int>, copies array<long>, begin array<int>, head string, tail string"
DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string()), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}


def arrow(schema: str) -> pa.Schema:
    return pa.schema([(name, ARROW[kind]) for name, kind in (x.split() for x in schema.split(", "))])


@lru_cache(maxsize=None)
def costs(after: tuple[int, ...], code: int) -> tuple[int, ...]:
    """The costs to go before a line, for each state, from those after it."""
    initial, cut = (code - 1) % 4, CUT if code > 4 else 0
    best = []
    for q in range(4):
        kept = STEP[q][initial] if initial < 3 else -1
        ways = [DELETE + after[q], REROLE + cut + after[STEP[q][WANTED[q]]]]
        best.append(min(ways + ([cut + after[kept]] if kept >= 0 else [])))
    two, three = min(best[2], INSERT + best[3]), min(best[3], INSERT + best[2])
    return min(best[0], INSERT + two), min(best[1], INSERT + two), two, three


@lru_cache(maxsize=None)
def back(after: tuple[int, ...], code: int) -> tuple[int, ...]:
    """As `costs`, the least at zero; a line that must go costs the same from every state."""
    if code == GONE:
        return after
    found = costs(after, code)
    return tuple(c - min(found) for c in found)


@lru_cache(maxsize=None)
def move(after: tuple[int, ...], code: int, q: int) -> tuple[str, int, int]:
    """Initials of the cheapest edits for a line, ASCII-least, their cost, and the state after it."""
    now, initial, cut, done, cost = costs(after, code), (code - 1) % 4, CUT if code > 4 else 0, "", 0
    while True:
        if now[q] == DELETE + after[q]:
            return done + "D", cost + DELETE, q
        wanted = STEP[q][WANTED[q]]
        if now[q] == INSERT + now[wanted]:
            done, cost, q = done + "I", cost + INSERT, wanted
            continue
        kept = STEP[q][initial] if initial < 3 else -1
        if kept >= 0 and now[q] == cut + after[kept]:
            return done + "K", cost + cut, kept
        return done + "R", cost + REROLE + cut, wanted


def through(codes: list[int], after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The vector after each line, and at last the one before the first line in front: n + 1 vectors."""
    out = [after]
    for code in reversed(codes):
        out.append(back(out[-1], code))
    return out[::-1]


def rerun(codes: list[int], assumed: tuple[int, ...], real: tuple[int, ...], begin: tuple[int, ...]) -> tuple[int, ...]:
    """The vector before the first line from the real vector after the last one; stops where it meets the old run."""
    for code in reversed(codes):
        if assumed == real:
            return begin
        assumed, real = back(assumed, code), back(real, code)
    return real


def leaves(codes: list[int], after: tuple[int, ...]) -> list[int]:
    """For each state that a part may be entered in, the state that it is left in."""
    vectors, states = through(codes, after)[1:], [0, 1, 2, 3]
    for code, v in zip(codes, vectors):
        if code != GONE:
            states = [move(v, code, q)[2] for q in states]
    return states


def traced(part: dict, after: tuple[int, ...], q: int, last: bool) -> dict:
    """The part with its edits: audit, cost, and the repaired turns."""
    audit, cost, roles, texts = [], 0, [], []
    vectors = through(part["codes"], after)[1:]
    for code, v, n, role, text in zip(part["codes"], vectors, part["copies"], part["roles"], part["texts"]):
        if code == GONE:
            audit.append("D" * n)
            cost += DELETE * n
            continue
        letters, spent, left = move(v, code, q)
        cost += spent
        for x in letters:
            if x == "I" or x == "R":
                roles.append(ROLES[WANTED[q]])
                texts.append("" if x == "I" else text)
                q = STEP[q][WANTED[q]]
            elif x == "K":
                roles.append(role)
                texts.append(text)
        q = left
        audit.append(letters)
        audit.append("D" * (n - 1))  # all copies but the first are duplicates
        cost += DELETE * (n - 1)
    while last and q in (1, 2):
        roles.append(ROLES[WANTED[q]])
        texts.append("")
        audit.append("I")
        cost, q = cost + INSERT, STEP[q][WANTED[q]]
    return part | {"audit": "".join(audit), "cost": cost, "roles": roles, "texts": texts, "codes": [], "copies": []}


class Part:
    """Lines of one conversation, put together one at a time."""

    def __init__(self, conv: int | None, number: int, opened: bool):
        self.row = {"conv_id": conv, "part": number, "whole": not opened, "audit": "", "cost": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "least": None, "most": None, "turns": 0, "roles": [], "texts": [], "codes": [], "copies": [], "begin": [], "head": None, "tail": None}
        self.size = 0

    def add(self, turn: int | None, role: str, text: str, n: int, later: bool) -> None:
        row, initial, bare = self.row, role[:1], text.rstrip(" \t\n\v\f\r")
        if not bare:
            row["blank"] += n
        elif later:
            row["duplicate"] += n
        else:
            row["duplicate"] += n - 1
            row["truncated"] += bare[-1] not in ".!?"
        row["codes"].append(GONE if not bare or later else 1 + ("sua".find(initial) if initial and initial in "sua" else 3) + (0 if bare[-1] in ".!?" else 4))
        if row["head"] is None:
            row["head"] = initial
        elif row["tail"] + initial not in LEGAL:
            row["illegal"] += 1
        row["illegal"] += n - 1
        row["tail"] = initial
        if turn is not None:
            row["turns"] += turn != row["most"]
            row["least"], row["most"] = turn if row["least"] is None else row["least"], turn
        for name, x in (("roles", role), ("texts", text), ("copies", n)):
            row[name].append(x)
        self.size += len(text)

    def done(self) -> dict:
        if self.row["whole"]:
            return traced(self.row, END, 0, last=True)
        self.row["begin"] = list(through(self.row["codes"], END)[0])
        return self.row


def emitted(rows: Iterator[dict], schema: pa.Schema, most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about `most` characters of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(map(len, row.get("texts", ()))) + len(row.get("audit") or "") + 100
        if size > most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def parts_of(ordered: DataFrame, part_lines: int, part_chars: int) -> DataFrame:
    schema = arrow(PART)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        number, part, first = TaskContext.get().partitionId() << 33, None, True
        for batch in batches:
            for conv, turn, role, text, n, later in zip(*(c.to_pylist() for c in batch.columns)):
                if part is None or conv != part.row["conv_id"] or len(part.row["codes"]) >= part_lines or part.size > part_chars:
                    cut = part is not None and conv == part.row["conv_id"]
                    if part is not None:
                        part.row["whole"] &= not cut
                        yield part.done()
                    part = Part(conv, number, opened=first or cut)  # the partition before may hold its first lines
                    number, first = number + 1, False
                if n:
                    part.add(turn, role, text, n, later)
        if part is not None:
            part.row["whole"] = False  # the next partition may go on with it
            yield part.done()

    return ordered.mapInArrow(lambda batches: emitted(rows(batches), schema), PART)


def stitched(opened: DataFrame) -> DataFrame:
    """Parts of conversations that may lie in several parts, repaired."""
    end, order = F.array(*map(F.lit, END)), Window.partitionBy("conv_id").orderBy("part")
    borders = opened.select("conv_id", "part", "begin", end.alias("assumed"))
    while True:
        seen = borders.withColumn("real", F.coalesce(F.lead("begin").over(order), end))
        stale = saved(seen.where(F.col("real") != F.col("assumed")).select("part", "assumed", "real", "begin"), "conversation-stale")
        if stale.isEmpty():
            break

        def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [{"part": r["part"], "fresh": list(rerun(r["codes"], tuple(r["assumed"]), tuple(r["real"]), tuple(r["begin"]))), "now": r["real"]} for r in batch.to_pylist()]
                yield pa.RecordBatch.from_pylist(found, arrow("part long, fresh array<int>, now array<int>"))

        fresh = opened.select("part", "codes").join(stale, "part").mapInArrow(again, "part long, fresh array<int>, now array<int>")
        borders = saved(borders.join(fresh, "part", "left").select("conv_id", "part", F.coalesce("fresh", "begin").alias("begin"), F.coalesce("now", "assumed").alias("assumed")), "conversation-borders")

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [{k: r[k] for k in ("conv_id", "part", "after", "head", "tail", "least", "most")} | {"exits": leaves(r["codes"], tuple(r["after"]))} for r in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(found, arrow(maps))

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hands each part its state; parts come in order, and a part waits for its successor to know if it is the last."""
        held = None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if held and held["conv_id"] == r["conv_id"]:
                    q, tail, most = held["exits"][held["state"]], held["tail"], held["most"]
                else:
                    q, tail, most = 0, None, None
                if held:
                    out.append({k: held[k] for k in ("part", "after", "state", "crossed", "shared")} | {"last": held["conv_id"] != r["conv_id"]})
                held = r | {"state": q, "crossed": int(None not in (tail, r["head"]) and tail + r["head"] not in LEGAL), "shared": int(most is not None and most == r["least"])}
                held["tail"] = r["tail"] if r["head"] is not None else tail  # a part without lines passes on what it was given
                held["most"] = most if r["most"] is None else r["most"]
            if out:
                yield pa.RecordBatch.from_pylist(out, arrow(states))
        if held:
            yield pa.RecordBatch.from_pylist([{k: held[k] for k in ("part", "after", "state", "crossed", "shared")} | {"last": True}], arrow(states))

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        found = (traced(r, tuple(r["after"]), r["state"], r["last"]) | {"illegal": r["illegal"] + r["crossed"], "turns": r["turns"] - r["shared"]} for r in rows)
        return emitted(found, arrow(PART))

    maps = "conv_id long, part long, after array<int>, head string, tail string, least long, most long, exits array<int>"
    states = "part long, after array<int>, state int, crossed int, shared int, last boolean"
    after = borders.select("part", F.col("assumed").alias("after"))
    mapped = opened.select("conv_id", "part", "codes", "head", "tail", "least", "most").join(after, "part").mapInArrow(exits, maps)
    entered = mapped.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(chain, states)
    return opened.join(entered, "part").mapInArrow(trace, PART)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: rows (nulls as one space) with a seeded fault in a quarter of them.

    crc32(`conv_id:turn`) % 20 is 0: dropped (no copies), 1: empty text, 2: without `[.!?]`, 3: two copies, 4: role user."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    role = F.when(fault == 4, "user").otherwise(shown("role"))
    copies = F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long")
    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def repaired(turns: DataFrame, part_lines: int = 4096, part_chars: int = 4_000_000) -> DataFrame:
    """Parts of repaired conversations: conv_id, part, whole, audit, roles, texts and sums; texts of a conversation lie
    in its parts in order of `part`. turns: conv_id, turn, role, text, copies (0: the conversation exists, the row not).

    Null roles and texts count as one space; a null conv_id is a conversation of its own; null turns come first. Rows of
    one turn are ordered by role and text, so copies are neighbours, and each but the first is a duplicate. An empty role
    and one whose first letter is not s, u or a is never kept as it is. Rows are added up before they are shuffled, and
    a conversation of any length is cut into parts of `part_lines` different lines or `part_chars` characters. Further
    columns are ignored; an empty table gives an empty result."""
    real = F.col("copies") > 0
    shown = lambda c: F.when(real, F.coalesce(F.col(c), F.lit(" "))).otherwise("").alias(c)
    lines = turns.select("conv_id", F.when(real, F.col("turn")).alias("turn"), shown("role"), shown("text"), "copies")
    lines = lines.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    again = lines.where(real).groupBy("conv_id", "role", "text").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    again = again.toDF("_conv_id", "_role", "_text", "first", "n")
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("text") == F.col("_text"))
    later = real & F.col("n").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    flagged = lines.join(again, same, "left").select("conv_id", "turn", "role", "text", "copies", later.alias("later"))
    ordered = flagged.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(32))).sortWithinPartitions("conv_id", "turn", "role", "text")
    found = saved(parts_of(ordered, part_lines, part_chars), "conversation-parts")
    opened = found.where("NOT whole")
    return found.where("whole").unionByName(saved(stitched(opened), "conversation-stitched"))


def digest(parts: DataFrame) -> DataFrame:
    """One row a conversation: gaps, faults, cost, audit and the SHA-256 of its repaired turns.

    A conversation in one part is hashed in place. The others pass through one task each as a stream of parts, as a
    SHA-256 can only be taken in order; a task holds one part and the audit at a time."""
    empty = F.col("least").isNull()
    gaps = F.when(empty, F.lit(0).cast("long")).otherwise(F.col("most") - F.col("least") + 1 - F.col("turns"))
    body = F.array_join(F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    whole = parts.where("whole").select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(body.cast("binary"), 256).alias("repaired_sha256"))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        row, begun = None, False
        for r in (r for batch in batches for r in batch.to_pylist()):
            if row is None or row["conv_id"] != r["conv_id"]:
                if row is not None:
                    yield closed(row, sha)
                row, sha, begun = {"conv_id": r["conv_id"], "least": None, "most": None, "turns": 0, "audit": []} | dict.fromkeys(SUMS, 0), hashlib.sha256(), False
            for name in (*SUMS, "turns"):
                row[name] += r[name]
            row["audit"].append(r["audit"])
            if r["least"] is not None:
                row["least"], row["most"] = r["least"] if row["least"] is None else row["least"], r["most"]
            for role, text in zip(r["roles"], r["texts"]):
                sha.update(f"{chr(10) if begun else ''}{role}:{text}".encode())
                begun = True
        if row is not None:
            yield closed(row, sha)

    def closed(row: dict, sha) -> dict:
        gaps = 0 if row["least"] is None else row["most"] - row["least"] + 1 - row["turns"]
        return {"conv_id": row["conv_id"], "gaps": gaps, "audit": "".join(row["audit"]), "repaired_sha256": sha.hexdigest()} | {k: row[k] for k in SUMS}

    columns = ["conv_id", "part", "audit", *SUMS, "least", "most", "turns", "roles", "texts"]
    many = parts.where("NOT whole").select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return whole.unionByName(many.mapInArrow(lambda batches: emitted(streamed(batches), arrow(DIGEST)), DIGEST))


ORACLE_SQL = r"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(concat(coalesce(conv_id::VARCHAR, ' '), ':', coalesce(turn::VARCHAR, ' ')), ''), lambda x: ord(x)::BIGINT)),
      lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295) % 20 AS fault
  FROM conversations),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
    CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE fault WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM drawn WHERE fault <> 0),
placed AS (
  SELECT dense_rank() OVER (ORDER BY conv_id) AS k, *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos, left(role, 1) AS ini FROM damaged),
judged AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY k, role, text ORDER BY pos) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS bare, concat(lag(ini) OVER (PARTITION BY k ORDER BY pos), ini) AS two FROM placed),
lines AS (
  SELECT k, pos, role, text, ini, blank OR seen AS gone, CASE WHEN bare THEN 5 ELSE 0 END AS t FROM judged),
sums AS (
  SELECT k, any_value(conv_id) AS conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate,
    count(*) FILTER (bare AND NOT seen AND NOT blank) AS truncated, count(*) FILTER (pos > 1 AND two NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY k),
back AS (
  SELECT k, n + 1 AS pos, 0 AS c0, 10 AS c1, 5 AS c2, 0 AS c3 FROM sums
  UNION ALL
  SELECT k, pos, least(b0, 5 + b2, 10 + b3), least(b1, 5 + b2, 10 + b3), least(b2, 5 + b3), least(b3, 5 + b2) FROM (
    SELECT l.k, l.pos,
      CASE WHEN gone THEN 2 + c0 ELSE least(2 + c0, 1 + t + c2, CASE ini WHEN 's' THEN t + c1 WHEN 'u' THEN t + c2 END) END AS b0,
      CASE WHEN gone THEN 2 + c1 ELSE least(2 + c1, 1 + t + c2, CASE ini WHEN 'u' THEN t + c2 END) END AS b1,
      CASE WHEN gone THEN 2 + c2 ELSE least(2 + c2, 1 + t + c3, CASE ini WHEN 'a' THEN t + c3 END) END AS b2,
      CASE WHEN gone THEN 2 + c3 ELSE least(2 + c3, 1 + t + c2, CASE ini WHEN 'u' THEN t + c2 END) END AS b3
    FROM back b JOIN lines l ON l.k = b.k AND l.pos = b.pos - 1)),
vectors AS (
  SELECT b.k, b.pos, [b.c0, b.c1, b.c2, b.c3] AS now, [a.c0, a.c1, a.c2, a.c3] AS after, l.role, l.text, l.ini, l.gone, l.t
  FROM back b LEFT JOIN back a ON a.k = b.k AND a.pos = b.pos + 1 LEFT JOIN lines l ON l.k = b.k AND l.pos = b.pos),
forth AS (
  SELECT k, 1::BIGINT AS pos, 0 AS q, '' AS audit, []::VARCHAR[] AS body FROM sums
  UNION ALL
  SELECT k, pos + CASE WHEN edit = 'I' THEN 0 ELSE 1 END,
    CASE edit WHEN 'D' THEN q WHEN 'K' THEN kept ELSE wanted END, audit || edit,
    CASE edit WHEN 'D' THEN body WHEN 'K' THEN list_append(body, concat(role, ':', text)) WHEN 'R' THEN list_append(body, concat(said, ':', text)) ELSE list_append(body, concat(said, ':')) END
  FROM (
    SELECT *, CASE WHEN after IS NOT NULL AND now[q + 1] = 2 + after[q + 1] THEN 'D' WHEN now[q + 1] = 5 + now[wanted + 1] THEN 'I'
      WHEN after IS NULL THEN NULL WHEN kept IS NOT NULL AND now[q + 1] = t + after[kept + 1] THEN 'K' ELSE 'R' END AS edit
    FROM (
      SELECT f.*, v.now, v.after, v.role, v.text, v.t, CASE f.q WHEN 2 THEN 3 ELSE 2 END AS wanted, CASE f.q WHEN 2 THEN 'assistant' ELSE 'user' END AS said,
        CASE WHEN v.gone THEN NULL WHEN v.ini = 's' AND f.q = 0 THEN 1 WHEN v.ini = 'u' AND f.q <> 2 THEN 2 WHEN v.ini = 'a' AND f.q = 2 THEN 3 END AS kept
      FROM forth f JOIN vectors v ON v.k = f.k AND v.pos = f.pos))
  WHERE edit IS NOT NULL),
last AS (
  SELECT f.k, f.audit, f.body FROM forth f JOIN sums s ON s.k = f.k AND f.pos = s.n + 1 WHERE f.q IN (0, 3)),
total AS (SELECT k, c0 AS cost FROM back WHERE pos = 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN last l ON l.k = s.k LEFT JOIN total t ON t.k = s.k
"""
