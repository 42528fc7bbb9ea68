"""Conversation repair against an exhaustive search, in one part and in many."""

import heapq
import random
import re
import zlib
from hashlib import sha256

import duckdb
import pytest

from graphtables.llm import conversation

GOOD = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def cheapest(lines):
    """All edits by increasing cost: the ASCII-least of the cheapest, with its cost and repaired turns.

    lines: (role, text, must go, truncated). A state is how far one has come and what stands so far."""
    best, least, queue = None, {}, [(0, "", 0, ())]
    while queue:
        cost, audit, at, out = heapq.heappop(queue)
        if best is not None and cost > best[0]:
            break
        initials = "".join(r[:1] if r[:1] in ("s", "u", "a") else "?" for r, _ in out)
        if at == len(lines) and GOOD.fullmatch(initials):
            if best is None or audit < best[1]:
                best = (cost, audit, out)
        if len(initials) > len(lines) + 3 or not re.fullmatch(r"s?(ua)*u?", initials):
            continue
        for role in ("user", "assistant"):
            heapq.heappush(queue, (cost + 5, audit + "I", at, (*out, (role, ""))))
        if at < len(lines):
            role, text, gone, bare = lines[at]
            heapq.heappush(queue, (cost + 2, audit + "D", at + 1, out))
            if not gone:
                heapq.heappush(queue, (cost + 5 * bare, audit + "K", at + 1, (*out, (role, text))))
                for new in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 1 + 5 * bare, audit + "R", at + 1, (*out, (new, text))))
    return best


def expected(rows):
    groups = {}
    for conv, turn, role, text in rows:
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own, role, text = groups.setdefault(conv, []), " " if role is None else role, " " if text is None else text
        if fault:
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            own += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns, seen, lines, sums = [t for t, _, _ in own if t is not None], set(), [], [0, 0, 0]
        for _, role, text in own:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            if fault is not None:
                sums[fault] += 1
            seen.add((role, text))
            lines.append((role, text, fault in (0, 1), fault == 2))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, kept = cheapest(lines)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (conv, gaps, *sums, illegal, cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest())
    return out


def conversations(seed, n):
    r, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(r.randrange(1, 8)):
            role = r.choice(["system", "user", "assistant", "assistant", "user", "tool", "", None])
            rows.append((conv if conv else None, None if r.random() < 0.1 else turn, role, r.choice(["Yes.", "No", "", " \n", None, "Why?", "Well, so", "é\x1c"])))
    return rows + rows[:5]


@pytest.mark.parametrize("part_lines", [4096, 2])
def test_repair_equals_exhaustive_search(spark, part_lines):
    rows = conversations(3, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = conversation.digest(conversation.repaired(conversation.damaged(df), part_lines=part_lines)).collect()
    assert {r.conv_id: tuple(r) for r in got} == expected(rows) and len(got) == len({r[0] for r in rows})


def test_long_conversation_in_many_parts_equals_one_part(spark):
    r = random.Random(8)
    rows = [(7, k, r.choice(["system", "user", "assistant"]), f"{k // 3 if r.random() < 0.2 else k}{r.choice(['.', ''])}") for k in range(3000)] + [(8, 1, "user", "Hi.")]
    lines = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1L AS copies")
    one, many = (sorted(map(tuple, conversation.digest(conversation.repaired(lines, part_lines=n)).collect())) for n in (10_000, 64))
    assert one == many and len(one) == 2 and len(one[0][7]) >= 3000


def test_copies_of_a_row_are_added_up(spark):
    lines = spark.createDataFrame([(1, 0, "user", "Hi.", 50_000), (1, 1, "assistant", "Yes.", 1)], SCHEMA + ", copies long")
    row = conversation.digest(conversation.repaired(lines)).first()
    assert (row.duplicate, row.illegal, row.cost, row.audit) == (49_999, 49_999, 99_998, "K" + "D" * 49_999 + "K")


def test_repaired_turns_are_returned(spark):
    lines = spark.createDataFrame([(1, 0, "assistant", "Hello.", 1), (1, 1, "assistant", "Bye.", 1)], SCHEMA + ", copies long")
    row = conversation.repaired(lines).first()
    assert (row.audit, row.cost, row.roles, row.texts) == ("RK", 1, ["user", "assistant"], ["Hello.", "Bye."])


def test_edge_cases(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert conversation.digest(conversation.repaired(conversation.damaged(none))).count() == 0
    dropped = next(k for k in range(1000) if zlib.crc32(f"5:{k}".encode()) % 20 == 0)
    long = "x" * 300_000
    rows = [(5, dropped, "user", "Hi.", "a"), (6, 1, "user", long, "b"), (None, None, None, None, "c")]
    df = spark.createDataFrame(rows, SCHEMA + ", part string")  # a name that the operator uses itself
    got = {r.conv_id: tuple(r) for r in conversation.digest(conversation.repaired(conversation.damaged(df))).collect()}
    assert got == expected([r[:4] for r in rows])
    assert got[5] == (5, 0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())


def test_fix_up_stops_where_vectors_differ_by_a_constant():
    codes = [1 + k % 4 + 4 * (k % 3 == 0) for k in range(50)]
    begin = conversation.through(codes, conversation.END)[0]
    for real in ((0, 0, 0, 0), (7, 3, 0, 1), (0, 10, 5, 0)):
        assert conversation.rerun(codes, conversation.END, real, begin) == conversation.through(codes, real)[0]


def test_sql_gives_the_same_rows(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    want = sorted(con.sql(conversation.ORACLE_SQL).fetchall())
    df = spark.read.parquet(f"{folder}/conversations.parquet")
    assert sorted(map(tuple, conversation.digest(conversation.repaired(conversation.damaged(df), part_lines=3)).collect())) == want
