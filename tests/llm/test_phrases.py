"""Phrase mining against plain counting."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from graphtables.llm import phrases

SCHEMA = "doc_id long, text string, lang string, chunk string, n string, score string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least, covered, top, longest=4):
    counts, words = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            own = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            words[lang] += len(own)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(own[i : i + k]) for i in range(len(own) - k + 1))
    out = []
    for lang, f in counts.items():
        found = [g for g, a in f.items() if len(g) > 1 and a >= least]
        longer = Counter()
        for g in found:
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    longer[g[i : i + k]] = max(longer[g[i : i + k]], f[g])
        rank = []
        for g in found:
            if 100 * longer[g] >= covered * f[g]:
                continue
            score, _, left, right = min((2_000_000 * f[g] // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            rank.append((-score, -f[g], " ".join(g).encode(), left, right))
        for k, (score, a, phrase, left, right) in enumerate(sorted(rank)[:top], 1):
            out.append((lang, k, phrase.decode(), -a, left, right, words[lang], -score))
    return sorted(out)


def corpus():
    r = random.Random(4)
    words = ["a", "B", "c", "d\x1ce", "é", "É", "ÀB", "x" * 500]
    rows = []
    for i in range(300):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\r", "\x0b", "!? "]) for _ in range(r.randrange(0, 40)))
        rows.append((i % 250, text, r.choice(["en", "de", None, "und", ""]), "x", "y", "z"))
    rows += [(1, None, None, "x", "y", "z"), (2, " . ,", "en", "x", "y", "z"), (3, "a b c d " * 3000, "fr", "x", "y", "z"), (4, "y" * 200_000, "fr", "x", "y", "z")]
    return rows + rows[:20]


@pytest.mark.parametrize(("least", "chunk_bytes", "top"), [(30, 16_000_000, 2000), (5, 700, 7)])
def test_phrases_equal_plain_counting(spark, least, chunk_bytes, top):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, phrases.phrases(df, least=least, top=top, chunk_bytes=chunk_bytes).collect()))
    assert got == expected(rows, least, 80, top) and got


def test_empty_tables_and_texts_without_phrases(spark):
    assert phrases.phrases(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "one two", "en", "x", "y", "z"), (2, None, None, "x", "y", "z")]
    assert phrases.phrases(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_scores_beyond_64_bits_are_exact(spark):
    f = 3 * 10**15 + 7
    df = spark.createDataFrame([(f, [f + 2, f], [f + 4, f])], "f long, heads array<long>, tails array<long>")
    cut = df.select(phrases.lowest_cut(2).alias("x")).first().x
    assert cut.score == 2_000_000 * f // (2 * f + 6) and (cut.k, cut.l, cut.r) == (1, f + 2, f + 4)


def test_sql_gives_the_same_rows(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = sorted(con.sql(phrases.ORACLE_SQL).fetchall())
    assert sorted(map(tuple, phrases.phrases(spark.read.parquet(f"{folder}/documents.parquet")).collect())) == want
