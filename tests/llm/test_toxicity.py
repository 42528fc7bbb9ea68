"""The toxicity grammar: its machine by hand-made clauses, its scores by held-out labels."""

import itertools
import zlib

import pytest

from graphtables.llm import toxicity

SCHEMA = "doc_id long, text string, lang string, source string, score string, toxic string"


def said(text, stems=None):
    x = toxicity.Grammar(stems or {}).patterns(text)
    return {("aimed " if aimed else "") + kind for (kind, aimed), v in zip(toxicity.PATTERNS, x) if v}


@pytest.mark.parametrize(
    ("text", "patterns"),
    [
        ("What a moron", {"insult"}),
        ("You are a moron.", {"aimed insult"}),
        ("A moron is what you are!", {"aimed insult"}),
        ("You are not a moron.", {"aimed denied"}),
        ("not now or ever a moron", {"insult"}),
        ("She wrote that he was a moron", {"aimed reported"}),
        ("She wrote. A moron", {"insult"}),
        ("I will kill you", {"aimed threat"}),
        ("We kill time", set()),
        ("he said I will kill it", {"aimed reported"}),
        ("I will not hurt you", set()),
        ("Moron. You", {"insult"}),
        ("Moron! You scum; it is nice", {"insult", "aimed insult"}),
        ("", set()),
        ("...", set()),
    ],
)
def test_clauses(text, patterns):
    assert said(text) == patterns


def test_the_composed_machine_is_the_cascade():
    following, names = toxicity.composed(toxicity.CASCADE)
    for symbols in itertools.islice(itertools.product(toxicity.SYMBOLS, repeat=5), 0, None, 7):
        states, at = [0] * len(toxicity.CASCADE), 0
        for s in symbols:
            out, pattern = s, names[at][toxicity.SYMBOLS.index(s)]
            for k, machine in enumerate(toxicity.CASCADE):
                states[k], out = machine.step(states[k], out)
            at = following[at][toxicity.SYMBOLS.index(s)]
            kinds = {f"{kind} {int(aimed)}": n for n, (kind, aimed) in enumerate(toxicity.PATTERNS)}
            assert pattern == kinds.get(out, -1)


def test_learnt_stems_make_insults():
    assert said("So ein glimpfer", {"glimp": 3.0}) == {"insult"}
    assert said("So ein glim", {"glimp": 3.0}) == set()
    assert said("der Glimpf", {"glimpf$": 3.0}) == {"insult"} and said("der Glimpfe", {"glimpf$": 3.0}) == set()


def test_held_out_rows_are_told_apart(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.where("quality = 1").collect()}
    rows = [r for r in toxicity.scored(docs, labels).collect() if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    right = sum(r.predicted == truth[r.doc_id] for r in rows)
    caught = sum(r.predicted for r in rows if truth[r.doc_id]) / sum(truth[r.doc_id] for r in rows)
    assert right / len(rows) > 0.98 and caught > 0.88


def test_edge_cases(spark):
    rows = [(1, None, "en", "s", "x", "y"), (2, "", None, None, "x", "y"), (3, "you moron. " * 20_000, "en", "s", "x", "y"), (None, "you are scum, moron.", "en", "s", "x", "y"), (3, "you moron. " * 20_000, "en", "s", "x", "y"), (4, "z" * 100_000, "en", "s", "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA)
    for labels in ([], [(1, 0), (2, None), (None, 1)], [(1, 0), (3, 1), (3, 0), (3, 1)]):
        got = toxicity.scored(df, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        scores = {r.doc_id: r.score for r in got}
        assert scores[1] == scores[2] == scores[4] == min(scores.values()) and scores[3] > 0.5
        assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert toxicity.scored(df.limit(0), spark.createDataFrame([], "doc_id long, toxic int")).count() == 0
