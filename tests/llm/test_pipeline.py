"""The pipeline's stages against brute-force versions, and the entry module without the subpackage."""

import subprocess
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphtables.llm import quality
from graphtables.llm.common import table

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, found = table(spark, FOLDER, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER).cache()
        found.append((docs, out))
        docs = out
    return found


def test_quality_stage_keeps_what_the_labels_call_good(spark, stages):
    docs, kept = stages[0]
    assert kept.columns == docs.columns
    marks = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    left = {r.doc_id for r in kept.select("doc_id").collect()}
    right = sum((i in left) == bool(q) for i, q in marks.items())
    assert right >= 0.97 * len(marks)
    scored = quality.scored(docs, table(spark, FOLDER, "labels"))
    assert left == {r.doc_id for r in scored.where("kept").collect()}


def test_exact_stage_keeps_one_of_equal_texts(stages):
    docs, kept = stages[1]
    groups = defaultdict(list)
    for r in docs.collect():
        groups["".join((r.text or "").split(" ")).translate({c: None for c in range(9, 14)})].append((-len(r.text or ""), r.doc_id))
    assert {r.doc_id for r in kept.collect()} == {min(g)[1] for g in groups.values()}


def test_near_stage_keeps_one_of_each_group(stages):
    docs, kept = stages[2]
    sets, root = {}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        w = bytes.lower((r.text or "").encode()).split()
        own = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
        root[r.doc_id] = r.doc_id
        for i, other in sets.items():
            both = len(own & other)
            if both and 100 * both >= 80 * len(own | other):
                a, b = find(i), find(r.doc_id)
                root[max(a, b)] = min(a, b)
        sets[r.doc_id] = own
    assert {r.doc_id for r in kept.collect()} == {i for i in root if find(i) == i}


def test_packing_stage_and_run_hold_every_kept_text(spark, stages):
    from tokenizers import Tokenizer

    from graphtables.llm.queries import vocabulary

    encoder = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    docs, pieces = stages[3]
    got = defaultdict(dict)
    for r in corpus_pipeline.run(spark, FOLDER).collect():
        got[r.doc_id][r.start] = np.frombuffer(r.ids, "<u4").tolist()
    want = {r.doc_id: [*encoder.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs.collect()}
    assert {i: [x for s in sorted(p) for x in p[s]] for i, p in got.items()} == want
    assert pieces.agg(F.sum(F.length("ids"))).first()[0] == 4 * sum(map(len, want.values()))


def test_dedup_stages_keep_one_of_rows_that_repeat_or_lack_an_id(spark):
    long = "one two three four five six seven eight nine ten"
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "a b  c d e f"), (None, "abcdef"), (None, "alone here"), (None, "alone here"), (2, "other text of two"), (2, "a b c d e f"), (3, None), (3, ""), (4, long), (4, long + " x"), (9, long + " x y")]
    docs = spark.createDataFrame([(i, t, 7, "z") for i, t in rows], "doc_id long, text string, n int, text_hash string")
    left = corpus_pipeline.exact_stage(spark, docs, FOLDER)
    assert left.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text) for r in left.collect())
    assert [g for g in got if g[0] != 3] == [(0, "alone here"), (1, "a b  c d e f"), (2, "other text of two"), (4, long), (4, long + " x"), (9, long + " x y")]
    assert sum(i == 3 for i, _ in got) == 1
    near = corpus_pipeline.near_stage(spark, docs, FOLDER)
    assert near.columns == docs.columns
    got = sorted((r.doc_id or 0, r.text or "") for r in near.collect())
    assert (9, long + " x y") not in got and (4, long) in got
    assert [g for g in got if g[0] == 0] == [(0, "abcdef"), (0, "alone here")] and sum(g == (1, "a b c d e f") for g in got) == 1


def test_stages_keep_columns_whose_names_clash(spark):
    names = "n s vote kept evidence posterior row rest text_hash component id digest v _n _s _chosen_n _own_doc_id".split()
    docs = table(spark, FOLDER, "documents").where("doc_id < 40")
    wide = docs.select("*", *(F.lit(c).alias(c) for c in names))
    for _, stage in corpus_pipeline.STAGES[:3]:
        kept = stage(spark, wide, FOLDER)
        assert kept.columns == wide.columns
        rows = kept.collect()
        assert {r.doc_id for r in rows} == {r.doc_id for r in stage(spark, docs, FOLDER).collect()}
        assert all(r[c] == c for r in rows for c in names)
    pieces = docs.select("*", *(F.lit("x").alias(c) for c in ("ids", "start", "offset", "sequence_id", "doc_tokens", "length")))
    shown = lambda df: sorted((r.doc_id, r.start, bytes(r.ids)) for r in df.collect())
    assert shown(corpus_pipeline.packing_stage(spark, pieces, FOLDER)) == shown(corpus_pipeline.packing_stage(spark, docs, FOLDER))


def test_entry_without_the_subpackage(tmp_path):
    root = Path(__file__).parents[2]
    (tmp_path / "__spark_entry__.py").write_text((root / "__spark_entry__.py").read_text())
    for f in root.glob("graphtables/**/*.py"):
        if "llm" not in f.parts:
            to = tmp_path / f.relative_to(root)
            to.parent.mkdir(parents=True, exist_ok=True)
            to.write_text(f.read_text())
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, set(e.oracle_sql()) <= set(q))"], cwd=tmp_path, capture_output=True, text=True)
    n, pipeline, covered = said.stdout.split()
    assert int(n) > 60 and pipeline == "False" and covered == "True", said.stderr
