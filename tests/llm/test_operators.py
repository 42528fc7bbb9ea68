"""Every corpus operator against a brute-force version, with nulls, empty and long texts, ties and clashing columns."""

import math
import random
import textwrap
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphtables.llm import ann, exact_dedup, license_scan, lm_score, near_dedup, packing, quality, reshard, sentence_pieces, token_store, tokens
from graphtables.llm.common import WordHashes
from graphtables.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, shard string, n string, kept string"


def corpus():
    r = random.Random(5)
    words = ["".join(r.choice("abcdeéü") for _ in range(r.randrange(1, 8))) for _ in range(300)]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 120))) for _ in range(60)]
    near = texts[0].split() + ["x"] * 60
    for k in range(8):
        changed = list(near)
        changed[5 * k] = f"new{k}"
        texts.append(" ".join(changed))
    texts += [None, "", " \n\t", "one", "One two", "ONE  two", texts[3], texts[3], texts[3].replace(" ", "\n"), " ".join(words * 40), "a" * 9000, "a" * 9001, "Σίσυφος ΣΑΣ\x1cx", "!!! ??? ###"]
    return list(enumerate(texts))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, "site" if i % 2 else None, 1, "x", "y", "z", "w") for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_near_dedup_matches_brute_force(docs, none):
    got = by_id(near_dedup.near_duplicates(docs, width=4, block=4))
    sets, root = {}, {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, t in corpus():
        w = bytes.lower((t or "").encode()).split()
        sets[i] = {tuple(w[j : j + 4]) for j in range(max(1, len(w) - 3))} if w else set()
        root[i] = i
    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}
    assert near_dedup.near_duplicates(none).count() == 0


def test_similarity_estimate_is_corrected_for_collisions():
    hasher = near_dedup.MinHasher(64, 8, 2)
    a = np.unique(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64))
    planes = [np.frombuffer(hasher.planes(hasher.minima(x)), np.uint8).reshape(2, -1).view(np.uint64) for x in (a[:900], a[100:], a)]
    est = near_dedup.similarity(planes[0], np.stack(planes[1:]), 512)
    assert abs(est[0] - 800 / len(a)) < 0.1 and abs(est[1] - 0.9) < 0.1


def test_exact_dedup_matches_brute_force(docs, none):
    got = by_id(exact_dedup.exact_duplicates(docs, block=8))
    groups = defaultdict(list)
    for i, t in corpus():
        groups["".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")].append((-len(t or ""), i))
    for norm, members in groups.items():
        keep = min(members)[1]
        for _, i in members:
            assert tuple(got[i]) == (i, keep, len(members), i == keep, sha256(norm.encode()).hexdigest())
    assert len(got) == len(corpus()) and exact_dedup.exact_duplicates(none).count() == 0


def test_exact_dedup_is_not_misled_by_equal_prefixes(spark):
    rows = [(1, "ab" * 20), (2, "ab" * 19 + "ac"), (3, "a b" * 20), (1, "ab" * 20)]
    got = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), block=2).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(1, 3, 3), (1, 3, 3), (2, 2, 1), (3, 3, 3)]


def tokenizer(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_packing_holds_every_id_once(docs, none):
    encode, rows = tokenizer("byte_bpe_50k.json"), packing.packed(docs, vocabulary("byte_bpe_50k.json")).collect()
    texts, sequences = defaultdict(dict), defaultdict(dict)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        texts[r.doc_id][r.start] = ids
        sequences[r.sequence_id][r.offset] = len(ids)
    for i, t in corpus():
        assert [x for s in sorted(texts[i]) for x in texts[i][s]] == [*encode(t), 0]
    for pieces in sequences.values():
        at = 0
        for offset in sorted(pieces):
            assert offset == at and pieces[offset] > 0
            at += pieces[offset]
        assert at <= 1024
    total = sum(len(x) for d in texts.values() for x in d.values())
    assert len(sequences) <= total / 1024 + 6
    digest = packing.digest(packing.packed(docs, vocabulary("byte_bpe_50k.json"))).where("doc_id = 1 AND start = 0").first()
    assert digest.ids_crc32 == zlib.crc32(np.array(texts[1][0], "<u4").tobytes())
    assert packing.packed(none, vocabulary("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_get_the_ids_of_the_plain_library(spark, name):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary(name))
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|startoftext|>b <|endoftext|><|endoftext|>", "<|ENDOFTEXT|> <|endoftext>", "é <|endoftext|>\n\n  it's 12"]
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert library.token_to_id("<|endoftext|>") in want[0]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    if name.startswith("byte"):
        got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in packing.packed(df, vocabulary(name)).collect()}
        assert got == {i: [*ids, 0] for i, ids in want.items()}
    else:
        got = by_id(token_store.token_digest(df, vocabulary(name)))
        assert {i: (r.n_tokens, r.ids_crc32) for i, r in got.items()} == {i: (len(ids) + 1, zlib.crc32(np.array([*ids, 2], "<u4").tobytes())) for i, ids in want.items()}


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_controls_and_white_space_get_the_ids_of_the_library(name):
    r, library = random.Random(3), tokenizer(name)
    letters = " \n\t\r\xa0\x0b\x0c'sdtrevlmLL12_-.,!\x00\x01\x1b\x1c\x1d\x1e\x1f\x7f\x85İıßé²½—€\u0301Σ"
    texts = ["".join(r.choice(letters[:n]) for _ in range(r.randrange(40))) for n in (33, len(letters)) for _ in range(500)]
    texts += ["", " ", "\n\n a", "it's IT'S 's", *(f"a{c}b {c} c" for c in map(chr, range(0x100)))]
    ids, counts = tokens.PieceEncoder(vocabulary(name))(texts)
    ends = np.cumsum(counts)
    assert len(ends) == len(texts) and all(ids[e - n : e].tolist() == library(t) for t, e, n in zip(texts, ends, counts))


def test_caches_of_long_pieces_stay_bounded():
    r = random.Random(9)
    texts = ["".join(r.choice("字学生中文大小") for _ in range(400)) for _ in range(40)]
    most, longest = 50, max(map(len, texts)) + 2
    encoder = tokens.PieceEncoder(vocabulary("byte_bpe_50k.json"), most=most)
    pieces = sentence_pieces.SentencePieces(vocabulary("piece_bpe_32k.model"), most=most)
    hashes = WordHashes(most=most)
    for t in texts:
        ids, _ = encoder([t])
        assert ids.tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
        pieces.encode([t])
        hashes([t.encode()])
        assert max(encoder.known.characters, pieces.words.characters) <= 32 * most + longest
        assert sum(map(len, hashes.known)) <= 32 * most + 3 * longest


def test_differencing_is_near_equal():
    r = random.Random(2)
    sizes = [r.randrange(1, 200) for _ in range(400)]
    parts = packing.differencing(sizes, 16)
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert sorted(i for p in parts for i in p) == list(range(400)) and max(sums) - min(sums) < 20
    assert packing.windows_of([1000, 1000, 30], 1024) and packing.windows_of([], 1024) == []


def test_token_store_round_trip(docs, none):
    encode, got, start = tokenizer("word_bpe_49k.json"), by_id(token_store.token_digest(docs, vocabulary("word_bpe_49k.json"))), 0
    for i, t in corpus():
        ids = [*encode(t), 2]
        assert tuple(got[i]) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_store.token_digest(none, vocabulary("word_bpe_49k.json")).count() == 0


@pytest.mark.parametrize("counts", [[0, 5], [1] * 70_000, [2**k for k in range(40)], [3, 0, 1, 1, 0, 9]])
def test_codes_are_prefix_free_limited_and_decodable(counts):
    counts = np.array(counts, np.int64)
    lengths = token_store.code_lengths(counts)
    assert lengths.max() <= token_store.LIMIT and ((lengths > 0) == (counts > 0)).all()
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    ids = np.random.default_rng(3).choice(np.flatnonzero(counts), 1700)
    bits, begin = token_store.pack_bits(ids, token_store.canonical(lengths), lengths)
    assert (token_store.Decoder(lengths)(bits, begin[:: token_store.STEP], len(ids)) == ids).all()


def test_sentence_pieces_equal_the_library(docs, none):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    got = by_id(sentence_pieces.encoded(docs, vocabulary("piece_bpe_32k.model")))
    for i, t in corpus():
        ids = [*model.encode(t or ""), model.eos_id()]
        assert got[i].ids == ids and got[i].decoded == model.decode(ids)
    d = sentence_pieces.digest(sentence_pieces.encoded(docs, vocabulary("piece_bpe_32k.model"))).where("doc_id = 3").first()
    assert d.ids_sha256 == sha256(" ".join(map(str, got[3].ids)).encode()).hexdigest() and d.decoded_sha256 == sha256(got[3].decoded.encode()).hexdigest()
    assert sentence_pieces.encoded(none, vocabulary("piece_bpe_32k.model")).count() == 0


def test_merge_rounds_equal_the_library_on_random_words():
    from sentencepiece import SentencePieceProcessor

    file, r = vocabulary("piece_bpe_32k.model"), random.Random(4)
    model, own = SentencePieceProcessor(model_file=file), sentence_pieces.SentencePieces(file)
    texts = ["".join(r.choice("aabn in.=-\n▁中é\x00") for _ in range(r.randrange(90))) for _ in range(400)]
    ids, counts = own.encode(texts)
    for text, found in zip(texts, np.split(ids, np.cumsum(counts)[:-1])):
        assert found.tolist() == model.encode(text)
        assert own.decode(found) == model.decode(found.tolist())


@pytest.mark.parametrize("order", [2, 3])
def test_scores_match_brute_force(docs, none, order):
    got = by_id(lm_score.scores(docs, order=order, chunk_bytes=3000, span_keys=200))
    texts = {i: [*bytes.lower((t or "").encode()).split(), b""] for i, t in corpus()}  # no word is empty: the end
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in texts}
    c = Counter(w for i, ws in texts.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    starts = sum(not h for h in held.values())
    learnt = [[None, *ws] for i, ws in texts.items() if not held[i]]
    pairs = Counter(p for ws in learnt for p in zip(ws, ws[1:]))
    triples = Counter(t for ws in learnt for t in zip(ws, ws[1:], ws[2:]))
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    p2 = lambda b, w: (pairs[(b, w)] + 30 * p1(w)) / ((starts if b is None else c[b]) + 30)
    p3 = lambda a, b, w: (triples[(a, b, w)] + 10 * p2(b, w)) / (pairs[(a, b)] + 10)
    for i, ws in texts.items():
        base = sum(math.log10(p1(w)) for w in ws)
        h = [None, *ws]
        score = math.log10(p2(None, ws[0])) + sum(math.log10(p3(*t) if order > 2 else p2(*t[1:])) for t in zip(h, h[1:], h[2:]))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
    assert lm_score.scores(none).count() == 0


def test_neighbours_match_brute_force(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(700, 16)).astype(np.float32).tolist()
    x[5], x[6], x[7], x[8], x[9], x[10] = None, [0.0] * 16, [None, *x[7][1:]], [float("nan"), *x[8][1:]], x[100], x[100]
    x[11], x[12] = [float("inf"), *x[11][1:]], [1.0, 2.0]
    df = spark.createDataFrame([(i, v, "q") for i, v in enumerate(x)], "vec_id long, embedding array<float>, score string").repartition(5)
    got = defaultdict(list)
    for row in ann.nearest(df, df.where("vec_id % 100 = 0"), query_block=3, block=64).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.rank, row.vec_id, row.score))
    early = ann.nearest(df, df.where("vec_id % 100 = 0"), query_block=3, block=64, held=2).orderBy("query_id", "rank")
    assert [tuple(r) for r in early.collect()] == [(q, *hit) for q in sorted(got) for hit in got[q]]
    bad = {5, 6, 7, 8, 11, 12}
    good = [i for i in range(700) if i not in bad]
    for q in range(0, 700, 100):
        d = sorted((float(np.sqrt(((np.array(x[i], np.float64) - np.array(x[q], np.float64)) ** 2).sum())), i) for i in good if i != q)[:10]
        assert [(k, i) for k, i, _ in got[q]] == [(k + 1, i) for k, (_, i) in enumerate(d)]
        assert np.allclose([s for _, _, s in got[q]], [s for s, _ in d], rtol=0, atol=1e-12)
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0


def test_neighbours_of_many_cells_pass_no_vectors_through_the_driver(spark):
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(900, 8)), 1).astype(np.float32).astype(np.float64)
    x[r.choice(900, 80, replace=False)] = x[0]  # a common vector: more ties than neighbours, in every cell
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(3)
    for held in (7, 1000):
        found = ann.nearest(df, df.where("vec_id % 5 = 0"), query_block=4, block=8, held=held)
        got = defaultdict(list)
        for row in found.collect():
            got[row.query_id].append((row.rank, row.vec_id, row.score))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "isFinalPlan=true" in plan and "Broadcast" not in plan
        assert len(got) == 180
        for q, hits in got.items():
            d = np.sqrt(np.cumsum((x - x[q]) ** 2, axis=1)[:, -1])
            d[q] = np.inf
            nearest = sorted(zip(d.tolist(), range(900)))[:10]
            assert sorted(hits) == [(k + 1, i, s) for k, (s, i) in enumerate(nearest)]


def test_reshard_levels_bytes_and_keeps_rows(docs, none, tmp_path):
    rows = reshard.digest(reshard.resharded(docs, str(tmp_path / "a"), shards=4)).collect()
    texts = dict(corpus())
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    even = sorted(sizes.values())[:-1]  # one text alone outweighs a shard
    assert max(even) - min(even) < 300
    assert len({r.shard for r in rows if texts[r.doc_id] == texts[3]}) == 1
    assert reshard.resharded(none, str(tmp_path / "b"), shards=4).count() == 0


def test_reshard_levels_a_text_that_a_third_of_all_rows_share(spark, tmp_path):
    rows = [(i, "hot " * 20 if i % 3 == 0 else f"text {i} " * 8) for i in range(30_000)]
    out = reshard.resharded(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "hot"), shards=40)
    sizes = [r["b"] for r in out.groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(sizes) == 40 and max(sizes) - min(sizes) < 0.05 * sum(sizes) / 40


def test_rows_without_an_id_are_kept(spark):
    text = "one two three four five six"
    rows = [(None, text), (None, text), (None, None), (4, text), (5, text + " "), (6, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    exact = sorted((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_duplicates(df).collect())
    assert exact == [(0, None, 1, True)] * 3 + [(4, 5, 2, False), (5, 5, 2, True), (6, 6, 2, True), (7, 6, 2, False)]
    near = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in near_dedup.near_duplicates(df).collect())
    assert near == [(0, 0, True)] * 3 + [(4, 4, True), (5, 4, False), (6, 6, True), (7, 7, True)]
    stored = token_store.token_digest(df, vocabulary("word_bpe_49k.json")).collect()
    assert sorted(r.doc_id or 0 for r in stored) == [0, 0, 0, 4, 5, 6, 7] and sum(r.doc_id is None for r in stored) == 3
    assert sum(r.doc_id is None for r in lm_score.scores(df).collect()) == 3
    assert sum(r.doc_id is None for r in packing.packed(df, vocabulary("byte_bpe_50k.json")).collect()) == 3
    assert sum(r.doc_id is None for r in sentence_pieces.encoded(df, vocabulary("piece_bpe_32k.model")).collect()) == 3
    labels = spark.createDataFrame([(4, 1, 0), (6, 0, 0), (None, 1, None)], "doc_id long, quality int, toxic int")
    assert quality.scored(df.selectExpr("*", "null AS lang", "null AS source"), labels).count() == 7
    assert license_scan.licenses(df).count() == 0


def test_small_sets_link_at_the_bound(spark):
    sets = [f"w{k} a{k} b{k} c{k} d{k} e{k} f{k}" for k in range(200)]  # four shingles of four words
    rows = [(2 * k + j, s + (f" z{k}" if j else "")) for k, s in enumerate(sets) for j in range(2)]  # 4 of 5: at 0.8
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)


def test_components_of_long_paths(spark):
    from graphtables.llm.common import components

    ids = list(range(100))
    random.Random(1).shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(1000, 1001), (1002, 1001), (5, 5)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "test").collect()}
    assert got == {i: 0 for i in range(100)} | {i: 1000 for i in (1000, 1001, 1002)}


def test_flow_moves_the_fewest_bytes():
    supply, capacity = [50, 5, 20, 25], [25, 25, 25, 25]
    sent = reshard.flow(supply, capacity, [[int(i != j) for j in range(4)] for i in range(4)])
    assert sum(v for (i, j), v in sent.items() if i != j) == 25
    assert [sum(v for (i, _), v in sent.items() if i == k) for k in range(4)] == supply
    uneven = reshard.flow([10, 10], [10, 10], [[5, 1], [1, 5]])
    assert uneven == {(0, 1): 10, (1, 0): 10}


def test_rewrite_touches_only_folders_that_lose_blocks(spark, tmp_path):
    rows = [(i, f"{i:084d}", 0 if i < 3000 else 1 if i < 4000 else 2) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    layout = reshard.Layout(spark, str(tmp_path / "x"), 3, 512, 4)
    layout.write(df, F.col("shard"))
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "x" / "old").rglob("*.parquet")}
    out = layout.rewrite()
    assert {s for s, _ in layout.touched} == {0} and len(layout.touched) <= layout.folders
    assert before == {f: f.stat().st_mtime_ns for f in (tmp_path / "x" / "old").rglob("*.parquet")}
    assert not any("old_shard=2" in str(f) or "old_shard=1" in str(f) for f in (tmp_path / "x" / "new").rglob("*"))
    got = out.collect()
    assert sorted((r.doc_id, r.text, r.old_shard) for r in got) == rows
    moved = [r for r in got if r.shard != r.old_shard]
    assert {(r.old_shard, r.shard) for r in moved} == {(0, 1)} and 900 < len(moved) < 1100
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and max(map(len, slots.values())) < 2100


def test_moved_bytes_are_near_the_flow_bound():
    r = random.Random(9)
    blocks = {(s, c, 0): r.randrange(500, 1500) * (2 if s < 3 else 1) for s in range(12) for c in range(256)}
    placed = reshard.moves(blocks, 12)
    moved, least = reshard.moved_bytes(blocks, placed, 12)
    sizes = Counter()
    for b, s in placed.items():
        sizes[s] += blocks[b]
    assert least <= moved + 12 * 3000 and moved <= 1.02 * least and max(sizes.values()) - min(sizes.values()) <= 320_000 / 400
    given_up = reshard.moves({(s, c, 0): 10 for s in range(4) for c in range(50)}, 3)  # a shard that is no more
    assert set(given_up.values()) == {0, 1, 2} and all(s == b[0] for b, s in given_up.items() if b[0] < 3)


def test_license_scan_names_the_wording(spark, none):
    rows = [(1, "words here\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "Released under the MIT License."), (3, None), (4, "The warranty of my fridge is over"), (5, "This work is licensed under the GNU General Public License, version 3."), (6, "Licensed under CC BY-NC 4.0.")]
    got = license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.block, r.license) for r in got if r.confirmed} == {(1, 1, "Apache-2.0"), (2, 0, "MIT"), (5, 0, "GPL"), (6, 0, "CC-BY-NC")}
    assert all(r.missing == 0 and r.saved > 0.3 for r in got if r.confirmed)
    assert {r.doc_id for r in got if not r.confirmed} == {4}
    assert license_scan.licenses(none).count() == 0


def test_license_scan_reads_wrapped_and_shared_lines(spark):
    mit, bsd, gpl = license_scan.TEMPLATES["MIT"][1], license_scan.TEMPLATES["BSD"][0], license_scan.TEMPLATES["GPL"][1]
    wrap = lambda text, mark: "\n".join(mark + line for line in textwrap.wrap(text, 72))
    both = "filler words " * 300 + license_scan.TEMPLATES["Apache-2.0"][0] + " more filler " * 3 + "Released under the MIT License." + " end" * 900
    rows = [(1, "x\n" + wrap(mit, "")), (2, wrap(bsd, " * ")), (3, "a\nb\n" + wrap(gpl, "# ")), (4, both), (5, wrap(mit + ". " + gpl, "// ")), (6, "All rights\n# reserved.")]
    got = license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.block, r.license, r.missing) for r in got if r.confirmed) == [(1, 1, "MIT", 0), (2, 0, "BSD", 0), (3, 2, "GPL", 0), (4, 0, "Apache-2.0", 0), (4, 0, "MIT", 0), (5, 0, "MIT", 0), (5, 2, "GPL", 0), (6, 0, "ARR", 0)]


def test_license_scan_confirms_no_other_license(spark):
    nd = "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."
    other = ["Licensed under the Mozilla License, Version 2.0", "EUPL License, Version 1.2", "Released under the Foo License.", nd, nd.replace("NoDerivatives", "ShareAlike"), "Licensed under CC BY-NC-ND 4.0."]
    other += ["Licensed under the Apache License, Version 1.1", license_scan.TEMPLATES["GPL"][1].replace("GNU", "GNU Lesser"), "This work is licensed under the GNU Library General Public License, version 2."]
    own = [(name, w) for name, wordings in license_scan.TEMPLATES.items() for w in wordings]
    rows = list(enumerate([*other, *(w for _, w in own)]))
    got = license_scan.licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in got if r.confirmed} == {(len(other) + i, name) for i, (name, _) in enumerate(own)}
    assert {r.doc_id for r in got} == {i for i, _ in rows}


def test_license_scan_aligns_blocks_longer_than_a_piece():
    scanner, filler = license_scan.Scanner(3, 4, 0.2), " the license of words " * 1200
    notices = [w for ws in license_scan.TEMPLATES.values() for w in ws]
    got = [h[6] for h in scanner(filler.join(["", *notices, ""])) if h[5]]
    assert len(got) == len(notices)


def test_quality_shrinks_sparse_sites(spark, docs, none):
    r = random.Random(6)
    good = lambda: " ".join(r.choice(["the", "of", "house", "tree", "river"]) for _ in range(80)) + "."
    bad = lambda: " ".join(r.choice(["BUY!!", "NOW!!", "###"]) for _ in range(80))
    rows = [(i, bad() if i % 5 == 0 else good(), "en", f"s{i % 3}" if i > 2 else "rare") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 300, 2)], "doc_id long, quality int, toxic int")
    got = by_id(quality.scored(df, labels))
    assert all(got[i].kept == (i % 5 != 0) for i in range(300))
    assert abs(got[1].site_prior - 0.8) < 0.15
    assert len(by_id(quality.scored(docs, labels))) == len(corpus())
    assert quality.scored(none, labels.limit(0)).count() == 0
    assert "text" in quality.scored(df, labels, keep=("text",)).columns
    clashing = df.selectExpr("*", "'x' AS _site", "'x' AS n", "'x' AS s", "'x' AS vote", "'x' AS kept", "'x' AS Evidence")
    marks = by_id(quality.scored(clashing, labels, keep=("n", "s", "vote", "kept")))
    assert all((marks[i].kept, marks[i].posterior, marks[i].n) == (got[i].kept, got[i].posterior, "x") for i in range(300))


def test_quality_posteriors_match_plain_sums(spark):
    r = random.Random(9)
    text = lambda good: " ".join(r.choice(["the", "of", "house"] if good else ["BUY!!", "NOW!!", "###"]) for _ in range(40))
    rows = [(i, text(r.random() < (0.9 if i % 4 else 0.2)), r.choice(["en", "de", None]), f"s{i % 4}" if i % 9 else None) for i in range(400)]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int("the" in t), 0) for i, t, _, _ in rows[::2]] + [(0, 0, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.scored(df, labels).collect()
    vote = lambda g: 1 / (1 + math.exp(-g.evidence))
    paths, sites = defaultdict(list), defaultdict(list)
    for g in got:
        paths[(g.source, g.lang)].append(vote(g))
        sites[g.source].append(vote(g))
    every = [v for own in sites.values() for v in own]
    mean = min(max(sum(every) / len(every), 1e-3), 1 - 1e-3)

    def strength(groups):  # of (n, sum, toward)
        n = sum(g[0] for g in groups)
        between = sum(k * (s / k - t) ** 2 for k, s, t in groups) / n - mean * (1 - mean) * len(groups) / n
        return min(max(mean * (1 - mean) / max(between, 1e-9) - 1, 1.0), 1e4)

    k_site = strength([(len(v), sum(v), mean) for v in sites.values()])
    prior = {s: (sum(v) + k_site * mean) / (len(v) + k_site) for s, v in sites.items()}
    k_path = strength([(len(v), sum(v), prior[s]) for (s, _), v in paths.items()])
    chosen = {d: max(int("the" in rows[d][1]), 0) for d in range(0, 400, 2)}
    share = sum(chosen.values()) / len(chosen)
    for g in got:
        own, there = paths[(g.source, g.lang)], sites[g.source]
        site = (sum(there) - vote(g) + k_site * mean) / (len(there) - 1 + k_site)
        path = (sum(own) - vote(g) + k_path * site) / (len(own) - 1 + k_path)
        p = min(max(path, 1e-3), 1 - 1e-3)
        posterior = 1 / (1 + math.exp(-(g.evidence - math.log(share / (1 - share)) + math.log(p / (1 - p)))))
        assert math.isclose(g.site_prior, site, abs_tol=2e-6) and math.isclose(g.path_prior, path, abs_tol=2e-6) and math.isclose(g.posterior, posterior, abs_tol=2e-6)
        assert g.kept == (g.posterior >= 0.5)
    assert {(g.evidence, g.kept) for g in quality.scored(df, labels.limit(0)).collect()} == {(2.0, True)}


def test_license_ranking_by_compression_finds_what_aligning_every_template_finds():
    r = random.Random(3)
    filler = ["".join(r.choice("theandofin") for _ in range(r.randrange(2, 9))) for _ in range(400)]
    every, some = license_scan.Scanner(3, len(license_scan.TEMPLATES) * 9, 0.2), license_scan.Scanner(3, 6, 0.2)
    notices = [(name, w) for name, ws in license_scan.TEMPLATES.items() for w in ws]
    caught = 0
    for _ in range(150):
        parts = []
        for _ in range(r.randrange(1, 4)):
            parts += [" ".join(r.choice(filler) for _ in range(r.randrange(0, 80))), r.choice(notices)[1]]
        words = " ".join(parts).split(" ")
        if r.random() < 0.5:
            words[r.randrange(len(words))] = "changed"
        text = " ".join(words) + r.choice(["", " Copyright of nobody"])
        one, two = ([(h[0], h[1], h[3], h[4], h[6]) for h in s(text) if h[5]] for s in (some, every))
        assert one == two
        caught += len(one)
    assert caught > 150
    name, share, missing, added = some.nearest("SPDX-License-Identifier: BSD-2-Clause")
    assert name == "BSD" and missing == added == 0 and share > 0.3


def test_large_families_are_linked_across_blocks_and_repeated_ids_keep_their_own_links(spark):
    r = random.Random(8)
    base = [f"w{r.randrange(4000)}" for _ in range(160)]
    rows = []
    for k in range(90):  # near copies of one text, and a chain that drifts away from it word by word
        w = list(base)
        w[r.randrange(160)] = f"n{k}"
        rows.append((k, " ".join(w)))
    w = list(base)
    for k in range(60):
        w[2 * k] = f"d{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(3, "quite another text than the first with the same number " * 2), (200, "quite another text than the first with the same number " * 2 + "x"), (5, "words of its own"), (5, "words of its own")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [(i, {tuple(t.split()[j : j + 4]) for j in range(max(1, len(t.split()) - 3))}) for i, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(rows)):
        for y in range(x):
            both = len(sets[x][1] & sets[y][1])
            if both and 100 * both >= 80 * len(sets[x][1] | sets[y][1]):
                root[find(x)] = find(y)
    least = defaultdict(list)
    for x, (i, _) in enumerate(rows):
        least[find(x)].append(i)
    want = sorted((i, len(s), min(least[find(x)])) for x, (i, s) in enumerate(sets))
    for block, tiled in ((16, 16), (16, 2), (512, 16)):
        got = near_dedup.near_duplicates(df, width=4, block=block, tiled=tiled).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
