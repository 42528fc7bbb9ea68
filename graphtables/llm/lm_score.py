"""Language-model scoring by a weighted backoff automaton of order two or three.

States are histories: the root, every word of the training texts and the start of a text, and every pair of neighbours.
Arcs are the words that follow a history in training: from the root every word, from a word every pair, from a pair every
triple. The root deals add-one unigrams. A longer history seen c times has a prior of some tokens dealt as the next
shorter history deals them: an arc seen n times has probability (n + prior * p) / (c + prior), with p the probability
there, and the failure arc to the history without its first word weighs prior / (c + prior), so what every state gives to
all words sums to one. A text is one walk from left to right: it takes the arc of its state if there is one, else failure
arcs until there is, and goes on in the longest history that training knows. No count is cut off or capped. Order two
has no states of pairs.

Texts are turned into chunks of word numbers with a vocabulary of their own. A chunk's different words, pairs and triples
are sorted 64-bit keys; they are cut in ranges of keys that all chunks share, and one group adds up one range and hands
each chunk its counts back in the chunk's own order. So no task ever holds the automaton of the corpus, and a key occurs
in a group once for each chunk, however frequent it is. Keys travel as packed differences. There are never more rows
than keys, as a row holds one at least.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, binary, mixed, packed, saved, slices, unpacked, word_hashes

#: Keys that no word hashes to but by a chance of 2**-64: the end of a text, and the state before its first word.
END, START = np.uint64(1), np.uint64(2)
LEFT, RIGHT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
KINDS = WORDS, PAIRS, TRIPLES = 0, 1, 2
CHUNK = "chunk long, doc_ids binary, named binary, counts binary, held binary, words binary, keys binary, n_words long, n_tokens long, learnt long"
GRAMS = "kind int, span long, chunk long, keys binary, seen binary"
COUNTED = "chunk long, kind int, span long, c binary, total long, known long"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
#: Tokens of a text that are walked in one go; the state behind them is known from the last two, so the walk goes on there.
STRETCH = 2048


def held_out(doc_ids: list[int | None], modulus: int, remainder: int) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % modulus == remainder for i in doc_ids], bool)


def chunks(docs: DataFrame, modulus: int, remainder: int, chunk_bytes: int) -> DataFrame:
    """One row for each chunk of whole texts: word numbers, and the sorted keys of the chunk's vocabulary."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, number, part = word_hashes(), 0, TaskContext.get().partitionId() << 33
        for rows in slices(batches, "text", chunk_bytes):
            doc_ids = rows.column(0).to_pylist()
            keys, counts = [], []
            for text in binary(rows, "text"):
                own = hashes(text.translate(LOWER).split())
                keys.append(np.array([*own, END], np.uint64))
                counts.append(len(own) + 1)
            vocabulary, words = np.unique(np.concatenate(keys), return_inverse=True)
            held = held_out(doc_ids, modulus, remainder)
            row = {
                "chunk": part + number,
                "doc_ids": np.array([i or 0 for i in doc_ids], "<i8").tobytes(),
                "named": np.array([i is not None for i in doc_ids], bool).tobytes(),
                "counts": np.array(counts, "<i8").tobytes(),
                "held": held.tobytes(),
                "words": packed(words),
                "keys": packed_keys(vocabulary),
                "n_words": len(vocabulary),
                "n_tokens": len(words),
                "learnt": int((~held).sum()),
            }
            number += 1
            yield pa.RecordBatch.from_pylist([row], pa.schema([(k, pa.int64() if isinstance(v, int) else pa.binary()) for k, v in row.items()]))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(build, CHUNK)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return packed(np.diff(keys, prepend=np.uint64(0)).view(np.int64))


def unpacked_keys(x: bytes) -> np.ndarray:
    return np.cumsum(unpacked(x).view(np.uint64))


class Tokens:
    """A chunk's tokens: for each the number of its word, and the numbers of the pair and the triple that end with it.

    A pair's first word may be the start of the text (numbered behind the words); the first token of a text ends no triple.
    At order two there are no triples."""

    def __init__(self, row: dict, order: int):
        self.keys, self.words = unpacked_keys(row["keys"]), unpacked(row["words"]).astype(np.int32)
        self.sizes = np.frombuffer(row["counts"], "<i8")
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.before = np.append(np.int32(len(self.keys)), self.words[:-1])
        self.before[self.begins] = len(self.keys)
        own = np.append(self.keys, START)
        pair = mixed(own[self.before] * LEFT + own[self.words] * RIGHT)
        self.pairs, number = np.unique(pair, return_inverse=True)
        self.pair = number.astype(np.int32)
        inner = np.ones(len(pair), bool)
        inner[self.begins] = False
        self.inner = np.flatnonzero(inner if order > 2 else np.zeros(len(pair), bool))
        self.triples, number = np.unique(mixed(pair[self.inner - 1] * RIGHT + own[self.words[self.inner]] * LEFT), return_inverse=True)
        self.triple = np.full(len(pair), -1, np.int32)
        self.triple[self.inner] = number

    def grams(self, learnt: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """kind, sorted keys, and how often each is seen in training texts."""
        yield WORDS, self.keys, np.bincount(self.words[learnt], minlength=len(self.keys))
        yield PAIRS, self.pairs, np.bincount(self.pair[learnt], minlength=len(self.pairs))
        if len(self.triples):
            yield TRIPLES, self.triples, np.bincount(self.triple[self.inner][learnt[self.inner]], minlength=len(self.triples))


def spans(keys: np.ndarray, most: int) -> np.ndarray:
    """The range that each key falls in; sorted keys have ascending ranges."""
    return ((keys >> np.uint64(32)) * np.uint64(most)) >> np.uint64(32)


def grams(chunked: DataFrame, most: dict[int, int], order: int) -> DataFrame:
    """A row for each chunk, kind and range of keys in it: the sorted keys, and how often each is seen in training."""
    schema = pa.schema([("kind", pa.int32()), ("span", pa.int64()), ("chunk", pa.int64()), ("keys", pa.binary()), ("seen", pa.binary())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in (r for batch in batches for r in batch.to_pylist()):
            tokens = Tokens(r, order)
            learnt = np.repeat(~np.frombuffer(r["held"], bool), tokens.sizes)
            for kind, keys, seen in tokens.grams(learnt):
                span = spans(keys, most[kind])
                cuts = np.flatnonzero(np.diff(span, prepend=span[0] + np.uint64(1))) if len(span) else []
                edges = [*cuts, len(keys)]
                out = [(kind, int(span[a]), r["chunk"], packed_keys(keys[a:b]), packed(seen[a:b])) for a, b in zip(edges, edges[1:])]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return chunked.select("chunk", "counts", "held", "words", "keys").mapInArrow(rows, GRAMS)


def added_up(group: pd.DataFrame) -> pd.DataFrame:
    """Counts over all training texts for each chunk's keys of a range; the range's sums stand in its first row."""
    keys = [unpacked_keys(k) for k in group["keys"]]
    different, at = np.unique(np.concatenate(keys), return_inverse=True)
    c = np.bincount(at, np.concatenate([unpacked(x) for x in group["seen"]]), len(different)).astype("<i8")  # sums below 2**53 are exact
    own = np.split(c[at], np.cumsum([len(k) for k in keys])[:-1])
    rest = [0] * (len(group) - 1)
    return pd.DataFrame({"chunk": group["chunk"], "kind": group["kind"], "span": group["span"], "c": [packed(x) for x in own], "total": [int(c.sum()), *rest], "known": [int((c > 0).sum()), *rest]})


def walked(tokens: Tokens, n: dict[int, np.ndarray], root: np.ndarray, starts: int, priors: tuple[float, float], order: int) -> np.ndarray:
    """The log10 probability of every token of a chunk, by walks from left to right, side by side over texts.

    n: training counts of the chunk's words, pairs and triples; root: probabilities of its words at the root. States are
    numbered: 0 the root, then words and the start, then pairs."""
    words = len(tokens.keys)
    seen = np.append(n[WORDS], starts)  # of words as histories
    fail_word = np.log10(priors[0] / (seen + priors[0]))
    first, last = np.zeros(len(tokens.pairs), np.int32), np.zeros(len(tokens.pairs), np.int32)
    first[tokens.pair], last[tokens.pair] = tokens.before, tokens.words
    from_word = (n[PAIRS] + priors[0] * root[last]) / (seen[first] + priors[0])
    fail_pair = np.log10(priors[1] / (n[PAIRS] + priors[1]))
    before, after = np.zeros(len(tokens.triples), np.int32), np.zeros(len(tokens.triples), np.int32)
    at = tokens.triple[tokens.inner]
    before[at], after[at] = tokens.pair[tokens.inner - 1], tokens.pair[tokens.inner]
    from_pair = np.log10((n[TRIPLES] + priors[1] * from_word[after]) / (n[PAIRS][before] + priors[1]))
    from_word, root = np.log10(from_word), np.log10(root)
    # the state behind each token: the longest history that training knows
    behind = np.where(n[WORDS][tokens.words] > 0, 1 + tokens.words, 0)
    if order > 2:
        behind = np.where(n[PAIRS][tokens.pair] > 0, 1 + words + 1 + tokens.pair, behind)
    begin = np.concatenate([np.arange(b, b + size, STRETCH) for b, size in zip(tokens.begins, tokens.sizes)])
    length = np.minimum(np.diff(np.append(begin, len(tokens.words))), STRETCH)
    longest = np.argsort(-length, kind="stable")
    begin, length = begin[longest], length[longest]
    fresh = np.isin(begin, tokens.begins)
    state = np.where(fresh, (1 + words) if starts else 0, behind[begin - 1])
    out = np.zeros(len(tokens.words))
    for step in range(int(length[0]) if len(length) else 0):
        live = int(np.searchsorted(-length, -step, side="left"))  # those longer than this step
        position, now = begin[:live] + step, state[:live]
        pair, triple, score = tokens.pair[position], tokens.triple[position], np.zeros(live)
        deep = now > 1 + words
        taken = deep & (n[TRIPLES][triple] > 0) if len(tokens.triples) else np.zeros(live, bool)
        score[taken] = from_pair[triple[taken]]
        failed = deep & ~taken
        score[failed] += fail_pair[now[failed] - words - 2]
        now = np.where(failed, 1 + last[np.maximum(now - words - 2, 0)], now)  # without its first word
        shallow = ~taken & (now > 0)
        arc = shallow & (n[PAIRS][pair] > 0)
        score[arc] += from_word[pair[arc]]
        lost = shallow & ~arc
        score[lost] += fail_word[now[lost] - 1]
        at_root = ~taken & ~arc
        score[at_root] += root[tokens.words[position[at_root]]]
        out[position], state[:live] = score, behind[position]
    return out


def scores(docs: DataFrame, modulus: int = 7, remainder: int = 2, order: int = 3, priors: tuple[float, float] = (30.0, 10.0), chunk_bytes: int = 8_000_000, span_keys: int = 1_000_000) -> DataFrame:
    """One row a row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from texts whose crc32(doc_id as text) modulo `modulus` is not `remainder` (a null doc_id as empty text);
    scores all. base_score is the add-one unigram score; score is the automaton's log10 probability of the text with
    its end; `order` is 3, or 2 for histories of one word alone; `priors` are those of histories of one and of two words. Null texts count as empty: one token, the end.
    Repeated rows count as often as they occur; further columns are ignored. An empty table gives an empty result; without
    training texts every token has probability one. `span_keys` keys of all chunks lie in a range on average; the number
    of ranges grows with the corpus."""
    spark = docs.sparkSession
    chunked = saved(chunks(docs, modulus, remainder, chunk_bytes), "lm-chunks")
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "learnt")]
    sizes = chunked.agg(*sums).first()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    most = {kind: max(tasks, n // span_keys) for kind, n in zip(KINDS, (sizes.n_words, sizes.n_tokens, sizes.n_tokens))}
    counted = saved(grams(chunked, most, order).groupBy("kind", "span").applyInPandas(added_up, COUNTED), "lm-counts")
    total = counted.where(F.col("kind") == WORDS).agg(F.coalesce(F.sum("total"), F.lit(0)).alias("n"), F.coalesce(F.sum("known"), F.lit(0)).alias("v")).first()
    n, v, texts = int(total.n), int(total.v), int(sizes.learnt)

    def traverse(key: tuple, chunk: pd.DataFrame, counts: pd.DataFrame) -> pd.DataFrame:
        out, counts = [], counts.sort_values("span")
        of = {kind: np.concatenate([np.zeros(0, np.int64), *(unpacked(c) for c in counts["c"][counts["kind"] == kind])]) for kind in KINDS}
        for row in chunk.to_dict("records"):
            tokens = Tokens(row, order)
            root = (of[WORDS] + 1) / (n + v + 1)
            score = walked(tokens, of, root, texts, priors, order)
            known, base, score = (np.add.reduceat(x, tokens.begins) for x in ((of[WORDS] > 0)[tokens.words].astype(np.int64), np.log10(root)[tokens.words], score))
            ids = pd.array(np.frombuffer(row["doc_ids"], "<i8"), "Int64")
            ids[~np.frombuffer(row["named"], bool)] = pd.NA
            out.append(pd.DataFrame({"doc_id": ids, "held_out": np.frombuffer(row["held"], bool), "n_tokens": tokens.sizes, "n_known": known, "train_tokens": n, "base_score": base, "score": score}))
        return pd.concat(out)

    own = chunked.drop("n_words", "n_tokens", "learnt").groupBy("chunk")
    return own.cogroup(counted.select("chunk", "kind", "span", "c").groupBy("chunk")).applyInPandas(traverse, SCORED)
