"""SentencePiece BPE encoding by vectorised merge rounds over flat numpy symbol arrays, and decoding.

All new words of a slice are merged together. A round looks up the rank of every adjacent pair, takes each word's
least rank by a segmented minimum, merges its leftmost non-overlapping occurrences at once, and drops the words that
have no pair left. Merging at once equals merging one by one unless a merge makes a pair that ranks before its own;
words where that happens merge their leftmost occurrence alone in that round.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices
from .tokens import Known

SPACE, NONE = "▁", np.int64(1 << 40)


class SentencePieces:
    def __init__(self, file: str, most: int = 600_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=file)
        size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
        self.known = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.unknown, self.end = model.unk_id(), model.eos_id()
        self.byte_ids = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if model.is_byte(i)}
        if any(SPACE in p.lstrip(SPACE) for p in self.known):
            raise ValueError("a piece runs over a word's end")
        if model.normalize("ﬁ  x") != f"{SPACE}ﬁ{SPACE}{SPACE}x":
            raise ValueError("the model changes texts before encoding")
        order = sorted((i for p, i in self.known.items() if len(p) > 1), key=lambda i: -model.get_score(i))
        self.size, self.extra = size, {}
        pairs = {}
        for rank, i in enumerate(order):
            p = self.pieces[i]
            for k in range(1, len(p)):
                left, right = self.symbol(p[:k]), self.symbol(p[k:])
                if left is not None and right is not None:
                    pairs[(left << 32) | right] = (rank, i)
        keys = np.array(sorted(pairs), np.int64)
        self.keys = np.append(keys, np.int64(2**62))
        self.ranks = np.array([*(pairs[k][0] for k in keys.tolist()), 0], np.int64)
        self.piece_of_rank = np.array(order, np.int64)
        # a character that no longer piece holds is a word of its own
        inside = set("".join(p for p in self.known if len(p) > 1))
        lone = "".join(re.escape(c) for c in map(chr, range(128)) if c not in inside)
        self.units = re.compile(f"[{lone}]|{SPACE}*[^{SPACE}{lone}]+|{SPACE}+")
        surface = [b"" if special[i] else p.replace(SPACE, " ").encode() for i, p in enumerate(self.pieces)]
        for b, i in self.byte_ids.items():
            surface[i] = bytes([b])
        surface[self.unknown] = " ⁇ ".encode()
        lengths = np.array([len(s) for s in surface], np.int64)
        self.surface, self.ends = np.frombuffer(b"".join(surface), np.uint8), np.concatenate([[0], np.cumsum(lengths)])
        self.is_byte = np.array([model.is_byte(i) for i in range(size)])
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.words, self.word_ids, self.word_ends, self.extra = Known(), np.zeros(0, np.int64), np.zeros(1, np.int64), {}

    def symbol(self, text: str) -> int | None:
        """A piece's id; a single character that is no piece gets a number beyond them."""
        at = self.known.get(text)
        return at if at is not None or len(text) > 1 else self.size + ord(text)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left << 32) | right
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """The symbols that each word ends in."""
        number = {c: self.symbol(c) for c in set(chain.from_iterable(words))}
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.int64, lengths.sum())
        word, out = np.repeat(np.arange(len(words)), lengths), [None] * len(words)
        while len(sym):
            inner = np.append(word[1:] == word[:-1], False)
            rank = np.full(len(sym), NONE)
            at = np.flatnonzero(inner)
            rank[at] = self.rank(sym[at], sym[at + 1])
            begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, begin)
            own = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(sym))))
            if (least == NONE).any():
                ends = np.append(begin[1:], len(sym))
                for b, e in zip(begin[least == NONE].tolist(), ends[least == NONE].tolist()):
                    out[word[b]] = sym[b:e]
                stay = least[own] != NONE
                sym, word, rank, own = sym[stay], word[stay], rank[stay], own[stay]
                if not len(sym):
                    break
            best = least[own]
            hit = rank == best
            place = np.arange(len(sym))
            run = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), place, 0))
            hit &= (place - run) % 2 == 0  # of overlapping occurrences every other one, from the left
            i = np.flatnonzero(hit)
            new, r, w = self.piece_of_rank[best[i]], best[i], word[i]
            before = np.maximum(i - 1, 0)
            after_merge = np.append(False, (i[1:] - i[:-1] == 2)) & np.append(False, w[1:] == w[:-1])
            left = np.where(after_merge, np.append(0, new[:-1]), sym[before])
            sooner = (i > 0) & (word[before] == w) & (self.rank(left, new) < r)
            after = np.minimum(i + 2, len(sym) - 1)
            sooner |= (i + 2 < len(sym)) & (word[after] == w) & (self.rank(new, sym[after]) < r)
            if sooner.any():
                first = np.append(True, w[1:] != w[:-1])
                keep = first | ~np.isin(w, w[sooner])
                i, new = i[keep], new[keep]
            sym[i] = new
            stay = np.ones(len(sym), bool)
            stay[i + 1] = False
            sym, word = sym[stay], word[stay]
        return out

    def ids_of(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols that are no piece fall back to the ids of their UTF-8 bytes."""
        if (symbols < self.size).all():
            return symbols
        out: list[int] = []
        for s in symbols.tolist():
            out += [s] if s < self.size else [self.byte_ids.get(b, self.unknown) for b in chr(s - self.size).encode()] if self.byte_ids else [self.unknown]
        return np.array(out, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts): the ids of all texts end to end without end ids, and how many each has."""
        if self.words.full(self.most):
            self.forget()
        units = [self.units.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        n = np.fromiter(map(len, units), np.int64, len(units))
        at = np.fromiter(map(self.words.__getitem__, chain.from_iterable(units)), np.int64, n.sum())
        if self.words.new:
            found = [self.ids_of(s) for s in self.merge(self.words.new)]
            self.words.new.clear()
            self.word_ends = np.concatenate([self.word_ends, self.word_ends[-1] + np.cumsum([len(f) for f in found])])
            self.word_ids = np.concatenate([self.word_ids, *found])
        begin, lengths = self.word_ends[at], self.word_ends[at + 1] - self.word_ends[at]
        ends = np.cumsum(lengths)
        ids = self.word_ids[np.repeat(begin - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return ids, np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])])

    def decode(self, ids: np.ndarray) -> str:
        """Pieces end to end; bytes that are no UTF-8 become U+FFFD; the space before the first word goes."""
        begin, lengths = self.ends[ids], self.ends[ids + 1] - self.ends[ids]
        ends = np.cumsum(lengths)
        raw = self.surface[np.repeat(begin - ends + lengths, lengths) + np.arange(int(ends[-1]) if len(ends) else 0)].tobytes()
        text = raw.decode(errors="replace")
        return text[1:] if len(ids) and self.pieces[int(ids[0])].startswith(SPACE) else text


def pieces_of(model: str) -> SentencePieces:
    """The model of a Python worker: a task finds the words that earlier tasks have merged."""
    return kept(model, lambda: SentencePieces(model))


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (with the end id), decoded text of every row; null texts count as empty and have the end id alone.

    Rows are independent: repeated rows repeat their result, a null doc_id stays null, an empty table gives an empty
    result, further columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model)
        for rows in slices(batches, "text", 2_000_000):
            ids, counts = pieces.encode([t or "" for t in rows.column(1).to_pylist()])
            ends = np.cumsum(counts)
            texts = [pieces.decode(ids[e - c : e]) for e, c in zip(ends.tolist(), counts.tolist())]
            ids = np.insert(ids, ends, pieces.end).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(counts + 1)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.array(texts, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest(rows: DataFrame) -> DataFrame:
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
