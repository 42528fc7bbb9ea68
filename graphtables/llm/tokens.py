"""Ids of whole texts from a tokenizers file; each different piece between cuts is merged once and remembered."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from itertools import chain
from pathlib import Path

import numpy as np

from .common import kept

#: Characters whose class and case no Unicode version moves: up to U+024F and plain punctuation. A text with any
#: other, or with a control that Python's re alone takes for white space, is encoded whole by the library, and so is
#: one that holds the string of an added token, which the library gives a single id. ODD_ASCII: those in plain ASCII.
OTHER = re.compile("[^\x00-\x1b\x20-\x84\x86-ɏ‐-‧‰-⁞€]")
ODD_ASCII = "\x1c\x1d\x1e\x1f"
LETTERS = "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "L")
NUMBERS = "".join(re.escape(c) for c in map(chr, range(0x250)) if unicodedata.category(c)[0] == "N")
# The pre-tokenizing patterns of the two public vocabularies.
BYTE_LEVEL = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\s{LETTERS}{NUMBERS}]+|\s+(?!\S)|\s+"
WORD_ENDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\s{LETTERS}{NUMBERS}]+"


def byte_letters() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shown = {b: chr(b) for b in plain}
    for b in range(256):
        shown.setdefault(b, chr(0x100 + len(shown) - len(plain)))
    return [shown[b] for b in range(256)]


#: Characters a piece that caches allow for on average.
LONG = 32


class Known(dict):
    """Piece to index; a new piece gets the next one and is noted. A piece may be as long as a text."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []
        self.characters = 0

    def __missing__(self, piece: str) -> int:
        at = self[piece] = len(self)
        self.new.append(piece)
        self.characters += len(piece)
        return at

    def full(self, most: int) -> bool:
        """Whether it holds more than `most` pieces, or what that many of LONG characters would."""
        return len(self) > most or self.characters > most * LONG


class PieceEncoder:
    """Calls give (ids, counts): the ids of all texts end to end, and how many each text has."""

    def __init__(self, file: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = json.loads(Path(file).read_text(encoding="utf-8"))["pre_tokenizer"]["type"] == "Sequence"
        self.pattern = re.compile(WORD_ENDS if self.words else BYTE_LEVEL)
        self.shown, self.most = dict(enumerate(byte_letters())), most
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.known, self.ids, self.ends = Known(), np.zeros(0, np.int32), np.zeros(1, np.int64)

    def pieces(self, text: str) -> list[str]:
        """A text that needs the library is one piece, marked by a leading NUL and line end that no piece begins with."""
        odd = any(c in text for c in ODD_ASCII) if text.isascii() else OTHER.search(text)
        if odd or any(t in text for t in self.added):
            return ["\x00\n" + text]
        return self.pattern.findall(text.lower() if self.words else text)

    def merged(self, piece: str) -> list[int]:
        if piece.startswith("\x00\n"):
            return self.tokenizer.encode(piece[2:], add_special_tokens=False).ids
        return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))]

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.known.full(self.most):
            self.forget()
        pieces = [self.pieces(t) for t in texts]
        n = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(pieces)), np.int64, n.sum())
        if self.known.new:
            found = [self.merged(p) for p in self.known.new]
            self.known.new.clear()
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
            self.ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(found), np.int32, lengths.sum())])
        begin, lengths = self.ends[at], self.ends[at + 1] - self.ends[at]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(begin - ends + lengths, lengths) + np.arange(total)]
        edges = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(n)])]
        return ids, np.diff(edges)


def encoder(file: str) -> PieceEncoder:
    """The encoder of a Python worker: a task finds the pieces that earlier tasks have merged."""
    return kept(file, lambda: PieceEncoder(file))
