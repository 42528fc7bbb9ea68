"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insults, verbs of violence, targets, negations, verbs of reported speech and modals. The insults
are a letter transducer: stems and words with weights, learnt from labels, next to a short list. A cascade of symbol
transducers rewrites what stands near: speech that is reported, what is negated, and a modal before violence, which
makes a threat; the last one reads a clause and says at its end what it held, with or without a target. The cascade is
composed into one machine over the reachable states. A document is scored by its matched clauses, each with the weight
of its strongest insult, never by words alone: a logistic regression that starts from prior weights of the patterns.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, saved, slices

#: The words of each symbol in four languages.
WORDS = {
    "insult": "idiot idiots moron morons loser losers stupid pathetic worthless scum trash clown disgusting imbecile bastard dumb fool idiotin trottel dummkopf abschaum imbécile crétin connard ordure idiota estúpido imbécil basura",
    "violent": "kill hurt beat shoot stab destroy murder strangle burn töten schlagen erschießen tuer frapper détruire matar golpear destruir",
    "target": "you your you're yourself he she they them him her his their these those people everyone du dich dein ihr euch sie tu toi vous ton votre ils elles ellos ellas usted ustedes",
    "negation": "not no never nobody isn't aren't wasn't don't nicht kein keine nie ne pas jamais aucun nunca ningún",
    "report": "said says wrote writes quoted reported called claims sagte schrieb dit écrit dijo escribió",
    "modal": "will gonna shall going must should i'll we'll werde werden wird vais va voy vamos",
}
SYMBOLS = ("other", *WORDS, "end")
KINDS = ("insult", "denied", "reported", "threat")
#: What a clause says: a kind, and whether it names a target; and the weight of each pattern before any label is seen.
PATTERNS = tuple((kind, aimed) for kind in KINDS for aimed in (False, True))
PRIOR = np.array([1.0, 1.5, 0.1, 0.2, 0.2, 0.3, 1.5, 2.0])
BIAS = -3.0
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;\n]")
ENDS = frozenset(".!?;\n")
SHORTEST, LONGEST = 4, 9


@dataclass
class Transducer:
    """States are numbers, 0 is the start; an arc without an entry leads where `rest` says and hands its symbol on."""

    arcs: dict[tuple[int, str], tuple[int, str]] = field(default_factory=dict)
    rest: dict[int, int] = field(default_factory=dict)

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol)


def near(trigger: str, reach: int, swaps: dict[str, str], otherwise: dict[str, str] | None = None) -> Transducer:
    """Rewrites by `swaps` what follows the trigger within `reach` symbols of a clause, and by `otherwise` elsewhere."""
    arcs: dict[tuple[int, str], tuple[int, str]] = {(0, a): (0, b) for a, b in (otherwise or {}).items()}
    for left in range(reach + 1):
        arcs |= {(left, trigger): (reach, trigger), (left, "end"): (0, "end")}
        if left:
            arcs |= {(left, a): (left - 1, b) for a, b in swaps.items()}
    return Transducer(arcs, {left: left - 1 for left in range(1, reach + 1)})


def clause() -> Transducer:
    """Remembers the strongest kind of a clause and whether it names a target; says so at the end of the clause."""
    rank = ("", "reported", "denied", "insult", "threat")
    arcs = {}
    for k, kind in enumerate(rank):
        for aimed in (0, 1):
            arcs[(2 * k + aimed, "target")] = (2 * k + 1, "")
            arcs[(2 * k + aimed, "end")] = (0, f"{kind} {aimed}" if kind else "")
            for j, other in enumerate(rank[1:], 1):
                arcs[(2 * k + aimed, other)] = (2 * max(j, k) + aimed, "")
    return Transducer(arcs)


CASCADE = (
    near("report", 12, {"insult": "reported", "violent": "reported"}),
    near("negation", 3, {"insult": "denied", "violent": "other", "reported": "denied"}),
    near("modal", 3, {"violent": "threat"}, {"violent": "other"}),
    clause(),
)


def composed(machines: tuple[Transducer, ...]) -> tuple[list[list[int]], list[list[int]]]:
    """One machine of the cascade's reachable states: for each state and symbol the next state and the pattern said, or -1."""
    numbers, todo, following, said = {(0,) * len(machines): 0}, [(0,) * len(machines)], [], []
    names = {f"{kind} {int(aimed)}": k for k, (kind, aimed) in enumerate(PATTERNS)}
    for states in todo:  # grows while it is read
        following.append([])
        said.append([])
        for symbol in SYMBOLS:
            new = []
            for machine, state in zip(machines, states):
                to, symbol = machine.step(state, symbol)
                new.append(to)
            if tuple(new) not in numbers:
                numbers[tuple(new)] = len(todo)
                todo.append(tuple(new))
            following[-1].append(numbers[tuple(new)])
            said[-1].append(names.get(symbol, -1))
    return following, said


class Grammar:
    """Words to symbols and weights, and clauses to patterns."""

    def __init__(self, stems: dict[str, float], most: int = 300_000):
        self.stems, self.most, self.known, self.size = stems, most, {}, 0
        self.listed = {w: SYMBOLS.index(s) for s, words in WORDS.items() for w in words.split()}
        self.following, self.said = composed(CASCADE)
        self.end, self.insult, self.violent = (SYMBOLS.index(s) for s in ("end", "insult", "violent"))

    def symbol(self, word: str) -> tuple[int, float]:
        """The symbol of a word, and its weight if it is an insult: that of the heaviest of its stems."""
        weight = max((self.stems.get(word[:k], 0.0) for k in range(SHORTEST, min(LONGEST, len(word)) + 1)), default=0.0)
        weight = max(weight, self.stems.get(word + "$", 0.0))
        listed = self.listed.get(word, self.end if word in ENDS else 0)
        if listed == self.insult:
            return listed, max(weight, 1.0)
        return (self.insult, weight) if weight and not listed else (listed, 0.0)

    def patterns(self, text: str) -> np.ndarray:
        """The summed weights of the clauses of each pattern."""
        tokens, out, known = TOKEN.findall(text.lower()), np.zeros(len(PATTERNS)), self.known
        if len(known) > self.most or self.size > 32 * self.most:
            known.clear()
            self.size = 0
        for w in set(tokens).difference(known):
            known[w] = self.symbol(w)
            self.size += len(w)
        begin = 0
        symbols = [known[t] for t in tokens]
        live = [k for k, s in enumerate(symbols) if s[0] == self.insult or s[0] == self.violent]
        for at in live:
            if at < begin:
                continue  # in a clause that has been read
            while at > begin and symbols[at - 1][0] != self.end:
                at -= 1
            state, weight = 0, 1.0
            for begin in range(at, len(symbols) + 1):
                s, w = symbols[begin] if begin < len(symbols) else (self.end, 0.0)
                weight, pattern = max(weight, w), self.said[state][s]
                state = self.following[state][s]
                if pattern >= 0:
                    out[pattern] += weight
                if s == self.end:
                    begin += 1
                    break
        return np.log1p(out)


def prefixes(word: str) -> list[str]:
    return [*(word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)), word + "$"]


def held_out(modulus: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus == 0


def sample(docs: DataFrame, labels: DataFrame, modulus: int, most_toxic: int, most_clean: int) -> DataFrame:
    """Labelled texts to learn from: toxic, text. At most so many ids of each label, by a hash; of texts that are near
    copies of each other (they share the least hash of three words) one of each label."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(modulus)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    some = lambda label, most: known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    ids = saved(some(1, most_toxic).union(some(0, most_clean)), "toxicity-ids")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")  # most_toxic + most_clean rows
    texts = texts.groupBy("doc_id").agg(F.min(F.struct("toxic", "text")).alias("x")).select("x.toxic", "x.text")

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text", 4_000_000):
            found = []
            for text in rows.column(1).to_pylist():
                words = text.lower().split()
                found.append(min((xxhash.xxh3_64_intdigest(" ".join(words[k : k + 3])) for k in range(max(1, len(words) - 2))), default=0) >> 1)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(found, pa.int64())], names=["toxic", "text", "least"])

    return texts.mapInArrow(least, "toxic int, text string, least long").groupBy("toxic", "least").agg(F.min("text").alias("text")).select("toxic", "text")


def learnt_stems(texts: DataFrame, most_stems: int) -> dict[str, float]:
    """Beginnings of words, and whole words, that toxic texts hold and clean ones don't: their log odds.

    A stem counts if its likelihood ratio exceeds what the best of all stems would reach by chance, 2 ln(stems)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for label, counter in enumerate(sums):
                yield pa.RecordBatch.from_arrays([pa.array(counter.keys(), pa.string()), pa.array([label] * len(counter), pa.int32()), pa.array(counter.values(), pa.int64())], names=["stem", "toxic", "n"])
                counter.clear()

        for rows in slices(batches, "text", 1_000_000):
            for label, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
                words = {w for w in TOKEN.findall(text.lower()) if w not in ENDS}
                sums[label].update({p for w in words for p in prefixes(w)})
            if len(sums[0]) + len(sums[1]) > 500_000:
                yield from out()
        yield from out()

    of = {r.toxic: r.n for r in texts.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    t, c = of.get(1, 0), of.get(0, 0)
    if not t or not c:
        return {}
    n = lambda label: F.coalesce(F.sum(F.when(F.col("toxic") == label, F.col("n"))), F.lit(0))
    counts = saved(texts.select("toxic", "text").mapInArrow(count, "stem string, toxic int, n long").groupBy("stem").agg(n(1).alias("t"), n(0).alias("c")), "toxicity-stems")
    both = F.col("t") + F.col("c")
    part = lambda seen, share: F.when(F.col(seen) > 0, F.col(seen) * F.log(F.col(seen) / (both * share))).otherwise(0.0)
    ratio = 2 * (part("t", t / (t + c)) + part("c", c / (t + c)))
    odds = F.log((F.col("t") + 0.5) / (t + 1)) - F.log((F.col("c") + 0.5) / (c + 1))
    chosen = counts.select("stem", ratio.alias("ratio"), odds.alias("odds")).where((F.col("ratio") > 2 * math.log(max(2, counts.count()))) & (F.col("odds") > 2))
    return {r.stem: r.odds for r in chosen.orderBy(F.desc("ratio"), "stem").limit(most_stems).collect()}


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic weights, the bias last; the ridge pulls toward the prior weights, and no weight is below zero."""
    prior = np.append(PRIOR, BIAS)
    x, w = np.hstack([x, np.ones((len(x), 1))]), prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * (w - prior))
        w = w + step
        w[:-1] = np.maximum(w[:-1], 0.0)
        if np.abs(step).max() < 1e-8:
            break
    return w


def scored(docs: DataFrame, labels: DataFrame, modulus: int = 5, most_toxic: int = 4000, most_clean: int = 12000, most_stems: int = 20000) -> DataFrame:
    """One row a row of docs: doc_id, held_out, score from 0 to 1, predicted (1 if score >= 0.5).

    Learns from at most `most_toxic` and `most_clean` labelled ids whose crc32(doc_id as text) modulo `modulus` is not
    0 (a null doc_id as empty text); an id with both labels counts as toxic, and of several texts of an id the least
    counts. Without labels of both kinds, the listed words and prior weights score alone. A null text is empty; texts
    without a matched clause all get the least score. Nothing but the text enters a score; further columns are ignored.
    An empty table gives an empty result."""
    texts = saved(sample(docs, labels, modulus, most_toxic, most_clean), "toxicity-sample")
    stems = learnt_stems(texts, most_stems)
    name = f"grammar {xxhash.xxh3_64_hexdigest(repr(sorted(stems.items())))}"
    grammar = lambda: kept(name, lambda: Grammar(stems))  # noqa: E731  one a Python worker

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text", 4_000_000):
            x = [grammar().patterns(t).tolist() for t in rows.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    seen = texts.select("toxic", "text").mapInArrow(features, "toxic int, x array<double>").collect()  # most_toxic + most_clean rows of 8 numbers
    weights = np.append(PRIOR, BIAS)
    if len({r.toxic for r in seen}) == 2:
        weights = fitted(np.array([r.x for r in seen]), np.array([r.toxic for r in seen], float))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text", 4_000_000):
            x = np.array([grammar().patterns(t) for t in rows.column(2).to_pylist()])
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    every = docs.select(F.col("doc_id").cast("long"), held_out(modulus).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return every.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
