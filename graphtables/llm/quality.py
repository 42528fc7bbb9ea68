"""Quality classifier with hierarchical empirical Bayes.

A logistic model over surface features of the whole text gives each document evidence. The expected share of good
documents of a site, and of a path within it, is a beta posterior: sparse sites shrink toward the global prior and
sparse paths toward their site, with prior strengths estimated from the spread between groups. Evidence and path
posterior add up in log odds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import binary, saved, slices

FEATURES = 20
RESULTS = ("evidence", "site_prior", "path_prior", "posterior", "kept")
LINE, RUN = re.compile(rb"\n+"), re.compile(rb"(.)\1{3,}", re.S)


def features(texts: list[bytes]) -> np.ndarray:
    """Shares and ratios of characters, words and lines, all of the whole text."""
    out = np.zeros((len(texts), FEATURES))
    for k, text in enumerate(texts):
        count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        words, lines = text.split(), [x for x in LINE.split(text) if x]
        n, w = max(1, len(text)), max(1, len(words))
        letters = count[65:91].sum() + count[97:123].sum()
        symbols = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
        wide = count[128:].sum()
        distinct = len(set(words))
        out[k] = (
            count[65:91].sum() / max(1, letters),
            symbols / n,
            count[48:58].sum() / n,
            wide / n,
            letters / n,
            (count[9:14].sum() + count[32]) / n,
            count[ord("|")] / w,
            count[ord("!")] / w,
            (count[ord("#")] + count[ord("$")] + count[ord("%")] + count[ord("&")] + count[ord("*")]) / w,
            (count[ord(".")] + count[ord(",")]) / w,
            (count[ord("<")] + count[ord(">")] + count[ord("{")] + count[ord("}")] + count[ord("=")] + count[ord(";")]) / w,
            distinct / w,
            np.log1p(len(words)) / 10,
            len(text) / w / 10,
            np.log1p(distinct) / 10,
            len(set(lines)) / max(1, len(lines)),
            np.log1p(n / max(1, len(lines))) / 10,
            sum(len(x) for x in RUN.findall(text)) / n,
            sum(1 for x in words if len(x) == 1) / w,
            sum(1 for x in words if len(x) > 20) / w,
        )
    return out


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights) of a ridge logistic regression on standardised features and their squares."""
    x = np.hstack([x, x * x])
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    weights, penalty = np.zeros(z.shape[1]), ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
        weights -= np.linalg.solve(z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + penalty, z.T @ (p - y) + penalty @ weights)
    return mean, scale, weights


def log_odds(x: np.ndarray, model: tuple) -> np.ndarray:
    mean, scale, weights = model
    return np.clip((np.hstack([x, x * x]) - mean) / scale @ weights[:-1] + weights[-1], -12, 12)


def trained(docs: DataFrame, labels: DataFrame, most: int = 20_000) -> tuple[tuple, float]:
    """The model and the share of good rows, from at most `most` labelled documents, the first in hash order; of several
    texts of one doc_id the least counts, so that the bound holds whatever repeats."""
    chosen = labels.where("quality IS NOT NULL").groupBy(F.col("doc_id").cast("long")).agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    known = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # `most` rows of two numbers
    sample = known.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 8_000_000):
            x = features(binary(part, "text"))
            yield pa.RecordBatch.from_arrays([part.column(2).cast(pa.int32()), pa.array([v.tobytes() for v in x], pa.binary())], names=["quality", "x"])

    table = sample.select("doc_id", "text", "quality").mapInArrow(rows, "quality int, x binary").toPandas()
    y = table["quality"].to_numpy(np.float64)
    if len(np.unique(y)) < 2:  # nothing to tell apart
        return (np.zeros(2 * FEATURES), np.ones(2 * FEATURES), np.append(np.zeros(2 * FEATURES), 2.0)), 0.88
    x = np.frombuffer(b"".join(map(bytes, table["x"])), np.float64).reshape(len(y), FEATURES)
    return fitted(x, y), float(y.mean())


def evidenced(docs: DataFrame, model: tuple, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs and `evidence`, the classifier's log odds that the whole text is good."""
    rest = [c for c in keep if c != "text"]
    wanted = docs.select(*rest, "text")
    names = keep if "text" in keep else rest

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", 8_000_000):
            evidence = np.round(log_odds(features(binary(part, "text")), model), 6)
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(evidence)], names=[*names, "evidence"])

    schema = T.StructType([*(wanted.schema[c] for c in names), T.StructField("evidence", T.DoubleType())])
    return wanted.mapInArrow(rows, schema)


def strength(mean: float, groups: DataFrame, n: str, s: str, toward: Column) -> float:
    """Prior strength by moments: how far group shares spread around what they shrink toward, beyond chance."""
    spread = groups.agg(F.sum(F.col(n) * F.pow(F.col(s) / F.col(n) - toward, 2)).alias("v"), F.sum(n).alias("n"), F.count("*").alias("k")).first()
    if not spread.n:
        return 1.0
    between = spread.v / spread.n - mean * (1 - mean) * spread.k / spread.n
    return float(np.clip(mean * (1 - mean) / max(between, 1e-9) - 1, 1.0, 1e4))


def scored(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, most_labels: int = 20_000, most_groups: int = 200_000, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, host, path and the columns `keep`, with evidence, site_prior, path_prior, posterior and kept.

    Evidence is the log odds of the text alone; the priors leave a document's own vote out; kept is posterior >=
    threshold. Null hosts and paths form groups of their own; null and empty texts are scored as any text is. Rows
    are judged one by one, so repeated rows get equal marks, and an empty table gives an empty result. Without labels of
    both kinds there is nothing to tell apart: every text has evidence 2 and is kept. The fit uses at most `most_labels`
    labelled documents; group statistics cover all rows. A table of up to `most_groups` groups is
    broadcast, a larger one is joined. A column of docs that has a result's name stays out."""
    columns = [c for c in dict.fromkeys(["doc_id", host, path, *keep]) if c not in RESULTS]
    model, share = trained(docs, labels, most_labels)
    keys = {"_host": F.coalesce(F.col(host).cast("string"), F.lit("\0")), "_path": F.coalesce(F.col(path).cast("string"), F.lit("\0"))}
    vote = 1 / (1 + F.exp(-F.col("evidence")))
    votes = evidenced(docs, model, [host, path]).select(*(c.alias(k) for k, c in keys.items()), vote.alias("vote"))
    paths = saved(votes.groupBy("_host", "_path").agg(F.count("*").alias("_n"), F.sum("vote").alias("_s")), "quality-paths")
    sites = paths.groupBy("_host").agg(F.sum("_n").alias("_site_n"), F.sum("_s").alias("_site_s"))
    total = paths.agg(F.count("*").alias("k"), F.sum("_n").alias("n"), F.sum("_s").alias("s")).first()
    mean = float(np.clip(total.s / total.n, 1e-3, 1 - 1e-3)) if total.n else share
    k_site = strength(mean, sites, "_site_n", "_site_s", F.lit(mean))
    groups = paths.join(sites, "_host")
    k_path = strength(mean, groups, "_n", "_s", (F.col("_site_s") + k_site * mean) / (F.col("_site_n") + k_site))
    groups = F.broadcast(groups) if total.k <= most_groups else groups
    marked = evidenced(docs, model, columns).withColumns(keys).withColumn("_vote", vote)
    odds = lambda p: F.log(p / (1 - p))
    bound = lambda p: F.least(F.greatest(p, F.lit(1e-3)), F.lit(1 - 1e-3))
    return (
        marked.join(groups, ["_host", "_path"])
        .withColumn("site_prior", (F.col("_site_s") - F.col("_vote") + k_site * mean) / (F.col("_site_n") - 1 + k_site))
        .withColumn("path_prior", (F.col("_s") - F.col("_vote") + k_path * F.col("site_prior")) / (F.col("_n") - 1 + k_path))
        .withColumn("posterior", F.round(1 / (1 + F.exp(-(F.col("evidence") - float(np.log(share / (1 - share))) + odds(bound(F.col("path_prior")))))), 6))
        .withColumn("kept", F.col("posterior") >= threshold)
        .withColumns({c: F.round(c, 6) for c in ("site_prior", "path_prior")})
        .select(*columns, *RESULTS)
    )
