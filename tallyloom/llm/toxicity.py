"""Toxicity: FTRL-proximal logistic regression over hashed word features.

Features of a text (each counted once): its words, pairs of neighbouring words,
pairs of words with one word between them (skip-grams), and the beginnings of
its words, which carry a word's stem where endings vary.  All are hashed into
DIMENSIONS coordinates.

Training: at most MAX_TRAIN labelled documents, those of smallest id hash (the
documented bound of the sample), dealt to SHARDS groups.  Each group runs FTRL
(a learning rate per coordinate, L1 for sparse weights) over its documents; the
groups' weights are averaged by their rows (a group with labels of one kind alone
trains nothing and doesn't count).  The weights are sparse and at most DIMENSIONS, so
they are broadcast.  Scoring reads every whole text once, without a shuffle.

Null texts are empty texts; an empty text scores by the bias alone.  Without any
labelled document of both kinds the bias is 0 and all scores are 0.5.  Repeated
rows are scored each; of repeated labels for an id the largest counts.  Texts of any length are
read whole.  Empty table: no rows.
Only doc_id and text are read: other columns, also of clashing names, change nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WordHash, batch_of, cut_rows, id_bucket, mix64, pick

BITS = 20
DIMENSIONS = 1 << BITS
MAX_TRAIN, SHARDS, EPOCHS = 20_000, 2, 5
ALPHA, BETA, L1, L2 = 0.5, 1.0, 3.0, 1.0
THRESHOLD = 0.3
STEMS = (4, 5, 6)
ROWS = -1  # stands for the number of rows among the sums of weights
WORD = re.compile(r"\w+")


class Features:
    """Coordinates of a text's features; words are hashed once while they stay in the cache."""

    def __init__(self):
        self.hashes = WordHash()
        self.stems: dict[str, np.ndarray] = {}

    def stem(self, word: str) -> tuple[int, ...]:
        if len(self.stems) >= 300_000:
            self.stems.clear()
        self.stems[word] = out = tuple(WordHash.__missing__(self.hashes, b"\0" + word[:k].encode()) for k in STEMS if len(word) >= k)
        return out

    def of(self, text: str) -> np.ndarray:
        words = WORD.findall(text.lower())
        if not words:
            return np.empty(0, np.int64)
        h = self.hashes.of([w.encode("utf-8", "surrogatepass") for w in words])
        stems, stem = self.stems, self.stem
        s = np.array([x for w in set(words) for x in (stems[w] if w in stems else stem(w))], np.uint64)
        parts = [h, h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:], h[:-2] * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:] + np.uint64(1), s]
        return np.unique(mix64(np.concatenate(parts)) >> np.uint64(64 - BITS)).astype(np.int64)


def sigmoid(x: float) -> float:
    return float(1.0 / (1.0 + np.exp(-min(max(x, -35.0), 35.0))))


def ftrl(texts: list[str], truth: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights that aren't zero after EPOCHS passes; coordinate DIMENSIONS is the bias, free of L1."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)
    l1 = np.full(DIMENSIONS + 1, L1)
    l1[DIMENSIONS] = 0.0
    features = Features()
    rows = [np.append(features.of(t), DIMENSIONS).astype(np.int32) for t in texts]
    for _ in range(EPOCHS):
        for at, y in zip(rows, truth, strict=True):
            zi, ni, li = z[at], n[at], l1[at]
            w = np.where(np.abs(zi) > li, -(zi - np.sign(zi) * li) / ((BETA + np.sqrt(ni)) / ALPHA + L2), 0.0)
            g = sigmoid(w.sum()) - y
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[at] = ni + g * g
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    at = np.flatnonzero(w)
    return at, w[at]


def train(docs: DataFrame, labels: DataFrame) -> pd.DataFrame:
    """Averaged weights (coordinate, weight) from the labelled rows outside the held-out quarter."""
    marked = pick(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = marked.where(id_bucket(F.col("doc_id"), 4) != 2).withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(MAX_TRAIN).withColumn("shard", F.pmod("order", F.lit(SHARDS)).cast("int"))
    # at most MAX_TRAIN slim rows: a proven bound, so the texts need no shuffle to meet their labels
    texts = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    # an id may stand on any number of rows: equal ones count once, and the bound is one of rows again
    pairs = texts.select("doc_id", "mark").join(F.broadcast(sample), "doc_id").distinct().orderBy("order", "doc_id", "mark").limit(MAX_TRAIN)
    rows = texts.join(F.broadcast(pairs), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("doc_id", "toxic", "shard", "text")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "text"])
        pdf = pdf.iloc[np.random.default_rng(0).permutation(len(pdf))]
        if pdf.toxic.nunique() < 2:
            return pd.DataFrame({"at": np.empty(0, np.int64), "weight": np.empty(0)})
        at, w = ftrl(pdf.text.tolist(), pdf.toxic.tolist())
        return pd.DataFrame({"at": [*at, ROWS], "weight": [*(w * len(pdf)), float(len(pdf))]})

    sums = rows.groupBy("shard").applyInPandas(fit, "at long, weight double").groupBy("at").agg(F.sum("weight").alias("weight")).toPandas()
    of_rows = sums["at"] == ROWS
    return sums[~of_rows].assign(weight=lambda d: d["weight"] / sums.loc[of_rows, "weight"].sum())


def score(docs: DataFrame, weights: pd.DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs; weights has at most DIMENSIONS + 1 rows."""
    spark = docs.sparkSession
    dense = np.zeros(DIMENSIONS + 1, np.float32)
    dense[weights["at"].to_numpy(np.int64)] = weights["weight"].to_numpy(np.float32)
    at = np.flatnonzero(dense)
    shared = spark.sparkContext.broadcast((at.astype(np.int32), dense[at]))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        where, what = shared.value
        w = np.zeros(DIMENSIONS + 1, np.float32)
        w[where] = what
        bias, features = float(w[DIMENSIONS]), Features()
        for batch in (part for whole in batches for part in cut_rows(whole, "text")):
            ids, held, texts = (batch.column(c).to_pylist() for c in ("doc_id", "held_out", "text"))
            scores = [sigmoid(bias + float(w[features.of(t or "")].sum(dtype=np.float64))) for t in texts]
            yield batch_of(schema, [ids, held, scores, [int(s >= THRESHOLD) for s in scores]])

    ready = pick(docs, "doc_id", "text").select("doc_id", (id_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "text")
    return ready.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
