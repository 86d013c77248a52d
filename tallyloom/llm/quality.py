"""Quality rules: base counts, then a log-likelihood ratio of hashed n-grams.

Base: n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each whole
text; base_failed if there are under MIN_WORDS words or over 30 % stand in
repeated runs of RUN words.

Verdict: tokens (runs of letters and digits, runs of other marks) give unigrams
and bigrams hashed into BUCKETS.  Two multinomials are counted: the raw corpus
(all rows) and the trusted target (documents labelled good, at most MAX_TRUSTED of
them, those of smallest id hash: the documented bound of the labelled sample).
A text's score is the mean over its n-grams of log p(target) - log p(raw), so its
length doesn't matter; it is kept if the score is at least THRESHOLD.

Each task sums its counts into BUCKETS cells before anything is shuffled; the
driver gets BUCKETS numbers.  Null texts have no words.  A text without tokens
scores 0 (and fails the base).  Without trusted documents all scores are 0.
Repeated rows count and are judged each, those of null doc_id too (they are never
trusted).  Texts of any length are judged whole.  Empty table: no rows.  Other columns
are carried along as they are, also those named like ours.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import WordHash, batch_of, cut_rows, mix64, ngram_hashes, pick

BITS = 16
BUCKETS = 1 << BITS
SMOOTH = 0.5
MAX_TRUSTED = 20_000
THRESHOLD = -0.4
MIN_WORDS, RUN = 20, 8
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
TOKEN = re.compile(r"\w+|[^\w\s]+")


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def buckets_of(text: str, hashes: WordHash) -> np.ndarray:
    tokens = TOKEN.findall(text)
    h = hashes.of([t.encode("utf-8", "surrogatepass") for t in tokens])
    return (mix64(np.concatenate([h, h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]])) >> np.uint64(64 - BITS)).astype(np.int64)


def base_counts(text: str, hashes: WordHash) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = words_of(text)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeated = 0
    if len(words) > RUN:
        windows = ngram_hashes(hashes.of(words), RUN)
        ordered = np.sort(windows)
        if (twice := ordered[1:][ordered[1:] == ordered[:-1]]).size:
            change = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(np.isin(windows, twice))
            np.add.at(change, at, 1)
            np.add.at(change, at + RUN, -1)
            repeated = int((np.cumsum(change) > 0).sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def trusted_ids(labels: DataFrame) -> np.ndarray:
    good = pick(labels, "doc_id", "quality").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1")
    rows = good.select("doc_id", F.xxhash64("doc_id").alias("order")).orderBy("order", "doc_id").limit(MAX_TRUSTED).collect()
    return np.array(sorted(r["doc_id"] for r in rows), np.int64)


def multinomials(docs: DataFrame, trusted: np.ndarray) -> DataFrame:
    """bucket, target, raw: n-gram counts of the trusted documents and of all."""
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(trusted.tolist()))
    schema = pa.schema([("bucket", pa.int64()), ("target", pa.int64()), ("raw", pa.int64())])

    def run(batches):
        ids, hashes = shared.value, WordHash()
        target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for doc_id, text in (x for batch in batches for part in cut_rows(batch, "text") for x in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True)):
            if text:
                at = buckets_of(text, hashes)
                if len(at) > 4096:
                    counts = np.bincount(at, minlength=BUCKETS)
                    raw += counts
                    if doc_id in ids:
                        target += counts
                else:
                    np.add.at(raw, at, 1)
                    if doc_id in ids:
                        np.add.at(target, at, 1)
        at = np.flatnonzero(raw)
        yield batch_of(schema, [at, target[at], raw[at]])

    return pick(docs, "doc_id", "text").mapInArrow(run, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))


def log_ratios(counts: DataFrame) -> np.ndarray:
    local = counts.toPandas()
    t, r = np.zeros(BUCKETS), np.zeros(BUCKETS)
    t[local["bucket"].to_numpy(np.int64)] = local["target"]
    r[local["bucket"].to_numpy(np.int64)] = local["raw"]
    if not t.sum():
        return np.zeros(BUCKETS)
    p = lambda c: np.log((c + SMOOTH) / (c.sum() + SMOOTH * BUCKETS))
    return p(t) - p(r)


FRESH = ["n_words long", "word_chars long", "n_symbols long", "n_dup_lines long", "n_repeat_words long", "score double", "base_failed boolean", "kept boolean"]
NAMES = [f.split()[0] for f in FRESH]


def judge(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """its_row (a struct of the columns of docs), the counts, the score and the verdicts of every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("its_row"))

    def run(batches):
        weights, hashes = shared.value, WordHash()
        kinds = [pa.int64()] * 5 + [pa.float64(), pa.bool_(), pa.bool_()]
        for part in (p for batch in batches for p in cut_rows(batch, pc.struct_field(batch.column(0), "text"))):
            rows = []
            for text in pc.struct_field(part.column(0), "text").to_pylist():
                text = text or ""
                base = base_counts(text, hashes)
                at = buckets_of(text, hashes)
                score = float(weights[at].mean()) if len(at) else 0.0
                failed = base[0] < MIN_WORDS or 100 * base[4] > 30 * base[0]
                rows.append((*base, score, failed, not failed and score >= threshold))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in NAMES]
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)]], names=["its_row", *NAMES])

    return packed.mapInArrow(run, f"its_row {packed.schema['its_row'].dataType.simpleString()}, {', '.join(FRESH)}")


def good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with the columns of docs alone."""
    judged = judge(docs, log_ratios(multinomials(docs, trusted_ids(labels))))
    return judged.where("kept").select(*[F.col(f"its_row.`{c}`").alias(c) for c in docs.columns])


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of docs plus the counts, the score and the verdicts, which replace columns of their names."""
    judged = judge(docs, log_ratios(multinomials(docs, trusted_ids(labels))))
    return judged.select(*[F.col(f"its_row.`{c}`").alias(c) for c in docs.columns if c not in NAMES], *NAMES)
