"""Document fingerprints: a digest of bucket quartiles over hashed byte triplets.

Every three consecutive bytes of a text are hashed to one of 128 buckets.  The
digest has a length code, the ratios of the bucket quartiles, and two bits for
each bucket: which quarter of the buckets its count falls in.  Two digests are
compared by a difference that can't exceed MOST, so likeness lies in 0 to 1.

Nulls count as empty texts.  Texts of under three bytes have no triplets: their
counts are all zero and only the length code (and a hash of the text itself)
tells them apart.  Repeated rows get one row each.  Texts of any length are taken
whole.  Empty table: no rows.  Only doc_id and text are read: other columns, also of clashing names, change nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import batch_of, cut_rows, pick

BUCKETS = 128
LENGTH_WEIGHT, LENGTH_MOST, RATIO_WEIGHT, RATIO_MOST = 3, 30, 2, 16
STEP = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]], np.int64)  # cost of two quarters
MOST = LENGTH_MOST + 2 * RATIO_MOST + 6 * BUCKETS
#: Above this share of the largest difference, texts have nothing in common; random texts come near it.
SCALE = 0.3


def triplet_counts(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(BUCKETS, np.int64)
    h = (b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(2654435761)
    return np.bincount(h >> np.uint32(25), minlength=BUCKETS)


def digest(data: bytes) -> str:
    """Hexadecimal: length code, two quartile ratios, then two bits for each bucket."""
    counts = triplet_counts(data)
    ordered = np.sort(counts)
    q1, q2, q3 = (int(ordered[BUCKETS * k // 4 - 1]) for k in (1, 2, 3))
    length = min(255, round(8 * math.log2(len(data) + 1)))
    ratios = (min(15, q1 * 15 // q3), min(15, q2 * 15 // q3)) if q3 else (0, 0)
    if len(data) < 3:
        body = np.frombuffer(data.ljust(32, b"\0"), np.uint8)
    else:
        quarter = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
        body = (quarter.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1).astype(np.uint8)
    return bytes([length, ratios[0] << 4 | ratios[1], *body]).hex()


def difference(a: str, b: str) -> int:
    """0 for equal digests, at most MOST."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    total = min(LENGTH_MOST, LENGTH_WEIGHT * abs(int(x[0]) - int(y[0])) // 8)
    for shift in (4, 0):
        total += min(RATIO_MOST, RATIO_WEIGHT * abs((int(x[1]) >> shift & 15) - (int(y[1]) >> shift & 15)))
    for shift in (0, 2, 4, 6):
        total += int(STEP[x[2:] >> shift & 3, y[2:] >> shift & 3].sum())
    return total


def likeness(a: str, b: str) -> float:
    return max(0.0, 1.0 - difference(a, b) / (SCALE * MOST))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars and fingerprint of every row of docs: no shuffle."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("fingerprint", pa.string())])

    def run(batches):
        for batch in (part for whole in batches for part in cut_rows(whole, "text")):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch_of(schema, [batch.column("doc_id").to_pylist(), [len(t) for t in texts], [digest(t.encode("utf-8", "surrogatepass")) for t in texts]])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def with_next(docs: DataFrame, runs_per_partition: int = 4) -> DataFrame:
    """Rows dealt into runs of neighbours; each run ends with a copy of the first row of the run after it (extra).

    Order: descending doc_id (null last), then the hash of the text; after the last row comes the first.  Cuts are
    quantiles of doc_id; an id that takes several of them, and null, are cut by the hash as well.  What reaches the
    driver is a few numbers for each run, and the number of runs is set by the shuffle partitions.
    """
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("mark", F.xxhash64("text"))
    runs = runs_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = docs.agg(F.count("*").alias("all"), F.count("doc_id").alias("named")).first()
    quantiles = [k / runs for k in range(1, runs)]
    found = docs.select("doc_id").approxQuantile("doc_id", quantiles, 1 / (20 * runs)) if n["named"] else []
    times = Counter(int(c) for c in found or [])
    cuts = sorted(times, reverse=True)
    bases = np.cumsum([0, 1, *(times[c] for c in cuts)]).tolist()  # the first run of each stretch between cuts
    for_null = max(1, round(runs * (n["all"] - n["named"]) / max(1, n["all"])))
    numbers = lambda values, kind: F.array(*[F.lit(v).cast(kind) for v in values]) if values else F.array().cast(f"array<{kind}>")
    # ids above the first cut are in stretch 0, and stretch k starts with the rows of cut k
    stretch = F.size(F.filter(numbers(cuts, "long"), lambda c: F.col("doc_id") <= c))
    share = lambda parts: F.floor((F.shiftright("mark", 32) + F.lit(1 << 31)) * parts / F.lit(1 << 32)).cast("int")
    parts = F.element_at(numbers([1, *(times[c] for c in cuts)], "int"), F.col("stretch") + 1)
    at_cut = F.col("doc_id") == F.get(numbers(cuts, "long"), F.col("stretch") - 1)
    named_run = F.element_at(numbers(bases[:-1], "int"), F.col("stretch") + 1) + F.when(at_cut, share(parts)).otherwise(parts - 1)
    run = F.when(F.col("doc_id").isNull(), F.lit(bases[-1]) + share(F.lit(for_null))).otherwise(named_run)
    placed = docs.withColumn("stretch", stretch).withColumn("run", run.cast("int")).drop("stretch")
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("down"), F.col("mark").alias("mark"), F.col("doc_id").alias("doc_id"))).alias("lead")
    firsts = sorted((r["run"], r["lead"]["doc_id"], r["lead"]["mark"]) for r in placed.groupBy("run").agg(lead).collect()) if n["all"] else []
    # a run's first row (all rows equal to it) goes to the run before it as well
    before = [(i, m, firsts[k - 1][0]) for k, (_, i, m) in enumerate(firsts)]
    extras = F.broadcast(spark.createDataFrame(before, "first_id long, first_mark long, before int"))
    both = placed.join(extras, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark")), "left")
    copies = F.array(F.struct(F.col("run").alias("run"), F.lit(False).alias("extra")), F.struct(F.col("before").alias("run"), F.lit(True).alias("extra")))
    return both.select("doc_id", "text", "mark", F.explode(F.filter(copies, lambda c: c["run"].isNotNull())).alias("c")).select("doc_id", "text", "mark", "c.run", "c.extra")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited form, whose last half is the start of the next document.

    Contract columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Documents of equal id, and those without one, follow each other by the hash of their texts.
    Empty table: no rows.  One document alone is its own next one.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def edited(batches):
        out: list[tuple] = []
        held = None  # the row that waits for its next one: run, id, text, fingerprint, whether it is an extra copy
        for batch in batches:
            for run, doc_id, text, extra in zip(*(batch.column(c).to_pylist() for c in ("run", "doc_id", "text", "extra")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                mark = digest(data)
                if held is not None and held[0] == run and not held[4]:
                    _, i, t, f, _ = held
                    half = len(t) // 2
                    new = (t[: len(t) - half] + text[:half]).encode("utf-8", "surrogatepass")
                    g = digest(new)
                    out.append((i, len(t), hashlib.sha256(new).hexdigest(), f, g, likeness(f, g), likeness(f, mark)))
                held = (run, doc_id, text, mark, extra)
            if len(out) >= 2000:
                yield batch_of(schema, list(zip(*out, strict=True)))
                out = []
        if out:
            yield batch_of(schema, list(zip(*out, strict=True)))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_next(docs).repartition(parts, "run").sortWithinPartitions("run", "extra", F.col("doc_id").desc_nulls_last(), "mark", "text")
    return dealt.mapInArrow(edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
