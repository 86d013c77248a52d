"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD_CACHE = 300_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can never clash with ours."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def id_bucket(doc_id, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see: spark.checkpoint.dir, else (local tests) a temporary one."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = spark.sparkContext.getCheckpointDir()
        if not current:
            current = tempfile.mkdtemp(prefix="tallyloom-")
            spark.sparkContext.setCheckpointDir(current)
        path = current
    return f"{path.rstrip('/')}/tallyloom/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back, so that lost executors recompute nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows (with key, the group) and idx, the place in the group in ascending order, from 0, and size, that of the group."""
    keys = ["key", *order]
    ranged = rows.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys)
    placed = materialise(ranged.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), name)
    # a row for each group in each range
    runs = placed.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    group = Window.partitionBy("key")
    starts = runs.select("key", "part", F.sum("n").over(group).alias("size"), (F.sum("n").over(group.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"))
    return placed.join(starts, ["key", "part"]).withColumn("idx", F.col("at") + F.col("shift")).drop("part", "at", "shift")


class WordHash(dict):
    """64-bit hashes of words (bytes), kept for the words seen lately."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


BYTE_SEED = 0x9E3779B97F4A7C15
LONG = 256  # bytes of the longest word that is hashed by eight bytes at a time


class ByteWords:
    """Hashes of the words of UTF-8 bytes without a Python object for each word.

    A word is taken eight bytes at a time; each step mixes them into the hash so far, which starts from the seed and the
    word's length, so no pattern of bytes makes different words of one length meet.  Words over LONG bytes go to xxh3.
    """

    def __init__(self, seed: int = BYTE_SEED):
        self.seed = seed
        self.blank = np.zeros(256, bool)
        self.blank[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

    def places(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words start and end."""
        full = np.zeros(len(data) + 2, np.int8)
        full[1:-1] = ~self.blank[data]
        change = np.diff(full)
        return np.flatnonzero(change == 1), np.flatnonzero(change == -1)

    def of(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The hash of each data[start:end], of one byte or more."""
        size = end - start
        out = mix64(size.astype(np.uint64) * np.uint64(BYTE_SEED) + np.uint64(self.seed))
        eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
        at, place, left, own = np.arange(len(start)), start, size, out
        if (size > LONG).any():
            for k in np.flatnonzero(size > LONG).tolist():
                out[k] = xxhash.xxh3_64_intdigest(data[start[k] : end[k]].tobytes(), self.seed)
            at = np.flatnonzero(size <= LONG)
            place, left, own = start[at], size[at], out[at]
        while len(at):
            own = mix64(own ^ (eights[place] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - np.minimum(left, 8)) * 8).astype(np.uint64))))
            done = left <= 8
            out[at[done]] = own[done]
            more = ~done
            at, place, left, own = at[more], place[more] + 8, left[more] - 8, own[more]
        return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalizer of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """One 64-bit hash for each run of n consecutive words; empty if there are fewer words."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]
    return mix64(out)


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def cut_rows(batch: pa.RecordBatch, text: str | pa.Array, limit: int = 8_000_000):
    """Split a batch into runs of rows with at most limit bytes of text (a column) each or one row, so that long texts don't pile up."""
    column = batch.column(text) if isinstance(text, str) else text
    if column.nbytes <= limit or not batch.num_rows:
        yield batch
        return
    _, offsets, _ = column.buffers()
    at = np.frombuffer(offsets, np.int64 if column.type == pa.large_string() else np.int32)[column.offset : column.offset + len(column) + 1]
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(at, int(at[low]) + limit, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high
