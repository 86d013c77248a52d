"""Token ids in binary files: ORC stripes, in ascending order of document ids.

Texts are dealt into ranges of doc_id, sorted, encoded, and written by Spark's
ORC writer: integer run-length encoding for the ids, stripes of STRIPE bytes that
separate tasks can read, a row index every STRIDE rows, and a Bloom filter on
doc_id in each stripe, so a lookup of ids skips stripes and row groups by their
metadata.  Each row holds a document's ids, their number, its range (part) and its
place in it (row), so a reader needs no other file to know the order.

Encoding agrees with the tokenizers library, which encodes each distinct piece of
text once (pieces.py says where texts are cut); texts with a special token's text
go to it whole.

Null texts count as empty: just the end id.  Null doc_ids come first.  Repeated
rows are written each; rows of equal ids stand in the order of their texts' first
HEAD characters, then of a hash.  The ranges tell such rows apart, so neither null
nor repeated ids meet in one task.  Empty table: no rows.  Only doc_id and text are read: other columns, also of clashing names, change nothing.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import batch_of, cut_rows, pick, shared_dir
from tallyloom.llm.pieces import PieceTable, cuts, load, special_texts, table_for, text_bytes

END = 2
STRIPE, STRIDE = 16 << 20, 1000
HEAD = 64
#: One pre-token: at most a blank, then letters that every version of Unicode in use knows.
PLAIN = r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+"


def encode(table: PieceTable, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a column of texts, one after the other, and where each text's end (and the first one's start) is."""
    table.room()
    data, offsets = text_bytes(texts)
    start, end = cuts(data, offsets[:-1], keep_blanks=True)
    owner = np.searchsorted(offsets, start, "right") - 1
    special = special_texts(data, offsets)
    if len(special):
        free = ~np.isin(owner, special)
        start, end, owner = start[free], end[free], owner[free]
    entries = table.entries(data, start, end)
    if len(special):
        owner = np.concatenate([owner, special])
        entries = np.concatenate([entries, table.whole([data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "surrogatepass") for k in special])])
        order = np.argsort(owner, kind="stable")
        owner, entries = owner[order], entries[order]
    flat, ends = table.gather(entries)
    return flat, ends[np.searchsorted(owner, np.arange(len(offsets)))]


def write(docs: DataFrame, path: str, tokenizer_path: str, end: int = END) -> None:
    """Encode every text and write its ids as ORC files under path."""
    shared = docs.sparkSession.sparkContext.broadcast(load(tokenizer_path))
    kind = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), ("ids", kind), ("n_tokens", pa.int64())])

    def run(batches):
        table = table_for(shared.value, PLAIN)
        for batch in batches:
            for part in cut_rows(batch, "text", 2_000_000):
                flat, ends = encode(table, part.column("text"))
                flat = np.insert(flat, ends[1:], end)
                ends = ends + np.arange(len(ends))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat)), pa.array(np.diff(ends))], schema=schema)

    # slim keys: whole texts aren't sampled for the ranges, and equal ids or equal rows spread over several of them
    keys = [F.col("doc_id").asc_nulls_first(), F.col("head").asc(), F.col("mark").asc()]
    keyed = pick(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.left(F.coalesce("text", F.lit("")), F.lit(HEAD)).alias("head"), F.xxhash64("text").alias("mark"))
    ordered = keyed.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys).select("doc_id", "text")
    coded = ordered.mapInArrow(run, "doc_id long, ids array<int>, n_tokens long")
    placed = coded.select("doc_id", "ids", "n_tokens", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.row.index.stride": str(STRIDE), "orc.create.index": "true", "orc.stripe.size": str(STRIPE), "compression": "zstd"}
    placed.write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, ids array<int>, n_tokens long, part int, row long").orc(path)


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of a few documents; Spark pushes the filter down, so ORC skips stripes and row groups."""
    return read(spark, path).where(F.col("doc_id").isin(doc_ids))


def index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, all from the files."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("row", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            flat, at = ids.values.to_numpy(zero_copy_only=False).astype("<u4"), ids.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at, at[1:], strict=False)]
            yield batch_of(schema, [batch.column("doc_id"), batch.column("part"), batch.column("row"), np.diff(at).astype(np.int64), crc])

    rows = read(spark, path).select("doc_id", "ids", "part", "row").mapInArrow(run, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    # one row for each range of ids: the starts of ranges are a sum over those before
    parts = read(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("total"))  # reads no ids
    starts = parts.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    inner = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("row")) - F.col("n_tokens")
    return rows.withColumn("inner", inner).join(starts, "part").select("doc_id", (F.col("before") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def store_and_index(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write(docs, path, tokenizer_path)
    return index(spark, path)
