"""Structured Streaming forms of alerts: windows, deduplication, rate limits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.sources.shared import shared_dir

HOUR = 3_600_000_000  # in microseconds
CHUNK = 10_000  # rows given back at a time


def event_stream(spark: SparkSession, path: str, batch_files: int | None = None) -> DataFrame:
    """A folder of event files as a stream, so many files in a micro-batch (all, if not said); watermarks need zoned timestamps."""
    schema = spark.read.parquet(path).schema
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    reader = spark.readStream.schema(schema)
    if not files.getFileStatus(place).isDirectory():  # a stream reads folders
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    if batch_files:
        reader = reader.option("maxFilesPerTrigger", batch_files)
    return reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(events: DataFrame) -> DataFrame:
    """Tumbling windows of an hour by type; a day late at most."""
    return events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def deduplicated(events: DataFrame) -> DataFrame:
    """One alert for each type, user and day."""
    return events.withColumn("day", F.to_date("ts")).withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["event_type", "user_id", "day"])


def rate_limited(events: DataFrame, per_hour: int) -> DataFrame:
    """Events with accepted: at most per_hour accepted events of a type in the hour before; rejected ones don't count.

    The state of a type holds the times of its accepted events of the last hour: at most per_hour numbers.  Events of a
    micro-batch are judged in order of time, then id, however Spark cuts them into chunks: a type's ids and times (16 bytes
    an event) are held by its task.  Events that come in a later micro-batch than younger ones are judged when they come.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent = list(state.get[0]) if state.exists else []
        chunks = [(pdf["event_id"].to_numpy(), pdf["at"].to_numpy()) for pdf in batches]
        ids, times = (np.concatenate(x) for x in zip(*chunks, strict=True))
        order = np.lexsort((ids, times))
        for start in range(0, len(order), CHUNK):
            part = order[start : start + CHUNK]
            accepted = []
            for at in times[part].tolist():
                recent = [x for x in recent if x > at - HOUR]
                accepted.append(len(recent) < per_hour)
                if accepted[-1]:
                    recent.append(at)
            yield pd.DataFrame({"event_id": ids[part], "event_type": key[0], "accepted": accepted})
        state.update((recent,))

    out, kept = "event_id long, event_type string, accepted boolean", "recent array<long>"
    timed = events.select("event_id", "event_type", F.unix_micros("ts").alias("at"))
    return timed.groupBy("event_type").applyInPandasWithState(step, out, kept, "append", GroupStateTimeout.NoTimeout)


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and return what it has written as Parquet: its rows, or in complete mode those of the last batch."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/tallyloom/{spark.sparkContext.applicationId}/{name}"
    writer = stream.writeStream.queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}-state")
    if mode == "complete":
        writer = writer.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{path}-rows"))
    else:
        writer = writer.format("parquet").option("path", f"{path}-rows")
    writer.start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}-rows")
