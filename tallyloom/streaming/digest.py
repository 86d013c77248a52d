"""Daily digests of alerts as a stream: counts by recipient, day and kind, sent when event time says that the day is over."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def daily_digests(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """user_id, day, n, total, highest, message: one row for each recipient and day with alerts, once the day is over.

    A day is over when the newest event of earlier micro-batches is lateness beyond its end; nothing is sent before.  Rows
    that come once its message is sent are late: they are dropped and counted (numRowsDroppedByWatermark of the query's
    progress), and no message is sent twice.
    Order and cut of the files make no difference to the others.  Null users are a recipient; null kinds count as "other",
    null values as 0; events without a time are left out.  A recipient's state is a few numbers a kind and open day: rows
    are summed before they meet it, and a day's state goes when its message is sent.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = events.where("ts is not null").withWatermark("ts", lateness)
    slim = rows.select("user_id", "ts", F.coalesce("event_type", F.lit("other")).alias("kind"), F.coalesce("value", F.lit(0.0)).alias("value"))
    kinds = slim.groupBy(F.window("ts", "1 day").alias("its_day"), "user_id", "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max("value").alias("highest"))
    cells = F.sort_array(F.collect_list(F.struct("kind", "n"))).alias("cells")
    found = kinds.groupBy(F.window(F.window_time("its_day"), "1 day").alias("its_day"), "user_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("highest").alias("highest"), cells)
    day = F.date_from_unix_date(F.floor(F.unix_millis("its_day.start") / DAY_MS).cast("int"))
    parts = F.array_join(F.transform("cells", lambda x: F.concat(x["kind"], F.lit(" "), x["n"].cast("string"))), ", ")
    return found.select("user_id", day.alias("day"), "n", "total", "highest", F.concat(day.cast("string"), F.lit(": "), F.col("n").cast("string"), F.lit(" alerts ("), parts, F.lit(")")).alias("message"))
