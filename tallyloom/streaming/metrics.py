"""Counters and histograms of a running stream, gathered by observed metrics, and their exposition as text."""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

NAME = "stream_metrics"
BOUNDS = (10.0, 50.0, 100.0, 250.0, 500.0)


def observed(events: DataFrame, kinds: list[str], bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """events, counted on their way: rows by kind (of the named ones and others), and how values spread over bounds."""
    kind, value = F.col("event_type"), F.col("value")
    each = [F.count_if(kind == k).alias(f"kind_{i}") for i, k in enumerate(kinds)]
    other = F.count_if(kind.isNull() | ~kind.isin(*kinds)) if kinds else F.count(F.lit(1))
    under = [F.count_if(value <= b).alias(f"under_{i}") for i, b in enumerate(bounds)]
    return events.observe(NAME, *each, other.alias("other"), *under, F.count(value).alias("values"), F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.max(F.unix_micros("ts")).alias("newest"))


class Metrics(StreamingQueryListener):
    """Sums what micro-batches have observed.  A batch that Spark runs again after a failure reports once, when it is done."""

    def __init__(self, query_name: str):
        self.query_name, self.run = query_name, None
        self.sums: dict[str, float] = {}
        self.newest, self.batches, self.late = None, set(), 0
        self.over = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.query_name:
            self.run = str(event.runId)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.query_name or p.batchId in self.batches:
            return
        self.late += sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        row = p.observedMetrics.get(NAME)
        if row is None or not p.numInputRows:
            return
        self.batches.add(p.batchId)
        for k, v in row.asDict().items():
            if k == "newest":
                self.newest = max(x for x in (self.newest, v) if x is not None) if v is not None else self.newest
            else:
                self.sums[k] = self.sums.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.runId) == self.run:
            self.over.set()

    def samples(self, kinds: list[str], bounds: tuple[float, ...] = BOUNDS) -> list[tuple[str, str, float]]:
        """(metric, label, value) in order of exposition."""
        get = lambda k: float(self.sums.get(k, 0))
        out = [("events_total", k, get(f"kind_{i}")) for i, k in enumerate(kinds)] + [("events_total", "other", get("other"))]
        out += [("event_value_bucket", f"{b:g}", get(f"under_{i}")) for i, b in enumerate(bounds)] + [("event_value_bucket", "+Inf", get("values"))]
        out += [("event_value_sum", "", get("total")), ("event_value_count", "", get("values")), ("event_batches_total", "", float(len(self.batches)))]
        return out + ([("event_newest_timestamp_seconds", "", self.newest / 1e6)] if self.newest is not None else [])


#: What each metric is: kind, label and help.
META = {
    "events_total": ("counter", "kind", "Events by kind."),
    "event_value": ("histogram", "le", "Values of events."),
    "event_batches_total": ("counter", "", "Micro-batches with events."),
    "event_newest_timestamp_seconds": ("gauge", "", "Time of the newest event."),
}


def escaped(label: str) -> str:
    return label.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


def exposition(samples: list[tuple[str, str, float]]) -> str:
    """The samples as text: a HELP and a TYPE line before each metric's first sample."""
    lines, seen = [], set()
    for metric, label, value in samples:
        family = metric.removesuffix("_bucket").removesuffix("_sum").removesuffix("_count") if metric.startswith("event_value") else metric
        kind, name, help_text = META[family]
        if family not in seen:
            seen.add(family)
            lines += [f"# HELP {family} {help_text}", f"# TYPE {family} {kind}"]
        labelled = name and not metric.endswith(("_sum", "_count"))
        lines.append(f"{metric}{f'{{{name}="{escaped(label)}"}}' if labelled else ''} {value:.17g}")
    return "\n".join([*lines, ""])


def run(spark: SparkSession, events: DataFrame, kinds: list[str], name: str, path: str, bounds: tuple[float, ...] = BOUNDS) -> Metrics:
    """Run a stream over all that is there, its rows to Parquet under path, and return what was observed."""
    listener = Metrics(name)
    spark.streams.addListener(listener)
    try:
        writer = observed(events, kinds, bounds).writeStream.queryName(name).trigger(availableNow=True).option("checkpointLocation", f"{path}-state")
        writer.format("parquet").option("path", f"{path}-rows").start().awaitTermination()
        listener.over.wait(60)
    finally:
        spark.streams.removeListener(listener)
    return listener
