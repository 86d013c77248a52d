"""Streams against brute force, with several Arrow chunks a type."""

import datetime
import random
from collections import defaultdict

from tallyloom.streaming import alerts as A


def brute_accepted(rows, per_hour):
    recent, out = defaultdict(list), {}
    for at, i, kind in sorted((at, i, kind) for i, kind, at in rows):
        recent[kind] = [x for x in recent[kind] if x > at - datetime.timedelta(hours=1)]
        out[i] = len(recent[kind]) < per_hour
        if out[i]:
            recent[kind].append(at)
    return out


def test_rate_limit_does_not_depend_on_chunks(spark, tmp_path):
    rng = random.Random(1)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, rng.choice("aab"), start + datetime.timedelta(minutes=rng.randrange(6000))) for i in range(6000)]
    spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz").write.parquet(f"{tmp_path}/events")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, 500)
    try:
        out = A.finished(A.rate_limited(A.event_stream(spark, f"{tmp_path}/events"), 2), "limited").collect()
    finally:
        spark.conf.set(key, before)
    assert len(out) == len(rows) and {r["event_id"]: r["accepted"] for r in out} == brute_accepted(rows, 2)


def test_rows_of_streams_do_not_pass_through_the_driver(spark, tmp_path):
    spark.sql("SELECT 1L AS event_id, 'a' AS event_type, 2L AS user_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS ts").write.parquet(f"{tmp_path}/events")
    out = A.finished(A.deduplicated(A.event_stream(spark, f"{tmp_path}/events")), "once")
    assert out.count() == 1 and all(f.endswith(".parquet") for f in out.inputFiles())


def test_complete_results_are_written_too(spark, tmp_path):
    for k in (1, 2):
        spark.sql(f"SELECT {k}L AS event_id, 'a' AS event_type, {k}L AS user_id, {k}.5D AS value, TIMESTAMP_NTZ '2024-01-01 00:0{k}:00' AS ts").write.mode("append").parquet(f"{tmp_path}/events")
    out = A.finished(A.hourly_counts(A.event_stream(spark, f"{tmp_path}/events")), "hours", "complete")
    assert [(r["n"], r["total"]) for r in out.collect()] == [(2, 4.0)] and all(f.endswith(".parquet") for f in out.inputFiles())
