"""Digests by recipient and day on odd rows."""

import datetime
import os
import time

from tallyloom.streaming import alerts as A
from tallyloom.streaming import digest as D

START = datetime.datetime(2024, 1, 1)
KINDS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def at(i, user=7, kind="a", value=2.0, **after):
    return (i, START + datetime.timedelta(**after), user, kind, value)


def test_digests_keep_open_days_and_all_recipients(spark, tmp_path):
    path = f"{tmp_path}/events"
    # the third file is older than the watermark (day 1, 12:00), but its day isn't over
    for rows in ([at(1, days=1, hours=1), at(2, -1, days=1), at(3, None, days=1)], [at(4, days=3, hours=12)], [at(5, days=1, hours=2)], [at(6, days=9)]):
        spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(path)
    names = sorted((f for f in os.scandir(path) if f.name.endswith(".parquet")), key=lambda f: f.stat().st_mtime_ns)
    for k, f in enumerate(names):
        os.utime(f, (time.time() - 100 + k, time.time() - 100 + k))
    got = A.finished(D.daily_digests(A.event_stream(spark, path, 1), "2 days"), "digest_open_days").collect()
    assert sorted((str(r["user_id"]), r["day"].day, r["message"]) for r in got) == [
        ("-1", 2, "2024-01-02: 1 alerts (a 1)"),
        ("7", 2, "2024-01-02: 2 alerts (a 2)"),
        ("7", 4, "2024-01-04: 1 alerts (a 1)"),
        ("None", 2, "2024-01-02: 1 alerts (a 1)"),
    ]
