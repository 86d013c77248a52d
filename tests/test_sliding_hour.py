"""Events of a type in the hour before, against a loop."""

import datetime

from tallyloom.plans.registry import QUERIES

START = datetime.datetime(2024, 1, 1)
KINDS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def at(i, user=7, kind="a", value=2.0, **after):
    return (i, START + datetime.timedelta(**after), user, kind, value)


def test_counts_of_the_hour_before_are_those_of_a_loop(spark, tmp_path):
    rows = [at(i, kind="ab"[i % 2], seconds=600 * (i // 3)) for i in range(90)]  # ties, and times an hour apart to the second
    rows += [at(100, kind=None), at(101, kind="a"), at(102, kind="a", days=-20_000, seconds=1, microseconds=1), at(103, kind="a", days=-20_000, hours=1, seconds=1, microseconds=1), (104, None, 1, "a", 1.0)]
    spark.createDataFrame(rows, KINDS).write.parquet(f"{tmp_path}/events.parquet")
    got = {r["event_id"]: (r["in_hour"], r["within"]) for r in QUERIES["stm_02_sliding_hour"](spark, str(tmp_path)).collect()}
    known = [r for r in rows if r[1] is not None and r[3] is not None]
    hour = datetime.timedelta(hours=1)
    want = {a[0]: sum(b[3] == a[3] and a[1] - hour <= b[1] <= a[1] for b in known) for a in known}
    assert got == {k: (n, n <= 5) for k, n in want.items()}
