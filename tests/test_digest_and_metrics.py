"""Digests and metrics of streams against batch results, over shuffled files in several micro-batches."""

import datetime
import random
from collections import defaultdict
from types import SimpleNamespace

import pytest

from tallyloom.sources.shared import shared_dir
from tallyloom.streaming import alerts as A
from tallyloom.streaming import digest as D
from tallyloom.streaming import metrics as M

START = datetime.datetime(2024, 1, 1)
KINDS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def made(n, days=6, seed=1):
    rng = random.Random(seed)
    return [(i, START + datetime.timedelta(seconds=rng.randrange(days * 86_400)), rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(1000))])) for i in range(n)]


def files(spark, path, groups):
    for rows in groups:
        spark.createDataFrame(rows, KINDS).coalesce(1).write.mode("append").parquet(path)


def batch(rows, closed):
    out = defaultdict(lambda: defaultdict(list))
    for _, ts, user, kind, value in rows:
        if ts.date() < closed:
            out[user, ts.date()][kind or "other"].append(value or 0.0)
    return {k: (sum(map(len, v.values())), sum(sum(x) for x in v.values()), max(max(x) for x in v.values()), f"{k[1]}: {sum(map(len, v.values()))} alerts ({', '.join(f'{n} {len(v[n])}' for n in sorted(v))})") for k, v in out.items()}


def test_digests_of_shuffled_files_are_those_of_a_batch(spark, tmp_path):
    rows = made(600)
    last = (9000, START + datetime.timedelta(days=40), 1, "a", 1.0)
    groups = [rows[k::4] for k in range(4)]  # each file covers all days
    files(spark, f"{tmp_path}/events", [*groups, [last]])
    stream = A.event_stream(spark, f"{tmp_path}/events", 1)
    got = A.finished(D.daily_digests(stream, "30 days"), "digest_shuffled").collect()
    assert {(r["user_id"], r["day"]): (r["n"], r["total"], r["highest"], r["message"]) for r in got} == batch(rows, datetime.date(2024, 1, 7))
    assert len(got) == len({(r["user_id"], r["day"]) for r in got})


def test_late_rows_are_counted_and_send_nothing(spark, tmp_path):
    day = lambda d, i: (i, START + datetime.timedelta(days=d, hours=1), 7, "a", 2.0)
    files(spark, f"{tmp_path}/events", [[day(0, 1), day(0, 2)], [day(9, 3)], [day(9, 4)], [day(0, 5), day(9, 6)], [day(20, 7)]])
    import os
    import time

    for k, f in enumerate(sorted((f for f in os.scandir(f"{tmp_path}/events") if f.name.endswith(".parquet")), key=lambda f: f.stat().st_mtime_ns)):
        os.utime(f, (time.time() - 100 + k, time.time() - 100 + k))
    stream = A.event_stream(spark, f"{tmp_path}/events", 1)
    got = A.finished(D.daily_digests(stream, "2 days"), "digest_late").collect()
    assert {(r["day"].day, r["n"]) for r in got} == {(1, 2), (10, 3)}  # the third row of the first day came when its message was sent


def test_metrics_of_micro_batches_are_the_counts_of_the_table(spark, tmp_path):
    rows = made(300, seed=3)
    files(spark, f"{tmp_path}/events", [rows[k::3] for k in range(3)])
    found = M.run(spark, A.event_stream(spark, f"{tmp_path}/events", 1), ["a", "zz"], "metrics_test", f"{tmp_path}/out", (10.0, 500.0))
    values = [r[4] for r in rows if r[4] is not None]
    want = {
        ("events_total", "a"): sum(r[3] == "a" for r in rows),
        ("events_total", "zz"): 0,
        ("events_total", "other"): sum(r[3] != "a" for r in rows),
        ("event_value_bucket", "10"): sum(v <= 10 for v in values),
        ("event_value_bucket", "500"): sum(v <= 500 for v in values),
        ("event_value_bucket", "+Inf"): len(values),
        ("event_value_sum", ""): sum(values),
        ("event_value_count", ""): len(values),
        ("event_batches_total", ""): 3,
        ("event_newest_timestamp_seconds", ""): max(r[1] for r in rows).replace(tzinfo=datetime.UTC).timestamp(),
    }
    samples = found.samples(["a", "zz"], (10.0, 500.0))
    assert {(m, k): v for m, k, v in samples} == want
    assert spark.read.parquet(f"{tmp_path}/out-rows").count() == 300
    text = M.exposition(samples)
    assert f'events_total{{kind="a"}} {want["events_total", "a"]}\n' in text and f"event_value_sum {sum(values):.17g}\n" in text
    assert text.count("# TYPE event_value histogram") == 1 and text.endswith("\n") and M.escaped('a"b\\\n') == 'a\\"b\\\\\\n'


def test_a_cluster_needs_a_shared_folder():
    def session(master, path=None):
        context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda _: path), getCheckpointDir=lambda: None, setCheckpointDir=lambda _: None)
        return SimpleNamespace(sparkContext=context)

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            shared_dir(session(master))
    assert shared_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared" and "tallyloom" in shared_dir(session("local[2]"))
