"""Snapshot sinks and readers."""

import datetime

from tallyloom.sources import sinks


def test_snapshots_are_written_once(spark, tmp_path):
    path = f"{tmp_path}/snapshots"
    day = lambda d, v: spark.createDataFrame([(datetime.date(2024, 1, d), "x", v)], "snapshot_date date, ticker string, score double")
    sinks.save_snapshot(day(1, 1.0), path)
    sinks.save_snapshot(day(1, 9.0).unionByName(day(2, 2.0)), path)
    assert [r["score"] for r in spark.read.parquet(path).orderBy("snapshot_date").collect()] == [1.0, 2.0]
    sinks.save_snapshot(day(2, 5.0), path, replace=True)
    assert [r["score"] for r in spark.read.parquet(path).orderBy("snapshot_date").collect()] == [1.0, 5.0]
    assert sinks.drop_old(spark.read.parquet(path), "2024-01-10", 8).count() == 1


def test_csv_and_json_lines(spark, tmp_path):
    (tmp_path / "broker.csv").write_text(" Name ;Value\nabc;1 234,5\nbroken\n", encoding="utf-8")
    rows = sinks.read_csv(spark, f"{tmp_path}/broker.csv")
    assert rows.columns == ["Name", "Value"] and rows.first()["Value"] == "1 234,5"
    (tmp_path / "m.jsonl").write_text('{"name": "a", "v": 1.5}\nnot json\n{"name": "b", "v": 2.5}\n')
    assert sinks.read_json_lines(spark, f"{tmp_path}/m.jsonl", "name string, v double").count() == 2
