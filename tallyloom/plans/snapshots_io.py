"""Queries that write through the sinks and read back through the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tallyloom.plans.registry import query
from tallyloom.sources import sinks as K
from tallyloom.sources.catalog import Tables
from tallyloom.streaming.alerts import shared_dir


def fresh(t: Tables) -> str:
    return f"{shared_dir(t.spark)}/io-{uuid.uuid4().hex}"


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name FROM nation")
def src_01_snapshot_or_csv(t: Tables):
    """No Parquet there, so its CSV twin is read; blanks around names go."""
    path = fresh(t)
    t.nation.select(F.col("n_nationkey").alias(" n_nationkey"), F.col("n_name").alias("n_name ")).write.option("header", True).csv(f"{path}.csv")
    return K.read_snapshot(t.spark, path)


@query("SELECT r_regionkey AS id, r_name AS name, n_name AS member FROM region JOIN nation ON n_regionkey = r_regionkey")
def src_05_json_documents(t: Tables):
    """A document for each region with the list of its members, read by schema and unfolded."""
    path = fresh(t)
    lists = t.nation.groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.collect_list("n_name").alias("members"))
    t.region.join(lists, "r_regionkey").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"), "members").write.partitionBy("id").json(path)
    docs = K.read_json_documents(t.spark, path, "id int, name string, members array<string>")
    return docs.select("id", "name", F.explode("members").alias("member"))


@query("SELECT s_suppkey, s_name, round(s_acctbal, 2) AS balance FROM supplier")
def src_07_swedish_csv(t: Tables):
    """Broker file in Latin-1 with semicolons, blanks between thousands and decimal commas."""
    path = fresh(t)
    number = F.translate(F.format_number("s_acctbal", 2), ",.", " ,")
    t.supplier.select("s_suppkey", "s_name", number.alias("Saldo (kr)")).write.option("header", True).option("sep", ";").option("encoding", "ISO-8859-1").csv(path)
    rows = K.read_csv(t.spark, path, encoding="ISO-8859-1")
    return rows.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", K.swedish_number("Saldo (kr)").alias("balance"))


@query("SELECT snapshot_date, ticker, score_total, entry_signal FROM snapshots", "snapshots")
def snk_01_02_snapshots(t: Tables):
    """Saved by date in two steps, the second over dates that are there already: those stay as they were."""
    path, rows = fresh(t), t.snapshots.select("snapshot_date", "ticker", "score_total", "entry_signal")
    K.save_snapshot(rows.where("year(snapshot_date) <= 1995"), path)
    K.save_snapshot(rows, path)
    return t.spark.read.parquet(path).select(*rows.columns)
