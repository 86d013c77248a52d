"""Publishing snapshots: CSV and Parquet twins that appear together, marked exports, and retention by date."""

from __future__ import annotations

import datetime
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "﻿"


def file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def publish(df: DataFrame, path: str, sanity=lambda rows: rows) -> str:
    """Write df, after the sanity rules, as Parquet (zstd) and as CSV, and then make both current at once; the version's name.

    Both are written under a version of its own.  Only when they are whole does a one-line file that names the version
    replace the old one, by one rename, so a reader sees either the old twins or the new ones.  What a failed run leaves
    is never named; `tidy` removes it.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    rows = sanity(df)
    rows.write.option("compression", "zstd").parquet(f"{path}/{version}/parquet")
    spark.read.schema(rows.schema).parquet(f"{path}/{version}/parquet").write.option("header", True).csv(f"{path}/{version}/csv")  # the twins hold the same rows
    fs, staged, current = file_system(spark, path), hadoop_path(spark, f"{path}/.{version}"), hadoop_path(spark, f"{path}/CURRENT")
    out = fs.create(staged, True)
    out.write(bytearray(json.dumps({"version": version}).encode()))
    out.close()
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri() if current.toUri().getScheme() else fs.getUri())
    overwrite = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(staged), fs.makeQualified(current), overwrite)
    return version


def current(spark: SparkSession, path: str) -> str | None:
    """The name of the version that readers see."""
    fs, place = file_system(spark, path), hadoop_path(spark, f"{path}/CURRENT")
    if not fs.exists(place):
        return None
    return json.loads(spark.read.text(f"{path}/CURRENT").first()[0])["version"]


def read_published(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """The rows of the current version, from Parquet or (as text) from CSV."""
    version = current(spark, path)
    if version is None:
        raise FileNotFoundError(path)
    place = f"{path}/{version}/{kind}"
    return spark.read.parquet(place) if kind == "parquet" else spark.read.option("header", True).csv(place)


def tidy(spark: SparkSession, path: str) -> list[str]:
    """Remove all versions but the current one; their names."""
    fs, keep, gone = file_system(spark, path), current(spark, path), []
    for entry in fs.listStatus(hadoop_path(spark, path)):
        name = entry.getPath().getName()
        if name.startswith("v-") and name != keep or name.startswith(".v-"):
            fs.delete(entry.getPath(), True)
            gone.append(name)
    return sorted(gone)


def export_marked(df: DataFrame, path: str) -> None:
    """CSV in UTF-8 whose files begin with a byte-order mark, as spreadsheets want it: the mark opens the first column's name."""
    first, *rest = df.columns
    df.select(F.col(f"`{first}`").alias(MARK + first), *[F.col(f"`{c}`") for c in rest]).write.option("header", True).option("encoding", "UTF-8").mode("overwrite").csv(path)


def retain(spark: SparkSession, path: str, as_of: datetime.date, days: int, date_column: str = "snapshot_date") -> list[str]:
    """Remove the folders of dates older than days before as_of; the names of those that went.  Others aren't touched, and no rows are read."""
    fs, gone = file_system(spark, path), []
    oldest = as_of - datetime.timedelta(days=days)
    for entry in fs.listStatus(hadoop_path(spark, path)):
        key, _, value = entry.getPath().getName().partition("=")
        try:
            day = datetime.date.fromisoformat(value)
        except ValueError:
            continue
        if key == date_column and entry.isDirectory() and day < oldest:
            fs.delete(entry.getPath(), True)
            gone.append(f"{key}={value}")
    return sorted(gone)
