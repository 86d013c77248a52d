"""Writing snapshots and exports: one folder for each date, committed whole by Spark's writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def save_snapshot(df: DataFrame, path: str, date_column: str = "snapshot_date", replace: bool = False) -> None:
    """Parquet (zstd) by date.  Without replace, dates that are there already are left as they are."""
    spark = df.sparkSession
    if not replace and exists(spark, path):
        there = spark.read.parquet(path).select(date_column).distinct()
        df = df.join(F.broadcast(there), date_column, "left_anti")  # one row a date
    mode = "overwrite" if replace else "append"
    df.write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy(date_column).mode(mode).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def drop_old(df: DataFrame, as_of: str, days: int, date_column: str = "snapshot_date") -> DataFrame:
    """Rows of the last days; as the date is the partition, the rest isn't read."""
    return df.where(F.col(date_column) >= F.date_sub(F.lit(as_of).cast("date"), days))


def export_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).option("encoding", "UTF-8").mode("overwrite").csv(path)


def read_csv(spark: SparkSession, path: str, sep: str = ";", encoding: str = "UTF-8") -> DataFrame:
    """Broker files: every column as text, names stripped, broken lines skipped."""
    df = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", "DROPMALFORMED").csv(path)
    return df.toDF(*[c.strip().lstrip("﻿") for c in df.columns])


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Metric logs; broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot's Parquet files (path.parquet), or if there are none its CSV twin (path.csv) as text; names are stripped."""
    if exists(spark, f"{path}.parquet"):
        df = spark.read.parquet(f"{path}.parquet")
    else:
        df = spark.read.option("header", True).csv(f"{path}.csv")
    return df.toDF(*[c.strip() for c in df.columns])


def swedish_number(c) -> Column:
    """A number written with blanks between thousands and a decimal comma; null if it isn't one."""
    text = F.regexp_replace(F.col(c) if isinstance(c, str) else c, r"[\s\u00a0\u202f]", "")
    return F.replace(F.replace(text, F.lit("\u2212"), F.lit("-")), F.lit(","), F.lit(".")).try_cast("double")


def read_json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that are one JSON document each (lists of watched or barred names, alerts)."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
