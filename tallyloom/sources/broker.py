"""Broker files of unknown encoding, separator and layout, read file by file as rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.sources.sinks import swedish_number

# Cells that mark the line of column names.
MARKS = ["värdepapper", "antal", "security", "quantity", "name", "isin", "kontonummer", "volym", "kortnamn"]
TARGETS = ["name", "isin", "shares", "cost_basis", "current_price", "market_value"]


def decoded(content: str = "content") -> tuple[Column, Column]:
    """(encoding, text) of a file's bytes: by its byte-order mark, else UTF-8 if it is valid, else Latin-1."""
    c = F.col(content)
    head = F.hex(F.substring(c, 1, 3))
    valid = F.is_valid_utf8(c.cast("string"))
    cut = lambda k: F.substring(c, F.lit(k), F.length(c))
    encoding = F.when(head == "EFBBBF", "UTF-8 with mark").when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE").when(valid, "UTF-8").otherwise("ISO-8859-1")
    text = (
        F.when(encoding == "UTF-8 with mark", F.decode(cut(4), "UTF-8"))
        .when(encoding == "UTF-16LE", F.decode(cut(3), "UTF-16LE"))
        .when(encoding == "UTF-16BE", F.decode(cut(3), "UTF-16BE"))
        .when(encoding == "UTF-8", F.when(valid, c.cast("string")))
        .otherwise(F.decode(c, "ISO-8859-1"))
    )
    return encoding, text


def cells(line: Column, sep: Column) -> Column:
    """The cells of a line; quotes around one keep separators in it."""
    found = F.regexp_extract_all(F.concat(sep, line), F.concat(sep, F.lit('("(?:[^"]|"")*"|[^'), sep, F.lit("]*)")), F.lit(1))
    return F.transform(found, lambda x: F.trim(F.when(x.startswith('"'), F.replace(F.regexp_replace(x, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)))


def target(cell: Column) -> Column:
    """What a column's name says that it holds, null if nothing that is read."""
    c = F.lower(F.trim(cell))
    has = lambda *parts: reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])
    return (
        F.when(has("värdepapper", "security") | c.isin("namn", "name"), "name")
        .when(c.startswith("isin"), "isin")
        .when(has("antal", "quantity", "shares", "volym"), "shares")
        .when(has("köpkurs", "genomsnittlig", "purchase", "anskaffningskurs") | (c == "gav") | c.startswith("gav "), "cost_basis")
        .when(has("kurs") & ~has("köp", "anskaff", "förändring", "resultat"), "current_price")
        .when(has("marknadsvärde", "market value") | (c == "värde"), "market_value")
    )


def read_broker(spark: SparkSession, path: str) -> DataFrame:
    """file, encoding, line and name, isin, shares, cost_basis, current_price, market_value of every row of the files under path.

    Each file is one row until it is cut into lines: broker exports, of some MB.  Lines before the column names are left
    out, as are lines with more cells than names and rows without a name; missing cells are null.  Of several columns with
    one meaning the first counts; without a column of names the first one is taken.
    """
    encoding, text = decoded()
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), encoding.alias("encoding"), F.split(text, "\r\n|\n|\r").alias("lines"))
    filled = F.filter("lines", lambda x: F.trim(x) != "")

    def marked(sep: Column):
        return lambda x: F.arrays_overlap(F.transform(cells(x, sep), F.lower), F.array(*[F.lit(m) for m in MARKS]))

    # a first line of other things has no separator, so the line of names is looked for with the semicolon as well
    semicolon = F.contains(F.coalesce(F.get(filled, F.lit(0)), F.lit("")), F.lit(";")) | F.exists("lines", marked(F.lit(";")))
    files = files.withColumn("sep", F.when(semicolon, ";").otherwise(","))
    files = files.withColumn("at", F.greatest(F.array_position(F.transform("lines", marked(F.col("sep"))), True), F.lit(1)).cast("int"))
    files = files.withColumn("names", cells(F.element_at("lines", F.col("at")), F.col("sep")))
    files = files.withColumn("targets", F.transform("names", target))
    first = F.when(F.array_contains(F.transform("targets", lambda x: F.coalesce(x, F.lit(""))), "name"), F.array_position("targets", "name")).otherwise(F.lit(1))
    spots = {t: F.array_position("targets", t) for t in TARGETS} | {"name": first}
    rows = files.select("file", "encoding", "sep", F.size("names").alias("n"), *[spots[t].cast("int").alias(f"at_{t}") for t in TARGETS], "at", F.posexplode("lines").alias("line", "text"))
    rows = rows.where(F.col("line") >= F.col("at")).withColumn("cells", cells(F.col("text"), F.col("sep"))).where((F.trim("text") != "") & (F.size("cells") <= F.col("n")))
    value = lambda t: F.nullif(F.when(F.col(f"at_{t}") > 0, F.get("cells", F.col(f"at_{t}") - 1)), F.lit(""))
    out = rows.select("file", "encoding", (F.col("line") + 1).alias("line"), *[value(t).alias(t) for t in TARGETS])
    return out.where("name is not null").select("file", "encoding", "line", "name", "isin", *[swedish_number(t).alias(t) for t in TARGETS[2:]])
