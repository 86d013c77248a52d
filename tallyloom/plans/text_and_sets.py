"""Queries over text, sets and events in batch."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyloom.operators import text as X
from tallyloom.plans.cross_section import r6
from tallyloom.plans.registry import query
from tallyloom.sources.catalog import Tables

q = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"


@query(f"WITH w AS (SELECT conv_id, turn, CASE WHEN length(trim(coalesce(text, ''))) < 5 THEN []::VARCHAR[] ELSE list_distinct(regexp_split_to_array(lower(text), '[ \\t\\n\\x0b\\f\\r]+')) END AS ws FROM conversations), c AS (SELECT conv_id, turn, len(list_intersect(ws, {q(X.POSITIVE)})) AS p, len(list_intersect(ws, {q(X.NEGATIVE)})) AS n FROM w) SELECT conv_id, turn, CASE WHEN p + n > 0 THEN round((p - n) * 1.0 / (p + n), 6) ELSE 0.0 END AS sentiment FROM c")
def fn_10_lexicon_sentiment(t: Tables):
    return t.conversations.select("conv_id", "turn", r6(X.sentiment("text"), "sentiment"))


@query(f"WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(text, '[^ \\n.,!?;:()$#]+'), lambda x: regexp_full_match(x, '[A-Z]{{2,5}}') AND NOT list_contains({q(X.STOP)}, x))) AS ts FROM documents), e AS (SELECT doc_id, unnest(ts) AS ticker FROM w) SELECT ticker, count(*) AS n FROM e GROUP BY ticker")
def fn_09_ticker_mentions(t: Tables):
    return t.documents.select("doc_id", F.explode(X.tickers("text")).alias("ticker")).groupBy("ticker").agg(F.count("*").alias("n"))


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lower(left(text, 50)) ORDER BY doc_id DESC) AS k FROM documents) WHERE k = 1")
def set_05_news_merge(t: Tables):
    w = Window.partitionBy(F.lower(F.substring("text", 1, 50))).orderBy(F.col("doc_id").desc())
    return t.documents.withColumn("k", F.row_number().over(w)).where("k = 1").select("doc_id")


@query("SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first_key FROM orders GROUP BY 1, 2")
def set_03_06_keep_first(t: Tables):
    w = Window.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey")
    return t.orders.withColumn("k", F.row_number().over(w)).where("k = 1").select("o_custkey", "o_orderstatus", F.col("o_orderkey").alias("first_key"))


@query("SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title, length(html)::BIGINT AS size FROM pages")
def src_10_page_titles(t: Tables):
    return t.pages.select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), F.length("html").cast("long").alias("size"))


@query("SELECT event_type, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS total, count(*) AS n FROM events GROUP BY event_type")
def fn_08_json_props(t: Tables):
    return t.events.select("event_type", F.from_json("props", "k long")["k"].alias("k")).groupBy("event_type").agg(F.sum("k").alias("total"), F.count("*").alias("n"))


@query("SELECT doc_id, md5(coalesce(text, '')) AS md5, sha256(coalesce(text, '')) AS sha256 FROM documents")
def fn_11_hashes(t: Tables):
    x = F.coalesce("text", F.lit(""))
    return t.documents.select("doc_id", F.md5(x.cast("binary")).alias("md5"), F.sha2(x.cast("binary"), 256).alias("sha256"))


@query("SELECT event_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS days, month(ts) AS month, CAST(isodow(ts) - 1 AS INTEGER) AS weekday, strftime(ts, '%Y-%m') AS period, CAST(date_trunc('week', ts) AS DATE) AS week FROM events")
def fn_04_dates(t: Tables):
    return t.events.select("event_id", F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("days"), F.month("ts").cast("long").alias("month"), F.weekday("ts").alias("weekday"), F.date_format("ts", "yyyy-MM").alias("period"), F.trunc(F.col("ts").cast("date"), "WEEK").alias("week"))


@query("SELECT event_type, count(*) AS n, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, list_sort(list(value))[count(*) // 2 + 1] AS p50, list_sort(list(value))[CAST(floor(0.95 * count(*)) AS BIGINT) + 1] AS p95, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY event_type")
def agg_15_metric_summary(t: Tables):
    return X.metric_summary(t.events).select("event_type", "n", "low", "high", r6("mean"), "p50", "p95", "last")


@query("SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS k FROM events) WHERE k <= 10")
def src_06_metrics_tail(t: Tables):
    w = Window.partitionBy("event_type").orderBy(F.col("ts").desc(), "event_id")
    return t.events.withColumn("k", F.row_number().over(w)).where("k <= 10").select("event_type", "event_id")


@query("WITH c AS (SELECT o_custkey AS ticker, o_orderpriority AS source, o_totalprice / 500000 AS confidence FROM orders), m AS (SELECT ticker, max(confidence) AS best, count(DISTINCT source) AS k FROM c GROUP BY ticker) SELECT ticker, k AS sources, round(least(1.0, best + CASE WHEN k > 1 THEN list_sum(list_transform(range(2, k + 1), lambda i: least(0.05 * (i - 1), 0.20))) ELSE 0 END), 6) AS confidence FROM m")
def set_08_candidate_merge(t: Tables):
    return X.merge_candidates(t.orders.select(F.col("o_custkey").alias("ticker"), F.col("o_orderpriority").alias("source"), (F.col("o_totalprice") / 500000).alias("confidence"))).select("ticker", "sources", r6("confidence"))
