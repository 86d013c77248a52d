"""Broker files, names, published snapshots, stress tables and factor timing on small hand-made cases."""

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import names as N
from tallyloom.operators import options as O
from tallyloom.operators import stress as ST
from tallyloom.operators import timing as TM
from tallyloom.sources import broker as B
from tallyloom.sources import publish as P
from tallyloom.sources import sinks as K


def test_files_of_any_encoding_layout_and_separator(spark, tmp_path):
    body = "ISK: Min depå\nDatum: 2026-05-19\n\nVärdepapper;ISIN;Antal;GAV (kr);Kurs;Förändring kurs;Marknadsvärde\n\"Åhléns; AB\";SE01;1 234,5;10,25;−3,5;9;100\n;SE02;1;1;1;1;1\nKort\nför;många;celler;i;denna;rad;a;b\n"
    (tmp_path / "latin.csv").write_bytes(body.encode("latin-1", "replace"))
    (tmp_path / "plain.csv").write_bytes(body.encode())
    (tmp_path / "mark.csv").write_bytes(b"\xef\xbb\xbf" + body.encode())
    (tmp_path / "le.csv").write_bytes(b"\xff\xfe" + body.encode("utf-16-le"))
    (tmp_path / "be.csv").write_bytes(b"\xfe\xff" + body.replace("\n", "\r\n").encode("utf-16-be"))
    (tmp_path / "comma.csv").write_text('Stuff,quantity\n"say ""hi"", you",2\n', encoding="utf-8")
    (tmp_path / "empty.csv").write_bytes(b"")
    found = {}
    for r in B.read_broker(spark, f"{tmp_path}/*.csv").orderBy("file", "line").collect():
        found.setdefault(r["file"], []).append(r)
    assert set(found) == {"latin.csv", "plain.csv", "mark.csv", "le.csv", "be.csv", "comma.csv"}
    assert {f: r[0]["encoding"] for f, r in found.items()} == {"latin.csv": "ISO-8859-1", "plain.csv": "UTF-8", "mark.csv": "UTF-8 with mark", "le.csv": "UTF-16LE", "be.csv": "UTF-16BE", "comma.csv": "UTF-8"}
    for f in ("plain.csv", "mark.csv", "le.csv", "be.csv", "latin.csv"):
        first, second = found[f]
        assert (first["name"], first["isin"], first["line"]) == ("Åhléns; AB", "SE01", 5)
        assert (first["shares"], first["cost_basis"], first["market_value"]) == (1234.5, 10.25, 100.0)
        assert first["current_price"] == (None if f == "latin.csv" else -3.5)  # Latin-1 has no such minus
        assert (second["name"], second["isin"], second["shares"]) == ("Kort", None, None)
    only = found["comma.csv"][0]
    assert (only["name"], only["shares"]) == ('say "hi", you', 2.0)


def test_names_find_their_tickers(spark):
    listings = spark.createDataFrame([("A", "Blue Steel Works"), ("B", "Blue Steel Works"), ("C", "Green Steel Works"), ("D", "Volvo"), ("E", "Investor"), ("F", "Red Steel Mills Inc")], "ticker string, name string")
    custom = spark.createDataFrame([("My Own, Co.", "OWN")], "name string, ticker string")
    known = spark.createDataFrame([("Zero Fund", None), ("Volvo", "VOLV-B.ST")], "name string, ticker string")
    asked = ["my own co", "ZERO FUND", "Volvo", "Bleu Steel Works", "Blu Steel Works", "Blue Steel Works", "Investr", "Invstr", "", None, "Red Steel Mils", "Steel", "Blue Steel Works"]
    held = spark.createDataFrame(list(enumerate(asked)), "id long, name string")
    got = {r["id"]: (r["ticker"], r["kind"], r["found_by"]) for r in N.tickers(held, custom, known, listings).collect()}
    assert got == {
        0: ("OWN", "stock", "custom"), 1: (None, "fund", "known"), 2: ("VOLV-B.ST", "stock", "known"), 3: ("A", "stock", "listing"), 4: ("A", "stock", "listing"), 5: ("A", "stock", "listing"),
        6: ("E", "stock", "listing"), 7: (None, "unknown", None), 8: (None, "unknown", None), 9: (None, "unknown", None), 10: (None, "unknown", None), 11: (None, "unknown", None), 12: ("A", "stock", "listing"),
    }
    shorts = spark.createDataFrame([("INVE B", "XSTO"), ("AAPL", "xnas "), ("X", "FUND"), ("Y", None), ("", "XSTO")], "short string, market string")
    assert [r[0] for r in shorts.select(N.exchange_ticker("short", "market", {"XSTO": ".ST", "XNAS": "", "FUND": None})).collect()] == ["INVE-B.ST", "AAPL", None, "Y", None]


def test_no_pair_is_made_between_names_without_a_rare_word(spark):
    """Two hundred names that share one word: only the rarer words are looked up."""
    listings = spark.createDataFrame([(f"T{k:03}", f"common name{chr(97 + k % 26)}{chr(97 + k // 26)}qz") for k in range(200)], "ticker string, name string")
    asked = spark.createDataFrame([(k, f"Common name{chr(97 + k % 26)}{chr(97 + k // 26)}qz") for k in range(200)], "id long, name string")
    none = spark.createDataFrame([], "name string, ticker string")
    got = N.tickers(asked, none, none, listings).collect()
    assert all(r["ticker"] == f"T{r['id']:03}" for r in got) and len(got) == 200


def test_twins_appear_together_or_not_at_all(spark, tmp_path):
    path, rows = f"{tmp_path}/out", spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    assert P.current(spark, path) is None
    first = P.publish(rows, path)
    seen = lambda kind: sorted((int(r["id"]), r["name"]) for r in P.read_published(spark, path, kind).collect())
    assert seen("csv") == seen("parquet") == [(1, "a"), (2, None)]

    def broken(df):
        return df.withColumn("name", F.raise_error(F.lit("no")))

    with pytest.raises(Exception, match="no"):
        P.publish(rows, path, broken)
    assert P.current(spark, path) == first and seen("csv") == [(1, "a"), (2, None)]
    second = P.publish(rows, path, lambda df: df.where("name is not null"))
    assert P.current(spark, path) == second != first and seen("csv") == seen("parquet") == [(1, "a")]
    gone = P.tidy(spark, path)
    assert first in gone and second not in gone and seen("parquet") == [(1, "a")]
    assert sorted(x for x in os.listdir(path) if not x.endswith(".crc")) == ["CURRENT", second]


def test_old_dates_go_and_others_stay_byte_by_byte(spark, tmp_path):
    path = f"{tmp_path}/store"
    days = [datetime.date(2024, 1, 1) + datetime.timedelta(days=30 * k) for k in range(5)]
    K.save_snapshot(spark.createDataFrame([(d, "x") for d in days], "snapshot_date date, ticker string"), path)
    os.makedirs(f"{path}/other=1"), os.makedirs(f"{path}/snapshot_date=never")
    kept = {f"{d}/{f}": open(f"{d}/{f}", "rb").read() for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}
    assert P.retain(spark, path, days[-1], 60) == ["snapshot_date=2024-01-01", "snapshot_date=2024-01-31"]
    left = {f"{d}/{f}": open(f"{d}/{f}", "rb").read() for d, _, files in os.walk(path) for f in files if f.endswith(".parquet")}
    assert left == {k: v for k, v in kept.items() if "2024-01" not in k} and len(left) == 3
    assert os.path.isdir(f"{path}/other=1") and os.path.isdir(f"{path}/snapshot_date=never")


def test_stress_of_a_small_book(spark):
    held = spark.createDataFrame([("b", "X", "Energy", 1.5, 30.0), ("b", "Y", None, None, 70.0), ("c", "Z", "Energy", 1.0, 0.0)], "book string, ticker string, sector string, beta double, value double")
    table = ST.stress_table(ST.weighted(held), {"s": {"_default_": -0.4, "Energy": 0.1}})
    got = {(r["book"], r["ticker"]): (r["is_total"], r["weight"], r["beta"], r["s"]) for r in table.collect()}
    assert got == {("b", "X"): (False, 0.3, 1.5, 0.045), ("b", "Y"): (False, 0.7, 1.0, -0.28), ("b", "TOTAL"): (True, 1.0, 0.0, -0.235), ("c", "Z"): (False, None, 1.0, 0.0), ("c", "TOTAL"): (True, None, 0.0, 0.0)}
    r = ST.summary(table, ["s"]).where("book = 'b'").first()
    assert (r["total_impact"], r["worst"], r["best"], r["level"]) == (-23.5, "Y", "X", "medium")


def test_weights_follow_a_turn_of_leadership_but_not_before_it(spark):
    months = [datetime.date(2020 + k // 12, k % 12 + 1, 1) for k in range(24)]
    rows = [(m, t, float(t), float(-t), float(t if k < 12 else -t)) for k, m in enumerate(months) for t in range(20)]
    ranks = TM.factor_ranks(spark.createDataFrame(rows, "month date, ticker long, up double, down double, actual double"), {"up": F.col("up"), "down": F.col("down")})
    got = {(r["month"], r["factor"]): r["weight"] for r in TM.weights(TM.factor_returns(ranks, ["up", "down"])).collect()}
    up = [got[m, "up"] for m in months]
    assert up[0] == 0.5 and up[1:13] == [1.0] * 12  # the month of the turn itself still goes by what came before
    assert up[15] == 0.5 and up[16:] == [0.0] * 8 and all(got[m, "up"] + got[m, "down"] == pytest.approx(1.0) for m in months)
    signal = {(r["month"], r["ticker"]): r["signal"] for r in TM.timed_signals(ranks, TM.weights(TM.factor_returns(ranks, ["up", "down"])), ["up", "down"]).collect()}
    assert signal[months[5], 19] == 1.0 and signal[months[20], 0] == 1.0 and signal[months[0], 3] == pytest.approx(signal[months[0], 4])


def test_implied_volatility_gives_the_price_back(spark):
    rows = [(k, kind, spot, strike, days, iv) for k, (kind, spot, strike, days, iv) in enumerate([("call", 100.0, 90.0, 30, 0.2), ("put", 100.0, 120.0, 365, 0.05), ("call", 50.0, 50.0, 7, 1.5), ("put", 250.0, 240.0, 180, 0.35)])]
    chain = spark.createDataFrame(rows, "contract long, kind string, spot double, strike double, days int, iv double")
    priced = O.greeks(chain).withColumn("last_price", F.col("value")).drop("d1", "d2", "delta", "gamma", "vega", "value")
    for r in O.implied_volatility(priced).collect():
        assert r["implied"] == pytest.approx(r["iv"], abs=2e-4)
    none = spark.createDataFrame([(1, "call", 100.0, 50.0, 30, 10.0), (2, "put", 100.0, 50.0, 30, 200.0), (3, "call", 100.0, 100.0, 0, 5.0), (4, "call", 100.0, 100.0, 30, None), (5, "call", 100.0, 100.0, 30, -1.0)], "contract long, kind string, spot double, strike double, days int, last_price double")
    assert [r["implied"] for r in O.implied_volatility(none).collect()] == [None] * 5
