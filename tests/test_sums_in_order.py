"""Sums of a part's lines follow the table's rows, as one thread of another engine adds them, however files and tasks cut the table."""

import datetime
import random

import duckdb
import pyarrow.parquet as pq
import pytest

from tallyloom.plans.registry import ORACLES, QUERIES
from tallyloom.sources.catalog import Tables

DATA = "/root/testdata/sf0.001"
FILES = 7


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The smallest tables, the lines cut into files in their order, so that most parts have lines in all of them."""
    path = tmp_path_factory.mktemp("cut")
    lines = pq.read_table(f"{DATA}/lineitem.parquet")
    (path / "lineitem.parquet").mkdir()
    step = -(-lines.num_rows // FILES)
    for k in range(FILES):
        pq.write_table(lines.slice(k * step, step), path / "lineitem.parquet" / f"{k}.parquet", row_group_size=100)
    (path / "part.parquet").symlink_to(f"{DATA}/part.parquet")
    return str(path)


@pytest.fixture(scope="module")
def other():
    """The same rows in one file, read by one thread."""
    con = duckdb.connect(config={"threads": 1})
    for name in ("lineitem", "part"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    yield con
    con.close()


def added(numbers):
    total = 0.0
    for x in numbers:
        total += x
    return total


def test_numbers_are_added_row_by_row(spark, folder):
    rows = pq.read_table(f"{DATA}/lineitem.parquet", columns=["l_partkey", "l_extendedprice", "l_discount", "l_tax"]).to_pylist()
    lines = {}
    for r in rows:
        lines.setdefault(r["l_partkey"], []).append(r)
    t = Tables(spark, folder)
    assert spark.read.parquet(f"{folder}/lineitem.parquet").rdd.getNumPartitions() > 2
    found = {r["pk"]: r for r in t.xsection.collect()}
    assert sorted(found) == sorted(lines)
    for pk, own in lines.items():
        assert found[pk]["total_revenue"] == added(r["l_extendedprice"] for r in own) * 400
        assert found[pk]["profit_margin"] == 1 - added(r["l_discount"] for r in own) / len(own) - 0.9
        if pk % 6:
            assert found[pk]["dividend_yield"] == added(r["l_tax"] for r in own) / len(own)
    for r in t.chain.collect():
        own = lines[r["contract"]]
        assert r["last_price"] == added(x["l_tax"] for x in own) / len(own) * 100


NAMES = ["flagship_top_signals", "flt_03_confidence", "flt_04_entry_signal", "flt_05_signal_counts", "opt_11_covered_calls", "scr_05_16_factor_scores", "scr_17_20_global_scorer_bull", "scr_18_sector_weights_bear", "scr_19_composite_sector_neutral", "scr_21_sector_blend", "scr_23_26_small_cap_scores", "scr_27_28_early_warning"]


@pytest.mark.parametrize("name", NAMES)
def test_rows_are_those_of_one_thread_of_sql(spark, folder, other, name):
    found = QUERIES[name](spark, folder)
    mine = sorted(map(repr, (tuple(r) for r in found.collect())))
    theirs = sorted(map(repr, other.execute(ORACLES[name]).fetchall()))
    assert mine == theirs


def test_repeated_parts_and_odd_lines(spark, tmp_path):
    """A part that stands twice counts its lines twice; nulls are passed by, and lines without a part are left out."""
    dice, day = random.Random(3), datetime.datetime(2024, 1, 1)
    lines = [(n, 1 + n % 3, 1, 1, 2.0, None if n % 11 == 0 else dice.randint(1, 10**7) / 100, None if n % 3 == 2 else dice.randint(0, 10) / 100, 0.02, "N", "O", day) for n in range(90)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    (tmp_path / "lineitem.parquet").mkdir()
    for k in range(3):
        spark.createDataFrame(lines[30 * k : 30 * k + 30], names).coalesce(1).write.parquet(f"{tmp_path}/{k}")
        (file,) = (tmp_path / str(k)).glob("*.parquet")
        file.rename(tmp_path / "lineitem.parquet" / f"{k}.parquet")
    spark.createDataFrame([(1, "a", "b", "t", 1, 9.0), (1, "a", "b", "t", 1, 9.0), (3, "c", "b", "t", 1, 9.0)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    found = {r["pk"]: r for r in Tables(spark, str(tmp_path)).xsection.collect()}
    assert sorted(found) == [1, 3] and found[3]["profit_margin"] is None
    prices = [x[5] for x in lines if x[1] == 1 and x[5] is not None for _ in range(2)]
    assert found[1]["total_revenue"] == added(prices) * 400
