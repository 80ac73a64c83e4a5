import datetime as dt
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandlake import Lake, LayoutError

from .conftest import main_lake, put

BOTH = pytest.mark.parametrize("strategy", ["zip", "join"])


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def lake(spark, lake_root):
    return Lake(spark, str(lake_root))


@BOTH
def test_counts(lake, strategy):
    df = lake.scan("main", columns=["rowid", "alpha001", "alpha099", "rowid_ma", "rowid_alpha"], strategy=strategy)
    bad = F.sum(F.when(F.col("rowid") != F.col("rowid_alpha"), 1).otherwise(0))
    assert rows(df.agg(F.count("*"), F.count("alpha001"), F.count("alpha099"), F.count("rowid_ma"), bad)) == [(6000, 1200, 666, 4000, 0)]


@BOTH
def test_rows_by_position(lake, strategy):
    df = lake.scan("main", columns=["rowid", "ma5", "ma20", "alpha001", "alpha099", "factor.alpha101.vwap", "fieldset.ma.vwap"], strategy=strategy)
    got = {r[0]: tuple(r)[1:] for r in df.where("rowid in (0, 1999, 2000, 4095, 4500, 5999)").collect()}
    assert got[0][0] is None and got[1999][0] is None
    assert got[2000][0] == 0.0 and got[5999][0] == pytest.approx(1.9)
    assert got[2000][2] == pytest.approx(20.02) and got[4095][2] == pytest.approx(40.97)
    assert got[2000][1] == pytest.approx(0.5) and got[4095][1] == pytest.approx(0.375)
    assert got[4500][3] == pytest.approx(4.501)
    assert got[2000][4:] == (250.125, 62.53125)


@BOTH
def test_strategies_agree(lake, strategy):
    columns = [c for c in lake.scan("main").columns]
    a = lake.scan("main", columns=columns, strategy=strategy)
    b = lake.scan("main", columns=columns)
    assert a.schema == b.schema and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_pruning(lake):
    assert lake.scan("main", where="date = DATE '2026-08-01'").count() == 4000
    df = lake.scan("main", columns=["rowid", "alpha001"], where="date = DATE '2026-07-01'")
    assert df.count() == 2000
    assert lake.scan("main", where=[("month", "=", "2026-08")]).count() == 4000
    assert lake.scan("main", where=[("month", "<", "2026-08")]).count() == 2000
    assert lake.scan("main", where="date > DATE '2027-01-01'").count() == 0
    assert lake.scan("main", where="DATE '2026-07-15' > date AND close > 999").count() == 2
    assert lake.scan("main", where="date = DATE '2026-07-01' OR close > 2999.5").count() == 2001


def test_between_in_and_folded_constants_prune(spark, lake):
    from strandlake.plans.pruning import conjuncts, kept_partitions

    table = lake.plan("main")
    kept = lambda text: kept_partitions(table, conjuncts(spark, text))
    assert kept("date BETWEEN DATE '2026-08-01' AND DATE '2026-08-31'") == ["month=2026-08"]
    assert kept("date >= DATE '2026-07-30' + INTERVAL 2 DAY AND close > 0") == ["month=2026-08"]
    assert kept("date IN (DATE '2026-07-03', DATE '2026-07-04')") == ["month=2026-07"]
    assert kept("date = to_date('2026-07-03')") == ["month=2026-07"]
    assert kept("month = concat('2026', '-08')") == ["month=2026-08"]
    assert kept("date NOT BETWEEN DATE '2026-08-01' AND DATE '2026-08-31'") == kept("date = current_date() OR close = 1") == ["month=2026-07", "month=2026-08"]
    assert lake.scan("main", where="date BETWEEN DATE '2026-08-01' AND DATE '2026-08-31' AND close IN (1000.5, 3000)").count() == 2


def test_zip_skips_row_groups(spark, tmp_path, monkeypatch):
    """Of 4 ranges of rows only those are read whose statistics leave a match; the result is that of the join."""
    from strandlake.sources import scan as module

    monkeypatch.setattr(module, "ROWS_PER_GROUP", 1000)
    n = 4000
    put(tmp_path / "t", "index", "month=2026-01", f"0000-{n:010d}.parquet", [("sym", pa.string(), [f"{i:05d}" for i in range(n)]), ("d", pa.date32(), [dt.date(2026, 1, 1 + i // 1000) for i in range(n)])], 1000)
    put(tmp_path / "t", "a/b", "month=2026-01", f"0000-{n:010d}.parquet", [("x", pa.float64(), [float("nan") if i == 5 else float(i) for i in range(n)]), ("y", pa.int64(), [None if i < 1000 else i for i in range(n)])], 500)
    seen = []
    real = module.RowReader.may_hold
    monkeypatch.setattr(module.RowReader, "may_hold", lambda self, a, b, tests: seen.append((a, real(self, a, b, tests))) or seen[-1][1])
    lake = Lake(spark, str(tmp_path))
    columns = ["sym", "x", "y"]
    for where, some in (("sym = '01500'", 1), ("d = DATE '2026-01-03'", 1000), ("x >= 3990.0", 11), ("y < 1005", 5), ("y IN (1, 2500)", 1), ("sym > '03997' AND x < 10", 0), ("3000 <= y AND sym < '03002'", 2)):
        got = lake.scan("t", columns=columns, where=where, strategy="zip")
        assert got.count() == some
        if "x >=" not in where:  # Spark's Parquet reader leaves out a NaN there, whose row group's greatest number is less
            assert sorted(map(str, got.collect())) == sorted(map(str, lake.scan("t", columns=columns, where=where, strategy="join").collect()))
    reader = module.RowReader(pa.fs.LocalFileSystem(), [(str(tmp_path / f"t/a/b/month=2026-01/0000-{n:010d}.parquet"), 0, n)], pa.schema([("y", pa.int64())]))
    assert [real(reader, a, a + 1000, [("y", "<", 1005)]) for a in range(0, n, 1000)] == [False, True, False, False]
    assert [real(reader, a, a + 1000, [("x", ">", 9e9)]) for a in range(0, n, 1000)] == [True] * 4  # NaN lies above all numbers


def test_row_numbers_and_partitions_open_no_file(spark, lake):
    df = lake.scan("main", columns=["month"])
    assert df.inputFiles() == [] and df.groupBy("month").count().orderBy("month").collect() == [("2026-07", 2000), ("2026-08", 4000)]


def test_footers_are_opened_once(spark, tmp_path, monkeypatch):
    from strandlake.plans import layout

    main_lake(tmp_path)
    opened = []
    real = layout._footer
    monkeypatch.setattr(layout, "_footer", lambda store, path, rows: opened.append(path) or real(store, path, rows))
    lake = Lake(spark, str(tmp_path))
    first = lake.scan("main").schema
    assert len(opened) == 5
    assert lake.scan("main").schema == first and len(opened) == 5
    put(tmp_path / "main", "fieldset/ma", "month=2026-08", "0001-0000002000.parquet", [("ma5", pa.float64(), [2.5] * 2000)])
    later = lake.scan("main").schema
    assert len(opened) == 6
    # Many are read by tasks.
    monkeypatch.setattr(layout, "FOOTERS_BY_DRIVER", 1)
    layout._footers.clear()
    assert lake.scan("main").schema == later and len(opened) == 6


def test_only_needed_groups_are_opened(lake):
    plan = lake.scan("main", columns=["close"])._jdf.queryExecution().toString()
    assert "alpha101" not in plan and "Join" not in plan and "MapInArrow" not in plan
    assert lake.count("main") == 6000
    assert lake.scan("main").agg(F.max("close"), F.sum("rowid")).first() == (3000.0, 17997000)


def test_single_full_group_needs_no_index(lake):
    files = lake.scan("main", columns=["alpha001", "rowid_alpha"]).inputFiles()
    assert len(files) == 3 and all("alpha101" in f for f in files)
    assert lake.scan("main", columns=["ma5"]).count() == 6000  # the group lacks a month, so the index sets the rows


def test_names(lake):
    shown = lake.scan("main").columns
    assert shown[:5] == ["symbol", "date", "close", "volume", "rowid"] and shown[-1] == "month"
    assert "factor.alpha101.vwap" in shown and "vwap" not in shown and "factor.alpha101.close" not in shown
    assert "alpha001" in shown and "factor.alpha101.alpha001" in shown
    one = lake.scan("main", "FACTOR/alpha101, nothing").columns
    assert "vwap" in one and "ma5" not in one
    assert lake.scan("main", "").columns == shown
    assert len(lake.scan("main").select(lake.scan("main").colRegex("`factor.alpha101.alpha00.*`")).columns) == 9
    with pytest.raises(ValueError, match="not found"):
        lake.scan("main", columns=["vwap"])
    same = lake.scan("main", columns=["alpha001", "factor.alpha101.alpha001"]).where("`alpha001` <> `factor.alpha101.alpha001`")
    assert same.count() == 0


def test_virtual_rowid(spark, tmp_path):
    for day, n in ((1, 3), (2, 2)):
        put(tmp_path / "t", "index", f"date=2026-01-0{day}", f"0000-{n:010d}.parquet", [("sym", pa.string(), [f"s{i}" for i in range(n)]), ("ts", pa.timestamp("us"), [dt.datetime(2026, 1, day, 10)] * n)])
    lake = Lake(spark, str(tmp_path))
    df = lake.scan("t", rowid=True)
    assert rows(df.select("rowid", "date").orderBy("rowid")) == [(0, "2026-01-01"), (1, "2026-01-01"), (2, "2026-01-01"), (3, "2026-01-02"), (4, "2026-01-02")]
    assert "rowid" not in lake.scan("t").columns
    # A time within a day keeps that day.
    assert lake.scan("t", where="ts >= TIMESTAMP '2026-01-02 09:00:00'").count() == 2
    assert rows(lake.scan("t", columns=["ts"]).distinct().orderBy("ts"))[0] == (dt.datetime(2026, 1, 1, 10),)


@pytest.mark.parametrize(
    ("change", "message"),
    [
        (lambda b: shutil.rmtree(b / "index"), "mandatory group 'index'"),
        (lambda b: put(b, "single", "month=2026-07", "0000-0000000001.parquet", [("x", pa.int64(), [1])]), "two-level path"),
        (lambda b: (b / "index/month=2026-07/0000-0000002000.parquet").rename(b / "index/month=2026-07/part-000001.parquet"), "self-describing"),
        (lambda b: (b / "index/month=2026-08/0000-0000002000.parquet").unlink(), "consecutive from 0000"),
        (lambda b: (b / "factor/alpha101/month=2026-08/0002-0000002000.parquet").rename(b / "factor/alpha101/month=2026-08/0003-0000003000.parquet"), "must agree"),
        (lambda b: shutil.rmtree(b / "index/month=2026-07"), "index group does not have"),
        (lambda b: put(b, "index", "month=2026-08", "0001-0000002000.parquet", [("symbol", pa.string(), ["a"] * 2000), ("close", pa.float64(), [1.0] * 2000)]), "second column must be DATE"),
        (lambda b: put(b, "index", "year=2026", "0000-0000000001.parquet", [("x", pa.int64(), [1])]), "inconsistent"),
    ],
)
def test_broken_layouts(spark, tmp_path, change, message):
    change(main_lake(tmp_path))
    with pytest.raises(LayoutError, match=message):
        Lake(spark, str(tmp_path)).scan("main")


def test_no_root_and_no_table(spark, tmp_path):
    with pytest.raises(LayoutError, match="no data root configured"):
        Lake(spark)
    with pytest.raises(LayoutError, match="does not exist"):
        Lake(spark, str(tmp_path)).scan("nothing")
