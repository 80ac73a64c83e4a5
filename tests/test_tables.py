import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from strandlake import Lake, LayoutError
from strandlake.operators.lock import LOCK, write_lock
from strandlake.plans.layout import discover, partition_period

from .conftest import put


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, str(tmp_path), today=lambda: dt.date(2026, 8, 15))


def sql(lake, text):
    return lake.spark.sql(text)


def one(lake, name, columns, **how):
    return [tuple(r) for r in lake.scan(name, columns=columns, **how).collect()]


def test_create_write_extend_drop(lake):
    assert lake.create("t", "index", "symbol VARCHAR, date DATE, close DOUBLE")[:2] == (2, 1)
    assert lake.scan("t").count() == 0
    assert lake.write(sql(lake, "SELECT '000001' symbol, DATE '2026-01-15' date, 10.5D close"), "t") == 1
    assert lake.create("t", "factor/alpha", "alpha001 DOUBLE, alpha002 DOUBLE")[:2] == (2, 2)
    assert one(lake, "t", ["alpha001", "alpha002"], where="symbol = '000001'") == [(None, None)]
    lake.write(sql(lake, "SELECT '000001' symbol, DATE '2026-01-15' date, 0.3D alpha001, 0.5D alpha002"), "t", "factor/alpha", merge=True)
    assert one(lake, "t", ["close", "alpha001", "factor.alpha.alpha002"]) == [(10.5, 0.3, 0.5)]
    assert [tuple(r) for r in lake.groups("t").collect()] == [("index", "symbol;date;close", 2), ("factor/alpha", "alpha001;alpha002", 2)]
    assert lake.drop("t", "factor/alpha")[:2] == (2, 2)
    with pytest.raises(ValueError, match="not found"):
        lake.scan("t", columns=["alpha001"])
    with pytest.raises(LayoutError, match="unknown group"):
        lake.drop("t", "factor/alpha")
    assert lake.drop("t", "index")[:2] == (3, 2)
    with pytest.raises(LayoutError, match="does not exist"):
        lake.scan("t")


def test_groups_and_partitions(lake):
    lake.create_table("t", "symbol VARCHAR, date DATE, close DOUBLE, volume BIGINT, alpha001 DOUBLE", groups="index:close;factor/alpha:alpha001")
    assert {g.name: g.schema.names for g in lake.plan("t").groups} == {"index": ["symbol", "date", "close", "volume"], "factor/alpha": ["alpha001"]}
    lake.create_partition("t", "month=2026-10")
    with pytest.raises(LayoutError, match="already exists"):
        lake.create_partition("t", "month=2026-10")
    with pytest.raises(LayoutError, match="invalid date"):
        lake.create_partition("t", "month=2026-13")
    assert lake.scan("t", where="date >= DATE '2026-10-01'").count() == 0
    lake.create("t", "empty/group")
    assert "empty/group" not in [r[0] for r in lake.groups("t").collect()]
    for text, columns, groups in (("at least 2", "symbol VARCHAR", None), ("first two columns", "a DOUBLE, b DATE", None), ("unknown column", "s VARCHAR, d DATE", "x/y:z")):
        with pytest.raises(LayoutError, match=text):
            lake.create_table("u", columns, groups=groups)
    with pytest.raises(LayoutError, match="already exists"):
        lake.create_table("t", "symbol VARCHAR, date DATE")
    with pytest.raises(LayoutError, match="non-index"):
        from strandlake.operators.manage import create_group

        create_group(lake.root, "t", "index", "x DOUBLE")
    with pytest.raises(ValueError, match="TIME"):
        lake.create_table("v", "s VARCHAR, d DATE, t TIME")


def test_meta(lake):
    lake.create("dt", "index", "symbol VARCHAR, date DATE, close DOUBLE")
    lake.create("dt", "factor/alpha", "close DOUBLE, vwap DOUBLE, alpha001 DOUBLE")
    lake.create("dt", "panel/ma", "close DOUBLE, vwap DOUBLE, ma5 DOUBLE")
    lake.write(sql(lake, "SELECT '000001' symbol, DATE '2026-01-15' date, 10.5D close"), "dt")
    m = lake.meta("dt").first()
    assert m.schema == "symbol:VARCHAR,date:DATE,close:DOUBLE,factor.alpha.vwap:DOUBLE,alpha001:DOUBLE,panel.ma.vwap:DOUBLE,ma5:DOUBLE"
    assert m.column_mapping == "factor.alpha.vwap:factor.alpha.vwap;alpha001:factor.alpha.alpha001;panel.ma.vwap:panel.ma.vwap;ma5:panel.ma.ma5"
    assert (m.total_rows, m.group_count, m.partition_count, m.part_count, m.partition_template) == (1, 3, 2, 4, "month=%Y-%m")
    assert m.partitions == "month=2026-01,month=2026-08" and m.table_path.startswith("/")


def test_overwrite_only_touches_its_partitions(lake):
    lake.create("t", "index", "symbol VARCHAR, date DATE, v BIGINT", partition_template="month=%Y-%m")
    days = "SELECT concat('s', x % 3) symbol, date_add(DATE '2026-01-01', x) date, CAST(x AS BIGINT) v FROM (SELECT explode(sequence(0, 89)) x)"
    assert lake.write(sql(lake, days), "t") == 90
    assert lake.write(sql(lake, "SELECT 'z' symbol, DATE '2026-02-10' date, 7 v"), "t") == 1
    assert lake.scan("t").count() == 90 - 28 + 1
    assert lake.write(sql(lake, days).where("v < 0"), "t") == 0
    got = [tuple(r) for r in lake.scan("t", columns=["symbol", "date", "rowid"], where="month = '2026-01'").orderBy("rowid").collect()]
    assert [r[:2] for r in got] == sorted(r[:2] for r in got) and [r[2] for r in got] == list(range(31))
    with pytest.raises(PySparkException, match="NULL in partition column"):
        lake.write(sql(lake, "SELECT 'z' symbol, CAST(NULL AS DATE) date, 7 v"), "t")
    with pytest.raises(LayoutError, match="lacks"):
        lake.write(sql(lake, "SELECT 'z' symbol, DATE '2026-02-10' date"), "t")
    assert not list(__import__("pathlib").Path(lake.root, "t").glob("_tmp"))


def test_merge(lake):
    lake.create("t", "index", "symbol VARCHAR, date DATE, v DOUBLE, extra BIGINT")
    lake.write(sql(lake, "SELECT * FROM VALUES ('a', DATE '2026-01-01', 1D, 1), ('b', DATE '2026-01-02', 2D, 2), ('c', DATE '2026-02-01', 3D, 3) t(symbol, date, v, extra)"), "t")
    lake.write(sql(lake, "SELECT * FROM VALUES ('b', DATE '2026-01-02', 20D, 5), ('d', DATE '2026-01-03', 4D, 6), ('b', DATE '2026-01-02', 21D, 7) t(symbol, date, v, extra)").coalesce(1), "t", merge=True)
    assert sorted(one(lake, "t", ["symbol", "v", "extra"])) == [("a", 1.0, 1), ("b", 21.0, 7), ("c", 3.0, 3), ("d", 4.0, 6)]


def test_group_is_aligned_by_key(lake):
    lake.create("t", "index", "sym VARCHAR, ts TIMESTAMP, v BIGINT", partition_template="date")
    base = "SELECT lpad(CAST(x AS STRING), 4, '0') sym, TIMESTAMP_NTZ '2026-03-01 00:00:00' + make_interval(0, 0, 0, x % 4, x) ts, CAST(x AS BIGINT) v FROM (SELECT explode(sequence(0, 199)) x)"
    lake.write(sql(lake, base), "t")
    some = sql(lake, base).where("v % 3 = 0").select("sym", "ts", (F.col("v") * 2).alias("twice"), F.lit("x").alias("note")).orderBy(F.rand(3))
    lake.write(some, "t", "a/b")  # a new group, its columns from the input
    for strategy in ("zip", "join"):
        got = lake.scan("t", columns=["v", "twice", "note"], strategy=strategy)
        assert got.count() == 200
        assert got.where("(v % 3 = 0 AND twice <=> 2 * v AND note = 'x') OR (v % 3 <> 0 AND twice IS NULL)").count() == 200
    # A merge fills what it names and keeps the rest.
    lake.write(sql(lake, base).where("v IN (1, 3)").select("sym", "ts", F.lit(-1).alias("twice"), F.lit("y").alias("note")), "t", "a/b", merge=True)
    got = {r.v: r.twice for r in lake.scan("t", columns=["v", "twice"]).collect()}
    assert (got[1], got[3], got[6], got[2]) == (-1, -1, 12, None)
    with pytest.raises(PySparkException, match="index group does not have"):
        lake.write(sql(lake, base).limit(1).select(F.lit("nobody").alias("sym"), "ts", F.lit(1).alias("twice"), F.lit("y").alias("note")), "t", "a/b")
    with pytest.raises(LayoutError, match="index group does not have"):
        lake.write(sql(lake, "SELECT 'a' sym, TIMESTAMP_NTZ '2027-01-01 00:00:00' ts, 1 twice, 'y' note"), "t", "a/b")
    with pytest.raises(LayoutError, match="no columns"):
        lake.write(sql(lake, base).select("sym", "ts"), "t", "c/d")


def test_merge_into_a_group_with_repeated_keys_and_padding(lake):
    root = lake.root
    day = dt.date(2026, 7, 1)
    import pathlib

    base = pathlib.Path(root, "t")
    put(base, "index", "month=2026-07", "0000-0000000007.parquet", [("symbol", pa.string(), ["a", "b", "b", None, "c", "d", "e"]), ("date", pa.date32(), [day] * 7)])
    put(base, "x/y", "month=2026-07", "0000-0000000005.parquet", [("v", pa.int64(), [1, 2, 3, 4, None])])
    put(base, "x/y", "month=2026-08", "0000-0000000001.parquet", [("v", pa.int64(), [9])])
    put(base, "index", "month=2026-08", "0000-0000000001.parquet", [("symbol", pa.string(), ["a"]), ("date", pa.date32(), [dt.date(2026, 8, 1)])])
    new = "SELECT * FROM VALUES (CAST(NULL AS STRING), DATE '2026-07-01', 40L), ('d', DATE '2026-07-01', 60L), ('a', DATE '2026-07-01', 10L), ('a', DATE '2026-07-01', NULL) t(symbol, date, v)"
    assert lake.write(sql(lake, new).coalesce(1), "t", "x/y", merge=True) == 7
    # The last row of a key stays, on its first index row; a NULL that is new replaces, and a partition that isn't named stays.
    assert one(lake, "t", ["v"]) == [(x,) for x in (None, 3, None, 40, None, 60, None, 9)]
    twice = "SELECT * FROM VALUES ('b', DATE '2026-07-01', 5L), ('b', DATE '2026-07-01', 6L), ('e', DATE '2026-07-01', 7L) t(symbol, date, v)"
    assert lake.write(sql(lake, twice).coalesce(1), "t", "x/y") == 7
    assert one(lake, "t", ["v"]) == [(x,) for x in (None, 5, 6, None, None, None, 7, 9)]


def test_rows_placed_on_the_index_are_not_sampled(lake, monkeypatch):
    from strandlake.operators import write as writing

    monkeypatch.setattr(writing, "ROWS_PER_GROUP", 64)  # several tasks for a partition
    lake.create("t", "index", "sym VARCHAR, ts TIMESTAMP, v BIGINT")
    base = "SELECT lpad(CAST(x * 7 % 1000 AS STRING), 4, '0') sym, TIMESTAMP_NTZ '2026-03-01 00:00:00' + make_interval(0, 0, 0, 20 * (x % 5)) ts, CAST(x AS BIGINT) v FROM (SELECT explode(sequence(0, 999)) x)"
    rows = sql(lake, base)
    lake.write(rows, "t")

    def sampled(*_):
        raise AssertionError("the rows' places are known, but were sampled")

    with monkeypatch.context() as m:
        m.setattr(type(rows), "repartitionByRange", sampled)
        lake.write(rows.select("sym", "ts", (F.col("v") * 2).alias("w")), "t", "a/b")
        lake.write(rows.where("v % 3 = 0").select("sym", "ts", F.lit(-1).alias("w")), "t", "a/b", merge=True)
    assert {p.index for p in discover(lake.root, "t").group("a/b").partitions["month=2026-03"]} >= {0, 1, 2}
    assert lake.scan("t", columns=["v", "w"]).where("w <=> IF(v % 3 = 0, -1, 2 * v)").count() == 1000


def test_writer_settings_and_many_parts(lake, monkeypatch):
    lake.create("t", "index", "symbol VARCHAR, date DATE, v BIGINT", partition_template="year")
    lake.write(sql(lake, "SELECT concat('s', lpad(id % 100, 3, '0')) symbol, date_add(DATE '2026-01-01', CAST(id / 100 AS INT) % 365) date, id v FROM range(300000)"), "t")
    parts = lake.plan("t").index.partitions["year=2026"]
    assert sum(p.rows for p in parts) == 300000 and [p.index for p in parts] == list(range(len(parts)))
    for p in parts:
        meta = pq.read_metadata(p.path)
        assert meta.row_group(0).num_rows <= 131072 and meta.row_group(0).column(0).compression == "ZSTD"
    flat = lake.scan("t", columns=["symbol", "rowid"]).orderBy("rowid").collect()
    assert [r[0] for r in flat] == sorted(r[0] for r in flat) and [r[1] for r in flat] == list(range(300000))


class Failing:
    """A store whose n-th move out of a path with some name fails."""

    def __init__(self, store, n, part):
        self.store, self.left, self.part = store, n, part

    def __getattr__(self, name):
        return getattr(self.store, name)

    def move(self, a, b):
        if self.part in a:
            self.left -= 1
            if self.left == 0:
                raise OSError("lost")
        self.store.move(a, b)


@pytest.mark.parametrize("n", [1, 3])
@pytest.mark.parametrize("what", ["write", "merge", "compact"])
def test_failed_swaps_lose_no_rows(lake, monkeypatch, what, n):
    from strandlake.operators import manage
    from strandlake.operators import write as writing

    lake.create("t", "index", "symbol VARCHAR, date DATE, v BIGINT")
    days = "SELECT concat('s', x % 3) symbol, date_add(DATE '2026-01-01', x) date, CAST(x AS BIGINT) v FROM (SELECT explode(sequence(0, 89)) x)"
    lake.write(sql(lake, days), "t")
    if what == "compact":
        for month, rows in (("2026-01", 31), ("2026-02", 28), ("2026-03", 31)):
            put(__import__("pathlib").Path(lake.root) / "t", "index", f"month={month}", "0001-0000000001.parquet", [("symbol", pa.string(), ["z"]), ("date", pa.date32(), [dt.date.fromisoformat(f"{month}-20")]), ("v", pa.int64(), [1])])
    before = sorted(map(str, lake.scan("t").collect()))
    module = manage if what == "compact" else writing
    real = module.swap
    monkeypatch.setattr(module, "swap", lambda store, *args: real(Failing(store, n, "/_ready/"), *args))
    with pytest.raises(OSError, match="lost"):
        lake.compact("t") if what == "compact" else lake.write(sql(lake, days).withColumn("v", F.col("v") + 1), "t", merge=what == "merge")
    monkeypatch.undo()
    assert sorted(map(str, lake.scan("t").collect())) == before
    assert not list(__import__("pathlib").Path(lake.root, "t").glob("_tmp"))


def test_next_writer_recovers_a_lost_one(lake):
    lake.create("t", "index", "symbol VARCHAR, date DATE, v BIGINT")
    lake.write(sql(lake, "SELECT * FROM VALUES ('a', DATE '2026-01-01', 1L), ('b', DATE '2026-02-01', 2L) t(symbol, date, v)"), "t")
    root = __import__("pathlib").Path(lake.root, "t")
    # As a driver leaves it that dies between the two moves of a partition.
    (root / "_tmp/transaction-7/_old/index").mkdir(parents=True)
    (root / "index/month=2026-01").rename(root / "_tmp/transaction-7/_old/index/month=2026-01")
    assert lake.scan("t").count() == 1
    lake.write(sql(lake, "SELECT 'c' symbol, DATE '2026-03-01' date, 3L v"), "t")
    assert sorted(one(lake, "t", ["symbol", "v"])) == [("a", 1), ("b", 2), ("c", 3)] and not (root / "_tmp").exists()


def test_rows_are_accounted_for(lake, monkeypatch):
    from strandlake.operators import write as writing

    lake.create("t", "index", "symbol VARCHAR, date DATE, v BIGINT")
    rows = "SELECT * FROM VALUES ('a', DATE '2026-01-01', 1L), ('b', DATE '2026-02-01', 2L) t(symbol, date, v)"
    lake.write(sql(lake, rows), "t")
    # Files that don't hold what was sorted stop the write; the table stays as it was.
    monkeypatch.setattr(writing, "_commit", lambda spark, store, root, folder, stage, group, received, own=writing._commit: own(spark, store, root, folder, stage, group, received + 1))
    with pytest.raises(LayoutError, match="rows were received"):
        lake.write(sql(lake, rows).withColumn("v", F.col("v") * 10), "t")
    monkeypatch.undo()
    assert sorted(one(lake, "t", ["symbol", "v"])) == [("a", 1), ("b", 2)]
    # An input that differs each time it is computed is written as it was seen once.
    random = lake.spark.range(300).selectExpr("CAST(rand() AS STRING) symbol", "date_add(DATE '2026-01-01', CAST(rand() * 80 AS INT)) date", "id v")
    assert lake.write(random, "t") == 300 and sorted(r[0] for r in one(lake, "t", ["v"])) == list(range(300))


def test_keys_of_instants_are_refused(lake):
    from pyspark.sql.types import StructType

    with pytest.raises(LayoutError, match="without time zone"):
        lake.create_table("t", StructType.fromDDL("symbol string, at timestamp, v long"))


def test_compact(lake):
    base = lambda g, n, rows: put(__import__("pathlib").Path(lake.root) / "c", g, "month=2026-07", f"{n:04d}-{len(rows):010d}.parquet", ([("symbol", pa.string(), [f"{r:05d}" for r in rows]), ("date", pa.date32(), [dt.date(2026, 7, 1)] * len(rows)), ("v", pa.int64(), list(rows))] if g == "index" else [("alpha001", pa.float64(), [r * 1.0 if r % 5 == 0 else None for r in rows])]))
    for g in ("index", "factor/alpha"):
        base(g, 0, range(2000))
        base(g, 1, range(2000, 4000))
    before = lake.scan("c", columns=["v", "alpha001"]).agg(F.count("*"), F.count("alpha001"), F.sum("v")).first()
    assert lake.compact("c") == (2, 4, 2)
    assert lake.compact("c", "factor/alpha") == (0, 2, 2)
    assert tuple(lake.scan("c", columns=["v", "alpha001"]).agg(F.count("*"), F.count("alpha001"), F.sum("v")).first()) == tuple(before) == (4000, 800, 7998000)
    assert lake.scan("c", columns=["v", "rowid"]).where("v <> rowid").count() == 0
    with pytest.raises(LayoutError, match="unknown group"):
        lake.compact("c", "no/such")


def test_compact_absorbs_empty_parts(lake):
    lake.create("e", "index", "symbol VARCHAR, date DATE, v DOUBLE")
    root = __import__("pathlib").Path(lake.root) / "e"
    cols = lambda a, n: [("symbol", pa.string(), [str(i) for i in range(n)]), ("date", pa.date32(), [dt.date(2026, 1, 1)] * n), ("v", pa.float64(), [float(a + i) for i in range(n)])]
    put(root, "index", "month=2026-01", "0000-0000000030.parquet", cols(0, 30))
    put(root, "index", "month=2026-01", "0001-0000000000.parquet", [("symbol", pa.string(), [])])
    put(root, "index", "month=2026-01", "0002-0000000050.parquet", cols(30, 50))
    assert lake.compact("e") == (1, 4, 2)
    assert tuple(lake.scan("e").agg(F.count("*"), F.min("v"), F.max("v")).first()) == (80, 0.0, 79.0)


def test_lock(lake):
    lake.create("t", "index", "symbol VARCHAR, date DATE")
    with write_lock(lake.root, "t"):
        with pytest.raises(LayoutError, match="another write is in progress"):
            lake.compact("t")
    assert not (__import__("pathlib").Path(lake.root) / "t" / LOCK).exists()


def test_catalog(lake):
    lake.create("t1", "index", "sym VARCHAR, date DATE, close DOUBLE")
    lake.write(sql(lake, "SELECT * FROM VALUES ('a', DATE '2026-01-01', 1D), ('b', DATE '2026-02-01', 2D) t(sym, date, close)"), "t1")
    lake.write(sql(lake, "SELECT 'a' sym, DATE '2026-01-01' date, 5D alpha"), "t1", "x/y")
    al = lake.attach("al")
    assert [r.table_name for r in al.tables().collect()] == ["t1"]
    assert al.table("t1").columns == ["sym", "date", "close", "alpha"]
    assert [tuple(r) for r in al.sql("SELECT sym, close FROM al.t1 WHERE date >= DATE '2026-02-01'").collect()] == [("b", 2.0)]
    assert [tuple(r) for r in al.sql("SELECT count(*) n FROM al.t1").collect()] == [(2,)]
    assert [tuple(r) for r in al.sql("SELECT * FROM al.t1 ORDER BY sym").collect()] == [("a", dt.date(2026, 1, 1), 1.0, 5.0), ("b", dt.date(2026, 2, 1), 2.0, None)]
    assert [tuple(r) for r in al.sql("SELECT rowid, month, alpha FROM al.t1 ORDER BY rowid").collect()] == [(0, "2026-01", 5.0), (1, "2026-02", None)]
    assert "x/y" not in al.sql("SELECT sum(close) FROM al.t1")._jdf.queryExecution().toString()
    assert al.sql("SELECT a.sym FROM al.t1 a JOIN al.t1 b ON a.sym = b.sym AND b.alpha = 5").count() == 1
    # Computed columns and a table named twice still prune; a command is refused before it runs.
    for text in ("SELECT sum(close * 2) s FROM al.t1", "SELECT sum(close) s FROM al.t1 WHERE month BETWEEN '2026-01' AND '2026-01' UNION ALL SELECT max(close) FROM al.t1 WHERE month = '2026-01'"):
        files = al.sql(text).inputFiles()
        assert files and not any("x/y" in f for f in files)
    assert len(files) <= 2 and all("month=2026-01" in f for f in files)
    assert [tuple(r) for r in al.sql("SELECT sym, (SELECT max(alpha) FROM al.t1 WHERE sym = 'a') m FROM al.t1 WHERE sym IN (SELECT sym FROM al.t1 WHERE close > 1)").collect()] == [("b", 5.0)]
    for text in ("CREATE TABLE copied AS SELECT sym FROM al.t1", "INSERT INTO al.t1 SELECT 'c', DATE '2026-01-01', 3D, 1D", "WITH a AS (SELECT 1) INSERT INTO al.t1 SELECT * FROM a", "DELETE FROM al.t1", "DROP TABLE al.t1"):
        with pytest.raises(NotImplementedError):
            al.sql(text)
    assert not lake.spark.catalog.tableExists("copied")
    assert [r.col_name for r in al.sql("DESCRIBE al.t1").collect()] == ["sym", "date", "close", "alpha"]
    lake.create("t2", "index", "s VARCHAR, d DATE")  # later than the first look
    assert al.table("t2").count() == 0
    al.create_table("t2", "s VARCHAR, d DATE", partition="month=2027-01")
    al.create_table("t2", "s VARCHAR, d DATE, z DOUBLE", groups="g/h:z")
    assert al.table("t2").columns == ["s", "d", "z"]
    with pytest.raises(NotImplementedError):
        al.insert()
    al.detach()


def test_periods():
    assert partition_period("month=2024-02") == (dt.date(2024, 2, 1), dt.date(2024, 3, 1))
    assert partition_period("year=2024")[1] == dt.date(2025, 1, 1)
    with pytest.raises(LayoutError, match="invalid date"):
        partition_period("date=2026-02-30")


def test_stream_merges(lake, tmp_path):
    from strandlake.streaming.upsert import merge_stream

    lake.create("t", "index", "symbol VARCHAR, date DATE, v BIGINT")
    source = str(tmp_path / "in")
    sql(lake, "SELECT 'a' symbol, DATE '2026-01-01' date, 1L v").write.parquet(source)
    run = lambda: merge_stream(lake.spark.readStream.schema("symbol string, date date, v long").parquet(source), lake.root, "t", checkpoint=str(tmp_path / "ck")).awaitTermination()
    run()
    sql(lake, "SELECT * FROM VALUES ('a', DATE '2026-01-01', 2L), ('b', DATE '2026-01-02', 3L) t(symbol, date, v)").write.mode("append").parquet(source)
    run()
    assert sorted(one(lake, "t", ["symbol", "v"])) == [("a", 2), ("b", 3)]
    assert discover(lake.root, "t").rows == 2
