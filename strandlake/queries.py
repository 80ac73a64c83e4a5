"""Registered queries of the library: lakes built from the given tables, one query for each capability, and the same in SQL."""

from __future__ import annotations

import datetime as dt
import re
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lake import ROOT_SETTING, Lake

TODAY = dt.date(2026, 8, 15)
_built: dict[tuple, Lake] = {}


def _lake(spark: SparkSession, sf_dir: str, kind: str, build: Callable[[Lake, str], None]) -> Lake:
    """A lake of its own for each kind and input, built once in a session."""
    at = (spark.sparkContext.applicationId, kind, sf_dir)
    if at not in _built:
        base = spark.conf.get(ROOT_SETTING, None) or spark.conf.get("spark.checkpoint.dir", None)
        if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {ROOT_SETTING} or spark.checkpoint.dir to a folder that all machines share")
        root = f"{base.rstrip('/')}/lakes-{abs(hash(at)):x}" if base else tempfile.mkdtemp(prefix="strandlake-")
        lake = Lake(spark, root, today=lambda: TODAY)
        build(lake, sf_dir)
        _built[at] = lake
    return _built[at]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.lpad(F.col("o_orderkey").cast("string"), 12, "0").alias("sym"), F.col("o_orderdate").alias("date"), "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("sym"), F.col("ts").alias("date"), "user_id", "value", "event_type", "props")


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return i.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("sym"), F.col("l_shipdate").alias("date"), "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")


def _build_ord(lake: Lake, sf_dir: str) -> None:
    o = _orders(lake.spark, sf_dir)
    lake.create("ord", "index", "sym VARCHAR, date TIMESTAMP, o_custkey BIGINT")
    lake.write(o.select("sym", "date", "o_custkey"), "ord")
    lake.write(o.select("sym", "date", "o_totalprice"), "ord", "price/base", align="position")
    lake.write(o.select("sym", "date", "o_orderstatus", "o_orderpriority"), "ord", "tag/status", align="position")


def _build_ev(lake: Lake, sf_dir: str) -> None:
    e = _events(lake.spark, sf_dir)
    lake.create("ev", "index", "sym VARCHAR, date TIMESTAMP, user_id BIGINT", partition_template="date")
    lake.write(e.select("sym", "date", "user_id"), "ev")
    lake.write(e.select("sym", "date", "value"), "ev", "val/num", align="position")
    lake.write(e.select("sym", "date", "event_type", "props"), "ev", "attr/txt", align="position")


def _build_li(lake: Lake, sf_dir: str) -> None:
    i = _items(lake.spark, sf_dir)
    lake.create("li", "index", "sym VARCHAR, date TIMESTAMP", partition_template="year")
    lake.write(i.select("sym", "date"), "li")
    lake.write(i.select("sym", "date", "l_quantity", "l_extendedprice", "l_discount"), "li", "price/base", align="position")
    lake.write(i.select("sym", "date", "l_returnflag", "l_linestatus"), "li", "flag/status", align="position")


def _ord(spark, sf_dir) -> Lake:
    return _lake(spark, sf_dir, "ord", _build_ord)


def _ev(spark, sf_dir) -> Lake:
    return _lake(spark, sf_dir, "ev", _build_ev)


def _li(spark, sf_dir) -> Lake:
    return _lake(spark, sf_dir, "li", _build_li)


_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
#: Common parts of the SQL.
_O = "SELECT lpad(CAST(o_orderkey AS VARCHAR), 12, '0') AS sym, o_orderdate AS date, o_custkey, o_totalprice, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m') AS month FROM orders"
_E = "SELECT lpad(CAST(event_id AS VARCHAR), 12, '0') AS sym, ts AS date, user_id, value, event_type, props, strftime(ts, '%Y-%m-%d') AS day FROM events"


def query(sql: str | None):
    def register(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return register


ALL = ["sym", "date", "o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority"]


@query(f"SELECT * EXCLUDE (month) FROM ({_O})")
def scan_all_groups(spark, sf_dir):
    return _ord(spark, sf_dir).scan("ord", columns=ALL)


@query(f"SELECT * EXCLUDE (month) FROM ({_O})")
def scan_by_row_join(spark, sf_dir):
    return _ord(spark, sf_dir).scan("ord", columns=ALL, strategy="join")


@query(f"SELECT sym, date, o_custkey, o_totalprice, o_totalprice AS \"price.base.o_totalprice\", month FROM ({_O})")
def scan_group_filter(spark, sf_dir):
    return _ord(spark, sf_dir).scan("ord", "PRICE/base, no/such")


@query(f"SELECT o_orderstatus, o_orderpriority FROM ({_O})")
def scan_single_group(spark, sf_dir):
    return _ord(spark, sf_dir).scan("ord", columns=["o_orderstatus", "o_orderpriority"], strategy="single")


@query(f"SELECT o_totalprice, o_totalprice AS \"price.base.o_totalprice\" FROM ({_O})")
def scan_qualified_names(spark, sf_dir):
    return _ord(spark, sf_dir).scan("ord", columns=["o_totalprice", "price.base.o_totalprice"])


@query(f"SELECT o_orderstatus AS \"tag.status.o_orderstatus\", o_orderpriority AS \"tag.status.o_orderpriority\" FROM ({_O})")
def scan_column_regex(spark, sf_dir):
    df = _ord(spark, sf_dir).scan("ord")
    return df.select(df.colRegex("`tag.status.*`"))


@query(f"SELECT sym, month, row_number() OVER (ORDER BY month, sym, date) - 1 AS rowid FROM ({_O})")
def scan_rowid_and_partition(spark, sf_dir):
    return _ord(spark, sf_dir).scan("ord", columns=["sym", "month", "rowid"])


@query(f"SELECT month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM ({_O}) GROUP BY month")
def group_by_partition_column(spark, sf_dir):
    return _ord(spark, sf_dir).scan("ord", columns=["month", "o_totalprice"]).groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT count(*) AS n FROM orders")
def count_rows(spark, sf_dir):
    return _ord(spark, sf_dir).scan("ord", columns=["sym"]).agg(F.count("*").alias("n"))


@query(f"SELECT sym, o_orderpriority FROM ({_O}) WHERE date >= TIMESTAMP '1995-03-01' AND date < TIMESTAMP '1995-05-15' AND o_totalprice > 100000")
def prune_date_range(spark, sf_dir):
    return _ord(spark, sf_dir).scan("ord", columns=["sym", "o_orderpriority"], where="date >= TIMESTAMP_NTZ '1995-03-01' AND date < TIMESTAMP_NTZ '1995-05-15' AND o_totalprice > 100000")


@query(f"SELECT sym, o_totalprice FROM ({_O}) WHERE month <= '1995-06' AND month <> '1995-02'")
def prune_partition_column(spark, sf_dir):
    return _ord(spark, sf_dir).scan("ord", columns=["sym", "o_totalprice"], where=[("month", "<=", "1995-06"), ("month", "<>", "1995-02")])


@query(f"SELECT sym, value, event_type FROM ({_E}) WHERE date >= TIMESTAMP '2024-01-10 12:00:00' AND date < TIMESTAMP '2024-01-11 12:00:00'")
def prune_timestamp(spark, sf_dir):
    return _ev(spark, sf_dir).scan("ev", columns=["sym", "value", "event_type"], where="date >= TIMESTAMP_NTZ '2024-01-10 12:00:00' AND date < TIMESTAMP_NTZ '2024-01-11 12:00:00'")


@query(f"SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, count(DISTINCT user_id) AS users FROM ({_E}) GROUP BY event_type")
def aggregate_over_three_groups(spark, sf_dir):
    return _ev(spark, sf_dir).scan("ev", columns=["event_type", "value", "user_id"]).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.count_distinct("user_id").alias("users"))


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def pricing_summary(spark, sf_dir):
    df = _li(spark, sf_dir).scan("li", columns=["l_returnflag", "l_linestatus", "l_quantity", "l_extendedprice", "l_discount"], where="date <= TIMESTAMP_NTZ '1998-09-02'")
    return df.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"), F.count("*").alias("n"))


@query(f"SELECT a.sym, a.date, b.o_totalprice FROM ({_O}) a JOIN ({_O}) b USING (sym) WHERE b.o_totalprice > 300000")
def join_on_rowid(spark, sf_dir):
    lake = _ord(spark, sf_dir)
    a, b = lake.scan("ord", columns=["rowid", "sym", "date"]), lake.scan("ord", columns=["rowid", "o_totalprice"], where="o_totalprice > 300000")
    return a.join(b, "rowid").drop("rowid")


def _build_some(lake: Lake, sf_dir: str) -> None:
    """A group for some months only, and one whose later months have a column more."""
    o = _orders(lake.spark, sf_dir)
    lake.create("some", "index", "sym VARCHAR, date TIMESTAMP")
    lake.write(o.select("sym", "date"), "some")
    early = F.col("date") < F.lit("1998-01-01").cast("timestamp_ntz")
    lake.write(o.where(early).select("sym", "date", F.col("o_totalprice").alias("early_price")), "some", "price/early")
    lake.write(o.where(early).select("sym", "date", "o_custkey"), "some", "cust/keys")
    part = o.where(~early).select("sym", "date", "o_custkey", "o_orderstatus")
    # The newer months are written with a wider schema, by position.
    from .operators.write import write_wider

    write_wider(part, lake.root, "some", "cust/keys")


@query(f"SELECT sym, CASE WHEN date < TIMESTAMP '1998-01-01' THEN o_totalprice END AS early_price FROM ({_O})")
def null_fill_missing_partitions(spark, sf_dir):
    return _lake(spark, sf_dir, "some", _build_some).scan("some", columns=["sym", "early_price"])


@query(f"SELECT sym, o_custkey, CASE WHEN date >= TIMESTAMP '1998-01-01' THEN o_orderstatus END AS o_orderstatus FROM ({_O})")
def null_fill_newer_columns(spark, sf_dir):
    return _lake(spark, sf_dir, "some", _build_some).scan("some", columns=["sym", "o_custkey", "o_orderstatus"])


def _build_merged(lake: Lake, sf_dir: str) -> None:
    o = _orders(lake.spark, sf_dir).select("sym", "date", "o_totalprice", "o_orderstatus")
    lake.create("m", "index", "sym VARCHAR, date TIMESTAMP, o_totalprice DOUBLE, o_orderstatus VARCHAR")
    lake.write(o.where("o_orderstatus <> 'P'"), "m")
    lake.write(o.where("o_orderstatus IN ('P', 'F')").withColumn("o_totalprice", F.col("o_totalprice") + 1), "m", merge=True)


@query(f"SELECT sym, date, CASE WHEN o_orderstatus IN ('P', 'F') THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM ({_O})")
def merge_upsert(spark, sf_dir):
    return _lake(spark, sf_dir, "merged", _build_merged).scan("m", columns=["sym", "date", "o_totalprice", "o_orderstatus"])


def _build_replaced(lake: Lake, sf_dir: str) -> None:
    o = _orders(lake.spark, sf_dir).select("sym", "date", "o_totalprice")
    lake.create("r", "index", "sym VARCHAR, date TIMESTAMP, o_totalprice DOUBLE")
    lake.write(o, "r")
    lake.write(o.where("date_format(date, 'yyyy-MM') = '1996-02' AND o_totalprice > 50000"), "r")
    lake.create("r", "x/y", "extra DOUBLE, note VARCHAR")
    lake.create_partition("r", "month=2030-01")
    lake.compact("r")


@query(f"SELECT sym, date, o_totalprice, CAST(NULL AS DOUBLE) AS extra, CAST(NULL AS VARCHAR) AS note FROM ({_O}) WHERE month <> '1996-02' OR o_totalprice > 50000")
def overwrite_extend_and_compact(spark, sf_dir):
    return _lake(spark, sf_dir, "replaced", _build_replaced).scan("r", columns=["sym", "date", "o_totalprice", "extra", "note"])


@query(f"SELECT * FROM (SELECT 'index' AS group_name, 'sym;date;o_custkey' AS columns, count(DISTINCT month) + 1 AS partition_count FROM ({_O}) UNION ALL SELECT 'price/base', 'o_totalprice', count(DISTINCT month) FROM ({_O}) UNION ALL SELECT 'tag/status', 'o_orderstatus;o_orderpriority', count(DISTINCT month) FROM ({_O}))")
def table_groups(spark, sf_dir):
    return _ord(spark, sf_dir).groups("ord")


@query(f"SELECT 'ord' AS table_name, 'month=%Y-%m' AS partition_template, count(*) AS total_rows, 3 AS group_count, count(DISTINCT month) + 1 AS partition_count, 'sym:VARCHAR,date:TIMESTAMP,o_custkey:BIGINT,o_totalprice:DOUBLE,o_orderstatus:VARCHAR,o_orderpriority:VARCHAR' AS schema, 'o_totalprice:price.base.o_totalprice;o_orderstatus:tag.status.o_orderstatus;o_orderpriority:tag.status.o_orderpriority' AS column_mapping FROM ({_O})")
def table_meta(spark, sf_dir):
    return _ord(spark, sf_dir).meta("ord").select("table_name", "partition_template", "total_rows", "group_count", "partition_count", "schema", "column_mapping")


@query("SELECT 'al' AS table_catalog, 'main' AS table_schema, 'ord' AS table_name, 'BASE TABLE' AS table_type")
def catalog_tables(spark, sf_dir):
    return _ord(spark, sf_dir).attach("al").tables()


@query(f"WITH t AS ({_O}), best AS (SELECT o_custkey, max(o_totalprice) AS most, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_f FROM t WHERE date >= TIMESTAMP '1996-01-01' GROUP BY 1) SELECT * FROM best ORDER BY most DESC, o_custkey LIMIT 50")
def catalog_sql_topk(spark, sf_dir):
    al = _ord(spark, sf_dir).attach("al")
    return al.sql("WITH best AS (SELECT o_custkey, max(o_totalprice) AS most, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS n_f FROM al.ord WHERE date >= TIMESTAMP_NTZ '1996-01-01' GROUP BY 1) SELECT * FROM best ORDER BY most DESC, o_custkey LIMIT 50")


@query(f"SELECT 'first' AS half, count(*) AS n FROM ({_O}) WHERE month < '1997-01' UNION ALL SELECT 'second', count(*) FROM ({_O}) WHERE month BETWEEN '1997-01' AND '1999-01'")
def catalog_sql_union(spark, sf_dir):
    al = _ord(spark, sf_dir).attach("al")
    return al.sql("SELECT 'first' AS half, count(*) AS n FROM al.ord WHERE month < '1997-01' UNION ALL SELECT 'second', count(*) FROM al.ord WHERE month BETWEEN '1997-01' AND '1999-01'")


@query(f"SELECT split_part(o_orderpriority, '-', 2) AS word, replace(o_orderstatus, 'F', 'x') AS status, dayofweek(date) AS dow, count(*) AS n FROM ({_O}) WHERE o_orderstatus IS NOT NULL GROUP BY ALL")
def scalar_functions(spark, sf_dir):
    al = _ord(spark, sf_dir).attach("al")
    return al.sql("SELECT split_part(o_orderpriority, '-', 2) AS word, replace(o_orderstatus, 'F', 'x') AS status, dayofweek(date) - 1 AS dow, count(*) AS n FROM al.ord WHERE o_orderstatus IS NOT NULL GROUP BY 1, 2, 3")


# Host operators and functions over catalog tables.


def _sql(spark, sf_dir, text: str) -> DataFrame:
    return _ord(spark, sf_dir).attach("al").sql(text)


@query(f"SELECT a.o_orderstatus AS status, b.o_orderpriority AS priority FROM (SELECT DISTINCT o_orderstatus FROM ({_O})) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM ({_O})) b")
def cross_join(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT a.o_orderstatus AS status, b.o_orderpriority AS priority FROM (SELECT DISTINCT o_orderstatus FROM al.ord) a CROSS JOIN (SELECT DISTINCT o_orderpriority FROM al.ord) b")


@query(f"SELECT sym, date, o_totalprice, o_orderstatus FROM ({_O}) WHERE o_totalprice > 250000 AND o_orderstatus = 'F'")
def three_way_join_on_rowid(spark, sf_dir):
    lake = _ord(spark, sf_dir)
    keys, price = lake.scan("ord", columns=["rowid", "sym", "date"]), lake.scan("ord", columns=["rowid", "o_totalprice"], where="o_totalprice > 250000")
    status = lake.scan("ord", columns=["rowid", "o_orderstatus"], where="o_orderstatus = 'F'")
    return keys.join(price, "rowid").join(status, "rowid").drop("rowid")


@query("SELECT * FROM (VALUES ('sym', 'string'), ('date', 'timestamp_ntz'), ('o_custkey', 'bigint'), ('o_totalprice', 'double'), ('o_orderstatus', 'string'), ('o_orderpriority', 'string')) t(col_name, data_type)")
def describe_table(spark, sf_dir):
    return _sql(spark, sf_dir, "DESCRIBE al.ord").select("col_name", "data_type")


@query(f"SELECT v.name, t.wanted, count(*) AS n FROM ({_O}) o JOIN (VALUES ('F', 'filled'), ('O', 'open')) v(code, name) ON o.o_orderstatus = v.code JOIN (VALUES ('filled', 1), ('open', 2), ('other', 3)) t(name, wanted) ON t.name = v.name GROUP BY ALL")
def values_and_temporary_table(spark, sf_dir):
    spark.createDataFrame([("filled", 1), ("open", 2), ("other", 3)], "name string, wanted int").createOrReplaceTempView("strandlake_wanted")
    return _sql(spark, sf_dir, "SELECT v.name, t.wanted, count(*) AS n FROM al.ord o JOIN (VALUES ('F', 'filled'), ('O', 'open')) v(code, name) ON o.o_orderstatus = v.code JOIN strandlake_wanted t ON t.name = v.name GROUP BY v.name, t.wanted")


@query(f"SELECT month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM ({_O}) GROUP BY month")
def native_partitioned_write(spark, sf_dir):
    """The same rows as plain hive-partitioned Parquet, which Spark writes and reads itself: the baseline of writes."""
    lake = _ord(spark, sf_dir)
    path = f"{lake.root}/.native"
    _orders(spark, sf_dir).select("sym", "date", "o_totalprice", F.date_format("date", "yyyy-MM").alias("month")).write.mode("overwrite").partitionBy("month").parquet(path)
    read = spark.read.schema("sym string, date timestamp_ntz, o_totalprice double, month string").parquet(path)
    return read.groupBy("month").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"SELECT sym, (o_custkey % 7) || '/' || o_orderstatus AS label, printf('%08d-%s', o_custkey, o_orderstatus) AS code, lpad(CAST(o_custkey % 1000 AS VARCHAR), 5, '0') AS padded FROM ({_O})")
def text_functions(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT sym, (o_custkey % 7) || '/' || o_orderstatus AS label, printf('%08d-%s', o_custkey, o_orderstatus) AS code, lpad(CAST(o_custkey % 1000 AS STRING), 5, '0') AS padded FROM al.ord")


@query(f"SELECT sym, CAST(date AS DATE) AS day, CAST(CAST(date AS DATE) + CAST(o_custkey % 5 AS INTEGER) * INTERVAL 1 DAY AS DATE) AS later, CAST(date - INTERVAL 2 MONTH AS DATE) AS earlier, strftime(date, '%Y/%m/%d') AS shown, CAST(CAST(round(o_totalprice) AS BIGINT) AS VARCHAR) AS price FROM ({_O})")
def dates_and_casts(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT sym, CAST(date AS DATE) AS day, CAST(CAST(date AS DATE) + CAST(o_custkey % 5 AS INT) * INTERVAL '1' DAY AS DATE) AS later, CAST(date - INTERVAL '2' MONTH AS DATE) AS earlier, date_format(date, 'yyyy/MM/dd') AS shown, CAST(CAST(round(o_totalprice) AS BIGINT) AS STRING) AS price FROM al.ord")


@query(f"SELECT o_custkey // 100 AS bin, CAST(floor(avg(o_totalprice)) AS BIGINT) AS mean, round(max(o_totalprice), 1) AS most, count(*) AS n, count(*) AS in_range FROM ({_O}) WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")
def numbers_and_membership(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT o_custkey div 100 AS bin, CAST(floor(avg(o_totalprice)) AS BIGINT) AS mean, round(max(o_totalprice), 1) AS most, count(*) AS n, count_if(r BETWEEN 0 AND 1) AS in_range FROM (SELECT *, rand() AS r FROM al.ord) WHERE o_orderstatus IN ('F', 'P') GROUP BY 1")


@query(f"WITH years AS (SELECT CAST(y AS BIGINT) AS y FROM generate_series(1992, 1999) t(y)) SELECT y, part, (SELECT count(*) FROM ({_O}) WHERE year(date) = y) AS n FROM years, unnest(['a', 'b']) u(part)")
def series_and_unnest(spark, sf_dir):
    text = "WITH years AS (SELECT id AS y FROM range(1992, 2000)), by_year AS (SELECT year(date) AS y, count(*) AS n FROM al.ord GROUP BY 1) SELECT years.y, part, coalesce(n, 0) AS n FROM years CROSS JOIN (SELECT explode(array('a', 'b')) AS part) LEFT JOIN by_year ON years.y = by_year.y"
    return _sql(spark, sf_dir, text)


@query(f"SELECT o_orderpriority AS priority, array_to_string(ARRAY(SELECT DISTINCT o_orderstatus FROM ({_O}) ORDER BY 1), ',') AS statuses, count(*) AS n FROM ({_O}) GROUP BY 1")
def array_subquery(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT o_orderpriority AS priority, array_join((SELECT array_sort(collect_set(o_orderstatus)) FROM al.ord), ',') AS statuses, count(*) AS n FROM al.ord GROUP BY 1")


@query("SELECT 'strandlake.data_root' AS name, '/some/lake' AS value")
def setting(spark, sf_dir):
    from .functions.tables import current_setting

    before = spark.conf.get(ROOT_SETTING, None)
    spark.conf.set(ROOT_SETTING, "/some/lake")
    try:
        return spark.range(1).select(F.lit(ROOT_SETTING).alias("name"), current_setting(spark, ROOT_SETTING).alias("value"))
    finally:
        spark.conf.unset(ROOT_SETTING) if before is None else spark.conf.set(ROOT_SETTING, before)


@query(f"SELECT group_name, columns, total_rows FROM (SELECT 'price/base' AS group_name, 'o_totalprice' AS columns UNION ALL SELECT 'tag/status', 'o_orderstatus;o_orderpriority'), (SELECT count(*) AS total_rows FROM ({_O}))")
def table_functions(spark, sf_dir):
    from .functions.tables import register

    lake = _ord(spark, sf_dir)
    register(spark)
    return spark.sql(f"SELECT group_name, columns, total_rows FROM lake_groups('{lake.root}', 'ord') CROSS JOIN lake_meta('{lake.root}', 'ord') WHERE group_name <> 'index'")


# Management, each with what the table is afterwards.


def _build_managed(lake: Lake, sf_dir: str) -> None:
    o = _orders(lake.spark, sf_dir)
    al = lake.attach("al")
    al.create_table("g", "sym VARCHAR, date TIMESTAMP, o_custkey BIGINT, o_totalprice DOUBLE", groups="price/base:o_totalprice", today=lambda: TODAY)
    lake.write(o.select("sym", "date", "o_custkey"), "g")
    lake.write(o.select("sym", "date", "o_totalprice"), "g", "price/base")
    lake.write(o.where("o_orderstatus = 'F'").select("sym", "date", (F.col("o_totalprice") * 2).alias("o_totalprice")), "g", "price/base", merge=True)
    al.create_table("g", "sym VARCHAR, date TIMESTAMP, note VARCHAR, gone BIGINT", groups="note/text:note;note/gone:gone")
    lake.write(o.where("o_custkey % 3 = 0").select("sym", "date", F.col("o_orderpriority").alias("note")), "g", "note/text", merge=True)
    lake.create("g", "empty/group")
    lake.drop("g", "note/gone")


def _managed(spark, sf_dir) -> Lake:
    return _lake(spark, sf_dir, "managed", _build_managed)


@query(f"SELECT sym, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM ({_O})")
def merge_into_group(spark, sf_dir):
    return _managed(spark, sf_dir).scan("g", columns=["sym", "o_totalprice"])


@query(f"SELECT sym, CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority END AS note FROM ({_O})")
def extended_by_ddl(spark, sf_dir):
    return _managed(spark, sf_dir).attach("al").table("g", columns=["sym", "note"])


@query("SELECT * FROM (VALUES ('index', 'sym;date;o_custkey'), ('note/text', 'note'), ('price/base', 'o_totalprice')) t(group_name, columns)")
def groups_after_drop_and_empty_group(spark, sf_dir):
    return _managed(spark, sf_dir).groups("g").select("group_name", "columns")


@query(f"SELECT count(*) AS n, count(DISTINCT month) AS months FROM ({_O})")
def zero_column_scan(spark, sf_dir):
    """Opens no file: row counts and partitions stand in the part names."""
    return _sql(spark, sf_dir, "SELECT count(*) AS n, count(DISTINCT month) AS months FROM al.ord")


@query(f"SELECT sym, o_totalprice FROM ({_O}) WHERE date BETWEEN TIMESTAMP '1994-02-01' AND TIMESTAMP '1994-02-28' AND o_totalprice >= 150000 AND o_custkey < 5000")
def prune_between(spark, sf_dir):
    return _ord(spark, sf_dir).scan("ord", columns=["sym", "o_totalprice"], where="date BETWEEN TIMESTAMP_NTZ '1994-02-01' AND TIMESTAMP_NTZ '1994-03-01' - INTERVAL 1 DAY AND o_totalprice >= 150000 AND o_custkey < 5000")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
