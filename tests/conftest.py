import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    out = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


def put(root, group, key, name, columns, row_group=2048):
    """A part file from (name, arrow type, values)."""
    place = root / group / key
    place.mkdir(parents=True, exist_ok=True)
    table = pa.table([pa.array(v, t) for _, t, v in columns], names=[n for n, _, _ in columns])
    pq.write_table(table, place / name, row_group_size=row_group)


def main_lake(root):
    """6000 rows in two months; a group with a gap in its part numbers and a newer column, and one without the first month."""
    base = root / "main"
    day = {0: dt.date(2026, 7, 1), 1: dt.date(2026, 8, 1), 2: dt.date(2026, 8, 1)}
    for i, key, index, other in ((0, "month=2026-07", 0, 0), (1, "month=2026-08", 0, 0), (2, "month=2026-08", 1, 2)):
        rows = range(2000 * i, 2000 * i + 2000)
        name = lambda k: f"{k:04d}-0000002000.parquet"
        put(base, "index", key, name(index), [("symbol", pa.string(), [f"{r + 1:06d}" for r in rows]), ("date", pa.date32(), [day[i]] * 2000), ("close", pa.float64(), [(r + 1) * 0.5 for r in rows]), ("volume", pa.int64(), [(r + 1) * 100 for r in rows]), ("rowid", pa.int64(), list(rows))])
        alpha = [("rowid_alpha", pa.int64(), list(rows))]
        alpha += [(f"alpha{n:03d}", pa.float64(), [(r + n + 1) * 0.01 if r % 5 == 0 else None for r in rows]) for n in range(1, 11)]
        alpha += [("close", pa.float64(), [(r + 1) * 0.25 for r in rows]), ("vwap", pa.float64(), [(r + 1) * 0.125 for r in rows])]
        if i == 2:
            alpha.append(("alpha099", pa.float64(), [(r + 1) * 0.001 if r % 3 == 0 else None for r in rows]))
        put(base, "factor/alpha101", key, name(other), alpha, 1000)
        if i:
            ma = [("rowid_ma", pa.int64(), list(rows)), ("ma5", pa.float64(), [(r % 20) * 0.1 for r in rows]), ("ma10", pa.float64(), [(r % 30) * 0.05 for r in rows]), ("ma20", pa.float64(), [(r % 60) * 0.025 for r in rows])]
            put(base, "fieldset/ma", key, name(index), [*ma, ("close", pa.float64(), [(r + 1) * 0.0625 for r in rows]), ("vwap", pa.float64(), [(r + 1) * 0.03125 for r in rows])])
    put(base, "_tmp/transaction-999/index", "month=2026-07", "part-000000.parquet", [("symbol", pa.string(), ["x"] * 100)])
    return base


@pytest.fixture(scope="session")
def lake_root(tmp_path_factory):
    root = tmp_path_factory.mktemp(".lake")
    main_lake(root)
    return root
