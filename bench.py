"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line. Lakes are built before the clock starts; each query is the better of two runs.

Beside them ("comparison"): non-null counts over one million rows of 127 columns in three groups, read from the lake, from the same rows as one wide
Parquet table, and from the groups' files joined on their row numbers; and writes of 1.3 million rows by year, into the lake and as plain partitioned Parquet.
BENCH_COMPARE=0 leaves these out.
"""

from __future__ import annotations

import datetime as dt
import json
import os
import sys
import tempfile
import time
from collections.abc import Callable
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADLINE = (
    "scan_all_groups", "scan_by_row_join", "scan_single_group", "scan_rowid_and_partition", "group_by_partition_column", "count_rows", "prune_date_range", "prune_timestamp", "aggregate_over_three_groups",
    "pricing_summary", "join_on_rowid", "null_fill_missing_partitions", "merge_upsert", "catalog_sql_topk",
)
ROWS, DAYS = 1_000_000, 4
ALPHA, MA = [f"alpha{n:03d}" for n in range(100)], [f"ma{n:03d}" for n in range(20)]


def best(run: Callable[[], object], times: int = 2) -> float:
    took = []
    for _ in range(times):
        began = time.time()
        run()
        took.append(time.time() - began)
    return round(min(took), 3)


def build(root: Path) -> None:
    """The lake `bench`, and beside it the same rows as one wide table and as a table for each group."""
    per = ROWS // DAYS
    for d in range(DAYS):
        r = np.arange(d * per, (d + 1) * per)
        day = dt.date(2026, 9, 1 + d)
        index = {"symbol": pa.array([f"{i + 1:06d}" for i in r.tolist()]), "date": pa.array([day] * per, pa.date32()), "close": pa.array((r + 1) * 0.5), "volume": pa.array((r + 1) * 100), "rowid": pa.array(r)}
        alpha = {"rowid_alpha": pa.array(r)} | {c: pa.array((r + n + 1) * 0.001, mask=r % 7 != 0) for n, c in enumerate(ALPHA)}
        ma = {"rowid_ma": pa.array(r)} | {c: pa.array((r % (n + 11)) * 0.0001) for n, c in enumerate(MA)}
        for group, columns, size in (("index", index, 32_768), ("factor/alpha101", alpha, 65_536), ("fieldset/ma", ma, 65_536)):
            for place in (root / "bench" / group / f"date={day}", root / ".flat" / group):
                place.mkdir(parents=True, exist_ok=True)
                pq.write_table(pa.table(columns), place / f"{0 if 'flat' not in str(place) else d:04d}-{per:010d}.parquet", row_group_size=size, compression="zstd")
        (root / ".flat/wide").mkdir(parents=True, exist_ok=True)
        pq.write_table(pa.table(index | alpha | ma), root / ".flat/wide" / f"{d:04d}.parquet", row_group_size=65_536, compression="zstd")


def reads(spark: SparkSession, root: Path) -> dict[str, dict[str, float]]:
    from strandlake import Lake

    lake = Lake(spark, str(root))
    flat = {g: spark.read.parquet(str(root / ".flat" / g)) for g in ("wide", "index", "factor/alpha101", "fieldset/ma")}
    first = "date = DATE '2026-09-01'"

    def keyed(columns: list[str], day: bool) -> DataFrame:
        i = flat["index"].where(first) if day else flat["index"]
        out = i.select("rowid").join(flat["factor/alpha101"], F.col("rowid") == F.col("rowid_alpha"))
        return out.join(flat["fieldset/ma"], F.col("rowid") == F.col("rowid_ma")) if MA[0] in columns else out

    loads = {"p5": (ALPHA[:5], False), "p25": (ALPHA[:25], False), "p100": (ALPHA + MA, False), "s25": (ALPHA[:25], True), "s100": (ALPHA[:25], False)}
    out: dict[str, dict[str, float]] = {}
    for name, (columns, day) in loads.items():
        ways = {
            "lake": lambda: lake.scan("bench", columns=columns, where=first if day else None),  # noqa: B023
            "zip": lambda: lake.scan("bench", columns=columns, where=first if day else None, strategy="zip"),  # noqa: B023
            "rowid_join": lambda: lake.scan("bench", columns=columns, where=first if day else None, strategy="join"),  # noqa: B023
            "wide": lambda: flat["wide"].where(first) if day else flat["wide"],  # noqa: B023
            "key_join": lambda: keyed(columns, day),  # noqa: B023
        }
        found = {}
        for way, df in ways.items():
            counts = set()
            found[way] = best(lambda: counts.add(tuple(df().agg(*[F.count(c) for c in columns]).first())), 3)  # noqa: B023
            assert len(counts) == 1
            out.setdefault("counts", {}).setdefault(name, next(iter(counts)))
            assert out["counts"][name] == next(iter(counts)), (name, way)
        out[name] = found
    out.pop("counts")
    return out


def writes(spark: SparkSession, root: Path) -> dict[str, float]:
    from strandlake import Lake

    lake = Lake(spark, str(root), today=lambda: dt.date(2026, 9, 1))
    rows = spark.range(100 * 13_159).select(
        F.lpad((F.col("id") % 100).cast("string"), 6, "0").alias("symbol"), F.date_add(F.lit(dt.date(1990, 1, 1)), (F.col("id") / 100).cast("int")).alias("date"), *[((F.col("id") % (97 + n)) * 0.5).alias(f"v{n}") for n in range(5)]
    )
    path = str(root / ".input")
    rows.write.parquet(path)
    rows = spark.read.parquet(path)
    lake.create("w", "index", "symbol VARCHAR, date DATE", partition_template="year")
    out = {"index": best(lambda: lake.write(rows.select("symbol", "date"), "w")), "panel_by_position": best(lambda: lake.write(rows, "w", "panel/v", align="position")), "panel_by_key": best(lambda: lake.write(rows, "w", "panel/v"))}
    out["panel_merge_one_year"] = best(lambda: lake.write(rows.where("year(date) = 2020"), "w", "panel/v", merge=True))
    out["native_by_year"] = best(lambda: rows.withColumn("year", F.year("date")).repartition("year").write.mode("overwrite").option("compression", "zstd").partitionBy("year").parquet(str(root / ".native")))
    out["native_flat"] = best(lambda: rows.write.mode("overwrite").option("compression", "zstd").parquet(str(root / ".native_flat")))
    return out


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, str(Path(__file__).parent))
    from strandlake.queries import queries

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    own, took = queries(), {}
    for name in HEADLINE:
        own[name](spark, sf_dir)  # builds the lake
        took[name] = best(lambda: own[name](spark, sf_dir).write.format("noop").mode("overwrite").save())  # noqa: B023
    out = {"metric": "total_query_time", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}
    if os.environ.get("BENCH_COMPARE", "1") != "0":
        with tempfile.TemporaryDirectory(prefix="bench-lake-") as root:
            build(Path(root))
            out["comparison"] = {"reads": reads(spark, Path(root)), "writes": writes(spark, Path(root))}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
