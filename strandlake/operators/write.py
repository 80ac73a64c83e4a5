"""Bulk writes into a column group: overwrite of the partitions in the input, or merge by key.

Rows are range-partitioned by (partition, symbol, time) and sorted, so a large partition is written by many tasks and the files'
order is the rows' order. Spark's Parquet writer stages them; row counts come from the footers, by one job, and must add up to
the rows that were sorted; then files get their self-describing names, and directories are swapped (see swap.py): a write that
fails leaves the table as it was. An input that may differ when it is computed again is staged once, before anything reads it.

A group other than the index holds no keys. With align="key" (the default) its rows are placed by joining the input to the index keys of
the touched partitions, so rows without input are NULL and input without an index row is an error; align="position" writes
the input sorted by its keys and leaves the correspondence to the caller. A merge by key reads the group's rows beside those index keys, so
one join places the input and keeps the rest; as row numbers are known, their tasks are too, and nothing is sampled.
"""

from __future__ import annotations

import datetime as dt
from collections import defaultdict
from urllib.parse import unquote

from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from ..plans.layout import INDEX, ROWS_PER_GROUP, ROWS_PER_PART, LayoutError, Table, discover, filesystem, group_name, part_name, partition_key, partition_period
from ..plans.names import PARTITION, ROW
from ..plans.names import Column as Out
from ..sources.scan import _single, _uri, _zipped, quoted
from .lock import next_transaction, write_lock
from .swap import Move, clear, swap

_NEW, _SEQ, _ROW, _TASK = "__new", "__seq", "__row", "__task"
WRITER = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.writer.version": "v1", "parquet.block.row.count.limit": str(ROWS_PER_GROUP), "maxRecordsPerFile": str(ROWS_PER_PART)}


def write(df: DataFrame, root: str, name: str, group: str = INDEX, *, merge: bool = False, align: str = "key", missing: str = "error") -> int:
    """Rows written. missing: what a group's columns that the input lacks mean: "error" or "null"."""
    group = group_name(group)
    if align not in ("key", "position"):
        raise ValueError("align must be 'key' or 'position'")
    with write_lock(root, name):
        table = discover(root, name)
        return _write(df, root, table, group, merge, align, missing)


def write_wider(df: DataFrame, root: str, name: str, group: str) -> int:
    """An overwrite whose partitions take all the input's columns beside the keys: columns that the group lacks join its schema,
    NULL in the partitions that stay."""
    group = group_name(group)
    with write_lock(root, name):
        table = discover(root, name)
        known = table.group(group)
        if known is not None:
            keys = {k.lower() for k in table.keys}
            there = {f.name.lower() for f in known.schema}
            known.schema = StructType([*known.schema.fields, *(f for f in df.schema if f.name.lower() not in there | (keys if group != INDEX else set()))])
        return _write(df, root, table, group, False, "key", "null")


def _projected(df: DataFrame, table: Table, group: str, missing: str) -> tuple[DataFrame, StructType, tuple[str, str]]:
    """The input's keys and the group's columns, cast to its types; a new group takes all columns but the keys."""
    keys = table.keys
    there = {c.lower(): c for c in df.columns}
    for k in keys:
        if k.lower() not in there:
            raise LayoutError(f"the input lacks the key column '{k}'")
    known = table.group(group)
    if known is None:
        schema = StructType([f for f in df.schema if f.name.lower() not in {k.lower() for k in keys}])
        if not len(schema):
            raise LayoutError(f"group '{group}' would have no columns: the input has only the keys")
    else:
        schema = known.schema
    lacking = [f.name for f in schema if f.name.lower() not in there]
    if lacking and (missing == "error" or len(lacking) == len(schema)):
        raise LayoutError(f"the input lacks column '{lacking[0]}' of group '{group}'")
    chosen = [F.col(quoted(there[f.name.lower()])).cast(f.dataType).alias(f.name) if f.name.lower() in there else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    if group == INDEX:
        return df.select(*chosen), schema, keys
    types = table.index.schema
    own = [F.col(quoted(there[k.lower()])).cast(types[k].dataType).alias(k) for k in keys]
    return df.select(*own, *chosen), schema, keys


def _counted(kind: str) -> str:
    """The column that numbers partitions of a kind."""
    return f"__{kind}"


def _partition_of(time: Column, kind: str, name: str) -> Column:
    """The partition's number: its year, months since the year 0, or days since 1970."""
    number = {"year": F.year(time), "month": F.year(time) * 12 + F.month(time) - 1, "date": F.unix_date(time.cast("date"))}[kind]
    return F.when(time.isNull(), F.raise_error(F.lit(f"NULL in partition column '{name}'")).cast("int")).otherwise(number)


def _named(kind: str, number: int) -> str:
    """The partition of a number."""
    try:
        day = dt.date(1970, 1, 1) + dt.timedelta(number) if kind == "date" else dt.date(number, 1, 1) if kind == "year" else dt.date(number // 12, number % 12 + 1, 1)
    except (ValueError, OverflowError) as e:
        raise LayoutError(f"{kind} partition {number} lies outside the years 1 to 9999") from e
    return partition_key(kind, day)


def _write(df: DataFrame, root: str, table: Table, group: str, merge: bool, align: str, missing: str) -> int:
    store, base = filesystem(root)
    folder = f"{base.rstrip('/')}/{table.name}"
    stage = f"{folder}/_tmp/transaction-{next_transaction()}"
    try:
        return _staged(df, root, table, group, merge, align, missing, store, folder, stage)
    finally:
        clear(store, folder, stage)


def _staged(df: DataFrame, root: str, table: Table, group: str, merge: bool, align: str, missing: str, store: pafs.FileSystem, folder: str, stage: str) -> int:
    spark = df.sparkSession
    rows, schema, (symbol, time) = _projected(df, table, group, missing)
    if not df._jdf.queryExecution().analyzed().deterministic():
        rows.write.parquet(_uri(root, f"{stage}/input"))
        rows = spark.read.schema(rows.schema).parquet(_uri(root, f"{stage}/input"))
    key = _counted(table.kind)
    rows = rows.withColumn(key, _partition_of(F.col(quoted(time)), table.kind, time))
    order = [F.col(key), F.col(quoted(symbol)).asc_nulls_last(), F.col(quoted(time)).asc_nulls_last()]
    by_key = group != INDEX and (merge or align == "key")
    touched: list[str] = []
    if merge or by_key:
        days = rows.select(F.col(quoted(time)).cast("date").alias("__day")).distinct()
        touched = list(dict.fromkeys(_named(table.kind, r[0]) for r in days.select(_partition_of(F.col("__day"), table.kind, time)).collect()))  # a row for each day
        if not touched:
            return 0
        if group != INDEX and (unknown := [k for k in touched if k not in table.starts]):
            raise LayoutError(f"group '{group}' has partition '{unknown[0]}' that the index group does not have")
    if by_key and align == "key":
        rows, n = _on_index(spark, root, table, group, rows, touched, symbol, time, schema, merge)
        order = [F.col(key), F.col(_ROW)]
        dealt = rows.repartitionById(n, F.col(_TASK))
    else:
        if merge:
            rows = _merged(spark, root, table, group, rows, touched, symbol, time)
        dealt = rows.repartitionByRange(*order)
    sorted_rows, seen = dealt.sortWithinPartitions(*order), Observation()
    observed = sorted_rows.select(*[F.col(quoted(f.name)) for f in schema], key).observe(seen, F.count(F.lit(1)).alias("rows"))
    observed.write.partitionBy(key).options(**WRITER).parquet(_uri(root, f"{stage}/_sorted"))
    return _commit(spark, store, root, folder, stage, group, seen.get["rows"])


def _existing(spark, root: str, table: Table, group: str, keys: list[str]) -> DataFrame:
    """The index keys of the partitions beside the group's rows (by position), with the row number and the partition."""
    index, own = table.keys, table.group(group)
    types = table.index.schema
    need = [Out(k, INDEX, k, types[k].dataType) for k in index]
    need += [Out(f.name, group, f.name, f.dataType) for f in (own.schema if own else ()) if group != INDEX or f.name not in index]
    need.append(Out(_ROW, ROW, _ROW, LongType()))
    read = _zipped if own and group != INDEX else lambda *a: _single(*a[:3], INDEX, *a[3:])
    df = read(spark, root, table, need, keys)
    return df.withColumn(_counted(table.kind), _partition_of(F.col(quoted(index[1])), table.kind, index[1]))


def _merged(spark, root: str, table: Table, group: str, rows: DataFrame, touched: list[str], symbol: str, time: str) -> DataFrame:
    """New rows and those of the touched partitions; of equal keys the last new one stays."""
    known = table.group(group)
    keys = [k for k in touched if known and k in known.partitions and known.rows(k)]
    rows = rows.withColumns({_NEW: F.lit(1), _SEQ: F.monotonically_increasing_id()})
    if keys:
        old = _existing(spark, root, table, group, keys).withColumns({_NEW: F.lit(0), _SEQ: F.col(_ROW)}).drop(_ROW)
        if group != INDEX:
            # Rows beyond the group's own are padding, not data.
            old = old.where(F.col(_SEQ) < F.element_at(F.create_map(*[F.lit(x) for k in keys for x in (_numbered(k), table.starts[k] + known.rows(k))]), F.col(_counted(table.kind))))
        rows = rows.unionByName(old.select(*rows.columns))
    last = Window.partitionBy(_counted(table.kind), quoted(symbol), quoted(time)).orderBy(F.col(_NEW).desc(), F.col(_SEQ).desc())
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", _NEW, _SEQ)


def _numbered(key: str) -> int:
    """The number that _partition_of gives the rows of a partition."""
    kind, day = key.partition("=")[0], partition_period(key)[0]
    return {"year": day.year, "month": day.year * 12 + day.month - 1, "date": (day - dt.date(1970, 1, 1)).days}[kind]


def _on_index(spark, root: str, table: Table, group: str, rows: DataFrame, touched: list[str], symbol: str, time: str, schema: StructType, merge: bool) -> tuple[DataFrame, int]:
    """A row for each index row of the touched partitions, and the number of tasks that they are dealt to. Keys that occur more than once are
    matched in order of the input. In a merge the last new row of a key is placed on its first index row, without a new row the last old one."""
    own, types, key = table.group(group) if merge else None, table.index.schema, _counted(table.kind)
    # The place of each partition: where its rows come among those of the touched ones, and where the group's own rows there end.
    places, at = [], 0
    for k in sorted(touched, key=_numbered):
        places.append((k.partition("=")[2], _numbered(k), at - table.starts[k], table.starts[k] + (own.rows(k) if own else 0)))
        at += table.index.rows(k)
    step = max(ROWS_PER_GROUP // 4, min(ROWS_PER_PART, -(-at // (2 * spark.sparkContext.defaultParallelism))))
    old = [Out(f"__old{i}", group, f.name, f.dataType) for i, f in enumerate(schema if own else ())]
    need = [Out("__s0", INDEX, symbol, types[symbol].dataType), Out("__t0", INDEX, time, types[time].dataType), Out("__value", PARTITION, "", StringType()), Out(_ROW, ROW, _ROW, LongType()), *old]
    there = _zipped(spark, root, table, need, touched) if old else _single(spark, root, table, INDEX, need, touched)
    where = spark.createDataFrame(places, f"__value string, {key} int, __shift long, __end long")
    there = there.join(F.broadcast(where), "__value").drop("__value")
    # Equal keys have equal columns without NULL; their hash leads, as it sorts faster than text.
    by = ["__h", "__null", "__s", "__t"]

    def keyed(df: DataFrame, s: str, t: str) -> DataFrame:
        s, t = F.col(quoted(s)), F.col(quoted(t))
        return df.select(F.xxhash64(s, t).alias("__h"), s.isNull().alias("__null"), F.coalesce(s, F.lit("")).alias("__s"), t.alias("__t"), "*").drop(s, t)

    there = keyed(there, "__s0", "__t0")
    new = keyed(rows.drop(key).withColumn(_SEQ, F.monotonically_increasing_id()), symbol, time)
    by_row = Window.partitionBy(*by).orderBy(_ROW)
    stray = F.concat(F.lit("the input has a row that the index group does not have: "), F.when(F.col("__null"), "NULL").otherwise(F.col("__s")))
    there = there.withColumn("__n", F.row_number().over(by_row))
    if merge:
        if old:
            # Rows beyond the group's own are padding, not data.
            held = F.when(F.col(_ROW) < F.col("__end"), F.struct(*[c.name for c in old]))
            whole = by_row.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            there = there.withColumn("__last", F.last(held, ignorenulls=True).over(whole)).drop(*[c.name for c in old])
        # One row of a key is left, so the join is by the key alone and needs no shuffle beside those of the windows.
        new = new.withColumn("__m", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(_SEQ).desc()))).where("__m = 1").drop("__m", _SEQ)
        both = there.join(new.withColumn(_NEW, F.lit(1)), by, "full_outer")
        own_or_old = lambda i, f: F.when(F.col(_NEW).isNotNull(), F.col(quoted(f.name))).otherwise(F.col("__last")[f"__old{i}"] if old else F.lit(None))
        values = [F.when(F.col("__n") == 1, own_or_old(i, f)).cast(f.dataType).alias(f.name) for i, f in enumerate(schema)]
    else:
        new = new.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(_SEQ))).drop(_SEQ)
        both = there.join(new, [*by, "__n"], "full_outer")
        values = [F.col(quoted(f.name)) for f in schema]
    both = both.where(F.assert_true(F.col(_ROW).isNotNull(), stray).isNull())
    task = F.coalesce(F.floor((F.col(_ROW) + F.col("__shift")) / step), F.lit(0)).cast("int").alias(_TASK)
    return both.select(*values, key, _ROW, task), max(1, -(-at // step))


def _commit(spark, store: pafs.FileSystem, root: str, folder: str, stage: str, group: str, received: int) -> int:
    """Staged files to their places; each partition's directory is swapped whole. received: the rows that the files must hold."""
    files = [i.path for i in store.get_file_info(pafs.FileSelector(f"{stage}/_sorted", recursive=True)) if i.path.endswith(".parquet") and "/part-" in i.path]
    sizes: dict[tuple[str, str], int] = {}
    if files:
        counts = spark.read.parquet(*[_uri(root, f) for f in files]).groupBy(F.substring_index("_metadata.file_path", "/", -1).alias("f"), F.substring_index(F.substring_index("_metadata.file_path", "/", -2), "/", 1).alias("d")).count()
        sizes = {(unquote(r["d"]), r["f"]): r["count"] for r in counts.collect()}  # a row for each file

    by_key: dict[str, list[tuple[str, int]]] = defaultdict(list)
    for f in sorted(files, key=_task_order):
        where, name = f.split("/")[-2:]
        kind, _, number = unquote(where).partition("=")
        by_key[_named(kind.removeprefix("__"), int(number))].append((f, sizes.get((where, name), 0)))
    written = sum(n for parts in by_key.values() for _, n in parts)
    if written != received:
        raise LayoutError(f"group '{group}': {received} rows were received, but the staged files hold {written}; nothing was changed")

    moves = []
    for key, parts in by_key.items():
        fresh = f"{stage}/_ready/{key}"
        store.create_dir(fresh, recursive=True)
        for i, (path, n) in enumerate((p, n) for p, n in parts if n):
            store.move(path, f"{fresh}/{part_name(i, n)}")
        moves.append(Move(fresh, f"{group}/{key}"))
    swap(store, folder, stage, moves)
    return written


def _task_order(path: str) -> tuple[str, int, str]:
    """part-<task>-<uuid>.c<number>...: by directory, task, number."""
    where, name = path.split("/")[-2:]
    return where, int(name.split("-")[1]), name.rpartition(".c")[2]
