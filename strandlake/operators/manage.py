"""Tables, groups and partitions: create, extend, compact, drop."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import NamedTuple

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.types import parse_columns, to_arrow
from ..plans.layout import INDEX, ROWS_PER_GROUP, ROWS_PER_PART, LayoutError, Table, check_keys, discover, filesystem, group_name, part_name, partition_key, partition_kind, partition_period
from ..sources.scan import RowReader
from .lock import LOCK, next_transaction, write_lock
from .swap import Move, clear, swap


class Created(NamedTuple):
    """Directories below the table or group, files, and a transaction number."""

    dirs_created: int
    files_created: int
    txid: int


class Compacted(NamedTuple):
    dirs_compacted: int
    parts_before: int
    parts_after: int


class Dropped(NamedTuple):
    dirs_removed: int
    files_removed: int
    txid: int


def _nulls(store: pafs.FileSystem, path: str, schema: StructType, rows: int) -> None:
    """A part of all-NULL rows."""
    arrow = to_arrow(schema)
    arrow = pa.schema([f.with_nullable(True) for f in arrow])
    with pq.ParquetWriter(path, arrow, filesystem=store, compression="zstd", compression_level=1) as out:
        at = 0
        while at < rows or at == 0:
            n = min(ROWS_PER_GROUP, rows - at)
            out.write_table(pa.Table.from_arrays([pa.nulls(n, f.type) for f in arrow], schema=arrow))
            at += max(n, 1)


def _null_parts(root: str, place: str, schema: StructType, sizes: dict[str, int]) -> int:
    """All-NULL parts in partition directories of place; by tasks where there is more than a part's rows and a session. Returns the files."""
    store, _ = filesystem(root)
    parts = [(f"{place}/{key}/{part_name(i, n)}", n) for key, rows in sizes.items() for i, n in enumerate(_cut(rows))]
    for key in sizes:
        store.create_dir(f"{place}/{key}")
    spark = SparkSession.getActiveSession()
    if spark is None or sum(sizes.values()) <= ROWS_PER_PART:
        for path, n in parts:
            _nulls(store, path, schema, n)
        return len(parts)

    def run(batches):
        own, _ = filesystem(root)
        for batch in batches:
            for job in batch.to_pylist():
                _nulls(own, job["path"], schema, job["n"])
            yield pa.RecordBatch.from_arrays([batch.column("n")], names=["n"])

    spark.createDataFrame(parts, "path string, n long").repartition(min(len(parts), 1000)).mapInArrow(run, "n long").collect()  # a row for each part
    return len(parts)


def _cut(rows: int) -> list[int]:
    """Sizes of full parts and a rest; one empty part without rows."""
    return [min(ROWS_PER_PART, rows - a) for a in range(0, rows, ROWS_PER_PART)] or [0]


def parse_groups(text: str | dict) -> dict[str, list[str]]:
    """'index:close;factor/alpha:a,b' as a dictionary."""
    if isinstance(text, dict):
        return {group_name(k): list(v) for k, v in text.items()}
    out = {}
    for item in filter(None, (x.strip() for x in text.split(";"))):
        name, _, columns = item.partition(":")
        out[group_name(name)] = [c.strip() for c in columns.split(",") if c.strip()]
    return out


def _shared_out(schema: StructType, groups: dict[str, list[str]]) -> dict[str, StructType]:
    """Columns by group: the keys and what no group lists belong to the index."""
    fields = {f.name.lower(): f for f in schema}
    for g, columns in groups.items():
        for c in columns:
            if c.lower() not in fields:
                raise LayoutError(f"group '{g}' references unknown column '{c}'")
    keys = [f.name.lower() for f in schema[:2]]
    listed = {c.lower() for g, columns in groups.items() if g != INDEX for c in columns}
    first = [f for f in schema if f.name.lower() in keys or f.name.lower() not in listed]
    out = {INDEX: StructType(first)}
    for g, columns in groups.items():
        if g != INDEX:
            out[g] = StructType([fields[c.lower()] for c in columns if c.lower() not in keys])
    return out


def create_table(root: str, name: str, columns: str | StructType, *, groups: str | dict | None = None, partition_template: str = "month", today: Callable[[], dt.date] = dt.date.today) -> Created:
    """A table with an empty part in the partition of the current date, in each group."""
    schema = parse_columns(columns)
    check_keys(schema)
    shared = _shared_out(schema, parse_groups(groups or {}))
    store, base = filesystem(root)
    folder = f"{base.rstrip('/')}/{name}"
    if store.get_file_info(f"{folder}/{INDEX}").type != pafs.FileType.NotFound:
        raise LayoutError(f"table '{name}' already exists")
    key = partition_key(partition_kind(partition_template), today())
    store.create_dir(folder, recursive=True)
    with write_lock(root, name):
        if store.get_file_info(f"{folder}/{INDEX}").type != pafs.FileType.NotFound:
            raise LayoutError(f"table '{name}' already exists")
        for g, own in sorted(shared.items(), key=lambda x: x[0] == INDEX):  # the index comes last: without one there is no table yet
            store.create_dir(f"{folder}/{g}/{key}", recursive=True)
            _nulls(store, f"{folder}/{g}/{key}/{part_name(0, 0)}", own, 0)
    below = {"/".join(f"{g}/{key}".split("/")[:n]) for g in shared for n in range(1, f"{g}/{key}".count("/") + 2)}
    return Created(len(below), len(shared), next_transaction())


def create_group(root: str, name: str, group: str, columns: str | StructType | None = None) -> Created:
    """Without columns an empty directory; else an all-NULL part beside each index partition."""
    group = group_name(group)
    if group == INDEX:
        raise LayoutError("specify a non-index group")
    with write_lock(root, name):
        table = discover(root, name)
        store, _ = filesystem(root)
        place = f"{table.path}/{group}"
        if store.get_file_info(place).type != pafs.FileType.NotFound:
            raise LayoutError(f"group '{group}' already exists")
        store.create_dir(place, recursive=True)
        if columns is None:
            return Created(1, 0, next_transaction())
        schema, keys = parse_columns(columns), {k.lower() for k in table.keys}
        schema = StructType([f for f in schema if f.name.lower() not in keys])
        files = _null_parts(root, place, schema, {k: table.index.rows(k) for k in table.starts})
        return Created(len(table.starts), files, next_transaction())


def create_partition(root: str, name: str, key: str) -> Created:
    """An empty part in every group."""
    with write_lock(root, name):
        table = discover(root, name)
        if key.partition("=")[0] != table.kind:
            raise LayoutError(f"partition '{key}' does not fit the table's {table.kind} partitions")
        partition_period(key)
        if key in table.starts:
            raise LayoutError(f"partition '{key}' already exists")
        store, _ = filesystem(root)
        for g in table.groups:
            store.create_dir(f"{table.path}/{g.name}/{key}")
            _nulls(store, f"{table.path}/{g.name}/{key}/{part_name(0, 0)}", g.schema, 0)
        return Created(len(table.groups), len(table.groups), next_transaction())


def drop(root: str, name: str, group: str) -> Dropped:
    """One group, or with 'index' the whole table."""
    store, base = filesystem(root)
    folder = f"{base.rstrip('/')}/{name}"
    if store.get_file_info(folder).type != pafs.FileType.Directory:
        raise LayoutError(f"table '{name}' does not exist")
    with write_lock(root, name):
        place = folder if group.lower() == INDEX else f"{folder}/{group.strip('/')}"
        if not group.strip("/") or store.get_file_info(place).type != pafs.FileType.Directory or ".." in group.split("/"):
            raise LayoutError(f"unknown group '{group}'")
        found = [i for i in store.get_file_info(pafs.FileSelector(place, recursive=True)) if i.base_name != LOCK]
        dirs = sum(i.type == pafs.FileType.Directory for i in found)
        files = sum(i.type == pafs.FileType.File for i in found)
        store.delete_dir(place)
        above = place.rpartition("/")[0]
        if above != folder and place != folder and not store.get_file_info(pafs.FileSelector(above)):
            store.delete_dir(above)
    return Dropped(dirs, files, next_transaction())


def compact(spark: SparkSession, root: str, name: str, group: str = "all") -> Compacted:
    """Every group's partitions as full parts and a rest, rows in order. Each new part is a task, which reads its rows by row groups."""
    with write_lock(root, name):
        table = discover(root, name)
        if group.lower() != "all" and table.group(group) is None:
            raise LayoutError(f"unknown group '{group}'")
        before, kept, jobs, dirs = 0, 0, [], []
        store, _ = filesystem(root)
        stage = f"{table.path}/_tmp/transaction-{next_transaction()}"
        for g in table.groups:
            for key, parts in g.partitions.items():
                before += len(parts)
                rows = [p.rows for p in parts]
                normal = len(rows) == 1 or (all(r == ROWS_PER_PART for r in rows[:-1]) and 0 < rows[-1] <= ROWS_PER_PART)
                if normal and [p.index for p in parts] == list(range(len(parts))):
                    kept += len(parts)
                    continue
                dirs.append(Move(f"{stage}/_ready/{g.name}/{key}", f"{g.name}/{key}"))
                at = 0
                for i, n in enumerate(_cut(sum(rows))):
                    own = [(p.path, p.start, p.rows) for p in parts if p.rows and p.start < at + n and p.start + p.rows > at] or [(parts[-1].path, 0, 0)]
                    jobs.append((f"{dirs[-1].fresh}/{part_name(i, n)}", own, at, at + n))
                    at += n
        if not jobs:
            return Compacted(0, before, kept)
        try:
            for d in dirs:
                store.create_dir(d.fresh, recursive=True)
            plan = spark.createDataFrame(jobs, "target string, parts array<struct<path:string,start:long,rows:long>>, a long, b long").repartition(min(len(jobs), 10_000))

            def run(batches):
                own, _ = filesystem(root)
                for batch in batches:
                    for job in batch.to_pylist():
                        _rewrite(own, [(p["path"], p["start"], p["rows"]) for p in job["parts"]], job["a"], job["b"], job["target"])
                    yield pa.RecordBatch.from_arrays([pa.array([len(batch)], pa.int64())], names=["n"])

            plan.mapInArrow(run, "n long").collect()  # all staged before anything is replaced; a row for each task
            swap(store, table.path, stage, dirs)
            return Compacted(len(dirs), before, kept + len(jobs))
        finally:
            clear(store, table.path, stage)


def _rewrite(store: pafs.FileSystem, parts: list[tuple[str, int, int]], a: int, b: int, target: str) -> None:
    """One part of rows a to b of a partition. Written under another name first, so that a task's second attempt does no harm."""
    from uuid import uuid4

    draft = f"{target}.{uuid4().hex}"
    schema = None
    for path, _, n in parts:
        file = pq.ParquetFile(path, filesystem=store)
        if file.metadata.num_rows != n:
            raise LayoutError(f"'{path}': its name says {n} rows, its footer {file.metadata.num_rows}")
        own = file.schema_arrow.remove_metadata()
        if schema is not None and set(own.names) != set(schema.names):
            raise LayoutError(f"'{path}': parts of one partition differ in their columns; cannot compact")
        schema = schema or own
    if a == b:
        store.copy_file(parts[-1][0], draft)
    else:
        reader = RowReader(store, parts, schema)
        with pq.ParquetWriter(draft, schema, filesystem=store, compression="zstd", compression_level=1) as out:
            for at in range(a, b, ROWS_PER_GROUP):
                out.write_table(reader.read(at, min(at + ROWS_PER_GROUP, b)), row_group_size=ROWS_PER_GROUP)
    store.move(draft, target)
