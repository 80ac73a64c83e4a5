"""Scans: a table's column groups as one DataFrame.

Only the groups, partitions and columns that a scan needs are opened. Three ways to put groups together:
  single  one group holds every needed column and has a row for each index row: a plain Parquet scan of its part files
  zip     tasks read the same row range of every group and set the columns side by side, without a shuffle; ranges that the row
          groups' statistics rule out are not read
  join    the groups are joined on the row number by Catalyst
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.types import to_arrow
from ..plans.layout import INDEX, ROWS_PER_GROUP, ROWS_PER_PART, Part, Table, discover, filesystem
from ..plans.names import PARTITION, ROW, Column, resolve
from ..plans.pruning import OPS, Comparison, conjuncts, converted, kept_partitions, possible

STRATEGIES = ("auto", "single", "zip", "join")
_ROWID = "__row"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def scan(spark: SparkSession, root: str, name: str, *, groups=None, columns: list[str] | None = None, where: str | list[Comparison] | None = None, rowid: bool = False, aliases: bool = True, strategy: str = "auto") -> DataFrame:
    """The table, or what is asked of it.

    groups: names of groups to keep beside the index (unknown ones are ignored); columns: output columns, in order, bare or
    qualified, the partition column and rowid included; where: an SQL condition or (column, operator, value) comparisons, for pruning
    and as a row filter; rowid: whether to add the row number; aliases: as in plans.names.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy must be one of {STRATEGIES}")
    table = discover(root, name)
    return scan_table(spark, root, table, resolve(table, groups, aliases), columns, where, rowid, strategy)


def scan_table(spark: SparkSession, root: str, table: Table, every: list[Column], columns, where, rowid: bool, strategy: str, keys: list[str] | None = None) -> DataFrame:
    """keys: partitions to keep, where that is known already."""
    by_name = {c.name.lower(): c for c in every}
    if columns is None:
        out = [c for c in every if not c.hidden or (rowid and c.group == ROW)]
    else:
        missing = [c for c in columns if c.lower() not in by_name]
        if missing:
            raise ValueError(f"column '{missing[0]}' not found in '{table.name}'; there are {', '.join(c.name for c in every)}")
        out = [by_name[c.lower()] for c in columns]
        if rowid and "rowid" not in {c.name for c in out}:
            out.append(by_name["rowid"])
    simple = conjuncts(spark, where) if isinstance(where, str) else list(where or ())
    condition = where if isinstance(where, str) else None
    if condition:
        # Columns of the condition are read too; names that it doesn't quote may hold dots.
        used = {n.lower() for n in _attributes(spark._jsparkSession.sessionState().sqlParser().parseExpression(condition))}
        extra = [by_name[n] for n in sorted(used) if n in by_name]
    else:
        extra = [by_name[c.lower()] for c, _, _ in simple]
    need = list(dict.fromkeys([*out, *extra]))
    keys = [k for k in kept_partitions(table, simple) if keys is None or k in keys]
    tests = [(by_name[c.lower()], op, value) for c, op, value in simple if c.lower() in by_name]
    df = _assembled(spark, root, table, need, keys, strategy, tests)
    if condition:
        df = df.where(condition)
    for column, op, value in simple if not condition else ():
        own = df[quoted(by_name[column.lower()].name)]
        df = df.where(own.isin(list(value)) if op == "in" else OPS[op](own, value))
    return df.select(*[F.col(quoted(c.name)) for c in out])


def _attributes(node) -> Iterator[str]:
    if node.getClass().getSimpleName() == "UnresolvedAttribute":
        yield ".".join(node.nameParts().apply(i) for i in range(node.nameParts().size()))
    for i in range(node.children().size()):
        yield from _attributes(node.children().apply(i))


def _assembled(spark: SparkSession, root: str, table: Table, need: list[Column], keys: list[str], strategy: str, tests: list[tuple[Column, str, object]] = ()) -> DataFrame:
    """need, over the partitions in keys. tests: comparisons that the caller filters by; rows that fail them may be left out."""
    if strategy in ("auto", "zip") and all(c.group in (PARTITION, ROW) for c in need):
        return _numbered(spark, table, need, keys)
    active = [g for g in table.groups if any(c.group == g.name for c in need)]
    single = active[0] if len(active) == 1 and (active[0].name == INDEX or all(active[0].rows(k) == table.index.rows(k) for k in keys)) else table.index if not active else None
    if strategy == "auto":
        strategy = "single" if single else "zip"
    if strategy == "single":
        if not single:
            raise ValueError("several groups are needed; use strategy zip or join")
        return _single(spark, root, table, single.name, need, keys)
    if strategy == "zip":
        return _zipped(spark, root, table, need, keys, tests)
    return _joined(spark, root, table, need, keys)


def _uri(root: str, path: str) -> str:
    """Spark's name of a discovered path."""
    if "://" in root:
        scheme, _, rest = root.partition("://")
        store, base = filesystem(root)
        return f"{scheme}://{rest.rstrip('/')}{path[len(base.rstrip('/')) :]}"
    return f"file://{path}"


def _empty(spark: SparkSession, need: list[Column]) -> DataFrame:
    return spark.createDataFrame([], StructType([StructField(c.name, c.type) for c in need]))


def _numbered(spark: SparkSession, table: Table, need: list[Column], keys: list[str]) -> DataFrame:
    """Row numbers and partition values come from the part names alone: no file is opened."""
    runs = [(k.partition("=")[2], table.starts[k] + a, table.starts[k] + min(a + ROWS_PER_GROUP, table.index.rows(k))) for k in keys for a in range(0, table.index.rows(k), ROWS_PER_GROUP)]
    if not runs:
        return _empty(spark, need)
    rows = spark.createDataFrame(runs, "__value string, __a long, __b long").select("__value", F.explode(F.sequence("__a", F.col("__b") - 1)).alias("__row"))
    return rows.select(*[F.col("__value" if c.group == PARTITION else "__row").alias(c.name) for c in need])


def _single(spark: SparkSession, root: str, table: Table, name: str, need: list[Column], keys: list[str], row: bool = False) -> DataFrame:
    """Columns of one group (and the partition column and rowid), read by Spark from the listed part files."""
    group = table.group(name)
    parts = [p for p in group.parts(keys) if p.rows]
    if not parts:
        return _empty(spark, [*need, *([Column(_ROWID, ROW, _ROWID, LongType())] if row else [])])
    own = [c for c in need if c.group == name]
    schema = StructType([f for f in group.schema if f.name in {c.source for c in own}])
    df = spark.read.schema(schema).parquet(*[_uri(root, p.path) for p in parts])
    placed = row or any(c.group in (PARTITION, ROW) for c in need)
    if placed:
        # The file's place in the table, by its path below the table's directory: one broadcast row for each part.
        places = spark.createDataFrame([(_tail(table, p.path), table.starts[k] + p.start, k.partition("=")[2]) for k in keys for p in group.partitions.get(k, ()) if p.rows], "__file string, __start long, __value string")
        tail = F.substring_index(F.col("_metadata.file_path"), "/", -_depth(table, parts[0].path))
        df = df.select("*", tail.alias("__file"), F.col("_metadata.row_index").alias("__index")).join(F.broadcast(places) if len(parts) <= 100_000 else places, "__file")
    value = {PARTITION: "__value", ROW: "__start + __index"}
    out = [F.expr(value[c.group]).alias(c.name) if c.group in value else F.col(quoted(c.source)).alias(c.name) for c in need]
    return df.select(*out, *([F.expr("__start + __index").alias(_ROWID)] if row else []))


def _tail(table: Table, path: str) -> str:
    return path[len(table.path) :].lstrip("/")


def _depth(table: Table, path: str) -> int:
    return _tail(table, path).count("/") + 1


def _joined(spark: SparkSession, root: str, table: Table, need: list[Column], keys: list[str]) -> DataFrame:
    base = [c for c in need if c.group in (INDEX, PARTITION, ROW)]
    out = _single(spark, root, table, INDEX, base, keys, row=True)
    for g in table.groups[1:]:
        if own := [c for c in need if c.group == g.name]:
            out = out.join(_single(spark, root, table, g.name, own, keys, row=True), _ROWID, "left")
    return out.select(*[F.col(quoted(c.name)) for c in need])


class RowReader:
    """Row ranges of one group's parts in a partition."""

    def __init__(self, store, parts: list[tuple[str, int, int]], schema: pa.Schema):
        self.store, self.parts, self.schema, self.open = store, parts, schema, {}

    def file(self, path: str, rows: int):
        import pyarrow.parquet as pq

        if path not in self.open:
            self.open = {path: pq.ParquetFile(path, filesystem=self.store, pre_buffer=True)}
        file = self.open[path]
        if file.metadata.num_rows != rows:
            raise ValueError(f"'{path}': its name says {rows} rows, its footer {file.metadata.num_rows}")
        return file

    def met(self, a: int, b: int) -> Iterator[tuple]:
        """For each part that rows a to b meet: its file, the rows from and to there, the row groups, and the first row of those."""
        for path, start, rows in self.parts:
            lo, hi = max(a, start) - start, min(b, start + rows) - start
            if lo >= hi:
                continue
            file = self.file(path, rows)
            at, pick, first = 0, [], 0
            for i in range(file.metadata.num_row_groups):
                n = file.metadata.row_group(i).num_rows
                if at < hi and at + n > lo:
                    first = first if pick else at
                    pick.append(i)
                at += n
            yield file, lo, hi, pick, first

    def may_hold(self, a: int, b: int, tests: list[tuple[str, str, object]]) -> bool:
        """Whether the statistics of the row groups leave a row from a to b that passes every (column, operator, value)."""
        for column, op, value in tests:
            some = False
            for file, _, _, pick, _ in self.met(a, b):
                place = next((i for i, n in enumerate(file.schema_arrow.names) if n.lower() == column.lower()), None)
                if place is None or len(file.schema_arrow.names) != file.metadata.num_columns:
                    some = some or place is not None  # a column that the part lacks is NULL there
                    continue
                some = some or any(possible(file.metadata.row_group(i).column(place).statistics, op, value) for i in pick)
            if not some:
                return False
        return True

    def read(self, a: int, b: int) -> pa.Table:
        tables, got = [], 0
        for file, lo, hi, pick, first in self.met(a, b):
            there = {n.lower(): n for n in file.schema_arrow.names}
            names = [there[f.name.lower()] for f in self.schema if f.name.lower() in there]
            found = file.read_row_groups(pick, columns=names, use_threads=False).slice(lo - first, hi - lo)
            columns = [found.column(there[f.name.lower()]).cast(f.type) if f.name.lower() in there else pa.nulls(hi - lo, f.type) for f in self.schema]
            tables.append(pa.Table.from_arrays(columns, schema=self.schema))
            got += hi - lo
        if got < b - a:
            tables.append(pa.Table.from_arrays([pa.nulls(b - a - got, f.type) for f in self.schema], schema=self.schema))
        return pa.concat_tables(tables)


def _zipped(spark: SparkSession, root: str, table: Table, need: list[Column], keys: list[str], tests: list[tuple[Column, str, object]] = ()) -> DataFrame:
    """Tasks of about equal numbers of rows, in order: each sets the groups' columns side by side, range by range of at most a row group's
    rows. Small partitions share a task. A range that the statistics of some group's row groups rule out by tests is left out unread."""
    import numpy as np

    active = [g for g in table.groups if any(c.group == g.name for c in need)]
    schema = StructType([StructField(c.name, c.type) for c in need])
    arrow = to_arrow(schema)
    fields = {g.name: to_arrow(StructType([f for f in g.schema if f.name in {c.source for c in need if c.group == g.name}])) for g in active}
    sources = [(c.group, c.source) for c in need]
    checks = {g.name: [(c.source, op, v) for c, op, value in tests if c.group == g.name and (v := converted(value, c.type)) is not None] for g in active}

    # A range carries only the parts of its own partition that meet it.
    def meeting(parts: list[Part], a: int, b: int) -> list[tuple[str, int, int]]:
        return [(p.path, p.start, p.rows) for p in parts if p.rows and p.start < b and p.start + p.rows > a]

    total = sum(table.index.rows(k) for k in keys)
    step = max(ROWS_PER_GROUP // 4, min(ROWS_PER_PART, -(-total // (2 * spark.sparkContext.defaultParallelism))))
    tasks: list[list[tuple]] = []
    room = 0
    for k in keys:
        rows = table.index.rows(k)
        for a in range(0, rows, ROWS_PER_GROUP):
            b = min(a + ROWS_PER_GROUP, rows)
            if room < (b - a) // 2 or not tasks:
                tasks.append([])
                room = step
            room -= b - a
            tasks[-1].append((table.starts[k], a, b, k.partition("=")[2], {g.name: meeting(g.partitions.get(k, []), a, b) for g in active}))
    if not tasks:
        return _empty(spark, need)
    shared = spark.sparkContext.broadcast(tasks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = filesystem(root)
        for task in (t for batch in batches for t in batch.column(0).to_pylist()):
            readers: dict[str, RowReader] = {}
            for start, a, b, value, parts in shared.value[task]:
                for n, own in parts.items():
                    old = readers.get(n)
                    readers[n] = RowReader(store, own, fields[n])
                    readers[n].open = old.open if old else {}  # the last file may go on
                if not all(x.may_hold(a, b, checks[n]) for n, x in readers.items() if checks[n]):
                    continue
                found = {n: x.read(a, b) for n, x in readers.items()}
                columns = []
                for (group, source), f in zip(sources, arrow, strict=True):
                    if group == PARTITION:
                        columns.append(pa.repeat(pa.scalar(value, f.type), b - a))
                    elif group == ROW:
                        columns.append(pa.array(np.arange(start + a, start + b), f.type))
                    else:
                        columns.append(found[group].column(source).cast(f.type))
                yield from pa.Table.from_arrays(columns, schema=arrow).combine_chunks().to_batches(max_chunksize=1 << 15)

    return spark.range(0, len(tasks), 1, len(tasks)).mapInArrow(run, schema)
