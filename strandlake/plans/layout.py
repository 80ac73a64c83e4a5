"""The directory layout is the catalog: table / group / partition / part. Discovery and its checks; Spark is only used for footers, where they are many.

    <root>/<table>/index/month=2026-07/0000-0000002000.parquet
    <root>/<table>/<lv1>/<lv2>/month=2026-07/0000-0000002000.parquet

Row N of a partition is row N of every group there; a group with fewer rows ends in NULLs.
"""

from __future__ import annotations

import calendar
import datetime as dt
import re
from collections import OrderedDict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.types import DateType, StringType, StructType, TimestampNTZType, TimestampType

from ..functions.types import from_arrow

ROWS_PER_GROUP, GROUPS_PER_PART = 131_072, 8
ROWS_PER_PART = ROWS_PER_GROUP * GROUPS_PER_PART
INDEX = "index"
PART = re.compile(r"^(\d{4})-(\d{10})\.parquet$")
#: Partition kinds and the format of their values.
KINDS = {"year": (r"\d{4}", "%Y", "yyyy"), "month": (r"\d{4}-\d{2}", "%Y-%m", "yyyy-MM"), "date": (r"\d{4}-\d{2}-\d{2}", "%Y-%m-%d", "yyyy-MM-dd")}


class LayoutError(ValueError):
    pass


def part_name(index: int, rows: int) -> str:
    return f"{index:04d}-{rows:010d}.parquet"


def parse_part(name: str) -> tuple[int, int]:
    if not (m := PART.match(name)):
        raise LayoutError(f"'{name}' is not a self-describing part name ({{index}}-{{rows}}.parquet)")
    return int(m[1]), int(m[2])


def partition_kind(template: str) -> str:
    """'month', 'month=%Y-%m' and 'month=2026-07' all name the kind month."""
    kind = template.partition("=")[0].strip().lower()
    if kind not in KINDS:
        raise LayoutError(f"unknown partition template '{template}': use year, month or date")
    return kind


def partition_period(key: str) -> tuple[dt.date, dt.date]:
    """First day, and the day after the last."""
    kind, _, value = key.partition("=")
    if kind not in KINDS or not re.fullmatch(KINDS[kind][0], value):
        raise LayoutError(f"partition '{key}' does not have the form of a {kind} partition")
    try:
        start = dt.datetime.strptime(value, KINDS[kind][1]).date()
    except ValueError as e:
        raise LayoutError(f"partition '{key}': invalid date") from e
    days = {"date": 1, "month": calendar.monthrange(start.year, start.month)[1], "year": 366 if calendar.isleap(start.year) else 365}[kind]
    try:
        return start, start + dt.timedelta(days)
    except OverflowError:
        return start, dt.date.max


def partition_key(kind: str, day: dt.date) -> str:
    return f"{kind}={day.strftime(KINDS[kind][1]) if day.year >= 1000 else day.isoformat()[: {'year': 4, 'month': 7, 'date': 10}[kind]]}"


@dataclass(frozen=True)
class Part:
    path: str
    index: int
    rows: int
    #: Row of the partition that its first row is.
    start: int


@dataclass
class Group:
    name: str
    partitions: dict[str, list[Part]] = field(default_factory=dict)
    schema: StructType = field(default_factory=StructType)
    #: Whether every index row has a row here.
    full: bool = True

    @property
    def dotted(self) -> str:
        return self.name.replace("/", ".")

    def rows(self, key: str) -> int:
        return sum(p.rows for p in self.partitions.get(key, ()))

    def parts(self, keys) -> list[Part]:
        return [p for k in keys for p in self.partitions.get(k, ())]


@dataclass
class Table:
    name: str
    path: str
    groups: list[Group]
    #: Row of the table that each partition's first row is, in order of the keys.
    starts: dict[str, int]
    rows: int
    kind: str

    @property
    def index(self) -> Group:
        return self.groups[0]

    @property
    def keys(self) -> tuple[str, str]:
        return self.index.schema[0].name, self.index.schema[1].name

    def group(self, name: str) -> Group | None:
        return next((g for g in self.groups if g.name.lower() == name.lower()), None)


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store that a path or URI is in, and the path there. file:/x and file:///x are local."""
    if re.match(r"^file:/+", path):
        path = "/" + re.sub(r"^file:/+", "", path)
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    import os

    return pafs.LocalFileSystem(), os.path.abspath(path)


def group_name(name: str) -> str:
    name = name.strip().strip("/")
    parts = name.split("/")
    if name.lower() == INDEX:
        return INDEX
    if len(parts) != 2 or not all(re.fullmatch(r"[^.=_/][^.=/]*", p) for p in parts):
        raise LayoutError(f"group '{name}' must be 'index' or a two-level path lv1/lv2")
    return name


def discover(root: str, name: str) -> Table:
    """The plan of a table from one recursive listing, and the footers of each partition's and group's last part that are new or have changed."""
    store, base = filesystem(root)
    path = f"{base.rstrip('/')}/{name}"
    if store.get_file_info(path).type != pafs.FileType.Directory:
        raise LayoutError(f"table '{name}' does not exist under '{root}'")
    groups: dict[str, Group] = {}
    listed = [i for i in store.get_file_info(pafs.FileSelector(path, recursive=True)) if i.type == pafs.FileType.File]
    stamps = {i.path: (i.mtime_ns, i.size) for i in listed}
    for file in sorted(stamps):
        steps = file[len(path) :].lstrip("/").split("/")
        if any(s[0] in "._" for s in steps) or not steps[-1].endswith(".parquet"):
            continue
        places = [i for i, s in enumerate(steps[:-1]) if "=" in s]
        if len(places) != 1 or places[0] != len(steps) - 2:
            raise LayoutError(f"'{'/'.join(steps)}' must lie in one partition directory below its group")
        own = group_name("/".join(steps[: places[0]]))
        index, rows = parse_part(steps[-1])
        group = groups.setdefault(own, Group(own))
        parts = group.partitions.setdefault(steps[places[0]], [])
        parts.append(Part(file, index, rows, sum(p.rows for p in parts)))
    if INDEX not in groups:
        raise LayoutError(f"table '{name}': mandatory group 'index' is missing")
    index = groups.pop(INDEX)
    kinds = {k.partition("=")[0] for g in (index, *groups.values()) for k in g.partitions}
    if len(kinds) != 1:
        raise LayoutError(f"table '{name}': inconsistent partition kinds {sorted(kinds)}")
    for g in (index, *groups.values()):
        for key in g.partitions:
            partition_period(key)
    for key, parts in index.partitions.items():
        if [p.index for p in parts] != list(range(len(parts))):
            raise LayoutError(f"table '{name}': index parts of '{key}' must be consecutive from 0000")
    keys = sorted(index.partitions)
    for g in groups.values():
        for key in g.partitions:
            if key not in index.partitions:
                raise LayoutError(f"group '{g.name}' has partition '{key}' that the index group does not have")
            if g.rows(key) > index.rows(key):
                raise LayoutError(f"group '{g.name}', partition '{key}': {g.rows(key)} rows, but the index has {index.rows(key)}; row counts must agree")
        g.full = all(g.rows(k) == index.rows(k) for k in keys)
    starts, at = {}, 0
    for k in keys:
        starts[k] = at
        at += index.rows(k)
    table = Table(name, path, [index, *(groups[n] for n in sorted(groups))], starts, at, kinds.pop())
    lasts = {g.name: [g.partitions[k][-1] for k in sorted(g.partitions, reverse=True)] for g in table.groups}
    found = footers(root, [p for parts in lasts.values() for p in parts], stamps)
    for g in table.groups:
        g.schema = _schema(g, [found[p.path] for p in lasts[g.name]])
    check_keys(index.schema, reading=True)
    return table


#: Schemas by root, path, time of change and size of a part, so that a scan opens only footers that are new; the oldest go first.
_footers: OrderedDict[tuple, StructType] = OrderedDict()
FOOTERS_KEPT, FOOTERS_BY_DRIVER = 200_000, 2_000


def footers(root: str, parts: list[Part], stamps: dict[str, tuple]) -> dict[str, StructType]:
    """Schemas of parts by path. Footers that aren't known yet are read by threads, or by tasks where they are many and there is a session."""
    at = {p.path: (root, p.path, *stamps[p.path]) for p in parts}
    new = [p for p in parts if at[p.path] not in _footers]
    spark = SparkSession.getActiveSession() if len(new) > FOOTERS_BY_DRIVER else None
    if spark is not None:

        def run(batches):
            store, _ = filesystem(root)
            for batch in batches:
                for row in batch.to_pylist():
                    schema = _footer(store, row["path"], row["rows"])
                    yield pa.RecordBatch.from_arrays([pa.array([row["path"]]), pa.array([schema.serialize().to_pybytes()], pa.binary())], names=["path", "schema"])

        frame = spark.createDataFrame([(p.path, p.rows) for p in new], "path string, rows long").repartition(max(1, min(len(new) // 100, 1000)))
        read = {r["path"]: pa.ipc.read_schema(pa.py_buffer(bytes(r["schema"]))) for r in frame.mapInArrow(run, "path string, schema binary").collect()}  # a row for each footer
    else:
        store, _ = filesystem(root)
        with ThreadPoolExecutor(16) as pool:
            read = dict(zip((p.path for p in new), pool.map(lambda p: _footer(store, p.path, p.rows), new), strict=True))
    for path, schema in read.items():
        _footers[at[path]] = from_arrow(schema)
    out = {}
    for p in parts:
        _footers.move_to_end(at[p.path])
        out[p.path] = _footers[at[p.path]]
    while len(_footers) > FOOTERS_KEPT:
        _footers.popitem(last=False)
    return out


def _footer(store: pafs.FileSystem, path: str, rows: int) -> pa.Schema:
    meta = pq.read_metadata(path, filesystem=store)
    if meta.num_rows != rows:
        raise LayoutError(f"'{path}': its name says {rows} rows, its footer {meta.num_rows}; they must agree")
    return meta.schema.to_arrow_schema().remove_metadata()


def _schema(group: Group, found: list[StructType]) -> StructType:
    """Columns of the last part, then those that only the last parts of earlier partitions have; one column, one type."""
    out: dict[str, object] = {}
    for schema in found:
        for f in schema:
            old = out.setdefault(f.name.lower(), f)
            if old.dataType != f.dataType:
                raise LayoutError(f"group '{group.name}': column '{f.name}' is {old.dataType.simpleString()} in one part and {f.dataType.simpleString()} in another")
    return StructType(list(out.values()))


def check_keys(schema: StructType, reading: bool = False) -> None:
    if len(schema) < 2:
        raise LayoutError("the second column must be DATE or TIMESTAMP, but the index has fewer than two" if reading else "at least 2 columns required: one VARCHAR and one DATE or TIMESTAMP key")
    text, time = (isinstance(f.dataType, t) for f, t in zip(schema[:2], (StringType, (DateType, TimestampType, TimestampNTZType)), strict=True))
    if reading and not time:
        raise LayoutError(f"the second column must be DATE or TIMESTAMP, not {schema[1].dataType.simpleString()}")
    if not reading and isinstance(schema[1].dataType, TimestampType):
        raise LayoutError("a key of instants has no day of its own; use TIMESTAMP (without time zone)")
    if not (text and time):
        raise LayoutError("the first two columns must be exactly one VARCHAR (first) and one DATE or TIMESTAMP (second)")
