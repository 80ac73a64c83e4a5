"""An attached root: its tables as DataFrames and views, SQL over them, and the statements that a column-group table refuses."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from ..functions import meta as metadata
from ..plans.layout import LayoutError, Table, discover, filesystem
from ..plans.names import ROW, Column, resolve
from ..plans.pruning import Comparison, comparisons_in, kept_partitions
from ..sources.scan import scan_table
from . import manage
from .write import write

#: Statements that the catalog rejects.
REJECTED = ("insert", "update", "delete", "create_table_as", "create_schema", "create_view", "create_index", "create_sequence", "create_function", "create_type", "drop_entry", "alter")


class Catalog:
    def __init__(self, spark: SparkSession, root: str, alias: str, strategy: str = "auto"):
        self.spark, self.root, self.alias, self.strategy = spark, root.removeprefix("lake:"), alias, strategy
        self._known: dict[str, Table] | None = None
        self._views: set[str] = set()

    def refresh(self) -> None:
        """Looks at the root again; tables with a broken layout and hidden directories are left out."""
        store, base = filesystem(self.root)
        self._known = {}
        if store.get_file_info(base).type != pafs.FileType.Directory:
            raise LayoutError(f"data root '{self.root}' does not exist")
        for i in store.get_file_info(pafs.FileSelector(base)):
            if i.type == pafs.FileType.Directory and i.base_name[0] not in "._":
                try:
                    self._known[i.base_name.lower()] = discover(self.root, i.base_name)
                except LayoutError:
                    continue

    def plan(self, name: str) -> Table:
        """The table's plan as it is now; a name that isn't known is looked for on disk."""
        if self._known is None:
            self.refresh()
        own = self._known.get(name.lower())
        table = discover(self.root, own.name if own else name)
        self._known[name.lower()] = table
        return table

    def tables(self) -> DataFrame:
        self.refresh()
        return self.spark.createDataFrame([(self.alias, "main", t.name, "BASE TABLE") for t in self._known.values()], "table_catalog string, table_schema string, table_name string, table_type string")

    def table(self, name: str, *, columns: list[str] | None = None, where: str | list[Comparison] | None = None, rowid: bool = False) -> DataFrame:
        """As the catalog shows it: no aliases, partition column and rowid only where named."""
        table = self.plan(name)
        return scan_table(self.spark, self.root, table, resolve(table, aliases=False), columns, where, rowid, self.strategy)

    def create_view(self, name: str) -> str:
        view = f"{self.alias}_{name}"
        self.table(name).createOrReplaceTempView(view)
        self._views.add(view)
        return view

    def sql(self, query: str) -> DataFrame:
        """An SQL query over <alias>.<table> names. Of each table only what the optimized plan uses is opened: its columns
        (with the partition column and rowid), and the partitions that comparisons right above it leave. Where a query names a table
        several times, it is opened once, with what any of them uses. Commands are refused, but for DESCRIBE and EXPLAIN."""
        names = list(dict.fromkeys(m[1] for m in re.finditer(rf"(?<![\w.]){re.escape(self.alias)}\.(?:main\.)?(\w+)", query)))
        text = re.sub(rf"(?<![\w.]){re.escape(self.alias)}\.(?:main\.)?(\w+)", rf"{self.alias}_\1", query)
        reads = self._reads(text)
        plans = {n: self.plan(n) for n in names}
        shown = {n: [c for c in resolve(table, aliases=False) if not c.hidden or re.search(rf"\b{c.name}\b", text)] for n, table in plans.items()}
        used = self._used(text, shown) if reads else {}
        for n, table in plans.items():
            every = resolve(table, aliases=False)
            columns, wheres = used.get(n, ([c.name for c in shown[n]], [[]]))
            # Rows that no occurrence needs stay out: one of several occurrences has no say alone, so only partitions are left out then.
            keys = [k for k in table.starts if any(k in kept for kept in [set(kept_partitions(table, w)) for w in wheres])]
            where = [x for x in wheres[0] if x[0].lower() in {c.lower() for c in columns}] if len(wheres) == 1 else []
            kept = scan_table(self.spark, self.root, table, every, columns or ["rowid" if "rowid" in {c.name for c in every if c.group == ROW} else table.keys[0]], where, False, self.strategy, keys)
            kept.createOrReplaceTempView(f"{self.alias}_{n}")
            self._views.add(f"{self.alias}_{n}")
        return self.spark.sql(text)

    def _reads(self, text: str) -> bool:
        """Whether the text is a query; False for the commands that only describe one. Others raise before anything runs."""
        command = self.spark._jvm.java.lang.Class.forName("org.apache.spark.sql.catalyst.plans.logical.Command")

        def walk(node) -> bool:
            kind = node.getClass().getSimpleName()
            if kind in ("DescribeRelation", "DescribeQueryCommand", "ExplainCommand"):
                return False
            if command.isInstance(node) or kind in ("InsertIntoStatement", "UnresolvedExecuteImmediate"):
                raise NotImplementedError(f"{kind} is not supported on column-group tables; use write() and the create, compact and drop functions")
            return all([walk(c) for c in _each(node.children())])

        return walk(self.spark._jsparkSession.sessionState().sqlParser().parsePlan(text))

    def _used(self, text: str, shown: dict[str, list[Column]]) -> dict[str, tuple[list[str], list[list[Comparison]]]]:
        """Columns, and comparisons of each occurrence, by table, from the optimized plan over empty stand-ins. Where it can't tell, nothing is left out."""
        for n, columns in shown.items():
            schema = StructType([StructField(c.name, c.type) for c in columns])
            self.spark.createDataFrame(self.spark.sparkContext.emptyRDD(), schema).createOrReplaceTempView(f"{self.alias}_{n}")
        try:
            plan = self.spark.sql(text)._jdf.queryExecution().optimizedPlan()
            leaves, needed, filters = [], {_id(a) for a in _each(plan.output())}, []

            def walk(node) -> None:
                children = list(_each(node.children()))
                if not children:
                    leaves.append(node)
                    return
                needed.update(_id(a) for a in _each(node.references().toSeq()))
                if node.getClass().getSimpleName() == "Filter" and not list(_each(children[0].children())):
                    filters.append((children[0], node.condition()))
                # Plans within expressions (scalar, IN and ARRAY subqueries that the optimizer left there).
                for c in [*children, *_each(node.subqueries())]:
                    walk(c)

            walk(plan)
            names = {n: [c.name for c in columns] for n, columns in shown.items()}
            out: dict[str, tuple[list[str], list[list[Comparison]]]] = {}
            for n, own in names.items():
                mine = [x for x in leaves if [a.name() for a in _each(x.output())] == own and x.getClass().getSimpleName() == "LogicalRDD"]
                if not mine or list(names.values()).count(own) > 1:
                    continue
                columns = [c for i, c in enumerate(own) if any(_id(x.output().apply(i)) in needed for x in mine)]
                out[n] = columns, [[c for leaf, condition in filters if leaf.equals(x) for c in comparisons_in(condition)] for x in mine]
            return out
        finally:
            for n in shown:
                self.spark.catalog.dropTempView(f"{self.alias}_{n}")

    def create_table(self, name: str, columns: str | StructType, *, groups: str | dict | None = None, partition_template: str = "month", partition: str | None = None, **more) -> manage.Created:
        """A new table; of one that exists, its new partition or new groups."""
        store, base = filesystem(self.root)
        exists = store.get_file_info(f"{base.rstrip('/')}/{name}/index").type != pafs.FileType.NotFound
        if partition:
            out = manage.create_partition(self.root, name, partition)
        elif exists and groups:
            schema = metadata_columns(columns)
            known = {g.name for g in discover(self.root, name).groups}
            fresh = {g: c for g, c in manage.parse_groups(groups).items() if g not in known}
            if not fresh:
                raise LayoutError(f"table '{name}': its groups already exist")
            done = [manage.create_group(self.root, name, g, StructType([_field(schema, c, g) for c in names])) for g, names in fresh.items()]
            out = manage.Created(sum(d.dirs_created for d in done), sum(d.files_created for d in done), done[-1].txid)
        else:
            out = manage.create_table(self.root, name, columns, groups=groups, partition_template=partition_template, **more)
        self._known = None
        return out

    def write(self, df: DataFrame, name: str, group: str = "index", **how) -> int:
        return write(df, self.root, name, group, **how)

    def groups(self, name: str) -> DataFrame:
        return metadata.groups(self.spark, self.root, name)

    def meta(self, name: str) -> DataFrame:
        return metadata.meta(self.spark, self.root, name)

    def detach(self) -> None:
        """Drops the views; the files stay."""
        for v in self._views:
            self.spark.catalog.dropTempView(v)
        self._views, self._known = set(), {}


def metadata_columns(columns: str | StructType) -> StructType:
    from ..functions.types import parse_columns

    return parse_columns(columns)


def _field(schema: StructType, name: str, group: str) -> StructField:
    for f in schema:
        if f.name.lower() == name.lower():
            return f
    raise LayoutError(f"group '{group}' references unknown column '{name}'")


def _rejecting(what: str) -> Callable:
    def method(self, *_, **__):
        raise NotImplementedError(f"{what.replace('_', ' ').upper()} is not supported on column-group tables; use write() and the create, compact and drop functions")

    method.__name__ = what
    return method


for _what in REJECTED:
    setattr(Catalog, _what, _rejecting(_what))


def _each(seq):
    for i in range(seq.size()):
        yield seq.apply(i)


def _id(attribute) -> int:
    return attribute.exprId().id()


def attach(spark: SparkSession, root: str, alias: str = "al", strategy: str = "auto") -> Catalog:
    return Catalog(spark, root, alias, strategy)
