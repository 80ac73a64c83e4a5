"""Output columns of a scan: bare and qualified names, shadowed and duplicated columns, the partition column and the row number."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql.types import DataType, LongType, StringType

from .layout import INDEX, Group, Table

PARTITION, ROW = "<partition>", "<row>"


@dataclass(frozen=True)
class Column:
    name: str
    #: Group name, or PARTITION or ROW.
    group: str
    source: str
    type: DataType
    #: A second name of a column that also has its bare one.
    alias: bool = False
    hidden: bool = False


def selected(table: Table, groups: list[str] | str | None) -> list[Group]:
    """The index, and the named groups that exist; without names all."""
    if isinstance(groups, str):
        groups = groups.split(",")
    names = {g.strip().lower() for g in groups or () if g.strip()}
    return [g for g in table.groups if g.name == INDEX or not names or g.name.lower() in names]


def resolve(table: Table, groups: list[str] | str | None = None, aliases: bool = True) -> list[Column]:
    """aliases: as in a table scan, qualified names beside bare ones, and the partition column shown; else as in the catalog."""
    own = selected(table, groups)
    index = {f.name.lower() for f in own[0].schema}
    owners = Counter(f.name.lower() for g in own[1:] for f in g.schema)
    out = [Column(f.name, INDEX, f.name, f.dataType) for f in own[0].schema]
    for g in own[1:]:
        for f in g.schema:
            if f.name.lower() in index:
                continue
            long = f"{g.dotted}.{f.name}"
            if owners[f.name.lower()] > 1:
                out.append(Column(long, g.name, f.name, f.dataType))
            else:
                out.append(Column(f.name, g.name, f.name, f.dataType))
                if aliases:
                    out.append(Column(long, g.name, f.name, f.dataType, alias=True))
    taken = {c.name.lower() for c in out}
    if table.kind not in taken:
        out.append(Column(table.kind, PARTITION, table.kind, StringType(), hidden=not aliases))
    if "rowid" not in taken:
        out.append(Column("rowid", ROW, "rowid", LongType(), hidden=True))
    return out


def mapping(table: Table) -> list[tuple[str, str]]:
    """Queryable name and its lv1.lv2.column, of the columns outside the index."""
    return [(c.name, f"{table.group(c.group).dotted}.{c.source}") for c in resolve(table, aliases=False) if c.group not in (INDEX, PARTITION, ROW)]
