"""Metadata of a table as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.layout import Table, discover
from ..plans.names import PARTITION, ROW, mapping, resolve
from .types import printed


def groups_rows(table: Table) -> list[tuple[str, str, int]]:
    return [(g.name, ";".join(f.name for f in g.schema), len(g.partitions)) for g in table.groups]


def groups(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A row for each group, the index first: group_name, columns (';'-joined), partition_count."""
    return spark.createDataFrame(groups_rows(discover(root, name)), "group_name string, columns string, partition_count long")


META = "table_name string, table_path string, partition_template string, total_rows long, group_count long, partition_count long, part_count long, groups string, partitions string, schema string, column_mapping string"
#: The printed templates.
TEMPLATES = {"year": "year=%Y", "month": "month=%Y-%m", "date": "date=%Y-%m-%d"}


def meta_row(table: Table) -> tuple:
    listed = ";".join(f"{g.name}:{','.join(f.name for f in g.schema)}" for g in table.groups)
    schema = [f"{c.name}:{printed(c.type)}" for c in resolve(table, aliases=False) if c.group not in (PARTITION, ROW)]
    parts = sum(len(p) for g in table.groups for p in g.partitions.values())
    pairs = ";".join(f"{a}:{b}" for a, b in mapping(table))
    return (table.name, table.path, TEMPLATES[table.kind], table.rows, len(table.groups), len(table.starts), parts, listed, ",".join(table.starts), ",".join(schema), pairs)


def meta(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One row of eleven columns on the table."""
    return spark.createDataFrame([meta_row(discover(root, name))], META)
