"""The library's front: a lake of column-group tables under one root."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .functions import meta as metadata
from .operators import manage
from .operators.catalog import Catalog, attach
from .operators.write import write
from .plans.layout import LayoutError, Table, discover
from .sources.scan import scan

#: Session setting of the root, where none is given.
ROOT_SETTING = "strandlake.data_root"


class Lake:
    def __init__(self, spark: SparkSession, root: str | None = None, *, today: Callable[[], dt.date] = dt.date.today):
        root = root or spark.conf.get(ROOT_SETTING, None)
        if not root:
            raise LayoutError(f"no data root configured: give root or set {ROOT_SETTING}")
        self.spark, self.root, self.today = spark, root, today

    def plan(self, name: str) -> Table:
        return discover(self.root, name)

    def scan(self, name: str, groups=None, **how) -> DataFrame:
        return scan(self.spark, self.root, name, groups=groups, **how)

    def count(self, name: str) -> int:
        """Rows of the table, from the part names alone."""
        return self.plan(name).rows

    def write(self, df: DataFrame, name: str, group: str = "index", *, merge: bool = False, **how) -> int:
        return write(df, self.root, name, group, merge=merge, **how)

    def create(self, name: str, group: str = "index", columns=None, *, partition_template: str = "month") -> manage.Created:
        """With 'index' a new table; else a new group of a table, empty without columns."""
        if group.lower() == "index":
            return manage.create_table(self.root, name, columns, partition_template=partition_template, today=self.today)
        return manage.create_group(self.root, name, group, columns)

    def create_table(self, name: str, columns, **how) -> manage.Created:
        return manage.create_table(self.root, name, columns, today=self.today, **how)

    def create_partition(self, name: str, key: str) -> manage.Created:
        return manage.create_partition(self.root, name, key)

    def compact(self, name: str, group: str = "all") -> manage.Compacted:
        return manage.compact(self.spark, self.root, name, group)

    def drop(self, name: str, group: str) -> manage.Dropped:
        return manage.drop(self.root, name, group)

    def groups(self, name: str) -> DataFrame:
        return metadata.groups(self.spark, self.root, name)

    def meta(self, name: str) -> DataFrame:
        return metadata.meta(self.spark, self.root, name)

    def attach(self, alias: str = "al", **how) -> Catalog:
        return attach(self.spark, self.root, alias, **how)
