"""Table functions for SQL: lake_groups(root, table) and lake_meta(root, table); and settings as columns."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..plans.layout import discover
from .meta import META, groups_rows, meta_row


class Groups:
    def eval(self, root: str, table: str) -> Iterator[tuple]:
        yield from groups_rows(discover(root, table))


class Meta:
    def eval(self, root: str, table: str) -> Iterator[tuple]:
        yield meta_row(discover(root, table))


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session: SELECT * FROM lake_groups('/data/lake', 'panel')."""
    spark.udtf.register("lake_groups", F.udtf(Groups, returnType="group_name string, columns string, partition_count long"))
    spark.udtf.register("lake_meta", F.udtf(Meta, returnType=META))


def current_setting(spark: SparkSession, name: str) -> Column:
    """A setting of the session as a column; an error where it is unset."""
    return F.lit(spark.conf.get(name))
