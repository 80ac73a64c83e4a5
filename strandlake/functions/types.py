"""Column types: DDL text, the names that metadata prints, and Arrow and Spark schemas."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import DataType, StructType

#: The type names of the DDL, and what Spark calls them.
DDL_TYPES = {
    "BOOLEAN": "boolean", "BOOL": "boolean", "TINYINT": "tinyint", "SMALLINT": "smallint", "INTEGER": "int", "INT": "int", "BIGINT": "bigint", "HUGEINT": "decimal(38,0)",
    "FLOAT": "float", "REAL": "float", "DOUBLE": "double", "VARCHAR": "string", "TEXT": "string", "STRING": "string", "DATE": "date", "TIMESTAMP": "timestamp_ntz",
}
#: The names that metadata prints.
PRINTED = {"boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "timestamp_ntz": "TIMESTAMP", "decimal(38,0)": "HUGEINT"}


def spark_type(name: str) -> str:
    name = name.strip().upper()
    if name == "TIME":
        raise ValueError("TIME columns are not supported; store microseconds as BIGINT")
    if name.startswith(("DECIMAL", "NUMERIC")):
        return name.replace("NUMERIC", "DECIMAL").lower()
    if name not in DDL_TYPES:
        raise ValueError(f"unknown column type '{name}'")
    return DDL_TYPES[name]


def parse_columns(ddl: str | StructType) -> StructType:
    """'symbol VARCHAR, date DATE, close DOUBLE' as a StructType."""
    if isinstance(ddl, StructType):
        return ddl
    out = StructType()
    for item in re.split(r",(?![^(]*\))", ddl):
        name, _, kind = item.strip().partition(" ")
        if not name or not kind.strip():
            raise ValueError(f"cannot parse column definition '{item.strip()}'")
        out.add(name.strip('"`'), DataType.fromDDL(spark_type(kind)))
    return out


def printed(kind: DataType) -> str:
    return PRINTED.get(kind.simpleString(), kind.simpleString().upper())


def from_arrow(schema: pa.Schema) -> StructType:
    return from_arrow_schema(schema, prefer_timestamp_ntz=True)


def to_arrow(schema: StructType) -> pa.Schema:
    return to_arrow_schema(schema)
