"""Tables and queries of a database through JDBC, with logical types from the SQL types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ShapeMismatch
from ..functions import types as L
from ..plans.frame import Frame

SQL_TYPES = {
    "int": "int", "integer": "int", "smallint": "int", "bigint": "wide", "tinyint": "byte", "float": "double", "real": "double",
    "double": "double", "decimal": "double", "numeric": "double", "bit": "boolean", "boolean": "boolean",
}


def logical_type(sql_type: str, nullable: bool = False) -> str:
    """The logical type of a SQL type; nullable columns and all other types are ``any``."""
    return "any" if nullable else SQL_TYPES.get(sql_type.lower().split("(")[0].strip(), "any")


def _of_spark(t: T.DataType) -> str:
    kinds = {T.ByteType: "byte", T.ShortType: "int", T.IntegerType: "int", T.LongType: "wide", T.FloatType: "double", T.DoubleType: "double", T.DecimalType: "double", T.BooleanType: "boolean"}
    return kinds.get(type(t), "any")


def typed_rows(df: DataFrame, nullable: Sequence[str] = ()) -> DataFrame:
    """A result set with logical types; a null becomes the empty text of an ``any`` column."""
    out = []
    for f in df.schema.fields:
        t = "any" if f.name in nullable else _of_spark(f.dataType)
        c = F.coalesce(L.as_text(F.col(f.name), "boolean" if isinstance(f.dataType, T.BooleanType) else "any"), F.lit("")) if t == "any" else F.col(f.name)
        out.append(L.typed(c, t, f.name))
    return df.select(*out)


def db_import(spark: SparkSession, url: str, table: str, columns: Sequence[str] | None = None, *, nullable: Sequence[str] = (), order: Sequence[str] | None = None, partition: dict | None = None, **options: str) -> Frame:
    """A database table, reading only ``columns``; ``partition`` (column, lowerBound, upperBound, numPartitions) reads in parallel."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition:
        reader = reader.options(partitionColumn=partition["column"], **{k: str(v) for k, v in partition.items() if k != "column"})
    df = reader.load()
    df = typed_rows(df.select(*columns) if columns else df, nullable)
    return Frame(df, order or df.columns)


def append_rows(frame: Frame, result: DataFrame, nullable: Sequence[str] = ()) -> Frame:
    """The frame with a result set's rows after its own; nothing changes if the result can't be read."""
    from ..operators.mutate import put

    rows = typed_rows(result, nullable)
    if len(rows.columns) != frame.width:
        raise ShapeMismatch(f"the result has {len(rows.columns)} columns, not {frame.width}")
    named = rows.toDF(*frame.names)
    return put(frame, Frame(named, frame.names), "end")
