"""Small driver-side tables with statistics.

An Arrow table becomes a local relation whose size Spark knows, so joins with it
are broadcast below ``spark.sql.autoBroadcastJoinThreshold`` and shuffled above.
A table built from Python rows has no statistics and would never be broadcast.
"""
from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_PRIMITIVES = {
    T.StringType: pa.string(), T.BooleanType: pa.bool_(), T.IntegerType: pa.int32(),
    T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.DateType: pa.date32(),
    T.TimestampType: pa.timestamp("us", tz="UTC"),
}


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, arrow_type(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return _PRIMITIVES[type(kind)]


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: T.StructType | str) -> DataFrame:
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    rows = list(rows)
    columns = [pa.array([r[i] for r in rows], type=arrow_type(f.dataType))
               for i, f in enumerate(schema.fields)]
    return spark.createDataFrame(
        pa.Table.from_arrays(columns, names=schema.fieldNames()), schema=schema)
