"""Small driver-made tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table from a bounded list of rows, as one Arrow batch in the plan (no Python at run time)."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], schema).schema
    kinds = {"string": pa.string(), "double": pa.float64(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    columns = list(zip(*rows)) if rows else [[] for _ in fields]
    table = pa.table({f.name: pa.array(list(column), type=kinds[f.dataType.simpleString()]) for f, column in zip(fields, columns)})
    return spark.createDataFrame(table)
