"""Element types of arrays: width in bytes and the Spark type that holds them.

Spark has no unsigned and no half-precision types: those are widened.  Complex numbers are structs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: name -> (bytes, Spark type); fixed values
TYPES: dict[str, tuple[int, str]] = {
    "PRED": (1, "boolean"),
    "S8": (1, "tinyint"),
    "U8": (1, "smallint"),
    "S16": (2, "smallint"),
    "U16": (2, "int"),
    "F16": (2, "float"),
    "BF16": (2, "float"),
    "S32": (4, "int"),
    "U32": (4, "bigint"),
    "F32": (4, "float"),
    "S64": (8, "bigint"),
    "U64": (8, "decimal(20,0)"),
    "F64": (8, "double"),
    "C64": (8, "struct<re:float,im:float>"),
    "C128": (16, "struct<re:double,im:double>"),
}


def width(dtype: str) -> int:
    return TYPES[dtype][0]


def type_table(spark: SparkSession) -> DataFrame:
    """Rows (dtype, bytes, spark_type)."""
    return spark.createDataFrame([(k, w, t) for k, (w, t) in TYPES.items()], "dtype string, bytes int, spark_type string")
