"""CSV report sinks (rules, forecast, forecast summary, insights, inventory plan).

Array columns are written as ``', '``-joined strings, the way the reports show item
sets. Output is a directory of part files written by the executors in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def flatten_arrays(df: DataFrame, sep: str = ", ") -> DataFrame:
    cols = []
    for field in df.schema.fields:
        if isinstance(field.dataType, ArrayType):
            cols.append(F.array_join(F.col(field.name).cast("array<string>"), sep).alias(field.name))
        else:
            cols.append(F.col(field.name))
    return df.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    flatten_arrays(df).write.mode(mode).option("header", True).csv(path)
    return path
