"""Small tables that are part of the program."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def constant_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Rows given in code, as literals of the plan (no Python data source)."""
    fields = T.StructType.fromDDL(schema).fields
    structs = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)])
        for row in rows
    ]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*structs)))
