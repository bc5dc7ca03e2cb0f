"""Posterior draws: sampler output files and the stored long table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fieldcast.functions.text import parse_indexed
from fieldcast.sources.manifest import read_run, write_run

CHAIN_IN_NAME = r"-(\d+)[^-]*\.csv$"


def read_draw_files(spark: SparkSession, path: str, chain_pattern: str = CHAIN_IN_NAME) -> DataFrame:
    """Long draws from per-chain CSV files (``name.i.j`` or ``name[i,j]`` columns).

    The file order gives the iteration.  A file may be split over several
    tasks: rows are numbered inside their split and shifted by the sizes of
    the splits before it, so no chain is gathered in one task.
    """
    # lines as text: the plan is the same for three columns and for a hundred thousand
    lines = spark.read.text(path).where("value <> '' and not startswith(value, '#')").select(
        F.col("_metadata.file_name").alias("__file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
        "value",
    )
    # one row per file; its first line has the names
    first = F.struct("__block", "__id")
    headers = lines.groupBy("__file").agg(F.min_by("value", first).alias("__header"))
    blocks = lines.groupBy("__file", "__block").agg(
        F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    before = Window.partitionBy("__file").orderBy("__block").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = blocks.withColumn(
        "__before", F.coalesce(F.sum("__rows").over(before), F.lit(0))
    ).select("__file", "__block", (F.col("__first") - F.col("__before")).alias("__zero"))
    numbered = lines.join(offsets, ["__file", "__block"]).withColumn(
        "iteration", (F.col("__id") - F.col("__zero")).cast("int")  # the header is line 0
    )
    cells = F.arrays_zip(
        F.split("__header", ",").alias("name"), F.split("value", ",").alias("value")
    )
    rows = (
        numbered.where("iteration > 0")
        .join(headers, "__file")
        .withColumn("chain", F.regexp_extract("__file", chain_pattern, 1).try_cast("int"))
        .select("chain", "iteration", F.inline(cells))
        .where("name is not null and not endswith(name, '__')")
        .withColumn("value", F.col("value").try_cast("double"))
    )
    dotted = r"^(\w+?)\.(\d+)(?:\.(\d+))?$"
    bracketed = F.when(
        F.col("name").rlike(dotted),
        F.concat(
            F.regexp_extract("name", dotted, 1),
            F.lit("["),
            F.regexp_extract("name", dotted, 2),
            F.when(
                F.regexp_extract("name", dotted, 3) != "",
                F.concat(F.lit(","), F.regexp_extract("name", dotted, 3)),
            ).otherwise(""),
            F.lit("]"),
        ),
    ).otherwise(F.col("name"))
    variable, i1, i2 = parse_indexed(bracketed)
    long = rows.select(
        "chain", "iteration", variable.alias("variable"), i1.alias("i1"), i2.alias("i2"), "value"
    )
    longest = offsets_length(blocks)
    return long.withColumn(
        "draw", ((F.col("chain") - 1) * longest.scalar() + F.col("iteration")).cast("int")
    ).select("chain", "iteration", "draw", "variable", "i1", "i2", "value")


def offsets_length(blocks: DataFrame) -> DataFrame:
    """One row: iterations of the longest chain."""
    per_file = blocks.groupBy("__file").agg((F.sum("__rows") - 1).alias("n"))  # without the header
    return per_file.agg(F.max("n"))


def write_draws(draws: DataFrame, path: str, run_id: str) -> None:
    """Store the draws of a run, partitioned so that reading one variable prunes files; see ``manifest``."""
    write_run(draws, path, run_id, ["variable"])


def read_draws(spark: SparkSession, path: str, run_id: str, variables: list[str] | None = None) -> DataFrame:
    rows = read_run(spark, path, run_id)
    if variables is not None:
        rows = rows.where(F.col("variable").isin(variables))
    return rows
