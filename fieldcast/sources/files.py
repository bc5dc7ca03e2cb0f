"""Discovery and delimited text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

CODE_PAGE_932 = "windows-31j"


def file_name() -> Column:
    return F.col("_metadata.file_name")


def matching(df: DataFrame, pattern: str) -> DataFrame:
    """Rows of a file scan whose file name matches a regular expression."""
    return df.where(F.col("_metadata.file_name").rlike(pattern))


def list_files(spark: SparkSession, folder: str, pattern: str, glob: str = "*") -> DataFrame:
    """(path, name, length) of the files of a folder that match ``pattern``."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .load(folder)
        .select("path", "length")
    )
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1))
    return named.where(F.url_decode("name").rlike(pattern)).select("path", "name", "length")


def read_tsv(
    spark: SparkSession, path: str, schema: T.StructType | str, glob: str = "*"
) -> DataFrame:
    """Tab-separated text with a header and a declared schema.

    Text that does not fit its type becomes null.
    """
    return (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("mode", "PERMISSIVE")
        .option("nullValue", "NA")
        .option("pathGlobFilter", glob)
        .csv(path)
    )


def read_code_page(
    spark: SparkSession, path: str, schema: T.StructType | str, glob: str = "*"
) -> DataFrame:
    """Tab-separated text in code page 932.

    Spark only reads this encoding with the session setting
    ``spark.sql.legacy.javaCharsets``, which is switched on here.
    """
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    return (
        spark.read.schema(schema)
        .option("sep", "\t")
        .option("header", True)
        .option("encoding", CODE_PAGE_932)
        .option("nullValue", "NA")
        .option("ignoreTrailingWhiteSpace", False)
        .option("pathGlobFilter", glob)
        .csv(path)
    )


def period_of(name: Column, pattern: str) -> Column:
    """``yymm`` tag from a file name: the first two groups of ``pattern``."""
    year = F.regexp_extract(name, pattern, 1)
    month = F.regexp_extract(name, pattern, 2)
    tag = F.concat(F.substring(year, -2, 2), month)
    return F.when(F.length(tag) == 4, tag)


def write_tsv(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite").option("sep", "\t").option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.option("nullValue", "NA").csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
