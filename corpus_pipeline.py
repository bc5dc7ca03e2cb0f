"""Pipeline over `documents`: toxic and poor documents go, one of each group of near copies stays, the rest is packed.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns a DataFrame, which is
written as Parquet to the shared folder and read again for the next one. All but the last return the columns of
`documents`. Rows with nulls, empty and very long texts, repeated rows, empty tables and extra columns are handled as
the operators say in their docstrings.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm.common import table, written
from fieldcast.llm.ngram_join import keep_one
from fieldcast.llm.packing import pack
from fieldcast.llm.quality import quality
from fieldcast.llm.toxicity import toxicity


def kept(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], condition: str) -> DataFrame:
    """Rows of docs that meet the condition on the columns that `judge` adds; other columns may have the same names."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    extra = "present" + "_" * max(map(len, docs.columns))  # longer than any column's name; the struct is never empty
    narrow = docs.select("doc_id", "text", F.struct(F.lit(True).alias(extra), *others).alias("others"))
    chosen = judge(narrow).where(condition)
    return chosen.select([F.col("others")[c].alias(c) if c in others else F.col(c) for c in docs.columns])


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that compression distance doesn't call toxic."""
    labels = table(spark, sf_dir, "labels")
    return kept(docs, lambda rows: toxicity(rows, labels), "predicted = 0")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the calibrated model."""
    labels = table(spark, sf_dir, "labels")
    return kept(docs, lambda rows: quality(rows, labels), "kept")


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group linked at 0.8 of the five-word shingles."""
    return keep_one(docs, words=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), tokens=2048)


STAGES = [
    ("toxicity", not_toxic),
    ("quality rules", good_quality),
    ("n-gram Jaccard join", one_of_near_copies),
    ("best-fit packing", packed),
]

#: the classifiers and the packing have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
