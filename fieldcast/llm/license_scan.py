"""Licence scans by diagonal voting.

Templates are short notices and phrases. Spark joins the hashes of all runs of K words of all texts with the template
positions that have the same run; a hit at word `pos` of a text and word `at` of a template votes for the diagonal
`pos - at`. Votes are aggregated by (text, template, diagonal), neighbouring diagonals are merged, because inserted or
left-out words shift a notice, and a span is verified by the share of the template's words that its hits cover.

Hits compare two independent 64-bit hashes of the words, so a covered word is an equal word. A base phrase is found
where one diagonal covers it whole, which is where its words stand consecutively.

The templates are part of the program and are broadcast; the hits of one text meet in one task, nothing else does.
Null text counts as empty: no words, no labels, score 0. Every row gives a row, repeated ones and rows with null ids
too. An empty table gives an empty result; other columns stay out of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldcast.llm.common import arrow_map
from fieldcast.llm.words import NO_LETTER_OR_DIGIT, runs, shingle_hash, texts_of

#: words of a run
K = 3
#: diagonals at most this far apart are merged
GAP = 4
#: share of a template's words that a verified span covers
COVERED = 0.8

#: phrase, label: found where the words stand consecutively
BASE = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: notices, found by voting
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("gnu general public license as published by the free software foundation", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("creative commons attribution sharealike 4 0 international license", "cc-by-sa"),
    ("all rights reserved", "all-rights-reserved"),
)


def templates() -> list[tuple[list[str], str, bool]]:
    return [(p.split(), label, base) for found, base in ((BASE, True), (NOTICES, False)) for p, label in found]


def run_hashes(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of slices of a column: (a, b, words of each text, text of each run, its first word, its two hashes)."""
    for a, b, texts in texts_of(column, NO_LETTER_OR_DIGIT, lower=True):
        n = np.maximum(texts.n_words - K + 1, 0)
        at = runs(texts.first, n)
        of = np.repeat(np.arange(len(n)), n)
        h = [shingle_hash(texts.word_hashes(kind), at, K).view(np.int64) for kind in (0, 1)]
        yield a, b, texts.n_words, of, at - texts.first[of], h[0], h[1]


def template_runs(spark: SparkSession) -> DataFrame:
    """(h1, h2, template, at) of all runs of the templates, and the row that text markers meet."""
    rows = [(0, 0, -1, 0)]
    words = [" ".join(t) for t, _, _ in templates()]
    for _, _, _, of, at, h1, h2 in run_hashes(pa.array(words)):
        rows += zip(h1.tolist(), h2.tolist(), of.tolist(), at.tolist())
    return spark.createDataFrame(rows, "h1 long, h2 long, template int, at int")


def judge(hits: list[tuple[int, int, list[int]]]) -> tuple[list[int], set[str], set[str], float]:
    """Starts of base places, base labels, all labels, best share; hits are (template, diagonal, covered runs)."""
    places: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    best = 0.0
    by_template: dict[int, list[tuple[int, list[int]]]] = {}
    for template, diagonal, at in hits:
        by_template.setdefault(template, []).append((diagonal, at))
    known = templates()
    for template, found in by_template.items():
        words, label, is_base = known[template]
        if is_base:
            starts = [d for d, at in found if len(set(at)) == len(words) - K + 1]
            if starts:
                places += starts
                base.add(label)
                best = 1.0
        found.sort()
        merged: list[tuple[int, set[int]]] = []
        for diagonal, at in found:
            covered = {i + k for i in at for k in range(K)}
            if merged and diagonal - merged[-1][0] <= GAP:
                merged[-1] = (diagonal, merged[-1][1] | covered)
            else:
                merged.append((diagonal, covered))
        share = max(len(covered) for _, covered in merged) / len(words)
        best = max(best, share)
        if share >= COVERED and not is_base:
            labels.add(label)
    return places, base, labels | base, best


def scan(documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    spark = documents.sparkSession
    rows = documents.select(
        F.col(id_column).alias("id"), F.col(text_column).alias("text"), F.monotonically_increasing_id().alias("row")
    )
    kind = rows.schema["id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "id", "pos", "h1", "h2"]
        for batch in batches:
            ids, number = batch.column(0), batch.column(2).to_numpy()
            for a, b, n_words, of, at, h1, h2 in run_hashes(batch.column(1)):
                zero = pa.array(np.zeros(b - a, np.int64))
                marker = [pa.array(number[a:b]), ids.slice(a, b - a), pa.array(n_words.astype(np.int64)), zero, zero]
                yield pa.RecordBatch.from_arrays(marker, names=names)
                runs_ = [pa.array(number[a:b][of]), pa.nulls(len(of), ids.type), pa.array(at), pa.array(h1), pa.array(h2)]
                yield pa.RecordBatch.from_arrays(runs_, names=names)

    grams = arrow_map(rows, cut, f"row long, id {kind}, pos long, h1 long, h2 long")
    hits = grams.join(F.broadcast(template_runs(spark)), ["h1", "h2"])
    votes = hits.groupBy("row", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("runs"), F.max("id").alias("id")
    )
    vote = F.struct("template", "diagonal", "runs")
    texts = votes.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max(F.when(F.col("template") < 0, F.col("diagonal"))).alias("n_words"),
        F.collect_list(F.when(F.col("template") >= 0, vote)).alias("votes"),
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [judge([(v["template"], v["diagonal"], v["runs"]) for v in x]) for x in batch.column(2).to_pylist()]
            places = [x[0] for x in out]
            columns = [
                batch.column(0),
                batch.column(1),
                pa.array([len(p) for p in places], pa.int64()),
                pa.array([min(p) if p else None for p in places], pa.int64()),
                pa.array([max(p) if p else None for p in places], pa.int64()),
                *(pa.array([",".join(sorted(x[i])) for x in out], pa.string()) for i in (1, 2)),
                pa.array([x[3] for x in out], pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [kind, *["long"] * 4, "string", "string", "double"]
    schema = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    out = arrow_map(texts.select("id", "n_words", "votes"), verify, schema)
    return out.withColumnRenamed("id", id_column)
