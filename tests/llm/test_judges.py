"""Toxicity and quality: held-out accuracy, base counts against brute force, edge cases; and the pipeline."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from fieldcast.llm import quality, toxicity
from tests.llm import fixtures as X

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark, sf):
    folder = f"{sf}/../sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def brute_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    lines = [line for line in text.split("\n") if WORDS.search(line)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(marked)


def test_base_counts(spark):
    texts = [*X.edge_texts(), "a b c a b c\na b c\n\n a b c\na b c", "x\r\nx\r\nx", "é é é é"]
    df = X.clashing(X.documents(spark, texts))
    rows = quality.quality(df, X.labels(spark)).collect()
    assert len(rows) == len(texts) + 3
    for r in rows:
        want = brute_counts(r.text)
        assert tuple(r[c] for c in quality.COLUMNS) == want
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r.base_failed == failed and r.kept == (not failed)  # without labels the base rules decide
        assert r.label == "own label" and r.row == "own row"
    assert quality.quality(X.documents(spark, []), X.labels(spark)).count() == 0


def test_quality_on_rows_it_has_not_seen(spark, tables):
    docs, labels = tables
    shown = labels.where("doc_id % 3 != 0")
    judged = quality.quality(docs, shown).join(labels.where("doc_id % 3 = 0").withColumnRenamed("quality", "y"), "doc_id")
    rows = judged.where("not base_failed").select("y", "kept").collect()
    assert sum(r.kept == bool(r.y) for r in rows) >= 0.9 * len(rows) > 50


def test_toxicity_on_held_out_rows(spark, tables):
    docs, labels = tables
    big = f"{'/'.join(docs.inputFiles()[0].removeprefix('file:').split('/')[:-2])}/sf0.1"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.toxicity(docs, labels)
    rows = scored.join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", "toxic").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)
    toxic = [r.predicted for r in rows if r.toxic]
    # here toxic words are made of common syllables; on the check tables hardly one of 421 is missed
    assert sum(toxic) >= 0.6 * len(toxic) > 50


def test_toxicity_counts_every_window():
    """As many look-alike words in a long clean text as toxic words in a short toxic one; and the calibration ends."""
    model = toxicity.fit([])
    model.toxic = b" stupid  moron  scum "
    scorer = model.scorer()
    few, many = X.prose(3, 60), X.prose(3, 3000)
    toxic, clean = (scorer.features(f"{text} stupid moron scum") for text in (few, many))
    assert toxic[-1] == clean[-1] > 0.3 and toxic[0] > 20 * clean[0] > 0
    assert scorer.features("") == [0.0] * toxicity.FEATURES
    x = np.column_stack([np.repeat([0.0, 1.0], 50), np.repeat([0.0, 30.0], 50), np.repeat([0.0, 1e-3], 50)])
    y = np.repeat([0.0, 1.0], 50)
    beta = toxicity.calibrate(x, y)
    assert ((x @ beta[:-1] + beta[-1] > 0) == y).all()


def test_toxic_held_out_rows_are_found(spark, tables):
    """91 of the 97 toxic held-out rows hold a toxic word; ordinary words of the same syllables don't count."""
    big = f"{'/'.join(tables[0].inputFiles()[0].removeprefix('file:').split('/')[:-2])}/sf0.1"
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").select("predicted", "toxic").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(toxic) >= 0.88 * len(toxic) > 50 and sum(clean) <= 0.015 * len(clean)


def test_toxicity_edges(spark):
    df = X.clashing(X.documents(spark))
    rows = toxicity.toxicity(df, X.labels(spark)).collect()
    assert len(rows) == df.count() and all(r.score < 1e-9 and r.predicted == 0 for r in rows)
    one = [(5, 1, 0), (8, 1, 1), (8, 1, 0), (None, 1, 1), (9, None, None), (12, 0, 1), (12, 0, 1)]
    rows = toxicity.toxicity(df, X.labels(spark, one)).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.toxicity(X.documents(spark, []), X.labels(spark, one)).count() == 0


def write(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_one_by_one(spark, sf, tmp_path):
    """Each stage on clashing columns, edge rows and an empty table: columns kept, decisions taken."""
    docs = X.clashing(X.documents(spark))
    folder = write(spark, tmp_path / "edge", docs, X.labels(spark, [(5, 1, 0), (12, 0, 1)]))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r.score == "own score" and r.node == "own node" for r in rows)
        assert stage(spark, docs.limit(0), folder).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert pieces.select("doc_id").distinct().count() == 14
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), folder).count() == 0


def test_pipeline_equals_its_operators(spark, sf):
    """run() against the judgements of the operators and brute-force linking of what they keep."""
    from tests.llm.test_groups import brute_join

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = toxicity.toxicity(docs, labels).where("predicted = 0").select(docs.columns)
    good = [(r.doc_id, r.text) for r in quality.quality(clean, labels).where("kept").collect()]
    want = {i for i, _, component in brute_join(good, 5, 80) if i == component}
    got = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in got.select("doc_id").distinct().collect()} == want and len(want) > 20
