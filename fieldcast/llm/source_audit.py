"""Source divergence audit: how far the term profiles of sources lie apart, over terms found by iceberg prefix refinement.

1. Refinement. Level by level (4, 8, 16, ... bytes) the terms of all texts are cut to byte prefixes. A prefix is
   counted in documents per language; each document lies in one task and gives each prefix once, so the counts of
   slices add up and no pair (document, prefix) is shuffled. Prefixes in fewer than `min_documents` documents are
   discarded with everything below them; survivors are extended at the next level. A term that ends within a level is
   counted there in full, with its occurrences per source, and kept if it reaches the threshold. The levels end when no
   prefix survives, so their number grows with the logarithm of the longest term that is kept.
2. Survivors reach the next level as a bitmap of their hashes, of at most `bits` bits whatever the corpus. A collision
   only lets a few more candidates be counted; all counts are exact and by the bytes of the terms.
3. Profiles. A share of a term is 1 + floor(10^9 (count + 5) / (N + 5 V)), in decimals. Each source of a language is
   compared with the language term by term, and with every other source by the sum of differences over all V terms:
   blocks of terms times two blocks of sources, as dense matrices of bounded size. A term that neither block holds adds
   the difference of the two shares of a count of zero, so only occurring terms are moved.

A row is a document, so repeated rows count each. Null text, lang and source are empty strings; an empty text has no
terms but its (lang, source) group takes part. Ties are ordered by the bytes of the item. An empty table gives no rows.
A language without kept terms gives pairs of value 0. Other columns, whatever their names, are not read. All pairs of
sources of a language are the result asked for; pairs of documents or terms never arise.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldcast.llm.common import arrow_map, written
from fieldcast.llm.words import NO_LETTER, Texts, binaries, texts_of

#: bytes of text counted together
CHUNK = 2_000_000
#: bits of one row of a bitmap, as Spark's bitmap functions have it
PAGE = 32_768
#: rows of one block of terms, and cells of a matrix in it
BLOCK = 100_000
CELLS = 2_000_000
#: sources of one block
SOURCES = 64

LEVEL = "lang string, source string, term binary, complete boolean, docs long, n long"


def survives(texts: Texts, words: np.ndarray, lang: np.ndarray, langs: list[bytes], low: int, bitmap: np.ndarray) -> np.ndarray:
    """Of words longer than `low` bytes, those whose first `low` bytes survived in their language."""
    if not len(words):
        return np.zeros(0, bool)
    head = np.ascontiguousarray(texts.data[texts.start[words][:, None] + np.arange(low)])
    heads = pa.FixedSizeBinaryArray.from_buffers(pa.binary(low), len(words), [None, pa.py_buffer(head)]).dictionary_encode()
    values = heads.dictionary.to_pylist()
    key = lang * len(values) + heads.indices.to_numpy()
    keys, place = np.unique(key, return_inverse=True)
    begin = [zlib.crc32(x) for x in langs]
    at = np.array([zlib.crc32(values[k % len(values)], begin[k // len(values)]) for k in keys.tolist()], np.int64)
    at &= 8 * len(bitmap) - 1
    return ((bitmap[at >> 3] >> (at & 7)) & 1).astype(bool)[place]


def slice_counts(
    texts: Texts, lang: pa.DictionaryArray, source: pa.DictionaryArray, low: int, high: int, bitmap: np.ndarray | None
) -> pa.RecordBatch:
    """Rows of LEVEL for some documents: terms of low + 1 to `high` bytes by source, longer ones cut, by language."""
    lang_of, source_of = (x.indices.to_numpy().astype(np.int64) for x in (lang, source))
    n_sources = len(source.dictionary)
    length = texts.stop - texts.start
    doc = texts.text_of_word
    words = np.flatnonzero(length > low)
    if bitmap is not None:
        langs = [x.encode() for x in lang.dictionary.to_pylist()]
        words = words[survives(texts, words, lang_of[doc[words]], langs, low, bitmap)]
    size = length[words]
    terms = binaries(texts.data, texts.start[words], np.minimum(size, high)).dictionary_encode()
    width = 2 * max(1, len(terms.dictionary))
    code = 2 * terms.indices.to_numpy().astype(np.int64) + (size <= high)
    found, times = np.unique(doc[words] * width + code, return_counts=True)
    found_doc, code = np.divmod(found, width)
    # prefixes are counted by language alone: a place of their own beside the sources
    group = lang_of[found_doc] * (n_sources + 1) + np.where(code % 2, source_of[found_doc], n_sources)
    keys, place = np.unique(group * width + code, return_inverse=True)
    docs = np.bincount(place, minlength=len(keys))
    n = np.bincount(place, weights=times, minlength=len(keys)).astype(np.int64)
    group, code = np.divmod(keys, width)
    named = group % (n_sources + 1)
    return pa.RecordBatch.from_arrays(
        [
            lang.dictionary.take(pa.array(group // (n_sources + 1))),
            source.dictionary.take(pa.array(named, pa.int64(), mask=named == n_sources)),
            terms.dictionary.take(pa.array(code // 2)),
            pa.array(code % 2 == 1),
            pa.array(docs, pa.int64()),
            pa.array(n, pa.int64()),
        ],
        names=["lang", "source", "term", "complete", "docs", "n"],
    )


def level_counts(rows: DataFrame, low: int, high: int, bitmap: bytes | None) -> DataFrame:
    """Counts of one level over all texts (columns lang, source, text), by slices."""
    shared = None if bitmap is None else rows.sparkSession.sparkContext.broadcast(bitmap)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if shared is None else np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
            # documents of one group side by side, so that a slice has few groups and combines much
            order = pa.array(np.lexsort((source.indices.to_numpy(), lang.indices.to_numpy())))
            lang, source, text = lang.take(order), source.take(order), batch.column(2).take(order)
            for a, b, texts in texts_of(text, NO_LETTER, lower=True, chunk=CHUNK):
                yield slice_counts(texts, lang.slice(a, b - a), source.slice(a, b - a), low, high, bits)

    return arrow_map(rows, count, LEVEL)


def bitmap_of(prefixes: DataFrame, n: int, bits: int) -> bytes:
    """Bitmap of the hashes of (lang, prefix): a power of two of bits, about 16 for each of the n, `bits` at most."""
    size = PAGE
    while size < min(16 * n, bits):
        size *= 2
    at = F.crc32(F.concat(F.encode("lang", "UTF-8"), "term")).bitwiseAND(F.lit(size - 1))
    pages = (
        prefixes.select((at / PAGE).cast("long").alias("page"), (at % PAGE).alias("bit"))
        .groupBy("page")
        .agg(F.bitmap_construct_agg("bit").alias("content"))
    )
    out = np.zeros((size // PAGE, PAGE // 8), np.uint8)
    for row in pages.collect():  # at most size / PAGE rows
        out[row.page] = np.frombuffer(row.content, np.uint8)
    return out.tobytes()


def kept_terms(rows: DataFrame, *, min_documents: int = 30, first: int = 4, bits: int = 1 << 26) -> DataFrame:
    """(lang, source, term, n, total, lead) of every kept term of a language and source with it (lang, source, text).

    n counts its occurrences there, total those in the language; lead marks one row of each term.
    """
    rows = rows.select("lang", "source", "text")
    low, high, bitmap = 0, first, None
    levels = []
    while True:
        counts = level_counts(rows, low, high, bitmap).withColumn("h", F.xxhash64("lang", "term", "complete"))
        counts = counts.repartition("h").groupBy("h", "lang", "term", "complete", "source")
        counts = counts.agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        same = Window.partitionBy("h", "lang", "term", "complete")
        counts = counts.select(
            "lang",
            "source",
            "term",
            "complete",
            "n",
            F.sum("docs").over(same).alias("in_documents"),
            F.sum("n").over(same).alias("total"),
            (F.col("source") == F.min("source").over(same)).alias("lead"),
        )
        level = written(counts.where(F.col("in_documents") >= min_documents), "level")
        levels.append(level.where("complete"))
        prefixes = level.where("not complete")
        n = prefixes.count()
        if not n:
            break
        bitmap = bitmap_of(prefixes, n, bits)
        low, high = high, 2 * high
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out.select("lang", "source", F.col("term").cast("string").alias("term"), "n", "total", "lead")


def share(count: str, n: str, v: str) -> Column:
    """1 + floor(10^9 (count + 5) / (n + 5 v)); null where v is 0."""
    return F.expr(
        f"CASE WHEN {v} > 0 THEN 1 + (CAST(1000000000 AS DECIMAL(38, 0)) * ({count} + 5)) DIV ({n} + 5 * {v}) END"
    )


def _differences(key: tuple, rows: pd.DataFrame, width: int) -> pd.DataFrame:
    """Sums of differences between the sources of two blocks (of `width` sources) over the terms of one block.

    Rows: no, source, zero (the share of a count of zero), term and its share; each source has one row without a term.
    """
    lang, _, i, j = key
    rows = rows.sort_values("no", kind="stable")
    sources = rows[rows["term"].isna()].reset_index(drop=True)
    numbers, zero = sources["no"].to_numpy(), sources["zero"].to_numpy()
    seen = rows[rows["term"].notna()]
    term, names = pd.factorize(seen["term"])
    order = np.argsort(term, kind="stable")
    term, place, value = term[order], np.searchsorted(numbers, seen["no"].to_numpy())[order], seen["p"].to_numpy()[order]
    block = numbers // width
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    total = np.zeros((len(left), len(right)), np.int64)
    step = max(1, CELLS // max(1, len(numbers)))
    for a in range(0, len(names), step):
        b = min(a + step, len(names))
        x, y = np.searchsorted(term, [a, b])
        matrix = np.repeat(zero[:, None], b - a, axis=1)
        matrix[place[x:y], term[x:y] - a] = value[x:y]
        for k, row in enumerate(left):
            total[k] += np.abs(matrix[right] - matrix[row]).sum(axis=1)
    out = pd.DataFrame(
        {
            "lang": lang,
            "source": np.repeat(left, len(right)),
            "item": np.tile(right, len(left)),
            "value": total.ravel(),
            "seen": len(names),
        }
    )
    out["gap"] = np.abs(zero[out["source"]] - zero[out["item"]])
    out = out[out["source"] != out["item"]]
    if i != j:
        out = pd.concat([out, out.rename(columns={"source": "item", "item": "source"})])
    for c in ("source", "item"):
        out[c] = sources["source"].to_numpy()[out[c]]
    return out[["lang", "source", "item", "value", "seen", "gap"]]


def pair_sums(profiles: DataFrame, groups: DataFrame, width: int = SOURCES, block: int = BLOCK) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language.

    profiles: lang, source, term, no, p; groups: lang, source, no, zero, v, blocks (of `width` sources in the language).
    """
    pieces = -(-profiles.count() // block) or 1
    entries = profiles.select("lang", "no", "source", "zero", "blocks", "term", "p").withColumn(
        "piece", F.pmod(F.xxhash64("term"), F.lit(pieces))
    )
    # v is positive wherever a share is needed; without kept terms all sums are 0
    every = groups.select("lang", "no", "source", F.coalesce("zero", F.lit(0)).alias("zero"), "blocks").select(
        "*",
        F.lit(None).cast("string").alias("term"),
        F.lit(None).cast("long").alias("p"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(pieces - 1).cast("long"))).alias("piece"),
    )
    own = (F.col("no") / width).cast("int")
    dealt = entries.unionByName(every).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"), own.alias("own")
    )
    dealt = dealt.select(
        "lang",
        "piece",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        "no",
        "source",
        "zero",
        "term",
        "p",
    )
    sums = dealt.groupBy("lang", "piece", "i", "j").applyInPandas(
        lambda key, rows: _differences(key, rows, width), "lang string, source string, item string, value long, seen long, gap long"
    )
    sums = sums.groupBy("lang", "source", "item").agg(
        F.sum("value").alias("value"), F.sum("seen").alias("seen"), F.max("gap").alias("gap")
    )
    sizes = groups.select("lang", "v").distinct()
    return sums.join(sizes, "lang").select(
        "lang", "source", "item", (F.col("value") + (F.col("v") - F.col("seen")) * F.col("gap")).alias("value")
    )


def source_audit(
    documents: DataFrame,
    *,
    min_documents: int = 30,
    top: int = 50,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    first: int = 4,
    bits: int = 1 << 26,
    width: int = SOURCES,
    block: int = BLOCK,
) -> DataFrame:
    """(lang, source, part, item, value, rank): other sources by distance (`pair`), terms used more here (`term`)."""
    empty: Callable[[str], Column] = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = documents.select(empty(lang).alias("lang"), empty(source).alias("source"), empty(text).alias("text"))
    terms = kept_terms(rows, min_documents=min_documents, first=first, bits=bits)
    of_source = terms.groupBy("lang", "source").agg(F.sum("n").alias("n_source"))
    of_lang = terms.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum(F.col("lead").cast("long")).alias("v"))
    groups = rows.select("lang", "source").distinct().join(of_source, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.na.fill(0, ["n_source", "n_lang", "v"])
    groups = groups.withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    sources = F.count(F.lit(1)).over(Window.partitionBy("lang"))
    groups = groups.withColumn("blocks", F.ceil(sources / width).cast("int"))
    groups = written(groups.withColumn("zero", share("0L", "n_source", "v")), "groups")
    profiles = written(terms.join(groups, ["lang", "source"]).withColumn("p", share("n", "n_source", "v")), "profiles")

    pairs = pair_sums(profiles, groups, width, block)
    above = profiles.withColumn("value", F.col("p") - share("total", "n_lang", "v")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", F.col("item"), "value"]
    ranked = pairs.select(*columns).withColumn("rank", F.row_number().over(order))
    tops = above.withColumnRenamed("term", "item").select(*columns).withColumn("rank", F.row_number().over(order))
    out = ranked.withColumn("part", F.lit("pair")).unionByName(tops.where(F.col("rank") <= top).withColumn("part", F.lit("term")))
    return out.select("lang", "source", "part", "item", "value", "rank")
