"""Vector best-fit packing of tokenised documents into sequences.

A piece asks for tokens, one document place and attention cost (its length squared). A sequence has a capacity of each.
Pieces go, longest first, to the open sequence that fits under every constraint and is best by the chosen rule:

* `norm`: the smallest weighted norm of what would be left of the capacities;
* `dot`: the largest weighted dot product of demand and residual capacities.

Pieces are dealt to groups of bounded size by a hash of a stored row number, so that no key, document or source can
make a group large; every group is packed in one task and leaves a few unfilled sequences at most. The tokenised
pieces are written once to the shared folder, as numbers only.

Null text counts as empty (only the end id). Repeated rows and rows with null ids are pieces like any other. Texts of
any length are cut, never dropped. An empty table gives an empty result. Other columns stay out of it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.common import arrow_map, written
from fieldcast.llm.pretokens import UNUSUAL, Memo, Vocabulary
from fieldcast.llm.words import Texts, runs, texts_of

#: pieces that one task packs together
GROUP = 16_384
#: weights of tokens, document places and attention cost
WEIGHTS = (1.0, 1e-3, 1e-3)


#: closing marks that are cut off a word: they are pre-tokens of their own, and none begins an ending such as 's
CLOSING = np.isin(np.arange(256), list(b".,;:!?)]}"))
#: bytes that a cut-off word may end with
BODY = np.isin(np.arange(256), [*range(48, 58), *range(97, 123)])
#: pre-tokens that a worker remembers
REMEMBERED = 600_000


class Encoder:
    """Ids of words, remembered by the worker from task to task."""

    def __init__(self, tokenizer: str):
        self.vocabulary = Vocabulary(tokenizer)
        self.by_piece = Memo({}, self.packed, limit=50_000)
        self.by_word = Memo({}, self.of_word, limit=REMEMBERED)

    def packed(self, piece: str) -> bytes:
        ids = self.vocabulary.merge(piece)
        return struct.pack(f"<{len(ids)}I", *ids)

    def of_word(self, word: bytes) -> bytes | None:
        """Ids of a run without white space; none if the library has to cut the whole text."""
        text = word.decode()
        if word.isalpha():  # letters of ASCII only: one pre-token, lower-cased already, its own form in the vocabulary
            ids = [t.id for t in self.vocabulary.model.tokenize(text)]
            return struct.pack(f"<{len(ids)}I", *ids)
        special = self.vocabulary.special
        if UNUSUAL.search(text) or special is not None and special.search(text):
            return None
        return b"".join(map(self.packed, self.vocabulary.find(text.lower())))

    def of_text(self, text: str) -> np.ndarray:
        """Ids of a whole text, cut by the library where it holds an unusual character."""
        ids = np.frombuffer(b"".join(map(self.by_piece.__getitem__, self.vocabulary.pieces(text))), "<u4")
        self.by_piece.trim()
        return ids

    def encoded(self, texts: Texts, end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, an end id after each; where each text's begin and end; which texts hold a word without ids.

        No pre-token of this vocabulary crosses white space, so each different run is encoded once; closing marks are
        runs of their own, so that a word is the same with and without them.
        """
        start, stop, of = parted(texts)
        words = texts.encoded(start, stop)
        known = [self.by_word[x] for x in words.dictionary.to_pylist()]
        self.by_word.trim()
        pool = np.frombuffer(b"".join(x or b"" for x in known), "<u4")
        sizes = np.fromiter((len(x or b"") // 4 for x in known), np.int64, len(known))
        unknown = np.fromiter((x is None for x in known), bool, len(known))
        word = words.indices.to_numpy()
        size = sizes[word]
        ends = np.cumsum(size)
        ids = np.full((int(ends[-1]) if len(ends) else 0) + len(texts.begin), end_id, "<u4")
        ids[runs(ends - size + of, size)] = pool[runs((np.cumsum(sizes) - sizes)[word], size)]
        place = np.arange(len(texts.begin))
        count = np.bincount(of, minlength=len(place))
        last = np.concatenate([[0], ends])[np.cumsum(count)]
        first = np.concatenate([[0], last[:-1]])
        odd = np.bincount(of[unknown[word]], minlength=len(place)) > 0
        return ids, first + place, last + place + 1, odd


def parted(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, stop and text of all words, closing marks cut off where a letter or digit is before them."""
    body = texts.stop.copy()
    open_ = np.arange(len(body))
    while len(open_):
        open_ = open_[(body[open_] > texts.start[open_]) & CLOSING[texts.data[body[open_] - 1]]]
        body[open_] -= 1
    cut = (body > texts.start) & (body < texts.stop)
    cut[cut] = BODY[texts.data[body[cut] - 1]]
    place = np.cumsum(1 + cut) - 1  # of a word's last part
    start, stop = np.empty(len(body) + cut.sum(), np.int64), np.empty(len(body) + cut.sum(), np.int64)
    start[place - cut], stop[place] = texts.start, texts.stop
    start[place[cut]] = stop[place[cut] - 1] = body[cut]
    return start, stop, np.repeat(texts.text_of_word, 1 + cut)


@lru_cache(maxsize=1)
def encoder(tokenizer: str) -> Encoder:
    """The worker's encoder; tasks that follow in it find the words of those before."""
    return Encoder(tokenizer)


def token_pieces(
    documents: DataFrame, tokenizer: str, size: int, *, end_id: int = 0, id_column: str = "doc_id"
) -> DataFrame:
    """Pieces of every row: id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for first, last, texts in texts_of(batch.column(1), lower=True):
                ids, begin, end, odd = coder.encoded(texts, end_id)
                for k in range(last - first):
                    mine = ids[begin[k] : end[k]]
                    if odd[k]:
                        text = batch.column(1)[first + k].as_py()
                        mine = np.append(coder.of_text(text), np.array(end_id, "<u4"))
                    for n, a in enumerate(range(0, len(mine), size)):
                        part = mine[a : a + size]
                        row.append(first + k)
                        piece.append(n)
                        start.append(a)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ],
                names=["id", "piece", "start", "length", "ids_crc32"],
            )

    rows = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, cut, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def vector_best_fit(
    lengths: np.ndarray,
    capacity: tuple[int, int, int],
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; lengths in descending order, none over the token capacity.

    A piece that alone breaks the attention capacity gets a sequence of its own.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    tokens, places, cost = capacity
    n = len(lengths)
    sequence = np.zeros(n, np.int64)
    offset = np.zeros(n, np.int64)
    scale = np.array(weights) / np.square(np.array(capacity, dtype=float))
    left = np.zeros((n, 3))  # residual capacities of the sequences that may still take a piece
    name = np.zeros(n, np.int64)  # their numbers
    kept = opened = 0
    shortest = int(lengths[-1]) if n else 0
    for i, length in enumerate(map(int, lengths)):
        if i % 256 == 0:
            stay = np.flatnonzero((left[:kept, 0] >= shortest) & (left[:kept, 1] >= 1))
            kept = len(stay)
            left[:kept], name[:kept] = left[stay], name[stay]
        demand = np.array((length, 1, length * length), float)
        at = np.flatnonzero((left[:kept] >= demand).all(axis=1))
        if len(at):
            if rule == "norm":
                at = at[np.argmin(np.square(left[at] - demand) @ scale)]
            else:
                at = at[np.argmax(left[at] @ (scale * demand))]
        else:
            at = kept
            left[at] = (tokens, places, max(cost, length * length))
            name[at] = opened
            kept += 1
            opened += 1
        sequence[i] = name[at]
        offset[i] = tokens - left[at, 0]
        left[at] -= demand
    return sequence, offset


def pack(
    documents: DataFrame,
    tokenizer: str,
    *,
    tokens: int = 2048,
    places: int | None = None,
    attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    rule: str = "norm",
    group: int = GROUP,
    id_column: str = "doc_id",
) -> DataFrame:
    """Pieces with sequence_id and offset.

    Without `places` and `attention` these capacities are what `tokens` implies (as many documents as tokens, the
    square of the tokens), so they steer the choice and never cost a sequence.
    """
    capacity = (tokens, places or tokens, attention or tokens * tokens)
    numbered = token_pieces(documents, tokenizer, tokens, id_column=id_column).withColumn(
        "row", F.monotonically_increasing_id()
    )
    pieces = written(numbered, "pieces")
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("deal", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        sequence, offset = vector_best_fit(frame["length"].to_numpy(), capacity, weights, rule)
        frame["sequence_id"] = (frame["deal"].to_numpy() << 32) + sequence
        frame["offset"] = offset
        return frame[["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]]

    kind = pieces.schema["id"].dataType.simpleString()
    schema = f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return dealt.groupBy("deal").applyInPandas(fill, schema).withColumnRenamed("id", id_column)
