"""Token counts by the whole-token shortcut.

Offline, every vocabulary string is run through the merges; those that come out as one token, namely themselves, are
proven to be whole. A pre-token equal to a proven string counts one by a table lookup; only the rest is merged.

Null text counts as empty. Empty and very long texts, repeated rows, ties and empty tables need no special case: the
operator is a narrow map that keeps every row and any other column stays out of its result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.common import arrow_map
from fieldcast.llm.pretokens import Memo, Vocabulary


def whole_tokens(vocabulary: Vocabulary) -> list[str]:
    """Vocabulary strings, as text, that the merges map to one token. Strings that aren't UTF-8 can't be a pre-token.

    A pre-token may begin or end anywhere in a character only if the text does, so a string that is no valid UTF-8
    never equals one and needs no proof.
    """
    proven = []
    for token, i in vocabulary.vocab.items():
        try:
            text = bytes(vocabulary.to_byte[c] for c in token).decode()
        except (KeyError, UnicodeDecodeError):
            continue
        if text not in vocabulary.specials and [t.id for t in vocabulary.model.tokenize(token)] == [i]:
            proven.append(text)
    return proven


def token_counts(
    documents: DataFrame, tokenizer: str, *, id_column: str = "doc_id", text_column: str = "text", limit: int = 512
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit (n_tokens > limit) and n_merged (pre-tokens that needed merges) of each row."""
    spark = documents.sparkSession
    # at most one entry per vocabulary string, so bounded by the tokenizer file and not by the data
    whole = spark.sparkContext.broadcast(whole_tokens(Vocabulary(tokenizer)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(tokenizer)
        memo = Memo(dict.fromkeys(whole.value, 1), lambda piece: len(vocabulary.merge(piece)))
        known = frozenset(whole.value)
        for batch in batches:
            tokens, merged = [], []
            for text in batch.column(1).to_pylist():
                pieces = vocabulary.pieces(text)
                tokens.append(sum(map(memo.__getitem__, pieces)))
                merged.append(len(pieces) - sum(map(known.__contains__, pieces)))
                memo.trim()
            n_tokens = pa.array(tokens, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.binary_length(batch.column(1)).cast(pa.int64()),
                    n_tokens,
                    pc.greater(n_tokens, limit),
                    pa.array(merged, pa.int64()),
                ],
                names=["id", "n_bytes", "n_tokens", "over_limit", "n_merged"],
            )

    rows = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = arrow_map(rows, count, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_merged long")
    return out.withColumnRenamed("id", id_column)
