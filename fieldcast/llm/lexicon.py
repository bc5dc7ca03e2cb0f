"""BPE encoding and decoding with a minimal acyclic transducer over the corpus's frequent words.

1. Every task summarises the pre-tokens of all its texts with the counters of Misra and Gries, so each word with more
   than a fixed share of the task's words survives; Spark adds the summaries and keeps the `words` most frequent.
   The summaries bound memory and shuffle; they only decide which words are fast, never a result.
2. The kept words become a minimal acyclic automaton (equal suffixes are one state). The outputs on the arcs of a
   word's path add up to its place in the lexicon, where its token ids are stored.
3. The lexicon is one flat file, handed to every executor with `addFile` and memory-mapped there, also by executors
   that replace lost ones. Each distinct pre-token walks the automaton; words it does not hold are merged exactly.

Decoding concatenates the bytes of the ids. Null text counts as empty (no ids, the hash of nothing). Every row is
kept, repeated ones too; other columns stay out of the result; an empty table gives an empty lexicon and no rows.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.common import arrow_map, slices, written
from fieldcast.llm.pretokens import Memo, Vocabulary

#: frequent words in the lexicon
WORDS = 32_768
#: counters of a task's summary
COUNTERS = 100_000
#: classes of counts to a doubling, when the least count of the lexicon is looked for
STEPS = 16
#: characters encoded together
CHUNK = 1_000_000


def compile_words(words: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimal automaton of distinct words in ascending order: arc keys (state * 256 + byte), targets, outputs, finals.

    The outputs on a word's path, together, are its position among the words. State 0 is the start.
    """
    register: dict[tuple, int] = {}
    arcs: list[dict[int, int]] = [{}]
    final: list[bool] = [False]
    open_path: list[int] = [0]  # states of the previous word's path
    previous = b""

    def close(depth: int) -> None:
        """Replace the states below `depth` of the open path by equal registered ones."""
        while len(open_path) - 1 > depth:
            state = open_path.pop()
            key = (final[state], tuple(arcs[state].items()))
            known = register.setdefault(key, state)
            if known != state:
                arcs[open_path[-1]][previous[len(open_path) - 1]] = known

    for word in words:
        shared = len(os.path.commonprefix((previous, word)))
        close(shared)
        previous = word
        for byte in word[shared:]:
            arcs.append({})
            final.append(False)
            arcs[open_path[-1]][byte] = len(arcs) - 1
            open_path.append(len(arcs) - 1)
        final[open_path[-1]] = True
    close(0)

    number = {0: 0}
    order = [0]
    for state in order:  # grows while it is walked: the reachable states
        for target in arcs[state].values():
            if target not in number:
                number[target] = len(order)
                order.append(target)
    below: dict[int, int] = {}
    stack = [0]
    while stack:  # words below each state, children first
        state = stack[-1]
        waiting = [t for t in arcs[state].values() if t not in below]
        if waiting:
            stack += waiting
        else:
            below[state] = final[state] + sum(below[t] for t in arcs[state].values())
            stack.pop()
    keys, targets, outputs = [], [], []
    for state in order:
        passed = int(final[state])
        for byte, target in sorted(arcs[state].items()):
            keys.append(number[state] << 8 | byte)
            targets.append(number[target])
            outputs.append(passed)
            passed += below[target]
    u = lambda x: np.array(x, dtype=np.uint32)
    return u(keys), u(targets), u(outputs), u([final[s] for s in order])


def lexicon_bytes(words: Iterable[bytes], ids: dict[bytes, list[int]]) -> bytes:
    """Flat file: the lengths of the six parts, then keys, targets, outputs, finals, id offsets, ids."""
    words = sorted(set(words))
    offsets = np.cumsum([0, *(len(ids[w]) for w in words)]).astype(np.uint32)
    pool = np.array([i for w in words for i in ids[w]], dtype=np.uint32)
    parts = [*compile_words(words), offsets, pool]
    return b"".join([np.array([len(p) for p in parts], np.uint32).tobytes(), *(p.tobytes() for p in parts)])


class Lexicon:
    """The memory-mapped file."""

    def __init__(self, path: str):
        flat = np.memmap(path, dtype=np.uint32, mode="r")
        ends = np.cumsum(flat[:6].astype(np.int64)) + 6
        parts = [flat[a:b] for a, b in zip([6, *ends[:-1]], ends)]
        self.keys, self.targets, self.outputs, self.final, self.offsets, self.ids = parts

    def find(self, words: list[bytes]) -> np.ndarray:
        """Place of each word in the lexicon, -1 where it is not in."""
        place = np.full(len(words), -1, dtype=np.int64)
        if not len(self.keys):
            return place
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        length = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.cumsum(length) - length
        row = np.arange(len(words))
        state = np.zeros(len(words), dtype=np.uint32)
        total = np.zeros(len(words), dtype=np.int64)
        step = 0
        while len(row):
            ended = length[row] == step
            if ended.any():
                done = row[ended]
                hit = self.final[state[ended]] == 1
                place[done[hit]] = total[ended][hit]
                row, state, total = row[~ended], state[~ended], total[~ended]
                if not len(row):
                    break
            key = state << np.uint32(8) | text[begin[row] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            known = self.keys[at] == key
            row, at = row[known], at[known]
            state, total = self.targets[at], total[known] + self.outputs[at]
            step += 1
        return place


def frequent_words(documents: DataFrame, tokenizer: str, words: int = WORDS) -> list[str]:
    """The `words` most frequent pre-tokens by the added summaries of all texts (columns id, text)."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(tokenizer)
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                counts.update(vocabulary.pieces(text))
                if len(counts) > 2 * COUNTERS:
                    cut = sorted(counts.values(), reverse=True)[COUNTERS]
                    counts = Counter({w: n - cut for w, n in counts.items() if n > cut})
        top = counts.most_common(2 * words)
        yield pa.RecordBatch.from_arrays(
            [pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], names=["word", "n"]
        )

    counts = arrow_map(documents, summary, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts, "word-counts")
    # the least count first, so that little more than `words` rows come to the driver
    step = F.floor(STEPS * F.log2("n"))
    least, held = 0, 0
    for row in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("n_words")).collect(), reverse=True):
        least, held = row.step, held + row.n_words
        if held >= words:
            break
    found = counts.where(step >= least).collect()
    return [r.word for r in sorted(found, key=lambda r: (-r.n, r.word))[:words]]


def encode_decode(
    documents: DataFrame, tokenizer: str, *, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS
) -> DataFrame:
    """id, n_tokens, ids (array), decoded text and their hashes (`digests`), as a frame of every row."""
    out = _mapped(documents, tokenizer, id_column, text_column, words, digests=False)
    return out.withColumnRenamed("id", id_column)


def encode_digests(
    documents: DataFrame, tokenizer: str, *, id_column: str = "doc_id", text_column: str = "text", words: int = WORDS
) -> DataFrame:
    """id, n_tokens, ids_sha256, decoded_sha256, n_unseen (pre-tokens outside the lexicon) of every row."""
    out = _mapped(documents, tokenizer, id_column, text_column, words, digests=True)
    return out.withColumnRenamed("id", id_column)


def _mapped(
    documents: DataFrame, tokenizer: str, id_column: str, text_column: str, words: int, digests: bool
) -> DataFrame:
    spark = documents.sparkSession
    rows = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    frequent = frequent_words(rows, tokenizer, words)
    vocabulary = Vocabulary(tokenizer)
    content = lexicon_bytes([w.encode() for w in frequent], {w.encode(): vocabulary.merge(w) for w in frequent})
    name = f"lexicon-{uuid.uuid4().hex}.bin"  # a name is registered once in a session
    path = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="fieldcast-")), name)
    with open(path, "wb") as file:
        file.write(content)
    spark.sparkContext.addFile(path)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(Vocabulary(tokenizer), Lexicon(SparkFiles.get(name)))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts, CHUNK):
                ids, ends, unseen = coder.encode(texts[a:b])
                docs = np.split(ids, ends[:-1])
                decoded = [coder.decode(x) for x in docs]
                lengths = pa.array([len(x) for x in docs], pa.int64())
                if digests:
                    columns = [
                        pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in docs]),
                        pa.array([hashlib.sha256(x.encode()).hexdigest() for x in decoded]),
                    ]
                else:
                    columns = [pa.array([x.tolist() for x in docs], pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), lengths, *columns, pa.array(unseen, pa.int64())],
                    names=["id", "n_tokens", *names, "n_unseen"],
                )

    names = ["ids_sha256", "decoded_sha256"] if digests else ["ids", "decoded"]
    kinds = ["string", "string"] if digests else ["array<int>", "string"]
    kind = rows.schema["id"].dataType.simpleString()
    columns = ", ".join(f"{n} {k}" for n, k in zip(names, kinds))
    return arrow_map(rows, encode, f"id {kind}, n_tokens long, {columns}, n_unseen long")


class Coder:
    """Encodes chunks of texts and decodes ids in one task."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.merged = Memo({}, vocabulary.merge, limit=100_000)
        self.bytes = vocabulary.token_bytes()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """All ids in text order, where each text's ids end, pre-tokens of each text outside the lexicon."""
        cut = [self.vocabulary.pieces(t) for t in texts]
        pieces = [p for c in cut for p in c]
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64), [0] * len(texts)
        distinct = list(dict.fromkeys(pieces))
        place = self.lexicon.find([p.encode() for p in distinct])
        missing = np.flatnonzero(place < 0)
        new = [self.merged[distinct[i]] for i in missing]
        self.merged.trim()
        # one pool: the lexicon's ids, then the ids of the words merged here
        begin = self.lexicon.offsets[place].astype(np.int64)
        length = self.lexicon.offsets[place + 1].astype(np.int64) - begin
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        begin[missing] = len(self.lexicon.ids) + np.cumsum(sizes) - sizes
        length[missing] = sizes
        pool = np.concatenate([self.lexicon.ids, np.fromiter((i for x in new for i in x), np.uint32, sizes.sum())])
        index = dict(zip(distinct, range(len(distinct))))
        code = np.fromiter(map(index.__getitem__, pieces), np.int64, len(pieces))
        size = length[code]
        after = np.cumsum(size)
        at = np.repeat(begin[code] - (after - size), size) + np.arange(after[-1])
        last = np.cumsum([len(c) for c in cut])
        totals = np.concatenate([[0], after])
        outside = np.concatenate([[0], np.cumsum(place[code] < 0)])
        first = last - [len(c) for c in cut]
        return pool[at], totals[last], (outside[last] - outside[first]).tolist()

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", errors="replace")
