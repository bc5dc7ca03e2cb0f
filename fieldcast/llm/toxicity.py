"""Toxicity by compression distance: one zstandard dictionary of ordinary text and one of toxic text.

Training, on a bounded sample of labelled rows (`sample` toxic and twice as many ordinary ones, whole texts):

1. Half of the sample gives the dictionaries. Byte 6-grams are counted by the distinct pairs of neighbouring words
   they stand between, so that copies of a document count once; 6-grams that are many times as frequent in toxic as in
   ordinary rows are marked. The toxic dictionary is trained on the runs of marked bytes in the words of toxic rows, the
   ordinary one on the words of ordinary rows that have none. Matches are 6 bytes at least, so that endings which both
   kinds of words share gain nothing.
2. A window is one lower-cased word between a lead-in that both dictionaries hold, so that its block is never stored
   raw, and a fixed lead-out, so that matches in it are seen. Its gain is the share of its bytes by which the toxic dictionary, added to the ordinary one, shortens it.
3. The other half calibrates: a logistic regression over all windows of a text (the shares of its windows above each of
   a few gains, the share of its distinct words with a gain, and the largest gain) and, with it, the threshold.

Scoring is a narrow map over whole texts. Only the text is an input. Null and empty texts have no window and get the
calibrated score of no gain. Repeated rows are scored alike; rows with null ids are scored and belong to no label;
rows labelled both ways train nothing. Without labels of both classes every score is 0. Empty tables give empty
results. Columns of documents with the names of the results are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fieldcast.llm.common import arrow_map, crc32_of_id
from fieldcast.llm.pretokens import Memo
from fieldcast.llm.quality import labelled_sample, sigmoid

#: toxic rows in the training sample, at most; there are twice as many ordinary ones
SAMPLE = 1_000
#: documents are held out of training where crc32(doc_id) modulo FOLDS is 0
FOLDS = 5
THRESHOLD = 0.5
ORDINARY_BYTES, TOXIC_BYTES = 8_192, 8_192
GRAM = 6
#: contexts a 6-gram needs in toxic rows, and how many times its frequency in ordinary rows it must reach
LEAST, TIMES = 5, 10
#: bytes that occur in no UTF-8 text, before and after a window; no match begins in the last 8 bytes of a block
LEAD_IN, LEAD_OUT = bytes(range(0xF5, 0x100)) * 3, bytes(range(0xF8, 0x100))
#: gains above which windows are counted; shares are some hundredths, so they are scaled to weigh like the largest gain
GAINS, SCALE = (0.0, 0.1, 0.2, 0.3), 30.0
FEATURES = len(GAINS) + 2
WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def window(word: str) -> bytes:
    return f" {word} ".encode()


def grams(word: str) -> set[bytes]:
    b = window(word)
    return {b[i : i + GRAM] for i in range(len(b) - GRAM + 1)}


def marked_runs(word: str, marked: set[bytes]) -> list[bytes]:
    """The longest runs of the window's bytes that marked 6-grams cover."""
    b = window(word)
    out: list[bytes] = []
    start = end = -1
    for i in range(len(b) - GRAM + 1):
        if b[i : i + GRAM] in marked:
            if i > end:
                if end >= 0:
                    out.append(b[start:end])
                start = i
            end = i + GRAM
    return [*out, b[start:end]] if end >= 0 else out


def _contexts(texts: list[list[str]]) -> tuple[Counter, int]:
    """Distinct neighbour pairs around each 6-gram, and around all words."""
    around: dict[str, set] = {}
    for found in texts:
        for before, word, after in zip(["", *found], found, [*found[1:], ""]):
            around.setdefault(word, set()).add(hash((before, after)))
    by_gram: Counter = Counter()
    for word, pairs in around.items():
        for g in grams(word):
            by_gram[g] += len(pairs)
    return by_gram, sum(map(len, around.values()))


def _dictionary(samples: Iterable[bytes], size: int) -> bytes:
    """Trained content, completed by the most frequent samples that it doesn't hold; those stand last."""
    counts = Counter(samples)
    content = b""
    try:
        repeated = list(counts.elements())
        content = zstandard.train_dictionary(size // 2, repeated * (1 + 20_000 // max(len(repeated), 1)), k=24, d=6)
        content = content.as_bytes()
    except zstandard.ZstdError:
        pass  # too few samples to train on; the samples themselves are the dictionary
    tail: list[bytes] = []
    room = size - len(content)
    for sample, _ in counts.most_common():
        if room < len(sample):
            break
        if sample not in content:
            tail.append(sample)
            room -= len(sample)
    return content + b"".join(reversed(tail))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    beta: np.ndarray = field(default_factory=lambda: np.array([0.0] * FEATURES + [-50.0]))

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    """The compressors of one task and the gains of words seen."""

    def __init__(self, model: Model):
        self.model = model
        self.compress = [self._compressor(d + LEAD_IN) for d in (model.ordinary, model.ordinary + model.toxic)]
        self.gains = Memo({}, self._gain)

    @staticmethod
    def _compressor(content: bytes):
        parameters = zstandard.ZstdCompressionParameters.from_level(
            6,
            dict_size=len(content),
            source_size=64,
            min_match=GRAM,
            search_log=8,
            hash_log=17,
            chain_log=16,
            window_log=17,
            write_checksum=False,
            write_content_size=False,
            write_dict_id=False,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        dictionary.precompute_compress(compression_params=parameters)
        return zstandard.ZstdCompressor(compression_params=parameters, dict_data=dictionary).compress

    def _gain(self, word: str) -> float:
        w = window(word)
        block = LEAD_IN + w + LEAD_OUT
        plain, toxic = (len(compress(block)) for compress in self.compress)
        return max(plain - toxic, 0) / len(w)

    def features(self, text: str) -> list[float]:
        """Shares of the text's windows above each of GAINS, of its distinct words with a gain, and the largest gain."""
        found = words(text)
        if not found:
            return [0.0] * FEATURES
        gained = {}
        above = [0] * len(GAINS)
        count = Counter(found)
        for word, n in count.items():
            gain = self.gains[word]
            if gain > 0:
                gained[word] = gain
                for i, least in enumerate(GAINS):
                    above[i] += n * (gain > least)
        self.gains.trim()
        shares = [n / len(found) for n in above] + [len(gained) / len(count)]
        return [SCALE * s for s in shares] + [max(gained.values(), default=0.0)]

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(features @ self.model.beta[:-1] + self.model.beta[-1])


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 100) -> np.ndarray:
    """Slopes and intercept of a lightly regularised logistic regression; Newton steps are halved until they ascend."""
    design = np.column_stack([x, np.ones(len(y))])
    penalty = np.array([1e-2] * x.shape[1] + [1e-6])

    def fitness(beta: np.ndarray) -> float:
        z = design @ beta
        return (y * z - np.logaddexp(0, z)).sum() - 0.5 * (penalty * beta * beta).sum()

    beta = np.zeros(design.shape[1])
    now = fitness(beta)
    for _ in range(steps):
        p = sigmoid(design @ beta)
        slope = design.T @ (y - p) - penalty * beta
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + np.diag(penalty), slope)
        while (after := fitness(beta + step)) < now and np.abs(step).max() > 1e-9:
            step = step / 2
        if np.abs(step).max() < 1e-9:
            break
        beta, now = beta + step, after
    return beta


def fit(rows: list[tuple[str, int]]) -> Model:
    """Rows (text, toxic) in an order that doesn't depend on the label."""
    halves: list[list] = [[], []]
    seen: Counter = Counter()
    for text, label in rows:
        halves[seen[label] % 3 == 2].append((text, label))
        seen[label] += 1
    if len(seen) < 2:
        return Model(b"", b"")
    cut = {label: [words(t) for t, x in halves[0] if x == label] for label in (0, 1)}
    toxic, n_toxic = _contexts(cut[1])
    ordinary, n_ordinary = _contexts(cut[0])
    marked = {
        g for g, n in toxic.items() if n >= LEAST and n * n_ordinary >= TIMES * (ordinary[g] + 1) * n_toxic
    }
    found = [run for text in cut[1] for w in text for run in marked_runs(w, marked)]
    bare = [[w for w in text if marked.isdisjoint(grams(w))] for text in cut[0]]
    plain = [b" " + " ".join(t[i : i + 8]).encode() + b" " for t in bare for i in range(0, len(t), 8)]
    model = Model(_dictionary(plain, ORDINARY_BYTES), _dictionary(found, TOXIC_BYTES))
    scorer = model.scorer()
    rest = halves[1] if len({x for _, x in halves[1]}) == 2 else rows
    x = np.array([scorer.features(text) for text, _ in rest])
    y = np.array([label for _, label in rest], float)
    model.beta = calibrate(x, y)
    return model


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    where = crc32_of_id(F.col("doc_id")) % FOLDS != 0
    rows = labelled_sample(documents, labels, "toxic", (2 * sample, sample), where)
    return fit([(r.text, r.y) for r in rows.orderBy(F.xxhash64("doc_id"), "doc_id", "text").collect()])


def toxicity(
    documents: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD
) -> DataFrame:
    """Every column of documents with held_out, score and predicted (1 where score >= threshold)."""
    documents = documents.drop("held_out", "score", "predicted")
    model = documents.sparkSession.sparkContext.broadcast(train(documents, labels, sample))  # two dictionaries
    place = documents.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.value.scorer()
        for batch in batches:
            texts = batch.column(place).to_pylist()
            x = np.array([scorer.features(t or "") for t in texts]).reshape(len(texts), FEATURES)
            p = scorer.scores(x)
            made = [pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, "score", "predicted"])

    held = documents.withColumn("held_out", crc32_of_id(F.col("doc_id")) % FOLDS == 0)
    made = StructType.fromDDL("score double, predicted int")
    return arrow_map(held, score, StructType([*held.schema.fields, *made.fields]))
