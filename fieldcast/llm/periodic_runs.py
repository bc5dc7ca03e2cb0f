"""Periodic runs of words: difference-cover LCE and harmonic-grid enumeration.

A run is a stretch of words with smallest period q, at least `shortest` words and `times` periods long, that can't be
extended with that period.

1. Grid. For each period q up to n / times, pairs of words (i, i + q) are probed at every step-th i, with
   step = max((times - 1) q, shortest - q): every run of period q holds such a pair, and the grids of all periods have
   O(n log n) pairs (a harmonic sum). The longest common extensions (LCE) of a pair to the right and to the left give
   the maximal stretch with period q; of equal stretches the smallest period is kept.
2. LCE. Positions whose number modulo v lies in a difference cover are samples; for every two positions a shift below v
   makes samples of both. Words are compared one by one up to that shift, which settles nearly all pairs. The rest
   reach two samples: only samples are sorted as suffixes (by their next v words where they still tie, then by
   doubling), neighbours' common prefixes go into a sparse table, and a range minimum gives the LCE. Leftward
   extensions use the same on the reversed sequence. The structure is built over the documents that need it.

All documents of a slice are one sequence with a different end mark after each, so no extension leaves its document.
A document is one row of a narrow map: nothing is shuffled, memory is linear in the longest document (times the levels
of the sparse table over its samples), and probes are handled in pieces of bounded size.

Null text counts as no words. Empty texts have no runs; a null id stays null. Repeated rows give repeated results, an
empty table none, and other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldcast.llm.common import arrow_map
from fieldcast.llm.words import Texts, binaries, runs, texts_of

#: perfect difference sets: every difference modulo v occurs; the larger one is for long sequences
COVERS = {31: (1, 5, 11, 24, 25, 27), 133: (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)}
#: words from which on the sparser cover is used
LONG = 2_000_000
#: probes handled together
PROBES = 1_000_000


class Cover:
    """A difference cover: which residues are samples, and the shift that makes samples of two positions."""

    def __init__(self, v: int):
        self.v, self.residues = v, np.array(COVERS[v])
        self.number = np.full(v, -1)
        self.number[self.residues] = np.arange(len(self.residues))
        self.meeting = np.zeros(v, np.int64)  # for each difference, a residue of the first position
        for a in self.residues:
            self.meeting[(self.residues - a) % v] = a

    def shift(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (self.meeting[(y - x) % self.v] - x) % self.v


class Extensions:
    """Longest common extensions to the right in a sequence whose last value occurs once.

    Until `prepare` is called, only extensions below the shift to samples are known.
    """

    def __init__(self, sequence: np.ndarray, cover: Cover):
        self.sequence, self.cover = sequence, cover

    def near(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Equal values from x and y on, up to the shift; and whether the samples were reached."""
        shift = self.cover.shift(x, y)
        same = np.zeros(len(x), np.int64)
        open_ = np.flatnonzero(shift > 0)
        step = 0
        while len(open_):
            open_ = open_[self.sequence[x[open_] + step] == self.sequence[y[open_] + step]]
            step += 1
            same[open_] = step
            open_ = open_[shift[open_] > step]
        return same, same == shift

    def prepare(self) -> None:
        """Sort the samples' suffixes; ranks and the sparse table of common prefixes."""
        v, residues = self.cover.v, self.cover.residues
        n, width = len(self.sequence), len(residues)
        self.position = runs(np.zeros(1, np.int64), np.array([n // v + 1])).repeat(width) * v + np.tile(residues, n // v + 1)
        self.position = self.position[self.position < n]
        count = len(self.position)
        padded = np.concatenate([self.sequence, np.full(v, self.sequence.min() - 1)])
        rank = np.zeros(count, np.int64)
        tied = np.arange(count)
        for k in range(v):
            tied = self._refine(rank, tied, padded[self.position[tied] + k])
        levels = [rank.astype(np.int32)]
        step = width  # samples from one to that v positions further
        while len(tied):
            further = np.where(tied + step < count, rank[np.minimum(tied + step, count - 1)], -1)
            tied = self._refine(rank, tied, further)
            levels.append(rank.astype(np.int32))
            step *= 2
        self.rank = rank
        order = np.empty(count, np.int64)
        order[rank] = np.arange(count)
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(0, count - 1), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            equal = np.flatnonzero(levels[k][np.minimum(a, count - 1)] == levels[k][np.minimum(b, count - 1)])
            equal = equal[(a[equal] < count) & (b[equal] < count) & (a[equal] != b[equal])]
            common[equal] += v << k
            a[equal] += width << k
            b[equal] += width << k
        x, y = self.position[order[:-1]] + common, self.position[order[1:]] + common
        open_ = np.arange(len(common))
        while len(open_):  # less than v values
            open_ = open_[padded[x[open_]] == padded[y[open_]]]
            common[open_] += 1
            x[open_] += 1
            y[open_] += 1
        self.table = [common.astype(np.int32)]
        half = 1
        while 2 * half <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))
            half *= 2

    @staticmethod
    def _refine(rank: np.ndarray, tied: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Split classes of equal rank by a further value; rank is the number of smaller suffixes. Returns what still ties."""
        order = np.lexsort((value, rank[tied]))
        tied, value = tied[order], value[order]
        old = rank[tied]
        begins = np.ones(len(tied), bool)
        begins[1:] = old[1:] != old[:-1]
        splits = begins.copy()
        splits[1:] |= value[1:] != value[:-1]
        place = np.arange(len(tied))
        first_of_class = np.maximum.accumulate(np.where(begins, place, 0))
        first_of_part = np.maximum.accumulate(np.where(splits, place, 0))
        rank[tied] = old + first_of_part - first_of_class
        alone = splits & np.append(splits[1:], True)
        return tied[~alone]

    def beyond(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Equal values from x and y on, both samples, x != y."""
        v, width = self.cover.v, len(self.cover.residues)
        i, j = (self.rank[p // v * width + self.cover.number[p % v]] for p in (x, y))
        low, high = np.minimum(i, j), np.maximum(i, j)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.zeros(len(x), np.int64)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.table[k][low[at]], self.table[k][high[at] - (1 << k)])
        return out

    def far(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        same, reached = self.near(x, y)
        at = np.flatnonzero(reached)
        same[at] += self.beyond(x[at] + same[at], y[at] + same[at])
        return same


def joined(codes: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One sequence of the given ranges of codes, an end mark of its own before and after each, and where each begins."""
    n = last - first
    begin = np.cumsum(n + 1) - n
    out = -1 - np.arange(n.sum() + len(n) + 1)  # marks are negative and differ
    out[runs(begin, n)] = codes[runs(first, n)]
    return out, begin


def probes(n: np.ndarray, shortest: int, times: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, i, period) on the grids of all periods of documents of n words, in pieces of about PROBES."""
    periods = np.where(n >= shortest, n // times, 0)
    ends = np.cumsum(periods)
    total = int(ends[-1]) if len(ends) else 0
    for a in range(0, total, PROBES):
        at = np.arange(a, min(total, a + PROBES))
        doc = np.searchsorted(ends, at, side="right")
        period = at - (ends[doc] - periods[doc]) + 1
        step = np.maximum((times - 1) * period, np.maximum(1, shortest - period))
        count = (n[doc] - period - 1) // step + 1
        after = np.cumsum(count)
        cuts = np.unique(np.searchsorted(after, np.arange(PROBES, after[-1] + PROBES, PROBES), side="left"))
        begin = 0
        for cut in [*(cuts[cuts < len(at)] + 1).tolist(), len(at)]:
            part = slice(begin, cut)
            if begin < cut:
                grid = np.repeat(step[part], count[part]) * runs(np.zeros(cut - begin, np.int64), count[part])
                yield np.repeat(doc[part], count[part]), grid, np.repeat(period[part], count[part])
            begin = cut


def find_runs(codes: np.ndarray, first: np.ndarray, last: np.ndarray, shortest: int = 24, times: int = 3) -> np.ndarray:
    """Rows (document, start, length, period), ordered, of all runs of the documents codes[first:last]."""
    n = last - first
    found = [np.zeros((0, 4), np.int64)]
    left_over = []
    cover = Cover(31 if len(codes) < LONG else 133)
    sequence, begin = joined(codes, first, last)
    right, left = Extensions(sequence, cover), Extensions(sequence[::-1], cover)
    end = len(sequence)
    for doc, i, period in probes(n, shortest, times):
        x = begin[doc] + i
        equal = np.flatnonzero(sequence[x] == sequence[x + period])
        doc, x, period = doc[equal], x[equal], period[equal]
        ahead, open_ahead = right.near(x, x + period)
        back, open_back = left.near(end - x, end - x - period)
        done = ~(open_ahead | open_back)
        length = ahead + back + period
        long = done & (length >= np.maximum(shortest, times * period))
        found.append(np.stack([doc, x - back - begin[doc], length, period], axis=1)[long])
        left_over.append(np.stack([doc, x - begin[doc], period], axis=1)[~done])
    rest = np.concatenate(left_over) if left_over else np.zeros((0, 3), np.int64)
    if len(rest):
        docs, place = np.unique(rest[:, 0], return_inverse=True)
        sequence, begin = joined(codes, first[docs], last[docs])
        right, left = Extensions(sequence, cover), Extensions(sequence[::-1], cover)
        right.prepare()
        left.prepare()
        end = len(sequence)
        for a in range(0, len(rest), PROBES):
            doc, i, period = rest[a : a + PROBES].T
            x = begin[place[a : a + PROBES]] + i
            back = left.far(end - x, end - x - period)
            length = right.far(x, x + period) + back + period
            long = length >= np.maximum(shortest, times * period)
            found.append(np.stack([doc, i - back, length, period], axis=1)[long])
    out = np.unique(np.concatenate(found), axis=0)
    smallest = np.ones(len(out), bool)  # rows are ordered, so the first of equal stretches has the smallest period
    smallest[1:] = (out[1:, :3] != out[:-1, :3]).any(axis=1)
    out = out[smallest]
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def outside(n: int, rows: np.ndarray, times: int = 1) -> np.ndarray:
    """Which of n words no run holds after its first `times` periods."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, rows[:, 1] + times * rows[:, 3], 1)
    np.add.at(change, rows[:, 1] + rows[:, 2], -1)
    return np.cumsum(change[:-1]) == 0


def rewritten(words: np.ndarray, doc_id: int) -> np.ndarray:
    """Word numbers of a document after the contract's rewriting: some ids get a repeated tail."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


NOTHING = hashlib.sha256(b"").hexdigest()
COLUMNS = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digests(texts: Texts, words: np.ndarray, first: np.ndarray, last: np.ndarray, found: np.ndarray) -> list[tuple]:
    """COLUMNS for each document: words of the slice by number, runs of all documents."""
    cuts = np.searchsorted(found[:, 0], np.arange(len(first) + 1))
    kept = np.ones(len(words), bool)
    heads = []
    for d in range(len(first)):
        rows = found[cuts[d] : cuts[d + 1]]
        if not len(rows):
            heads.append((0, None, None, None, None, NOTHING))
            continue
        kept[first[d] : last[d]] = outside(last[d] - first[d], rows)
        listed = [tuple(r) for r in rows[:, 1:].tolist()]
        best = min(listed, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in listed)
        heads.append((len(listed), *best, 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest()))
    # the bytes of kept words, a space after each; a document's last one stays out
    at = words[kept]
    size = texts.stop[at] - texts.start[at] + 1
    end = np.cumsum(size)
    data = np.append(texts.data, np.uint8(32))[runs(texts.start[at], size)]
    data[end - 1] = 32
    before = np.concatenate([[0], np.cumsum(kept)])
    end = np.concatenate([[0], end])
    begin, stop = end[before[first]], end[before[last]]
    whole = data.tobytes()
    return [
        (*head, hashlib.sha256(whole[a : b - 1] if b > a else b"").hexdigest())
        for head, a, b in zip(heads, begin.tolist(), stop.tolist())
    ]


def periodic_runs(
    documents: DataFrame,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    shortest: int = 24,
    times: int = 3,
    rewrite: bool = False,
) -> DataFrame:
    """(id, start, length, period) of every run of every document; `rewrite` applies the contract's repeated tails."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, _, _, _, found in _slices(batches, shortest, times, rewrite):
            columns = [ids.take(pa.array(found[:, 0])), *(pa.array(found[:, k]) for k in (1, 2, 3))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "start", "length", "period"])

    return _mapped(documents, id_column, text_column, listed, "start long, length long, period long")


def run_digests(
    documents: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", shortest: int = 24, times: int = 3
) -> DataFrame:
    """id and COLUMNS of every document after the contract's rewriting."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in COLUMNS.split(", ")]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, words, first, last, found in _slices(batches, shortest, times, True):
            rows = digests(texts, words, first, last, found)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([ids, *columns], names=["id", *names])

    return _mapped(documents, id_column, text_column, judged, COLUMNS)


def _mapped(documents: DataFrame, id_column: str, text_column: str, function, columns: str) -> DataFrame:
    rows = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, function, f"id {kind}, {columns}").withColumnRenamed("id", id_column)


def _slices(batches: Iterator[pa.RecordBatch], shortest: int, times: int, rewrite: bool) -> Iterator[tuple]:
    """ids, texts, word numbers after rewriting, first and last of each document, runs."""
    for batch in batches:
        for a, b, texts in texts_of(batch.column(1)):
            ids = batch.column(0).slice(a, b - a)
            first, last = texts.first, texts.last
            words = np.arange(len(texts.start))
            if rewrite:
                parts = [words[f:t] if i is None else rewritten(words[f:t], i) for i, f, t in zip(ids.to_pylist(), first, last)]
                words = np.concatenate(parts) if parts else words
            codes = binaries(texts.data, texts.start, texts.stop - texts.start).dictionary_encode().indices.to_numpy()
            yield ids, texts, words, first, last, find_runs(codes[words].astype(np.int64), first, last, shortest, times)
