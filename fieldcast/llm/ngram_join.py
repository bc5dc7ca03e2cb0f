"""N-gram Jaccard join by T-occurrence search (DivideSkip) inside shards that hold every possible partner.

A document's set holds its distinct runs of `words` words, or its whole word sequence if it is shorter. Two sets link
when 100 * |intersection| >= percent * |union|. All documents of one set are one node, named by a 64-bit hash of it.

1. Routing. Linked sets differ in so few elements that, cut by hash ranges into more parts than that, they agree on a
   whole part. Nodes that share a part (of the same cut) get an edge to the smallest of them; sets of neighbouring size
   bands use both bands' cuts. Parts that are empty route only sets with so many empty parts that no other part is sure
   to agree. A cut has more parts than the sure one, so linked sets agree on several, and each set leaves out as many of
   its most frequent parts (prefix filtering in a common order: those known to be frequent, then by exact counts over
   all texts). This loses no link, and lines or passages that documents share don't bring them together, however few
   documents these are, unless they fill more parts than that.
2. The connected components of these edges are the shards: small ones are put together, large ones are cut into blocks.
3. Search. A task indexes the sets of its block in inverted lists. For each set, the lists are divided: the short ones
   are merged with counts, the long ones are probed by binary search for the sets that the short lists left possible,
   and those that reach the overlap are linked. Sets already known to be connected aren't probed again.
4. Blocks of one shard also get the shard's leaders, a few of its sets. What may still link are sets outside the
   shard's largest component so far, with each other or with sets inside it. They are compared with all blocks of the
   shard by small sketches that bound the difference from below; what these leave together are smaller shards, and
   step 3 searches them, again in blocks if they are large. So no link is lost.
5. Components of the links, over Spark joins.

Copies never meet as pairs, and near copies only as links of a forest. A part shared by very many sets is combined
within each batch before the shuffle. Broadcasts of component tables are made behind a check of their size.

Null and empty texts have no set: n_shingles 0, linked with nothing, component_id their own id. Rows with null ids link
others and get the smallest id of their component, null if there is none. Every row is kept, repeated ones too; an empty
table gives an empty result; other columns stay out of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from fieldcast.llm.common import arrow_map, written
from fieldcast.llm.components import components
from fieldcast.llm.words import BLANK, mix, shingle_hash, texts_of

#: shingles that one task indexes, about
TASK_SHINGLES = 1_500_000
#: leaders that all blocks of a large shard get
LEADERS = 32
#: parts of a cut beyond what is needed, so that few sets have as many empty ones
SPARE = 3
#: cells of a sketch, a power of two
CELLS = 256
#: part keys that are combined together before the shuffle
KEYS = 250_000
#: rows of a key that are counted; the counts only order the keys
COUNTED = 50_000
#: most frequent part keys that the sets know, at most (16 bytes each)
FREQUENT = 100_000
#: thresholds from which on parts hold so many shingles (eight or so) that common lines fill none: nothing is left out
FULL_PARTS = 90
#: what a set weighs besides its shingles when sets are dealt to tasks: its sketch, in 8 bytes
SKETCH = CELLS // 4
#: rows up to which a table of shards is broadcast (32 bytes each)
FEW = 500_000


def sets_of(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of slices of a column: (a, b, text of each element, element); elements of a text are distinct and ascending."""
    for a, b, texts in texts_of(column, BLANK, lower=True):
        hashes = texts.word_hashes()
        of, element = texts.shingles(words, hashes)
        short = np.flatnonzero((texts.n_words > 0) & (texts.n_words < words))
        for n in range(1, words):
            some = short[texts.n_words[short] == n]
            of = np.concatenate([of, some])
            element = np.concatenate([element, shingle_hash(hashes, texts.first[some], n)])
        order = np.lexsort((element, of))
        of, element = of[order], element[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (element[1:] != element[:-1])
        yield a, b, of[new], element[new]


def sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of the runs that begin at `begin` (ascending, none empty)."""
    return np.add.reduceat(values, begin) if len(begin) else np.zeros(0, np.uint64)


def nodes_of(of: np.ndarray, element: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, size) of each of n texts; node 0 and size 0 without a set."""
    size = np.bincount(of, minlength=n)
    node = np.zeros(n, np.uint64)
    filled = size > 0
    begin = (np.cumsum(size) - size)[filled]
    node[filled] = mix(sums(mix(element), begin) ^ mix(size[filled].astype(np.uint64)))
    return node, size


def bands(percent: int, largest: int) -> np.ndarray:
    """First sizes of the bands: the sizes that may link with one are in its band or in a neighbouring one."""
    first = [1]
    while first[-1] <= largest:
        first.append(max(first[-1] + 1, -(-first[-1] * 100 // percent)))
    return np.array(first, np.int64)


def part_keys(
    of: np.ndarray,
    element: np.ndarray,
    node: np.ndarray,
    size: np.ndarray,
    percent: int,
    frequent: tuple[np.ndarray, np.ndarray] | None = None,
):
    """(key, node) of the parts of every set, by the cuts of its band and of the band below; see `marked_keys`."""
    return marked_keys(of, element, node, size, percent, frequent)[:2]


def marked_keys(
    of: np.ndarray,
    element: np.ndarray,
    node: np.ndarray,
    size: np.ndarray,
    percent: int,
    frequent: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, node, mark) of the parts of every set, by the cuts of its band and of the band below.

    `frequent` (keys ascending, their counts) leads a common order of all keys, the most frequent first. Two linked sets
    agree on as many parts as a cut has beyond the elements in which they may differ. So each set may leave out its
    first ones in that order, one less than these (and less its empty parts, which have no key): the last key that two
    linked sets share is never among them. A mark is the cut (upper half) and how many more of its keys in that cut the
    set may leave out, which has none left in `frequent` then; 0 for keys that must stay.
    """
    keys, owners, marks = [], [], []
    first = bands(percent, int(size.max(initial=1)))
    band = np.searchsorted(first, size, side="right") - 1
    for below in (0, 1):
        b = band - below
        use = (size > 0) & (b >= 0)
        differ = (first[np.clip(b, 0, None) + 1] - 1) * (100 - percent) // percent
        parts = differ + 1 + SPARE + differ // 8
        use &= differ > 0  # else only equal sets link, and they are one node
        mine = use[of]
        o, e = of[mine], element[mine]
        if not len(o):
            continue
        part = ((e >> np.uint64(32)) * parts[o].astype(np.uint64)) >> np.uint64(32)
        new = np.ones(len(o), bool)
        new[1:] = (o[1:] != o[:-1]) | (part[1:] != part[:-1])
        begin = np.flatnonzero(new)
        o, part = o[begin], part[begin]
        filled = np.bincount(o, minlength=len(size))
        content = sums(mix(element[mine] ^ np.uint64(0x5851F42D4C957F2D)), begin)
        cut = mix(parts.astype(np.uint64))
        key = mix(content ^ mix(cut[o] + part))
        spare = np.maximum(filled - differ - 1, 0)
        stay = without_frequent(o, key, spare, frequent)
        left = spare - filled + np.bincount(o[stay], minlength=len(size))
        keys.append(key[stay])
        owners.append(node[o[stay]])
        marks.append(((parts << 32) + left)[o[stay]])
        bare = np.flatnonzero(use & (parts - filled >= parts - differ))
        for i in bare:  # sets with so many empty parts that they may be all that agrees
            empty = np.setdiff1d(np.arange(parts[i], dtype=np.uint64), part[o == i])
            keys.append(mix(mix(cut[i] + empty) + np.uint64(1)))
            owners.append(np.full(len(empty), node[i]))
            marks.append(np.zeros(len(empty), np.int64))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(marks)


def without_frequent(
    of: np.ndarray, key: np.ndarray, spare: np.ndarray, frequent: tuple[np.ndarray, np.ndarray] | None
) -> np.ndarray:
    """Places of the keys that stay when each set leaves out its `spare` most frequent ones, if it has that many."""
    if frequent is None or not len(frequent[0]):
        return np.arange(len(key))
    known, count = frequent
    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
    hit = np.flatnonzero(known[at] == key)
    order = hit[np.lexsort((key[hit], -count[at[hit]], of[hit]))]
    begins = np.append(True, of[order][1:] != of[order][:-1])[: len(order)]
    place = np.arange(len(order))
    rank = place - np.maximum.accumulate(np.where(begins, place, 0))
    stay = np.ones(len(key), bool)
    stay[order[rank < spare[of[order]]]] = False
    return np.flatnonzero(stay)


def local_roots(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct nodes, and the smallest node of each one's component by shared keys; rows are in the order of the key."""
    names, position = np.unique(node, return_inverse=True)
    label = np.arange(len(names))
    by_key = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    of_key = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
    order = np.argsort(position, kind="stable")
    by_node = np.flatnonzero(np.append(True, position[order][1:] != position[order][:-1]))
    while len(names):
        least = np.minimum.reduceat(label[position], by_key)[of_key]
        new = label[np.minimum.reduceat(least[order], by_node)]
        if (new == label).all():
            break
        label = new
    return names, names[label]


def combined(key: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys with one node for each component of these rows, and the components as stars.

    An edge of a star is two rows with a key of their own. So a key that very many nodes of one family share brings one
    row for each batch to the shuffle, and a node one edge.
    """
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    first = np.append(True, key[1:] != key[:-1])[: len(key)]
    shared = ~first
    shared[:-1] |= ~first[1:]
    names, root = local_roots(key[shared], node[shared])
    star = names != root
    own = mix(mix(root[star]) + names[star])
    node = node.copy()
    node[shared] = root[np.searchsorted(names, node[shared])]
    new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[: len(key)]
    return np.concatenate([key[new], own, own]), np.concatenate([node[new], root[star], names[star]])


def combined_marked(key: np.ndarray, node: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for marked keys. Only nodes that share more keys than they may leave out are taken for one family.

    A family's keys are one list. It may leave out as many as its member that may leave out the fewest: what two linked
    sets share is lost from its begin in the common order only, and never more than each of the two may lose.
    """
    key, node, mark = distinct(key, node, mark)
    same = key[1:] == key[:-1]
    first = np.append(True, ~same)[: len(key)]
    n = np.bincount(np.cumsum(first) - 1)[np.cumsum(first) - 1]
    some = np.flatnonzero(n > 1)
    order = some[np.lexsort((key[some], -n[some], mark[some] >> 32, node[some]))]
    by, cut = node[order], mark[order] >> 32
    begins = np.append(True, (by[1:] != by[:-1]) | (cut[1:] != cut[:-1]))[: len(order)]
    place = np.arange(len(order))
    rank = place - np.maximum.accumulate(np.where(begins, place, 0))
    use = np.sort(order[rank >= mark[order] & 0xFFFFFFFF])
    names, root = local_roots(key[use], node[use])
    star = names != root
    own = mix(mix(root[star]) + names[star])
    if len(names):
        at = np.minimum(np.searchsorted(names, node), len(names) - 1)
        node = np.where(names[at] == node, root[at], node)
    key, node, mark = distinct(key, node, mark)
    stays = np.zeros(2 * len(own), np.int64)
    return np.concatenate([key, own, own]), np.concatenate([node, root[star], names[star]]), np.concatenate([mark, stays])


def distinct(key: np.ndarray, node: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """In the order of key and node, the smallest mark of each."""
    order = np.lexsort((mark, node, key))
    key, node, mark = key[order], node[order], mark[order]
    new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))[: len(key)]
    return key[new], node[new], mark[new]


def shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, node, mark, n) of the keys of several nodes, from rows in the order of all three columns.

    `n` counts the nodes of a key up to COUNTED, and no more rows of a key are held.
    """
    held = [np.zeros(0, np.int64)] * 3
    over = None  # a key of COUNTED rows or more, some of which are gone already
    for batch in chain(batches, [None]):
        if batch is not None:
            held = [np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate(held)]
        key, node, mark = held
        if not len(key):
            continue
        new = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
        key, node, mark = key[new], node[new], mark[new]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        n = np.minimum(np.diff(np.append(first, len(key))), COUNTED)
        if over is not None and key[0] == over:
            n[0] = COUNTED
        whole = len(key) if batch is None or n[-1] == COUNTED else int(first[-1])
        over = key[-1] if n[-1] == COUNTED else None
        n = np.repeat(n, np.diff(np.append(first, len(key))))
        some = np.flatnonzero(n[:whole] > 1)
        held = [key[whole:], node[whole:], mark[whole:]]
        if len(some):
            columns = [pa.array(x[some]) for x in (key, node, mark, n)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "mark", "n"])


def without_most_frequent(shared: DataFrame) -> DataFrame:
    """(key, node) without the keys that the nodes leave out: their most frequent ones, as many as the marks allow."""
    cut, left = F.shiftright("mark", 32).alias("cut"), F.col("mark").bitwiseAND(F.lit(0xFFFFFFFF)).alias("left")
    whole = Window.partitionBy("node", "cut")
    place = F.row_number().over(whole.orderBy(F.desc("n"), "key"))
    ranked = shared.select("key", "node", "n", cut, left).withColumn("place", place)
    return ranked.withColumn("left", F.min("left").over(whole)).where("place > left").select("key", "node")


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


class TOccurrence:
    """Inverted lists of some sets, and the search for sets that overlap enough."""

    #: weight of a probe against a merge step in the choice of the long lists
    MU = 0.01

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")  # owners stay ascending inside a list
        flat, self.owner = flat[order], owner[order]
        start = np.ones(len(flat), bool)
        start[1:] = flat[1:] != flat[:-1]
        self.begin = np.append(np.flatnonzero(start), len(flat))
        self.keys = flat[start]

    def search(self, query: np.ndarray, skip: np.ndarray | None = None) -> np.ndarray:
        """Positions of the indexed sets that link with the query; `skip` marks sets that needn't be looked at."""
        n = len(query)
        at = np.searchsorted(self.keys, query)
        at = at[at < len(self.keys)] if len(self.keys) else at[:0]
        at = at[np.isin(self.keys[at], query)]
        need = -(-self.percent * n // 100)  # an overlap that links is at least this large
        if len(at) < need:
            return np.zeros(0, np.int64)
        begin, end = self.begin[at], self.begin[at + 1]
        by_length = np.argsort(end - begin, kind="stable")
        begin, end = begin[by_length], end[by_length]
        longest = int(end[-1] - begin[-1])
        n_long = min(need - 1, int(need / (self.MU * np.log2(max(longest, 2)) + 1)))
        short, long = len(at) - n_long, range(len(at) - n_long, len(at))
        merged = np.concatenate([self.owner[a:b] for a, b in zip(begin[:short], end[:short])])
        candidate, count = np.unique(merged, return_counts=True)
        keep = count >= need - n_long
        size = self.sizes[candidate]
        keep &= (100 * size >= self.percent * n) & (100 * n >= self.percent * size)
        if skip is not None:
            keep &= ~skip[candidate]
        candidate, count = candidate[keep], count[keep]
        union_need = -(-self.percent * (n + self.sizes[candidate]) // (100 + self.percent))
        for left, i in zip(range(n_long, 0, -1), long):
            if not len(candidate):
                break
            row = self.owner[begin[i] : end[i]]
            where = np.minimum(np.searchsorted(row, candidate), len(row) - 1)
            count = count + (row[where] == candidate)
            possible = count + left - 1 >= union_need
            if not possible.all():
                candidate, count, union_need = candidate[possible], count[possible], union_need[possible]
        return candidate[count >= union_need]


class Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: int, others: np.ndarray) -> list[int]:
        """Joins a with others; returns those that were not joined yet."""
        new = []
        for b in others.tolist():
            x, y = self.root[a], self.root[b]
            if x != y:
                self.root[self.root == max(x, y)] = min(x, y)
                new.append(b)
        return new


def links_inside(nodes: np.ndarray, sets: list[np.ndarray], percent: int, known: np.ndarray, asked: np.ndarray):
    """Forest of links: each asked set against all sets of the task; sets of one `known` component are joined already."""
    index = TOccurrence(sets, percent)
    forest = Forest(len(sets))
    first: dict[int, int] = {}
    for i, label in enumerate(known.tolist()):
        forest.root[i] = first.setdefault(label, i)
    a, b = [], []
    for i in np.flatnonzero(asked):
        found = index.search(sets[i], skip=forest.root == forest.root[i])
        for j in forest.join(i, found):
            a.append(nodes[i])
            b.append(nodes[j])
    return a, b


def small(df: DataFrame) -> DataFrame:
    """The frame, to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def describe(rows: DataFrame, words: int) -> DataFrame:
    """(id, n_shingles, node) of every row (id, text)."""
    kind = rows.schema["id"].dataType.simpleString()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, of, element in sets_of(batch.column(1), words):
                node, size = nodes_of(of, element, b - a)
                columns = [batch.column(0).slice(a, b - a), pa.array(size.astype(np.int64)), signed(node)]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n_shingles", "node"])

    return written(arrow_map(rows, sizes, f"id {kind}, n_shingles long, node long"), "sets")


def frequent_keys(rows: DataFrame, words: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent part keys (ascending) and their counts, FREQUENT at most.

    Counts cover all texts, by keys that come up repeatedly in a slice. They only order the keys: any order is exact.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held = [], 0
            for a, b, of, element in sets_of(batch.column(0), words):
                node, size = nodes_of(of, element, b - a)
                new = np.append(True, node[1:] != node[:-1])  # neighbouring copies count once
                key, owner = part_keys(of, element, node, np.where(new, size, 0), percent)
                keys.append(key)
                held += len(key)
                if held >= 4 * KEYS:
                    yield repeated(keys)
                    keys, held = [], 0
            if keys:
                yield repeated(keys)

    def repeated(keys: list[np.ndarray]) -> pa.RecordBatch:
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        some = np.flatnonzero(n > 1)
        some = some[np.argsort(-n[some], kind="stable")[: KEYS // 8]]
        return pa.RecordBatch.from_arrays([signed(key[some]), pa.array(n[some].astype(np.int64))], names=["key", "n"])

    counts = arrow_map(rows.select("text"), count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    counts = written(counts, "key-counts")
    step = F.floor(8 * F.log2("n"))
    steps = counts.groupBy(step.alias("step")).agg(F.count("*").alias("keys")).collect()  # a few hundred at most
    least, held = 0, 0
    for row in sorted(steps, reverse=True):
        held += row["keys"]
        if held > FREQUENT:
            least = row.step + 1
            break
    found = counts.where(step >= least).collect()  # FREQUENT rows at most
    key = np.array([r["key"] for r in found], np.int64).view(np.uint64)
    n = np.array([r.n for r in found], np.int64)
    order = np.argsort(key)
    return key[order], n[order]


def shards_of(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, component) by the routing parts; nothing else of the routing outlives this call."""
    leave_out = frequent_keys(rows, words, percent) if percent < FULL_PARTS else None
    frequent = rows.sparkSession.sparkContext.broadcast(leave_out)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, n = [], 0
            for a, b, of, element in sets_of(batch.column(0), words):
                node, size = nodes_of(of, element, b - a)
                held.append(marked_keys(of, element, node, size, percent, frequent.value))
                n += len(held[-1][0])
                if n >= KEYS:
                    yield met(held)
                    held, n = [], 0
            if held:
                yield met(held)

    def met(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, node, mark = (np.concatenate(x) for x in zip(*held))
        rows = combined(key, node) if frequent.value is None else combined_marked(key, node, mark)
        return pa.RecordBatch.from_arrays([signed(x) for x in rows], names=["key", "node", "mark"][: len(rows)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key = last_node = None
        for batch in batches:
            key, node = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(key):
                continue
            start = np.ones(len(key), bool)
            start[1:] = key[1:] != key[:-1]
            least = node[np.maximum.accumulate(np.where(start, np.arange(len(key)), 0))]
            if key[0] == last_key:
                least = np.where(key == last_key, last_node, least)
            last_key, last_node = key[-1], least[-1]
            other = least != node
            pairs = np.unique(np.column_stack([least[other], node[other]]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    if leave_out is None:
        parts = arrow_map(rows.select("text"), route, "key long, node long")
    else:
        parts = arrow_map(rows.select("text"), route, "key long, node long, mark long")
        parts = parts.repartition("key").sortWithinPartitions("key", "node", "mark")
        parts = without_most_frequent(arrow_map(parts, shared_keys, "key long, node long, mark long, n long"))
    return components(arrow_map(parts.repartition("key").sortWithinPartitions("key", "node"), meet, "a long, b long"))


def searched(rows: DataFrame, wanted: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): forest of the links that the tasks find.

    `wanted` has a row (task, node, one, known, asked) for each set of each task; `one` is an id whose text has the set.
    The sets are made again from the texts and go to their tasks only, they are never stored.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, of, element in sets_of(batch.column(1), words):
                node, size = nodes_of(of, element, b - a)
                ends = np.cumsum(size)
                sets = [element[e - s : e].tobytes() for e, s in zip(ends, size)]
                columns = [batch.column(0).slice(a, b - a), signed(node), pa.array(sets, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "elements"])

    def search(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["asked", "node"], ascending=[False, True]).drop_duplicates("node")
        nodes = frame["node"].to_numpy()
        elements = [np.frombuffer(x, np.uint64) for x in frame["elements"]]
        a, b = links_inside(nodes, elements, percent, frame["known"].to_numpy(), frame["asked"].to_numpy())
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    brought = arrow_map(rows, bring, f"id {kind}, node long, elements binary")
    sets = brought.join(small(wanted), "node").where(F.col("id").eqNullSafe(F.col("one")))
    tasks = sets.select("task", "node", "elements", "known", "asked").groupBy("task")
    return written(tasks.applyInPandas(search, "a long, b long"), "links")


def classes(documents: DataFrame, words: int, percent: int, id_column: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(id, n_shingles, node) of every row, and (node, component) of the nodes that link with others."""
    rows = documents.select(F.col(id_column).alias("id"), F.col("text"))
    described = describe(rows, words)
    shard_of = shards_of(rows, words, percent)

    # the shards' sizes decide how they are dealt to tasks
    one = described.where("node != 0").groupBy("node").agg(F.min("id").alias("one"), F.max("n_shingles").alias("n"))
    shard = shard_of.join(one, "node").select("node", "one", "n", F.col("component").alias("shard"))
    shard = written(shard, "shards")
    per_shard = shard.groupBy("shard").agg(F.sum(F.col("n") + SKETCH).alias("weight"))
    all_weight = per_shard.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    tasks = max(1, -(-int(all_weight) // TASK_SHINGLES))
    blocks = F.ceil(F.col("weight") / TASK_SHINGLES)
    block = F.when(blocks > 1, F.pmod(F.xxhash64("node"), blocks)).otherwise(F.lit(-1))
    task = F.when(F.col("block") >= 0, F.xxhash64("shard", "block")).otherwise(F.pmod(F.xxhash64("shard"), F.lit(tasks)))
    dealt = shard.join(per_shard, "shard").withColumn("block", block).withColumn("task", task)
    dealt = written(dealt.drop("weight"), "dealt")
    large = dealt.where("block >= 0")
    to_block = large.select("shard", F.xxhash64("shard", "block").alias("task")).distinct()

    def wanted(sets: DataFrame, asked: bool, known: str = "node") -> DataFrame:
        return sets.select("task", "node", "one", F.col(known).alias("known"), F.lit(asked).alias("asked"))

    leaders = shard_leaders(large).drop("task").join(to_block, "shard")
    found = searched(rows, wanted(dealt, True).unionByName(wanted(leaders, True)), words, percent)
    if large.isEmpty():
        return described, components(found)

    # sets of large shards outside the largest component so far may link with any other; sketches say with which
    so_far = components(found.join(large.select(F.col("node").alias("a")), "a", "left_semi"))
    state = large.join(so_far, "node", "left").withColumn("known", F.coalesce("component", "node"))
    state = written(state.drop("component"), "shard-state")
    near = components(sketched(rows, *outside_and_hosts(state, to_block, F.lit(SKETCH)), words, percent))
    state = written(state.drop("shard", "task", "block").join(near, "node").withColumnRenamed("component", "shard"), "near")

    # what is left are smaller shards, dealt and searched like the first ones; each outsider meets all blocks of its own
    per_near = state.groupBy("shard").agg(F.sum(F.col("n") + SKETCH).alias("weight"))
    tasks = max(1, -(-int(per_near.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]) // TASK_SHINGLES))
    block = F.when(blocks > 1, F.pmod(F.xxhash64("node"), blocks)).otherwise(F.lit(-1))
    state = state.join(per_near, "shard").withColumn("block", block).withColumn("task", near_task(tasks))
    state = written(state.drop("weight"), "near-dealt")
    split = state.where("block >= 0")
    to_near = split.select("shard", "task").distinct()
    visiting, hosts = outside_and_hosts(split, to_near, F.col("n"))
    again = wanted(state.where("block < 0"), True, "known").unionByName(wanted(visiting, True, "known"))
    again = again.unionByName(wanted(hosts, False, "known"))
    return described, components(found.unionByName(searched(rows, again, words, percent)))


def near_task(tasks: int) -> Column:
    whole = F.pmod(F.xxhash64("shard"), F.lit(tasks))
    return F.when(F.col("block") >= 0, F.xxhash64("shard", "block")).otherwise(whole)


def outside_and_hosts(state: DataFrame, to_task: DataFrame, weight: Column) -> tuple[DataFrame, DataFrame]:
    """Sets outside their shard's largest known component, for each task of the shard; and its sets, where they are.

    Every pair of sets that isn't connected yet has one of the first. Where these are many, each task of the shard is
    split into parts by the sum of their `weight`: a set outside visits one part of every task, and a set at home is in all parts of its own. So a
    task holds a block of visitors and a block of hosts, of bounded size both.
    """
    count = state.groupBy("shard", "known").agg(F.count("*").alias("n"))
    main = count.groupBy("shard").agg(F.max(F.struct("n", "known")).alias("m"))
    outside = state.join(main, "shard").where("known != m.known").drop("m")
    parts = F.ceil(F.sum(weight) / TASK_SHINGLES).cast("int").alias("parts")
    per_shard = outside.groupBy("shard").agg(parts)
    one = F.pmod(F.xxhash64("node", F.lit(2)), F.col("parts")).cast("int")
    visiting = outside.drop("task").join(per_shard, "shard").withColumn("part", one).join(to_task, "shard")
    hosts = state.join(per_shard, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    task = F.when(F.col("parts") > 1, F.xxhash64("task", "part")).otherwise(F.col("task"))
    return tuple(x.withColumn("task", task).drop("parts", "part") for x in (visiting, hosts))


def sketched(rows: DataFrame, visiting: DataFrame, hosts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): forest of the pairs of a visiting set and a host that may link, by counts of their elements in CELLS cells.

    Two sets differ in at least as many elements as their counts do, so a pair that differs in more counts than linked
    sets differ in elements isn't linked. Only the counts go to the tasks.
    """
    kind = rows.schema["id"].dataType.simpleString()
    shift = np.uint64(64 - int(np.log2(CELLS)))

    def bring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, of, element in sets_of(batch.column(1), words):
                node, size = nodes_of(of, element, b - a)
                cell = of * CELLS + (element >> shift).astype(np.int64)
                counts = np.minimum(np.bincount(cell, minlength=(b - a) * CELLS), 32_767).astype(np.int16)
                sketch = [x.tobytes() for x in counts.reshape(b - a, CELLS)]
                columns = [batch.column(0).slice(a, b - a), signed(node), pa.array(sketch, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "node", "sketch"])

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n", "node", "visits"], kind="stable").reset_index(drop=True)
        counts = np.stack([np.frombuffer(x, np.int16) for x in frame["sketch"]])
        node, size, known = (frame[c].to_numpy() for c in ("node", "n", "known"))
        host = np.flatnonzero(~frame["visits"].to_numpy())
        forest = Forest(len(frame))
        a, b = [], []
        for i in np.flatnonzero(frame["visits"]):
            low = np.searchsorted(size[host], -(-percent * size[i] // 100))
            high = np.searchsorted(size[host], 100 * size[i] // percent, side="right")
            some = host[low:high]
            differ = np.abs(counts[some] - counts[i]).sum(axis=1, dtype=np.int64)
            some = some[(100 + percent) * differ <= (100 - percent) * (size[some] + size[i])]
            for j in forest.join(i, some[known[some] != known[i]]):
                a.append(node[i])
                b.append(node[j])
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    wanted = visiting.withColumn("visits", F.lit(True)).unionByName(hosts.withColumn("visits", F.lit(False)), True)
    wanted = wanted.select("task", "node", "one", "n", "known", "visits")
    brought = arrow_map(rows, bring, f"id {kind}, node long, sketch binary")
    sketches = brought.join(small(wanted), "node").where(F.col("id").eqNullSafe(F.col("one")))
    tasks = sketches.select("task", "node", "sketch", "n", "known", "visits").groupBy("task")
    return written(tasks.applyInPandas(compare, "a long, b long"), "near-pairs")


def shard_leaders(large: DataFrame) -> DataFrame:
    """LEADERS sets of each large shard, about: those whose node's hash is the smallest in one of as many classes."""
    lead = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(LEADERS))
    pick = large.groupBy("shard", lead.alias("lead")).agg(F.min("node").alias("node")).select("node").distinct()
    return large.join(pick, "node", "left_semi")


def ngram_join(documents: DataFrame, *, words: int = 3, percent: int = 90, id_column: str = "doc_id") -> DataFrame:
    """id, n_shingles, component_id of every row, and n_nodes: different sets in its component (1 without a link)."""
    described, linked = classes(documents, words, percent, id_column)
    by_node = described.where("node != 0").groupBy("node").agg(F.min("id").alias("least"))
    named = by_node.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named, "named")
    per = named.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n_nodes"))
    # only components of several nodes need the join; the others name themselves
    alone = per.where("n_nodes = 1").select(F.col("component").alias("node"), "component_id", "n_nodes")
    many = named.join(per.where("n_nodes > 1"), "component").select("node", "component_id", "n_nodes")
    out = described.join(alone.unionByName(many), "node", "left")
    return out.select(
        F.col("id").alias(id_column),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_nodes", F.lit(1)).alias("n_nodes"),
    )


def tagged(documents: DataFrame, words: int) -> DataFrame:
    """(row, id, node): whole rows with the node of their text."""
    rows = documents.select(F.struct(*documents.columns).alias("row"), "text")
    schema = StructType([rows.schema["row"], StructField("node", LongType())])

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, of, element in sets_of(batch.column(1), words):
                node, _ = nodes_of(of, element, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), signed(node)], names=["row", "node"])

    return arrow_map(rows, tag, schema).select("row", F.col("row.doc_id").alias("id"), "node")


def keep_one(documents: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of linked documents, and all rows without a set; all columns.

    The row with the smallest doc_id stays, null ids last, then the smallest set; rows with one doc_id and different
    texts are judged by their own texts. Of rows that are equal in id and set the one with the smallest text stays.
    """
    described, linked = classes(documents, words, percent)
    named = described.where("node != 0").groupBy("id", "node").agg(F.count("*").alias("rows"))
    named = named.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = written(named, "named")
    first = F.struct(F.col("id").isNull().alias("unnamed"), "id", "node")
    groups = named.groupBy("component").agg(F.min(first).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = named.join(small(groups), "component").where("NOT (node = first.node AND id <=> first.id)")
    gone = small(written(gone.select(F.col("id").alias("gone_id"), F.col("node").alias("gone_node")), "gone"))
    rows = tagged(documents, words)
    rows = rows.join(gone, F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("node") == F.col("gone_node")), "left_anti")
    if not named.where("rows > 1").isEmpty():
        one = rows.where("node != 0").groupBy("id", "node").agg(F.min_by("row", "row.text").alias("row"))
        rows = rows.where("node = 0").select("row").unionByName(one.select("row"))
    return rows.select([F.col("row")[c].alias(c) for c in documents.columns])
