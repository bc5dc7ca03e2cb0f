"""Shards by balanced label propagation.

Documents with equal text are linked. Every row starts in a shard of its own hash. In each round Spark counts the
members of every group per shard (pre-aggregated), and rows outside their group's most frequent shard ask to move
there. A shard admits movers in the order of their gain up to its quota: its capacity less the linked rows it already
holds. Where most rows are linked no shard has such room and propagation ends early; the groups it leaves cut are then
dealt anew: Spark counts groups by size, the driver packs these counts, largest first, into the room that whole groups
leave, and if that cuts more than it must, into empty shards. Unlinked rows have no cut to mind and make room
afterwards: the last step moves the surplus of each shard, unlinked rows first, so that the counts of all shards are at
most one apart (law `rows`).

Only a group larger than a shard, or than the room left everywhere, is cut: it fills the emptiest shards, so there are
at most as many cut groups as shards. The distinct sizes that the driver sees grow with the root of the rows. Joins on groups are salted, ranks within a
shard are made of chunk counts and ranks inside chunks of bounded size, and every round is written to the shared folder.

Null text counts as empty: 1 byte of size, crc 0, one group with the empty texts. Every row, repeated ones and rows with
null ids included, gets a slot of its own. An empty table gives an empty result; other columns stay out of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldcast.llm.common import written

#: rows of a chunk, inside of which one task ranks
CHUNK = 50_000
#: copies of a group's row in joins, so that a hot group is spread
SALT = 16
#: steps of a quota: movers of one step are admitted together
STEPS = 256
ROUNDS = 6


def ranked(df: DataFrame, key: str, first: Column, n_rows: int) -> DataFrame:
    """`rank`: gapless from 0 within `key`, rows with smaller `first` (a small whole number) before others."""
    chunks = max(1, -(-n_rows // CHUNK))
    dealt = df.withColumn("first", first).withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    counts = dealt.groupBy(key, "first", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("first", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "first", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy(key, "first", "chunk").orderBy("row")
    placed = dealt.withColumn("inside", F.row_number().over(inside) - 1).join(offsets, [key, "first", "chunk"])
    return placed.withColumn("rank", F.col("before") + F.col("inside")).drop("first", "chunk", "before", "inside")


def case(pairs: list[tuple[Column, object]], otherwise: object) -> Column:
    out = reduce(lambda w, p: w.when(p[0], F.lit(p[1])), pairs[1:], F.when(pairs[0][0], F.lit(pairs[0][1])))
    return out.otherwise(F.lit(otherwise))


def move(rows: DataFrame, shards: int, capacity: int) -> tuple[DataFrame, int]:
    """One round: rows with new labels, and the number of rows that moved."""
    linked = {r.label: r.n for r in rows.where("linked").groupBy("label").agg(F.count("*").alias("n")).collect()}
    free = [max(0, capacity - linked.get(s, 0)) for s in range(shards)]
    held = rows.where("linked").groupBy("group", "label").agg(F.count("*").alias("n"))
    # a group's pile in a full shard stays there; the others gather in the largest pile that can grow
    open_pile = F.when(case([(F.col("label") == s, free[s] > 0) for s in range(shards)], False), F.col("n"))
    pile = F.struct(open_pile.alias("n"), (-F.col("label")).alias("minus"))
    best = held.groupBy("group").agg(
        F.sum("n").alias("size"), F.max(F.when(open_pile.isNotNull(), pile)).alias("best")
    ).where("best is not null")
    wishes = (
        held.join(best, "group")
        .select("group", "label", "n", "size", (-F.col("best.minus")).alias("target"), F.col("best.n").alias("there"))
        .where("there > n or (there = n and target < label)")
        .withColumn("gain", F.col("there") - F.col("n") + 1)
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        .select("group", "label", "salt", "target", "gain", "size")
    )
    asked = rows.withColumn("salt", F.pmod(F.col("row"), F.lit(SALT)).cast("int")).join(
        wishes, ["group", "label", "salt"], "left"
    )
    # large groups are admitted in parts, others whole
    by = F.when(F.col("size") * STEPS > capacity, F.col("row")).otherwise(F.col("group"))
    asked = asked.withColumn("step", -F.floor(F.log2("gain")) * STEPS + F.pmod(F.xxhash64(by), F.lit(STEPS)))
    asked = written(asked.drop("salt", "gain", "size"), "shard-wishes")
    room = case([(F.col("target") == s, free[s]) for s in range(shards)], 0)
    # shards x 64 classes of gain x STEPS rows at most
    demand = asked.where("target is not null").groupBy("target", "step").agg(F.count("*").alias("n"))
    so_far = F.sum("n").over(Window.partitionBy("target").orderBy("step"))
    admitted = demand.where("n > 0").select("target", "step", (so_far <= room).alias("admitted"))
    moved = asked.join(F.broadcast(admitted), ["target", "step"], "left")
    label = F.when(F.coalesce("admitted", F.lit(False)), F.col("target")).otherwise(F.col("label"))
    out = written(
        moved.select(*[c for c in rows.columns if c != "label"], label.cast("int").alias("label"), "admitted"),
        "shard-labels",
    )
    return out.drop("admitted"), out.where("admitted").count()


def packed(sizes: dict[int, int], room: list[int]) -> tuple[list[tuple[int, int, int, int]], list[tuple], int] | None:
    """Groups, given as size -> count, in the room of each shard: (size, from rank, to rank, shard) of those kept whole,
    (size, rank, [(rows, shard), ...]) of those cut, and the number of cuts; None where the rows exceed the room."""
    room = [max(0, r) for r in room]
    if sum(size * n for size, n in sizes.items()) > sum(room):
        return None
    whole, cut = [], []
    for size in sorted(sizes, reverse=True):
        rank = 0
        while rank < sizes[size]:
            n = min(sizes[size] - rank, sum(r // size for r in room))
            if n:
                # the highest level of room to which the shards can be filled by n groups
                level, above = 0, max(room) + 1
                while above - level > 1:
                    middle = (level + above) // 2
                    if sum(max(0, r - middle) // size for r in room) >= n:
                        level = middle
                    else:
                        above = middle
                for shard in sorted(range(len(room)), key=lambda s: (-room[s], s)):
                    here = min(n, max(0, room[shard] - level) // size)
                    if here:
                        whole.append((size, rank, rank + here, shard))
                        room[shard] -= here * size
                        rank += here
                        n -= here
                continue
            left, pieces = size, []
            while left:
                # the smallest room that takes the rest, else the largest
                fits = [s for s in range(len(room)) if room[s] >= left]
                shard = min(fits, key=lambda s: (room[s], s)) if fits else max(range(len(room)), key=lambda s: (room[s], -s))
                pieces.append((min(left, room[shard]), shard))
                room[shard] -= pieces[-1][0]
                left -= pieces[-1][0]
            cut.append((size, rank, pieces))
            rank += 1
    return whole, cut, sum(len(p) - 1 for _, _, p in cut)


def settled(rows: DataFrame, due: list[int], n_rows: int) -> DataFrame:
    """Rows with the groups that propagation left cut dealt anew."""
    held = rows.where("linked").groupBy("group", "label").agg(F.count("*").alias("n"))
    groups = held.groupBy("group").agg(
        F.sum("n").alias("size"), F.count("*").alias("pieces"), F.max("label").alias("home")
    )
    groups = written(groups, "shard-groups")
    known = groups.groupBy("size", (F.col("pieces") > 1).alias("cut")).agg(F.count("*").alias("n")).collect()
    loose = {r["size"]: r.n for r in known if r.cut}
    if not loose:
        return rows
    every: dict[int, int] = {}
    for r in known:
        every[r["size"]] = every.get(r["size"], 0) + r.n
    taken = groups.where("pieces = 1").groupBy("home").agg(F.sum("size").alias("n"))
    taken = {r.home: r.n for r in taken.collect()}
    plan, pool = packed(loose, [d - taken.get(s, 0) for s, d in enumerate(due)]), groups.where("pieces > 1")
    if any(n > due[s] for s, n in taken.items()):
        plan = None
    least = sum((-(-size // max(due)) - 1) * n for size, n in every.items())
    if plan is None or plan[2] > least:
        anew = packed(every, due)
        if plan is None or anew[2] < plan[2]:
            plan, pool = anew, groups
    whole, cut, _ = plan
    dealt = ranked(pool.select("group", "size", F.col("group").alias("row")), "size", F.lit(0), n_rows)
    spark = rows.sparkSession
    quotas = spark.createDataFrame(whole, "size long, begin long, stop long, target int")
    inside = (F.col("rank") >= F.col("begin")) & (F.col("rank") < F.col("stop"))
    dealt = written(dealt.select("group", "size", "rank"), "shard-ranks")
    placed = dealt.join(F.broadcast(quotas.withColumnRenamed("size", "of")), (F.col("size") == F.col("of")) & inside)
    salted = placed.select("group", "target", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    split = {}
    for size, rank, pieces in cut:
        split[dealt.where((F.col("size") == size) & (F.col("rank") == rank)).first().group] = pieces
    some = F.col("group").isin(list(split)) if split else F.lit(False)
    kept = (
        rows.where(~some | ~F.col("linked"))
        .withColumn("salt", F.pmod(F.col("row"), F.lit(SALT)).cast("int"))
        .join(salted, ["group", "salt"], "left")
        .withColumn("label", F.coalesce("target", "label"))
        .select(rows.columns)
    )
    if split:
        parts = []
        for group, pieces in split.items():
            stop = 0
            for n, shard in pieces:
                stop += n
                parts.append(((F.col("group") == group) & (F.col("rank") < stop), shard))
        cuts = ranked(rows.where(some & F.col("linked")), "group", F.lit(0), n_rows)
        kept = kept.unionByName(cuts.withColumn("label", case(parts, 0)).select(rows.columns))
    return written(kept, "shard-labels")


def balanced_shards(
    documents: DataFrame, shards: int = 8, *, rounds: int = ROUNDS, id_column: str = "doc_id"
) -> DataFrame:
    """id, size, text_crc32, law, shard, slot and grown_shard (null: law `rows` has no stable growth) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = documents.select(
        F.col(id_column).alias("id"),
        (F.octet_length(text).cast("long") + 1).alias("size_"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.xxhash64(text, F.crc32(text.cast("binary")), F.octet_length(text)).alias("group"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = written(rows, "shard-rows")
    n = rows.count()
    sizes = rows.groupBy("group").agg(F.count("*").alias("members")).where("members > 1")
    salted = sizes.select("group", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("salt"))
    rows = (
        rows.withColumn("salt", F.pmod(F.col("row"), F.lit(SALT)).cast("int"))
        .join(salted.withColumn("linked", F.lit(True)), ["group", "salt"], "left")
        .withColumn("linked", F.coalesce("linked", F.lit(False)))
        .withColumn("label", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
        .drop("salt")
    )
    rows = written(rows, "shard-labels")
    for _ in range(rounds):
        rows, moved = move(rows, shards, n // shards)
        if not moved:
            break
    due = [n // shards + (s < n % shards) for s in range(shards)]
    rows = settled(rows, due, n)
    held = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    surplus = [max(0, held.get(s, 0) - due[s]) for s in range(shards)]
    given = [sum(surplus[:s]) for s in range(shards)]
    lacking, taken = [], 0
    for s in range(shards):
        taken += max(0, due[s] - held.get(s, 0))
        lacking.append(taken)
    at = F.col("label")
    leaves = F.col("rank") < case([(at == s, surplus[s]) for s in range(shards)], 0)
    place = F.col("rank") + case([(at == s, given[s]) for s in range(shards)], 0)
    target = case([(place < lacking[s], s) for s in range(shards)], shards - 1)
    evened = ranked(rows, "label", F.col("linked").cast("int"), n).withColumn(
        "shard", F.when(leaves, target).otherwise(at).cast("int")
    )
    out = ranked(written(evened.drop("rank"), "shard-evened"), "shard", F.lit(0), n)
    return out.select(
        F.col("id").alias(id_column),
        F.col("size_").alias("size"),
        F.col("crc").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        F.col("rank").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
