"""One ranking from several differently-scaled scores: a Markov chain that walks up the rankings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.session import discard, stored, task_count

#: Probability of following a score; else the walk starts anew at any item of the group.
DAMPING = 0.85
#: The walk has settled when no item's mass changes by more than this share of it (or of the mean, if that is more)...
SETTLED = 1e-13
#: ... which it must within so many rounds: changes shrink at least by DAMPING a round, so they do for any size of group.
MOST_ROUNDS = 400
#: Groups up to so many items are walked within one task; larger ones by distributed prefix sums.
LOCAL = 1_000_000
#: Items of a large group that are summed up together.
STRIP = 4096
#: Rounds between two looks at whether large groups have settled.
LOOK = 10
#: Digits of an item's mass, in units of the group's mean mass, that count for the order.
DIGITS = 12
#: Cells of the matrices that groups of like size are walked in together.
CELLS = 1 << 18


def _unsettled(new: np.ndarray, old: np.ndarray, n: np.ndarray) -> bool:
    return bool((np.abs(new - old) > SETTLED * np.maximum(new, 1 / n)).any())


def walk(ranks: np.ndarray, damping: float = DAMPING) -> np.ndarray:
    """Stationary probabilities of one group's items; ranks [items, scores], 0-based, -1 where an item has none.

    From an item the walk picks one of its scores with equal chance and jumps uniformly to an item that this
    score ranks at least as high, the item itself included. Only ranks count, so no score prevails through its
    range. One round is a suffix sum per score over the items in rank order.
    """
    return walks(ranks, np.array([len(ranks)]), damping)


def walks(ranks: np.ndarray, sizes: np.ndarray, damping: float = DAMPING) -> np.ndarray:
    """The same for many groups, whose items follow each other: groups of like size share the rounds' matrices."""
    out = np.empty(len(ranks))
    start = np.cumsum(sizes) - sizes
    width = 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for wide in np.unique(width):
        alike = np.flatnonzero(width == wide)
        together = max(1, CELLS // int(wide))
        for part in (alike[a : a + together] for a in range(0, len(alike), together)):
            at = start[part][:, None] + np.arange(wide)[None, :]
            real = np.arange(wide)[None, :] < sizes[part][:, None]
            out[at[real]] = _walk_rows(ranks[np.where(real, at, 0)], real, damping)[real]
    return out


def _walk_rows(ranks: np.ndarray, real: np.ndarray, damping: float) -> np.ndarray:
    """Of groups as rows: ranks [groups, width, scores], real [groups, width] where a group has an item."""
    groups, wide, scores = ranks.shape
    n = real.sum(1, keepdims=True)
    have = (ranks >= 0) & real[:, :, None]
    lists = np.maximum(have.sum(2), 1)
    # place of the item of each rank, one spare column for ranks that a group lacks
    row = np.arange(groups)[:, None] * (wide + 1)
    places = []
    for s in range(scores):
        place = np.full((groups, wide), wide)
        g, c = np.nonzero(have[:, :, s])
        place[g, ranks[g, c, s]] = c
        places.append(row + place)
    weight = 1 / np.arange(1, wide + 1)
    p = np.where(real, 1 / n, 0.0)
    share = np.zeros((groups, wide + 1))
    for _ in range(MOST_ROUNDS):
        share[:, :wide] = p / lists
        new = np.zeros((groups, wide))
        for place in places:
            up = np.cumsum((share.ravel()[place] * weight)[:, ::-1], 1)[:, ::-1]
            moved = np.zeros(groups * (wide + 1))
            moved[place.ravel()] = up.ravel()
            new += moved.reshape(groups, -1)[:, :wide]
        new = np.where(real, damping * new, 0.0)
        new = np.where(real, new + (1 - new.sum(1, keepdims=True)) / n, 0.0)
        old, p = p, new
        if not _unsettled(p, old, n):
            return p
    raise RuntimeError(f"the walk did not settle in {MOST_ROUNDS} rounds")


def _positions(rows: DataFrame, group: str, item: str, score: str, out: str) -> DataFrame:
    """Adds 0-based positions by falling score, ties by the smaller item, null without a score.

    No group is ranked in one task: the rows are put into ranges of (group, score, item), numbered within
    their range, and a table of the ranges' sizes per group gives the offsets.
    """
    scored = rows.filter(F.col(score).isNotNull())
    ranged = scored.repartitionByRange(task_count(rows), F.col(group), F.desc(score), F.asc(item)).select(group, item, score, F.spark_partition_id().alias("_part"))
    ranged = stored(ranged, "ranges")
    sizes = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy(group).orderBy("_part")) - F.col("_n")
    offsets = sizes.select(group, "_part", before.alias("_before"))
    within = F.row_number().over(W.partitionBy(group, "_part").orderBy(F.desc(score), F.asc(item)))
    placed = ranged.withColumn("_i", within).join(offsets, [group, "_part"])
    return rows.join(placed.select(group, item, (F.col("_before") + F.col("_i") - 1).alias(out)), [group, item], "left")


def _ranked(group: np.ndarray, start: np.ndarray, item: np.ndarray, score: np.ndarray) -> np.ndarray:
    """0-based positions within the groups by falling score, ties by the smaller item; -1 without a score."""
    none = np.isnan(score)
    order = np.lexsort((item, -score, none, group))
    out = np.empty(len(group), np.int64)
    out[order] = np.arange(len(group)) - start[group[order]]
    out[none] = -1
    return out


def _fused_local(rows: DataFrame, scores: list[str], damping: float) -> DataFrame:
    """g, i, rank_<score>..., mass, rank of groups that fit in a task: one shuffle by g, then arrays only."""
    kind = rows.schema["g"].dataType.simpleString()
    outs = [f"rank_{s}" for s in scores]

    def fuse(table: pa.Table, edges: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(edges)
        start, group = edges[:-1], np.repeat(np.arange(len(sizes)), sizes)
        item = table.column("i").to_numpy()
        ranks = np.stack([_ranked(group, start, item, pc.fill_null(table.column(s), float("nan")).to_numpy()) for s in scores], 1)
        n = sizes[group]
        mass = np.rint(walks(ranks, sizes, damping) * n * 10**DIGITS) / 10**DIGITS / n
        last = _ranked(group, start, item, mass) + 1
        columns = [pa.array(np.where(r < 0, 0, r + 1), pa.int64(), mask=r < 0) for r in ranks.T]
        arrays = [table.column(c).combine_chunks() for c in ("g", "i")] + columns + [pa.array(mass), pa.array(last)]
        return pa.RecordBatch.from_arrays(arrays, names=["g", "i", *outs, "mass", "rank"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by g; whole groups are worked on once enough rows are there."""
        held: list[pa.RecordBatch] = []

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            table = pa.Table.from_batches(held).combine_chunks()
            g = table.column("g")
            new = pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)).to_numpy() if len(g) > 1 else np.zeros(0, bool)
            edges = np.concatenate([[0], np.flatnonzero(new) + 1, [len(g)] if last else np.zeros(0, int)]).astype(np.int64)
            if len(edges) > 1:
                yield fuse(table.slice(0, edges[-1]), edges)
            held = table.slice(edges[-1]).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= CELLS:
                yield from whole(False)
        if sum(b.num_rows for b in held):
            yield from whole(True)

    ordered = rows.repartition(task_count(rows), "g").sortWithinPartitions("g")
    return ordered.mapInArrow(run, f"g {kind}, i bigint, {', '.join(f'{o} bigint' for o in outs)}, mass double, rank bigint")


def _walk_distributed(placed: DataFrame, sizes: DataFrame, outs: list[str], damping: float) -> DataFrame:
    """The same walk for groups of any size: items are summed by strips of a list; strips' suffix sums are a
    window over few rows; within a strip a window over at most STRIP rows adds the rest."""
    state = placed.join(sizes, "g").withColumn("lists", sum(F.col(o).isNotNull().cast("int") for o in outs))
    state = stored(state.withColumn("mass", 1 / F.col("n")), "walk")
    for turn in range(1, MOST_ROUNDS + 1):
        new = state
        for o in outs:
            strip = F.floor(F.col(o) / STRIP)
            gain = F.col("mass") / F.col("lists") / (F.col(o) + 1)
            strips = state.filter(F.col(o).isNotNull()).groupBy("g", strip.alias(f"s_{o}")).agg(F.sum(gain).alias("t"))
            later = F.sum("t").over(W.partitionBy("g").orderBy(F.desc(f"s_{o}"))) - F.col("t")
            strips = strips.select("g", f"s_{o}", later.alias(f"l_{o}"))
            inner = F.sum(gain).over(W.partitionBy("g", f"s_{o}").orderBy(F.desc(o)))
            new = new.withColumn(f"s_{o}", strip).withColumn(f"i_{o}", F.when(F.col(o).isNotNull(), inner)).join(strips, ["g", f"s_{o}"], "left")
        followed = damping * sum(F.coalesce(F.col(f"l_{o}") + F.col(f"i_{o}"), F.lit(0.0)) for o in outs)
        new = new.select("g", "i", *outs, "n", "lists", F.col("mass").alias("old"), followed.alias("mass"))
        sums = new.groupBy("g").agg(F.sum("mass").alias("held"))
        new = new.join(sums, "g").withColumn("mass", F.col("mass") + (1 - F.col("held")) / F.col("n")).drop("held")
        # each round hangs on the one before; a table cuts the lineage and survives lost executors
        last, state = state, stored(new, "walk")
        discard(last)
        if turn % LOOK == 0:
            moved = F.abs(F.col("mass") - F.col("old")) > F.lit(SETTLED) * F.greatest("mass", 1 / F.col("n"))
            if state.filter(moved).isEmpty():
                return state.select("g", "i", "mass", "n")
    raise RuntimeError(f"the walk did not settle in {MOST_ROUNDS} rounds")


def _fused_distributed(rows: DataFrame, sizes: DataFrame, scores: list[str], damping: float) -> DataFrame:
    outs = [f"rank_{s}" for s in scores]
    placed = rows.select("g", "i", *scores)
    for s, o in zip(scores, outs):
        placed = _positions(placed, "g", "i", s, o)
    placed = stored(placed.select("g", "i", *outs), "positions")
    mass = _walk_distributed(placed, sizes, outs, damping)
    # masses shrink as 1 / n, so they are rounded in units of the mean
    mass = stored(mass.select("g", "i", (F.rint(F.col("mass") * F.col("n") * 10**DIGITS) / 10**DIGITS / F.col("n")).alias("mass")), "masses")
    walked = _positions(mass, "g", "i", "mass", "rank").join(placed, ["g", "i"])
    ones = [(F.col(o) + 1).cast("bigint").alias(o) for o in [*outs, "rank"]]
    return walked.select("g", "i", *ones[:-1], "mass", ones[-1])


def fused_ranking(rows: DataFrame, group: str, item: str, scores: list[str], damping: float = DAMPING, local: int = LOCAL) -> DataFrame:
    """group, item, rank_<score>..., mass, rank: one ranking per group by stationary probability, ties by item.

    rank_<score> is the item's rank (from 1) by that score, ties by the smaller item, null without it. NaN counts
    as null. Rows with a null group or item are dropped; a repeated (group, item) counts once with the highest
    of each score. An item without any score is reached by restarts only. Items must be integers. An empty
    table gives no row. Groups above ``local`` items take the distributed path, with the same result. The walk
    goes on until it has settled (SETTLED) and fails loudly if it does not.
    """
    clean = [F.max(F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double"))).alias(s) for s in scores]
    named = rows.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).groupBy(F.col(group).alias("g"), F.col(item).cast("bigint").alias("i")).agg(*clean)
    named = stored(named, "scores")
    large = stored(named.groupBy("g").agg(F.count("*").alias("n")).filter(F.col("n") > local), "large")
    if large.isEmpty():
        out = _fused_local(named, scores, damping)
    else:
        out = _fused_local(named.join(large, "g", "left_anti"), scores, damping)
        out = out.unionByName(_fused_distributed(named.join(large.select("g"), "g", "left_semi"), large, scores, damping))
    return out.select(F.col("g").alias(group), F.col("i").alias(item), *[f"rank_{s}" for s in scores], "mass", "rank")
