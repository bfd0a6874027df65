"""Per-key work when a few keys hold most records: fragment and replicate by estimated load.

Loads are estimated by a mergeable frequent-items sketch; keys too large for a task are cut into proportionate
shards, the other keys fall into bins, and bins and shards are packed onto tasks by their load. The matching
side of a join is replicated to the shards of the large keys only.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import task_count

#: Keys that the sketch tracks, at least and at most (more the engine's sketch can't). A key's count is off by at
#: most rows / (0.75 * tracked).
LEAST_TRACKED, MOST_TRACKED = 4096, 1 << 19
#: Bins of light keys for each task.
BINS = 16
#: A key whose load exceeds this share of a task's fair share is cut.
CUT = 0.5


@dataclass(frozen=True)
class Layout:
    """Where rows go. heavy: key -> number of shards; its shards' tasks follow each other in ``tasks`` from
    ``first``; bins: task of each bin. The number of entries is bounded by tasks, never by keys."""

    n_tasks: int
    bins: list[int]
    heavy: dict[str, tuple[int, int]] = field(default_factory=dict)
    shard_tasks: list[int] = field(default_factory=list)
    loads: list[float] = field(default_factory=list)


def pack(loads: list[float], n_tasks: int, start: list[float] | None = None) -> tuple[list[int], list[float]]:
    """Task of each load, largest loads first, each onto the task that holds least; and the tasks' sums."""
    sums = list(start or [0.0] * n_tasks)
    heap = [(s, t) for t, s in enumerate(sums)]
    heapq.heapify(heap)
    where = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda i: (-loads[i], i)):
        s, t = heapq.heappop(heap)
        where[i] = t
        sums[t] = s + loads[i]
        heapq.heappush(heap, (sums[t], t))
    return where, sums


def tracked_for(n_tasks: int) -> int:
    """Keys to track so that a count is off by at most half of the load from which a key is cut, up to 98,000 tasks;
    a power of two. Beyond, a key may be cut up to 1.5 times that load too late."""
    needed = 2 * n_tasks / (0.75 * CUT)
    return min(MOST_TRACKED, max(LEAST_TRACKED, 1 << math.ceil(math.log2(needed))))


def _bin(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def plan_layout(rows: DataFrame, key: str, n_tasks: int | None = None) -> Layout:
    """The layout for rows by their key (a string column without nulls), from estimates over all rows.

    Two small aggregations over the key column alone: a sketch of frequent keys, and row counts per bin of
    hashed keys. What reaches the driver is bounded by the sketch's entries and BINS counts per task.
    """
    n_tasks = n_tasks or task_count(rows)
    n_bins = n_tasks * BINS
    keys = rows.select(F.col(key).alias("k"))
    counted = keys.groupBy(_bin(F.col("k"), n_bins).alias("bin")).agg(F.count("*").alias("n")).collect()
    per_bin = [0.0] * n_bins
    for row in counted:
        per_bin[row["bin"]] = float(row["n"])
    total = sum(per_bin)
    limit = max(CUT * total / n_tasks, 1.0)
    # no more than n_tasks / CUT keys can exceed the limit
    tracked = tracked_for(n_tasks)
    most = min(tracked // 2, int(n_tasks / CUT) + 1)
    found = keys.select(F.expr(f"approx_top_k(k, {most}, {tracked})").alias("top")) if total else None
    frequent = [(r["item"], float(r["count"])) for r in found.first()["top"]] if found is not None else []
    large = {k: n for k, n in frequent if k is not None and n > limit}
    if large:
        named = rows.sparkSession.createDataFrame([(k,) for k in large], "k string").select("k", _bin(F.col("k"), n_bins).alias("bin"))
        for row in named.collect():
            per_bin[row["bin"]] = max(0.0, per_bin[row["bin"]] - large[row["k"]])
    heavy, shard_loads = {}, []
    for k, n in sorted(large.items(), key=lambda x: (-x[1], x[0])):
        shards = min(n_tasks, int(-(-n // limit)))
        heavy[k] = (len(shard_loads), shards)
        shard_loads += [n / shards] * shards
    where, sums = pack(shard_loads + per_bin, n_tasks)
    return Layout(n_tasks, where[len(shard_loads) :], heavy, where[: len(shard_loads)], sums)


def _array(values: list[int]) -> Column:
    return F.from_json(F.lit(str(values)), "array<int>")


def _placement(rows: DataFrame, key: str, layout: Layout) -> DataFrame:
    """Adds _first and _shards (null for light keys) and _home, the task of the key's bin."""
    table = rows.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in layout.heavy.items()], f"`{key}` string, _first int, _shards int")
    # the table has an entry per large key: at most tasks / CUT of them
    marked = rows.join(F.broadcast(table), key, "left")
    return marked.withColumn("_home", F.get(_array(layout.bins), _bin(F.col(key), len(layout.bins))))


def fragmented(rows: DataFrame, key: str, layout: Layout, by: list[str]) -> DataFrame:
    """Rows with _shard (0 for light keys) and _task, brought to their task; a large key's rows are dealt to its
    shards by a hash of ``by`` (columns that tell its rows apart), so that a repeated task deals them alike."""
    placed = _placement(rows, key, layout)
    shard = F.coalesce(F.pmod(F.xxhash64(*by), F.col("_shards")).cast("int"), F.lit(0))
    task = F.coalesce(F.get(_array(layout.shard_tasks), F.col("_first") + F.col("_shard")), F.col("_home"))
    dealt = placed.withColumn("_shard", shard).withColumn("_task", task).drop("_first", "_shards", "_home")
    return dealt.repartitionById(layout.n_tasks, F.col("_task"))


def replicated(rows: DataFrame, key: str, layout: Layout) -> DataFrame:
    """The matching side: a row of a large key once for each of its shards, any other row once."""
    placed = _placement(rows, key, layout)
    copies = placed.withColumn("_shard", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_shards"), F.lit(1)) - 1)))
    task = F.coalesce(F.get(_array(layout.shard_tasks), F.col("_first") + F.col("_shard")), F.col("_home"))
    return copies.withColumn("_task", task).drop("_first", "_shards", "_home").repartitionById(layout.n_tasks, F.col("_task"))


def balanced_aggregate(rows: DataFrame, key: str, partial: dict[str, Column], final: dict[str, Column], by: list[str], layout: Layout | None = None) -> DataFrame:
    """key, and the ``final`` columns over the ``partial`` aggregates of each shard.

    The first aggregation runs where the layout put the rows, without another shuffle; the second one merges
    as many rows per key as it has shards. Rows with a null key are dropped. An empty table gives no row.
    """
    rows = rows.filter(F.col(key).isNotNull())
    layout = layout or plan_layout(rows, key)
    shards = fragmented(rows, key, layout, by).groupBy("_task", key, "_shard").agg(*[c.alias(n) for n, c in partial.items()])
    return shards.groupBy(key).agg(*[c.alias(n) for n, c in final.items()])


def balanced_join(left: DataFrame, right: DataFrame, key: str, by: list[str], how: str = "inner", more: list[str] | None = None, layout: Layout | None = None) -> DataFrame:
    """``left`` join ``right`` on ``key`` and the columns ``more``, laid out by the load of ``left``.

    ``how``: inner or left. Null keys match nothing; with ``left`` their rows stay. Columns of ``right`` that
    clash with those of ``left`` get the suffix _right. The join runs where the layout put the rows.
    """
    more = more or []
    clash = [c for c in right.columns if c in left.columns and c not in (key, *more)]
    for c in clash:
        right = right.withColumnRenamed(c, f"{c}_right")
    keyed = left.filter(F.col(key).isNotNull())
    layout = layout or plan_layout(keyed, key)
    on = ["_task", key, "_shard", *more]
    joined = fragmented(keyed, key, layout, by).join(replicated(right.filter(F.col(key).isNotNull()), key, layout), on, how)
    out = joined.select(*left.columns, *[c for c in right.columns if c not in left.columns])
    if how == "left":
        out = out.unionByName(left.filter(F.col(key).isNull()), allowMissingColumns=True)
    return out
