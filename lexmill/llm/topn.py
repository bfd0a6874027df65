"""Top N items within every group by mergeable bounded heaps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows that a task gathers before it brings its heaps up to date, at least.
GATHERED = 1 << 16
#: Entries that a task's heaps hold, at most; beyond them they are handed on and new ones are begun.
HELD = 1 << 20


def heaped(table: pa.Table, n: int) -> pa.Table:
    """The ``n`` best rows of each group of (group, item, score): by score, then the smaller item; an item counts
    once, with its best score. Any rows of a group may be put into the result later on, in any order."""
    codes = table.column(0).combine_chunks().dictionary_encode().indices.to_numpy()
    item, score = table.column(1).to_numpy(), table.column(2).to_numpy()
    order = np.lexsort((-score, item, codes))
    c, i = codes[order], item[order]
    order = order[np.concatenate([[True], (c[1:] != c[:-1]) | (i[1:] != i[:-1])])]
    order = order[np.lexsort((item[order], -score[order], codes[order]))]
    c = codes[order]
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], c[1:] != c[:-1]]), np.arange(len(c)), 0))
    return table.take(pa.array(order[np.arange(len(c)) - begin < n]))


def heaps(rows: DataFrame, n: int) -> DataFrame:
    """group, item, score: of each task's rows at most ``n`` a group, in heaps that are filled while it reads.

    What leaves the task is bounded by the groups that it meets, whatever the size of a group. Heaps grow by
    whole batches; the work for a row stays the same however many groups are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, new, waiting = None, [], 0
        for batch in batches:
            if batch.num_rows:
                new.append(batch)
                waiting += batch.num_rows
            if waiting >= max(GATHERED, held.num_rows if held else 0):
                held = heaped(pa.concat_tables(([held] if held else []) + [pa.Table.from_batches(new)]), n)
                new, waiting = [], 0
                if held.num_rows > HELD:
                    yield from held.to_batches()
                    held = None
        if new:
            held = heaped(pa.concat_tables(([held] if held else []) + [pa.Table.from_batches(new)]), n)
        if held:
            yield from held.to_batches()

    kinds = [f"{name} {rows.schema[name].dataType.simpleString()}" for name in rows.columns]
    return rows.mapInArrow(run, ", ".join(kinds))


def top_n(rows: DataFrame, group: str, item: str, score: str, n: int = 10) -> DataFrame:
    """group, rank (bigint, from 1), item, score: the ``n`` best items of every group, ties by the smaller item.

    Rows with a null group, item or score or a NaN score do not take part. A repeated (group, item) counts
    once with its highest score: an item that a heap has dropped and meets again with a higher score enters
    again, so dropping it was safe. Each task fills heaps while it reads; only they are shuffled, once, by
    group; so a group of any size is never gathered. Items must be integers. n < 1 gives no row.
    """
    if n < 1:
        return rows.select(group, F.lit(0).cast("bigint").alias("rank"), item, score).limit(0)
    valid = rows.select(F.col(group).alias("_group"), F.col(item).cast("bigint").alias("_item"), F.col(score).cast("double").alias("_score")).filter(
        F.col("_group").isNotNull() & F.col("_item").isNotNull() & F.col("_score").isNotNull() & ~F.isnan("_score")
    )
    # both the merging of equal items and the ranks are content with rows that lie together by group
    once = heaps(valid, n).repartition("_group").groupBy("_group", "_item").agg(F.max("_score").alias("_score"))
    rank = F.row_number().over(W.partitionBy("_group").orderBy(F.desc("_score"), F.asc("_item")))
    best = once.withColumn("_rank", rank).filter(F.col("_rank") <= n)
    return best.select(F.col("_group").alias(group), F.col("_rank").cast("bigint").alias("rank"), F.col("_item").alias(item), F.col("_score").alias(score))
