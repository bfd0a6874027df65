"""Frequency of every distinct value: occurrences and records, by last-seen counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.session import scan_tasks


#: Salts for each task that reads the tokens, and the fewest. A value that owns a third of all tokens thereby
#: leaves each of its counters a sixth of what a reading task holds, at any size.
SALTS, FEWEST = 2, 64


def value_frequencies(rows: DataFrame, value: str, record: str, weight: Column | None = None, repeats: bool = False, salts: int | None = None) -> DataFrame:
    """value, occurrences, records of each value over all records.

    Method: tokens are partitioned by value and streamed in the order of their record; a counter per value
    holds the occurrences, the records, and the record seen last, which alone tells whether a token opens a
    new record, so no set of records is kept. The partitioning also takes a salt made from the record: a
    record's tokens stay together, so counters of different salts never count the same record and may be
    added. A value that owns a third of all rows is thereby counted by ``salts`` counters; their number grows
    with the tokens (None: SALTS for each task of the scan).

    ``weight``: what a token adds to the occurrences (1). ``repeats``: whether tokens of the same value and
    record add up (plain text) or count once (deliveries of one posting; the largest weight counts).
    Rows with a null value or record do not count. An empty table gives no row.
    """
    salts = salts or max(FEWEST, SALTS * scan_tasks(rows))
    tokens = rows.select(F.col(value).alias("value"), F.col(record).alias("_record"), (F.lit(1) if weight is None else weight).cast("bigint").alias("_weight"))
    tokens = tokens.filter("value is not null and _record is not null").withColumn("_salt", F.pmod(F.xxhash64("_record"), F.lit(salts)))
    order = [F.col("_record"), F.desc("_weight")]
    seen = F.lag("_record").over(W.partitionBy("value", "_salt").orderBy(*order))
    opens = seen.isNull() | (seen != F.col("_record"))
    stream = tokens.withColumn("_opens", opens)
    counted = F.col("_weight") if repeats else F.when(F.col("_opens"), F.col("_weight")).otherwise(0)
    partial = stream.groupBy("value", "_salt").agg(F.sum(counted).alias("occurrences"), F.count_if("_opens").alias("records"))
    return partial.groupBy(F.col("value").alias(value)).agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def record_count(rows: DataFrame, record: str) -> DataFrame:
    """One row, one column n: the number of distinct records."""
    return rows.filter(F.col(record).isNotNull()).select(record).distinct().agg(F.count("*").alias("n"))


def marked_frequencies(frequencies: DataFrame, n_records: Column, rare: int = 1, common: float = 1 / 3) -> DataFrame:
    """Adds mark: ``rare`` up to ``rare`` records, else ``common`` in more than that share of the records, else null."""
    share = F.col("records") > n_records * F.lit(common) if common != 1 / 3 else F.col("records") * 3 > n_records
    return frequencies.withColumn("mark", F.when(F.col("records") <= rare, "rare").when(share, "common"))
