"""Dictionaries: dense ids, membership, prefixes, and the node counts of character and radix trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dense_ids(values: DataFrame, column: str, out: str) -> DataFrame:
    """Ids 0.. in the order of the distinct, non-null values: out (bigint), column.

    Numbering without one task holding all values: rows are put into ranges, numbered within their range, and
    the ranges' sizes (a row per partition) give the offsets.
    """
    from lexmill.session import stored

    ranged = values.select(column).filter(F.col(column).isNotNull()).distinct().repartitionByRange(column)
    ranged = stored(ranged.withColumn("_part", F.spark_partition_id()), "dictionary")
    within = F.row_number().over(W.partitionBy("_part").orderBy(column))
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_before"))
    return ranged.withColumn("_i", within).join(F.broadcast(offsets), "_part").select((F.col("_before") + F.col("_i") - 1).alias(out), column)


def known(words: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """Rows whose word is in the dictionary; nothing is ever inserted by asking."""
    return words.join(dictionary.select(column), column, "left_semi")


def unknown(words: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    return words.join(dictionary.select(column), column, "left_anti")


def prefixes(terms: DataFrame, column: str = "term") -> DataFrame:
    """prefix, is_term, branches: each distinct non-empty prefix, whether it is a term, and its next letters."""
    steps = terms.filter(F.length(column) > 0).select(
        F.col(column).alias("t"), F.explode(F.sequence(F.lit(1), F.length(column))).alias("n")
    )
    rows = steps.select(
        F.left("t", F.col("n")).alias("prefix"),
        (F.col("n") == F.length("t")).alias("end"),
        F.when(F.col("n") < F.length("t"), F.substring(F.col("t"), F.col("n") + 1, F.lit(1))).alias("next"),
    )
    letters = rows.groupBy("prefix", "next").agg(F.max("end").alias("end"))
    return letters.groupBy("prefix").agg(F.max("end").alias("is_term"), F.count("next").alias("branches"))


def tree_nodes(terms: DataFrame, column: str = "term") -> DataFrame:
    """One row: trie_nodes (a node per prefix), radix_nodes (only ends of terms and branchings); roots not counted."""
    keep = F.col("is_term") | (F.col("branches") >= 2)
    return prefixes(terms, column).agg(F.count("*").alias("trie_nodes"), F.count_if(keep).alias("radix_nodes"))
