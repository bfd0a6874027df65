"""Sources: directories of text files, query and relevance files, and the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_collection(spark: SparkSession, root: str) -> DataFrame:
    """Files ``root/<block>/<number>.txt``: block, doc_name, doc_id, text.

    One row per file; files without a byte give none, as Spark's file scans skip them (they hold no token and
    count for no statistic). Invalid UTF-8 becomes U+FFFD. A file without a number as its name has a null doc_id.
    """
    content = F.make_valid_utf8(F.col("content").cast("string"))
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/*").select(content.alias("text"), F.col("path").alias("doc_name"))
    return files.select(
        F.regexp_extract("doc_name", "([^/]+)/[^/]+$", 1).alias("block"),
        "doc_name",
        document_number(F.col("doc_name")).alias("doc_id"),
        "text",
    )


def document_number(name):
    """The number in ``.../<number>.txt``, else null."""
    digits = F.regexp_extract(name, "[\\\\/](\\d+)\\.txt$", 1)
    return F.when(digits != "", digits).cast("bigint")


def collection(rows: DataFrame) -> DataFrame:
    """One row per document of rows with doc_id, block, text: block, doc_id, text.

    Rows without a doc_id are dropped; a document delivered more than once counts once (least block, least
    text that is not null). A null text stays: the document is known but has no token.
    """
    return rows.filter("doc_id is not null").groupBy("doc_id").agg(F.min("block").alias("block"), F.min("text").alias("text"))


def collection_table(spark: SparkSession, folder: str) -> DataFrame:
    return collection(table(spark, folder, "collection_docs").select("doc_id", "block", "text"))


def documents_table(spark: SparkSession, folder: str) -> DataFrame:
    """The wider corpus, its source in the role of the block. Its ids are unique, so no text is shuffled."""
    return table(spark, folder, "documents").filter("doc_id is not null").select("doc_id", F.col("source").alias("block"), "text")


def queries(rows: DataFrame) -> DataFrame:
    """One row per query id (the least text that is not null); rows without an id or a text are dropped."""
    return rows.filter("qid is not null and text is not null").groupBy("qid").agg(F.min("text").alias("text"))


def queries_table(spark: SparkSession, folder: str) -> DataFrame:
    return queries(table(spark, folder, "queries").select("qid", "text"))


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``<qid> <words...>``: qid, text. Blank lines are dropped."""
    parts = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "")
    return rows.select(parts[0].alias("qid"), F.array_join(F.slice(parts, 2, 1 << 30), " ").alias("text"))


def qrels_file(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``<qid> <doc_id>``: qid, doc_id, rel = 1, repeated lines once. Pairs that are absent count as 0."""
    parts = F.split(F.trim("value"), "\\s+")
    rows = spark.read.text(path).filter(F.size(parts) >= 2)
    return rows.select(parts[0].alias("qid"), parts[1].cast("bigint").alias("doc_id")).distinct().withColumn("rel", F.lit(1))
