"""Incremental building: each micro-batch of documents becomes a block of postings; blocks are merged on reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.operators.index import Index, postings_of


def index_stream(docs: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes postings of each micro-batch of a stream (doc_id, text) under ``path/batch=<n>``.

    A batch that is done again after a failure overwrites its own block, so nothing is counted twice. With
    ``once`` all data present is worked through, then the query ends.
    """
    def write(batch: DataFrame, number: int) -> None:
        unique = batch.filter("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
        postings_of(unique).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def merged(spark: SparkSession, path: str) -> Index:
    """The index over all blocks written so far.

    A document delivered again in a later batch counts once, with its first delivery that has a token; so the
    postings of a document come from one block and need no adding up.
    """
    blocks = spark.read.option("basePath", path).parquet(path)
    first = blocks.groupBy("doc_id").agg(F.min("batch").alias("batch"))
    return Index.of(blocks.join(first, ["doc_id", "batch"], "left_semi").select("term", "doc_id", "tf"))
