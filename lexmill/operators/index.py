"""The inverted index as relations: postings, terms, documents, corpus figures.

Building by blocks and merging, and building in one pass, give the same relation; both are offered. Spark's
partial and final aggregation plays the part of runs and merges.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexmill.functions import scoring
from lexmill.functions.codecs import CODECS
from lexmill.functions.text import clean_tokens
from lexmill.operators.dictionary import dense_ids
from lexmill.session import stored, task_count


def block_postings(docs: DataFrame) -> DataFrame:
    """Postings of each block on its own: block, term, doc_id, tf."""
    return clean_tokens(docs, keep=("block", "doc_id")).groupBy("block", "term", "doc_id").agg(F.count("*").alias("tf"))


def merge_postings(*parts: DataFrame) -> DataFrame:
    """Union of postings (term, doc_id, tf); equal (term, doc_id) add up their tf. Works on one part with blocks too."""
    first, *rest = [p.select("term", "doc_id", "tf") for p in parts]
    for part in rest:
        first = first.unionByName(part)
    return first.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def postings_of(docs: DataFrame) -> DataFrame:
    """All postings in one aggregation: term, doc_id, tf."""
    return clean_tokens(docs).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def document_lengths(postings: DataFrame) -> DataFrame:
    """doc_id, doc_len; documents without an indexed token are absent."""
    return postings.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))


def term_statistics(postings: DataFrame) -> DataFrame:
    """term, df (documents), cf (occurrences)"""
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_statistics(lengths: DataFrame) -> DataFrame:
    """One row: n_docs (documents with a token), n_tokens, avgdl; on an empty corpus 0, 0, null."""
    return lengths.agg(
        F.count("*").alias("n_docs"),
        F.coalesce(F.sum("doc_len"), F.lit(0)).alias("n_tokens"),
        (F.sum("doc_len") / F.when(F.count("*") > 0, F.count("*"))).alias("avgdl"),
    )


#: Of the layout of saved indexes.
VERSION = 2
#: Depths of rankings that an index holds thresholds for; a depth between two takes those of the larger one.
DEPTHS = (10, 100, 1000)


def block_metadata(rows: DataFrame, n_docs: Column, k1: float = scoring.K1) -> DataFrame:
    """term, df, ub from metadata rows(block, term, df, ub) of blocks written by several versions.

    A (block, term) counts once (the greatest df); blocks add up. Where a block has no ub (old metadata), the
    term's bound is made from its df and the number of documents. Rows without a block or a term are dropped.
    """
    once = rows.filter("block is not null and term is not null").groupBy("block", "term").agg(F.max("df").alias("df"), F.max("ub").alias("ub"))
    terms = once.groupBy("term").agg(F.sum("df").alias("df"), F.max("ub").alias("ub"), F.count_if(F.col("ub").isNull()).alias("old"))
    bound = scoring.bm25_bound(scoring.bm25_idf(F.col("df"), n_docs), k1)
    return terms.select("term", "df", F.when(F.col("old") > 0, bound).otherwise(F.col("ub")).alias("ub"))


@dataclass(frozen=True)
class Index:
    """An index: postings(term, doc_id, tf), terms(term, df, cf), docs(doc_id, doc_len), codec name; of a saved index
    terms has also term_id and ub, and there are names(doc_id, doc_name) if it was saved with them."""

    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    codec: str = "vbe"
    names: DataFrame | None = None
    #: term, kth_<depth>: see ``term_thresholds``; made when an index is cached or saved
    thresholds: DataFrame | None = None

    @property
    def stats(self) -> DataFrame:
        return corpus_statistics(self.docs)

    def n_docs(self) -> Column:
        """N as a scalar subquery: no join, no job on the driver."""
        return self.docs.agg(F.count("*").alias("n")).scalar()

    def avgdl(self) -> Column:
        return self.docs.agg(F.avg("doc_len").alias("a")).scalar()

    def weighted_terms(self, k1: float = scoring.K1) -> DataFrame:
        """terms with both idf variants and the upper bound of a document's gain."""
        n = self.n_docs()
        idf = scoring.bm25_idf(F.col("df"), n)
        return self.terms.select(
            "term", "df", "cf", scoring.tfidf_idf(F.col("df"), n).alias("idf_tfidf"), idf.alias("idf_bm25"), scoring.bm25_bound(idf, k1).alias("ub")
        )

    def gains(self, terms: DataFrame, k1: float = scoring.K1, b: float = scoring.B) -> DataFrame:
        """term, doc_id, gain of distinct terms(term, idf) in each of their documents; a missing length counts as average.

        Gains depend on no query, so a term that many queries ask for meets the lengths once.
        """
        avgdl = self.avgdl()
        hits = self.postings.join(terms, "term").join(self.docs, "doc_id", "left")
        tf = scoring.bm25_tf(F.col("tf"), F.coalesce(F.col("doc_len").cast("double"), avgdl), avgdl, k1, b)
        return hits.select("term", "doc_id", (F.col("idf") * tf).alias("gain"))

    def term_thresholds(self) -> DataFrame:
        """term, kth_<depth> for each of DEPTHS: the term's gain in its k-th best document, null with fewer documents.

        The best of each term are cut within each task before the shuffle.
        """
        idf = scoring.bm25_idf(F.col("df"), self.n_docs()).alias("idf")
        rank = F.row_number().over(W.partitionBy("term").orderBy(F.desc("gain")))
        best = self.gains(self.terms.select("term", idf)).withColumn("n", rank).filter(F.col("n") <= DEPTHS[-1])
        return best.groupBy("term").agg(*[F.max(F.when(F.col("n") == k, F.col("gain"))).alias(f"kth_{k}") for k in DEPTHS])

    def lookup(self, *terms: str) -> DataFrame:
        """Postings of a few terms; on a saved index the filter reaches the row groups of the term-sorted files."""
        return self.postings.filter(F.col("term").isin(*terms))

    def prefix(self, prefix: str) -> DataFrame:
        return self.terms.filter(F.col("term").startswith(prefix))

    def save(self, path: str, files: int = 64) -> Index:
        """Writes one table per relation, postings in ranges of (term, doc_id): also a very frequent term is
        spread over several files, and a term's statistics in the footers prune everything else. The terms carry
        their ids and the bounds of their gains, so that a search needs no second look at the postings."""
        spark = self.postings.sparkSession
        postings = self.postings.repartitionByRange(files, "term", "doc_id").sortWithinPartitions("term", "doc_id")
        postings.write.mode("overwrite").parquet(f"{path}/postings")
        written = Index.of(spark.read.parquet(f"{path}/postings"), self.codec)
        terms = written.weighted_terms().select("term", "df", "cf", "ub").join(dense_ids(written.terms, "term", "term_id"), "term").join(written.term_thresholds(), "term", "left")
        terms = terms.repartitionByRange(max(1, files // 8), "term").sortWithinPartitions("term")
        terms.write.mode("overwrite").parquet(f"{path}/terms")
        written.docs.write.mode("overwrite").parquet(f"{path}/docs")
        if self.names is not None:
            self.names.select("doc_id", "doc_name").filter("doc_id is not null").dropDuplicates(["doc_id"]).write.mode("overwrite").parquet(f"{path}/names")
        meta = [(self.codec, VERSION, self.names is not None)]
        spark.createDataFrame(meta, "codec string, version int, named boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
        return Index.open(spark, path)

    @staticmethod
    def open(spark: SparkSession, path: str, codec: str | None = None) -> Index:
        """Opens a saved index; asking for another codec than it was saved with is an error, not a guess.

        Indexes of version 1 lack term ids, bounds and names; the bounds are then made from the statistics.
        """
        meta = spark.read.parquet(f"{path}/meta").first().asDict()
        if codec not in (None, meta["codec"]):
            raise ValueError(f"index was saved with codec {meta['codec']}, not {codec}")
        names = spark.read.parquet(f"{path}/names") if meta.get("named") else None
        index = Index(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "docs")), codec=meta["codec"], names=names)
        kth = [f"kth_{k}" for k in DEPTHS]
        if set(kth) <= set(index.terms.columns):
            index = replace(index, terms=index.terms.drop(*kth), thresholds=index.terms.select("term", *kth))
        if "ub" in index.terms.columns:
            return index
        return replace(index, terms=index.weighted_terms().select("term", "df", "cf", "ub"))

    @staticmethod
    def of(postings: DataFrame, codec: str = "vbe") -> Index:
        return Index(postings, term_statistics(postings), document_lengths(postings), codec)

    @staticmethod
    def build(docs: DataFrame, codec: str = "vbe") -> Index:
        """From doc_id, text (, block). Null and empty texts contribute nothing; an empty table gives an empty index.

        Texts are tokenised once: the postings are written to the shared folder, and terms, lengths and every
        scan of a query read that table.
        """
        if codec not in CODECS:
            raise ValueError(f"unknown codec {codec}; there are {', '.join(CODECS)}")
        return Index.of(stored(postings_of(docs), "postings"), codec)

    def cached(self) -> Index:
        """The relations held in memory and on disk for a series of query batches."""
        held = replace(self, postings=self.postings.persist(), terms=self.terms.persist(), docs=self.docs.persist())
        return replace(held, thresholds=(held.term_thresholds() if self.thresholds is None else self.thresholds).persist())


# --- postings lists ------------------------------------------------------------------------------------------


def _in_ranges(rows: DataFrame) -> DataFrame:
    """Rows in ranges of (term, doc_id), the range's number in _part: a frequent term lies in several of them."""
    ranged = rows.repartitionByRange(task_count(rows), "term", "doc_id")
    return stored(ranged.withColumn("_part", F.spark_partition_id()), "ranges")


def _carried(per_range: DataFrame, carry: Column) -> DataFrame:
    """term, _part, _carry of ranges that begin within a term; that is at most one term of each range, so the
    table has no more rows than there are ranges and may be broadcast."""
    return F.broadcast(per_range.withColumn("_carry", carry).filter("_carry is not null").select("term", "_part", "_carry"))


def postings_gaps(postings: DataFrame) -> DataFrame:
    """term, doc_id, tf, gap: difference to the document before in the term's list, the first id as it is.

    Differences are taken within ranges and carried over their borders; no task holds a whole frequent term.
    """
    ranged = _in_ranges(postings.select("term", "doc_id", "tf"))
    before = F.lag("doc_id").over(W.partitionBy("_part", "term").orderBy("doc_id"))
    ends = ranged.groupBy("term", "_part").agg(F.max("doc_id").alias("_last"))
    carried = _carried(ends, F.lag("_last").over(W.partitionBy("term").orderBy("_part")))
    joined = ranged.withColumn("_before", before).join(carried, ["term", "_part"], "left")
    return joined.select("term", "doc_id", "tf", (F.col("doc_id") - F.coalesce("_before", "_carry", F.lit(0))).alias("gap"))


def gaps_decoded(gapped: DataFrame) -> DataFrame:
    """The inverse: ids as running sums of the gaps, in the order of the ids that are to come out."""
    ranged = _in_ranges(gapped.select("term", "doc_id", "tf", "gap"))
    run = W.partitionBy("_part", "term").orderBy("doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = ranged.groupBy("term", "_part").agg(F.sum("gap").alias("_sum"))
    earlier = F.sum("_sum").over(W.partitionBy("term").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    joined = ranged.withColumn("_within", F.sum("gap").over(run)).join(_carried(sums, earlier), ["term", "_part"], "left")
    return joined.select("term", (F.col("_within") + F.coalesce("_carry", F.lit(0))).alias("doc_id"), "tf")


#: Postings of a chunk of a list, at most.
CHUNK = 4096


def chunked(postings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """term, doc_id, tf, chunk: each list in ascending order is cut after every ``chunk`` postings.

    Running counts are taken within ranges and carried over their borders, so no task ever holds the whole list
    of a very frequent term, however its document ids lie. Only lists that are cut at all go that way.
    """
    plain = postings.select("term", "doc_id", "tf")
    long = stored(plain.groupBy("term").agg(F.count("*").alias("n")).filter(F.col("n") > chunk).select("term"), "long")
    whole = lambda rows: rows.withColumn("chunk", F.lit(0).cast("bigint"))
    if long.isEmpty():
        return whole(plain)
    ranged = _in_ranges(plain.join(long, "term", "left_semi"))
    within = F.row_number().over(W.partitionBy("_part", "term").orderBy("doc_id"))
    sizes = ranged.groupBy("term", "_part").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(W.partitionBy("term").orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    placed = ranged.withColumn("_i", within).join(_carried(sizes, earlier), ["term", "_part"], "left")
    at = F.coalesce("_carry", F.lit(0)) + F.col("_i") - 1
    return placed.select("term", "doc_id", "tf", F.floor(at / chunk).alias("chunk")).unionByName(whole(plain.join(long, "term", "left_anti")))


def postings_lists(postings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """term, chunk, df, doc_ids, tfs: ascending lists of at most ``chunk`` postings each.

    A term with up to ``chunk`` postings has the one chunk 0. df counts the chunk's postings.
    """
    pairs = F.sort_array(F.collect_list(F.struct("doc_id", "tf")))
    lists = chunked(postings, chunk).groupBy("term", "chunk").agg(F.count("*").alias("df"), pairs.alias("p"))
    return lists.select("term", "chunk", "df", F.col("p.doc_id").alias("doc_ids"), F.col("p.tf").alias("tfs"))


def encoded_lists(lists: DataFrame, codec: str) -> DataFrame:
    """term, chunk, df, postings_bytes, tf_bytes under the codec named."""
    c = CODECS[codec]
    return lists.select("term", "chunk", "df", c.encode(F.col("doc_ids")).alias("postings_bytes"), c.encode_tf(F.col("tfs")).alias("tf_bytes"))


def decoded_lists(encoded: DataFrame, codec: str) -> DataFrame:
    c = CODECS[codec]
    return encoded.select("term", "chunk", "df", c.decode(F.col("postings_bytes")).alias("doc_ids"), c.decode_tf(F.col("tf_bytes")).alias("tfs"))


def codec_sizes(postings: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """codec, postings_bytes, tf_bytes of the encoded chunks of the whole index, from closed forms: no list is
    assembled.

    Every chunk begins anew with its first document id. Gamma codes are padded to whole bytes and headed by
    four bytes once per chunk.
    """
    from lexmill.functions.codecs import gamma_bits, vbe_size

    before = F.lag("doc_id", 1, 0).over(W.partitionBy("term", "chunk").orderBy("doc_id"))
    per_term = chunked(postings, chunk).withColumn("gap", F.col("doc_id") - before).groupBy("term", "chunk").agg(
        F.count("*").alias("n"),
        F.sum(vbe_size(F.col("gap"))).alias("vp"),
        F.sum(vbe_size(F.col("tf"))).alias("vt"),
        F.sum(gamma_bits(F.col("gap"))).alias("gp"),
        F.sum(gamma_bits(F.col("tf"))).alias("gt"),
    )
    whole = lambda bits: (F.ceil(F.col(bits) / 8) + 4).cast("bigint")
    total = per_term.agg(
        F.struct(F.sum(F.col("n") * 8).alias("p"), F.sum(F.col("n") * 8).alias("t")).alias("standard"),
        F.struct(F.sum("vp").alias("p"), F.sum("vt").alias("t")).alias("vbe"),
        F.struct(F.sum(whole("gp")).alias("p"), F.sum(whole("gt")).alias("t")).alias("elias"),
    )
    rows = F.array(*[F.struct(F.lit(c).alias("codec"), F.col(c)["p"].alias("postings_bytes"), F.col(c)["t"].alias("tf_bytes")) for c in ("standard", "vbe", "elias")])
    return total.select(F.inline(rows))
