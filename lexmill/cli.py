"""Command line: build an index over a directory of text files, rank queries, show snippets; evaluate rankings.

``lexmill QUERY ...`` ranks, ``lexmill evaluate --queries FILE --qrels FILE ...`` prints means per method.
"""

from __future__ import annotations

import argparse
import os
import shutil
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions.codecs import CODECS
from lexmill.functions.scoring import result_line
from lexmill.operators import lsi, snippets
from lexmill.operators.index import Index, merge_postings
from lexmill.operators.index import block_postings as blocks_of
from lexmill.plans import evaluate
from lexmill.session import local_session, stored
from lexmill.sources import tables

# The default queries and how many results are shown.
DEFAULT_QUERIES = (
    "alkylated with radioactive iodoacetate",
    "psychodrama for disturbed children",
    "lipid metabolism in toxemia and normal pregnancy",
)
SHOWN = 5

TITLES = {"tfidf": "TF-IDF", "bm25": "BM25", "wand": "BM25 + bound-pruned top-k", "adaptive": "Adaptive hybrid"}


def _indexing(p: argparse.ArgumentParser) -> argparse.ArgumentParser:
    p.add_argument("--collection", default="collection", help="directory with one sub-directory per block")
    p.add_argument("--index", choices=["bsbi", "spimi"], default="bsbi", help="by blocks and merged, or in one pass")
    p.add_argument("--dictionary", choices=["standard", "trie", "patricia"], default="standard")
    p.add_argument("--compression", choices=["standard", "vbe", "elias"], default="vbe")
    p.add_argument("--metric", choices=[*TITLES, "all"], default="all")
    p.add_argument("--build", action="store_true", help="build anew, also where an index exists")
    p.add_argument("--output", help="directory of the index (index, or index_bonus for spimi)")
    return p


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexmill", description="Ranked retrieval over a directory of text files")
    p.add_argument("query", nargs="?", help="free text; without it three default queries are run")
    p.add_argument("--snippets", action="store_true")
    return _indexing(p)


def evaluation_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lexmill evaluate", description="Means of RBP, DCG, NDCG and AP, and seconds, per method")
    p.add_argument("--queries", required=True, help="lines of a query id and its words")
    p.add_argument("--qrels", required=True, help="lines of a query id and the id of a relevant document")
    p.add_argument("--depth", type=int, default=1000)
    return _indexing(p)


def notices(args: argparse.Namespace) -> list[str]:
    """All dictionaries are the same relation here; choices that have no effect are named."""
    if args.index == "bsbi" and args.dictionary != "standard":
        return ["bsbi has the standard dictionary only; the choice is ignored"]
    if args.index == "spimi" and args.dictionary == "standard":
        return ["spimi uses the trie dictionary by default"]
    return []


def output_of(args: argparse.Namespace) -> str:
    return args.output or ("index" if args.index == "bsbi" else "index_bonus")


def build(spark: SparkSession, args: argparse.Namespace) -> tuple[Index, DataFrame]:
    """Builds, or opens where an index with this codec exists; returns it with the documents.

    The documents are read again only for snippets: the index knows their names.
    """
    docs = tables.text_collection(spark, args.collection).filter("doc_id is not null")
    path = f"{output_of(args)}/{args.index}"
    if not args.build and os.path.isdir(f"{path}/meta"):
        try:
            return Index.open(spark, path, args.compression), docs
        except ValueError as error:
            print(f"Warning: {error}; rebuilding")
    elif not args.build:
        print(f"Warning: no index in {path}; building")
    if args.index == "bsbi":
        index = Index.of(stored(merge_postings(blocks_of(docs)), "postings"), args.compression)
    else:
        index = Index.build(docs, args.compression)
    saved = replace(index, names=docs.select("doc_id", "doc_name")).save(path, files=8)
    # vectors of the index before are not those of this one
    shutil.rmtree(vectors_of(args), ignore_errors=True)
    return saved, docs


def vectors_of(args: argparse.Namespace) -> str:
    return f"{output_of(args)}/{args.index}_vectors"


def vectors(spark: SparkSession, args: argparse.Namespace, index: Index) -> lsi.Vectors:
    """Opens the saved latent vectors, or fits and saves them; a ValueError where the corpus is too small."""
    path = vectors_of(args)
    return lsi.Vectors.open(spark, path) if os.path.isdir(f"{path}/sigma") else lsi.fit(index).save(path)


def methods_of(spark: SparkSession, args: argparse.Namespace, index: Index) -> dict[str, evaluate.Method]:
    """The methods asked for; without --metric adaptive a corpus too small for it leaves it out."""
    methods = evaluate.lexical_methods(index)
    if args.metric in ("adaptive", "all"):
        try:
            methods["adaptive"] = evaluate.adaptive_method(index, vectors(spark, args, index))
        except ValueError as error:
            if args.metric == "adaptive":
                print(error)
    return {m: method for m, method in methods.items() if args.metric in (m, "all")}


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    for notice in notices(args):
        print(f"Warning: {notice}")
    assert args.compression in CODECS
    index, docs = build(spark, args)
    texts = [args.query] if args.query else list(DEFAULT_QUERIES)
    queries = spark.createDataFrame([(f"Q{i + 1}", t) for i, t in enumerate(texts)], "qid string, text string")
    found = {m: method(queries, SHOWN) for m, method in methods_of(spark, args, index).items()}
    shown = {m: show(hits, index.names if index.names is not None else docs, docs, queries, args.snippets) for m, hits in found.items()}
    for i, text in enumerate(texts):
        print(f"\n{'=' * 60}\nQuery: {text}\n{'=' * 60}")
        for metric, lines in shown.items():
            print(f"\n[{TITLES[metric]}]")
            for line in lines.get(f"Q{i + 1}", []):
                print(line)


def show(hits: DataFrame, names: DataFrame, docs: DataFrame, queries: DataFrame, with_snippets: bool) -> dict[str, list[str]]:
    """The few lines that are printed, per query."""
    hits = stored(hits, "hits")
    rows = hits.join(names.select("doc_id", "doc_name"), "doc_id").withColumn("line", result_line())
    rows = rows.join(snippets.snippets(hits, docs, queries, marks=snippets.ANSI), ["qid", "doc_id"]) if with_snippets else rows.withColumn("snippet", F.lit(None).cast("string"))
    out: dict[str, list[str]] = {}
    for row in rows.orderBy("qid", "rank").select("qid", "line", "snippet").collect():
        out.setdefault(row["qid"], []).append(row["line"] + (f"\n    {row['snippet']}" if row["snippet"] else ""))
    return out


def run_evaluation(spark: SparkSession, args: argparse.Namespace) -> None:
    for notice in notices(args):
        print(f"Warning: {notice}")
    index, _ = build(spark, args)
    queries, qrels = stored(tables.query_file(spark, args.queries), "queries"), stored(tables.qrels_file(spark, args.qrels), "qrels")
    print(f"{'method':<10} {'RBP':>8} {'DCG':>8} {'NDCG':>8} {'AP':>8} {'seconds':>9}")
    for row in evaluate.timed(methods_of(spark, args, index), queries, qrels, args.depth):
        print(f"{row['method']:<10} " + " ".join(f"{row['mean_' + m]:8.4f}" for m in ("rbp", "dcg", "ndcg", "ap")) + f" {row['seconds']:9.3f}")


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    evaluating = argv[:1] == ["evaluate"]
    args = evaluation_parser().parse_args(argv[1:]) if evaluating else parser().parse_args(argv)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    (run_evaluation if evaluating else run)(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
