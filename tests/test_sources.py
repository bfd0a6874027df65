import random

import pytest

from lexmill import cli
from lexmill.operators.index import Index
from lexmill.sources import tables
from lexmill.streaming import blocks
from tests.conftest import rows


@pytest.fixture(scope="module")
def collection(tmp_path_factory):
    root = tmp_path_factory.mktemp("collection")
    for block, name, text in (("1", "7.txt", "cat cat dog"), ("2", "8.txt", "dog bird"), ("2", "notes.md", "fish"), ("10", "9.txt", "")):
        (root / block).mkdir(exist_ok=True)
        (root / block / name).write_text(text)
    return str(root)


def test_text_collection(spark, collection):
    got = {r.doc_id: (r.block, r.text) for r in tables.text_collection(spark, collection).collect()}
    assert got == {7: ("1", "cat cat dog"), 8: ("2", "dog bird"), None: ("2", "fish")}


def test_query_and_qrels_files(spark, tmp_path):
    (tmp_path / "q").write_text("Q1  cat   dog\n\nQ2 bird\n")
    (tmp_path / "r").write_text("Q1 7\nQ1 7\nQ2 8\n")
    assert rows(tables.query_file(spark, str(tmp_path / "q"))) == [("Q1", "cat dog"), ("Q2", "bird")]
    assert rows(tables.qrels_file(spark, str(tmp_path / "r"))) == [("Q1", 7, 1), ("Q2", 8, 1)]


def test_repeated_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "b", "x"), (1, "b", "x"), (None, "b", "y"), (2, None, None)], "doc_id bigint, block string, text string")
    assert rows(tables.collection(docs)) == [(1, "b", "x"), (2, None, None)]
    q = spark.createDataFrame([("Q1", "a"), ("Q1", "a"), ("Q2", None), (None, "b")], "qid string, text string")
    assert rows(tables.queries(q)) == [("Q1", "a")]


def test_stream_builds_the_same_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, "dog bird"), (3, None)], "doc_id bigint, text string")
    for i in (1, 2, 3):
        docs.filter(f"doc_id = {i}").coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    blocks.index_stream(stream, str(tmp_path / "blocks"), str(tmp_path / "state")).awaitTermination()
    assert rows(blocks.merged(spark, str(tmp_path / "blocks")).postings) == rows(Index.build(docs).postings)


def test_documents_delivered_again_count_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "heart cat heart dog"), (2, "dog bird")], "doc_id bigint, text string")
    for i, part in enumerate((docs.filter("doc_id = 1"), docs, docs.filter("doc_id = 1"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/part={i}"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    blocks.index_stream(stream, str(tmp_path / "blocks"), str(tmp_path / "state")).awaitTermination()
    assert rows(blocks.merged(spark, str(tmp_path / "blocks")).postings) == rows(Index.build(docs).postings)


def test_command_line(spark, collection, tmp_path, capsys):
    args = cli.parser().parse_args(["dog", "--collection", collection, "--output", str(tmp_path / "ix"), "--metric", "wand", "--snippets", "--build", "--dictionary", "trie"])
    cli.run(spark, args)
    said = capsys.readouterr().out
    assert "ignored" in said and "8.txt" in said and "\033[1;33mdog\033[0m" in said
    args = cli.parser().parse_args(["dog", "--collection", collection, "--output", str(tmp_path / "ix"), "--metric", "bm25", "--compression", "elias"])
    cli.run(spark, args)
    assert "rebuilding" in capsys.readouterr().out


def test_evaluation_command(spark, tmp_path, capsys):
    rng = random.Random(2)
    words = [a + b for a in "bcdfg" for b in ("arn", "elt", "ism", "ool")]
    for i in range(40):
        (tmp_path / "c" / str(i % 3)).mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / str(i % 3) / f"{i}.txt").write_text(" ".join(rng.choice(words) for _ in range(30)))
    (tmp_path / "q").write_text("Q1 barn celt\nQ2 fool\n")
    (tmp_path / "r").write_text("Q1 3\nQ1 4\nQ2 7\n")
    args = ["--queries", str(tmp_path / "q"), "--qrels", str(tmp_path / "r"), "--collection", str(tmp_path / "c"), "--output", str(tmp_path / "ix"), "--depth", "20"]
    cli.run_evaluation(spark, cli.evaluation_parser().parse_args(args))
    said = capsys.readouterr().out
    assert [line.split()[0] for line in said.strip().splitlines()[-4:]] == ["tfidf", "bm25", "wand", "adaptive"]
    # the second run opens the index and the vectors that the first one saved
    fit, cli.lsi.fit = cli.lsi.fit, None
    try:
        cli.run_evaluation(spark, cli.evaluation_parser().parse_args([*args, "--metric", "adaptive"]))
    finally:
        cli.lsi.fit = fit
    again = capsys.readouterr().out.strip().splitlines()
    assert again[-1].split()[:5] == said.strip().splitlines()[-1].split()[:5] and len(again) == 2
