"""What several operators share: cleaned views of the postings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import normalised_term


def valid_postings(postings: DataFrame) -> DataFrame:
    """term (trimmed, lower-cased), doc_id, tf of the rows with a non-blank term, a doc_id and tf >= 1.

    Rows delivered again stay; callers decide how they count.
    """
    rows = postings.select(normalised_term(F.col("term")).alias("term"), "doc_id", "tf")
    return rows.filter("term is not null and doc_id is not null and tf >= 1")


def words(text: Column) -> Column:
    """Maximal runs of [a-z0-9] in the lower-cased text; empty for empty texts, null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


#: Bytes that a table may take up in memory to be sent to every task.
SENT_BYTES = 24 << 20


def table_bytes(table: DataFrame) -> int:
    """Bytes of a stored table's rows in memory, at most: counted, as files may be compressed by any factor."""
    text = [F.coalesce(F.sum(F.octet_length(c)), F.lit(0)) for c, kind in table.dtypes if kind in ("string", "binary")]
    rows, *lengths = table.agg(F.count("*"), *text).first()
    return rows * (32 + 16 * len(table.columns)) + sum(lengths)


def small(table: DataFrame) -> DataFrame:
    """A stored table with the hint to send it to every task, if its size allows it; else as it is, to be shuffled."""
    return F.broadcast(table) if table_bytes(table) <= SENT_BYTES else table


#: Characters of texts that are worked on together.
CHARACTERS = 1 << 21


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Cuts a batch into runs of a bounded number of characters; a longer text is a run of its own."""
    begin, held = 0, 0
    for i, text in enumerate(texts):
        if held and held + len(text) > CHARACTERS:
            yield begin, i
            begin, held = i, 0
        held += len(text)
    if begin < len(texts):
        yield begin, len(texts)


class Memo(dict):
    """What ``learn`` says of a string, asked once for each different one; ``of`` many of them at once."""

    def __init__(self, learn: Callable[[str], int]):
        super().__init__()
        self.learn = learn

    def __missing__(self, key: str) -> int:
        value = self[key] = self.learn(key)
        return value

    def of(self, flat: list[str], kind) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, flat), kind, len(flat))
