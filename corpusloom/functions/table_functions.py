"""Table functions for SQL: the rows of a page's tables, the chunks of a document, the pieces of a text.

They are called in FROM, with LATERAL for the columns of a table before them:
SELECT page_id, r.* FROM pages, LATERAL table_rows(html) r
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from corpusloom.functions.html import grid, header_value_text
from corpusloom.operators.structure import GRAMMARS, parse


@udtf(returnType="pos int, text string")
class TableRows:
    """The rows below the header of a page's first table as 'header: value' texts. Null: none."""

    def eval(self, html: str | None) -> Iterator[tuple]:
        rows = grid(html)
        for pos, row in enumerate(rows[1:], 1):
            yield pos, header_value_text(rows[0], row)


@udtf(returnType="chunk_id string, parent_chunk_id string, chunk_level string, chunk_order int, label string, content string")
class ChunkUnits:
    """The chunks of a text by the grammar of that name; an unknown name counts as plain. Null: none."""

    def eval(self, doc_id: int, text: str | None, grammar: str) -> Iterator[tuple]:
        for _, chunk, parent, level, _, order, label, content in parse(doc_id, text, GRAMMARS.get(grammar, GRAMMARS["plain"])):
            yield chunk, parent, level, order, label, content


@udtf(returnType="pos int, word_start int, text string")
class WordWindows:
    """Windows of `size` words, each beginning `size - overlap` words after the last, until all are covered."""

    def eval(self, text: str | None, size: int, overlap: int) -> Iterator[tuple]:
        words = (text or "").split()
        step = max(1, size - overlap)
        for pos, start in enumerate(range(0, max(len(words) - overlap, min(len(words), 1)), step)):
            yield pos, start, " ".join(words[start : start + size])


FUNCTIONS = {"table_rows": TableRows, "chunk_units": ChunkUnits, "word_windows": WordWindows}


def register(spark: SparkSession) -> None:
    """Makes the table functions known to a session's SQL."""
    for name, function in FUNCTIONS.items():
        spark.udtf.register(name, function)
