"""Table functions for SQL: what a query can select from, registered by name."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from ..operators.chunks import SEPARATORS, SEPARATORS_CJK, split_text


@F.udtf(returnType="key string, parent long, child int, text string")
class Chunks:
    """chunks(TABLE(...)): rows (key, parent, text) as the child chunks of child_chunks(). Null texts are empty and give none."""

    def eval(self, row: Row) -> Iterator[tuple]:
        text = row["text"] or ""
        cjk = any("一" <= c <= "鿿" for c in text)
        for i, part in enumerate(split_text(text, separators=SEPARATORS_CJK if cjk else SEPARATORS) or ([text] if text.strip() else [])):
            yield None if row["key"] is None else str(row["key"]), row["parent"], i, part


@F.udtf(returnType="key string, row int, col int, head string, cell string")
class MarkdownCells:
    """markdown_cells(TABLE(...)): rows (key, text) as the cells of the markdown tables in them, with each column's head.

    A table begins with two lines of bars, the second of dashes; a shorter row ends early. Rows are numbered through all
    tables of a text, from 1.
    """

    def eval(self, row: Row) -> Iterator[tuple]:
        lines, head, n = (row["text"] or "").split("\n"), None, 0
        cells = lambda s: [c.strip() for c in s.strip().strip("|").split("|")]
        for i, line in enumerate(lines):
            if not line.strip().startswith("|"):
                head = None
            elif head is None:
                rule = lines[i + 1].strip() if i + 1 < len(lines) else ""
                if rule.startswith("|") and set(rule) <= set("|-: "):
                    head = cells(line)
            elif not set(line.strip()) <= set("|-: "):
                n += 1
                for k, c in enumerate(cells(line)):
                    yield None if row["key"] is None else str(row["key"]), n, k, head[k] if k < len(head) else None, c


@F.udtf(returnType="key string, first int, last int, text string")
class MergedPieces:
    """merged_pieces(TABLE(...) PARTITION BY key ORDER BY pos): pieces (key, pos, text) of a key joined in order while they
    stay within `size` characters; a longer piece stands alone. The rows of a key pass one by one, one join is held."""

    SIZE = 400

    def __init__(self):
        self.key, self.first, self.last, self.held = None, None, None, None

    def eval(self, row: Row) -> Iterator[tuple]:
        text = row["text"] or ""
        if self.held is not None and len(self.held) + 1 + len(text) > self.SIZE:
            yield self.key, self.first, self.last, self.held
            self.held = None
        if self.held is None:
            self.key, self.first, self.held = str(row["key"]), row["pos"], text
        else:
            self.held += "\n" + text
        self.last = row["pos"]

    def terminate(self) -> Iterator[tuple]:
        if self.held is not None:
            yield self.key, self.first, self.last, self.held


def register_functions(spark: SparkSession) -> None:
    """chunks, markdown_cells and merged_pieces for spark.sql()."""
    for name, function in (("chunks", Chunks), ("markdown_cells", MarkdownCells), ("merged_pieces", MergedPieces)):
        spark.udtf.register(name, function)
