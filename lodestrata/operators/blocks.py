"""Table functions for SQL: text_blocks cuts the lines of each document into blocks of about even length."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


@udtf
class TextBlocks:
    """text_blocks(size => 500, rows => TABLE(...) PARTITION BY id ORDER BY line_number): (id, block, line_start, line_end, text).

    The table has id, line_number and line, and may have more. A line belongs to block n if size * n characters stand before it in its document, line ends
    counted, and less than size * (n + 1); a null line is empty. Each document is its own partition, so its lines are held one block at a time.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, size: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("text_blocks: rows is a table, as in TABLE(lines) PARTITION BY id ORDER BY line_number")
        kinds = {f.name: f.dataType for f in rows.dataType.fields}
        if missing := [c for c in ("id", "line_number", "line") if c not in kinds]:
            raise ValueError(f"text_blocks: the table has no column {', '.join(missing)}")
        if not size.isConstantExpression or not isinstance(size.value, int) or size.value < 1:
            raise ValueError("text_blocks: size is a constant of 1 or more")
        long = T.LongType()
        return AnalyzeResult(T.StructType([T.StructField("id", kinds["id"]), T.StructField("block", long), T.StructField("line_start", long), T.StructField("line_end", long), T.StructField("text", T.StringType())]))

    def __init__(self) -> None:
        self.upto, self.block, self.held = 0, -1, []

    def eval(self, rows: T.Row, size: int) -> Iterator[tuple]:
        line = rows["line"] or ""
        if self.upto // size != self.block:
            yield from self._done()
            self.block = self.upto // size
        self.held.append((rows["id"], rows["line_number"], line))
        self.upto += len(line) + 1

    def terminate(self) -> Iterator[tuple]:
        yield from self._done()

    def _done(self) -> Iterator[tuple]:
        if self.held:
            yield self.held[0][0], self.block, self.held[0][1], self.held[-1][1], "\n".join(h[2] for h in self.held)
        self.held = []


def register(spark: SparkSession) -> None:
    """Make the table functions known to spark.sql."""
    spark.udtf.register("text_blocks", TextBlocks)
