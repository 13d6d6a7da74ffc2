"""Table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class SplitPieces:
    """Text, stride, overlap -> the windows of the text, one at a time, blank ones left out; use with LATERAL.

    A window is a slice of the text, so the work is linear in its length and no more than one window is held beside it.
    """

    def eval(self, body: str, stride: int, overlap: int) -> Iterator[tuple[int, str]]:
        if body is None:
            return
        last = 0 if len(body) <= stride + overlap else -(-(len(body) - stride - overlap) // stride)
        for n in range(last + 1):
            part = body[n * stride : (n + 1) * stride + overlap]
            if part.strip(" "):
                yield n, part


def register(spark: SparkSession) -> None:
    """Make split_pieces known to the session's SQL."""
    spark.udtf.register("split_pieces", udtf(SplitPieces, returnType="piece int, body string", useArrow=True))
