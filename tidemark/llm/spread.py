"""How the llm operators deal out work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bytes_of(df: DataFrame, column: str) -> tuple[int, int]:
    """Rows, and bytes of a text or binary column: one aggregate over the scan."""
    row = df.select(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(column)).alias("b")).first()
    return int(row["n"]), int(row["b"] or 0)


def parts(df: DataFrame, amount: int, each: int) -> int:
    """A number of partitions that holds each one near ``each``, and the session's number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-amount // each), 1)


def clear_of(df: DataFrame, name: str) -> str:
    """``name``, with underscores put before it until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
