"""Shuffles whose tasks hold a bounded number of rows, however large the table is."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame

ROWS = 150_000  # rows a task


def spread(rows: DataFrame, count: int, *keys: str) -> DataFrame:
    """rows dealt by the keys to as many tasks as count rows need; Spark doesn't put these together again.

    Joins and groupings by the keys, or by more than them, keep the tasks. A single key's rows stay together.
    """
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(count / ROWS)), *keys)
