"""Analysis engines: one interface for what turns a content (an image, a text) into typed rows or into a vector.

An engine is made once a task, from a function that the driver gives, so models are loaded where they are used and once
only. Its rows come by a lateral join with a table function: one content row gives any number of typed rows, in one pass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Engine(Protocol):
    """analyze: the rows of a content; embed: vectors of some contents; signature: what tells its results from others' (see names.cache_key)."""

    def analyze(self, content) -> Iterable[tuple]: ...

    def embed(self, contents: list) -> list[list[float] | None]: ...

    def signature(self) -> str: ...


def analyzed(rows: DataFrame, content: str, make: Callable[[], Engine], schema: str, keep_empty: bool = False) -> DataFrame:
    """rows joined with what the engine finds in their content, a row each (schema: the found columns).

    A null content has no findings; rows without findings go, or stay with nulls where keep_empty.
    """
    nothing = (None,) * len(StructType.fromDDL(schema))

    class Found:
        def __init__(self) -> None:
            self.engine = make()

        def eval(self, content) -> Iterator[tuple]:
            some = False
            for row in () if content is None else self.engine.analyze(content):
                some = True
                yield row
            if keep_empty and not some:  # a left lateral join with a table function doesn't keep such rows
                yield nothing

    found = F.udtf(Found, returnType=schema)(F.col(content).outer())
    return rows.lateralJoin(found)


def embedded(rows: DataFrame, content: str, make: Callable[[], Engine], name: str = "embedding") -> DataFrame:
    """rows with the engine's vector of their content, batches at once; null contents have none."""

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        engine = make()
        for batch in batches:
            there = batch.notna()
            out = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            if there.any():
                out[there] = pd.Series(engine.embed(batch[there].tolist()), index=batch.index[there], dtype=object)
            yield out

    return rows.withColumn(name, vectors(F.col(content)))


def status(rows: DataFrame, signature: str, engine: Engine) -> DataFrame:
    """One row: rows in all, those made by this engine, and whether none is stale."""
    fresh = F.count_if(F.col(signature).eqNullSafe(F.lit(engine.signature())))
    return rows.agg(F.count(F.lit(1)).alias("rows"), fresh.alias("fresh"), (fresh == F.count(F.lit(1))).alias("ready"))
