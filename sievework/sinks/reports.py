"""Reports and documents."""

from __future__ import annotations

import json
import os
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path, mode="overwrite")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.json(path, mode="overwrite")


def markdown(rows: DataFrame, title: str, most: int = 200) -> str:
    """A small table as Markdown; more than `most` rows are an error, not a cut."""
    held = rows.limit(most + 1).collect()
    if len(held) > most:
        raise ValueError("too many rows for a report")
    line = lambda xs: "| " + " | ".join("" if x is None else str(x) for x in xs) + " |"
    return "\n".join([f"# {title}", "", line(rows.columns), line(["---"] * len(rows.columns)), *map(line, held)]) + "\n"


def save_document(document: dict, path: str) -> None:
    """A small JSON document, replaced as a whole."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, sort_keys=True)
    os.replace(part, path)


def write_results(parts: dict[str, DataFrame], path: str, project: str = "project", key: str = "id") -> None:
    """The result of each project as JSON lines in a folder of its own: parts in the order given, each part's rows by key.

    A line is {"part": name, "row": {...}}. Rows are dealt by ranges of (project, part, key), so a large project is many
    files, whose names follow the order.
    """
    lines = [rows.select(F.col(project).cast("string").alias("project"), F.lit(n).alias("_part"), F.col(key).cast("string").alias("_key"), F.to_json(F.struct(F.lit(name).alias("part"), F.struct(*rows.columns).alias("row"))).alias("value")) for n, (name, rows) in enumerate(parts.items())]
    whole = reduce(DataFrame.unionByName, lines).repartitionByRange("project", "_part", "_key").sortWithinPartitions("project", "_part", "_key")
    whole.select("project", "value").write.mode("overwrite").partitionBy("project").text(path)


def sheet_cells(rows: DataFrame, group: str, order: str, columns: int, per_page: int) -> DataFrame:
    """page, row and column of each member on its group's contact sheets."""
    from ..operators.ranking import chunked

    held = chunked(rows, [group], [F.col(order)], per_page).withColumnRenamed("chunk", "page")
    placed = chunked(held, [group, "page"], [F.col(order)], columns).withColumnRenamed("chunk", "row")
    return placed
