"""Executing an export plan: verify all, then copy, then read back. Files are written once and never replaced."""

from __future__ import annotations

import hashlib
import os
import shutil
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _digest(path: str) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            h.update(block)
    return h.hexdigest()


def verify(plan: DataFrame) -> DataFrame:
    """plan (id, source, target, sha, action) with state ready, present, stale or blocked, checked where the data is.

    source and target are paths that every executor sees.
    """

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            state = []
            for source, target, sha in zip(b["source"], b["target"], b["sha"], strict=True):
                if not os.path.isfile(source) or _digest(source) != sha:
                    state.append("stale")
                elif os.path.exists(target):
                    state.append("present" if _digest(target) == sha else "blocked")
                else:
                    state.append("ready")
            yield b.assign(state=state)

    wanted = plan.filter(F.col("action").isin("copy", "skip")).select("id", "source", "target", "sha", "action")
    return wanted.mapInPandas(look, "id string, source string, target string, sha string, action string, state string")


def execute(plan: DataFrame) -> DataFrame:
    """Copy what is ready; one row an item with outcome copied, present or failed. Nothing is written if any item is stale or blocked.

    A copy goes to a name of its own beside the target and is linked there only if the target is still free, so a task
    that runs again finds its own result present.
    """
    checked = verify(plan)
    if not checked.filter(F.col("state").isin("stale", "blocked")).isEmpty():
        raise ValueError("the plan no longer holds; plan again")

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            outcome = []
            for source, target, sha in zip(b["source"], b["target"], b["sha"], strict=True):
                if os.path.exists(target):
                    outcome.append("present" if _digest(target) == sha else "failed")
                    continue
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{os.getpid()}.part"
                try:
                    shutil.copyfile(source, part)
                    if _digest(part) != sha:
                        raise OSError("content changed")
                    os.link(part, target)
                    outcome.append("copied")
                except OSError:
                    outcome.append("present" if os.path.exists(target) and _digest(target) == sha else "failed")
                finally:
                    if os.path.exists(part):
                        os.remove(part)
            yield pd.DataFrame({"id": b["id"], "target": b["target"], "outcome": outcome})

    return checked.mapInPandas(copy, "id string, target string, outcome string")
