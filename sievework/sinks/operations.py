"""Records of delivery operations: journals by revision, receipts, archive, heartbeat."""

from __future__ import annotations

import os
import re
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import last_revisions
from ..streaming.queue import write_once
from .reports import save_document

_ID = re.compile(r"^[0-9a-f]{32}$")


def _checked(operation: str) -> str:
    if not _ID.match(operation):
        raise ValueError("not an operation id")
    return operation


def append_journal(folder: str, operation: str, revision: int, journal: dict) -> bool:
    """Revision n of an operation's journal: written once, never changed."""
    return write_once(folder, f"{_checked(operation)}.{revision:08d}", journal)


def latest_journals(spark: SparkSession, folder: str) -> DataFrame:
    """(operation, revision, value) of the highest revision of every operation."""
    raw = spark.read.option("wholetext", True).text(folder).select("value", F.col("_metadata.file_name").alias("name"))
    return last_revisions(raw).select("operation", "revision", "value")


def publish_receipt(inbox: str, outbox: str, archive: str, name: str, receipt: dict) -> None:
    """Put the receipt out, then move the request to the archive; safe to do again."""
    write_once(outbox, name, receipt)
    os.makedirs(archive, exist_ok=True)
    source = os.path.join(inbox, f"{name}.json")
    if os.path.exists(source):
        os.replace(source, os.path.join(archive, f"{name}.json"))


def recover(processing: str, inbox: str, quarantine: str) -> None:
    """After a stop: requests in work go back to the inbox, or aside where the inbox has another of that name."""
    for folder in (inbox, quarantine):
        os.makedirs(folder, exist_ok=True)
    for name in sorted(os.listdir(processing)):
        home = quarantine if os.path.exists(os.path.join(inbox, name)) else inbox
        os.replace(os.path.join(processing, name), os.path.join(home, name))


def beat(path: str, **facts) -> None:
    save_document({"at": time.time(), **facts}, path)


def fresh(beats: DataFrame, now: float, seconds: float = 15.0) -> DataFrame:
    """Heartbeats (at: seconds) no older than that."""
    return beats.filter(F.lit(now) - F.col("at") <= seconds)
