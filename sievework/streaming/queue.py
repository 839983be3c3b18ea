"""File-queue protocol: JSON requests are read as a stream, answered once each, and bad ones set aside."""

from __future__ import annotations

import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.names import sound_request_id

REQUEST = "request_id string, operation_id string, plan_hash string, operation string, created_at string, items array<struct<item_id:string,path_hash:string,target_rating:int,rating_tier:string>>"


def write_once(folder: str, name: str, document: dict) -> bool:
    """A document under its id: True if written, False if the same is there, an error if another is."""
    os.makedirs(folder, exist_ok=True)
    text, path = json.dumps(document, sort_keys=True, ensure_ascii=False), os.path.join(folder, f"{name}.json")
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
    try:
        os.link(part, path)
        return True
    except FileExistsError:
        with open(path, encoding="utf-8") as f:
            if f.read() != text:
                raise ValueError(f"{name} is taken by other content") from None
        return False
    finally:
        os.remove(part)


def requests(spark: SparkSession, inbox: str, most_per_batch: int = 100) -> DataFrame:
    """The inbox as a stream, oldest files first: REQUEST columns, the file, and whether the request is sound."""
    raw = spark.readStream.option("maxFilesPerTrigger", most_per_batch).option("latestFirst", False).option("wholetext", True).format("text").load(inbox)
    held = raw.select(F.from_json("value", REQUEST, {"mode": "PERMISSIVE"}).alias("r"), F.col("_metadata.file_name").alias("file"))
    sound = sound_request_id(F.col("request_id")) & F.col("plan_hash").rlike("^[0-9A-Fa-f]{64}$") & F.col("operation").isin("preflight", "execute") & (F.size("items") > 0) & (F.size(F.array_distinct(F.transform("items", lambda i: i["item_id"]))) == F.size("items"))
    return held.select("r.*", "file").withColumn("sound", F.coalesce(sound, F.lit(False)))


def serve(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True, every: str = "2 seconds") -> StreamingQuery:
    """Answer sound requests with handle (requests -> request_id, status, ...); receipts go to out, bad requests to out-rejected.

    A batch that runs again overwrites its own folder, so every request is answered once.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.persist()
        handle(rows.filter("sound")).write.mode("overwrite").json(f"{out}/batch={number}")
        rows.filter("not sound").select("file", F.lit("invalid").alias("status")).write.mode("overwrite").json(f"{out}-rejected/batch={number}")
        rows.unpersist()

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
