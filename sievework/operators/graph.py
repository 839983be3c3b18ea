"""Components of a link table, for folds that must not be cut by a link."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which a query deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ready_to_checkpoint(spark: SparkSession) -> None:
    """spark.checkpoint.dir is used as it is; where it is unset, a folder of our own is, in local mode only."""
    context = spark.sparkContext
    if context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None):
        return
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sievework-"))


def written(rows: DataFrame) -> DataFrame:
    """rows, written as Parquet beside the checkpoints and read again; the shuffles that made them are deleted at once.

    Smaller than a checkpoint, and columns that nothing asks for aren't read. The files stay until discard().
    """
    spark = rows.sparkSession
    ready_to_checkpoint(spark)
    folder = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    path, before = f"{folder.rstrip('/')}/sievework-{uuid.uuid4().hex}", spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        rows.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(rows.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing still to be run reads."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_components(rows: DataFrame, links: DataFrame, key: str, name: str = "part", rounds: int = 40) -> DataFrame:
    """rows with the least key that links (left, right) lead to; rows without a link are their own component.

    Each round every node takes the least label of its neighbours, and labels take their own label's label; rounds
    follow the logarithm of the longest chain for the chains that near duplicates form. State is checkpointed.
    """
    ready_to_checkpoint(rows.sparkSession)
    both = links.select("left", "right").union(links.select("right", "left")).filter("left != right").distinct().checkpoint()
    label = both.groupBy(F.col("left").alias("node")).agg(F.least(F.min("right"), F.first("left")).alias("label")).checkpoint()
    for _ in range(rounds):
        seen = both.join(label, both["right"] == label["node"]).groupBy("left").agg(F.min("label").alias("near"))
        new = label.join(seen, label["node"] == seen["left"], "left").select("node", F.least("label", "near").alias("label"))
        jump = new.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = new.join(jump, new["label"] == jump["_n"], "left").select("node", F.least("label", "_l").alias("label")).checkpoint()
        if new.exceptAll(label).isEmpty():
            break
        label = new
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return rows.join(label.select(F.col("node").alias(key), F.col("label").alias("_c")), key, "left").select(*[F.col(c) for c in rows.columns], F.coalesce("_c", key).alias(name))
