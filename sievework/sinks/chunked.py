"""Chunked catalogue writes: each chunk is checked anew, journalled, written, read back, and undone where it doesn't hold.

A catalogue is a folder of immutable parts: the base, and one part a chunk written. The row with the highest number
counts for an id, so a chunk is one atomic write however large the catalogue is, and undoing it is one more part with
what was there before. The plan is a folder with one file a chunk; a stream hands the chunks to foreachBatch one by one,
updates before new rows. The journal is written ahead of every write, so a run that stops anywhere can be started again:
chunks that are complete are passed over, one that was under way is checked and done again. Every path is read and
written by Spark, so the folders may lie in any store.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.ranking import numbered

PLAN = "id string, action string, previous int, target int, chunk string"
ROWS = "id string, rating int, number long"
SIZES = {"update": 100, "new": 1}
#: What a chunk may end as, and whether the next one may begin.
STATES = {"complete": True, "replan_required": False, "failed": False, "manual_recovery_required": False}


class Stopped(RuntimeError):
    """A chunk ended in a state after which no other may begin."""


class Catalogue:
    """Ratings by id below a folder: parts/<name> (ROWS) and journal/<name>."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _names(self, folder: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        fs, make = path.getFileSystem(self.spark._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs.Path
        found = [s.getPath() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(p.getName() for p in found if fs.exists(make(p, "_SUCCESS")))

    def put(self, name: str, rows: DataFrame) -> None:
        """A part (id, rating); written again it replaces itself."""
        number = self.spark.read.schema(ROWS).parquet(*[f"{self.root}/parts/{n}" for n in names]).agg(F.max("number")).first()[0] if (names := self._names("parts")) else None
        number = 0 if number is None else number + 1
        rows.select(F.col("id").cast("string").alias("id"), F.col("rating").cast("int").alias("rating"), F.lit(number).cast("long").alias("number")).write.mode("overwrite").parquet(f"{self.root}/parts/{name}")

    def read(self) -> DataFrame:
        """(id, rating) as they are now; incomplete parts don't count, a null rating is none."""
        names = self._names("parts")
        if not names:
            return self.spark.createDataFrame([], "id string, rating int")
        rows = self.spark.read.schema(ROWS).parquet(*[f"{self.root}/parts/{n}" for n in names])
        return rows.groupBy("id").agg(F.max_by(F.struct("rating"), "number").alias("r")).select("id", "r.rating")

    def note(self, chunk: str, state: str, items: int, verified: int) -> None:
        entry = [(chunk, state, items, verified, len(self._names("journal")))]
        self.spark.createDataFrame(entry, "chunk string, state string, items long, verified long, revision long").coalesce(1).write.json(f"{self.root}/journal/{entry[0][4]:08d}")

    def journal(self) -> DataFrame:
        names = self._names("journal")
        schema = "chunk string, state string, items long, verified long, revision long"
        return self.spark.read.schema(schema).json([f"{self.root}/journal/{n}" for n in names]) if names else self.spark.createDataFrame([], schema)

    def states(self) -> dict[str, str]:
        """The last state of each chunk of the journal (chunks, not rows, come to the driver)."""
        last = self.journal().groupBy("chunk").agg(F.max_by("state", "revision").alias("state"))
        return {r["chunk"]: r["state"] for r in last.collect()}


def submit(changes: DataFrame, folder: str, sizes: dict[str, int] | None = None) -> None:
    """changes (id, action, previous, target) as a plan of chunks, a file each: updates first, each action's rows by id."""
    for action in ("update", "new"):
        size = (sizes or SIZES)[action]
        rows = numbered(changes.filter(F.col("action") == action), [F.col("id")], "_n")
        named = rows.withColumn("chunk", F.concat_ws("-", "action", F.format_string("%08d", F.floor((F.col("_n") - 1) / size))))
        names = StructType.fromDDL(PLAN).fieldNames()
        named.select(*names).withColumn("_c", F.col("chunk")).repartition("_c").write.mode("append").partitionBy("_c").parquet(folder)


def _differing(rows: DataFrame, catalogue: Catalogue, wanted: str) -> int:
    """How many of rows the catalogue doesn't hold as the column says (null: there is no such id)."""
    return rows.join(catalogue.read(), "id", "left").filter(~F.col("rating").eqNullSafe(F.col(wanted))).count()


def write_chunk(rows: DataFrame, catalogue: Catalogue, put: Callable[[str, DataFrame], None] | None = None) -> str:
    """Write the rows of one chunk (PLAN) and return the state it ends in; put stands for catalogue.put in tests."""
    put = put or catalogue.put
    first = rows.agg(F.first("chunk"), F.count(F.lit(1))).first()
    chunk, items = first[0], first[1]
    state = catalogue.states().get(chunk)
    if state == "complete":
        return state
    if state in ("started", "failed"):  # a run before this one stopped here: what it may have written is taken back
        catalogue.put(f"{chunk}.undo", rows.select("id", F.col("previous").alias("rating")))
    if _differing(rows, catalogue, "previous"):
        catalogue.note(chunk, "replan_required", items, 0)
        return "replan_required"
    catalogue.note(chunk, "started", items, 0)
    try:
        put(chunk, rows.select("id", F.col("target").alias("rating")))
        wrong = _differing(rows, catalogue, "target")
    except Exception:  # noqa: BLE001 - whatever the store says, the chunk is undone
        wrong = items
    if not wrong:
        catalogue.note(chunk, "complete", items, items)
        return "complete"
    catalogue.put(f"{chunk}.undo", rows.select("id", F.col("previous").alias("rating")))
    state = "manual_recovery_required" if _differing(rows, catalogue, "previous") else "failed"
    catalogue.note(chunk, state, items, items - wrong)
    return state


def execute(spark: SparkSession, plan: str, catalogue: Catalogue, checkpoint: str, put: Callable[[str, DataFrame], None] | None = None) -> str:
    """All chunks of a plan folder in turn; the state of the last one that was begun (complete: of all).

    A chunk that doesn't complete stops the run; the next call goes on with it.
    """
    ended: list[str] = []

    def batch(rows: DataFrame, _: int) -> None:
        held = rows.persist()
        try:
            if not held.isEmpty():
                ended.append(write_chunk(held, catalogue, put))
                if not STATES[ended[-1]]:
                    raise Stopped(ended[-1])
        finally:
            held.unpersist()

    stream = spark.readStream.schema(PLAN).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(plan)
    query = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if not ended or STATES[ended[-1]]:
            raise
    return ended[-1] if ended else "complete"


def receipt(plan: DataFrame, catalogue: Catalogue) -> DataFrame:
    """plan (PLAN) with final, the rating that the catalogue holds now, and what became of each item.

    pending: its chunk wasn't begun; unsettled: begun, without an end; verified: written and still so; changed: written, and
    changed by someone since; skipped: its chunk had drifted from the plan; restored: its chunk failed and was undone;
    broken: its chunk failed and the old state isn't back.
    """
    state = catalogue.journal().groupBy("chunk").agg(F.max_by("state", "revision").alias("_state"))  # a row a chunk
    now = catalogue.read().withColumnRenamed("rating", "final")
    held = plan.join(state, "chunk", "left").join(now, "id", "left")
    is_ = lambda c: F.col("final").eqNullSafe(F.col(c))
    status = (
        F.when(F.col("_state").isNull(), "pending").when(F.col("_state") == "started", "unsettled").when(F.col("_state") == "complete", F.when(is_("target"), "verified").otherwise("changed"))
        .when(F.col("_state") == "replan_required", "skipped").when(is_("previous"), "restored").otherwise("broken")
    )
    return held.select("id", "chunk", "action", "previous", "target", "final", status.alias("status"))


def receipt_phase(items: DataFrame) -> DataFrame:
    """One row over receipt's items: phase (empty, begun, running, finished or error), items, verified, pending, wrong."""
    n, wrong = F.count(F.lit(1)), F.count_if(F.col("status").isin("skipped", "restored", "broken"))
    verified, waiting = F.count_if(F.col("status").isin("verified", "changed")), F.count_if(F.col("status") == "pending")
    phase = F.when(n == 0, "empty").when(wrong > 0, "error").when(waiting == n, "begun").when(verified == n, "finished").otherwise("running")
    return items.agg(phase.alias("phase"), n.alias("items"), verified.alias("verified"), waiting.alias("pending"), wrong.alias("wrong"))
