"""Order, rank, percentile and group-relative features as window functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import ready_to_checkpoint


def temporal_order(t: str, sequence: str, name: str, key: str) -> list[Column]:
    """The canonical order: time (unknown last), sequence (-1 last), name without case, key."""
    seq = F.when(F.col(sequence) >= 0, F.col(sequence))
    return [F.col(t).asc_nulls_last(), seq.asc_nulls_last(), F.lower(name).asc(), F.col(key).asc()]


def temporal_place(t: str, sequence: str, name: str, key: str) -> Column:
    """A struct that compares as temporal_order sorts."""
    known = F.when(F.col(sequence) >= 0, F.col(sequence))
    return F.struct(F.col(t).isNull().alias("u"), F.col(t).alias("t"), known.isNull().alias("v"), known.alias("s"), F.lower(name).alias("n"), F.col(key).alias("k"))


def sessions(rows: DataFrame, key: str, t: str, gap: float, tie: str) -> DataFrame:
    """session: number of the row's activity session within key; a gap of more than `gap` opens a new one."""
    w = Window.partitionBy(key).orderBy(t, tie)
    opens = F.when(F.col(t) - F.lag(t).over(w) > gap, 1).otherwise(0)
    return rows.select("*", opens.alias("_new")).select("*", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("session")).drop("_new")


def rank_percentile(group: list[str], order: list[Column]) -> Column:
    """1 for the first of a group, falling to 0 for the last; 1 for a group of one."""
    w = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(w)
    return F.when(n <= 1, 1.0).otherwise(1 - (F.row_number().over(w.orderBy(*order)) - 1) / (n - 1))


def value_percentile(group: list[str], value: str, tie: Column) -> Column:
    """Rank share 0 to 1 by value, ties by the given order; 0.5 for all where the group has one row or no spread."""
    w = Window.partitionBy(*group)
    n, spread = F.count(F.lit(1)).over(w), F.max(value).over(w) - F.min(value).over(w)
    return F.when((n <= 1) | (spread < 1e-9), 0.5).otherwise((F.row_number().over(w.orderBy(F.col(value), tie)) - 1) / (n - 1))


def group_features(rows: DataFrame, group: list[str], score: str, metrics: list[str]) -> DataFrame:
    """group_size, score_gap, quality_percentile (share of the group with no higher score) and <metric>_gap to the group's best."""
    w = Window.partitionBy(*group)
    gaps = [(F.col(m) - F.max(m).over(w)).alias(f"{m}_gap") for m in metrics]
    return rows.select("*", F.count(F.lit(1)).over(w).alias("group_size"), (F.col(score) - F.max(score).over(w)).alias("score_gap"), (100 * F.cume_dist().over(w.orderBy(score))).alias("quality_percentile"), *gaps)


def ranked(rows: DataFrame, group: list[str], order: list[Column], keep: int = 1, name: str = "rank") -> DataFrame:
    """Rank in group and whether it is among the first `keep`."""
    r = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.select("*", r.cast("long").alias(name)).withColumn("is_top", F.col(name) <= keep)


def provisional_stars(score: Column) -> Column:
    return F.when(score >= 86, 3).when(score >= 72, 2).when(score >= 55, 1).otherwise(0)


def seed_rows(rows: DataFrame, group: str, eligible: Column, rank: str, learned: str, name: str) -> DataFrame:
    """Each group's first eligible row by rank (0: unranked), then learned score, then name."""
    order = F.struct(F.when(F.col(rank) > 0, F.col(rank)).otherwise(10**9), -F.col(learned), F.lower(name))
    return rows.filter(eligible).groupBy(group).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def folder_stages(rows: DataFrame, path: str, order: str) -> DataFrame:
    """folder, stage: stages by top folder, numbered by first row; null where folders don't carry stages.

    They do where there are two top folders or more, and max(2, round(0.8 n)) rows lie in one.
    """
    from ..functions.names import top_folder

    named = rows.withColumn("folder", F.when(top_folder(F.col(path)) == "", "root").otherwise(top_folder(F.col(path))))
    by = named.groupBy("folder").agg(F.min(order).alias("_first"), F.count(F.lit(1)).alias("_n"))
    facts = by.agg(F.count_if(F.col("folder") != "root").alias("k"), F.sum(F.when(F.col("folder") != "root", F.col("_n")).otherwise(0)).alias("nested"), F.sum("_n").alias("n")).first()
    usable = facts["n"] is not None and facts["k"] >= 2 and facts["nested"] >= max(2, round(0.8 * facts["n"]))
    number = F.row_number().over(Window.orderBy("_first", "folder")) if usable else F.lit(None)  # one row a folder
    stages = by.select("folder", number.cast("long").alias("stage"))
    return named.join(stages, "folder")


def folder_stages_by(rows: DataFrame, key: str, path: str, place: Column, tie: str) -> DataFrame:
    """(key, tie, folder_stage): stages by top folder within each key, numbered by their first rows (least place); null where folders don't carry stages.

    See folder_stages; here every key (a budget) is judged by itself, in one grouped pass.
    """
    from ..functions.names import top_folder

    folder = F.coalesce(F.nullif(top_folder(F.col(path)), F.lit("")), F.lit("root"))
    named = rows.select(key, tie, folder.alias("_f"), place.alias("_o"))
    by = named.groupBy(key, "_f").agg(F.min("_o").alias("_first"), F.count(F.lit(1)).alias("_n"))
    all_ = Window.partitionBy(key)
    nested, kinds = F.sum(F.when(F.col("_f") != "root", F.col("_n")).otherwise(0)).over(all_), F.count_if(F.col("_f") != "root").over(all_)
    usable = (kinds >= 2) & (nested >= F.greatest(F.lit(2), F.bround(0.8 * F.sum("_n").over(all_))))
    stages = by.select(key, "_f", F.when(usable, F.row_number().over(all_.orderBy("_first", "_f"))).cast("long").alias("folder_stage"))
    return named.join(stages, [key, "_f"]).select(key, tie, "folder_stage")


def running_total(rows: DataFrame, order: list[Column], value: Column, name: str) -> DataFrame:
    """Sum of value over all rows up to each row in a total order, without gathering them in one task.

    Rows are sorted into partitions; totals of partitions (one number each) come to the driver, and each row adds the
    total before its partition to the sum inside it. The sorted rows are checkpointed, so they outlive executors and are
    cleaned with the result.
    """
    ready_to_checkpoint(rows.sparkSession)
    held = rows.orderBy(*order).select("*", F.monotonically_increasing_id().alias("_at"), value.cast("long").alias("_v")).checkpoint()
    part = F.shiftright("_at", 33)
    totals = {r["p"]: r["n"] for r in held.groupBy(part.alias("p")).agg(F.sum("_v").alias("n")).collect()}
    before, upto = {}, 0
    for p in sorted(totals):
        before[p] = upto
        upto += totals[p] or 0
    offset = F.element_at(F.create_map(*[F.lit(x) for kv in before.items() for x in kv]), part) if before else F.lit(0)
    inside = F.sum("_v").over(Window.partitionBy(part).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return held.select(*rows.columns, (offset + inside).cast("long").alias(name))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Number all rows from 1 in a total order; see running_total."""
    return running_total(rows, order, F.lit(1), name)


def rotated(rows: DataFrame, group: str, salt: Column, key: str, offset: int) -> DataFrame:
    """position: a repeatable shuffle within group by hash, rotated by offset."""
    w = Window.partitionBy(group)
    at = F.row_number().over(w.orderBy(F.sha2(F.concat_ws(":", salt, F.col(key).cast("string")), 256), key)) - 1
    return rows.select("*", F.pmod(at - offset, F.count(F.lit(1)).over(w)).cast("long").alias("position"))


def chunked(rows: DataFrame, group: list[str], order: list[Column], size: int) -> DataFrame:
    """chunk: number of the fixed-size chunk within group."""
    at = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1
    return rows.select("*", F.floor(at / size).cast("long").alias("chunk"))


def cyclic_next(group: list[str], order: list[Column], key: str) -> Column:
    """The next row's key, the first row's after the last."""
    w = Window.partitionBy(*group).orderBy(*order)
    return F.coalesce(F.lead(key).over(w), F.first(key).over(w))


def reasons(candidates: list[Column], most: int = 5) -> Column:
    """Non-empty reasons in order, each once, the first `most`."""
    return F.slice(F.array_distinct(F.filter(F.array_compact(F.array(*candidates)), lambda x: x != "")), 1, most)


def reranked(rows: DataFrame, group: str, outer_rank: str, rank: str) -> DataFrame:
    """rank: rows that an outside ranking names come first in its order, the others keep theirs."""
    order = F.coalesce(F.col(outer_rank), F.col(rank) + 10**6)
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("long"))


def ambiguous_groups(rows: DataFrame, group: str, score: str, key: str, margin: float, most_candidates: int, limit: int) -> DataFrame:
    """The `limit` groups whose two best lie closest (gap <= margin): smallest gap, most candidates, least group first."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    top = rows.select(group, key, score, F.row_number().over(w).alias("_r"), F.lead(score).over(w).alias("_next"))
    facts = top.groupBy(group).agg(F.max(F.when(F.col("_r") == 1, F.col(score) - F.col("_next"))).alias("gap"), F.least(F.count(F.lit(1)), F.lit(most_candidates)).alias("candidates"))
    return facts.filter(F.col("gap") <= margin).orderBy("gap", F.desc("candidates"), group).limit(limit)
