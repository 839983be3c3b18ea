"""Evaluation against labels: set metrics, ranking metrics, audits, micro averages and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import safe_ratio
from .ranking import running_total


def confusion(predicted: Column, expected: Column) -> list[Column]:
    """tp, fp, fn, tn counts of two boolean columns."""
    return [F.count_if(p & e).alias(n) for n, p, e in (("tp", predicted, expected), ("fp", predicted, ~expected), ("fn", ~predicted, expected), ("tn", ~predicted, ~expected))]


def rates(counts: DataFrame) -> DataFrame:
    """precision, recall (to 4 places), f1 (of the unrounded ones, to 4 places) and accuracy beside tp, fp, fn, tn."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select("*", safe_ratio(tp, tp + fp).alias("precision"), safe_ratio(tp, tp + fn).alias("recall"), safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def ranking_metrics(rows: DataFrame, group: str, rank: str, label: Column, ks: tuple[int, ...] = (1, 2, 3, 5)) -> DataFrame:
    """One row: groups with a label, top-1 hit rate, mean reciprocal rank, and hit and recall at each k."""
    per = rows.filter(label).groupBy(group).agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(rank) <= k).alias(f"in{k}") for k in ks])
    hits = [F.bround(F.avg((F.col("best") <= k).cast("double")), 6).alias(f"hit_at_{k}") for k in ks]
    recalls = [F.bround(F.sum(f"in{k}") / F.sum("n"), 6).alias(f"recall_at_{k}") for k in ks]
    return per.agg(F.count(F.lit(1)).alias("groups"), F.bround(F.avg(1 / F.col("best")), 6).alias("mrr"), *hits, *recalls)


def grouping_summary(sizes: DataFrame, size: str) -> DataFrame:
    """One row: groups, singletons, largest, p95 (element floor(0.95 n) of the sorted sizes) and reduction if one a group stays.

    The sizes are counted by value first, so no list of all groups is made.
    """
    by = sizes.groupBy(size).agg(F.count(F.lit(1)).alias("n"))
    upto = by.select(size, "n", F.sum("n").over(Window.orderBy(size)).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))  # one row a distinct size
    return upto.agg(
        F.max("all").alias("groups"), F.coalesce(F.sum(F.when(F.col(size) == 1, F.col("n"))), F.lit(0)).alias("singletons"), F.max(size).alias("largest"),
        F.min(F.when(F.col("upto") > F.floor(0.95 * F.col("all")), F.col(size))).alias("p95"), F.bround(1 - F.max("all") / F.sum(F.col(size) * F.col("n")), 6).alias("reduction"),
    )


def duplicate_leaks(rows: DataFrame, cluster: str) -> DataFrame:
    """One row: clusters delivered twice or more, rows too many, and pairs too many; null clusters never match."""
    n = F.col("n")
    by = rows.filter(F.col(cluster).isNotNull()).groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.count_if(n > 1).alias("clusters"), F.coalesce(F.sum(n - 1), F.lit(0)).alias("leaks"), F.coalesce(F.sum((n * (n - 1) / 2).cast("long")), F.lit(0)).alias("pairs"))


def pair_audit(pairs: DataFrame, clusters: DataFrame, key: str, cluster: str) -> DataFrame:
    """Confusion of labelled pairs (left_id, right_id, duplicate) against equal, known clusters."""
    a = clusters.select(F.col(key).alias("left_id"), F.col(cluster).alias("_a"))
    b = clusters.select(F.col(key).alias("right_id"), F.col(cluster).alias("_b"))
    both = pairs.join(a, "left_id", "left").join(b, "right_id", "left")
    return rates(both.agg(*confusion(F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)), F.col("duplicate"))))


def roc_auc(rows: DataFrame, score: str, positive: Column) -> DataFrame:
    """One row: auc, ties counting half; scores are counted by value, so equal ones cost one row."""
    by = rows.groupBy(score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    held = running_total(by, [F.col(score)], F.col("n"), "upto")
    right = F.sum(F.col("p") * (F.col("upto") - F.col("n") + 0.5 * F.col("n")))
    return held.agg(F.bround(right / (F.sum("p") * F.sum("n")), 6).alias("auc"), F.sum("p").alias("positives"), F.sum("n").alias("negatives"))


def pairwise_accuracy(rows: DataFrame, group: str, score: str, positive: Column) -> DataFrame:
    """One row: share of (positive, negative) pairs inside a group in the right order, ties half; top-1 hits; groups with both.

    By counts of scores inside the group, so pairs are never listed.
    """
    by = rows.groupBy(group, score).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    w = Window.partitionBy(group).orderBy(score)
    held = by.select(group, "p", "n", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"), (F.row_number().over(w.orderBy(F.desc(score))) == 1).alias("top"))
    per = held.groupBy(group).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum(F.col("p") * (F.col("below") + 0.5 * F.col("n"))).alias("right"), F.max(F.when(F.col("top"), (F.col("p") > 0).cast("int"))).alias("hit"))
    return per.filter("p > 0 and n > 0").agg(F.bround(F.sum("right") / F.sum(F.col("p") * F.col("n")), 6).alias("pairwise_accuracy"), F.bround(F.avg("hit"), 6).alias("top1"), F.count(F.lit(1)).alias("groups"))


def threshold_sweep(rows: DataFrame, score: str, positive: Column, low: float = 0.12, high: float = 0.88, steps: int = 153) -> DataFrame:
    """Counts and rates at each of the steps thresholds: one pass counts rows by the number of thresholds they reach."""
    width = (high - low) / (steps - 1)
    reached = F.least(F.lit(steps), F.greatest(F.lit(0), F.floor((F.col(score) - low) / width + 1e-9) + 1))
    by = rows.groupBy(reached.cast("int").alias("k")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("n"))
    frame = rows.sparkSession.range(0, steps + 1).select(F.col("id").cast("int").alias("k")).join(by, "k", "left").fillna(0, ["p", "n"])
    w = Window.orderBy(F.desc("k"))  # steps + 1 rows
    run = frame.select("k", F.sum("p").over(w).alias("tp"), F.sum("n").over(w).alias("fp"), F.sum("p").over(Window.partitionBy()).alias("P"), F.sum("n").over(Window.partitionBy()).alias("N"))
    counts = run.filter("k > 0").select(F.round(low + (F.col("k") - 1) * width, 6).alias("threshold"), "tp", "fp", (F.col("P") - F.col("tp")).alias("fn"), (F.col("N") - F.col("fp")).alias("tn"))
    return rates(counts)


def best_threshold(swept: DataFrame) -> DataFrame:
    order = F.struct("f1", "precision", (-F.abs(F.col("threshold") - 0.5)).alias("near"), (-F.col("threshold")).alias("low"))
    return swept.agg(F.max_by(F.struct(*swept.columns), order).alias("b")).select("b.*")


def micro_average(reports: DataFrame) -> DataFrame:
    """Counts of all datasets summed, then rates; ok is true if all are, false if one is, null if one is unknown."""
    flag = F.when(F.count_if(F.col("ok") == F.lit(False)) > 0, False).when(F.count_if(F.col("ok").isNull()) > 0, F.lit(None).cast("boolean")).otherwise(True)
    return rates(reports.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], flag.alias("ok")))


def gates(baseline: DataFrame, candidate: DataFrame, on: str, least_gain: float = 0.03, most_loss: float = 0.01) -> DataFrame:
    """One row a dataset with the change of top1 and safety and each check, for development data."""
    b = baseline.select(on, F.col("top1").alias("b1"), F.col("safety").alias("b2"))
    both = candidate.select(on, "top1", "safety").join(b, on)
    gain, safety = F.bround(F.col("top1") - F.col("b1"), 6), F.bround(F.col("safety") - F.col("b2"), 6)
    mean = F.bround(F.avg(gain).over(Window.partitionBy()), 6)
    return both.select(on, gain.alias("top1_gain"), safety.alias("safety_gain"), (gain >= -most_loss).alias("top1_ok"), (safety >= -most_loss).alias("safety_ok"), (mean >= least_gain).alias("mean_ok"))


def group_hits(rows: DataFrame, group: str, chosen: Column, labelled: Column) -> DataFrame:
    """One row: selected, labelled, hits, recall, groups with a label, those with a hit, reduction."""
    per = rows.groupBy(group).agg(F.count_if(chosen).alias("s"), F.count_if(labelled).alias("l"), F.count_if(chosen & labelled).alias("h"), F.count(F.lit(1)).alias("n"))
    named = F.col("l") > 0
    return per.agg(F.sum("s").alias("selected"), F.sum("l").alias("labelled"), F.sum("h").alias("hits"), safe_ratio(F.sum("h"), F.sum("l")).alias("recall"), F.count_if(named).alias("groups"), F.count_if(named & (F.col("h") > 0)).alias("groups_hit"), safe_ratio(F.sum("n") - F.sum("s"), F.sum("n")).alias("reduction"))
