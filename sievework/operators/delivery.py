"""Delivery: export plans, catalogue differences, receipts and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import safe_relative


def export_plan(rows: DataFrame, files: DataFrame, existing: DataFrame, least_stars: int) -> DataFrame:
    """One row a delivered item: id, stars, path, target and action copy, skip, conflict or invalid.

    rows: id, stars, path (relative); files: id, sha; existing: target, sha. Of items with one target the first by
    (stars desc, path, id) has it and the others conflict; a target that exists is skipped where its hash is the same.
    """
    target = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    held = rows.filter(F.col("stars") >= least_stars).select("id", "stars", "path", target.alias("target")).join(files.select("id", "sha"), "id", "left")
    w = Window.partitionBy("target").orderBy(F.desc("stars"), "path", "id")
    known = held.select("*", F.row_number().over(w).alias("_n")).join(existing.select("target", F.col("sha").alias("_has")), "target", "left")
    action = F.when(F.col("sha").isNull() | ~safe_relative(F.col("path")), "invalid").when(F.col("_n") > 1, "conflict").when(F.col("_has").isNull(), "copy").when(F.col("_has") == F.col("sha"), "skip").otherwise("conflict")
    return known.select("id", "stars", "path", "target", "sha", action.alias("action"))


def plan_hash(plan: DataFrame) -> DataFrame:
    """One row: items and a hash of the plan that doesn't depend on row order: digests a row, then of the sorted digests of 256 parts."""
    row = plan.select(F.sha2(F.to_json(F.struct(*sorted(plan.columns)), {"ignoreNullFields": "false"}), 256).alias("d"))
    part = row.groupBy(F.substring("d", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("d")), ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("items"), F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat("p", "h"))), ""), 256).alias("plan_hash"))


def classify_changes(plan: DataFrame, live: DataFrame, key: str, protect_above: int = 3) -> DataFrame:
    """Each planned item against the live catalogue: new, update, unchanged, protected or invalid."""
    known = plan.join(live.select(key, F.col("rating").alias("previous")), key, "left")
    action = F.when(F.col("target_rating").isNull() | ~F.col("target_rating").between(0, 5), "invalid").when(F.col("previous").isNull(), "new").when(F.col("previous") > protect_above, "protected").when(F.col("previous") == F.col("target_rating"), "unchanged").otherwise("update")
    return known.select(key, "target_rating", "previous", action.alias("action"))


def drift(plan: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Items whose live state isn't the planned baseline, with the first failing check."""
    now = live.select(key, F.col("size").alias("_size"), F.col("modified").alias("_modified"), F.col("rating").alias("_rating"))
    code = F.when(F.col("_size").isNull(), "missing").when(F.col("_size") != F.col("size"), "size").when(F.floor(F.col("modified") / 10**9) != F.floor(F.col("_modified") / 10**9), "modified").when(~F.col("_rating").eqNullSafe(F.col("baseline")), "rating")
    return plan.join(now, key, "left").select(key, code.alias("drift")).filter("drift is not null")


def action_counts(items: DataFrame, actions: tuple[str, ...] = ("new", "update", "unchanged", "protected", "invalid")) -> DataFrame:
    return items.agg(*[F.count_if(F.col("action") == a).alias(a) for a in actions], F.count(F.lit(1)).alias("total"))


def reconcile(manifest: DataFrame, receipt: DataFrame, key: str) -> DataFrame:
    """Full outer match of manifest and receipt: missing, unexpected, mismatch or verified, a count each."""
    a = manifest.select(key, F.col("target_rating").alias("_want"))
    b = receipt.select(key, F.col("final_rating").alias("_got"))
    state = F.when(F.col("_want").isNull(), "unexpected").when(F.col("_got").isNull(), "missing").when(F.col("_want") != F.col("_got"), "mismatch").otherwise("verified")
    return a.join(b, key, "full").groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("items"))


def pending(manifest: DataFrame, journal: DataFrame, key: str, action: str) -> DataFrame:
    """Items of an action that the journal hasn't verified."""
    done = journal.filter("verified").select(key)
    return manifest.filter(F.col("action") == action).join(done, key, "left_anti")


def rollback(receipt: DataFrame, live: DataFrame, key: str) -> DataFrame:
    """Ratings to restore: items whose live rating is still the one that was written; others were changed by the user."""
    now = live.select(key, F.col("rating").alias("_now"))
    held = receipt.join(now, key)
    return held.select(key, F.when(F.col("_now") == F.col("final_rating"), F.col("previous_rating")).alias("restore"), (F.col("_now") != F.col("final_rating")).alias("conflict"))


def fingerprint_matches(size: Column, modified_ns: Column, now_size: Column, now_seconds: Column) -> Column:
    """Equal size and whole-second modification time; the catalogue counts seconds from 2001."""
    return (size == now_size) & (F.floor(modified_ns / 10**9) == now_seconds + 978307200)
