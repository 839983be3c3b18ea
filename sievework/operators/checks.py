"""Checks of what comes from outside: manifests, receipts, requests and projects. Each gives the faults by name, all at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the exchange format.
REQUEST_ID = r"^[0-9A-Fa-f-]{16,64}$"
DIGEST = r"^[0-9A-Fa-f]{64}$"
TIERS = ("waste", "valuable", "coverage", "primary")
ACTIONS = ("new", "update", "unchanged", "protected", "invalid")
# What requests and settings may be (name, least, greatest).
RANGES = (
    ("keep_per_group", 1, 5), ("coverage_window_minutes", 5, 60), ("face_identity_threshold", 0.32, 0.62), ("jpeg_preview_quality", 60, 95), ("context_size", 4096, 32768),
    ("gpu_layers", 0, 256), ("max_groups", 1, 500), ("max_candidates", 2, 8), ("ambiguity_margin", 0.5, 30.0), ("min_confidence", 0.5, 0.95), ("timeout_seconds", 30, 900),
    ("stars", 0, 3), ("minimum_stars", 1, 3), ("revision", 0, 2**31 - 1),
)


def _faults(conditions: dict[str, Column]) -> Column:
    """Names of the conditions that don't hold, as an array; a condition on nulls doesn't hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()]))


def _long(name: str, least: int, most: int) -> Column:
    return F.length(name).between(least, most)


def out_of_range(rows: DataFrame, key: str) -> DataFrame:
    """(key, faults): which of the known settings of a row lie outside their range; a null is not set, which is allowed."""
    held = {n: F.col(n).isNull() | F.col(n).between(lo, hi) for n, lo, hi in RANGES if n in rows.columns}
    return rows.select(key, _faults(held).alias("faults"))


def native_projects(projects: DataFrame) -> DataFrame:
    """projects with gate: ready, or why a project must be scanned anew before it is evaluated or delivered."""
    native = (F.col("schema_version") == 2) & (F.col("status") == "native") & F.col("delivery_ready")
    gate = F.when(F.coalesce("identity_rescan_required", F.lit(False)), "identities_changed").when(~F.coalesce(native, F.lit(False)), "not_native").when(F.trim(F.coalesce("project_id", F.lit(""))) == "", "no_id").otherwise("ready")
    return projects.withColumn("gate", gate)


def _repeated(rows: DataFrame, key: str, column: str, fault: str) -> DataFrame:
    twice = rows.groupBy(key, column).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return twice.select(key).distinct().withColumn("fault", F.lit(fault))


def _listed(keys: DataFrame, key: str, faults: list[DataFrame]) -> DataFrame:
    said = reduce(DataFrame.unionByName, faults).groupBy(key).agg(F.sort_array(F.collect_set("fault")).alias("_f"))  # few names a key
    held = keys.select(key).distinct().join(said, key, "left").select(key, F.coalesce("_f", F.array().cast("array<string>")).alias("faults"))
    return held.withColumn("sound", F.size("faults") == 0)


def manifest_faults(manifests: DataFrame, items: DataFrame) -> DataFrame:
    """(request_id, faults, sound) of every manifest.

    manifests: request_id, operation_id, plan_hash, operation, app_version, created_at, import_mode, collection_mode,
    write_xmp, protect_above; items: request_id, item_id, source_path, path_hash, file_size, modified_ns, target_rating,
    rating_tier, rating_reason. Ids and path hashes of a manifest are each unique; a manifest without items is at fault.
    """
    head = {
        "request_id": F.col("request_id").rlike(REQUEST_ID), "operation_id": F.col("operation_id").rlike(REQUEST_ID), "plan_hash": F.col("plan_hash").rlike(DIGEST), "operation": F.col("operation").isin("preflight", "execute"),
        "app_version": _long("app_version", 1, 40), "created_at": _long("created_at", 10, 80),
        "policy": (F.col("import_mode") == "in_place") & (F.col("collection_mode") == "none") & ~F.col("write_xmp") & (F.col("protect_above") == 3),
    }
    part = {
        "item_id": _long("item_id", 1, 128), "source_path": _long("source_path", 3, 4096), "path_hash": F.col("path_hash").rlike(DIGEST), "file_size": F.col("file_size") >= 0, "modified_ns": F.col("modified_ns") >= 0,
        "target_rating": F.col("target_rating").between(0, 3), "rating_tier": F.col("rating_tier").isin(*TIERS), "rating_reason": _long("rating_reason", 1, 256),
    }
    of = lambda rows, c: rows.select("request_id", F.explode(_faults(c)).alias("fault"))
    empty = manifests.join(items.select("request_id").distinct(), "request_id", "left_anti").select("request_id", F.lit("no_items").alias("fault"))
    return _listed(manifests, "request_id", [of(manifests, head), of(items, part), empty, _repeated(items, "request_id", "item_id", "repeated_id"), _repeated(items, "request_id", "path_hash", "repeated_path")])


def receipt_faults(manifests: DataFrame, items: DataFrame, receipts: DataFrame, receipt_items: DataFrame) -> DataFrame:
    """(request_id, faults, sound) of every receipt against the manifest that it answers.

    manifests: request_id, operation_id, plan_hash; items: request_id, item_id, path_hash, target_rating; receipts: as
    manifests, with total and a count an action; receipt_items: as items, with action. Items must be the manifest's, once
    each, with the same fingerprint and target; totals and counts an action must be those of the items.
    """
    n = F.count(F.lit(1))
    planned = items.groupBy("request_id").agg(n.alias("_planned"))
    got = receipt_items.groupBy("request_id").agg(n.alias("_got"), *[F.count_if(F.col("action") == a).alias(f"_{a}") for a in ACTIONS])
    want = manifests.select("request_id", F.col("operation_id").alias("_op"), F.col("plan_hash").alias("_plan"))
    held = receipts.join(want, "request_id", "left").join(planned, "request_id", "left").join(got, "request_id", "left").fillna(0, ["_planned", "_got", *[f"_{a}" for a in ACTIONS]])
    counted = reduce(lambda a, b: a + b, [F.col(a) for a in ACTIONS])
    head = {
        "plan": (F.col("operation_id") == F.col("_op")) & (F.col("plan_hash") == F.col("_plan")), "total": (F.col("total") == F.col("_planned")) & (F.col("_got") == F.col("_planned")), "counts": counted == F.col("total"),
        "actions": reduce(lambda a, b: a & b, [F.col(a) == F.col(f"_{a}") for a in ACTIONS]),
    }
    own = items.select("request_id", "item_id", F.col("path_hash").alias("_path"), F.col("target_rating").alias("_target")).dropDuplicates(["request_id", "item_id"])
    met = receipt_items.join(own, ["request_id", "item_id"], "left")
    same = {"unknown_item": F.col("_path").isNotNull(), "item": F.col("_path").isNull() | ((F.col("path_hash") == F.col("_path")) & F.col("target_rating").eqNullSafe(F.col("_target")))}
    of = lambda rows, c: rows.select("request_id", F.explode(_faults(c)).alias("fault"))
    return _listed(receipts, "request_id", [of(held, head), of(met, same), _repeated(receipt_items, "request_id", "item_id", "repeated_item")])
