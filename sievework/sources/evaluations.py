"""Evaluation reports of differing nesting, read as VARIANT: one row a report with its checked metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a metric stands in a report: the first path that is there counts. A report may hold everything below summary.
PATHS = {
    "top1": ("group_evaluation.top1_exact_group_hit_rate", "top1"),
    "top2": ("group_evaluation.group_hit_at_2", "top2"),
    "strict_f1": ("strict_ai_best.f1", "strict_f1"),
    "dedup": ("grouping_summary.top1_reduction_rate", "dedup"),
    "closed": ("eye_evidence_evaluation.manual_with_decisive_closed", "closed"),
    "required": ("engine.coverage_guard.required_cells", "coverage_guard.required_cells"),
    "unresolved": ("engine.coverage_guard.unresolved_cells", "coverage_guard.unresolved_cells"),
}
RATES = ("top1", "top2", "strict_f1", "dedup")


def _found(v: Column, name: str, kind: str) -> Column:
    places = [f"$.{head}{p}" for p in PATHS[name] for head in ("", "summary.")]
    return F.coalesce(*[F.try_variant_get(v, p, kind) for p in places])


def report_metrics(reports: DataFrame, name: str, text: str) -> DataFrame:
    """(name, top1, top2, strict_f1, dedup, coverage, closed, faults) of reports (name, JSON text).

    faults lists what is wrong, in order: not_an_object, a rate that is missing or not within 0 to 1, closed where the count
    is missing or negative, coverage where the counts of cells contradict each other (missing ones are 0, none required
    is full coverage). A metric at fault is null; a report without faults may be compared.
    """
    v = F.try_parse_json(text)
    read = reports.select(name, v.alias("_v")).select(name, F.schema_of_variant("_v").startswith("OBJECT").alias("_object"), *[_found(F.col("_v"), k, "double").alias(f"_{k}") for k in PATHS])
    in_range = lambda c: c.isNotNull() & ~F.isnan(c) & (c >= 0) & (c <= 1)
    whole = lambda k: F.coalesce(F.col(k), F.lit(0.0)).cast("long")
    need, rest = whole("_required"), whole("_unresolved")
    sound = {k: in_range(F.col(f"_{k}")) for k in RATES} | {"coverage": (need >= 0) & (rest >= 0) & (rest <= need), "closed": F.coalesce(F.col("_closed") >= 0, F.lit(False))}
    is_object = F.coalesce("_object", F.lit(False))
    faults = F.array_compact(F.array(F.when(~is_object, "not_an_object"), *[F.when(is_object & ~ok, k) for k, ok in sound.items()]))
    coverage = F.when(need == 0, 1.0).otherwise((need - rest) / need)
    values = {k: F.col(f"_{k}") for k in RATES} | {"coverage": coverage, "closed": F.col("_closed").cast("long")}
    return read.select(name, *[F.when(is_object & sound[k], x).alias(k) for k, x in values.items()], faults.alias("faults"))


def compared(baseline: DataFrame, candidate: DataFrame, name: str) -> DataFrame:
    """(name, each metric's change from baseline to candidate) of the datasets whose reports are both without faults."""
    metrics = [*RATES, "coverage", "closed"]
    side = lambda d, s: d.filter(F.size("faults") == 0).select(name, *[F.col(m).alias(f"{s}_{m}") for m in metrics])
    both = side(baseline, "b").join(side(candidate, "c"), name)
    return both.select(name, *[F.bround(F.col(f"c_{m}") - F.col(f"b_{m}"), 9).alias(m) for m in metrics])


def named_once(spec: DataFrame, name: str = "name", version: str = "version", versions: tuple[int, ...] = (1,)) -> list[str]:
    """What keeps a dataset specification (a row a dataset) from use: unknown versions, missing and repeated names; empty if nothing.

    The number of datasets is small by nature; only the faults come to the driver.
    """
    known = reduce(lambda a, b: a | b, [F.col(version) == v for v in versions])
    faults = spec.agg(F.count_if(~F.coalesce(known, F.lit(False))).alias("v"), F.count_if(F.coalesce(F.trim(name) == "", F.lit(True))).alias("m"), (F.count(name) - F.countDistinct(name)).alias("r")).first()
    return [k for k, n in (("version", faults["v"]), ("missing_name", faults["m"]), ("repeated_name", faults["r"])) if n]
