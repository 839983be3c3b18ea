"""Review of decisions: outside rankings, disagreements, protection, progress, prompts, model choice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import numbered


# ---- outside rankings
def decision_key(group: Column, model: Column, prompt: Column, photos: Column) -> Column:
    """Cache key of an outside decision: SHA-256 over its inputs; photos (structs) count in the order of their fields."""
    return F.sha2(F.concat_ws("|", prompt, model, group, F.array_join(F.transform(F.sort_array(photos), lambda p: F.to_csv(p)), ";")), 256)


def ab_effect(baseline_hit: Column, effective_hit: Column) -> Column:
    """improved where only the outside winner is a hit, regressed where only the baseline is, else neutral."""
    return F.when(effective_hit & ~baseline_hit, "improved").when(baseline_hit & ~effective_hit, "regressed").otherwise("neutral")


def ab_summary(records: DataFrame) -> DataFrame:
    """One row of counts over A/B records: success, baseline_hit, raw_hit, effective_hit, top2_hit, changed, seconds."""
    ok, n = F.col("success"), F.count(F.lit(1))
    hit = lambda c: F.count_if(ok & F.col(c))
    effect = ab_effect(F.col("baseline_hit"), F.col("effective_hit"))
    effects = [F.count_if(ok & (effect == e)).alias(name) for e, name in (("improved", "improvements"), ("regressed", "regressions"), ("neutral", "neutral"))]
    return records.agg(
        n.alias("requested_groups"), F.count_if(ok).alias("successes"), F.count_if(~ok).alias("failures"), hit("baseline_hit").alias("baseline_top1_hits"), hit("raw_hit").alias("raw_top1_hits"),
        hit("effective_hit").alias("effective_top1_hits"), hit("top2_hit").alias("effective_top2_hits"), hit("changed").alias("applied_changes"), *effects,
        F.coalesce(F.bround(F.avg(F.when(ok, F.col("seconds"))), 2), F.lit(0.0)).alias("average_group_seconds"),
    )


def fact_line(key: Column, numbers: list[tuple[str, Column]], people: Column, issues: Column) -> Column:
    """One photo's facts for a prompt: numbers to one place (cut), people sorted, issues or none."""
    tenth = lambda x: F.concat_ws(".", F.floor(x).cast("string"), (F.floor(x * 10) % 10).cast("string"))
    told = [F.concat(F.lit(f"{name}="), tenth(F.coalesce(x, F.lit(0.0)))) for name, x in numbers]
    rest = [F.concat(F.lit("persons=["), F.array_join(F.sort_array(people), ","), F.lit("]")), F.concat(F.lit("hard_issues=["), F.when(F.size(issues) > 0, F.array_join(issues, ",")).otherwise("none"), F.lit("]"))]
    return F.concat(F.lit("Photo "), key.cast("string"), F.lit(": "), F.concat_ws(", ", *told, *rest))


def group_prompts(facts: DataFrame, group: str, order: str, line: str, head: Column) -> DataFrame:
    """(group, prompt): the head and the group's fact lines in order; review groups have tens of rows."""
    lines = F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda x: x[line])
    return facts.groupBy(group).agg(lines.alias("_l")).select(group, F.concat(head, F.lit("\n"), F.array_join("_l", "\n")).alias("prompt"))


# ---- disagreements and protection
def eye_disagreements(photos: DataFrame, group: str) -> DataFrame:
    """One row: how far eye evidence explains that a group's winner isn't its manual choice.

    photos: group, rank, name, manual, closed (a decisive closed eye), uncertain (a face with unsure eyes), eye (score,
    72 where unknown), eye_issue. The winner and the manual choice are the first by rank, then name without case.
    """
    facts = F.struct("manual", "closed", "uncertain", F.coalesce("eye", F.lit(72.0)).alias("eye"), "eye_issue")
    order = F.struct(F.coalesce("rank", F.lit(10**9)).alias("r"), F.lower("name").alias("n"))
    manual = F.col("manual")
    per = photos.groupBy(group).agg(F.min_by(facts, order).alias("w"), F.min_by(F.when(manual, facts), F.when(manual, order)).alias("m"), F.count_if(manual & F.col("closed")).alias("c"), F.count_if(manual & F.col("uncertain")).alias("u"))
    w, m = F.col("w"), F.col("m")
    differs = F.coalesce(m.isNotNull() & ~w["manual"], F.lit(False))
    by_eye = m["closed"] | m["uncertain"] | (F.abs(w["eye"] - m["eye"]) >= 8.0) | m["eye_issue"] | w["eye_issue"]
    counts = per.agg(F.sum("c").alias("manual_with_decisive_closed"), F.sum("u").alias("manual_with_uncertain_eye"), F.count_if(differs).alias("top1_disagreements"), F.count_if(differs & by_eye).alias("eye_related_top1_disagreements"))
    rate = F.when(F.col("top1_disagreements") > 0, F.bround(F.col("eye_related_top1_disagreements") / F.col("top1_disagreements"), 4)).otherwise(0.0)
    return counts.withColumn("eye_related_disagreement_rate", rate)


def protected(photos: DataFrame, picks: DataFrame, key: str) -> DataFrame:
    """photos with the picks of coverage turned to selected: category, original_category, protected, reason."""
    marked = photos.join(picks.select(key).distinct().withColumn("_p", F.lit(True)), key, "left")
    use = F.coalesce("_p", F.lit(False)) & (F.col("category") != "selected")
    kept = [F.col(c) for c in photos.columns if c != "category"]
    return marked.select(*kept, F.when(use, "selected").otherwise(F.col("category")).alias("category"), F.col("category").alias("original_category"), use.alias("protected"), F.when(use, "person_stage_gap").alias("reason"))


def protected_counts(rows: DataFrame) -> DataFrame:
    """Protected rows by original category, and how many of them have issues."""
    return rows.filter("protected").groupBy("original_category").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.size("issues") > 0).alias("with_issues"))


def group_confidence(rows: DataFrame, group: str, total: str) -> DataFrame:
    """Mean of the evidence that a group accepted, 1 where there is none."""
    return rows.groupBy(group).agg(F.coalesce(F.avg(total), F.lit(1.0)).alias("confidence"))


# ---- views
def face_page(faces: DataFrame, order: list[Column], size: int, who: str = "all", person: Column | None = None) -> DataFrame:
    """Faces with their page (from 1) of `size` rows: all, those of no person, or those that `person` names."""
    kept = faces if who == "all" else faces.filter(F.col("person").isNull() if who == "unknown" else person)
    return numbered(kept, order, "_n").withColumn("page", F.floor((F.col("_n") - 1) / size) + 1).drop("_n")


def progress(elapsed: Column, processed: Column, total: Column) -> list[Column]:
    """elapsed_seconds (one place) and eta_seconds, null before the first row is done."""
    return [F.bround(elapsed, 1).alias("elapsed_seconds"), F.when((processed > 0) & (total > 0), F.bround(elapsed / processed * (total - processed)).cast("long")).alias("eta_seconds")]


def queue_depths(listing: DataFrame, path: str) -> DataFrame:
    """Files of each folder of a queue."""
    return listing.groupBy(F.element_at(F.split(path, "/"), -2).alias("folder")).agg(F.count(F.lit(1)).alias("files"))


def delivered_folders(rows: DataFrame, path: str) -> DataFrame:
    """The distinct parent folders of delivered rows, and their rows."""
    parent = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return rows.groupBy(parent.alias("folder")).agg(F.count(F.lit(1)).alias("rows"))


# ---- models
#: The features of the preference model, in order.
PREFERENCE_FEATURES = (
    "sharpness_score", "motion_blur_score", "exposure_score", "contrast_score", "noise_score", "composition_score", "face_quality_score", "min_face_score", "face_sharpness_score",
    "eye_sharpness_score", "eye_score", "expression_score", "technical_score", "generic_group_score", "group_relative_score", "group_quality_percentile", "group_size", "relative_face_quality",
    "relative_eye", "relative_motion", "relative_exposure", "relative_composition", "bad_face_count", "face_count", "largest_face_ratio", "mean_occlusion_risk", "mean_abs_yaw", "mean_smile_score", "portrait_present",
)


def preference_vector(photos: DataFrame, faces: DataFrame, key: str) -> DataFrame:
    """(key, x): the preference features of each photo; faces: key, quality (it counts), area, occlusion, yaw, smile."""
    q = F.col("quality")
    mean = lambda c: F.coalesce(F.avg(F.when(q, c)), F.lit(0.0))
    own = faces.groupBy(key).agg(
        F.count(F.lit(1)).cast("double").alias("face_count"), (F.coalesce(F.max(F.when(q, F.col("area"))), F.lit(0.0)) * 1000).alias("largest_face_ratio"), (mean(F.col("occlusion")) * 100).alias("mean_occlusion_risk"),
        mean(F.abs("yaw")).alias("mean_abs_yaw"), mean(F.col("smile")).alias("mean_smile_score"), F.bool_or(q).cast("double").alias("portrait_present"),
    )
    held = photos.join(own, key, "left")
    value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f in held.columns else F.lit(0.0)
    return held.select(key, F.array(*map(value, PREFERENCE_FEATURES)).alias("x"))


def blend_curve(rows: DataFrame, group: str, generic: str, learned: str, positive: Column, key: str, steps: int = 12) -> DataFrame:
    """(weight, groups, top1, pairwise, utility) of generic blended with learned at 0 and 0.05 to 0.60.

    Groups with both kinds count. top1: the first by score, then key, is positive; pairwise: the share of pairs in right order by ranks (ties half).
    """
    weights = F.explode(F.array(F.lit(0.0), *[F.lit(round(0.05 + 0.55 * k / (steps - 1), 4)) for k in range(steps)])).alias("weight")
    scored = rows.select(F.col(group).alias("g"), F.col(key).alias("k"), positive.cast("int").alias("y"), generic, learned, weights)
    scored = scored.select("g", "k", "y", "weight", F.round((1 - F.col("weight")) * F.col(generic) + F.col("weight") * 100 * F.col(learned), 9).alias("s"))
    w = Window.partitionBy("weight", "g")
    placed = scored.select("*", F.rank().over(w.orderBy("s")).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("weight", "g", "s")).alias("t"))
    per = placed.groupBy("weight", "g").agg(
        F.sum("y").alias("p"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("y") == 1, F.col("r") + (F.col("t") - 1) / 2)).alias("ranks"), F.min_by("y", F.struct(-F.col("s"), F.col("k"))).alias("first")
    )
    per = per.filter("p > 0 and p < n").select("weight", "first", (F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2).alias("right"), (F.col("p") * (F.col("n") - F.col("p"))).alias("pairs"))
    out = per.groupBy("weight").agg(F.count(F.lit(1)).alias("groups"), F.bround(F.avg(F.col("first").cast("double")), 6).alias("top1"), F.bround(F.sum("right") / F.sum("pairs"), 6).alias("pairwise"))
    return out.withColumn("utility", F.bround(F.col("top1") + F.col("pairwise"), 6))


def chosen_blend(curve: DataFrame) -> DataFrame:
    """One row: the least weight of the largest utility, its uplift over weight 0 and whether it may be used.

    validated: 20 groups or more, pairwise of 0.54 or more, and an uplift of 0.02 at the top or of 0.025 pairwise.
    """
    best = curve.agg(F.max_by(F.struct("weight", "groups", "top1", "pairwise"), F.struct("utility", -F.col("weight"))).alias("b"), F.max(F.when(F.col("weight") == 0, F.struct("top1", "pairwise"))).alias("z"))
    b, z = F.col("b"), F.col("z")
    up1, up2 = F.bround(b["top1"] - z["top1"], 6), F.bround(b["pairwise"] - z["pairwise"], 6)
    sound = (b["groups"] >= 20) & (b["pairwise"] >= 0.54) & ((up1 >= 0.02) | (up2 >= 0.025)) & (b["weight"] > 0)
    strength = F.when(sound, F.least(F.lit(1.0), F.greatest(F.lit(0.2), F.greatest(up1, up2) / 0.12))).otherwise(0.0)
    return best.select(F.when(sound, b["weight"]).otherwise(0.0).alias("weight"), b["top1"].alias("top1"), b["pairwise"].alias("pairwise"), up1.alias("top1_uplift"), up2.alias("pairwise_uplift"), sound.alias("validated"), F.bround(strength, 4).alias("strength"))


def filter_gate(objective: Column, auc: Column, f1: Column, positive_rate: Column) -> Column:
    """Whether a pointwise model may reject rows: AUC of 0.62 and F1 0.04 above calling everything positive."""
    return (objective == "pointwise") & (auc >= 0.62) & (f1 - 2 * positive_rate / (1 + positive_rate) >= 0.04)


def coefficient_report(weights: DataFrame, feature: str, weight: str) -> DataFrame:
    """Features with place (from 1) by size of weight, then name; a model has tens of them."""
    order = Window.orderBy(F.desc(F.abs(F.col(weight))), F.col(feature))  # one row a feature
    return weights.select(feature, F.round(weight, 6).alias("weight"), F.row_number().over(order).cast("long").alias("place"))


def training_set(cached: DataFrame, listing: DataFrame, labels: DataFrame, part: str, key: str, stem: str) -> DataFrame:
    """(part, listed, cached, labelled, positive, coverage): what a training set from cached features has of a listing.

    cached: key and signature of features; listing: part, key, signature, stem; labels: stem. A cached row counts where
    its signature is the listing's.
    """
    held = listing.join(cached.select(key, F.col("signature").alias("_s")), key, "left").join(labels.select(stem).distinct().withColumn("_y", F.lit(True)), stem, "left")
    valid = F.coalesce(F.col("_s") == F.col("signature"), F.lit(False))
    hit = F.coalesce("_y", F.lit(False))
    return held.groupBy(part).agg(F.count(F.lit(1)).alias("listed"), F.count_if(valid).alias("cached"), F.count_if(hit).alias("labelled"), F.count_if(valid & hit).alias("positive"), F.bround(F.avg(valid.cast("double")), 6).alias("coverage"))


# ---- overrides and operations
def group_resync(rows: DataFrame, group: str, key: str, stars: str, rank: str) -> DataFrame:
    """(group, best, delivered, summary) after overrides: the best row by stars, then rank, then key, and the counts that follow."""
    best = F.min_by(F.col(key), F.struct(-F.col(stars), F.col(rank), F.col(key)))
    counts = F.array(*[F.count_if(F.col(stars) == k) for k in range(4)])
    return rows.groupBy(group).agg(best.alias("best"), F.count_if(F.col(stars) >= 2).alias("delivered"), F.array_join(counts.cast("array<string>"), "/").alias("summary"))


def checked_changes(current: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """current with changes (key, expected_revision, value) that name its revision; the others are conflicts.

    (key, value, revision, outcome): applied changes raise the revision by one; rows without a change keep theirs.
    """
    new = changes.select(key, "expected_revision", F.col("value").alias("_v"))
    held = current.join(new, key, "left")
    fits = F.coalesce(F.col("expected_revision") == F.col("revision"), F.lit(False))
    outcome = F.when(F.col("expected_revision").isNull(), "kept").when(fits, "applied").otherwise("conflict")
    return held.select(key, F.when(fits, F.col("_v")).otherwise(F.col("value")).alias("value"), (F.col("revision") + fits.cast("int")).alias("revision"), outcome.alias("outcome"))


def leading_receipt(receipts: DataFrame, operation: str) -> DataFrame:
    """Each operation's receipt that counts: execute before preflight, then the last revision."""
    order = F.struct((F.col("kind") == "execute").cast("int"), F.col("revision"))
    return receipts.filter(F.col("kind").isin("execute", "preflight")).groupBy(operation).agg(F.max_by(F.struct("kind", "revision", "status"), order).alias("r")).select(operation, "r.*")


def journal_progress(journal: DataFrame, operation: str, item: str, revision: str) -> DataFrame:
    """(operation, revision, done, failed): distinct items verified and failed up to each journal revision, an item's last entry counting."""
    w = Window.partitionBy(operation, item).orderBy(revision)
    one = lambda c: F.when(c, 1).otherwise(0)
    steps = journal.select(operation, revision, *[(one(F.col("state") == s) - F.lag(one(F.col("state") == s), 1, 0).over(w)).alias(s) for s in ("verified", "failed")])
    by = steps.groupBy(operation, revision).agg(F.sum("verified").alias("v"), F.sum("failed").alias("f"))
    upto = Window.partitionBy(operation).orderBy(revision)
    return by.select(operation, revision, F.sum("v").over(upto).alias("done"), F.sum("f").over(upto).alias("failed"))
