"""Queries: names and ids, vectors and duplicates, evaluation, models, delivery, state machines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names, vectors
from ..operators import corrections, delivery, evaluate, folds, model, pairs, ranking
from ..sources import files, store
from ..streaming import operations
from . import proxies as P
from .proxies import read, with_


# ---- names, ids, sources
def entity_ids(spark, sf):
    d = read(spark, sf, "documents")
    e = names.entity_id(F.concat_ws("/", "source", F.col("doc_id").cast("string")), F.col("n_chars"), F.col("doc_id") * 1000)
    return d.select("doc_id", e.alias("entity_id"), names.cache_key(e, F.concat_ws("|", "lang", F.lit("v1"))).alias("cache_key"))


def file_names(spark, sf):
    p = read(spark, sf, "part").select("p_partkey", F.concat_ws("", F.lit("Shoot "), F.col("p_brand"), F.lit("/IMG_"), F.lpad(F.col("p_partkey").cast("string"), 5, "0"), F.when(F.col("p_size") % 2 == 0, F.lit(".CR2")).otherwise(F.lit(".jpg"))).alias("path"))
    n = F.col("path")
    return p.select("p_partkey", names.stem(n).alias("stem"), names.suffix(n).alias("suffix"), names.top_folder(n).alias("top"), names.file_sequence(names.stem(n)).alias("sequence"), names.safe_relative(n).alias("safe"))


def companion_anti_join(spark, sf):
    o = read(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("d"), F.col("o_custkey").cast("string"), F.lit("/F"), (F.col("o_orderkey") % 40).cast("string"), F.when(F.col("o_orderstatus") == "O", F.lit(".NEF")).otherwise(F.lit(".JPG"))).alias("path"))
    return files.without_companions(o).select("o_orderkey", "path")


def raw_previews(spark, sf):
    o = read(spark, sf, "orders").select(F.concat(F.lit("d"), F.col("o_custkey").cast("string"), F.lit("/F"), (F.col("o_orderkey") % 40).cast("string"), F.when(F.col("o_orderstatus") == "O", F.lit(".nef")).otherwise(F.lit(".jpg"))).alias("path")).distinct()
    return files.raw_previews(o)


def dominant_signature(spark, sf):
    d = read(spark, sf, "documents").select(F.col("source").alias("source_path"), F.col("lang").alias("pipeline_signature"), F.col("doc_id").alias("updated"))
    return store.dominant_signature(d, "src").select("pipeline_signature", "n", "last")


def latest_revision(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", "role", F.concat(F.col("conv_id").cast("string"), F.lit("."), F.lpad(F.col("turn").cast("string"), 8, "0"), F.lit(".json")).alias("name"))
    return store.last_revisions(c).select("operation", F.col("revision").cast("long").alias("revision"), "role")


def latest_by_key(spark, sf):
    return corrections.latest(P.photos(spark, sf).select("grp", "us", "id", "status"), "grp", ["us", "id"])


def set_hash(spark, sf):
    """The hash of the whole export plan, whatever its order."""
    return delivery.plan_hash(export_plan(spark, sf))


# ---- vectors and duplicates
def cosine_pairs(spark, sf):
    """All pairs of each label, in blocks."""
    found = pairs.cosine_pairs(read(spark, sf, "embeddings").filter("label is not null"), "label", "vec_id", "embedding", 0.3)
    return found.select("l", "r", F.round("c", 5).alias("cosine"))


def nearest_two_centroids(spark, sf):
    e = read(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    mean = e.select("label", F.posexplode("embedding").alias("k", "v")).groupBy("label", "k").agg(F.avg(F.col("v").cast("double")).alias("v")).groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("c"))
    # class means in blocks of 256: a vector meets every block by an equi-join, and its two best of each block are merged
    blocks = max(1, -(-mean.count() // 256))
    block = F.pmod(F.xxhash64("label"), F.lit(blocks)).cast("int").alias("b")
    packed = mean.select("label", "c", block).groupBy("b").agg(F.collect_list(F.struct("label", "c")).alias("cs"))
    asked = e.select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")).join(packed, "b")
    best = lambda a: F.slice(F.sort_array(a, asc=False), 1, 2)
    two = asked.select("vec_id", best(F.transform("cs", lambda s: F.struct(F.round(vectors.dot(F.col("embedding"), s["c"]), 6).alias("s"), (-s["label"]).alias("n")))).alias("s"))
    scored = two.groupBy("vec_id").agg(best(F.flatten(F.collect_list("s"))).alias("s"))
    return scored.select("vec_id", (-F.col("s")[0]["n"]).alias("best"), F.col("s")[0]["s"].alias("score"), F.round(F.col("s")[0]["s"] - F.get("s", F.lit(1))["s"], 6).alias("margin"))


def vector_norms(spark, sf):
    e = read(spark, sf, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 5).alias("norm"), F.round(vectors.dot(vectors.unit(F.col("embedding")), F.col("embedding")), 5).alias("self"))


def near_duplicate_pairs(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.floor(F.col("doc_id") / 4).alias("tb"), vectors.hash_from_hex(F.substring(F.sha2("text", 256), 1, 16)).alias("ph"), F.md5("text").alias("fp"))
    found = pairs.blocked_pairs(d, "doc_id", [(F.array("fp"), F.array("fp")), (F.array(F.col("tb").cast("string")), F.transform(pairs.neighbours(F.col("tb")), lambda x: x.cast("string")))])
    h = d.select("doc_id", "ph")
    both = found.join(h.select(F.col("doc_id").alias("left"), F.col("ph").alias("a")), "left").join(h.select(F.col("doc_id").alias("right"), F.col("ph").alias("b")), "right")
    return both.select("left", "right", F.round(vectors.hash_similarity(F.col("a"), F.col("b")), 6).alias("similarity")).filter("similarity >= 0.6")


def fingerprint_clusters(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", F.sha2("text", 256).alias("fp"))
    by = d.groupBy("fp").agg(F.min_by("source", F.when(F.col("source").isNotNull(), F.col("doc_id"))).alias("owner"), F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("members"))
    numbered = ranking.ranked(by, ["owner"], [F.col("first")], name="number")
    return numbered.select(F.concat("owner", F.format_string(":strict-%04d", F.col("number"))).alias("cluster"), "first", "members")


def duplicate_leaks(spark, sf):
    return evaluate.duplicate_leaks(read(spark, sf, "documents").select(F.sha2("text", 256).alias("c")), "c")


def strict_clusters(spark, sf):
    r = P.in_sessions(spark, sf).select("event_id", "t", F.concat_ws("-", F.col("user_id").cast("string"), F.col("session").cast("string")).alias("part"))
    near = pairs.range_join(r, r, "t", 1800.0, ["part"]).filter("l_event_id < r_event_id").select(F.col("l_event_id").alias("left"), F.col("r_event_id").alias("right"))
    return folds.complete_link(r, near, "part", "event_id", ["t"])


def beats(spark, sf):
    r = P.in_sessions(spark, sf).select("event_id", "t", F.concat_ws("-", F.col("user_id").cast("string"), F.col("session").cast("string")).alias("part"))
    near = pairs.range_join(r, r, "t", 3600.0, ["part"]).filter("l_event_id != r_event_id").select(F.col("l_event_id").alias("left"), F.col("r_event_id").alias("right"))
    return folds.beats(r, near, "part", "event_id", ["t"])


def online_groups(spark, sf):
    from ..config import preset

    p = preset("aggressive")
    rows = folds.islands(P.records(spark, sf).select("event_id", "user_id", "t", F.col("value").alias("score")), "user_id", "t", 48.0, "event_id")
    rows = rows.select("event_id", F.concat_ws("-", F.col("user_id").cast("string"), F.col("island").cast("string")).alias("part"), "t", "score")
    near = pairs.range_join(rows, rows, "t", 48.0, ["part"]).filter("l_event_id < r_event_id")
    like = 1 - F.abs(F.col("l_score") - F.col("r_score")) / 200
    time = F.exp(-F.abs(F.col("l_t") - F.col("r_t")) / 18)
    ev = near.select(F.col("l_event_id").alias("left"), F.col("r_event_id").alias("right"), like.alias("total"), like.alias("scene"), (like >= 0.99).alias("strong"), F.lit(True).alias("compatible"), time.alias("time"), F.lit(0).alias("shared"), F.lit(None).cast("double").alias("pose"))
    return folds.online_groups(rows, pairs.group_rules(ev, p), "part", "event_id", ["t"], p)


def identity_clusters(spark, sf):
    e = read(spark, sf, "embeddings").select("label", "vec_id", (F.col("vec_id") % 400).alias("photo"), "embedding", (F.col("vec_id") % 7).alias("strength"), (F.col("vec_id") % 3 != 0).alias("seed"))
    return folds.identities(e, "label", "photo", "vec_id", "embedding", "strength", "seed", threshold=0.30)


# ---- labels
def label_join(spark, sf):
    return evaluate.group_hits(P.labelled(spark, sf), "source", F.col("score") >= 0.4, F.col("good"))


def unmatched_labels(spark, sf):
    d, x = read(spark, sf, "documents"), read(spark, sf, "labels")
    return d.join(x, "doc_id", "left_anti").groupBy("lang").agg(F.count(F.lit(1)).alias("unlabelled"))


def single_label_groups(spark, sf):
    x = P.labelled(spark, sf).filter("toxic")
    return x.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).filter("n = 1").select("source", "lang", "doc_id")


def confusion_metrics(spark, sf):
    return evaluate.rates(P.labelled(spark, sf).groupBy("lang").agg(*evaluate.confusion(F.col("score") >= 0.4, F.col("good"))))


def ranking_metrics(spark, sf):
    rows = ranking.ranked(P.labelled(spark, sf), ["source"], [F.desc("score"), F.col("doc_id")])
    return evaluate.ranking_metrics(rows, "source", "rank", F.col("toxic"))


def grouping_summary(spark, sf):
    return evaluate.grouping_summary(P.photos(spark, sf).groupBy("grp").agg(F.count(F.lit(1)).alias("size")), "size")


def micro_average(spark, sf):
    per = P.labelled(spark, sf).groupBy("source").agg(*evaluate.confusion(F.col("score") >= 0.4, F.col("good")), F.when(F.count(F.lit(1)) > 5, F.count_if("toxic") < 100).alias("ok"))
    return evaluate.micro_average(per)


def gate_checks(spark, sf):
    per = lambda cut: P.labelled(spark, sf).groupBy("source").agg(F.bround(F.avg(((F.col("score") >= cut) == F.col("good")).cast("double")), 6).alias("top1"), F.bround(F.avg(((F.col("score") >= cut) & ~F.col("toxic")).cast("double")), 6).alias("safety"))
    return evaluate.gates(per(0.5), per(0.3), "source")


def roc_auc(spark, sf):
    return evaluate.roc_auc(P.labelled(spark, sf), "score", F.col("good"))


def pairwise_accuracy(spark, sf):
    return evaluate.pairwise_accuracy(P.labelled(spark, sf), "source", "score", F.col("good"))


def threshold_sweep(spark, sf):
    return evaluate.threshold_sweep(P.labelled(spark, sf), "score", F.col("good")).select("threshold", "tp", "fp", "fn", "tn", "precision", "recall", "f1")


def pair_audit(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("c"))
    p = read(spark, sf, "labels").select(F.col("doc_id").alias("left_id"), (F.col("doc_id") + 1).alias("right_id"), (F.col("quality") == 0).alias("duplicate"))
    return evaluate.pair_audit(p, d, "doc_id", "c")


def set_ops_eval(spark, sf):
    d = read(spark, sf, "documents").filter("n_chars >= 1500").select("doc_id")
    x = read(spark, sf, "labels").filter("quality = 1").select("doc_id")
    tag = lambda df, name: df.select(F.lit(name).alias("kind"), "doc_id")
    return tag(d.intersect(x), "both").union(tag(d.subtract(x), "predicted")).union(tag(x.subtract(d), "expected")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


def star_summary(spark, sf):
    s = F.floor(F.col("score") / 26).cast("int")
    return P.photos(spark, sf).agg(F.count(F.lit(1)).alias("photos"), *[F.count_if(s == k).alias(f"stars{k}") for k in range(4)], F.countDistinct("grp").alias("groups"), F.count_if(s >= 2).alias("delivered"), F.round(1 - F.count_if(s >= 2) / F.count(F.lit(1)), 6).alias("reduction"))


# ---- models
_W = ([20.0, 100.0, 0.5], [10.0, 50.0, 0.25], [0.4, -0.3, 0.8], 0.1)


def logistic_score(spark, sf):
    f = P.faces(spark, sf).groupBy("photo").agg(F.max("sharp").alias("a"), F.sum("sharp").alias("b"), F.avg("occlusion").alias("c"))
    return f.select("photo", F.round(model.logistic([F.col("a"), F.col("b"), F.col("c")], *_W), 6).alias("p"))


def hash_split(spark, sf):
    return read(spark, sf, "documents").select("doc_id", model.hash_split(F.col("doc_id"), "v1", 0.8, 0.1).alias("part"))


def score_join(spark, sf):
    d = P.labelled(spark, sf).select("doc_id", "source")
    x = read(spark, sf, "labels").filter("doc_id % 50 != 7").select("doc_id", "quality")
    held = d.join(x, "doc_id", "left")
    return held.groupBy("source").agg(F.bool_and(F.col("quality").isNotNull()).alias("complete"), F.count("quality").alias("scores"))


def training_records(spark, sf):
    """A record of all turns and texts of each conversation."""
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
    return c.select("conv_id", F.size("turns").cast("long").alias("turns"), F.sha2(model.conversation_record(F.col("turns")), 256).alias("record"))


def cv_folds(spark, sf):
    return model.cv_folds(P.labelled(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "n", 5)


def hardest_negatives(spark, sf):
    rows = ranking.ranked(P.labelled(spark, sf), ["source"], [F.desc("score"), F.col("doc_id")])
    return model.hardest_negatives(rows, "source", F.col("good"), "rank", "score", "lang", 3).select("source", "doc_id", F.col("hardness").cast("long").alias("hardness"))


def sound_decisions(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.col("turn").cast("int"))).alias("t"))
    ids = F.transform("t", lambda x: x.cast("string"))
    ranks = F.transform("t", lambda x: x + 1)
    return c.select("conv_id", model.sound_decision(ids, ranks, F.lit("0"), F.array().cast("array<string>"), ids).alias("sound"))


def fitted_preference(spark, sf):
    rows = P.labelled(spark, sf).select("doc_id", "source", "score", F.length("source").cast("double").alias("len"), F.col("good").cast("double").alias("label"))
    m = model.fit_pointwise(rows, ["score", "len"], "label")
    w = m.coefficients
    return rows.select("doc_id", F.round(1 / (1 + F.exp(-(F.col("score") * float(w[0]) + F.col("len") * float(w[1]) + float(m.intercept)))), 3).alias("p"))


# ---- delivery
def export_plan(spark, sf):
    p = P.photos(spark, sf).select("id", F.floor(F.col("score") / 26).cast("int").alias("stars"), F.concat(F.lit("G"), F.col("grp").cast("string"), F.lit("/"), (F.col("id") % 500).cast("string")).alias("path"))
    f = P.photos(spark, sf).filter("id % 17 != 0").select("id", F.sha2(F.col("id").cast("string"), 256).alias("sha"))
    e = p.filter("id % 23 = 0").groupBy(F.lower("path").alias("target")).agg(F.sha2(F.min("id").cast("string"), 256).alias("sha"))
    return delivery.export_plan(p, f, e, 2).select("id", "stars", "path", "action")


def plan_counts(spark, sf):
    return export_plan(spark, sf).groupBy("stars").pivot("action", ["copy", "skip", "conflict", "invalid"]).agg(F.count(F.lit(1))).fillna(0)


def cdc_classify(spark, sf):
    plan = P.photos(spark, sf).select("id", F.when(F.col("id") % 31 != 0, F.floor(F.col("score") / 20).cast("int")).alias("target_rating"))
    live = P.photos(spark, sf).filter("id % 5 != 0").select("id", (F.col("id") % 6).cast("int").alias("rating"))
    return delivery.classify_changes(plan, live, "id")


def action_counts(spark, sf):
    return delivery.action_counts(cdc_classify(spark, sf))


def receipt_reconcile(spark, sf):
    m = P.photos(spark, sf).filter("id % 7 != 0").select("id", F.lit(3).alias("target_rating"))
    r = P.photos(spark, sf).filter("id % 11 != 0").select("id", F.when(F.col("id") % 13 == 0, 2).otherwise(3).alias("final_rating"))
    return delivery.reconcile(m, r, "id")


def drift_check(spark, sf):
    o = P.photos(spark, sf)
    plan = o.select("id", F.col("grp").alias("size"), (F.col("us") * 1000).alias("modified"), F.lit(1).alias("baseline"))
    live = o.filter("id % 9 != 0").select("id", F.when(F.col("id") % 8 == 0, 0).otherwise(F.col("grp")).alias("size"), F.when(F.col("id") % 10 == 0, F.lit(0)).otherwise(F.col("us") * 1000 + 5).alias("modified"), F.when(F.col("id") % 3 == 0, 1).otherwise(2).alias("rating"))
    return delivery.drift(plan, live, "id")


def pending_items(spark, sf):
    j = P.photos(spark, sf).select("id", (F.col("id") % 2 == 0).alias("verified"))
    return delivery.pending(cdc_classify(spark, sf), j, "id", "update").select("id", "target_rating")


def rollback_items(spark, sf):
    r = P.photos(spark, sf).select("id", F.lit(1).alias("previous_rating"), F.lit(3).alias("final_rating"))
    live = P.photos(spark, sf).select("id", F.when(F.col("id") % 3 == 0, 3).otherwise(4).alias("rating"))
    return delivery.rollback(r, live, "id")


def corrections_replay(spark, sf):
    x = read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("photo"), F.col("l_linenumber").cast("long").alias("face_index")).agg(F.max("l_quantity").alias("q"), F.min("l_suppkey").cast("string").alias("person"))
    box = lambda shift: F.struct((F.col("q") % 9).cast("double").alias("x1"), F.lit(0.0).alias("y1"), (F.col("q") % 9 + 5 + shift).cast("double").alias("x2"), F.lit(5.0).alias("y2"))
    faces = x.select("photo", "face_index", box(0).alias("box"), "person")
    anchors = x.filter("photo % 4 = 0 and face_index <= 2").select("photo", F.col("face_index").alias("anchor"), box(1).alias("box"), F.concat(F.lit("fixed-"), F.col("person")).alias("person"))
    return corrections.replay(faces, anchors).select("photo", "face_index", "person", "warning")


def merged_people(spark, sf):
    f = P.faces(spark, sf).select("photo", "person").distinct()
    m = f.select("person").distinct().filter("person % 5 = 1").select("person", (F.col("person") - 1).alias("new_person"))
    return corrections.relabel(f, m).groupBy("person").agg(F.countDistinct("photo").alias("photos"))


def face_moments(spark, sf):
    f = P.faces(spark, sf).groupBy("photo", "person").agg(F.max("sharp").alias("s"), F.max("occlusion").alias("o"))
    faces = f.select("photo", F.lit(0).alias("face_index"), "person", F.lit(0.9).alias("confidence"), F.when(F.col("o") < 0.4, "Open").otherwise("Closed").alias("eyes"), F.lit("calm").alias("expression"), F.lit(0.5).alias("expression_confidence"), F.col("o").alias("yaw"), F.lit(0.0).alias("pitch"))
    two = P.photos(spark, sf).select("grp", "id").groupBy("grp").agg(F.min("id").alias("left"), F.max("id").alias("right")).filter("left < right").select("left", "right")
    return pairs.changed_faces(two, faces)


# ---- state
def state_machine(spark, sf):
    e = P.records(spark, sf)
    names_ = F.array(*[F.lit(x) for x in ("submit", "claim", "receipt", "confirm", "progress", "fail", "retry")])
    return operations.final_states(e.select("user_id", "t", "event_id", F.element_at(names_, (F.col("event_id") % 7 + 1).cast("int")).alias("event")), "user_id", ["t", "event_id"], "event")


def activity_sessions(spark, sf):
    a = operations.activity(read(spark, sf, "events"), "ts", "user_id", "3 hours")
    return a.select("user_id", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"), "rows")


_RATE = lambda n, d: f"coalesce(round_even(({n}) / nullif(({d})::double, 0), 4), 0.0)"
_RATES = f"{_RATE('tp', 'tp + fp')} as precision, {_RATE('tp', 'tp + fn')} as recall, {_RATE('2 * tp', '2 * tp + fp + fn')} as f1, {_RATE('tp + tn', 'tp + fp + fn + tn')} as accuracy"
_CONF = "count(*) filter (where p and e) as tp, count(*) filter (where p and not e) as fp, count(*) filter (where not p and e) as fn, count(*) filter (where not p and not e) as tn"
_PLAN = with_("photos") + """, p as (select id, cast(floor(score / 26) as int) as stars, 'G' || grp || '/' || (id % 500) as path from photos), e as (select lower(path) as target, sha256(min(id)::varchar) as sha from p where id % 23 = 0 group by 1),
k as (select p.*, row_number() over (partition by lower(path) order by stars desc, path, id) as n from p where stars >= 2),
plan as (select k.id, k.stars, k.path, case when k.id % 17 = 0 then 'invalid' when k.n > 1 then 'conflict' when e.sha is null then 'copy' when e.sha = sha256(k.id::varchar) then 'skip' else 'conflict' end as action from k left join e on e.target = lower(k.path))"""
_CDC = with_("photos") + """, c as (select p.id, case when p.id % 31 != 0 then cast(floor(p.score / 20) as int) end as target_rating, case when p.id % 5 != 0 then cast(p.id % 6 as int) end as previous from photos p),
cdc as (select *, case when target_rating is null then 'invalid' when previous is null then 'new' when previous > 3 then 'protected' when previous = target_rating then 'unchanged' else 'update' end as action from c)"""

SET_HASH = _PLAN + """, d as (select sha256(to_json(struct_pack(action := action, id := id, path := path, stars := stars))::varchar) as d from plan),
parts as (select d[1:2] as p, sha256(string_agg(d, '' order by d)) as h, count(*) as n from d group by 1) select coalesce(sum(n), 0)::bigint as items, sha256(string_agg(p || h, '' order by p || h)) as plan_hash from parts"""
#: Complete link as recursion over the place in a session, all sessions at once; clusters is a list of lists.
STRICT = with_("records", "sess").replace("with ", "with recursive ", 1) + """, e as (select event_id, user_id || '-' || session as part, t, row_number() over (partition by user_id, session order by t, event_id) as n from sess),
l as (select a.part, a.event_id, a.n, coalesce(list(b.event_id) filter (where b.event_id is not null), []) as near from e a left join e b on a.part = b.part and b.n < a.n and abs(a.t - b.t) <= 1800 group by 1, 2, 3),
r as (select distinct part, null::bigint as event_id, 0::bigint as n, 0::bigint as cluster, []::bigint[][] as clusters from e
 union all select r.part, l.event_id, l.n, coalesce(nullif(home, 0), len(clusters) + 1)::bigint,
  case when home > 0 then list_transform(clusters, lambda c, i: case when i = home then list_append(c, l.event_id) else c end) else list_append(clusters, [l.event_id]) end
  from r join l on l.part = r.part and l.n = r.n + 1, lateral (select coalesce(list_position(list_transform(clusters, lambda c: list_has_all(l.near, c)), true), 0) as home))
select part, event_id, cluster from r where n > 0"""
#: Incremental identities as recursion over the place in a label, all labels at once; sums and photos are lists a centroid.
IDENTITIES = """with recursive x as (select label, vec_id, vec_id % 400 as photo, vec_id % 3 <> 0 as seed, vec_id % 7 as strength, embedding::double[] as e from embeddings),
l as (select label, vec_id, photo, seed, list_transform(e, lambda y: y / sqrt(list_dot_product(e, e))) as v, row_number() over (partition by label order by seed desc, strength desc, photo, vec_id) as n from x),
r as (select distinct label, null::bigint as vec_id, 0::bigint as n, 0::bigint as identity, []::double[][] as sums, []::bigint[][] as photos from x
 union all select label, vec_id, n, case when sure then place when fresh then len(sums) + 1 else 0 end,
  case when sure and seed then list_transform(sums, lambda s, i: case when i = place then list_transform(s, lambda y, j: y + v[j]) else s end) when fresh then list_append(sums, v) else sums end,
  case when sure then list_transform(photos, lambda s, i: case when i = place then list_append(s, photo) else s end) when fresh then list_append(photos, [photo]) else photos end
 from (select *, coalesce(best >= (case when seed then 0.30::double else 0.55::double end) and (second is null or best - second >= (case when seed then 0.025::double else 0.05::double end)), false) as sure, seed and coalesce(best < 0.30::double, true) as fresh from (
  select *, list_position(scores, best) as place, list_max(list_filter(scores, lambda y, i: i <> list_position(scores, best))) as second from (
   select *, list_max(scores) as best from (
    select r.label, l.vec_id, l.n, l.photo, l.seed, l.v, r.sums, r.photos,
     list_transform(r.sums, lambda s, i: case when list_contains(r.photos[i], l.photo) then '-infinity'::double else list_dot_product(s, l.v) / sqrt(list_dot_product(s, s)) end) as scores
    from r join l on l.label = r.label and l.n = r.n + 1)))))
select label, vec_id, identity from r where n > 0"""
SQLS = {
    "entity_ids": "with e as (select doc_id, lang, sha256(source || '/' || doc_id || '|' || n_chars || '|' || (doc_id * 1000))[1:24] as entity_id from documents) select doc_id, entity_id, entity_id || ':' || sha256(lang || '|v1')[1:16] as cache_key from e",
    "file_names": "with p as (select p_partkey, p_size, 'Shoot ' || p_brand || '/IMG_' || lpad(p_partkey::varchar, 5, '0') || case when p_size % 2 = 0 then '.CR2' else '.jpg' end as path from part) select p_partkey, 'img_' || lpad(p_partkey::varchar, 5, '0') as stem, case when p_size % 2 = 0 then 'cr2' else 'jpg' end as suffix, regexp_extract(path, '^([^/]+)/', 1) as top, cast(regexp_extract(path, '.*?(\\d{3,})\\D*\\.', 1) as int) as sequence, true as safe from p",
    "companion_anti_join": "with o as (select o_orderkey, 'd' || o_custkey || '/F' || (o_orderkey % 40) as base, o_orderstatus = 'O' as raw from orders) select o_orderkey, base || case when raw then '.NEF' else '.JPG' end as path from o where raw or base not in (select base from o where raw)",
    "raw_previews": "with o as (select distinct 'd' || o_custkey || '/F' || (o_orderkey % 40) as base, o_orderstatus = 'O' as raw from orders) select a.base || '.nef' as path, b.base || '.jpg' as preview from o a left join o b on a.base = b.base and not b.raw where a.raw",
    "dominant_signature": "select lang as pipeline_signature, count(*) as n, max(doc_id) as last from documents where source like 'src%' group by 1 order by 2 desc, 3 desc, 1 limit 1",
    "latest_revision": "select conv_id::varchar as operation, max(turn) as revision, arg_max(role, turn) as role from conversations group by 1",
    "latest_by_key": with_("photos") + " select grp, us, id, status from (select *, row_number() over (partition by grp order by us desc, id desc) as r from photos) where r = 1",
    "set_hash": SET_HASH,
    "strict_clusters": STRICT,
    "identity_clusters": IDENTITIES,
    "cosine_pairs": "with e as (select vec_id, label, embedding::double[] as x, sqrt(list_sum(list_transform(embedding::double[], lambda v: v * v))) as n from embeddings) select a.vec_id as l, b.vec_id as r, round(list_dot_product(a.x, b.x) / (a.n * b.n), 5) as cosine from e a join e b on a.label = b.label and a.vec_id < b.vec_id where list_dot_product(a.x, b.x) / (a.n * b.n) >= 0.3",
    "nearest_two_centroids": "with x as (select label, k, avg(v::double) as v from (select label, unnest(embedding) as v, generate_subscripts(embedding, 1) as k from embeddings) group by 1, 2), c as (select label, list(v order by k) as c from x group by 1), s as (select e.vec_id, c.label, round(list_dot_product(e.embedding::double[], c.c), 6) as s from embeddings e cross join c), r as (select *, row_number() over (partition by vec_id order by s desc, label) as r from s) select vec_id, max(label) filter (where r = 1) as best, max(s) filter (where r = 1) as score, round(max(s) filter (where r = 1) - max(s) filter (where r = 2), 6) as margin from r where r <= 2 group by 1",
    "vector_norms": "select vec_id, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) as norm, round(sqrt(list_dot_product(embedding::double[], embedding::double[])), 5) as self from embeddings",
    "near_duplicate_pairs": "with d as (select doc_id, doc_id // 4 as tb, md5(text) as fp, ('0x' || sha256(text)[1:16])::ubigint as h from documents), p as (select a.doc_id as l, b.doc_id as r, a.h as x, b.h as y from d a join d b on a.doc_id < b.doc_id and a.fp = b.fp union select a.doc_id, b.doc_id, a.h, b.h from d a join d b on a.doc_id < b.doc_id and b.tb between a.tb - 1 and a.tb + 1) select l as \"left\", r as \"right\", round(1 - bit_count(xor(x, y)) / 64, 6) as similarity from p where round(1 - bit_count(xor(x, y)) / 64, 6) >= 0.6",
    "fingerprint_clusters": "with f as (select sha256(text) as fp, arg_min(source, doc_id) as owner, min(doc_id) as first, count(*) as members from documents group by 1) select owner || ':strict-' || lpad(row_number() over (partition by owner order by first)::varchar, 4, '0') as cluster, first, members from f",
    "duplicate_leaks": "with c as (select count(*) as n from documents where text is not null group by text) select count(*) filter (where n > 1) as clusters, sum(n - 1)::bigint as leaks, sum(n * (n - 1) // 2)::bigint as pairs from c",
    "beats": "with recursive records as (select event_id, user_id, epoch_us(ts) / 1e6 as t from events), s0 as (select *, case when t - lag(t) over (partition by user_id order by t, event_id) > 10800 then 1 else 0 end as n from records), s as (select event_id, t, user_id || '-' || (sum(n) over (partition by user_id order by t, event_id rows unbounded preceding))::bigint as part from s0), r as (select *, row_number() over (partition by part order by t, event_id) as i from s), f as (select part, event_id, i, t as first, t as last, 1::bigint as beat from r where i = 1 union all select r.part, r.event_id, r.i, case when r.t - f.last > 3600 or r.t - f.first > 3600 then r.t else f.first end, r.t, case when r.t - f.last > 3600 or r.t - f.first > 3600 then f.beat + 1 else f.beat end from f join r on r.part = f.part and r.i = f.i + 1) select part, event_id, beat from f",
    "label_join": with_("labelled") + f", g as (select source, count(*) filter (where score >= 0.4) as s, count(*) filter (where good) as l, count(*) filter (where score >= 0.4 and good) as h, count(*) as n from labelled group by 1) select sum(s)::bigint as selected, sum(l)::bigint as labelled, sum(h)::bigint as hits, {_RATE('sum(h)', 'sum(l)')} as recall, count(*) filter (where l > 0) as groups, count(*) filter (where l > 0 and h > 0) as groups_hit, {_RATE('sum(n) - sum(s)', 'sum(n)')} as reduction from g",
    "unmatched_labels": "select lang, count(*) as unlabelled from documents where doc_id not in (select doc_id from labels) group by 1",
    "single_label_groups": with_("labelled") + " select source, lang, min(doc_id) as doc_id from labelled where toxic group by 1, 2 having count(*) = 1",
    "confusion_metrics": with_("labelled") + f", c as (select lang, {_CONF} from (select lang, score >= 0.4 as p, good as e from labelled) group by 1) select *, {_RATES} from c",
    "ranking_metrics": with_("labelled") + ", r as (select source, toxic, row_number() over (partition by source order by score desc, doc_id) as rank from labelled), g as (select source, min(rank) as best, count(*) as n, " + ", ".join(f"count(*) filter (where rank <= {k}) as in{k}" for k in (1, 2, 3, 5)) + " from r where toxic group by 1) select count(*) as groups, round_even(avg(1 / best), 6) as mrr, " + ", ".join(f"round_even(avg((best <= {k})::int), 6) as hit_at_{k}, round_even(sum(in{k}) / sum(n), 6) as recall_at_{k}" for k in (1, 2, 3, 5)) + " from g",
    "grouping_summary": with_("photos") + ", s as (select count(*) as size from photos group by grp) select count(*) as groups, count(*) filter (where size = 1) as singletons, max(size) as largest, list(size order by size)[cast(floor(0.95::double * count(*)) as bigint) + 1] as p95, round_even(1 - count(*) / sum(size), 6) as reduction from s",
    "micro_average": with_("labelled") + f", g as (select source, {_CONF}, case when count(*) > 5 then count(*) filter (where toxic) < 100 end as ok from (select source, toxic, score >= 0.4 as p, good as e from labelled) group by 1), c as (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(tn)::bigint as tn, case when count(*) filter (where not ok) > 0 then false when count(*) filter (where ok is null) > 0 then null else true end as ok from g) select *, {_RATES} from c",
    "gate_checks": with_("labelled") + ", g as (select source, round_even(avg(((score >= 0.5) = good)::int), 6) as b1, round_even(avg((score >= 0.5 and not toxic)::int), 6) as b2, round_even(avg(((score >= 0.3) = good)::int), 6) as c1, round_even(avg((score >= 0.3 and not toxic)::int), 6) as c2 from labelled group by 1), d as (select source, round_even(c1 - b1, 6) as top1_gain, round_even(c2 - b2, 6) as safety_gain from g) select *, top1_gain >= -0.01 as top1_ok, safety_gain >= -0.01 as safety_ok, round_even(avg(top1_gain) over (), 6) >= 0.03 as mean_ok from d",
    "roc_auc": with_("labelled") + ", s as (select score, count(*) filter (where good) as p, count(*) filter (where not good) as n from labelled group by 1), b as (select *, coalesce(sum(n) over (order by score rows between unbounded preceding and 1 preceding), 0) as below from s) select round_even(sum(p * (below + 0.5 * n)) / (sum(p) * sum(n))::double, 6) as auc, sum(p)::bigint as positives, sum(n)::bigint as negatives from b",
    "pairwise_accuracy": with_("labelled") + ", p as (select a.source, case when a.score > b.score then 1.0 when a.score = b.score then 0.5 else 0.0 end as v from labelled a join labelled b on a.source = b.source and a.good and not b.good), t as (select source, max((good)::int) as hit from (select source, good, rank() over (partition by source order by score desc) as r from labelled) where r = 1 group by 1) select round_even(avg(v), 6) as pairwise_accuracy, (select round_even(avg(hit), 6) from t where source in (select source from p)) as top1, count(distinct source) as groups from p",
    "threshold_sweep": with_("labelled") + ", k as (select k, round(0.12::double + (k - 1) * (0.76::double / 152), 6) as threshold, 0.12::double + (k - 1) * (0.76::double / 152) as raw from (select unnest(generate_series(1, 153)) as k)), c as (select threshold, count(*) filter (where score >= raw - 1e-11 and good) as tp, count(*) filter (where score >= raw - 1e-11 and not good) as fp, count(*) filter (where score < raw - 1e-11 and good) as fn, count(*) filter (where score < raw - 1e-11 and not good) as tn from k cross join labelled group by threshold) select threshold, tp, fp, fn, tn, " + _RATES.rpartition(", coalesce")[0] + " from c",
    "pair_audit": f"with p as (select l.quality = 0 as e, coalesce(a.text = b.text, false) as p from labels l left join documents a on a.doc_id = l.doc_id left join documents b on b.doc_id = l.doc_id + 1), c as (select {_CONF} from p) select *, {_RATES} from c",
    "set_ops_eval": "with d as (select doc_id from documents where n_chars >= 1500), x as (select doc_id from labels where quality = 1), u as (select 'both' as kind, doc_id from (select * from d intersect select * from x) union all select 'predicted', doc_id from (select * from d except select * from x) union all select 'expected', doc_id from (select * from x except select * from d)) select kind, count(*) as n, sum(doc_id)::bigint as ids from u group by 1",
    "star_summary": with_("photos") + ", s as (select grp, cast(floor(score / 26) as int) as s from photos) select count(*) as photos, " + ", ".join(f"count(*) filter (where s = {k}) as stars{k}" for k in range(4)) + ", count(distinct grp) as groups, count(*) filter (where s >= 2) as delivered, round(1 - count(*) filter (where s >= 2) / count(*), 6) as reduction from s",
    "logistic_score": with_("faces") + ", f as (select photo, max(sharp) as a, sum(sharp) as b, avg(occlusion) as c from faces group by 1) select photo, round(1 / (1 + exp(-greatest(-30.0, least(30.0, 0.1 + (a - 20) / 10 * 0.4 + (b - 100) / 50 * -0.3 + (c - 0.5) / 0.25 * 0.8)))), 6) as p from f",
    "hash_split": "with s as (select doc_id, ('0x' || sha256('v1:' || doc_id)[1:16])::ubigint::double / 18446744073709551616.0 as u from documents) select doc_id, case when u < 0.8 then 'train' when u < 0.9::double then 'validation' else 'test' end as part from s",
    "score_join": with_("labelled") + " select source, bool_and(doc_id % 50 != 7) as complete, count(*) filter (where doc_id % 50 != 7) as scores from labelled group by 1",
    "training_records": """select conv_id, count(*) as turns, sha256('{"messages":' || to_json(list(struct_pack(role := role, content := text) order by turn, role, text))::varchar || '}') as record from conversations group by 1""",
    "cv_folds": with_("labelled") + ", g as (select source, count(*) as n from labelled group by 1), u as (select *, sum(n) over (order by source) as upto, sum(n) over () as total from g) select source, n, cast(least(4, floor((upto - n / 2) * 5 / total)) as bigint) as fold from u",
    "hardest_negatives": with_("labelled") + " select source, doc_id, hardness from (select source, doc_id, row_number() over (partition by source order by rank) as hardness from (select *, row_number() over (partition by source order by score desc, doc_id) as rank from labelled) where not good) where hardness <= 3",
    "sound_decisions": "select conv_id, list(turn order by turn) = range(0, count(*)) as sound from conversations group by 1",
    "export_plan": _PLAN + " select * from plan",
    "plan_counts": _PLAN + " select stars, " + ", ".join(f"count(*) filter (where action = '{a}') as {a}" for a in ("copy", "skip", "conflict", "invalid")) + " from plan group by 1",
    "cdc_classify": _CDC + " select * from cdc",
    "action_counts": _CDC + " select " + ", ".join(f"count(*) filter (where action = '{a}') as {a}" for a in ("new", "update", "unchanged", "protected", "invalid")) + ", count(*) as total from cdc",
    "receipt_reconcile": with_("photos") + " select case when id % 7 = 0 then 'unexpected' when id % 11 = 0 then 'missing' when id % 13 = 0 then 'mismatch' else 'verified' end as state, count(*) as items from photos where id % 7 != 0 or id % 11 != 0 group by 1",
    "drift_check": with_("photos") + " select * from (select id, case when id % 9 = 0 then 'missing' when id % 8 = 0 and grp != 0 then 'size' when id % 10 = 0 and floor(us / 1000000) != 0 then 'modified' when id % 3 != 0 then 'rating' end as drift from photos) where drift is not null",
    "pending_items": _CDC + " select id, target_rating from cdc where action = 'update' and id % 2 != 0",
    "rollback_items": with_("photos") + " select id, case when id % 3 = 0 then 1 end as restore, id % 3 != 0 as conflict from photos",
    "merged_people": with_("faces") + " select case when person % 5 = 1 then person - 1 else person end as person, count(distinct photo) as photos from faces group by 1",
    "face_moments": with_("photos", "faces") + ", f as (select photo, person, max(occlusion) < 0.4 as open from faces group by 1, 2), p as (select min(id) as l, max(id) as r from photos group by grp having min(id) < max(id)) select distinct l as \"left\", r as \"right\" from p join f a on a.photo = p.l join f b on b.photo = p.r and b.person = a.person where a.open != b.open",
    "activity_sessions": "with e as (select user_id, epoch_us(ts) as t from events), s as (select *, sum(n) over (partition by user_id order by t rows unbounded preceding) as k from (select *, case when t - lag(t) over (partition by user_id order by t) >= 10800000000 then 1 else 0 end as n from e)) select user_id, min(t) as first, max(t) as last, count(*) as \"rows\" from s group by user_id, k",
    "corrections_replay": """with x as (select l_orderkey as photo, l_linenumber::bigint as face_index, max(l_quantity) as q, min(l_suppkey)::varchar as person from lineitem group by 1, 2),
f as (select photo, face_index, person, (q % 9)::double as a from x), n as (select photo, face_index as anchor, 'fixed-' || person as person, (q % 9)::double as b from x where photo % 4 = 0 and face_index <= 2),
o as (select f.photo, f.face_index, n.anchor, n.person, greatest(0.0, least(a + 5, b + 6) - greatest(a, b)) * 5 as common from f join n using (photo)),
met as (select *, count(*) over (partition by photo, anchor) as na, count(*) over (partition by photo, face_index) as nf from o where common / (55 - common) >= 0.8),
once as (select photo, person, min(face_index) as face_index from met where na = 1 and nf = 1 group by 1, 2)
select f.photo, f.face_index, case when once.person is not null then once.person when m.photo is not null then null else f.person end as person, m.photo is not null and once.person is null as warning
from f left join once on once.photo = f.photo and once.face_index = f.face_index left join (select distinct photo, face_index from met) m on m.photo = f.photo and m.face_index = f.face_index""",
    "state_machine": "with recursive step(s, e, n) as (values " + ", ".join(f"('{a}', '{b}', '{c}')" for (a, b), c in operations.STEPS.items()) + """),
r as (select user_id, row_number() over (partition by user_id order by ts, event_id) as i, ['submit', 'claim', 'receipt', 'confirm', 'progress', 'fail', 'retry'][event_id % 7 + 1] as e from events),
f as (select user_id, 0::bigint as i, 'new' as state, 0::bigint as applied from (select distinct user_id from events) union all
 select f.user_id, r.i, coalesce(step.n, f.state), f.applied + (step.n is not null)::int from f join r on r.user_id = f.user_id and r.i = f.i + 1 left join step on step.s = f.state and step.e = r.e)
select user_id, arg_max(state, i) as state, max(applied) as applied from f group by 1""",
}
QUERIES = {k: globals()[k] for k in [*SQLS, "online_groups", "fitted_preference"]}
