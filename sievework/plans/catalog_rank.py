"""Queries: sessions, ranks, percentiles, stages, order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..config import preset
from ..functions import names, numbers
from ..operators import folds, pairs, ranking
from . import proxies as P
from .proxies import read, with_

SIGNIFICANT = "((area >= 0.0006 and confidence >= 0.82) or (area >= 0.0010 and confidence >= 0.65) or (area >= 0.0025 and confidence >= 0.55))"


def session_rank_topk(spark, sf):
    held = ranking.group_features(P.in_sessions(spark, sf), ["user_id", "session"], "value", ["value"])
    top = ranking.ranked(held, ["user_id", "session"], [F.desc("value"), F.col("event_id")], keep=1)
    return top.filter("is_top").select("user_id", "session", "event_id", F.round("value", 6).alias("value"), "group_size", F.round("quality_percentile", 6).alias("quality_percentile"), F.round("score_gap", 6).alias("score_gap"))


def session_percent_rank(spark, sf):
    held = P.in_sessions(spark, sf)
    g = ["user_id", "session"]
    return held.select("event_id", F.round(ranking.rank_percentile(g, [F.desc("value"), F.col("event_id")]), 6).alias("rank_percentile"), F.round(ranking.value_percentile(g, "value", F.col("event_id")), 6).alias("value_percentile"))


def session_features(spark, sf):
    held = ranking.group_features(P.in_sessions(spark, sf), ["user_id", "session"], "value", ["value", "t"])
    return held.select("event_id", F.round("value_gap", 6).alias("value_gap"), F.round("t_gap", 3).alias("t_gap"), F.col("group_size"))


def stage_fold_span_gap(spark, sf):
    held = P.in_sessions(spark, sf).select("event_id", "user_id", "t", F.lit(None).cast("long").alias("burst"))
    return folds.time_stages(held, "user_id", "t", "burst", "event_id", 60).select("user_id", "event_id", "stage")


def stage_summary(spark, sf):
    held = P.in_sessions(spark, sf)
    return held.groupBy("user_id", "session").agg(F.count(F.lit(1)).alias("photos"), F.countDistinct("event_type").alias("kinds"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), names.time_range_label(F.min(F.timestamp_micros((F.col("t") * 1e6).cast("long"))), F.max(F.timestamp_micros((F.col("t") * 1e6).cast("long")))).alias("label"))


def folder_stage(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"))
    return ranking.folder_stages(d, "path", "doc_id").select("doc_id", "folder", "stage")


def chunk_assign(spark, sf):
    held = ranking.chunked(P.photos(spark, sf), ["status"], [F.col("us"), F.col("id")], 100)
    return held.groupBy("status", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("most"))


def hash_rotate(spark, sf):
    return ranking.rotated(P.photos(spark, sf), "grp", F.lit("salt"), "id", 2).select("id", "grp", "position")


def canonical_order(spark, sf):
    o = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 7 != 0, names.micros(F.col("o_orderdate"))).alias("t"), F.when(F.col("o_orderkey") % 3 == 0, -1).otherwise(F.col("o_custkey")).cast("long").alias("seq"), F.col("o_orderpriority").alias("name"))
    return ranking.numbered(o, ranking.temporal_order("t", "seq", "name", "id"), "position").select("id", "position")


def cyclic_next(spark, sf):
    return P.photos(spark, sf).select("id", ranking.cyclic_next(["grp"], [F.col("us"), F.col("id")], "id").alias("next_id"))


def reason_list(spark, sf):
    rows = P.photos(spark, sf)
    said = ranking.reasons([F.when(F.col("score") >= 60, "sharp"), F.when(F.col("score") >= 40, "exposed"), F.when(F.col("status") == "F", "sharp"), F.lit(""), F.when(F.col("status") == "O", "open"), F.lit("last")], 3)
    return rows.select("id", F.array_join(said, " | ").alias("reasons"))


def rerank_external(spark, sf):
    rows = ranking.ranked(P.photos(spark, sf), ["grp"], [F.desc("score"), F.col("id")])
    named = rows.withColumn("outer_rank", F.when(F.col("id") % 5 == 0, F.col("id") % 97))
    again = ranking.reranked(named.select("id", "grp", (F.coalesce("outer_rank", F.lit(None)) * 1000000000 + F.col("id")).alias("outer_rank"), (F.col("rank") + 10**15).alias("rank")), "grp", "outer_rank", "rank")
    return again.select("id", "grp", "rank")


def ambiguous_groups(spark, sf):
    return ranking.ambiguous_groups(P.photos(spark, sf), "grp", "score", "id", 0.5, 4, 50).select("grp", F.round("gap", 6).alias("gap"), F.col("candidates").cast("long").alias("candidates"))


def seed_rows(spark, sf):
    rows = P.photos(spark, sf).withColumns({"rank": F.lit(0), "name": F.col("id").cast("string")})
    return ranking.seed_rows(rows, "grp", F.col("score") >= 20, "rank", "score", "name").select("grp", "id")


def span_check(spark, sf):
    held = P.in_sessions(spark, sf).groupBy("user_id", "session").agg((F.max("t") - F.min("t")).alias("span"), F.count(F.lit(1)).alias("n"))
    p = preset("balanced")
    return held.select("user_id", "session", F.round("span", 3).alias("span"), (F.col("span") <= p.span_seconds).alias("coherent"), ((F.col("span") > p.span_seconds) & (F.col("span") <= 2 * p.span_seconds)).alias("needs_ends"))


def time_pairs(spark, sf):
    r = P.records(spark, sf).select("event_id", "user_id", "t")
    near = pairs.range_join(r, r, "t", 600.0, ["user_id"]).filter("l_event_id < r_event_id")
    d = F.abs(F.col("l_t") - F.col("r_t"))
    return near.select("l_event_id", "r_event_id", F.round(d, 3).alias("seconds"), F.round(numbers.temporal_similarity(d, F.lit(None).cast("double")), 6).alias("similarity"))


def close_pairs(spark, sf):
    p = preset("balanced")
    r = P.records(spark, sf).select("event_id", "t")
    near = pairs.range_join(r, r, "t", p.hard_seconds).filter("l_event_id < r_event_id")
    d, s = F.abs(F.col("l_t") - F.col("r_t")), F.abs(F.col("l_event_id") - F.col("r_event_id"))
    return near.select("l_event_id", "r_event_id", pairs.sequence_close(d, s, p).alias("close"), pairs.consolidation_close(d, s, p).alias("mergeable"))


def leak_search(spark, sf):
    s = P.in_sessions(spark, sf).select("event_id", "user_id", "session", "t")
    near = pairs.nearest_between_groups(s, "event_id", ["user_id", "session"], "t", 60.0)
    name = lambda side: F.concat_ws("-", F.col(f"{side}_user_id").cast("string"), F.col(f"{side}_session").cast("string"))
    return near.select(F.least(name("l"), name("r")).alias("low"), F.greatest(name("l"), name("r")).alias("high"), "l_event_id", "r_event_id", F.round(F.exp(-F.col("gap") / 18), 6).alias("total"))


def window_prune(spark, sf):
    s = P.in_sessions(spark, sf).groupBy("user_id", "session").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    nxt = F.lead("first").over(Window.partitionBy("user_id").orderBy("session"))
    return s.select("user_id", "session", (nxt - F.col("last") > 28.0).alias("beyond"))


SQLS = {
    "session_rank_topk": with_("records", "sess") + """ select user_id, session, event_id, round(value, 6) as value, group_size, round(q, 6) as quality_percentile, round(gap, 6) as score_gap from (
select *, count(*) over w as group_size, 100 * cume_dist() over (w order by value) as q, value - max(value) over w as gap, row_number() over (w order by value desc, event_id) as r from sess window w as (partition by user_id, session)) where r = 1""",
    "session_percent_rank": with_("records", "sess") + """ select event_id, round(case when n <= 1 then 1.0 else 1 - (a - 1) / (n - 1) end, 6) as rank_percentile, round(case when n <= 1 or spread < 1e-9 then 0.5 else (b - 1) / (n - 1) end, 6) as value_percentile from (
select event_id, count(*) over w as n, max(value) over w - min(value) over w as spread, row_number() over (w order by value desc, event_id) as a, row_number() over (w order by value, event_id) as b from sess window w as (partition by user_id, session))""",
    "session_features": with_("records", "sess") + " select event_id, round(value - max(value) over w, 6) as value_gap, round(t - max(t) over w, 3) as t_gap, count(*) over w as group_size from sess window w as (partition by user_id, session)",
    "stage_fold_span_gap": "with recursive r0 as (select event_id, user_id, epoch_us(ts) / 1e6 as t, row_number() over (partition by user_id order by ts, event_id) as i from events), f as (select user_id, event_id, i, t as start, t as last, 1::bigint as stage from r0 where i = 1 union all select r.user_id, r.event_id, r.i, case when r.t - f.start >= 3600 or r.t - f.last >= 1800 then r.t else f.start end, r.t, case when r.t - f.start >= 3600 or r.t - f.last >= 1800 then f.stage + 1 else f.stage end from f join r0 r on r.user_id = f.user_id and r.i = f.i + 1) select user_id, event_id, stage from f",
    "stage_summary": with_("records", "sess") + " select user_id, session, count(*) as photos, count(distinct event_type) as kinds, min(t) as first_t, max(t) as last_t, strftime(make_timestamp(cast(min(t) * 1e6 as bigint)), '%H:%M') || '-' || strftime(make_timestamp(cast(max(t) * 1e6 as bigint)), '%H:%M') as label from sess group by 1, 2",
    "folder_stage": "with f as (select source as folder, min(doc_id) as first from documents group by 1), g as (select folder, row_number() over (order by first, folder) as stage from f) select d.doc_id, g.folder, g.stage from documents d join g on g.folder = d.source",
    "chunk_assign": with_("photos") + " select status, chunk, count(*) as n, min(id) as least, max(id) as most from (select status, id, cast(floor((row_number() over (partition by status order by us, id) - 1) / 100) as bigint) as chunk from photos) group by 1, 2",
    "hash_rotate": with_("photos") + " select id, grp, cast(((r - 3) % n + n) % n as bigint) as position from (select id, grp, count(*) over (partition by grp) as n, row_number() over (partition by grp order by sha256('salt:' || id), id) as r from photos)",
    "canonical_order": "select o_orderkey as id, row_number() over (order by case when o_orderkey % 7 != 0 then o_orderdate end nulls last, case when o_orderkey % 3 = 0 then null else o_custkey end nulls last, lower(o_orderpriority), o_orderkey) as position from orders",
    "cyclic_next": with_("photos") + " select id, coalesce(lead(id) over w, first_value(id) over w) as next_id from photos window w as (partition by grp order by us, id)",
    "reason_list": with_("photos") + ", r as (select id, list_filter([case when score >= 60 or status = 'F' and score < 40 then 'sharp' when status = 'F' and score >= 40 then null end, case when score >= 40 then 'exposed' end, case when status = 'F' and score >= 40 and score < 60 then 'sharp' end, case when status = 'O' then 'open' end, 'last'], lambda x: x is not null)[1:3] as l from photos) select id, array_to_string(l, ' | ') as reasons from r",
    "rerank_external": with_("photos") + " select id, grp, row_number() over (partition by grp order by case when id % 5 = 0 then 0 else 1 end, case when id % 5 = 0 then id % 97 end, case when id % 5 = 0 then id end, score desc, id) as rank from photos",
    "ambiguous_groups": with_("photos") + " select grp, round(gap, 6) as gap, cast(least(n, 4) as bigint) as candidates from (select grp, max(case when r = 1 then score - nxt end) as gap, count(*) as n from (select grp, score, row_number() over w as r, lead(score) over w as nxt from photos window w as (partition by grp order by score desc, id)) group by 1) where gap <= 0.5 order by gap, candidates desc, grp limit 50",
    "seed_rows": with_("photos") + " select grp, id from (select grp, id, row_number() over (partition by grp order by score desc, id::varchar) as r from photos where score >= 20) where r = 1",
    "span_check": with_("records", "sess") + " select user_id, session, round(span, 3) as span, span <= 16 as coherent, span > 16 and span <= 32 as needs_ends from (select user_id, session, max(t) - min(t) as span from sess group by 1, 2)",
    "time_pairs": with_("records") + " select a.event_id as l_event_id, b.event_id as r_event_id, round(abs(a.t - b.t), 3) as seconds, round(exp(-abs(a.t - b.t) / 18), 6) as similarity from records a join records b on a.user_id = b.user_id and a.event_id < b.event_id and abs(a.t - b.t) <= 600",
    "close_pairs": with_("records") + " select a.event_id as l_event_id, b.event_id as r_event_id, abs(a.t - b.t) <= 16 or abs(a.event_id - b.event_id) <= 16 as close, abs(a.t - b.t) <= 28 as mergeable from records a join records b on a.event_id < b.event_id and b.t between a.t - 45 and a.t + 45",
    "leak_search": with_("records", "sess") + ", s as (select event_id, user_id || '-' || session as grp, t from sess), p as (select least(a.grp, b.grp) as low, greatest(a.grp, b.grp) as high, a.event_id as l_event_id, b.event_id as r_event_id, exp(-abs(a.t - b.t) / 18) as total from s a join s b on a.event_id < b.event_id and a.grp != b.grp and b.t between a.t - 60 and a.t + 60) select low, high, l_event_id, r_event_id, round(total, 6) as total from (select *, row_number() over (partition by low, high order by total desc, l_event_id desc, r_event_id desc) as r from p) where r = 1",
    "window_prune": with_("records", "sess") + ", s as (select user_id, session, min(t) as first, max(t) as last from sess group by 1, 2) select user_id, session, lead(first) over (partition by user_id order by session) - last > 28.0 as beyond from s",
}
QUERIES = {k: globals()[k] for k in SQLS}
