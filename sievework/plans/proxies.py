"""The tables seen as the pipeline's entities, in Spark and in SQL.

photos: orders (group = customer, score from price); faces: line items (photo = order, person = supplier); records in
time: events (key = user); texts with labels: documents and labels; embeddings: identities; catalogue: orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import micros
from ..operators.ranking import sessions

SESSION_GAP = 3 * 3600.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, user_id, event_type, value, t (seconds)."""
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", (micros(F.col("ts")) / 1e6).alias("t"))


def in_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(records(spark, sf_dir), "user_id", "t", SESSION_GAP, "event_id")


def photos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, grp, score (0 to 100), us (microseconds), status, priority."""
    o = read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("grp"), F.least(F.lit(100.0), F.col("o_totalprice") / 5000).alias("score"), micros(F.col("o_orderdate")).alias("us"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """photo, person, area, confidence, sharp, occlusion, line."""
    x = read(spark, sf_dir, "lineitem")
    return x.select(F.col("l_orderkey").alias("photo"), F.col("l_suppkey").alias("person"), (F.col("l_quantity") / 10000).alias("area"), (1 - 5 * F.col("l_discount")).alias("confidence"), (F.col("l_extendedprice") / 100).alias("sharp"), (F.col("l_tax") * 10).alias("occlusion"), F.col("l_linenumber").alias("line"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, score (0 to 1 from n_chars), good: labelled documents."""
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    j = d.join(read(spark, sf_dir, "labels"), "doc_id")
    return j.select("doc_id", "source", "lang", F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("score"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))


SQL = {
    "records": "records as (select event_id, user_id, event_type, value, epoch_us(ts) / 1e6 as t from events)",
    "sess": """sess0 as (select *, case when t - lag(t) over (partition by user_id order by t, event_id) > 10800 then 1 else 0 end as n from records),
sess as (select event_id, user_id, event_type, value, t, cast(sum(n) over (partition by user_id order by t, event_id rows unbounded preceding) as bigint) as session from sess0)""",
    "photos": "photos as (select o_orderkey as id, o_custkey as grp, least(100.0, o_totalprice / 5000) as score, epoch_us(o_orderdate) as us, o_orderstatus as status, o_orderpriority as priority from orders)",
    "faces": "faces as (select l_orderkey as photo, l_suppkey as person, l_quantity / 10000 as area, 1 - 5 * l_discount as confidence, l_extendedprice / 100 as sharp, l_tax * 10 as occlusion, l_linenumber as line from lineitem)",
    "labelled": "labelled as (select d.doc_id, d.source, d.lang, least(1.0, d.n_chars / 4000) as score, l.quality = 1 as good, l.toxic = 1 as toxic from documents d join labels l using (doc_id))",
}


def with_(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names)
