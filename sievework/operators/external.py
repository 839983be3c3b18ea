"""Outside rankings of groups: decisions from a cache, the others asked for once, repaired once, checked, or left as they are."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import ready_to_checkpoint
from .model import sound_decision

DECISION = "best string, ranking array<struct<id:string,rank:int>>, rejected array<string>, confidence double"


def _read(text: Column, candidates: Column) -> Column:
    """The decision that a text holds (anything around its outer braces is ignored), null where it isn't whole."""
    d = F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), DECISION, {"mode": "PERMISSIVE"})
    part = lambda name: F.transform(d["ranking"], lambda x: x[name])
    sound = sound_decision(part("id"), part("rank"), d["best"], F.coalesce(d["rejected"], F.array().cast("array<string>")), candidates) & d["confidence"].between(0.0, 1.0)
    return F.when(F.coalesce(sound, F.lit(False)), d)


def _answers(groups: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """groups with answer: what ask says to prompt, null where it raises. Written to the checkpoint folder, so nothing is asked again."""

    def asked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(prompt: str) -> str | None:
            try:
                return ask(prompt)
            except Exception:  # noqa: BLE001 - an outside service may fail in any way; the group keeps its own order
                return None

        for b in batches:
            yield b.assign(answer=[one(p) for p in b["prompt"]])

    schema = ", ".join(f"`{n}` {t}" for n, t in groups.dtypes) + ", answer string"
    return groups.mapInPandas(asked, schema).checkpoint()


def review(groups: DataFrame, cache: DataFrame, ask: Callable[[str], str], repair: str = "The last answer was not a whole decision. Answer with the JSON object alone.") -> DataFrame:
    """groups (group, key, prompt, candidates) with decision (null where there is none), response and source.

    cache: key, response (JSON text; of several for a key the least counts). A cached response that doesn't hold together is
    asked for anew. source is cached, asked, repaired (the second answer held) or failed. Needs a checkpoint folder.
    """
    ready_to_checkpoint(groups.sparkSession)
    names = ["group", "key", "prompt", "candidates"]
    kept = cache.filter("key is not null").groupBy("key").agg(F.min("response").alias("response"))
    met = groups.select(*names).join(kept, "key", "left").withColumn("decision", _read(F.col("response"), F.col("candidates")))
    done = lambda rows, source: rows.select(*names, "decision", "response", F.lit(source).alias("source"))
    read = lambda rows: rows.withColumn("response", F.col("answer")).withColumn("decision", _read(F.col("answer"), F.col("candidates")))
    first = read(_answers(met.filter("decision is null").select(*names), ask))
    again = first.filter("decision is null").select("group", "key", F.concat_ws("\n", "prompt", F.lit(repair)).alias("prompt"), "candidates")
    second = read(_answers(again, ask)).withColumn("prompt", F.substring_index("prompt", "\n" + repair, 1))
    parts = [done(met.filter("decision is not null"), "cached"), done(first.filter("decision is not null"), "asked"), done(second.filter("decision is not null"), "repaired"), done(second.filter("decision is null"), "failed")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def new_responses(reviewed: DataFrame) -> DataFrame:
    """(key, response) to add to the cache: what was asked for and held together."""
    return reviewed.filter(F.col("source").isin("asked", "repaired")).select("key", "response")


def outer_ranks(reviewed: DataFrame, least_confidence: float) -> DataFrame:
    """(group, id, outer_rank) of the decisions that are sure enough; a row a candidate."""
    sure = reviewed.filter(F.col("decision.confidence") >= least_confidence)
    return sure.select("group", F.explode("decision.ranking").alias("r")).select("group", F.col("r.id").alias("id"), F.col("r.rank").alias("outer_rank"))


def review_report(reviewed: DataFrame, least_confidence: float) -> DataFrame:
    """One row: groups by source, and how many decisions are sure enough to apply."""
    return reviewed.agg(F.count(F.lit(1)).alias("candidate_groups"), *[F.count_if(F.col("source") == s).alias(s) for s in ("cached", "asked", "repaired", "failed")], F.count_if(F.col("decision.confidence") >= least_confidence).alias("applied_groups"))
