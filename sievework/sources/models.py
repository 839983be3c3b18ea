"""Model assets and provenance: small JSON documents on the driver, checked before use."""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.delivery import plan_hash
from ..operators.model import logistic
from ..sinks.reports import save_document


@dataclass(frozen=True)
class LogisticModel:
    """A frozen logistic model; features are names of columns or metrics."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float

    def __post_init__(self) -> None:
        n = len(self.features)
        if not n or any(len(x) != n for x in (self.mean, self.scale, self.weights)) or len(set(self.features)) != n:
            raise ValueError("features, mean, scale and weights must match one to one")
        if not all(map(math.isfinite, (*self.mean, *self.scale, *self.weights, self.bias))) or any(s <= 0 for s in self.scale):
            raise ValueError("numbers must be finite and scales above zero")

    def score(self, feature=F.col) -> Column:
        return logistic([feature(f) for f in self.features], list(self.mean), list(self.scale), list(self.weights), self.bias)

    def digest(self) -> str:
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()

    def save(self, path: str) -> None:
        save_document(asdict(self) | {"digest": self.digest()}, path)


def load_model(path: str, features: tuple[str, ...] | None = None) -> LogisticModel:
    """The model of a file; an error where it doesn't hold together, was changed, or has other features than expected."""
    with open(path, encoding="utf-8") as f:
        d = json.load(f)
    m = LogisticModel(tuple(d["features"]), tuple(d["mean"]), tuple(d["scale"]), tuple(d["weights"]), float(d["bias"]))
    if d.get("digest") != m.digest() or (features is not None and m.features != tuple(features)):
        raise ValueError("the model file isn't the one expected")
    return m


def load_model_or_none(path: str, features: tuple[str, ...]) -> LogisticModel | None:
    """For optional models: None where the file is missing or unfit."""
    try:
        return load_model(path, features)
    except (OSError, ValueError, KeyError, TypeError):
        return None


def release(models: dict[str, LogisticModel], path: str, frozen: dict, tables: dict[str, DataFrame]) -> str:
    """Write the models of all profiles with what they were made of, and return the document's digest; or refuse.

    frozen: holdout_read and tuned_after_holdout, both of which must be False; tables, the digest of each training table;
    configuration. The tables given must be those of frozen, with the same digests in any order of rows. Profiles come
    from the narrowest to the widest, and each one's features begin with those of the one before.
    """
    for flag in ("holdout_read", "tuned_after_holdout"):
        if frozen.get(flag) is not False:
            raise ValueError(f"{flag} must be False in the frozen configuration")
    found = {name: plan_hash(rows).first()["plan_hash"] for name, rows in tables.items()}
    if found != frozen.get("tables"):
        raise ValueError("the training tables aren't those of the frozen configuration")
    features = [m.features for m in models.values()]
    if not features or any(b[: len(a)] != a or len(b) <= len(a) for a, b in zip(features, features[1:], strict=False)):
        raise ValueError("each profile must add features to the one before")
    document = {"tables": found, "configuration": frozen.get("configuration", {}), "profiles": {n: asdict(m) | {"digest": m.digest()} for n, m in models.items()}}
    digest = hashlib.sha256(json.dumps(document, sort_keys=True).encode()).hexdigest()
    save_document(document | {"digest": digest}, path)
    return digest


def score_table(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """(photo_id, iqa) of one dataset from a JSON map dataset -> photo -> score."""
    raw = spark.read.option("wholetext", True).text(path).select(F.from_json("value", "map<string,map<string,double>>").alias("m"))
    return raw.select(F.explode(F.element_at("m", dataset)).alias("photo_id", "iqa"))


def with_scores(rows: DataFrame, scores: DataFrame, budget: str) -> DataFrame:
    """rows with iqa where all rows of their budget unit have a score; null for the whole unit otherwise."""
    held = rows.join(scores, "photo_id", "left")
    whole = held.groupBy(budget).agg(F.bool_and(F.col("iqa").isNotNull()).alias("_all"))
    return held.join(whole, budget).select(*rows.columns, F.when(F.col("_all"), F.col("iqa")).alias("iqa"))


def provenance(files: DataFrame, settings: dict) -> DataFrame:
    """One row: number of sources, a digest of their ids in any order, and the settings as JSON."""
    part = files.groupBy(F.substring("photo_id", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.sort_array(F.collect_list("photo_id")), ""), 256).alias("h"), F.count(F.lit(1)).alias("n"))
    return part.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("sources"), F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("digest")).withColumn("settings", F.lit(json.dumps(settings, sort_keys=True)))
