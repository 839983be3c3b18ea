"""Logistic models: inference as a column, training by MLlib, splits and folds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import sigmoid
from .ranking import running_total


def logistic(features: list[Column], mean: list[float], scale: list[float], weights: list[float], bias: float) -> Column:
    """Probability of a frozen model; a missing feature counts as 0 before scaling, the logit is kept within 30."""
    if not len(features) == len(mean) == len(scale) == len(weights):
        raise ValueError("features, mean, scale and weights must be of one length")
    terms = [(F.coalesce(x.cast("double"), F.lit(0.0)) - m) / s * w for x, m, s, w in zip(features, mean, scale, weights, strict=True)]
    return sigmoid(sum(terms, F.lit(float(bias))))


def hash_share(text: Column) -> Column:
    """The first 64 bits of SHA-256 over text as a share of 2^64."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / 2.0**64


def hash_split(key: Column, salt: str, train: float, validation: float) -> Column:
    """train, validation or test by the first 64 bits of SHA-256 over salt and key, as a share of 2^64."""
    share = hash_share(F.concat_ws(":", F.lit(salt), key.cast("string")))
    return F.when(share < train, "train").when(share < train + validation, "validation").otherwise("test")


def balanced_weights(rows: DataFrame, label: str) -> DataFrame:
    """weight: n / (2 n of the row's class)."""
    w = rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = w.agg(F.sum("_n")).first()[0] or 1
    return rows.join(F.broadcast(w), label).withColumn("weight", total / (2 * F.col("_n"))).drop("_n")  # two classes


def fit_pointwise(rows: DataFrame, features: list[str], label: str, l2: float = 0.045):
    """Class-balanced logistic regression with standardised features."""
    held = VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep").transform(balanced_weights(rows.fillna(0.0, features), label))
    return LogisticRegression(featuresCol="_x", labelCol=label, weightCol="weight", regParam=l2, maxIter=100).fit(held)


def pair_differences(rows: DataFrame, group: str, features: list[str], positive: Column) -> DataFrame:
    """Differences positive - negative inside each group, both signs, weighted 1 / (P N) so that groups count alike.

    A join on the group: meant for review groups of tens of rows, not for hot keys.
    """
    w = Window.partitionBy(group)
    held = rows.select(group, *features, positive.alias("_y"), F.count_if(positive).over(w).alias("_p"), F.count_if(~positive).over(w).alias("_n"))
    a, b = held.filter("_y").alias("a"), held.filter("not _y").alias("b")
    both = a.join(b, F.col(f"a.{group}") == F.col(f"b.{group}"))
    weight = 1.0 / (F.col("a._p") * F.col("a._n"))
    side = lambda s, y: both.select(F.col(f"a.{group}").alias(group), *[(s * (F.col(f"a.{f}") - F.col(f"b.{f}"))).alias(f) for f in features], F.lit(y).alias("label"), weight.alias("weight"))
    return side(1, 1.0).union(side(-1, 0.0))


@dataclass(frozen=True)
class PairwiseModel:
    """coefficients of the features, groups that had both kinds, and the loss reached."""

    coefficients: np.ndarray
    groups: int
    loss: float


def _sums_over(others: np.ndarray, at: np.ndarray, exact: int = 1 << 21, step: float = 1 / 64) -> tuple[np.ndarray, np.ndarray]:
    """Sum over others o of log(1 + exp(o - x)), and of its slope 1 / (1 + exp(x - o)), at each x of at.

    Few terms are summed one by one. Otherwise both sums, smooth functions of x, are computed on a grid and read off by
    cubics through values and slopes: the error is about 1e-11 of the sum.
    """

    def plain(x: np.ndarray, second: bool = False) -> list[np.ndarray]:
        out = []
        for lo in range(0, len(x), max(1, exact // max(len(others), 1))):
            z = others[None, :] - x[lo : lo + max(1, exact // max(len(others), 1)), None]
            s = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            out.append([np.logaddexp(0, z).sum(1), s.sum(1), (s * (1 - s)).sum(1) if second else s[:, 0]])
        return [np.concatenate(part) for part in zip(*out, strict=True)]

    if len(others) * len(at) <= exact:
        return tuple(plain(at)[:2])
    low, cells = at.min(), int(np.ceil((at.max() - at.min()) / step)) + 1
    grid = low + step * np.arange(cells + 1)
    total, slope, bend = plain(grid, True)
    k = np.minimum(((at - low) / step).astype(int), cells - 1)
    u = (at - grid[k]) / step

    def cubic(value: np.ndarray, change: np.ndarray) -> np.ndarray:
        a, b, c, d = value[k], step * change[k], value[k + 1], step * change[k + 1]
        return a + u * (b + u * (3 * (c - a) - 2 * b - d + u * (2 * (a - c) + b + d)))

    return cubic(total, -slope), cubic(slope, -bend)


def _descended(value: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, iterations: int, tolerance: float) -> tuple[np.ndarray, float]:
    """The point where a convex function is least, by limited-memory BFGS with halved steps."""
    loss, slope = value(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        if np.abs(slope).max() <= tolerance:
            break
        way, used = slope.copy(), []
        for s, y in reversed(past):
            used.append(s @ way / (y @ s))
            way -= used[-1] * y
        if past:
            way *= past[-1][0] @ past[-1][1] / (past[-1][1] @ past[-1][1])
        for (s, y), a in zip(past, reversed(used), strict=True):
            way += s * (a - y @ way / (y @ s))
        size = 1.0
        while size > 1e-10:
            new, at = value(x - size * way), x - size * way
            if new[0] <= loss - 1e-4 * size * (slope @ way):
                break
            size /= 2
        else:
            break
        if (at - x) @ (new[1] - slope) > 1e-14:
            past = [*past[-9:], (at - x, new[1] - slope)]
        x, (loss, slope) = at, new
    return x, loss


def fit_pairwise(rows: DataFrame, group: str, features: list[str], positive: Column, l2: float = 0.045, iterations: int = 100, tolerance: float = 1e-7) -> PairwiseModel:
    """Weights that put the positive rows of each group before the others, without listing the pairs.

    The least of the mean logistic loss of all pairs of a group, groups alike, plus l2 / 2 times the squared weights in
    units of the pairs' deviations: what logistic regression over pair_differences finds. A pass sends one row a group:
    a row's share in the slope is a sum over the other kind's scores, a smooth function of its own score. A group is one
    task; missing features count as 0. Groups of one kind only teach nothing; without others the weights are 0.
    """
    spark = rows.sparkSession
    x = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    held = rows.select(F.col(group).cast("string").alias("g"), x.alias("x"), F.coalesce(positive, F.lit(False)).alias("y")).repartition("g").persist()

    def summed(fold: Callable[[np.ndarray, np.ndarray], list[float]]) -> np.ndarray:
        def of(part: pd.DataFrame) -> pd.DataFrame:
            y = part["y"].to_numpy(bool)
            told = fold(*(lambda z: (z[y], z[~y]))(np.stack(part["x"].to_numpy()))) if y.any() and not y.all() else []
            return pd.DataFrame({"k": np.arange(len(told)), "v": np.array(told, float)})

        got = held.groupBy("g").applyInPandas(of, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()  # a few numbers
        out = np.zeros(len(got))
        for r in got:
            out[r["k"]] = r["v"]
        return out

    def moments(a: np.ndarray, b: np.ndarray) -> list[float]:
        return [1.0, 2 / (len(a) * len(b)), *(2 * ((a**2).mean(0) + (b**2).mean(0) - 2 * a.mean(0) * b.mean(0)))]

    try:
        facts = summed(moments)
        if not len(facts):
            return PairwiseModel(np.zeros(len(features)), 0, 0.0)
        weight = 2 * facts[0]
        deviation = np.sqrt(facts[2:] / max(weight - facts[1] / weight, 1e-300))

        def value(beta: np.ndarray) -> tuple[float, np.ndarray]:
            shared = spark.sparkContext.broadcast(beta)

            def slope(a: np.ndarray, b: np.ndarray) -> list[float]:
                s, t = a @ shared.value, b @ shared.value
                loss, up = _sums_over(t, s)  # of each positive over the others
                down = _sums_over(-s, -t)[1]  # of each other over the positives
                return [2 / (len(a) * len(b)) * v for v in (loss.sum(), *(down @ b - up @ a))]

            got = summed(slope) / weight
            shared.destroy()
            return got[0] + l2 / 2 * float(((beta * deviation) ** 2).sum()), got[1:] + l2 * beta * deviation**2

        scale = np.where(deviation > 0, deviation, 1.0)
        best, loss = _descended(lambda z: (lambda v, d: (v, d / scale))(*value(z / scale)), np.zeros(len(features)), iterations, tolerance)
        return PairwiseModel(best / scale, int(facts[0]), loss)
    finally:
        held.unpersist()


def cv_folds(groups: DataFrame, group: str, size: str, folds: int) -> DataFrame:
    """fold of each group: contiguous blocks of groups with about equal numbers of rows."""
    total = groups.agg(F.sum(size)).first()[0] or 1
    middle = F.col("_upto") - F.col(size) / 2
    return running_total(groups, [F.col(group)], F.col(size), "_upto").select(group, size, F.least(F.lit(folds - 1), F.floor(middle * folds / total)).cast("long").alias("fold"))


def hardest_negatives(rows: DataFrame, group: str, positive: Column, rank: str, score: str, name: str, most: int) -> DataFrame:
    """The first negatives of each group by rank, then score, then name."""
    w = Window.partitionBy(group).orderBy(F.col(rank), F.desc(score), F.lower(name))
    return rows.filter(~positive).select("*", F.row_number().over(w).alias("hardness")).filter(F.col("hardness") <= most)


def training_record(prompt: Column, answer: Column) -> Column:
    """A fine-tuning record as JSON."""
    turn = lambda who, what: F.struct(F.lit(who).alias("role"), what.alias("content"))
    return F.to_json(F.struct(F.array(turn("user", prompt), turn("assistant", answer)).alias("messages")))


def conversation_record(turns: Column) -> Column:
    """A fine-tuning record as JSON of sorted (turn, role, text) structs; null roles and texts stay as nulls."""
    message = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))
    return F.to_json(F.struct(F.transform(turns, message).alias("messages")), {"ignoreNullFields": "false"})


def sound_decision(ids: Column, ranks: Column, best: Column, rejected: Column, candidates: Column) -> Column:
    """Whether an outside ranking is whole: ids once each and just the candidates, ranks 1 to n, the best first, rejected ones known."""
    n = F.size(candidates)
    once = (F.size(F.array_distinct(ids)) == F.size(ids)) & (F.size(F.array_except(candidates, ids)) == 0) & (F.size(F.array_except(ids, candidates)) == 0)
    return once & (n > 0) & (F.sort_array(ranks) == F.sequence(F.lit(1), F.greatest(n, F.lit(1)))) & (F.get(ids, (F.array_position(ranks, F.lit(1)) - 1).cast("int")) == best) & (F.size(F.array_except(rejected, ids)) == 0)
