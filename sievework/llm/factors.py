"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's inputs are its words (in lower case) and their shapes (kinds of characters, a run once), hashed and weighted by
1 + log count, each kind of unit length; one input for the size class of each structure statistic (shares of symbols, capitals, digits, repeats and so
on); and one for the size class of n_chars, or for its absence. Every input has a weight and ``rank`` factors; inputs
meet in pairs through the products of their factors. The sum over all pairs is half the difference between the square
of the sum and the sum of the squares of each factor, so a text costs as much as it has inputs. Weights are fitted by
MLlib's FMClassifier on a bounded sample of labelled texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import FMClassifier
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, hashed_sample
from .quality import _TABLE, CLASSES

WORDS, SHAPES = 1 << 14, 1 << 10  # hashed places
WORD_SHARE = 0.2  # length of the hashed words (and of the shapes) beside statistics of 1
STEPS = 12  # size classes of a statistic, and one for absence
SHARES = ("upper", "digit", "blank", "mark", "symbol", "other")
STATISTICS = (*SHARES, "words", "word_length", "distinct_words", "top_word", "repeated_pairs", "lines", "line_length", "repeated_lines", "n_chars")
INPUTS = WORDS + SHAPES + len(STATISTICS) * (STEPS + 1)
SHAPE_RUNS = 12
BLOCK_CHARS = 1 << 20
_LOWER = np.array([ord(chr(p).lower()) if len(chr(p).lower()) == 1 else p for p in range(0x3000)], np.uint64)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)  # multipliers of the hashes


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _ODD[1]
    return h ^ (h >> np.uint64(29))


def _runs(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run of values (runs begin at starts), order included."""
    place = np.arange(len(values)) - np.repeat(starts, np.diff(np.append(starts, len(values))))
    powers = np.ones(int(place.max(initial=0)) + 1, np.uint64)
    powers[1:] = _ODD[0]
    return _mixed(np.add.reduceat((values + np.uint64(1)) * np.multiply.accumulate(powers)[place], starts))


def _counted(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, key, count) of the distinct keys of each document, by document."""
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])
    at = np.flatnonzero(new)
    return doc[at], key[at], np.diff(np.append(at, len(key)))


def _weighted(doc: np.ndarray, slot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, slot, 1 + log count), the values of a document of unit length together."""
    doc, slot, count = _counted(doc, slot)
    value = 1 + np.log(count)
    return doc, slot.astype(np.int64), WORD_SHARE * value / np.sqrt(np.bincount(doc, value**2, n))[doc]


def inputs(texts: list[str], n_chars: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, place, value) of all inputs of some texts, in this order; n_chars is nan where unknown."""
    n = len(texts)
    size = np.array(list(map(len, texts)), np.int64)
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(n), size + 1)
    kind = _TABLE[np.minimum(points, 0x3000)]
    by_kind = np.bincount(doc * len(CLASSES) + kind, minlength=n * len(CLASSES)).reshape(n, len(CLASSES)).astype(float)
    by_kind[:, CLASSES.index("blank")] -= 1  # the line end after each text

    inside = ~((points == 0x20) | ((points >= 0x09) & (points <= 0x0D)))
    line = np.cumsum(np.append(0, points[:-1] == 0x0A))[inside]
    begins = (inside & ~np.append(False, inside[:-1]))[inside]
    points, kind, doc = points[inside], kind[inside], doc[inside]
    starts = np.flatnonzero(begins)
    facts = dict.fromkeys(STATISTICS, np.zeros(n))
    parts = []
    if len(starts):
        low = np.where(points < 0x3000, _LOWER[np.minimum(points, 0x2FFF)], points.astype(np.uint64))
        word, of, line = _runs(low, starts), doc[starts], line[starts]
        parts.append(_weighted(of, word % np.uint64(WORDS), n))
        turn = begins | np.append(True, kind[1:] != kind[:-1])
        turns = np.flatnonzero(turn)
        first = np.searchsorted(turns, starts)
        near = np.arange(len(turns)) - np.repeat(first, np.diff(np.append(first, len(turns)))) < SHAPE_RUNS
        d, slot, value = _weighted(of, _runs(kind[turns][near].astype(np.uint64), np.searchsorted(np.flatnonzero(near), first)) % np.uint64(SHAPES), n)
        parts.append((d, slot + WORDS, value))

        words, chars = np.bincount(of, minlength=n), np.bincount(doc, minlength=n)
        d, _, count = _counted(of, word)
        top = np.zeros(n)
        np.maximum.at(top, d, count)
        pair = of[1:] == of[:-1]
        e, _, twice = _counted(of[1:][pair], _mixed(word[:-1] * _ODD[2] + word[1:])[pair])
        heads = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        f, _, same = _counted(of[heads], _runs(word, heads))
        lines = np.bincount(of[heads], minlength=n)
        some = lambda x: np.maximum(x, 1)
        facts |= {
            "words": words, "word_length": 10 * chars / some(words), "distinct_words": 1000 * np.bincount(d, minlength=n) / some(words), "top_word": 1000 * top / some(words),
            "repeated_pairs": 1000 * np.bincount(e, twice * (twice > 1), n) / some(words), "lines": lines, "line_length": 10 * words / some(lines),
            "repeated_lines": 1000 * (lines - np.bincount(f, minlength=n)) / some(lines),
        }
    facts |= {c: 1000 * by_kind[:, CLASSES.index(c)] / np.maximum(size, 1) for c in SHARES} | {"n_chars": n_chars}
    for j, name in enumerate(STATISTICS):
        x = np.asarray(facts[name], float)
        step = np.where(np.isnan(x), STEPS, np.minimum(np.log2(1 + np.maximum(np.nan_to_num(x), 0)), STEPS - 1)).astype(np.int64)
        parts.append((np.arange(n), WORDS + SHAPES + j * (STEPS + 1) + step, np.full(n, 1.0)))
    document, place, value = map(np.concatenate, zip(*parts, strict=True))
    order = np.lexsort((place, document))
    return document[order], place[order], value[order]


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK_CHARS; a longer text is a run of its own."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        if held and held + len(t) > BLOCK_CHARS:
            yield start, k
            start, held = k, 0
        held += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


@dataclass(frozen=True)
class Model:
    """bias, weights (INPUTS) and factors (INPUTS, rank)."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, document: np.ndarray, place: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each document, the pairs' sum by the squares of sums less the sums of squares."""
        starts = np.flatnonzero(np.append(True, document[1:] != document[:-1]))
        each = self.factors[place] * value[:, None]
        pairs = (np.add.reduceat(each, starts) ** 2 - np.add.reduceat(each**2, starts)).sum(1) / 2
        x = self.bias + np.add.reduceat(self.weights[place] * value, starts) + pairs
        return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, at_most: int = 20_000, rank: int = 4, iterations: int = 60, step: float = 0.05, ridge: float = 3e-2, seed: int = 13) -> Model:
    """Model from about at_most labelled documents (documented bound; rows chosen by hash of doc_id).

    Rows without a label, text or doc_id teach nothing; a document labelled twice counts for its least label, and of
    documents with equal texts one counts. Without rows of both kinds every score is the share of label 1 (0.5 with none).
    """
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    marks = hashed_sample(marks, "doc_id", at_most)
    sample = docs.filter("text is not null").select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars")).join(F.broadcast(marks), "doc_id")
    sample = sample.select("text", "n_chars", F.xxhash64("text").alias("h"), (F.col("quality") > 0).cast("double").alias("label"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, sizes = batch["text"].tolist(), batch["n_chars"].to_numpy(float, na_value=np.nan)
            for a, b in _blocks(texts):
                document, place, value = inputs(texts[a:b], sizes[a:b])
                cuts = np.flatnonzero(np.diff(document)) + 1
                yield pd.DataFrame({"h": batch["h"].iloc[a:b], "label": batch["label"].iloc[a:b], "places": np.split(place, cuts), "values": np.split(value, cuts)})

    given = sample.mapInPandas(read, "h long, label double, places array<int>, values array<double>")
    given = cut(given.groupBy("h").agg(F.min(F.struct("label", "places", "values")).alias("x")).select("x.*"), "quality-sample")
    counts = {r["label"]: r["n"] for r in given.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        discard(given)
        share = (counts.get(1.0, 0) + 1) / (sum(counts.values()) + 2)
        return Model(math.log(share / (1 - share)), np.zeros(INPUTS), np.zeros((INPUTS, rank)))
    vector = F.udf(lambda p, v: Vectors.sparse(INPUTS, p, v), VectorUDT())
    learner = FMClassifier(featuresCol="x", labelCol="label", factorSize=rank, maxIter=iterations, stepSize=step, regParam=ridge, initStd=0.05, seed=seed, solver="adamW", tol=1e-5)
    made = learner.fit(given.select("label", vector("places", "values").alias("x")))
    discard(given)
    return Model(float(made.intercept), made.linear.toArray(), made.factors.toArray())


def classify(docs: DataFrame, model: Model, held_out: Column, least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; predicted is 1 where the score is at least ``least``.

    Null and empty texts have no words and the least size classes; null n_chars is an input of its own. Null doc_ids and
    repeated rows are kept; an empty table gives no rows; a text of any length is read whole; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, sizes = batch["text"].fillna("").tolist(), batch["n_chars"].to_numpy(float, na_value=np.nan)
            scores = np.concatenate([shared.value.scores(*inputs(texts[a:b], sizes[a:b])) for a, b in _blocks(texts)] or [np.zeros(0)])
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": scores, "predicted": (scores >= least).astype("int32")})

    given = docs.select("doc_id", "text", F.col("n_chars").cast("long").alias("n_chars"), held_out.alias("held_out"))
    return given.mapInPandas(rate, "doc_id long, held_out boolean, score double, predicted int")
