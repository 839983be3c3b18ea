"""Toxicity by maximum-scoring segments.

Token scores are log-odds between toxic and other labelled texts under an informative Dirichlet prior (the pooled word
shares), over the distinct words of distinct texts, so that copies don't count. Every word and five-letter stem has one,
positive or negative, times 1 - shrink^2 / G, where G is the likelihood ratio of its counts (so that what may be chance
scores 0); all tokens that score 0 share the log-odds of their class as a cost, ``step`` at least. A linear scan finds every maximal segment with a positive sum.
Segment scores of ordinary text follow an extreme-value law: lambda solves sum p exp(lambda s) = 1 over the shares p of
ordinary tokens, and a text of n tokens reaches S by chance with probability 1 - exp(-K n exp(-lambda S)), with K by
maximum likelihood on texts that aren't toxic. The segments of a text are combined by the sum law of the same theory:
the evidence is -log10 of the least chance of its r best segments together. The score is a logistic curve of the evidence.
K and the curve are fitted on folds of the sample whose word scores come from the other folds.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, hashed_sample

_TOKENS = re.compile(r"[^\W\d_]+")
STEM = 5


def _features(text: str) -> set[str]:
    """Distinct words of a text, and the stems (first STEM letters, marked *) of the longer ones."""
    words = set(_TOKENS.findall(text.lower()))
    return words | {f"{w[:STEM]}*" for w in words if len(w) > STEM}


@dataclass(frozen=True)
class Model:
    """scores: log-odds of words and stems; step: cost of any other token; lam, k: extreme-value law; a, b: the curve."""

    scores: dict[str, float]
    step: float = 0.05
    lam: float = 1.0
    k: float = 0.1
    a: float = 1.0
    b: float = -3.0

    def __post_init__(self) -> None:
        object.__setattr__(self, "known", _Scores(self.scores))


class _Scores(dict):
    """Score of any word: its own, else its stem's, else 0; answers are remembered up to a bound."""

    def __init__(self, scores: dict[str, float]) -> None:
        super().__init__(scores)
        self.scores = scores

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
            self.update(self.scores)
        got = self[word] = self.scores.get(f"{word[:STEM]}*", 0.0) if len(word) > STEM else 0.0
        return got

    def __reduce__(self):
        return _Scores, (self.scores,)


def segments(values: list[tuple[int, float]], n: int, step: float) -> list[tuple[int, int, float]]:
    """All maximal segments (first, end, sum) of n tokens that cost step, but for the places and scores in values.

    Ruzzo and Tompa's scan: candidates keep the sums left of and through them; one that extends an earlier candidate
    swallows it. Places without a value only lower the running sum.
    """
    kept: list[tuple[int, int, float, float]] = []
    total, done = 0.0, 0
    for at, value in values:
        total -= step * (at - done)
        done = at + 1
        if value <= 0:
            total += value
            continue
        first, end, low, high = at, at + 1, total, total + value
        total = high
        while kept:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j -= 1
            if j < 0 or kept[j][3] >= high:
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
        kept.append((first, end, low, high))
    return [(f, e, high - low) for f, e, low, high in kept]


def evidence(model: Model, scores: list[float], n: int, most: int = 8) -> float:
    """-log10 (0 to 300) of the least chance, over r, that ordinary text of n tokens has r segments with these sums."""
    best, total = 0.0, 0.0
    for r, score in enumerate(sorted((s for s in scores if s > 0), reverse=True)[:most], 1):
        if n == 0:
            break
        one = min(model.lam * score, 700) - math.log(max(model.k * n, 1e-300))
        total += one
        if r == 1:
            p = -math.expm1(-math.exp(-max(-700.0, one)) if one > -700 else -700)
            best = -math.log10(p) if p > 0 else 300.0
        elif one <= 0:
            break
        elif total > r - 1:  # chance of a sum of r normalised scores, times 2^r for the choice of r
            best = max(best, (total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r)) / math.log(10) - r * math.log10(2))
    return min(300.0, max(0.0, best))


def raw_segments(model: Model, text: str) -> tuple[int, list[tuple[int, int, float]]]:
    """(tokens, maximal segments with their sums) of a text."""
    tokens = _TOKENS.findall(text.lower())
    hits = [(i, s) for i, s in enumerate(map(model.known.__getitem__, tokens)) if s]
    return len(tokens), segments(hits, len(tokens), model.step)


def scan(model: Model, text: str) -> tuple[float, list[tuple[int, int, float]]]:
    """(evidence of the text, segments in code points with the evidence of each alone)."""
    n, found = raw_segments(model, text)
    if not found:
        return 0.0, []
    places = [m.span() for m in _TOKENS.finditer(text)]
    if len(places) != n:  # a lower-case form of another length
        places = [(0, len(text))] * n
    return evidence(model, [s for *_, s in found], n), [(places[f][0], places[e - 1][1], evidence(model, [s], n)) for f, e, s in found]


def _rate(spread: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum share exp(root * spread) = 1 by halving; 1 where there is none."""
    low, high = 1e-6, 1.0
    value = lambda x: float((share * np.exp(np.minimum(x * spread, 600))).sum()) - 1
    while value(high) < 0 and high < 64:
        high *= 2
    if value(high) < 0:
        return 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 0 else (low, mid)
    return high


def _scored(counted: pd.DataFrame, n0: float, n1: float, prior: float, shrink: float) -> tuple[pd.Series, float, float]:
    """(shrunk log-odds that aren't 0 by term, cost of other tokens, lambda) from texts with a term, other (n0) and toxic (n1)."""
    own = (counted["n0"] + counted["n1"]) * (prior / (n0 + n1))
    y0, y1 = counted["n0"] + own, counted["n1"] + own
    odds = np.log(y1 / (n1 + prior - y1)) - np.log(y0 / (n0 + prior - y0))
    both = counted["n0"] + counted["n1"]
    part = lambda c, n: np.where(c > 0, c * np.log(np.maximum(c, 1e-300) * (n0 + n1) / (both * n)), 0.0)
    ratio = np.maximum(2 * (part(counted["n0"], n0) + part(counted["n1"], n1)), 0)
    held = odds * np.maximum(1 - shrink**2 / np.maximum(ratio, 1e-12), 0)
    kept = held[held != 0]
    rest1, rest0 = n1 - counted["n1"][kept.index].sum(), n0 - counted["n0"][kept.index].sum()
    step = max(0.05, -math.log(max(rest1, 1) / n1) + math.log(max(rest0, 1) / n0))
    share = (counted["n0"][kept.index] + 0.5) / n0
    spread = np.append(kept.to_numpy(), -step)
    return kept, step, _rate(spread, np.append(share.to_numpy(), max(0.0, 1 - share.sum())))


def fit(docs: DataFrame, labels: DataFrame, at_most: int = 30_000, prior: float = 300.0, shrink: float = 4.0, count_least: int = 4, folds: int = 4) -> Model:
    """Model from about at_most labelled documents (documented bound; rows chosen by hash of doc_id).

    So at_most bounds the terms and the rows that come to the driver, too. Terms of fewer than count_least texts score 0.
    Rows without a label, text or doc_id are left out, and a document labelled twice counts for its largest label; of
    documents with equal texts one counts. With no labels, or of one kind only, no word has a score and every score is low.
    """
    marks = hashed_sample(labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id", at_most)
    sample = docs.filter("text is not null").select("doc_id", "text").join(marks.hint("shuffle_hash"), "doc_id")
    sample = sample.groupBy("text").agg(F.max("toxic").alias("toxic")).select("text", "toxic", F.pmod(F.xxhash64("text"), F.lit(folds)).cast("int").alias("fold"))
    sample = cut(sample, "toxicity-sample")

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, list[int]] = {}
        for batch in batches:
            for text, toxic, fold in zip(batch["text"], batch["toxic"], batch["fold"], strict=True):
                for t in _features(text):
                    counts.setdefault(t, [0] * (2 * folds))[2 * fold + (toxic > 0)] += 1
        yield pd.DataFrame([(t, c) for t, c in counts.items()], columns=["t", "c"])

    parts = sample.mapInPandas(tokens, "t string, c array<long>").select("t", *[F.col("c")[k].alias(f"c{k}") for k in range(2 * folds)])
    sums = parts.groupBy("t").agg(*[F.sum(f"c{k}").alias(f"c{k}") for k in range(2 * folds)])
    counted = cut(sums, "toxicity-terms")
    totals = np.array(counted.agg(*[F.sum(f"c{k}") for k in range(2 * folds)]).first(), float).reshape(folds, 2) if not counted.isEmpty() else np.zeros((folds, 2))
    if not totals[:, 0].sum() or not totals[:, 1].sum():
        discard(sample, counted)
        return Model({})
    rows = counted.filter("+".join(f"c{k}" for k in range(2 * folds)) + f" >= {count_least}").toPandas().set_index("t")  # bounded by the sample
    by_fold = rows.to_numpy(float).reshape(len(rows), folds, 2)

    def model_without(fold: int | None) -> Model:
        use = [f for f in range(folds) if f != fold]
        if fold is not None and not totals[use].sum(0).all():
            use = list(range(folds))
        c = pd.DataFrame(by_fold[:, use].sum(1), index=rows.index, columns=["n0", "n1"])
        kept, step, lam = _scored(c[c.sum(1) > 0], *totals[use].sum(0), prior, shrink)
        return Model(kept.to_dict(), step, lam)

    final, others = model_without(None), [model_without(f) for f in range(folds)]

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, toxic, fold in zip(batch["text"], batch["toxic"], batch["fold"], strict=True):
                n, found = raw_segments(others[fold], text)
                out.append((float(toxic > 0), fold, n, sorted((s for *_, s in found), reverse=True)[:8]))
            yield pd.DataFrame(out, columns=["y", "fold", "n", "sums"])

    seen = sample.mapInPandas(rate, "y double, fold int, n long, sums array<double>").orderBy("y", "fold", "n", "sums").collect()  # at_most rows
    discard(sample, counted)
    if not final.scores:
        return Model({})
    law = [(len(r["sums"]) > 0, r["n"] * math.exp(-others[r["fold"]].lam * (r["sums"][0] if r["sums"] else 0.0))) for r in seen if not r["y"] and r["n"]]
    k = max(sum(hit for hit, _ in law), 0.5) / max(sum(x for _, x in law), 1e-9)
    held = [Model({}, m.step, m.lam, k) for m in others]
    x = np.array([evidence(held[r["fold"]], list(r["sums"]), r["n"]) for r in seen])
    return Model(final.scores, final.step, final.lam, k, *_curve(x, np.array([r["y"] for r in seen])))


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b), a > 0, of the logistic curve 1 / (1 + exp(-(a x + b))) of most likelihood, with a small ridge; x counts up to 30."""
    z = np.stack([np.minimum(x, 30.0), np.ones_like(x)], 1)
    w = np.array([0.5, -2.0])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
        slope = z.T @ (p - y) + 1e-2 * w
        bend = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        move = np.linalg.solve(bend, slope)
        w = w - move * min(1.0, 2.0 / max(np.abs(move).max(), 1e-12))
    return max(float(w[0]), 1e-3), float(w[1])


def classify(docs: DataFrame, model: Model, held_out: Column, chance: float = 1e-3) -> DataFrame:
    """(doc_id, held_out, score, predicted, passages) of every row; passages are start:end of those significant.

    Null and empty texts have no evidence and so the lowest score. Null doc_ids and repeated rows are kept; an empty
    table gives no rows; a text of any length is scanned whole; other columns are left out.
    """
    least = -math.log10(chance)

    def rate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch["text"].fillna(""):
                x, found = scan(model, text)
                s = 1 / (1 + math.exp(-max(-50.0, min(50.0, model.a * x + model.b))))
                rows.append((s, int(s >= 0.5), ",".join(f"{a}:{b}" for a, b, e in found if e >= least)))
            out = pd.DataFrame(rows, columns=["score", "predicted", "passages"])
            out.insert(0, "held_out", batch["held_out"].array)
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInPandas(rate, "doc_id long, held_out boolean, score double, predicted int, passages string")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model doesn't call toxic, in one pass over them; all columns stay as they are."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [t is None or model.a * scan(model, t)[0] + model.b < 0 for t in batch.column("text").to_pylist()]
            yield batch.filter(pc.fill_null(pa.array(ok, pa.bool_()), True))

    return docs.mapInArrow(clean, docs.schema)
