"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector is the product of its letters' vectors, each rotated
by its place; a text's profile is the sum of its n-grams' vectors. Language prototypes are sums of unit profiles of
labelled texts; a text gets the language whose prototype has the largest cosine with its profile.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hashed_sample

DIMENSIONS = 1024
BATCH_CHARS = 1 << 18
BATCH_TEXTS = 128
_BITS = 21  # of a code point


class Profiles:
    """Profiles of texts. Every letter has a vector of its own, drawn from its code point; anything else is a gap (code 0)."""

    def __init__(self, dimensions: int = DIMENSIONS, n: int = 3) -> None:
        self.d, self.n = dimensions, n
        self.letter = np.zeros(0x110000, bool)
        self.known = np.zeros(0x110000, bool)

    def _codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        new = np.unique(points[~self.known[points]])
        self.letter[new] = [unicodedata.category(chr(p))[0] == "L" for p in new.tolist()]
        self.known[new] = True
        return np.where(self.letter[points], points, 0).astype(np.int64)

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        """The vector of +1 and -1 of each code: mixed bits of (code, word), the same in every process."""
        kinds, at = np.unique(codes, return_inverse=True)
        words = -(-self.d // 64)
        x = (kinds.astype(np.uint64)[:, None] * np.uint64(words) + np.arange(words, dtype=np.uint64) + np.uint64(8)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).view(np.uint8), axis=1)[:, : self.d]
        return (2 * bits.astype(np.int8) - 1)[at]

    def _add(self, total: np.ndarray, c: np.ndarray, where: np.ndarray, block: int = 4096) -> None:
        """Add the vectors of the n-grams of codes c, each within one row of total; a block of kinds at a time."""
        gram = np.zeros(max(0, len(c) - self.n + 1), np.int64)
        inside = np.ones(len(gram), bool)
        for k in range(self.n):
            gram = (gram << _BITS) + c[k : k + len(gram)]
            inside &= where[k : k + len(gram)] == where[: len(gram)]
        row = where[: len(gram)][inside]
        kinds, gram = np.unique(gram[inside], return_inverse=True)
        order = np.argsort(gram, kind="stable")
        row, gram = row[order], gram[order]
        for lo in range(0, len(kinds), block):
            part = kinds[lo : lo + block]
            a, b = np.searchsorted(gram, (lo, lo + len(part)))
            counts = np.bincount(row[a:b] * len(part) + gram[a:b] - lo, minlength=len(total) * len(part)).reshape(len(total), len(part))
            bound = np.ones((len(part), self.d), np.int8)
            for k in range(self.n):  # the last letter isn't rotated, those before it by one place more each
                bound *= np.roll(self.vectors((part >> (_BITS * k)) & ((1 << _BITS) - 1)), k, 1)
            total += counts.astype(np.float32) @ bound.astype(np.float32)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(profiles, whether the text has a letter). Runs of gaps count as one; a text has a gap at both ends.

        Texts longer than BATCH_CHARS go slice by slice, with the codes that n-grams across the cut need.
        """
        total, some = np.zeros((len(texts), self.d), np.float32), np.zeros(len(texts), bool)
        short = [k for k, t in enumerate(texts) if len(t) <= BATCH_CHARS]
        padded = [f" {texts[k].lower()} " for k in short]
        codes, where = self._codes("".join(padded)), np.repeat(np.array(short, np.int64), np.array(list(map(len, padded)), np.int64))
        keep = codes != 0
        some[where[keep]] = True
        keep[:1] = True
        keep[1:] |= (codes[:-1] != 0) | (where[1:] != where[:-1])
        self._add(total, codes[keep], where[keep])
        for k in (k for k, t in enumerate(texts) if len(t) > BATCH_CHARS):
            text, before, carry = f" {texts[k].lower()} ", 1, np.zeros(0, np.int64)
            for at in range(0, len(text), BATCH_CHARS):
                codes = self._codes(text[at : at + BATCH_CHARS])
                some[k] |= bool(codes.any())
                c = np.concatenate([carry, codes[(codes != 0) | (np.append(before, codes[:-1]) != 0)]])
                before, carry = codes[-1], c[len(c) - self.n + 1 :] if len(c) >= self.n else c
                self._add(total[k : k + 1], c, np.zeros(len(c), np.int64))
        return total, some


def _batches(texts: list[str]) -> Iterator[tuple[int, int]]:
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t)
        if held >= BATCH_CHARS or k - start >= BATCH_TEXTS - 1:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


_MADE: dict[int, Profiles] = {}


def profiles(dimensions: int) -> Profiles:
    if dimensions not in _MADE:
        _MADE[dimensions] = Profiles(dimensions)
    return _MADE[dimensions]


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def fit(labelled: DataFrame, at_most: int = 20_000, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """Unit prototype of each language of labelled (doc_id, text, lang), from about at_most rows chosen by hash of doc_id.

    So at_most bounds the languages and what comes to the driver, too. Rows without text, lang or letters teach nothing.
    """
    rows = hashed_sample(labelled.filter("lang is not null and text is not null").select("doc_id", "text", "lang"), "doc_id", at_most)

    def bundle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in _batches(texts):
                found, some = profiles(dimensions).of(texts[a:b])
                for lang, x in zip(batch["lang"].iloc[a:b][some], _unit(found[some].astype(float)), strict=True):
                    total[lang] = total.get(lang, 0.0) + x
        yield pd.DataFrame({"lang": pd.Series([*total], dtype=object), "x": pd.Series([x.tolist() for x in total.values()], dtype=object)})

    parts = rows.mapInPandas(bundle, "lang string, x array<double>").select("lang", F.posexplode("x").alias("k", "v")).groupBy("lang", "k").agg(F.sum("v").alias("v"))
    out: dict[str, np.ndarray] = {}
    for r in parts.collect():  # languages x dimensions
        out.setdefault(r["lang"], np.zeros(dimensions))[r["k"]] = r["v"]
    return {k: _unit(v) for k, v in sorted(out.items())}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], held_out: Column, dimensions: int = DIMENSIONS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; score is the cosine with the prototype, at 0 where negative.

    Null texts, texts without a letter and an empty set of prototypes give `und` with score 0; equal cosines go to the
    first language by name. Null doc_ids and repeated rows are kept; an empty table gives no rows; a text of any length
    is read whole, in slices of bounded memory. Other columns are left out.
    """
    names = [*prototypes]
    table = np.array([prototypes[k] for k in names]).reshape(len(names), dimensions)

    def guess(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            lang, score = np.full(len(texts), "und", object), np.zeros(len(texts))
            for a, b in _batches(texts):
                found, some = profiles(dimensions).of(texts[a:b])
                if names:
                    cos = _unit(found.astype(float)) @ table.T
                    best = cos.argmax(1)
                    at = np.flatnonzero(some)
                    lang[a + at] = np.array(names, object)[best[at]]
                    score[a + at] = np.clip(cos[at, best[at]], 0, 1)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "lang_pred": lang, "score": score})

    return docs.select("doc_id", "text", held_out.alias("held_out")).mapInPandas(guess, "doc_id long, held_out boolean, lang_pred string, score double")
