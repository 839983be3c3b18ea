"""Quality rules: counts over words and lines, and Jensen-Shannon distance to language references.

References come from the whole table: for each language the histogram of character classes, and that of words in lower
case: the common ones (a share of at least 1 in 500 of the language's words, so 500 at most) and one bin for all others.
The distance of a document to its language's reference is the Jensen-Shannon distance (square root of the divergence in
bits, 0 to 1). What is far follows from the documents themselves: those of one language and one power of two of words
have a median distance and a median deviation from it, and a document is rejected where its distance exceeds the median
by ``spread`` robust standard deviations and ``class_ratio`` (``word_ratio``) times. Texts of too few words have no
distances and are judged by the rules only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, discard

CLASSES = ("lower", "upper", "digit", "blank", "mark", "symbol", "other")
SYMBOLS = "#*$%&|<>"
_FIND = re.compile(WORD).findall
_LETTERS = re.compile(r"[^\W\d_]+").findall
MIN_SHARE = 1 / 500
LANGUAGE_SHARE = 1 / 1000
HELD_WORDS = 200_000


def _class_table() -> np.ndarray:
    """Class number of each code point below 0x3000; letters without case count as lower."""
    out = np.full(0x3001, 6, np.uint8)
    for p in range(0x3000):
        c = chr(p)
        if c in SYMBOLS:
            out[p] = 5
        elif c.isupper():
            out[p] = 1
        elif c.isalpha():
            out[p] = 0
        elif c.isdigit():
            out[p] = 2
        elif c.isspace():
            out[p] = 3
        elif 0x20 < p < 0x7F or c.isprintable():
            out[p] = 4
    out[0x3000] = 0
    return out


_TABLE = _class_table()


def class_counts(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.bincount(_TABLE[np.minimum(points, 0x3000)], minlength=7)


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the contract."""
    words = _FIND(text)
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif _FIND(line[:200]) or _FIND(line):
            seen.add(line)
    repeat = 0
    m = len(words) - 4
    if m > 1:
        number: dict[str, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        # exact five-word windows: pairs, then pairs of pairs, get dense numbers, so nothing overflows
        two = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
        if two.max() + 1 < len(two):
            four = np.unique(two[:-2] * len(two) + two[2:], return_inverse=True)[1]
            five = np.unique(four[:m] * len(number) + ids[4:], return_inverse=True, return_counts=True)
            repeat = int(_covered(five[2][five[1]] > 1))
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat


def _covered(window: np.ndarray) -> int:
    """Words that lie in a marked five-word window."""
    edge = np.zeros(len(window) + 5, np.int64)
    edge[:-5] += window
    edge[5:] -= window
    return int((np.cumsum(edge)[:-1] > 0).sum())


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of a histogram to a reference; 0 where the reference is empty, 1 where only the other is."""
    if not q.sum():
        return 0.0
    if not p.sum():
        return 1.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    part = lambda x: float((x[x > 0] * np.log2(x[x > 0] / m[x > 0])).sum())
    return max(0.0, (part(p) + part(q)) / 2) ** 0.5


def references(docs: DataFrame) -> dict[str, tuple[np.ndarray, dict[str, float]]]:
    """{lang: (class counts, {common word: count, "": count of all words})} over all rows.

    Languages of at least LANGUAGE_SHARE of the rows have one, 1000 at most; 'und' is that of all rows, for the others.
    """

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        classes: dict[str, np.ndarray] = {}
        rows: Counter = Counter()

        def told() -> pd.DataFrame:
            out = [(k, 0, CLASSES[c], int(n)) for k, x in classes.items() for c, n in enumerate(x)]
            out += [(k, 1, w, n) for k, x in words.items() for w, n in x.items()]
            out += [(k, 2, "", n) for k, n in rows.items()]
            for held in (words, classes, rows):
                held.clear()
            return pd.DataFrame(out, columns=["lang", "kind", "item", "n"])

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                rows[lang] += 1
                words.setdefault(lang, Counter()).update(_LETTERS(text.lower()))
                classes[lang] = classes.get(lang, 0) + class_counts(text)
            if sum(map(len, words.values())) > HELD_WORDS:
                yield told()
        yield told()

    given = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = given.mapInPandas(gather, "lang string, kind int, item string, n long").groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    counts = cut(counts, "quality-counts")
    own = counts.filter("kind = 2").select("lang", F.col("n").alias("rows"))
    large = own.filter(F.col("rows") >= LANGUAGE_SHARE * F.lit(float(own.agg(F.sum("rows")).first()[0] or 0))).filter("lang != 'und'").select("lang")
    each = counts.filter("kind < 2").join(large, "lang", "left_semi").unionByName(counts.filter("kind < 2").groupBy("kind", "item").agg(F.sum("n").alias("n")).withColumn("lang", F.lit("und")))
    total = each.groupBy("lang", "kind").agg(F.sum("n").alias("all"))
    common = each.join(total, ["lang", "kind"]).filter((F.col("kind") == 0) | (F.col("n") >= F.col("all") * MIN_SHARE))
    out: dict[str, tuple[np.ndarray, dict[str, float]]] = {}
    for r in common.orderBy("lang", "kind", "item").collect():  # 507 rows a language at most
        classes, words = out.setdefault(r["lang"], (np.zeros(7), {"": 0.0}))
        if r["kind"]:
            words[r["item"]], words[""] = float(r["n"]), float(r["all"])
        else:
            classes[CLASSES.index(r["item"])] = r["n"]
    discard(counts)
    return out


def judge(docs: DataFrame, refs: dict | None = None, min_chars_words: int = 50, min_word_words: int = 50, spread: float = 4.0, class_ratio: float = 2.0, word_ratio: float = 1.2) -> DataFrame:
    """The columns of query op3, and class_distance and word_distance (null where the text is too short for one).

    Null text has no words and fails; null lang and languages without a reference are compared with 'und', all rows.
    Null doc_ids and repeated rows are kept; an empty table gives an empty result; other columns are left out; a text of
    any length is read whole.
    """
    refs = references(docs) if refs is None else refs

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = {}
        for k, (classes, words) in refs.items():
            names = [w for w in words if w]
            shares = np.array([words[w] for w in names] + [max(0.0, words[""] - sum(words[w] for w in names))])
            known[k] = (classes, {w: i for i, w in enumerate(names)}, shares)
        for batch in batches:
            rows = []
            for text, lang in zip(batch["text"].fillna(""), batch["lang"].fillna("und"), strict=True):
                n, chars, symbols, dup, repeat = base_counts(text)
                failed = n < 10 or 100 * repeat > 20 * n
                lang = lang if lang in known else "und"
                ref = known.get(lang)
                by_class = by_word = None
                if ref is not None and n >= min_chars_words:
                    by_class = distance(class_counts(text).astype(float), ref[0])
                if ref is not None and n >= min_word_words:
                    mine = np.zeros(len(ref[2]))
                    for w, k in Counter(_LETTERS(text.lower())).items():
                        mine[ref[1].get(w, -1)] += k
                    by_word = distance(mine, ref[2])
                rows.append((n, chars, symbols, dup, repeat, failed, by_class, by_word, lang, n.bit_length()))
            out = pd.DataFrame(rows, columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", "group", "size"])
            out[["class_distance", "word_distance"]] = out[["class_distance", "word_distance"]].astype(float).round(3)
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
            yield out

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, class_distance double, word_distance double, group string, size int"
    scored = docs.select("doc_id", "text", "lang").mapInPandas(score, schema)
    number = lambda c: F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c)
    scored = cut(scored.select(*[c for c in scored.columns if "distance" not in c], number("class_distance"), number("word_distance")), "quality-scores")
    # distances have three decimals, so the exact percentiles keep a thousand counts a group at most
    sound = scored.filter("not base_failed")
    middle = sound.groupBy("group", "size").agg(F.percentile("class_distance", 0.5).alias("mc"), F.percentile("word_distance", 0.5).alias("mw"))
    apart = lambda d, m: F.percentile(F.round(F.abs(F.col(d) - F.col(m)), 4), 0.5)
    off = sound.join(F.broadcast(middle), ["group", "size"]).groupBy("group", "size", "mc", "mw").agg(apart("class_distance", "mc").alias("dc"), apart("word_distance", "mw").alias("dw"))
    limit = lambda m, d, ratio: F.greatest(F.col(m) + spread * 1.4826 * F.col(d), F.col(m) * ratio)
    limits = off.select("group", "size", limit("mc", "dc", class_ratio).alias("class_limit"), limit("mw", "dw", word_ratio).alias("word_limit"))
    far = F.coalesce(F.col("class_distance") > F.col("class_limit"), F.lit(False)) | F.coalesce(F.col("word_distance") > F.col("word_limit"), F.lit(False))
    # one row a language (1000 at most, and 'und') and power of two: broadcast, so that no group meets in one task
    judged = scored.join(F.broadcast(limits), ["group", "size"], "left").withColumn("kept", ~F.col("base_failed") & ~far)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")
