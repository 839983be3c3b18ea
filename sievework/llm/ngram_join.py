"""N-gram Jaccard join: MinHash banding finds candidates, full sets of word n-grams decide.

Texts that are equal form a class; only classes are compared. Each text's set of five-word shingles is min-hashed;
bands and rows are chosen so that a pair at the threshold shares a band with probability ``recall``. Band hashes are
shuffled and grouped; members of a bucket are tied to its least member (never paired with each other), and connected
components of these ties hold every candidate pair. A component is verified as a whole where it is small. In a larger
one every member is first compared with one pivot: Jaccard distance is a metric, so members within half of the allowed
distance of the pivot are all linked to each other, which settles a group of close copies in linear work. Members
further off are dealt into blocks, and pairs of blocks of them, and of them and the others they can still be linked to,
are verified in tasks of their own by products of incidence matrices. No group meets in one task, and no list of all
its pairs is made; blocks are bounded in texts and in characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, cut, discard
from .components import connected_components

_FIND = re.compile(WORD).findall
_MIX = np.uint64(0x9E3779B97F4A7C15)


def choose_bands(threshold: float, recall: float, at_most: int = 128) -> tuple[int, int]:
    """(bands, rows) with the most rows a band, among at_most hashes, that find a pair at the threshold with that recall."""
    best = None
    for rows in range(1, 17):
        bands = int(np.ceil(np.log1p(-recall) / np.log1p(-(threshold**rows))))
        if bands * rows <= at_most:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding within at_most hashes reaches the recall")
    return best


class _Words(dict):
    """Random 64-bit number of a word, remembered."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return got


_WORDS = _Words()


def shingle_hashes(words: list[str], n: int) -> np.ndarray:
    """64-bit hashes of the distinct n-word shingles; fewer than n words are one shingle, none none."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    m = max(1, len(words) - n + 1)
    out = np.zeros(m, np.uint64)
    for k in range(min(n, len(words))):
        out = (out * _MIX) ^ (out >> np.uint64(29))
        out += h[k : k + m]
    out ^= out >> np.uint64(32)
    return out * _MIX


def minhash_bands(words: list[str], n: int, bands: int, rows: int, factors: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """One 64-bit number a band, bands apart; empty for no words."""
    h = shingle_hashes(words, n)
    if not len(h):
        return np.empty(0, np.int64)
    h = (h >> np.uint64(32)).astype(np.uint32)
    least = np.full(bands * rows, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(h), 512):
        part = h[at : at + 512, None] * factors + shifts
        np.minimum(least, part.min(0), out=least)
    out = np.arange(bands, dtype=np.uint64) * _MIX
    for k in range(rows):
        out = (out ^ least.reshape(bands, rows)[:, k]) * _MIX
        out ^= out >> np.uint64(31)
    return out.view(np.int64)


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, tid, bands): tid is a 128-bit hash of the text, null for a null text (which takes no part)."""
    rng = np.random.default_rng(6)
    factors = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    shifts = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            for batch in batches:
                found = [minhash_bands(_FIND(text or ""), n, bands, rows, factors, shifts) for text in batch["text"]]
                yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "tid": batch["tid"], "bands": found})
        finally:
            _WORDS.clear()  # a worker outlives its tasks

    return docs.select("doc_id", _tid().alias("tid"), "text").mapInPandas(sign, "doc_id long, tid binary, bands array<long>")


def _tid() -> Column:
    return F.unhex(F.md5(F.col("text").cast("binary")))


def gram_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) numbers of the distinct n-word shingles of texts, exact; fewer than n words are one shingle, none none."""
    words = [_FIND(t) for t in texts]
    known: dict[str, int] = {}
    flat = np.fromiter((known.setdefault(w, len(known)) for ws in words for w in ws), np.int64, sum(map(len, words)))
    row = np.repeat(np.arange(len(texts)), [len(ws) for ws in words])
    gram = flat
    for k in range(1, min(n, len(flat))):  # dense numbers of k-word runs make those of k + 1 words
        gram = np.unique(gram[:-1] * len(known) + flat[k:], return_inverse=True)[1]
    gram, start = gram[: max(0, len(flat) - n + 1)], row[: max(0, len(flat) - n + 1)]
    whole = start == row[n - 1 :] if len(flat) >= n else np.zeros(0, bool)
    pairs = np.unique(start[whole] * (int(gram.max(initial=0)) + 1) + gram[whole])
    rows, grams = np.divmod(pairs, int(gram.max(initial=0)) + 1)
    short: dict[tuple, int] = {}
    few = [(r, short.setdefault(tuple(ws), len(short))) for r, ws in enumerate(words) if 0 < len(ws) < n]
    if few:
        base = int(gram.max(initial=0)) + 1
        rows = np.append(rows, [r for r, _ in few])
        grams = np.append(grams, [base + g for _, g in few])
    return rows.astype(np.int64), grams.astype(np.int64)


def _verify(tids: list[bytes], texts: list[str], side: np.ndarray | None, n: int, threshold: float) -> list[tuple[bytes, int, bytes]]:
    """(tid, links, least tid it is tied to) of the texts with a link; side splits a pair of blocks."""
    rows, grams = gram_sets(texts, n)
    count = len(texts)
    sizes = np.bincount(rows, minlength=count).astype(float)
    often = np.bincount(grams, minlength=1) > 1
    place, shared = np.cumsum(often) - 1, often[grams] if len(grams) else np.zeros(0, bool)
    order = np.argsort(place[grams[shared]], kind="stable")
    row, col = rows[shared][order], place[grams[shared]][order]
    common = np.zeros((count, count), np.float32)
    for at in range(0, int(often.sum()), 4096):
        lo, hi = np.searchsorted(col, (at, at + 4096))
        wide = np.zeros((count, 4096), np.float32)
        wide[row[lo:hi], col[lo:hi] - at] = 1
        common += wide @ wide.T
    either = sizes[:, None] + sizes[None, :] - common
    link = (common >= threshold * either - 1e-9) & (common > 0)
    np.fill_diagonal(link, False)
    if side is not None:
        link &= side[:, None] != side[None, :]
    root = np.arange(count)
    while True:  # least row index of each connected part
        new = np.minimum(root, np.where(link, root[None, :], count).min(1, initial=count))
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    links = link.sum(1)
    return [(tids[r], int(links[r]), tids[root[r]]) for r in np.flatnonzero(links)]


def _from_pivot(large: DataFrame, n: int) -> DataFrame:
    """(tid, root, away): the Jaccard distance of every member of large (tid, root, text) from its component's root."""
    pivots = large.filter("tid = root").select("root", F.col("text").alias("pivot"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            away = []
            for pivot, part in batch.groupby("pivot", sort=False):
                rows, grams = gram_sets([pivot, *part["text"]], n)
                mine = np.zeros(int(grams.max(initial=0)) + 1, bool)
                mine[grams[rows == 0]] = True
                sizes = np.bincount(rows, minlength=len(part) + 1)
                common = np.bincount(rows[mine[grams]], minlength=len(part) + 1)
                away.append(pd.Series(1 - common[1:] / np.maximum(sizes[0] + sizes[1:] - common[1:], 1), index=part.index))
            yield batch[["tid", "root"]].assign(away=pd.concat(away) if away else pd.Series(dtype=float))

    return large.select("tid", "root", "text").join(pivots, "root").mapInPandas(compare, "tid binary, root binary, away double")


def similarity_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, block: int = 256, block_chars: int = 4_000_000) -> DataFrame:
    """(doc_id, tid, text_id, class_id, n_links) of every row.

    text_id is the least doc_id with the same text. n_links counts the other texts whose shingle sets have a Jaccard
    similarity of threshold or more. class_id is the least doc_id that such links, in any number of steps, and equal
    texts lead to; it is null where all of these are. A null text, and a text without words other than its equal copies,
    has no links; a null text is its own class. Rows that repeat a doc_id are kept, each with its own text's class; an
    empty table gives an empty result; a text of any length is compared whole; other columns are left out.
    """
    bands, rows = choose_bands(threshold, recall)
    signed = cut(signatures(docs, n, bands, rows), "bands")
    texts = signed.filter("tid is not null").groupBy("tid").agg(F.min("doc_id").alias("text_id"), F.first("bands").alias("bands"))
    spots = cut(texts.select("tid", F.explode("bands").alias("spot")), "spots")
    hubs = spots.groupBy("spot").agg(F.min("tid").alias("hub"), F.count(F.lit(1)).alias("held")).filter("held > 1").select("spot", "hub")
    ties = spots.join(hubs, "spot").filter("tid != hub").select(F.col("tid").alias("u"), F.col("hub").alias("v"))
    parts = connected_components(ties, "candidates")
    members = texts.select("tid", "text_id").join(parts.select(F.col("node").alias("tid"), "root"), "tid")
    held = docs.filter("text is not null").select("doc_id", _tid().alias("tid"), "text")
    members = members.select(F.col("tid").alias("_tid"), "text_id", "root").hint("shuffle_hash")
    whole = held.join(members, (F.col("tid") == F.col("_tid")) & F.col("doc_id").eqNullSafe(F.col("text_id"))).select("tid", "root", "text").dropDuplicates(["tid"])
    whole = cut(whole, "members")
    chars = F.sum(F.length("text").cast("long"))
    sizes = whole.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), chars / F.lit(block_chars))).cast("int").alias("blocks"))
    bundles = max(1, -(-(whole.agg(chars).first()[0] or 0) // block_chars))
    sized = whole.join(sizes, "root")
    small = sized.filter("blocks = 1").select("tid", "text", "root", F.lit(0).alias("side"), F.lit(False).alias("split"), F.pmod(F.xxhash64("root"), F.lit(bundles)).alias("_key"), F.xxhash64("root").alias("_part"))
    large = cut(_from_pivot(sized.filter("blocks > 1"), n), "pivots")
    half = (1 - threshold) / 2 - 1e-9
    near = F.col("away") <= half
    counts = large.groupBy("root").agg(F.count_if(near).alias("close"))
    # close members are linked with each other: so many links, and the pivot ties them
    sure = large.filter(near).join(counts, "root").filter("close > 1").select("tid", (F.col("close") - 1).alias("links"), F.col("root").alias("least"), F.lit(True).alias("split"))
    dealt, big = small, sized.filter("blocks > 1").join(large.select("tid", "away"), "tid")
    share = F.ceil(F.greatest(F.count(F.lit(1)) / F.lit(block), chars / F.lit(block_chars))).cast("int")
    far_blocks = big.filter(~near).groupBy("root").agg(share.alias("far"))
    close_blocks = big.filter(near).groupBy("root").agg(share.alias("near"))
    own = lambda blocks: F.pmod(F.xxhash64("tid"), F.col(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    columns = ["tid", "text", "root", "side", "split", "_key", "_part"]
    spread = lambda df, side, key: df.select("tid", "text", "root", side.alias("side"), F.lit(True).alias("split"), key.alias("_key"), key.alias("_part")).select(columns)
    far = big.filter(~near).join(far_blocks, "root").select("tid", "text", "root", "away", "far", own("far").alias("own"))
    met = far.select("*", every("far").alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.unionByName(spread(met, F.when(low == high, 0).when(F.col("own") == low, 1).otherwise(2), F.xxhash64(F.lit("far"), "root", low, high)))
    # a far member can be linked to a close one only within the allowed distance and half of it of the pivot
    edge = far.filter(F.col("away") <= (1 - threshold) + half + 2e-9).join(close_blocks, "root").select("*", every("near").alias("other"))
    close = big.filter(near).join(close_blocks, "root").join(far_blocks, "root").select("*", own("near").alias("own"), every("far").alias("other"))
    dealt = dealt.unionByName(spread(edge, F.lit(1), F.xxhash64(F.lit("edge"), "root", "own", "other")))
    dealt = dealt.unionByName(spread(close, F.lit(2), F.xxhash64(F.lit("edge"), "root", "other", "own")))

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        for _, part in group.sort_values("tid").groupby(["root", "_part"]):
            side = part["side"].to_numpy()
            if len(part) > 1 and (not side.any() or len(set(side)) > 1):
                out += [(*x, bool(part["split"].iat[0])) for x in _verify(part["tid"].tolist(), part["text"].tolist(), side if side.any() else None, n, threshold)]
        return pd.DataFrame(out, columns=["tid", "links", "least", "split"])

    found = cut(dealt.groupBy("_key").applyInPandas(verify, "tid binary, links long, least binary, split boolean").unionByName(sure), "links")
    joined = connected_components(found.filter("split").select(F.col("tid").alias("u"), F.col("least").alias("v")), "classes").withColumnsRenamed({"node": "tid"})
    counted = found.groupBy("tid").agg(F.sum("links").alias("n_links"), F.min(F.when(~F.col("split"), F.col("least"))).alias("least"))
    rooted = texts.select("tid", "text_id").join(counted, "tid", "left").join(joined, "tid", "left")
    rooted = rooted.select("tid", "text_id", F.coalesce("root", "least", "tid").alias("root"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    rooted = cut(rooted, "roots")
    discard(spots, whole, large, found)
    classes = rooted.groupBy("root").agg(F.min("text_id").alias("class_id"))
    known = rooted.join(classes, "root").select("tid", "text_id", "class_id", "n_links")
    mine = signed.select("doc_id", "tid").join(known, "tid", "left")
    return mine.select("doc_id", "tid", F.coalesce("text_id", "doc_id").alias("text_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def report(docs: DataFrame, **params) -> DataFrame:
    """The columns of query op6."""
    return similarity_classes(docs, **params).select("doc_id", "class_id", "text_id", "n_links")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """The rows of docs that stand for their class: those whose doc_id is the class's least, and rows with a null doc_id.

    Rows that repeat both doc_id and text stay once; rows of one doc_id with different texts all stay if it is kept.
    Null ids have no order, so none of their rows goes.
    """
    own = cut(similarity_classes(docs, **params).filter("doc_id = class_id").select(F.col("doc_id").alias("_sw_id")), "kept")
    # rows with a null id stay, whatever their number, and meet no key
    held = docs.filter("doc_id is not null").join(own.distinct().hint("shuffle_hash"), F.col("doc_id") == F.col("_sw_id"), "left_semi").select(docs.columns)
    again = own.groupBy("_sw_id").count().filter("count > 1")
    held = held if again.isEmpty() else held.dropDuplicates(["doc_id", "text"])
    return held.unionByName(docs.filter("doc_id is null"))
