"""Best-fit packing of documents into sequences under token, document-count and attention-cost limits.

Text becomes ids of a word-level BPE vocabulary with an end id after each document. Documents of more than
``capacity`` ids are cut into pieces of that length; those full pieces are sequences of their own and meet no others. The
rest, one piece a document at most, is dealt by hash into groups whose number follows theirs; in each group the pieces go,
longest first, to the open sequence where they fit best: by the smallest weighted norm of the residuals that would be
left ("norm"), or by the largest weighted dot product of the piece's needs and the residuals ("dot").
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# Characters whose lower case, normal form and letter class are alike in every Unicode version and library; a token with
# others goes to the library by itself.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-įĲ-ňŊ-ž]")
_TOKEN = re.compile(r"[^\t\n\r ]+")
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|(?:[^\w\s]|_)+")


class WordIds:
    """Ids of whole texts, by a bounded cache of the ids of blank-separated tokens.

    The pre-tokenizer never joins across blanks, so a text's ids are those of its tokens in a row. Tokens that the
    cache lacks are split into parts, and parts not met before are encoded together by byte merges of the same ranks.
    Tokens with characters outside the plain set or special-token strings are encoded by the tokenizers library.
    """

    def __init__(self, path: str, cached: int = 400_000) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.cached, self.tokens, self.parts = cached, {}, {}
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in told["added_tokens"]) or r"(?!)")
        vocabulary = told["model"]["vocab"]
        # The same merges over bytes: the word end is a blank after the word, which no word holds.
        signs = _byte_signs()
        ranks, self.ends = {}, np.zeros(max(vocabulary.values()) + 1, bool)
        for sign, n in vocabulary.items():
            stem, end = sign.removesuffix("</w>"), sign.endswith("</w>")
            if sign != "</w>" and all(c in signs for c in stem) and not self.special.fullmatch(sign):
                ranks[bytes(signs[c] for c in stem) + b" " * end] = n
                self.ends[n] = end
        free = max(vocabulary.values()) + 1
        for b in range(256):
            if bytes([b]) not in ranks:
                ranks[bytes([b])] = free
                free += 1
        self.coder = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})

    def forget(self) -> None:
        """Empty the caches: a worker outlives its tasks, and the next ones need its memory."""
        self.tokens, self.parts = {}, {}

    def _learn(self, tokens: list[str]) -> None:
        odd = [t for t in tokens if _PLAIN.search(t) or self.special.search(t)]
        for t, got in zip(odd, self.whole.encode_batch(odd, add_special_tokens=False) if odd else [], strict=True):
            self.tokens[t] = np.array(got.ids, "<u4").tobytes()
        tokens = [t for t in tokens if t not in self.tokens]
        split = [_PART.findall(t.lower()) for t in tokens]
        new = list(dict.fromkeys(p for s in split for p in s if p not in self.parts))
        if new:
            if len(self.parts) + len(new) > self.cached:
                self.parts = {}
                new = list(dict.fromkeys(p for s in split for p in s))
            ids = np.array(self.coder.encode_ordinary(" ".join(new) + " "), "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            raw, at = ids.tobytes(), 0
            for p, end in zip(new, (cuts * 4).tolist(), strict=True):
                self.parts[p] = raw[at:end]
                at = end
        for t, s in zip(tokens, split, strict=True):
            self.tokens[t] = b"".join([self.parts[p] for p in s])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text, without an end id."""
        out: list[bytes] = []
        for text in texts:
            tokens = _TOKEN.findall(text)
            missing = list(set(tokens).difference(self.tokens))
            if missing:
                if len(self.tokens) + len(missing) > self.cached:
                    self.tokens = {}
                    missing = list(set(tokens))
                self._learn(missing)
            out.append(b"".join(map(self.tokens.__getitem__, tokens)))
        return out


def _byte_signs() -> dict[str, int]:
    """The printable sign of each byte in byte-level vocabularies: itself if printable, else the next from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


_CODERS: dict[str, WordIds] = {}


def coder(path: str) -> WordIds:
    """One coder a worker and vocabulary."""
    if path not in _CODERS:
        _CODERS[path] = WordIds(path)
    return _CODERS[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, crc32 of its ids, and the ids where asked for.

    _again counts earlier rows of the batch with the same doc_id; it deals rows that repeat an id to several groups.

    Null and empty texts are one piece that holds the end id alone. Null doc_ids and repeated rows are kept.
    """
    path = vocabulary or vocabulary_path()

    def cut_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make, end = coder(path), np.array([end_id], "<u4").tobytes()
        try:
            for batch in batches:
                rows = []
                again = batch.groupby("doc_id", dropna=False).cumcount()
                for doc, raw, salt in zip(batch["doc_id"].array, make.encode(batch["text"].fillna("").tolist()), again, strict=True):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), salt, *([np.frombuffer(part, "<u4").astype("int32")] * with_ids)))
                yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "_again", *["ids"] * with_ids]).astype({"doc_id": "Int64"})
        finally:
            make.forget()

    return docs.select("doc_id", "text").mapInPandas(cut_up, PIECES + ", _again int" + (", ids array<int>" if with_ids else ""))


def best_fit(length: np.ndarray, limits: tuple[float, float, float], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece of one group; length must be sorted, longest first.

    Needs of a piece: its tokens, one document, length squared (attention cost), each as a share of the limit. A bin
    that has no room for the shortest piece is closed.
    """
    need = np.stack([length / limits[0], np.full(len(length), 1 / limits[1]), length.astype(float) ** 2 / limits[2]], 1)
    w, least = np.asarray(weights), need.min(0) if len(need) else np.zeros(3)
    left, name, fill = np.empty((64, 3)), np.empty(64, np.int64), np.empty(64, np.int64)
    n = made = 0
    out, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    for k, x in enumerate(need):
        room = left[:n] - x
        fits = np.flatnonzero((room >= -1e-9).all(1))
        if len(fits):
            score = ((room[fits] * w) ** 2).sum(1) if rule == "norm" else -(left[fits] * x * w).sum(1)
            b = fits[score.argmin()]
        else:
            if n == len(left):
                left, name, fill = np.resize(left, (2 * n, 3)), np.resize(name, 2 * n), np.resize(fill, 2 * n)
            b, name[n], fill[n], left[n] = n, made, 0, 1
            n, made = n + 1, made + 1
        out[k], offset[k] = name[b], fill[b]
        left[b] -= x
        fill[b] += length[k]
        if (left[b] < least - 1e-9).any():
            n -= 1
            left[b], name[b], fill[b] = left[n], name[n], fill[n]
    return out, offset


def pack(
    docs: DataFrame, capacity: int = CAPACITY, max_docs: int | None = None, max_attention: float | None = None,
    weights: tuple[float, float, float] = (1.0, 0.01, 0.01), rule: str = "norm", group_rows: int = 16_384, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = False,
) -> DataFrame:
    """The pieces of docs with sequence_id and offset (gapless from 0 in every sequence).

    max_docs and max_attention (the sum of squared lengths) default to capacity and its square, which never bind. A
    piece over one of them alone is an error of the call. Null and empty texts are the end id alone; rows with a null
    doc_id and repeated rows are packed like others; pieces of equal length go by doc_id and piece, equal ones as they
    come; a text of any length is encoded whole. Other columns are left out; an empty table gives no rows.
    """
    limits = (capacity, max_docs or capacity, max_attention or float(capacity) ** 2)
    if limits[2] < capacity**2 or limits[1] < 1:
        raise ValueError("a full piece must fit into a sequence alone")
    made = cut(pieces(docs, capacity, end_id, vocabulary, with_ids), "pieces")
    groups = max(1, -(-made.filter(F.col("length") < capacity).count() // group_rows))
    # a full piece needs no partner: it is numbered where it is made, below 0, apart from the groups' numbers
    full = made.filter(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    dealt = made.filter(F.col("length") < capacity).withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "_again"), F.lit(groups)))

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offset = best_fit(group["length"].to_numpy(), limits, weights, rule)
        group["sequence_id"] = group["_group"] * (1 << 32) + bins
        group["offset"] = offset
        return group.drop(columns=["_group", "_again"])

    ids = ", ids array<int>" if with_ids else ""
    rest = dealt.groupBy("_group").applyInPandas(packed, PIECES + ids + ", sequence_id long, offset long")
    return rest.unionByName(full.select(rest.columns))
