"""Byte-level BPE encoding with reuse of content-defined chunks.

A rolling hash over the bytes picks cut points by content alone, so a passage that stands in many documents yields
the same chunks wherever it stands. A chunk is encoded once a worker and kept in a bounded cache. Its ids are final
between its first and its last safe boundary: a point before a blank that follows a non-blank and precedes a letter,
where the pre-tokenizer always splits. What lies around the cut (the tail of one chunk and the head of the next) is
re-encoded as one piece up to those boundaries, where both agree with the whole text's ids. A chunk without such a
boundary joins its neighbours before it is encoded. Decoding joins the bytes of the ids.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

VOCABULARY = "byte_bpe_50k"

# Characters that every library's pre-tokenizer classes alike; spans with others, up to safe boundaries, go to the library.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ž]")
_SAFE = re.compile(r"(?<=\S)(?= [A-Za-zÀ-ÖØ-öø-ž])")
_LAST = re.compile(r"(?s).*(?<=\S)(?= [A-Za-zÀ-ÖØ-öø-ž])")
_GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def cut_points(data: np.ndarray, mask_bits: int, window: int = 32) -> np.ndarray:
    """Positions whose last `window` bytes hash to zero in mask_bits bits: gear hashes by doubling."""
    h, w = _GEAR[data], 1
    while w < window:
        h[w:] += h[:-w] << np.uint32(w)
        w *= 2
    return np.flatnonzero(h >> np.uint32(32 - mask_bits) == 0) + 1


class ChunkCoder:
    """Encodes and decodes texts; see the module. stats counts chunks met and chunks encoded."""

    def __init__(self, model: str, ranks: str, pattern: str, mask_bits: int = 8, cached_chars: int = 40_000_000) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(model)
        self.whole.no_truncation()
        self.whole.no_padding()
        added = self.whole.get_added_tokens_decoder()
        self.special = re.compile("|".join(re.escape(t.content) for t in added.values()) or r"(?!)")
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.coder = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes = {n: b for b, n in table.items()} | {n: t.content.encode() for n, t in added.items()}
        self.names = {n: str(n) for n in self.bytes}
        self.mask_bits, self.cached_chars, self.held = mask_bits, cached_chars, 0
        self.chunks: dict[str, tuple] = {}
        self.seams: dict[str, list[int]] = {}
        self.stats = {"chunks": 0, "encoded": 0}

    def _chunk(self, text: str) -> tuple[str, list[int] | None, str]:
        """(head, ids of the body, tail); None where the chunk has fewer than two safe boundaries."""
        first = _SAFE.search(text)
        last = _LAST.match(text)
        if first is None or first.end() == last.end():
            return text, None, ""
        return text[: first.end()], self.coder.encode_ordinary(text[first.end() : last.end()]), text[last.end() :]

    def _seam(self, text: str) -> list[int]:
        got = self.seams.get(text)
        if got is None:
            if len(self.seams) > 200_000:
                self.seams = {}
            got = self.coder.encode_ordinary(text)
            if len(text) < 64:
                self.seams[text] = got
        return got

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        if not (_PLAIN.search(text) or self.special.search(text)):
            return self._plain(text)
        ids: list[int] = []
        at = 0
        for a, b in self._odd_spans(text):
            ids += self._plain(text[at:a])
            ids += self.whole.encode(text[a:b], add_special_tokens=False).ids
            at = b
        return ids + self._plain(text[at:])

    def _odd_spans(self, text: str) -> list[tuple[int, int]]:
        """Disjoint spans between safe boundaries that hold all other characters and special strings."""
        edges = [0, *(m.end() for m in _SAFE.finditer(text)), len(text)]
        spans: list[tuple[int, int]] = []
        odd = sorted([m.span() for m in _PLAIN.finditer(text)] + [m.span() for m in self.special.finditer(text)])
        for a, b in odd:
            if spans and b <= spans[-1][1]:
                continue
            low, high = edges[bisect_right(edges, a) - 1], edges[bisect_left(edges, b)]
            if spans and low <= spans[-1][1]:
                spans[-1] = (spans[-1][0], high)
            else:
                spans.append((low, high))
        return spans

    def _plain(self, text: str) -> list[int]:
        """Ids of a text of plain characters, chunk by chunk."""
        if not text:
            return []
        if text.isascii():
            raw = np.frombuffer(text.encode("ascii"), np.uint8)
        else:  # one unit a character, so that a cut never splits one
            raw = (np.frombuffer(text.encode("utf-16-le"), np.uint16) % 251).astype(np.uint8)
        cuts = cut_points(raw, self.mask_bits).tolist()
        if not cuts or cuts[-1] != len(text):
            cuts.append(len(text))
        ids: list[int] = []
        pending, at = "", 0
        for end in cuts:
            chunk = text[at:end]
            at = end
            self.stats["chunks"] += 1
            known = self.chunks.get(chunk)
            if known is None:
                if self.held > self.cached_chars:
                    self.chunks, self.held = {}, 0
                known = self.chunks[chunk] = self._chunk(chunk)
                self.held += 2 * len(chunk) + 200
                self.stats["encoded"] += 1
            head, body, tail = known
            if body is None:
                pending += head
                continue
            ids += self._seam(pending + head)
            ids += body
            pending = tail
        return ids + self._seam(pending) if pending else ids

    def forget(self) -> None:
        """Empty the caches: a worker outlives its tasks, and the next ones need its memory."""
        self.chunks, self.seams, self.held = {}, {}, 0

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


_CODERS: dict[tuple, ChunkCoder] = {}


def coder(*args) -> ChunkCoder:
    if args not in _CODERS:
        _CODERS[args] = ChunkCoder(*args)
    return _CODERS[args]


def vocabulary_paths(name: str = VOCABULARY) -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path(f"{name}.json"), p.path(f"{name}.tiktoken"), p.PATTERN


def encode(docs: DataFrame, vocabulary: tuple[str, str, str] | None = None, with_ids: bool = True) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256 and, where asked for, ids and the decoded text.

    Null text counts as empty; null doc_ids and repeated rows are kept; other columns are left out; an empty table gives
    no rows; a text of any length is encoded whole, in chunks.
    """
    paths = vocabulary or vocabulary_paths()
    more = ", ids array<int>, decoded string" if with_ids else ""

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = coder(*paths)
        try:
            for batch in batches:
                rows = []
                for text in batch["text"].fillna(""):
                    ids = make.encode(text)
                    joined = ",".join(map(make.names.__getitem__, ids))
                    back = b"".join(map(make.bytes.__getitem__, ids))
                    rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back).hexdigest(), *([ids, back.decode("utf-8", "replace")] * with_ids)))
                out = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", *["ids", "decoded"] * with_ids])
                out.insert(0, "doc_id", batch["doc_id"].astype("Int64").array)
                yield out
        finally:
            make.forget()

    return docs.select("doc_id", "text").mapInPandas(encoded, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + more)
