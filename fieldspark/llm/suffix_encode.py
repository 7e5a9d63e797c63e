"""Unigram encoding by suffix-array matching, and decoding.

A task joins the words of a batch that it has not met yet into one array of
characters, sorts its suffixes as far as the longest piece reaches, and finds
every piece's range of occurrences by binary search.  Each occurrence is an
edge from its first to one past its last character; edges sorted by position
are relaxed start by start, for all words at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import slices
from fieldspark.llm.tokens import MEMO_ENTRIES, unigram

#: Characters of new words that are indexed at once.
INDEX_CHARS = 400_000


class SuffixEncoder:
    def __init__(self, path: str):
        self.vocabulary = v = unigram(path)
        pieces = list(v.pieces)
        self.width = max(map(len, pieces))
        self.piece_ids = np.array([v.pieces[p][0] for p in pieces], np.int32)
        self.scores = np.array([v.pieces[p][1] for p in pieces])
        self.lengths = np.array([len(p) for p in pieces])
        codes = np.zeros((len(pieces), self.width), np.int64)
        for row, p in enumerate(pieces):
            codes[row, : len(p)] = [ord(c) for c in p]
        self.codes = codes
        self.memo: dict[str, bytes] = {}

    def _edges(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, piece row) of every occurrence of a piece in ``text``.

        Words are parted by 0, which no piece holds.
        """
        n = len(text)
        # rank of the suffixes by their first 1, 2, 4, ... characters
        alphabet, rank = np.unique(text, return_inverse=True)
        rank = rank.astype(np.int64)
        by = 1
        while by * 2 <= self.width:
            second = np.zeros(n, np.int64)
            second[: max(n - by, 0)] = rank[by:] + 1
            _, rank = np.unique(rank * (n + 2) + second, return_inverse=True)
            rank = rank.astype(np.int64)
            by *= 2
        # the full order: by pairs of known ranks that cover the longest piece
        key = rank.copy()
        at = by
        while at < self.width:
            second = np.zeros(n, np.int64)
            second[: max(n - at, 0)] = rank[at:] + 1
            _, key = np.unique(key * (n + 2) + second, return_inverse=True)
            key = key.astype(np.int64)
            at += by
        order = np.argsort(key, kind="stable")
        # binary search of every piece, one character at a time: within lo..hi
        # all suffixes share what has been matched, so the next character is sorted
        lo, hi = np.zeros(len(self.codes), np.int64), np.full(len(self.codes), n, np.int64)
        rows = np.arange(len(self.codes))
        for k in range(self.width):
            live = rows[(self.lengths[rows] > k) & (lo[rows] < hi[rows])]
            if not len(live):
                break
            rows = live
            want = self.codes[live, k]
            for side in (0, 1):
                a, b = lo[live].copy(), hi[live].copy()
                while True:
                    open_ = a < b
                    if not open_.any():
                        break
                    mid = (a + b) >> 1
                    at_ = order[np.minimum(mid, n - 1)] + k
                    char = np.where(at_ < n, text[np.minimum(at_, n - 1)], -1)
                    right = open_ & ((char < want) if side == 0 else (char <= want))
                    a = np.where(right, mid + 1, a)
                    b = np.where(open_ & ~right, mid, b)
                if side == 0:
                    first = a
                else:
                    lo[live], hi[live] = first, a
        counts = np.maximum(hi - lo, 0)
        piece = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        return order[lo[piece] + within], piece

    def _encode_words(self, words: list[str]) -> list[bytes]:
        joined = "\0".join(words) + "\0"
        text = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        sizes = np.array([len(w) for w in words])
        first = np.cumsum(sizes + 1) - sizes - 1
        start, piece = self._edges(text)
        # a character without a piece of its own: an unknown edge
        lone = text != 0
        lone[start[self.lengths[piece] == 1]] = False
        lone = np.flatnonzero(lone)
        start = np.concatenate([start, lone])
        piece = np.concatenate([piece, np.full(len(lone), -1)])
        score = np.where(piece < 0, self.vocabulary.unknown_score, self.scores[piece])
        end = start + np.where(piece < 0, 1, self.lengths[piece])
        # relax by start within the word; all edges of one step that lead to the
        # same cell come from the same start, so no two meet
        word = np.searchsorted(first, start, "right") - 1
        step = start - first[word]
        order = np.argsort(step, kind="stable")
        start, end, piece, score, step = start[order], end[order], piece[order], score[order], step[order]
        best = np.full(len(text) + 1, -np.inf)
        back = np.full(len(text) + 1, -2, np.int64)
        come = np.zeros(len(text) + 1, np.int64)
        best[first] = 0.0
        cuts = np.searchsorted(step, np.arange(sizes.max(initial=0) + 1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            to = end[a:b]
            s = best[start[a:b]] + score[a:b]
            better = s > best[to]
            to = to[better]
            best[to], back[to], come[to] = s[better], piece[a:b][better], start[a:b][better]
        # trace all words back together
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        who, at = np.arange(len(words)), first + sizes
        on = at > first
        who, at = who[on], at[on]
        while len(at):
            found.append((who, come[at], back[at]))
            at = come[at]
            on = at > first[who]
            who, at = who[on], at[on]
        if not found:
            return [b""] * len(words)
        who, at, piece = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((at, who))
        who, at, piece = who[order], at[order], piece[order]
        ids = np.where(piece < 0, -1, self.piece_ids[piece]).astype(np.int32)
        if (ids < 0).any():  # unknown characters become their bytes
            byte_ids = self.vocabulary.byte_ids
            parts = [[i] if i >= 0 else [byte_ids[b] for b in chr(text[p]).encode()] for i, p in zip(ids.tolist(), at.tolist())]
            who = np.repeat(who, [len(p) for p in parts])
            ids = np.fromiter(chain.from_iterable(parts), np.int32)
        bounds = np.searchsorted(who, np.arange(len(words) + 1))
        flat = ids.astype("<i4").tobytes()
        return [flat[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = self.vocabulary.words(texts)
        new = set(chain.from_iterable(words)).difference(self.memo)
        if len(self.memo) + len(new) > MEMO_ENTRIES:
            self.memo, new = {}, set(chain.from_iterable(words))
        # a 0 in a text would part words: such words have no piece across it
        special = {w for w in new if "\0" in w}
        for w in special:
            parts = self._encode_words([p for p in w.split("\0")])
            zero = np.array([self.vocabulary.byte_ids[0]], "<i4").tobytes()
            self.memo[w] = zero.join(parts)
        held: list[str] = []
        size = 0
        for w in sorted(new - special):
            held.append(w)
            size += len(w)
            if size > INDEX_CHARS:
                self.memo.update(zip(held, self._encode_words(held)))
                held, size = [], 0
        if held:
            self.memo.update(zip(held, self._encode_words(held)))
        get = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), "<i4") for ws in words]

    def decode(self, ids: np.ndarray) -> str:
        text_of = self.vocabulary.text_of
        text = b"".join(map(text_of.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return text[1:] if self.vocabulary.proto.normalizer_spec.add_dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def encoder(path: str) -> SuffixEncoder:
    return SuffixEncoder(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array<int>) of every whole text of ``docs``.

    Null and empty texts have no ids.  Row order, repeated rows and other
    columns do not matter.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in slices(batches, "text"):
            ids = model.encode([t or "" for t in batch.column("text").to_pylist()])
            offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            flat = np.concatenate(ids) if len(ids) else np.zeros(0, "<i4")
            array = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), array], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text of every row of ids; null ids give null text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [None if not x.is_valid else model.decode(x.values.to_numpy(zero_copy_only=False)) for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Encodes and decodes every text in one pass: doc_id, n_tokens, ids_crc32,
    text_sha256 (of the decoded text) and round_trip (it equals the text, up
    to the space mark that the vocabulary keeps for itself)."""
    import hashlib
    import zlib

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for batch in slices(batches, "text"):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = model.encode(texts)
            back = [model.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(i) for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    pa.array([hashlib.sha256(b.encode()).hexdigest() for b in back], pa.string()),
                    pa.array([b == t.replace("▁", " ") for b, t in zip(back, texts)], pa.bool_()),
                ],
                ["doc_id", "n_tokens", "ids_crc32", "text_sha256", "round_trip"],
            )

    schema = "doc_id long, n_tokens long, ids_crc32 long, text_sha256 string, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(work, schema)
