"""Two tokenizers' views of the same bytes, aligned.

Tokens are intervals of bytes.  Offsets at which tokens of both end cut a text
into groups; two tokens are linked where their intervals overlap.

A byte range of a text yields a ``Fragment``: tokens up to its first common end
(open prefix), whole groups, tokens behind its last common end (open suffix).
A token belongs to the range in which it ends, so every common end is seen
within one range, and fragments compose associatively.  Texts of up to
SEGMENT_BYTES are one fragment of their task.  Longer ones are cut where no
token of either tokenizer can reach over (at a space behind other text), the
segments are dealt to tasks, each gives the fragments of its ranges, and a tree
of groups of ARITY neighbours composes them.

A text has no tokens, and zeros and '' in the result, if it is null or empty
or if either side's bytes differ from " " + text.  Every row is a document of
its own, also if rows are repeated or ids are null.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import slices, small, written
from fieldspark.llm.tokens import ordinary_byte_bpe, piece_model, ragged
from fieldspark.sources.scratch import setting

#: Bytes of text in a shard; beyond SEGMENT_BYTES a text is cut into segments, and those into byte ranges.
SHARD_BYTES, SEGMENT_BYTES, RANGE_BYTES, ARITY = 2 << 20, 64 << 10, 24 << 10, 8

#: Words that are encoded at once.
WORDS = 4096

#: Spark's own setting, and the most that goes to a worker at once: a shard of short texts, with the one that passes the limit.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", SHARD_BYTES - SEGMENT_BYTES

#: Of the table of shards, whose rows are large: what a writer gathers, and a reader opens, at once.
ROW_GROUP, ROW_GROUP_BYTES = "parquet.block.size", 16 << 20

#: A space at which neither tokenizer can join what is before with what is behind: other text is before it.
SAFE = re.compile(r"(?<=\S) (?!\Z)")
#: Texts that can't simply be split at every space: white space before a space, a space at an end.
_UNEVEN = r"^ | $|[\s\v\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "


def _starts(size: np.ndarray) -> np.ndarray:
    return np.cumsum(size) - size


def _sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums of runs of so many."""
    return np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(size)])])


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(size.sum())), size


def _distinct(x: np.ndarray) -> np.ndarray:
    x.sort()
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _pack_numbers(x: np.ndarray) -> bytes:
    """Unsigned integers of the least width that holds them, compressed, behind that width and their number.

    Rows of shards are large: executors hold several of them, and copies, on their way to and from files, shuffles and workers.
    """
    width = np.min_scalar_type(int(x.max(initial=0))).itemsize
    return bytes([width]) + len(x).to_bytes(8, "little") + pa.compress(x.astype(f"<u{width}").tobytes(), "zstd", asbytes=True)


def _numbers(data) -> np.ndarray:
    data = memoryview(data)
    width, n = data[0], int.from_bytes(data[1:9], "little")
    return np.frombuffer(pa.decompress(data[9:], width * n, "zstd"), f"<u{width}").astype(np.int64)


# --- groups -----------------------------------------------------------------


@dataclass
class Groups:
    """Closed groups in a row: ids of both sides and how many of them each group has."""

    a: np.ndarray
    b: np.ndarray
    na: np.ndarray
    nb: np.ndarray

    @staticmethod
    def none() -> Groups:
        return Groups(*(np.zeros(0, np.int64) for _ in range(4)))

    def __add__(self, other: Groups) -> Groups:
        return Groups(*(np.concatenate(p) for p in zip(vars(self).values(), vars(other).values())))


@dataclass
class Fragment:
    """What a byte range says: prefix and suffix are (ids of A, ids of B).

    Without a common end in the range everything is in ``prefix`` and ``closed``
    is False; else ``prefix`` ends at the first one.
    """

    prefix: tuple[np.ndarray, np.ndarray]
    closed: bool
    groups: Groups
    suffix: tuple[np.ndarray, np.ndarray]

    def __add__(self, other: Fragment) -> Fragment:
        join = lambda x, y: (np.concatenate([x[0], y[0]]), np.concatenate([x[1], y[1]]))
        if not self.closed:
            return Fragment(join(self.prefix, other.prefix), other.closed, other.groups, other.suffix)
        if not other.closed:
            return Fragment(self.prefix, True, self.groups, join(self.suffix, other.prefix))
        a, b = join(self.suffix, other.prefix)
        between = Groups(a, b, np.array([len(a)]), np.array([len(b)]))
        return Fragment(self.prefix, True, self.groups + between + other.groups, other.suffix)

    def whole(self) -> Groups:
        """The groups of a text that begins and ends with this fragment."""
        if len(self.suffix[0]) or len(self.suffix[1]) or (not self.closed and len(self.prefix[0])):
            raise ValueError("a text must end at a common end")
        if not self.closed:
            return self.groups
        a, b = self.prefix
        return Groups(a, b, np.array([len(a)]), np.array([len(b)])) + self.groups


def fragment(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> Fragment:
    """Of the tokens that end in a range, with their ends."""
    common = np.intersect1d(a_end, b_end, assume_unique=True)
    none = np.zeros(0, np.int64)
    if not len(common):
        return Fragment((a, b), False, Groups.none(), (none, none))
    at, bt = np.searchsorted(a_end, common) + 1, np.searchsorted(b_end, common) + 1
    groups = Groups(a[at[0] : at[-1]], b[bt[0] : bt[-1]], np.diff(at), np.diff(bt))
    return Fragment((a[: at[0]], b[: bt[0]]), True, groups, (a[at[-1] :], b[bt[-1] :]))


def aligned(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> Groups:
    """The groups of whole texts in a row."""
    return fragment(a, a_end, b, b_end).whole()


# --- units ------------------------------------------------------------------


class Encoder:
    """Both tokenizers over texts, each distinct word of a batch once.

    A word goes with the space before it: " " + text begins with one, and at a
    SAFE space both tokenizers start anew (if no piece holds a space behind
    another character; else a text is one word).
    """

    def __init__(self, path_a: str, path_b: str):
        self.encode_a, self.text_a = ordinary_byte_bpe(path_a)
        self.encode_b, self.text_b, self.apart = piece_model(path_b)
        self.len_a = np.array([len(t) for t in self.text_a])
        self.len_b = np.array([len(t) for t in self.text_b])

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(words of all texts in a row, how many each text has)."""
        texts = pc.fill_null(texts, "")
        uneven = np.ones(len(texts), bool) if not self.apart else pc.match_substring_regex(texts, _UNEVEN).to_numpy(zero_copy_only=False)
        uneven |= pc.equal(texts, "").to_numpy(zero_copy_only=False)
        odd = np.flatnonzero(uneven)
        plain = pc.split_pattern(texts.filter(pa.array(~uneven)), " ").cast(pa.list_(pa.string()))
        split = SAFE.split if self.apart else lambda t: [t]
        others = pa.array([split(t) if t else [] for t in texts.take(pa.array(odd)).to_pylist()], pa.list_(pa.string()))
        place = np.empty(len(texts), np.int64)
        place[np.flatnonzero(~uneven)] = np.arange(len(plain))
        place[odd] = len(plain) + np.arange(len(odd))
        lists = pa.concat_arrays([plain, others]).take(pa.array(place))
        return lists.flatten(), pc.list_value_length(lists).to_numpy().astype(np.int64)

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids and sizes of A, of B, whether both give the bytes) of words with a space before.

        A block of WORDS at a time: as Python lists, the ids of a shard take more memory than all else of it.
        """
        blocks = [self._block(words[i : i + WORDS]) for i in range(0, len(words), WORDS)] or [self._block([])]
        return tuple(np.concatenate(x) for x in zip(*blocks))  # type: ignore[return-value]

    def _block(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a = [self.encode_a(" " + w) for w in words]
        b = self.encode_b(words)
        flat_a, size_a = _flat(a)
        flat_b, size_b = _flat(b)
        texts = [b" " + w.encode() for w in words]
        want = np.array([len(t) for t in texts], np.int64)
        ok = (_sums(self.len_a[flat_a], size_a) == want) & (_sums(self.len_b[flat_b], size_b) == want)
        if not ok.all():
            flat_a, size_a = flat_a[np.repeat(ok, size_a)], size_a * ok
            flat_b, size_b = flat_b[np.repeat(ok, size_b)], size_b * ok
        whole = b"".join([t for t, good in zip(texts, ok) if good])
        ta, tb = self.text_a.__getitem__, self.text_b.__getitem__
        if b"".join(map(tb, flat_b.tolist())) != whole or b"".join(map(ta, flat_a.tolist())) != whole:  # as long as the text, but another one
            ok &= [b"".join(map(tb, y)) == t and b"".join(map(ta, x)) == t for x, y, t in zip(a, b, texts)]
            flat_a, size_a = _flat([x if good else [] for x, good in zip(a, ok)])
            flat_b, size_b = _flat([x if good else [] for x, good in zip(b, ok)])
        return flat_a, size_a, flat_b, size_b, ok


@lru_cache(maxsize=1)
def byte_lengths(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of every id of both sides; the tokenizers themselves are not kept."""
    return np.array([len(t) for t in ordinary_byte_bpe.__wrapped__(path_a)[1]]), np.array([len(t) for t in piece_model.__wrapped__(path_b)[1]])


@lru_cache(maxsize=1)
def encoder(path_a: str, path_b: str) -> Encoder:
    return Encoder(path_a, path_b)


# --- shards -----------------------------------------------------------------


#: A shard: documents, the units each is made of, and the groups of every distinct unit. Numbers are
#: arrays as ``_pack_numbers`` lays them out; ``pairs`` are the linked ids (A << 32 | B), ``held`` the documents that hold them.
SHARD = (
    "shard long, doc_id array<long>, n_units binary, codes binary, unit_groups binary, a binary, b binary, na binary, nb binary, "
    "pairs array<long>, held array<long>"
)
_NUMBERS = ["n_units", "codes", "unit_groups", "a", "b", "na", "nb"]


def _links(g: Groups, unit_groups: np.ndarray, len_a: np.ndarray, len_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A << 32 | B of every link, how many links each unit has)."""
    a_end, b_end = np.cumsum(len_a[g.a]), np.cumsum(len_b[g.b])
    ends = np.union1d(a_end, b_end)
    pairs = g.a[np.searchsorted(a_end, ends)] << 32 | g.b[np.searchsorted(b_end, ends)]
    # in a group all ends of both sides differ but the last
    return pairs, _sums(g.na + g.nb - 1, unit_groups)


def _doc_pairs(doc: np.ndarray, code: np.ndarray, link: np.ndarray, n_links: np.ndarray, n_pairs: int) -> np.ndarray:
    """How many documents hold each pair, if ``doc`` has the unit ``code``."""
    n_codes = len(n_links)
    both = _distinct(doc * n_codes + code)
    doc, code = both // max(n_codes, 1), both % max(n_codes, 1)
    begin = _starts(n_links)
    pair = ragged(link, begin[code], n_links[code])
    seen = _distinct(np.repeat(doc * n_pairs, n_links[code]) + pair)
    return np.bincount(seen % max(n_pairs, 1), minlength=n_pairs)


def _shard(number: int, ids: pa.Array, n_units: np.ndarray, codes: np.ndarray, unit_groups: np.ndarray, g: Groups, lengths) -> pa.RecordBatch:
    links, n_links = _links(g, unit_groups, *lengths)
    pairs, link = np.unique(links, return_inverse=True)
    held = np.zeros(len(pairs), np.int64)
    upto = np.concatenate([[0], np.cumsum(n_units)])
    begin = 0
    while begin < len(n_units):  # blocks of documents, so that their links fit in memory
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + (1 << 18), "right")) - 1)
        doc = np.repeat(np.arange(end - begin), n_units[begin:end])
        held += _doc_pairs(doc, codes[upto[begin] : upto[end]].astype(np.int64), link, n_links, len(pairs))
        begin = end
    numbers = [n_units, codes, unit_groups, g.a, g.b, g.na, g.nb]
    used = held > 0
    return pa.RecordBatch.from_arrays(
        [
            pa.array([number], pa.int64()),
            pa.array([ids], pa.list_(pa.int64())),
            *(pa.array([_pack_numbers(x)], pa.binary()) for x in numbers),
            pa.array([pairs[used]], pa.list_(pa.int64())),
            pa.array([held[used]], pa.list_(pa.int64())),
        ],
        names=["shard", "doc_id", *_NUMBERS, "pairs", "held"],
    )


def _short_shards(path_a: str, path_b: str) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = encoder(path_a, path_b)
        number = TaskContext.get().partitionId() << 31
        for batch in slices(batches, "text", SHARD_BYTES):
            words, n_units = tools.words(batch.column("text"))
            words = words.dictionary_encode()
            a, size_a, b, size_b, ok = tools.encode(words.dictionary.to_pylist())
            codes = words.indices.to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(len(n_units)), n_units)
            good = np.bincount(doc, ~ok[codes], minlength=len(n_units)) == 0
            n_units, codes = n_units * good, codes[good[doc]]
            ends_a, ends_b = np.cumsum(tools.len_a[a]), np.cumsum(tools.len_b[b])
            groups = aligned(a, ends_a, b, ends_b)
            unit_a = np.repeat(np.arange(len(ok)), size_a)
            unit_groups = np.bincount(unit_a[_starts(groups.na)], minlength=len(ok)) if len(groups.na) else np.zeros(len(ok), np.int64)
            yield _shard(number, batch.column("doc_id"), n_units, codes, unit_groups, groups, (tools.len_a, tools.len_b))
            number += 1

    return work


# --- very long documents ----------------------------------------------------


SEGMENT = "uid long, doc_id long, part long, begin long, text string"
FRAGMENT = "uid long, doc_id long, at long, ok boolean, closed boolean, pa binary, pb binary, a binary, b binary, na binary, nb binary, sa binary, sb binary"
_PARTS = ["pa", "pb", "a", "b", "na", "nb", "sa", "sb"]


def segments(text: str, limit: int, apart: bool = True) -> list[str]:
    """The text cut at SAFE spaces, which go, at least ``limit`` characters apart."""
    cuts, at = [], limit
    while apart and (m := SAFE.search(text, at)):
        cuts.append(m.start())
        at = m.start() + 1 + limit
    return [text[i:j] for i, j in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)])]


def _cut(path_b: str, limit: int) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = piece_model(path_b)[2]
        for batch in batches:
            for row in batch.to_pylist():
                parts = segments(row["text"], limit, apart)
                sizes = np.array([len(p.encode()) + 1 for p in parts])
                n = len(parts)
                columns = [[row["uid"]] * n, [row["doc_id"]] * n, range(n), _starts(sizes), parts]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["uid", "doc_id", "part", "begin", "text"])

    return work


def _pack(f: Fragment) -> list[bytes]:
    g = f.groups
    return [_pack_numbers(x) for x in (*f.prefix, g.a, g.b, g.na, g.nb, *f.suffix)]


def _unpack(row) -> Fragment:
    pa_, pb_, a, b, na, nb, sa, sb = (_numbers(row[k]) for k in _PARTS)
    return Fragment((pa_, pb_), bool(row["closed"]), Groups(a, b, na, nb), (sa, sb))


def _fragments(path_a: str, path_b: str, width: int) -> Callable:
    """Fragments of the byte ranges of segments."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = encoder(path_a, path_b)
        for batch in slices(batches, "text", SHARD_BYTES):
            rows = []
            for row in batch.to_pylist():
                words, _ = tools.words(pa.array([row["text"]]))
                words = words.dictionary_encode()
                a, size_a, b, size_b, ok = tools.encode(words.dictionary.to_pylist())
                codes = words.indices.to_numpy()
                a, b = ragged(a, _starts(size_a)[codes], size_a[codes]), ragged(b, _starts(size_b)[codes], size_b[codes])
                a_end, b_end = row["begin"] + np.cumsum(tools.len_a[a]), row["begin"] + np.cumsum(tools.len_b[b])
                end = row["begin"] + 1 + len(row["text"].encode())
                edges = [*range((row["begin"] // width + 1) * width, end, width), end]
                ia, ib = 0, 0
                for edge in edges:
                    ja, jb = np.searchsorted(a_end, edge, "right"), np.searchsorted(b_end, edge, "right")
                    f = fragment(a[ia:ja], a_end[ia:ja], b[ib:jb], b_end[ib:jb])
                    rows.append((row["uid"], row["doc_id"], edge, bool(ok.all()), f.closed, *_pack(f)))
                    ia, ib = ja, jb
            yield _rows(rows)

    return work


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.binary()] * len(_PARTS)]
    names = ["uid", "doc_id", "at", "ok", "closed", *_PARTS]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _composed(rows: pa.Table) -> tuple[dict, bool, Fragment]:
    """(first row, whether all went well, the fragment) of neighbours."""
    rows = rows.sort_by("at").to_pylist()
    parts = [_unpack(r) for r in rows]
    while len(parts) > 1:
        parts = [x + y for x, y in zip(parts[::2], parts[1::2])] + parts[len(parts) & ~1 :]
    return rows[0], all(r["ok"] for r in rows), parts[0]


def _compose(rows: pa.Table) -> pa.Table:
    first, ok, f = _composed(rows)
    return pa.Table.from_batches([_rows([(first["uid"], first["doc_id"], first["at"], ok, f.closed, *_pack(f))])])


def compose(fragments: DataFrame, most: int, width: int = RANGE_BYTES, arity: int = ARITY) -> DataFrame:
    """At most ``arity`` fragments per document of at most ``most`` bytes, by a tree of groups of neighbours."""
    span = width
    while span * arity < most + width:
        span *= arity
        fragments = fragments.withColumn("node", F.expr(f"at div {span}")).groupBy("uid", "node").applyInArrow(_compose, FRAGMENT)
    return fragments


def _long_shard(path_a: str, path_b: str) -> Callable:
    """The root of a document's tree: its fragments become a shard of its own."""

    def work(rows: pa.Table) -> pa.Table:
        first, ok, f = _composed(rows)
        groups = f.whole() if ok else Groups.none()
        n = np.array([int(ok)])
        ids = pa.array([first["doc_id"]], pa.int64())
        batch = _shard(-1 - first["uid"], ids, n, np.zeros(n[0], np.int64), np.array([len(groups.na)])[: n[0]], groups, byte_lengths(path_a, path_b))
        return pa.Table.from_batches([batch])

    return work


def shards(docs: DataFrame, path_a: str, path_b: str, segment: int = SEGMENT_BYTES, width: int = RANGE_BYTES) -> DataFrame:
    """All documents with their groups, shard by shard, written.

    Texts go to the workers a shard at a time: 10,000 rows, which Spark would send, are held several times over, by it and by them.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    out = rows.where(size <= segment).mapInArrow(_short_shards(path_a, path_b), SHARD)
    long_ = written(rows.where(size > segment).withColumn("uid", F.monotonically_increasing_id()), "long-texts")
    most = long_.agg(F.max(F.octet_length("text"))).first()[0]
    if most is not None:
        cut = long_.mapInArrow(_cut(path_b, segment), SEGMENT).repartition("uid", "part")
        parts = compose(cut.mapInArrow(_fragments(path_a, path_b, width), FRAGMENT), most + 1, width)
        out = out.unionByName(parts.groupBy("uid").applyInArrow(_long_shard(path_a, path_b), SHARD))
    with setting(docs.sparkSession, BATCH, str(BATCH_BYTES)), setting(docs.sparkSession, ROW_GROUP, str(ROW_GROUP_BYTES)):
        return written(out, "alignment")


# --- results ----------------------------------------------------------------


def pair_counts(parts: DataFrame) -> DataFrame:
    """pair, n (documents that hold it linked), best (no pair of the same A id has more), written."""
    pairs = parts.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair"))
    pairs = written(pairs.agg(F.sum("x.held").alias("n")).withColumn("a", F.expr("pair div 4294967296")), "pair-counts")
    # one row per id of the vocabulary
    top = F.broadcast(pairs.groupBy("a").agg(F.max("n").alias("top")))
    return pairs.join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def _texts(g: Groups, unit_groups: np.ndarray) -> pa.Array:
    """Every unit's groups as text: ids with commas, a bar between the sides, semicolons between groups."""
    size = g.na + g.nb
    begin = _starts(size)
    ids = np.empty(int(size.sum()), np.int64)
    ids[ragged(np.arange(len(ids)), begin, g.na)] = g.a
    ids[ragged(np.arange(len(ids)), begin + g.na, g.nb)] = g.b
    mark = np.zeros(len(ids), np.int8)
    mark[begin + g.na - 1] = 1
    mark[begin + size - 1] = 2
    upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(unit_groups)])]
    mark[upto[1:][np.diff(upto) > 0] - 1] = 3
    marks = pa.array([",", "|", ";", ""]).take(pa.array(mark))
    tokens = pc.binary_join_element_wise(pa.array(ids).cast(pa.string()), marks, "")
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(upto, pa.int32()), tokens), "")


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def _measure(path_a: str, path_b: str, texts: bool) -> Callable:
    """Documents' rows from a shard to which the counts of its pairs are joined."""

    def work(shard: pa.Table) -> pa.Table:
        lengths = byte_lengths(path_a, path_b)
        n_units, codes, unit_groups, a, b, na, nb = (_numbers(shard.column(k)[0].as_buffer()) for k in _NUMBERS)
        g = Groups(a, b, na, nb)
        links, n_links = _links(g, unit_groups, *lengths)
        known, n, best = (shard.column(k).combine_chunks().flatten().to_numpy(zero_copy_only=False) for k in ("pair", "n", "best"))
        # links of units that no good document has are unknown, and are not asked for
        order = np.argsort(known)
        at = order[np.minimum(np.searchsorted(known[order], links), len(known) - 1)] if len(known) else np.zeros(0, np.int64)
        nothing = np.zeros(len(n_links), np.int64)
        per_unit = [_sums(na, unit_groups), _sums(nb, unit_groups), unit_groups, n_links]
        per_unit += [_sums(x[at], n_links) if len(known) else nothing for x in (best, n)]
        columns = dict(zip(("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"), (_sums(x[codes], n_units) for x in per_unit)))
        units, upto = _texts(g, unit_groups), np.concatenate([[0], np.cumsum(n_units)])
        shas, groups = [], []
        begin = 0
        while begin < len(n_units):  # a few documents' texts at a time
            end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + (1 << 18), "right")) - 1)
            mine = units.take(pa.array(codes[upto[begin] : upto[end]])).cast(pa.large_string())
            lists = pa.ListArray.from_arrays(pa.array(upto[begin : end + 1] - upto[begin], pa.int32()), mine)
            joined = pc.binary_join(lists, pa.scalar(";", pa.large_string()))
            shas += [hashlib.sha256(t.as_buffer()).hexdigest() if t.as_buffer().size else "" for t in joined]
            groups += joined.to_pylist() if texts else [None] * (end - begin)
            begin = end
        ids = shard.column("doc_id").combine_chunks().flatten()
        return pa.table({"doc_id": ids, **columns, "groups_sha256": pa.array(shas, pa.string()), "groups": pa.array(groups, pa.string())})

    return work


def align(
    docs: DataFrame, path_a: str, path_b: str, texts: bool = False, segment: int = SEGMENT_BYTES, width: int = RANGE_BYTES
) -> DataFrame:
    """One row per document: numbers of tokens, groups and links, n_best, count_sum, the digest of its groups
    and, if asked for, ``groups`` themselves as text."""
    parts = shards(docs, path_a, path_b, segment, width)
    counts = small(written(pair_counts(parts), "pairs"))
    mine = parts.select("shard", F.explode("pairs").alias("pair")).join(counts, "pair").groupBy("shard")
    mine = mine.agg(F.collect_list(F.struct("pair", "n", "best")).alias("x")).select("shard", F.col("x.pair").alias("pair"), F.col("x.n").alias("n"), F.col("x.best").alias("best"))
    rows = parts.drop("pairs", "held").join(mine, "shard", "left")
    out = rows.groupBy("shard").applyInArrow(_measure(path_a, path_b, texts), RESULT)
    return out if texts else out.drop("groups")
