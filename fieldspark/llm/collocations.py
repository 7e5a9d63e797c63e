"""Phrases of two to four words that stick together, from FM indexes over word ids.

Every task turns its texts into sequences of word ids, one FM index per shard
and language: the Burrows-Wheeler transform of the sequence and of its mirror
image, each sorted to the depth of the longest phrase.  A phrase is a pair of
intervals, one in either transform, and grows by a word to the left or to the
right; each interval's size is the phrase's count in the shard.  Counts are
summed across shards.  Two rounds keep what is shuffled small without losing
anything: a phrase can only be frequent if its words are, and then if its word
pairs are, so the first round counts pairs of frequent words, and the second
the longer phrases over frequent pairs.

A null text is empty, a null language is ``und``; ids play no part, so null or
repeated ids do no harm, and a repeated row counts again.  Other columns are
ignored.  A table without words gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import slices, small, written
from fieldspark.llm.tokens import ragged

MIN_COUNT, SHARE, TOP, MAX_WORDS = 30, 80, 2000, 4
#: Bytes of text in a shard, and what a task holds of all languages before it closes the fullest shard.
SHARD_BYTES, HELD_BYTES = 4 << 20, 16 << 20
#: Everything that ends a piece of text becomes this one, which no word can hold.
_ENDS = bytes.maketrans(b",;:!?\n\x0b\x0c\r", b"." * 9)


class FMIndex:
    """Both transforms of a sequence of ids, sorted by their first ``depth`` symbols.

    0 separates; no phrase holds it.  Phrases are arrays of intervals: ``lo``
    in the transform, ``mirror`` in that of the reversed sequence, ``size``.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        self.ids = np.append(ids, 0).astype(np.int32)
        self.depth = depth
        self.n = len(self.ids)
        self.counts = np.bincount(self.ids, minlength=1)
        self.first = np.cumsum(self.counts) - self.counts

    def _transform(self, ids: np.ndarray) -> np.ndarray:
        rank, width = ids, 1
        order = None
        while width < self.depth:
            key = rank * np.int64(int(rank.max()) + 1)
            key += np.roll(rank, -width)
            order = np.argsort(key, kind="stable")
            width *= 2
            if width < self.depth:
                key = key[order]
                rank = np.empty(self.n, np.int32)
                rank[order] = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]), dtype=np.int32)
        if order is None:
            order = np.argsort(ids, kind="stable")
        return ids[order - 1]

    @cached_property
    def bwt(self) -> np.ndarray:
        return self._transform(self.ids)

    @cached_property
    def mirror_bwt(self) -> np.ndarray:
        return self._transform(np.append(self.ids[-2::-1], 0))

    def _places(self, bwt: np.ndarray) -> np.ndarray:
        """Places of every symbol in a transform, as symbol * n + place, ascending."""
        order = np.argsort(bwt, kind="stable")
        order += bwt[order] * np.int64(self.n)
        return order

    @cached_property
    def places(self) -> np.ndarray:
        return self._places(self.bwt)

    @cached_property
    def mirror_places(self) -> np.ndarray:
        return self._places(self.mirror_bwt)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, lo, mirror, size) of every symbol but the separator."""
        symbol = np.flatnonzero(self.counts)
        symbol = symbol[symbol > 0]
        return symbol, self.first[symbol], self.first[symbol], self.counts[symbol]

    def _grow(self, bwt, lo, other, size):
        """(parent, symbol, size, other) of all one-symbol extensions of intervals."""
        top = len(self.counts)
        key = np.repeat(np.arange(len(lo)) * top, size)
        key += ragged(bwt, lo, size)
        key, count = np.unique(key, return_counts=True)
        parent, symbol = key // top, key % top
        # within the other interval the extensions lie in the order of their symbols
        before = np.cumsum(count) - count
        begin = np.cumsum(size) - size
        return parent, symbol, count, other[parent] + before - begin[parent]

    def _rank(self, places, symbol, at):
        """Where symbol + phrase begins, for a phrase whose interval begins at ``at``."""
        return np.searchsorted(places, symbol * self.n + at)

    def left(self, lo, mirror, size):
        """(parent, symbol, lo, mirror, size) of all phrases symbol + phrase."""
        parent, symbol, count, mirrored = self._grow(self.bwt, lo, mirror, size)
        ok = symbol > 0
        parent, symbol, count, mirrored = parent[ok], symbol[ok], count[ok], mirrored[ok]
        return parent, symbol, self._rank(self.places, symbol, lo[parent]), mirrored, count

    def right(self, lo, mirror, size):
        """(parent, symbol, lo, mirror, size) of all phrases phrase + symbol."""
        parent, symbol, count, placed = self._grow(self.mirror_bwt, mirror, lo, size)
        ok = symbol > 0
        parent, symbol, count, placed = parent[ok], symbol[ok], count[ok], placed[ok]
        return parent, symbol, placed, self._rank(self.mirror_places, symbol, mirror[parent]), count

    def phrases(self, upto: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(words of each phrase as rows of a matrix, counts) for 2, 3, ... words.

        Pairs are words grown to the left, longer phrases grow to the right and
        to the left in turn.
        """
        symbol, lo, mirror, size = self.words()
        words = symbol[:, None]
        for k in range(2, upto + 1):
            if not len(words):
                return
            if k == upto:  # the last words need no intervals of their own
                parent, symbol, size, _ = self._grow(self.bwt, lo, mirror, size)
                ok = symbol > 0
                yield np.column_stack([symbol[ok], words[parent[ok]]]), size[ok]
                return
            parent, symbol, lo, mirror, size = (self.right if k % 2 else self.left)(lo, mirror, size)
            words = np.column_stack([words[parent], symbol] if k % 2 else [symbol, words[parent]])
            yield words, size


# --- shards -----------------------------------------------------------------


def _packed(ids: np.ndarray) -> bytes:
    """32-bit numbers, their bytes by place value, compressed behind their count."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(ids).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: pa.Buffer) -> np.ndarray:
    n = int.from_bytes(data.slice(0, 8).to_pybytes(), "little")
    planes = np.frombuffer(pa.decompress(data.slice(8), decompressed_size=4 * n, codec="zstd"), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _encode(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, int]:
    """(distinct words, ids from 1 with 0 between pieces, how many words)."""
    flat = b" . ".join(texts).translate(_ENDS).replace(b".", b" . ")
    words = pc.ascii_split_whitespace(pa.array([flat], pa.large_binary()).cast(pa.large_string())).values
    words = words.filter(pc.not_equal(words, "")).dictionary_encode()
    names, ids = words.dictionary.cast(pa.string()), words.indices.to_numpy().astype(np.uint32) + 1
    dot = pc.index(names, ".").as_py()
    if dot >= 0:
        ids = np.where(ids == dot + 1, 0, ids - (ids > dot + 1)).astype(np.uint32)
        names = pa.concat_arrays([names.slice(0, dot), names.slice(dot + 1)])
    return names, ids, int(np.count_nonzero(ids))


SHARD = "shard long, lang string, n long, words array<string>, counts array<long>, ids binary"


def shards(docs: DataFrame) -> DataFrame:
    """One row per shard: its words, how often each occurs, and the ids of its texts in a row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, made = TaskContext.get().partitionId() << 32, 0
        held, size = defaultdict(list), defaultdict(int)

        def close(lang: str) -> Iterator[pa.RecordBatch]:
            nonlocal made
            names, ids, n = _encode(held.pop(lang))
            size.pop(lang)
            if n:
                counts = np.bincount(ids, minlength=len(names) + 1)[1:]
                row = [[base + made], [lang], [n], [names], [counts], [_packed(ids)]]
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["shard", "lang", "n", "words", "counts", "ids"])

        for batch in slices(batches, "text", SHARD_BYTES):
            lower = pc.ascii_lower(batch.column("text")).cast(pa.binary())
            for lang, text in zip(batch.column("lang").to_pylist(), lower.to_pylist()):
                if text:
                    held[lang].append(text)
                    size[lang] += len(text)
                    if size[lang] >= SHARD_BYTES:
                        yield from close(lang)
            while sum(size.values()) > HELD_BYTES:
                yield from close(max(size, key=size.get))
        for lang in list(held):
            yield from close(lang)

    rows = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, SHARD)


def _sequence(ids: pa.Buffer, at: np.ndarray) -> np.ndarray:
    """The shard's ids with those of rare words as separators and frequent ones counted anew from 1."""
    ids = _unpacked(ids)
    new = np.zeros(int(ids.max(initial=0)) + 1, np.int32)
    new[at + 1] = np.arange(1, len(at) + 1)
    return _tight(new[ids])


def _tight(ids: np.ndarray, least: int = 2) -> np.ndarray:
    """Runs of at least so many words, one separator between them."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
    start, stop = edge[::2], edge[1::2]
    long_ = stop - start >= least
    start, size = start[long_], (stop - start)[long_]
    out = np.zeros(int((size + 1).sum()), np.int32)
    into = np.cumsum(size + 1) - size - 1
    out[ragged(np.arange(len(out)), into, size)] = ragged(ids, start, size)
    return out


def _flat(shard: pa.Table, column: str) -> np.ndarray:
    """A list column of a table of one row."""
    return shard.column(column).combine_chunks().flatten().to_numpy()


def _pairs(shard: pa.Table) -> pa.Table:
    """Pairs of frequent words in a shard, with counts."""
    at, word = _flat(shard, "at"), _flat(shard, "word")
    number, ids = shard.column("shard")[0].as_py(), shard.column("ids")[0].as_buffer()
    pair, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for phrase, count in FMIndex(_sequence(ids, at), 2).phrases(2):
        pair = word[phrase[:, 0] - 1] << 32 | word[phrase[:, 1] - 1]
    return pa.table({"shard": np.full(len(pair), number), "pair": pair, "n": count.astype(np.int32)})


def _longer(shard: pa.Table) -> pa.Table:
    """Phrases of three words and more over frequent pairs in a shard, with counts."""
    at, word = _flat(shard, "at"), _flat(shard, "word")
    order = np.argsort(word)
    local = lambda w: order[np.searchsorted(word[order], w)] + 1
    top = len(word) + 1
    pairs = _flat(shard, "pairs")
    good = np.sort(local(pairs >> 32) * top + local(pairs & 0xFFFFFFFF))
    ids = _sequence(shard.column("ids")[0].as_buffer(), at)
    key = ids[:-1] * np.int64(top) + ids[1:]
    where = np.minimum(np.searchsorted(good, key), len(good) - 1)
    # a separator goes between two words that are no frequent pair
    cut = np.flatnonzero((good[where] != key) & (ids[:-1] > 0) & (ids[1:] > 0)) + 1
    index = FMIndex(_tight(np.insert(ids, cut, 0), 3), MAX_WORDS)
    out = [pa.table({"head": np.zeros(0, np.int64), "tail": np.zeros(0, np.int64), "n": np.zeros(0, np.int32)})]
    for phrase, count in index.phrases(MAX_WORDS):
        if phrase.shape[1] > 2:
            w = word[phrase - 1]
            tail = w[:, 2] if phrase.shape[1] == 3 else w[:, 2] << 32 | w[:, 3]
            out.append(pa.table({"head": w[:, 0] << 32 | w[:, 1], "tail": tail, "n": count.astype(np.int32)}))
    return pa.concat_tables(out)


def numbered(rows: DataFrame) -> DataFrame:
    """``rows``, written, with ``id`` from 1 on without gaps (below 2^31, so that two fit a 64-bit number)."""
    rows = written(rows.withColumn("_i", F.monotonically_increasing_id()), "words")
    part = F.shiftright("_i", 33)
    sizes = rows.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # one row a partition
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    out = rows.withColumn("_p", part).join(F.broadcast(sizes.select("_p", before.alias("_b"))), "_p")
    out = out.withColumn("id", F.col("_b") + F.col("_i").bitwiseAND((1 << 33) - 1) + 1)
    return out.withColumn("id", F.when(F.col("id") < 1 << 31, F.col("id")).otherwise(F.raise_error(F.lit("too many words")))).drop("_p", "_b", "_i")


def _both(pair: str) -> list[Column]:
    return [F.shiftright(pair, 32), F.col(pair).bitwiseAND(0xFFFFFFFF)]


def frequent(docs: DataFrame, least: int = MIN_COUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words: id, lang, word, f; totals: lang, n; phrases of one to four words: ids, f), all written."""
    parts = written(shards(docs), "shards")
    each = parts.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("at", "x"))
    each = each.select("shard", "lang", "at", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    words = each.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    words = written(numbered(words), "numbered")
    totals = written(parts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    # which of a shard's words are frequent, by their places in the shard's list
    known = each.join(small(words.select("id", "lang", "word")), ["lang", "word"]).groupBy("shard")
    known = known.agg(F.array_sort(F.collect_list(F.struct("at", "id"))).alias("x")).select("shard", F.col("x.at").alias("at"), F.col("x.id").alias("word"))
    known = written(known, "known-words")
    coded = parts.select("shard", "ids").join(known, "shard")
    pairs = coded.groupBy("shard").applyInArrow(_pairs, "shard long, pair long, n int")
    pairs = pairs.withColumn("f", F.sum("n").over(Window.partitionBy("pair"))).where(F.col("f") >= least)
    pairs = written(pairs.select("shard", "pair", "f"), "pairs")
    of_shard = pairs.groupBy("shard").agg(F.collect_list("pair").alias("pairs"))
    longer = coded.join(of_shard, "shard").groupBy("shard").applyInArrow(_longer, "head long, tail long, n int")
    longer = longer.groupBy("head", "tail").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    three = F.array(*_both("head"), F.col("tail"))
    longer = longer.select(F.when(F.col("tail") < 1 << 32, three).otherwise(F.array(*_both("head"), *_both("tail"))).alias("ids"), "f")
    two = pairs.groupBy("pair").agg(F.first("f").alias("f")).select(F.array(*_both("pair")).alias("ids"), "f")
    phrases = words.select(F.array("id").alias("ids"), "f").unionByName(two).unionByName(longer)
    return words, totals, written(phrases, "phrases")


# --- scores -----------------------------------------------------------------


def score(a: Column, both: Column) -> Column:
    """floor(2000000 * a / (l + r)) in whole numbers beyond 64 bits."""
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * a.cast("decimal(20,0)"), both.cast("decimal(20,0)"))


def scored(phrases: DataFrame) -> DataFrame:
    """ids, a, l, r, score of every phrase of two words and more, by its weakest cut."""
    counted = small(phrases)
    long_ = phrases.where(F.size("ids") > 1).withColumnRenamed("f", "a")
    cuts = long_.select("ids", "a", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("head"), F.slice("ids", F.col("k") + 1, F.size("ids")).alias("tail"))
    cuts = cuts.join(counted.select(F.col("ids").alias("head"), F.col("f").alias("l")), "head")
    cuts = cuts.join(counted.select(F.col("ids").alias("tail"), F.col("f").alias("r")), "tail")
    cuts = cuts.withColumn("score", score(F.col("a"), F.col("l") + F.col("r")))
    best = cuts.groupBy("ids").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("b"))
    return best.select("ids", "b.a", "b.l", "b.r", "b.score")


def without_parts(candidates: DataFrame, phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """Candidates that no longer phrase holds in at least ``share`` percent of their occurrences.

    A phrase that holds another is at most as frequent as the phrases between
    them, so those with one more word decide.
    """
    wide = phrases.where(F.size("ids") > 2)
    n = F.size("ids")
    inside = wide.select("f", F.explode(F.array(F.slice("ids", F.lit(1), n - 1), F.slice("ids", F.lit(2), n - 1))).alias("ids"))
    inside = inside.groupBy("ids").agg(F.max("f").alias("held"))
    rows = candidates.join(inside, "ids", "left")
    return rows.where(F.col("held").isNull() | (100 * F.col("held") < share * F.col("a"))).drop("held")


def collocations(docs: DataFrame, least: int = MIN_COUNT, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best ``top`` phrases of each language."""
    words, totals, phrases = frequent(docs, least)
    kept = written(without_parts(scored(phrases), phrases, share), "candidates")
    named = kept.select("*", F.posexplode("ids").alias("at", "id")).join(small(words.select("id", "lang", "word")), "id")
    named = named.groupBy("ids", "a", "l", "r", "score").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("x"))
    named = named.select("lang", F.array_join("x.word", " ").alias("phrase"), "a", "l", "r", "score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
