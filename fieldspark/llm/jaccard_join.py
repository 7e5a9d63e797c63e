"""Exact n-gram Jaccard self-join by PartEnum signatures.

Two sets link when their Jaccard similarity is at least 3/4, so they differ in
at most (|r| + |s|) / 7 shingles.  Sets are put in size bands [10 * 2^t,
20 * 2^t); a set whose partners may be in the next band gets that band's
signatures, too.  In a band the domain of shingles is cut into first-level
parts, more than half as many as linked sets can have differences: some parts
then hold one difference at most.  Each is cut into n2 second-level parts, and
every subset of n2 - 1 of them makes a signature (of the set's shingles there,
the part, the subset and the band); the one without the difference is shared.
n2 is 3 up to band WIDE, where parts are small, and 2 beyond, where that gives
fewer signatures that still hold enough shingles.

A signature of no shingles is not written, so how many a set is sure to share
with each partner depends on how evenly it fills its parts.  With n2 = 3 those
first-level parts count where at most one of the three is empty, less the most
that can hold two differences; with n2 = 2 all its signatures, less the most
differences.  Sets where that is not positive are cut anew by further hashes (two sets that miss each other are both of this kind) and at
last, if no hash serves them, have each single shingle as a signature.  Sets of
up to TINY shingles meet by the finest cut, each shingle a part of its own: all
subsets that leave out up to a quarter.  A set whose shared signatures are fewer
than its bound has no partner; sets that have only a passage in common end there.

No group of equal signatures is turned into all its pairs at once.  Equal sets
are one set from the start.  First each member is compared with the first member
of its groups.  Then the sets that are outside the largest component of their
family (sets that rare shingles tie together) are queries against that family, in
blocks of bounded size; a task compares two blocks and returns links only.

Shingles are told apart by 64-bit hashes and equal sets by 128-bit digests, so
"exact" is up to collisions of those.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import keep_ids, slices, small, written
from fieldspark.llm.components import components
from fieldspark.llm.shingles import mix, shingle_sets

_U = np.uint64
#: Linked: 4 * intersection >= 3 * union.
#: ``code`` = (band, hash) * CODE + signatures that a partner must share.
CODE = 1 << 24
#: Largest set that meets others by its subsets.
TINY = 9
#: Smallest size of the first band.
FIRST = 10
#: From this band on, n2 is 2.
WIDE = 4
#: Hashes by which sets are cut before single shingles serve.
SEEDS = 4
#: Shingles in a block of sets that are compared with another block in one task: a
#: third of the family within these bounds, so its sets travel three times, or more
#: often only in families that one task can't hold.
BLOCK, LEAST_BLOCK = 4_000_000, 50_000
#: Sets in a block that are compared with the first of their group in one task.
STAR = 2_000


def _sets(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return shingle_sets([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()])


def set_digests(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles and a 128-bit digest of the set of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, bounds = _sets(batch)
            out = [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(bounds))]
            for salt in (1, 2):
                total = np.concatenate([[_U(0)], np.cumsum(mix(h * _U(2 * salt + 1) + _U(salt)), dtype=_U)])
                out.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "text_hash", "n_shingles", "d1", "d2"])

    return docs.mapInArrow(work, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long")


def parts_of(band: int) -> int:
    """First-level parts in a band: half the most differences, and some more."""
    most = (2 * (FIRST * 2 ** (band + 1) - 1)) // 7
    return most // 2 + 2 + most // (36 if band < WIDE else 20)


def _subsets(h: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of tiny sets: all subsets that leave out up to a quarter."""
    sigs, owners = [], []
    size = np.diff(bounds)
    for n in np.unique(size[rows]):
        at = rows[size[rows] == n]
        value = h[bounds[at][:, None] + np.arange(n)]
        total = value.sum(axis=1, dtype=_U)[:, None]
        for left_out in range(n // 4 + 1):
            pick = np.array(list(combinations(range(n), left_out)), np.int64).reshape(comb(n, left_out), left_out)
            found = total - value[:, pick].sum(axis=2, dtype=_U)
            sigs.append(found.ravel())
            owners.append(np.repeat(at, len(pick)))
    if not sigs:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    return mix(np.concatenate(sigs) ^ mix(np.full(1, 0x7151, _U))), np.concatenate(owners)


def _two_levels(value: np.ndarray, row: np.ndarray, size: np.ndarray, tag: np.ndarray, seed: int, n2: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, place in ``size``, signatures sure to be shared by each set) of sets in their bands.

    ``value`` and ``row``: hashes of all shingles and the set of each, ``tag``
    the band of each set.
    """
    parts = np.array([parts_of(t) for t in range(int(tag.max()) + 1)], np.int64)[tag]
    first = np.cumsum(n2 * parts) - n2 * parts  # cells of a set: n2 for each part
    place = mix(value + _U(0x9E37 * seed + 1)) >> _U(32)
    cell = first[row] + ((place * (n2 * parts).astype(_U)[row]) >> _U(32)).astype(np.int64)
    n = int(n2 * parts.sum())
    sums = np.zeros(n, _U)
    order = np.argsort(cell, kind="stable")
    cells = cell[order]
    at = np.flatnonzero(np.diff(cells, prepend=-1))
    sums[cells[at]] = np.add.reduceat(mix(value + _U(0x51ED270B))[order], at)
    filled = np.zeros(n, bool)
    filled[cells[at]] = True
    sums, filled = sums.reshape(-1, n2), filled.reshape(-1, n2)
    owner = np.repeat(np.arange(len(size)), parts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    most = (size + np.minimum((4 * size) // 3, FIRST * 2 ** (tag + 1) - 1)) // 7
    if n2 == 2:
        sure = np.bincount(owner, weights=filled.sum(axis=1), minlength=len(size)).astype(np.int64) - most
    else:
        sure = np.bincount(owner, weights=filled.sum(axis=1) >= 2, minlength=len(size)).astype(np.int64) - most // 2
    name = (number * 64 + tag[owner]).astype(_U) * _U(4 * SEEDS) + _U(4 * seed)
    sigs, owners = [], []
    for k, kept in enumerate(combinations(range(n2), n2 - 1)):
        some = filled[:, kept].any(axis=1)
        sigs.append(mix(sums[some][:, kept].sum(axis=1, dtype=_U) + mix(name[some] + _U(k))))
        owners.append(owner[some])
    return np.concatenate(sigs), np.concatenate(owners), sure


def signatures(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(signature, row, code) of all sets in ``shingle_sets`` form."""
    size = np.diff(bounds).astype(np.int64)
    tiny = np.flatnonzero((size > 0) & (size <= TINY))
    sig, owner = _subsets(h, bounds, tiny)
    out: tuple[list, list, list] = ([sig], [owner], [np.ones(len(sig), np.int64)])

    def add(sig: np.ndarray, owner: np.ndarray, kind: np.ndarray, need: np.ndarray) -> None:
        for o, x in zip(out, (sig, owner, kind * CODE + np.clip(need, 1, CODE - 1))):
            o.append(x)

    band = np.zeros(len(size), np.int64)
    band[size >= FIRST] = np.floor(np.log2(size[size >= FIRST] / FIRST)).astype(np.int64)
    band[size < FIRST] = -1
    for up, n2 in product((0, 1), (2, 3)):
        tag = band + up
        # the next band only for sets that have partners there
        rows = (size >= FIRST) if not up else (size > 0) & ((4 * size) // 3 >= FIRST * 2**tag)
        rows = np.flatnonzero(rows & ((tag >= WIDE) if n2 == 2 else (tag < WIDE)))
        for seed in range(SEEDS + 1):
            if not len(rows):
                break
            n = size[rows]
            element = np.repeat(bounds[rows], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row = np.repeat(np.arange(len(rows)), n)
            if seed == SEEDS:  # no hash parts these sets well
                who = rows[row]
                single = mix(mix(h[element] + _U(0x51ED270B)) ^ mix(_U(0xABCDEF) + tag[who].astype(_U)))
                add(single, who, 1 + tag[who] * (SEEDS + 1) + seed, (3 * size[who] + 3) // 4)
                break
            sig, at, sure = _two_levels(h[element], row, n, tag[rows], seed, n2)
            add(sig, rows[at], 1 + tag[rows][at] * (SEEDS + 1) + seed, sure[at])
            rows = rows[sure <= 0]
    return tuple(np.concatenate(o) for o in out)  # type: ignore[return-value]


def signature_rows(docs: DataFrame) -> DataFrame:
    """sig, doc_id, code of every signature of every document."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sig, row, code = signatures(*_sets(batch))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for at in range(0, len(sig), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sig[part].view(np.int64)), pa.array(ids[row[part]], pa.int64()), pa.array(code[part])],
                    ["sig", "doc_id", "code"],
                )

    return docs.select("doc_id", "text").mapInArrow(work, "sig long, doc_id long, code long")


def _apart(members: DataFrame, component: str = "component") -> DataFrame:
    """Drops signatures that only one component has."""
    w = Window.partitionBy("sig")
    m = members.withColumn("lo", F.min(component).over(w)).withColumn("hi", F.max(component).over(w))
    return m.filter("lo <> hi").drop("lo", "hi")


def _enough(members: DataFrame) -> DataFrame:
    """Drops the sets that share too few signatures for any partner."""
    n = F.count("*").over(Window.partitionBy("doc_id", "code"))
    return members.withColumn("n", n).filter(F.col("n") >= F.col("code") % CODE).drop("n")


def _set_rows(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, s (hashes of the set) of the documents in ``ids``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            h, bounds = _sets(batch)
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sets], ["doc_id", "s"])

    return keep_ids(docs.select("doc_id", "text"), written(ids.distinct(), "ids"), "doc_id", "left_semi").mapInArrow(work, "doc_id long, s array<long>")


def linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b), a < b, whose sets reach the threshold.

    Sets are sent to their pair's a, in blocks of STAR sets; a's own set comes
    first in each block and the others pass by it.
    """

    n = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("blocks"))
    salt = F.pmod(F.xxhash64("b"), F.col("blocks"))
    members = pairs.join(n, "a").select("a", salt.alias("salt"), F.col("b").alias("doc_id"))
    firsts = n.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("salt"), F.col("a").alias("doc_id"))
    keyed = written(members.unionByName(firsts), "stars")
    rows = _set_rows(keyed.select("doc_id"), docs).join(small(keyed), "doc_id")
    rows = rows.withColumn("other", F.col("doc_id") != F.col("a")).repartition("a", "salt").sortWithinPartitions("a", "salt", "other")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first = None, np.zeros(0, _U)
        for batch in batches:
            a, salt, ids = (batch.column(c).to_numpy() for c in ("a", "salt", "doc_id"))
            bounds = batch.column("s").offsets.to_numpy()
            h = batch.column("s").values.to_numpy().view(_U)
            out: tuple[list, list] = ([], [])
            for i in range(batch.num_rows):
                own = h[bounds[i] : bounds[i + 1]]
                if ids[i] == a[i]:
                    # texts of one id: sets of equal key, the last one counts as well
                    key, first = (a[i], salt[i]), own if key != (a[i], salt[i]) else np.union1d(first, own)
                    continue
                n = len(np.intersect1d(own, first, assume_unique=True))
                if key == (a[i], salt[i]) and 4 * n >= 3 * (len(own) + len(first) - n):
                    out[0].append(a[i])
                    out[1].append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(o, pa.int64()) for o in out], ["a", "b"])

    return rows.mapInArrow(work, "a long, b long")


def _with_first(members: DataFrame, apart: str) -> DataFrame:
    """(a, b): each member with the first of its group, where they differ in ``apart``."""
    first = F.min(F.struct("component", "doc_id")).over(Window.partitionBy("sig"))
    pairs = members.withColumn("first", first).filter(f"{apart} <> first.{apart}")
    return pairs.select(F.least("doc_id", "first.doc_id").alias("a"), F.greatest("doc_id", "first.doc_id").alias("b")).distinct()


def _by_key(names: tuple[str, ...], out: tuple[str, str], found):
    """A task over rows sorted by ``names``: ``found(rows of a key, key)`` gives two columns of numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def close():
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found(pa.concat_batches(held), key)], list(out))

        for batch in batches:
            keys = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            change = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for lo, hi in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                now = tuple(int(k[lo]) for k in keys)
                if now != key and held:
                    yield close()
                    held = []
                key = now
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield close()

    return work


def _ties(members: DataFrame, docs: DataFrame) -> DataFrame:
    """sig, doc_id, component: the rarest shingles of each set, as far as sets of other components hold them.

    Linked sets have three quarters of either in common, so of shingles in one
    and the same order they share one of the first quarter and one more.  What
    many sets have in common, such as a passage, comes last in that order.
    """
    ids = written(members.select("doc_id", "component").distinct(), "held")
    sets = _set_rows(ids.select("doc_id"), docs).join(small(ids), "doc_id")
    rows = sets.select("doc_id", "component", F.size("s").alias("size"), F.explode("s").alias("sig"))
    w = Window.partitionBy("sig")
    often = F.when(F.min("component").over(w) < F.max("component").over(w), F.count("*").over(w)).otherwise(0)
    # texts of one id: a set that is there twice has its shingles twice, in one place
    place = F.dense_rank().over(Window.partitionBy("doc_id").orderBy("often", "sig"))
    rows = rows.withColumn("often", often).withColumn("place", place)
    return written(rows.filter("often > 0 AND place <= size div 4 + 1").select("sig", "doc_id", "component"), "ties")


def _linked_in_families(members: DataFrame, base: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between sets of different components that are left in ``members``.

    Sets that share ties, directly or by way of others, are a family; no link
    leaves it.  By their signatures, sets that have a passage in common would
    be tied, and with enough of them most of a corpus is one family.  All its sets but those of its largest component are
    queries against all of it.  Queries and family are cut into blocks of
    about BLOCK shingles; a task counts the shingles that each query of one
    block has in common with each set of another.  Only links come out: the
    first found between a query and each other component in the block.
    """
    members = _ties(members, docs)
    family = components(_with_first(members, "doc_id")).withColumnRenamed("id", "doc_id").withColumnRenamed("component", "family")
    sizes = base.groupBy("doc_id").agg(F.max("n_shingles").alias("size"))
    one = members.select("doc_id", "component").distinct().join(family, "doc_id").join(sizes, "doc_id")
    one = written(one, "families")
    parts = one.groupBy("family", "component").agg(F.sum("size").alias("part"))
    per = parts.groupBy("family").agg(F.sum("part").alias("total"), F.max_by("component", F.struct("part", "component")).alias("major"), F.max("part").alias("most"))
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.col("total") / 3))
    per = per.select("family", "major", F.ceil(F.col("total") / block).alias("n_db"), F.ceil((F.col("total") - F.col("most")) / block).alias("n_q"))
    rows = one.join(per, "family")
    place = lambda salt, n: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.col(n))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    db = rows.select("family", "doc_id", "component", F.lit(False).alias("query"), place(1, "n_db").alias("db"), upto("n_q").alias("q"))
    q = rows.filter("component <> major").select("family", "doc_id", "component", F.lit(True).alias("query"), upto("n_db").alias("db"), place(2, "n_q").alias("q"))
    blocks = _set_rows(one.select("doc_id"), docs).join(small(written(db.union(q), "blocks")), "doc_id")
    keyed = blocks.repartition("family", "db", "q").sortWithinPartitions("family", "db", "q")

    return keyed.mapInArrow(_by_key(("family", "db", "q"), ("a", "b"), lambda block, _: _compare(block)), "a long, b long")


def _compare(block: pa.RecordBatch) -> tuple[list[int], list[int]]:
    """Links between the queries of a block and its other sets."""
    ids, comps = (block.column(c).to_numpy() for c in ("doc_id", "component"))
    query = block.column("query").to_numpy(zero_copy_only=False)
    column = block.column("s")
    bounds = column.offsets.to_numpy().astype(np.int64)
    h = column.values.to_numpy().view(_U)
    size = np.diff(bounds)
    db = np.flatnonzero(~query)
    a, b = [], []
    if not len(db) or not query.any():
        return a, b
    owner = np.repeat(np.arange(len(size)), size)
    inside = np.repeat(~query, size)
    values, owners = h[bounds[0] : bounds[-1]][inside], owner[inside]
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    for i in np.flatnonzero(query):
        own = h[bounds[i] : bounds[i + 1]]
        lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.bincount(owners[at], minlength=len(size))
        hit = np.flatnonzero((4 * both >= 3 * (size[i] + size - both)) & (both > 0) & (comps != comps[i]))
        if len(hit):
            _, first = np.unique(comps[hit], return_index=True)
            a += [int(ids[i])] * len(first)
            b += ids[hit[first]].tolist()
    return a, b


def _tally(block: pa.RecordBatch, key: tuple[int, ...]) -> tuple[list[int], list[int]]:
    """(id, documents that it links to) of two blocks ``i`` and ``j`` of a component, or within one.

    Sets are told by what they have or lack against those shingles that most
    have: |A & B| = |R| - |R - A| - |R - B| + |(A ^ R) & (B ^ R)|, so near
    copies cost their differences only.
    """
    _, i, j = key
    ids, node = np.unique(block.column("doc_id").to_numpy(), return_inverse=True)
    n, side = len(node), block.column("part").to_numpy()
    weight = np.zeros(len(ids), np.int64)
    weight[node] = block.column("weight").to_numpy()
    bounds = block.column("s").offsets.to_numpy().astype(np.int64)
    size = np.diff(bounds)
    owner = np.repeat(np.arange(n), size)
    values, place, count = np.unique(block.column("s").values.to_numpy()[bounds[0] : bounds[-1]], return_inverse=True, return_counts=True)
    often = 2 * count > n
    number = np.cumsum(often) - 1
    has = np.zeros((n, int(often.sum())), bool)
    usual = often[place]
    has[owner[usual], number[place[usual]]] = True
    lacks = has.shape[1] - has.sum(axis=1)
    who, what = np.nonzero(~has)
    del has
    who, what = np.concatenate([who, owner[~usual]]), np.concatenate([np.flatnonzero(often)[what], place[~usual]])
    order = np.argsort(what, kind="stable")
    holders, start = who[order], np.searchsorted(what[order], np.arange(len(values) + 1))
    order = np.argsort(who, kind="stable")
    differs, at = what[order], np.searchsorted(who[order], np.arange(n + 1))
    most = int(often.sum())
    rows = np.argsort(node, kind="stable")
    rows = np.split(rows, np.flatnonzero(np.diff(node[rows])) + 1)
    links = np.zeros(len(ids), np.int64)
    for a, own in enumerate(rows):
        if side[own[0]] != i:
            continue
        near = np.zeros(n, bool)
        for x in own:
            d = differs[at[x] : at[x + 1]]
            lo, length = start[d], start[d + 1] - start[d]
            take = np.repeat(lo - np.cumsum(length) + length, length) + np.arange(length.sum())
            both = most - lacks[x] - lacks + np.bincount(holders[take], minlength=n)
            near |= (4 * both >= 3 * (size[x] + size - both)) & (both > 0) & (side == j)
        to = np.unique(node[near])
        to = to[to != a]
        links[a] += weight[to].sum()
        if i != j:
            links[to] += weight[a]
    some = np.flatnonzero(links)
    return ids[some].tolist(), links[some].tolist()


def link_counts(docs: DataFrame, base: DataFrame, found: DataFrame) -> DataFrame:
    """id, n_links: other documents that each document of a component links to.

    Links never leave a component.  Documents with one and the same set are
    compared as one that counts for all of them; those with several texts
    stand alone.  Each component is cut into blocks, every two of which meet
    in one task.
    """
    sets = base.filter("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", F.struct("n_shingles", "d1", "d2").alias("set"))
    per = sets.distinct().groupBy("doc_id").agg(F.count("*").alias("n"), F.max("set").alias("set"), F.sum("set.n_shingles").alias("size"))
    per = per.select("doc_id", "size", F.when(F.col("n") == 1, F.to_json("set")).alias("set"))
    alike = per.filter("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("first"), F.count("*").alias("weight")).filter("weight > 1")
    per = per.join(small(written(alike, "alike")), "set", "left").join(small(found), F.col("doc_id") == F.col("id"))
    per = per.select("doc_id", "component", "size", F.coalesce("first", "doc_id").alias("first"), F.coalesce("weight", F.lit(1)).alias("weight"))
    per = written(per, "counted")
    firsts = per.filter("doc_id = first")
    cut = firsts.groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("total")).filter("n > 1")
    cut = cut.select("component", F.greatest(F.ceil(F.col("total") / BLOCK), F.ceil(F.col("n") / STAR)).alias("parts"))
    rows = firsts.join(small(written(cut, "cut")), "component")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    rows = rows.select("component", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "doc_id", "part", "weight")
    rows = written(rows, "parts")
    keyed = _set_rows(rows.select("doc_id"), docs).join(small(rows), "doc_id")
    keyed = keyed.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    links = keyed.mapInArrow(_by_key(("component", "i", "j"), ("first", "n"), _tally), "first long, n long").groupBy("first").agg(F.sum("n").alias("n"))
    every = per.join(small(written(links, "tallies")), "first", "left")
    return every.select(F.col("doc_id").alias("id"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))


def _with_components(members: DataFrame, found: DataFrame) -> DataFrame:
    m = members.drop("component").join(small(found.withColumnRenamed("id", "doc_id")), "doc_id", "left")
    return m.select("sig", "doc_id", "code", F.coalesce("component", "doc_id").alias("component"))


def _nodes(base: DataFrame) -> DataFrame | None:
    """doc_id, text_hash, node of the second and further sets of documents with several; None if there are none.

    A document's first set is called by doc_id itself, the others by numbers
    above all doc_ids, so the smallest name in a component is a doc_id.
    """
    sets = base.filter("doc_id IS NOT NULL").select("doc_id", "text_hash", F.struct("n_shingles", "d1", "d2").alias("set"))
    several = sets.groupBy("doc_id").agg(F.min("set").alias("first"), F.max("set").alias("last")).filter("first <> last")
    several = written(several, "several")
    if not several.limit(1).count():
        return None
    most = base.agg(F.max("doc_id")).first()[0]
    others = sets.join(small(several), "doc_id").filter("set <> first").select("doc_id", "text_hash").distinct()
    others = written(others, "others")
    return others.withColumn("node", F.lit(most) + 1 + F.monotonically_increasing_id())


def jaccard_components(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of ``docs``.

    component_id: the smallest doc_id that links reach, itself included.
    n_links: how many other documents it links to; left out unless asked for.
    Null or empty texts, and those without words, have no shingles and no
    links.  Rows with one doc_id are one document that links if any of its
    texts does; they come back once each.  A null doc_id links with nothing
    and has a null component.  Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    base = written(set_digests(docs), "digests")
    texts, named = docs, base
    others = _nodes(base)
    if others is not None:
        name = F.coalesce("node", "doc_id").alias("doc_id")
        texts = docs.join(small(others), ["doc_id", "text_hash"], "left").select(name, "text")
        named = written(base.join(small(others), ["doc_id", "text_hash"], "left").select(name, "n_shingles", "d1", "d2"), "named")
    usable = named.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    groups = usable.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).filter("n > 1").drop("n")
    copies = usable.join(written(groups, "groups"), ["n_shingles", "d1", "d2"]).filter("doc_id <> rep").select("doc_id", "rep").distinct()
    copies = written(copies, "copies")
    links = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    if others is not None:
        links = links.union(others.select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    unique = keep_ids(texts.filter("doc_id IS NOT NULL"), copies.select("doc_id").distinct(), "doc_id", "left_anti")

    # every set is a component of its own: nothing but its id travels with its signatures
    members = _enough(_apart(signature_rows(unique), "doc_id")).withColumn("component", F.col("doc_id"))
    members = written(members, "members")
    # 1: everyone with the first of each group
    links = written(links.union(linked(written(_with_first(members, "component"), "pairs"), texts)), "links")
    # 2: what is still apart, family by family
    members = written(_enough(_apart(_with_components(members, components(links)))), "members")
    links = written(links.union(_linked_in_families(members, named, texts)), "links")
    found = written(components(links), "components")
    columns = ["doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")]
    if count_links:
        found = found.join(link_counts(docs, base, found), "id", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return base.join(found, base.doc_id == found.id, "left").select(*columns)


#: The same rows as ``jaccard_components(documents)`` where doc_ids are distinct: every two documents that share a shingle are compared.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 75 * (x.k + y.k - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS reached FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.reached = e.a),
c AS (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY 1),
d AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT doc_id, coalesce(k, 0) AS n_shingles, component_id, coalesce(n_links, 0) AS n_links
FROM c LEFT JOIN n USING (doc_id) LEFT JOIN d USING (doc_id)
"""
