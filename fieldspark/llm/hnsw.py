"""Nearest neighbours by inner product: a navigable small-world graph per shard.

Equal vectors are one node.  Nodes are dealt to shards by hash; a task builds
the layered graph of its shard in batches, all searches of a batch in step,
and stores it as flat arrays (neighbours of every node, layer by layer, -1
where there is none).  Queries visit every shard of vectors of their length, a
shard's index row first and then its queries as a stream; the shards' results
are merged by Spark.

Links follow the inner product itself.  How wide a beam a shard needs is
measured while it is built: PROBES nodes stay out at first, are searched for
against exact results with wider and wider beams until RECALL of their
neighbours is found, and are put in last; the index row keeps that width.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import written
from fieldspark.llm.shingles import mix

#: Links of a node: above the ground layer, and on it.
LINKS, GROUND_LINKS = 16, 32
#: Beams: while building, and the first that is tried for searches.
EF_BUILD, EF_SEARCH = 64, 96
#: Nodes that measure a shard's beam, and the share of their nearest that it has to find.
PROBES, RECALL = 128, 0.97
#: Shards: MIN_SHARDS of at least LEAST nodes, more so that the vectors of none are over SHARD_BYTES.
MIN_SHARDS, LEAST, SHARD_BYTES = 16, 64, 8 << 20
BATCH = 256


class Graph:
    def __init__(self, vectors: np.ndarray, levels: np.ndarray, links: list[np.ndarray] | None = None):
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.levels = levels
        top = int(levels.max(initial=0))
        n = len(vectors)
        self.nodes = [np.flatnonzero(levels >= lv) for lv in range(top + 1)]
        self.row = []
        for nodes in self.nodes:
            row = np.full(n, -1, np.int64)
            row[nodes] = np.arange(len(nodes))
            self.row.append(row)
        self.links = links or [np.full((len(v), LINKS if lv else GROUND_LINKS), -1, np.int32) for lv, v in enumerate(self.nodes)]

    # --- search ---

    def layer(self, lv: int, q: np.ndarray, entry: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(nodes, similarities), best first, of a beam search of every query on one layer."""
        b, links, row = len(q), self.links[lv], self.row[lv]
        beam = np.full((b, ef), -1, np.int64)
        sims = np.full((b, ef), -np.inf, np.float32)
        open_ = np.zeros((b, ef), bool)
        seen = np.zeros((b, len(self.nodes[lv])), bool)
        beam[:, 0], sims[:, 0], open_[:, 0] = entry, np.einsum("bd,bd->b", q, self.x[entry]), True
        seen[np.arange(b), row[entry]] = True
        act = np.arange(b)
        while len(act):
            at = np.argmax(np.where(open_[act], sims[act], -np.inf), axis=1)
            here = beam[act, at]
            open_[act, at] = False
            near = links[row[here]].astype(np.int64)
            ok = near >= 0
            place = row[np.where(ok, near, here[:, None])]
            ok &= ~seen[act[:, None], place]
            seen[act[:, None], place] = True
            s = np.einsum("bkd,bd->bk", self.x[np.where(ok, near, 0)], q[act])
            s[~ok] = -np.inf
            all_s = np.concatenate([sims[act], s], axis=1)
            keep = np.argsort(-all_s, axis=1, kind="stable")[:, :ef] if ef > 1 else np.argmax(all_s, axis=1)[:, None]
            pick = lambda old, new: np.take_along_axis(np.concatenate([old, new], axis=1), keep, axis=1)
            beam[act] = pick(beam[act], near)
            open_[act] = pick(open_[act], ok)
            sims[act] = np.take_along_axis(all_s, keep, axis=1)
            open_[act] &= sims[act] > -np.inf
            act = act[open_[act].any(axis=1)]
        beam[sims == -np.inf] = -1
        return beam, sims

    def search(self, q: np.ndarray, ef: int) -> np.ndarray:
        """Nodes (-1: none) that the descent finds for each query."""
        out = []
        step = max(8, min(BATCH, (1 << 26) // max(1, len(self.x))))
        for at in range(0, len(q), step):
            part = np.ascontiguousarray(q[at : at + step], np.float32)
            entry = np.full(len(part), self.nodes[-1][0])
            for lv in range(len(self.nodes) - 1, 0, -1):
                entry = self.layer(lv, part, entry, 1)[0][:, 0]
            out.append(self.layer(0, part, entry, ef)[0])
        return np.concatenate(out) if out else np.zeros((0, ef), np.int64)

    # --- build ---

    def _select(self, cand: np.ndarray, sims: np.ndarray, m: int) -> np.ndarray:
        """At most m of each row's candidates (best first): one that is closer to
        a chosen one than to the node itself waits until others are in."""
        b, c = cand.shape
        v = self.x[np.maximum(cand, 0)]
        between = np.matmul(v, v.transpose(0, 2, 1))
        valid = cand >= 0
        chosen = np.zeros((b, c), bool)
        closest = np.full((b, c), -np.inf, np.float32)
        count = np.zeros(b, np.int64)
        for j in range(c):
            take = valid[:, j] & (count < m) & (closest[:, j] < sims[:, j])
            chosen[take, j] = True
            count += take
            closest[take] = np.maximum(closest[take], between[take, j])
        order = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)) * c + np.arange(c), axis=1)[:, :m]
        out = np.take_along_axis(np.where(valid, cand, -1), order, axis=1)
        return np.pad(out, ((0, 0), (0, max(0, m - out.shape[1]))), constant_values=-1)

    def _connect(self, lv: int, new: np.ndarray, chosen: np.ndarray) -> None:
        """Links each new node to its chosen ones and these back to it."""
        links, row = self.links[lv], self.row[lv]
        m = links.shape[1]
        links[row[new], : chosen.shape[1]] = chosen
        src = np.repeat(new, chosen.shape[1])[chosen.ravel() >= 0]
        dst = chosen.ravel()[chosen.ravel() >= 0]
        if not len(dst):
            return
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        nodes, first, n = np.unique(dst, return_index=True, return_counts=True)
        for at in range(0, len(nodes), 512):
            y = nodes[at : at + 512]
            k = int(n[at : at + 512].max())
            more = np.full((len(y), k), -1, np.int64)
            r = np.repeat(np.arange(len(y)), n[at : at + 512])
            c = np.arange(len(r)) - np.repeat(np.cumsum(n[at : at + 512]) - n[at : at + 512], n[at : at + 512])
            lo = first[at]
            more[r, c] = src[lo : lo + len(r)]
            cand = np.concatenate([links[row[y]].astype(np.int64), more], axis=1)
            # a new node may have chosen y and been chosen by it
            back = np.sort(cand, axis=1)
            back[:, 1:][back[:, 1:] == back[:, :-1]] = -1
            sims = np.einsum("bkd,bd->bk", self.x[np.maximum(back, 0)], self.x[y])
            sims[back < 0] = -np.inf
            best = np.argsort(-sims, axis=1, kind="stable")[:, : 2 * m]
            back, sims = np.take_along_axis(back, best, axis=1), np.take_along_axis(sims, best, axis=1)
            full = (back >= 0).sum(axis=1) > m
            out = np.pad(back, ((0, 0), (0, max(0, m - back.shape[1]))), constant_values=-1)[:, :m]
            if full.any():
                out[full] = self._select(back[full], sims[full], m)
            links[row[y]] = out

    def build(self, k: int = 20) -> int:
        """Puts all nodes in; the beam that finds RECALL of the k nearest of nodes that weren't in yet."""
        # the top layer's nodes go in first, so every search has its entry
        order = np.argsort(-self.levels, kind="stable")
        ground = order[self.levels[order] == 0]
        probes = ground[:: max(1, -(-len(ground) // PROBES))][: len(order) // 4]
        rest = order[~np.isin(order, probes)]
        self._insert(rest, 0)
        ef = self._beam(rest, probes, k)
        self._insert(np.concatenate([rest, probes]), len(rest))
        return ef

    def _beam(self, inside: np.ndarray, probes: np.ndarray, k: int) -> int:
        k, ef = min(k, len(inside)), max(EF_SEARCH, k)
        if not len(probes):
            return ef
        sims = self.x[probes] @ self.x[inside].T
        least = -np.partition(-sims, k - 1, axis=1)[:, k - 1 : k]  # ties count as found
        while True:
            found = self.search(self.x[probes], ef)
            s = np.einsum("bkd,bd->bk", self.x[np.maximum(found, 0)], self.x[probes])
            hits = np.minimum(((s >= least - 1e-6 * np.abs(least)) & (found >= 0)).sum(axis=1), k).sum()
            if hits >= RECALL * k * len(probes) or ef >= len(inside):
                return ef
            ef = min(len(inside), ef * 3 // 2)

    def _insert(self, order: np.ndarray, done: int) -> None:
        """Puts in the nodes of ``order`` from place ``done`` on; those before are in."""
        while done < len(order):
            size = min(max(32, done), BATCH, max(8, (1 << 26) // len(order)), len(order) - done)
            new = order[done : done + size]
            q = self.x[new]
            entry = np.full(size, order[0])
            within = q @ q.T
            np.fill_diagonal(within, -np.inf)
            for lv in range(int(self.levels[order[0]]), -1, -1):
                mine = self.levels[new] >= lv
                m = LINKS
                if done and (~mine).any():
                    entry[~mine] = self.layer(lv, q[~mine], entry[~mine], 1)[0][:, 0]
                if not mine.any():
                    continue
                found, sims = np.zeros((mine.sum(), 0), np.int64), np.zeros((mine.sum(), 0), np.float32)
                if done:
                    found, sims = self.layer(lv, q[mine], entry[mine], EF_BUILD)
                    entry[mine] = found[:, 0]
                peers = within[np.ix_(mine, mine)]
                k = min(EF_BUILD // 2, peers.shape[1])
                near = np.argsort(-peers, axis=1, kind="stable")[:, :k]
                peer_sims = np.take_along_axis(peers, near, axis=1)
                cand = np.concatenate([found, np.where(peer_sims > -np.inf, new[mine][near], -1)], axis=1)
                sims = np.concatenate([sims, peer_sims], axis=1)
                best = np.argsort(-sims, axis=1, kind="stable")[:, :EF_BUILD]
                cand, sims = np.take_along_axis(cand, best, axis=1), np.take_along_axis(sims, best, axis=1)
                self._connect(lv, new[mine], self._select(cand, sims, m))
            done += size


def _levels(ids: np.ndarray) -> np.ndarray:
    u = (mix(ids.astype(np.int64).view(np.uint64) + np.uint64(77)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return np.minimum(np.floor(-np.log(np.maximum(u, 1e-18)) / math.log(LINKS)), 12).astype(np.int64)


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, v: distinct rows without null, zero, or non-finite vectors."""
    v = F.col(vector_column).cast("array<double>")
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.filter(F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    return written(rows.distinct(), "vectors")


def nodes(rows: DataFrame, k: int) -> DataFrame:
    """v, id (the smallest), ids (the k + 1 smallest, ascending) of each distinct vector.

    More ids of one vector cannot be among a query's k nearest, since ties go
    to smaller ids.  The limit is applied before the shuffle.
    """
    w = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    return few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select("v", F.get("ids", F.lit(0)).alias("id"), "ids")


def shard_plan(node_rows: DataFrame) -> DataFrame:
    """dim, first, n_shards: which shards hold the vectors of each length; one row a length."""
    bytes_ = F.col("n") * 8 * F.col("dim")
    n_shards = F.greatest(F.least(F.lit(MIN_SHARDS), F.expr(f"n div {LEAST}")), F.ceil(bytes_ / SHARD_BYTES), F.lit(1)).cast("long")
    lengths = node_rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).withColumn("n_shards", n_shards)
    before = F.sum("n_shards").over(Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1))
    return lengths.select("dim", "n_shards", F.coalesce(before, F.lit(0)).alias("first"))


def build_index(node_rows: DataFrame, plan: DataFrame, k: int = 20) -> DataFrame:
    """One row per shard: shard, n, dim, ef (the beam it needs for k neighbours), ids, vectors, levels and links
    (flat arrays as bytes)."""
    n_shards = plan.agg(F.coalesce(F.sum("n_shards"), F.lit(1))).first()[0]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}

        def close(shard: int) -> pa.RecordBatch:
            t = pa.Table.from_batches(held.pop(shard)).combine_chunks()
            ids = t.column("id").to_numpy()
            x = t.column("v").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
            g = Graph(x, _levels(ids))
            ef = g.build(k)
            row = {
                "shard": shard, "n": len(ids), "dim": x.shape[1], "ef": ef, "ids": ids.astype("<i8").tobytes(), "vectors": x.astype("<f8").tobytes(),
                "levels": g.levels.astype("<i1").tobytes(), "links": b"".join(a.astype("<i4").tobytes() for a in g.links),
            }
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("shard", pa.int32()), ("n", pa.int64()), ("dim", pa.int32()), ("ef", pa.int32())] + [(c, pa.binary()) for c in ("ids", "vectors", "levels", "links")])
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo < hi:
                    shard = int(shards[lo])
                    for old in [s for s in held if s != shard]:
                        yield close(old)
                    held.setdefault(shard, []).append(batch.slice(lo, hi - lo))
        for old in list(held):
            yield close(old)

    dealt = node_rows.withColumn("dim", F.size("v")).join(F.broadcast(plan), "dim")
    dealt = dealt.select((F.col("first") + F.pmod(F.xxhash64("id"), "n_shards")).cast("int").alias("shard"), "id", "v")
    dealt = dealt.repartition(n_shards, "shard").sortWithinPartitions("shard", "id")
    return dealt.mapInArrow(work, "shard int, n long, dim int, ef int, ids binary, vectors binary, levels binary, links binary")


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, Graph]:
    ids = np.frombuffer(row["ids"], "<i8")
    x = np.frombuffer(row["vectors"], "<f8").reshape(len(ids), row["dim"])
    levels = np.frombuffer(row["levels"], "<i1").astype(np.int64)
    links, at = [], 0
    flat = np.frombuffer(row["links"], "<i4")
    for lv in range(int(levels.max(initial=0)) + 1):
        n, m = int((levels >= lv).sum()), LINKS if lv else GROUND_LINKS
        links.append(flat[at : at + n * m].reshape(n, m))
        at += n * m
    return ids, x, Graph(x, levels, links)


def search_index(index: DataFrame, plan: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: the k best nodes of every shard for every query (id, v) of its length."""
    n_shards = max(1, index.count())
    graph = F.struct("ids", "vectors", "levels", "links", "dim", "ef").alias("graph")
    first = index.select("shard", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("array<double>").alias("v"), graph)
    asks = queries.withColumn("dim", F.size("v")).join(F.broadcast(plan), "dim")
    asks = asks.select(
        F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n_shards") - 1).cast("array<int>")).alias("shard"), F.lit(1).alias("kind"), "id", "v",
        F.lit(None).cast(first.schema["graph"].dataType).alias("graph"),
    )
    stream = first.unionByName(asks).repartition(n_shards, "shard").sortWithinPartitions("shard", "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = row = None
        for batch in batches:
            kind, shard = batch.column("kind").to_numpy(), batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(kind) != 0) | (np.diff(shard) != 0)) + 1).tolist(), len(kind)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if kind[lo] == 0:
                    row = batch.column("graph")[lo].as_py()
                    ids, x, graph = _open(row)
                    continue
                part = batch.slice(lo, hi - lo)
                asked = part.column("id").to_numpy()
                q = part.column("v").flatten().to_numpy().reshape(len(asked), -1)
                found = graph.search(q, max(row["ef"], k))
                for at in range(0, len(q), 512):
                    f = found[at : at + 512]
                    score = (x[np.maximum(f, 0)] * q[at : at + 512, None, :]).sum(axis=2)
                    score[f < 0] = -np.inf
                    # best first, ties to the smaller id
                    order = np.lexsort((ids[np.maximum(f, 0)], -score), axis=1)[:, :k]
                    f, score = np.take_along_axis(f, order, axis=1), np.take_along_axis(score, order, axis=1)
                    r, c = np.nonzero(f >= 0)
                    yield pa.RecordBatch.from_arrays([pa.array(asked[at + r]), pa.array(ids[f[r, c]]), pa.array(score[r, c])], ["query_id", "id", "score"])

    return stream.mapInArrow(work, "query_id long, id long, score double")


def nearest(vectors: DataFrame, id_column: str, vector_column: str, every: int, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by ``every``.

    Candidates are all rows but the query's own id whose vectors are as long as
    the query's.  Vectors that are null, zero or hold null or non-finite
    components take no part; nor do rows without an id.  Repeated rows count once.
    With fewer than k candidates all that are found come back.
    """
    rows = usable(vectors, id_column, vector_column)
    node_rows = written(nodes(rows, k), "nodes")
    plan = written(shard_plan(node_rows), "plan")
    index = written(build_index(node_rows, plan, k), "index")
    queries = rows.filter(F.col("id") % every == 0)
    found = search_index(index, plan, queries, k + 1)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    found = found.withColumn("r", F.row_number().over(best)).filter(F.col("r") <= k + 1)
    each = found.join(node_rows.select("id", "ids"), "id").select("query_id", "score", F.explode("ids").alias("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    each = each.filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return each.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
