"""Best-fit packing of tokenized documents under several capacities.

A piece asks for tokens, one document place and length squared of attention
cost; a sequence has a capacity for each.  Pieces of one length ask for the
same, so the plan is made over the histogram of lengths (at most 1024 rows,
whatever the corpus) with equal bins kept as one entry and a count: longest
pieces first, each goes to the open bin of the best score among those that
hold it in every capacity, else to a new bin.  Spark counts, numbers and
places the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import slices, small, written
from fieldspark.llm.tokens import byte_bpe

SEQUENCE = 1024
#: Capacities of a sequence: tokens, documents, attention cost.  The query's contract
#: limits tokens only and wants few sequences; the other two take part in the choice
#: of bins through WEIGHTS and bind as soon as a caller lowers them.
CAPACITIES = (SEQUENCE, SEQUENCE, SEQUENCE * SEQUENCE)
WEIGHTS = (1.0, 0.05, 0.05)
#: Pieces in a bucket that are numbered together, about; and buckets at least.
BUCKET_ROWS, LEAST_BUCKETS = 200_000, 64


def pieces(docs: DataFrame, tokenizer: str, end_id: int, size: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces.

    A document's ids end with ``end_id``; null and empty texts have only that.
    More than ``size`` ids are cut so that all pieces but the first are full.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = byte_bpe(tokenizer)
        for batch in slices(batches, "text"):
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), end_id], "<u4")
                cuts = [0, *range((len(ids) - 1) % size + 1, len(ids) + 1, size)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for out, x in zip(rows, (doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))):
                        out.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def plan(counts: dict[int, int], capacities=CAPACITIES, weights=WEIGHTS, rule: str = "norm") -> list[tuple[tuple[int, ...], int]]:
    """[(lengths in a bin, number of such bins)] for ``counts`` of each length.

    ``rule``: "dot" takes the bin whose residual has the largest weighted dot
    product with the demand, "norm" the one with the least weighted norm of
    what is left.  Capacities and demands are taken relative to capacities.
    """
    cap, weight = np.array(capacities, float), np.array(weights)
    residual = np.zeros((64, 3))
    number = np.zeros(64, np.int64)
    held: list[tuple[int, ...]] = [()] * 64
    free = list(range(63, -1, -1))

    def new(rest: np.ndarray, content: tuple[int, ...], n: int) -> int:
        nonlocal residual, number
        if not free:
            k = len(held)
            residual, number = np.vstack([residual, np.zeros((k, 3))]), np.append(number, np.zeros(k, np.int64))
            held.extend([()] * k)
            free.extend(range(2 * k - 1, k - 1, -1))
        i = free.pop()
        residual[i], number[i], held[i] = rest, n, content
        return i

    done: list[tuple[tuple[int, ...], int]] = []
    least = min(counts, default=0)
    for length in sorted(counts, reverse=True):
        demand, todo = np.array([length, 1, length * length], float), counts[length]
        if (demand > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while todo:
            fits = (number > 0) & (residual >= demand).all(axis=1)
            rel = residual / cap
            if rule == "dot":
                score = -(rel * weight * demand / cap).sum(axis=1)
            else:
                score = (weight * (rel - demand / cap) ** 2).sum(axis=1)
            score = np.where(fits, score, np.inf)
            i = int(np.argmin(score))
            if np.isinf(score[i]):
                i = new(cap.copy(), (), (todo + int((cap // demand).min()) - 1) // int((cap // demand).min()))
            # one bin of this entry takes pieces while it stays the best choice:
            # under "norm" a fuller bin is better still, so it is filled up
            k = min(int((residual[i] // demand).min()), todo) if rule == "norm" else 1
            bins = min(int(number[i]), todo // k)
            rest, content = residual[i] - k * demand, held[i] + (length,) * k
            number[i] -= bins
            if not number[i]:
                free.append(i)
            todo -= bins * k
            if rest[0] < least or rest[1] < 1:
                done.append((content, bins))
            else:
                new(rest, content, bins)
    done += [(held[i], int(number[i])) for i in np.flatnonzero(number)]
    return [d for d in done if d[0]]


def pack(found: DataFrame, capacities=CAPACITIES, weights=WEIGHTS, rule: str = "norm") -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces.

    Pieces as long as a sequence are sequences of their own, with negative
    numbers, and need no plan.  Others of one length are numbered by doc_id and
    piece within hashed buckets of about BUCKET_ROWS pieces, so a length that a
    third of all pieces have is no single task's work.  Repeated rows are
    pieces of their own; no piece is dropped.  A null doc_id is a document.
    """
    spark = found.sparkSession
    size = int(capacities[0])
    if size > 0 and found.filter(F.col("length") > size).limit(1).count():
        raise ValueError(f"a piece of over {size} tokens fits no sequence")
    alone = F.lit(capacities[1] >= 1 and capacities[2] >= size * size) & (F.col("length") == size)
    # the table is written, so its rows keep their numbers if a task runs again
    whole = found.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")).filter(alone)
    rest = found.filter(~alone)
    buckets = max(LEAST_BUCKETS, -(-rest.count() // BUCKET_ROWS))
    rows = rest.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    counts = written(rows.groupBy("length", "bucket").agg(F.count("*").alias("n")), "lengths")
    total = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``size`` rows
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = written(counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "before")
    # each entry of the plan takes a run of numbers of each length it holds
    used = dict.fromkeys(total, 0)
    runs, sequence = [], 0
    for content, bins in plan(total, capacities, weights, rule):
        offset = 0
        for length in content:
            runs.append((length, used[length], used[length] + bins, sequence, offset))
            used[length] += bins
            offset += length
        sequence += bins
    where = spark.createDataFrame(runs, "length long, lo long, hi long, base long, offset long")
    w = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = rows.withColumn("rn", F.row_number().over(w)).join(small(first), ["length", "bucket"])
    numbered = numbered.withColumn("number", F.col("before") + F.col("rn") - 1)
    n, p = numbered.alias("n"), small(where).alias("p")
    placed = n.join(p, (F.col("n.length") == F.col("p.length")) & (F.col("number") >= F.col("lo")) & (F.col("number") < F.col("hi")))
    placed = placed.select(
        *[F.col(f"n.{c}") for c in found.columns],
        (F.col("base") + F.col("number") - F.col("lo")).alias("sequence_id"),
        F.col("offset"),
    )
    return placed.unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Tokenizes and packs whole documents; one row per piece."""
    return pack(written(pieces(docs, tokenizer, end_id), "pieces"))
