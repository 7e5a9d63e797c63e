"""Composites and pending work that grow with arriving files.

Memory is by patch: one state row per patch, with a bit for each of its cells
that has been counted, so cells that come late are told from cells that come
again.  The composite lies in partitions with two slots each: a batch writes
the partitions that it touches, each into the slot that doesn't hold its newest
version, so a batch that runs again after a failure starts from the same
version and writes the same one, and no third version is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fieldspark.operators.composite import build_composites, merge_composites
from fieldspark.operators.patches import pending
from fieldspark.sources.scratch import written


def _fresh_cells(cell: dict[str, tuple[int, int]]) -> Callable:
    """The cells of a patch that its state has no bit for; repeats within an arrival count once."""
    size = int(np.prod([n for _, n in cell.values()]))

    def work(_, arrivals: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        seen = np.unpackbits(np.frombuffer(state.get[0], np.uint8), count=size).astype(bool) if state.exists else np.zeros(size, bool)
        for rows in arrivals:
            place = reduce(lambda at, c: at * cell[c][1] + (rows[c].to_numpy() - cell[c][0]), cell, np.zeros(len(rows), np.int64))
            if len(place) and (place.min() < 0 or place.max() >= size):
                raise ValueError(f"a cell lies outside {cell}")
            first = np.zeros(len(rows), bool)
            first[np.unique(place, return_index=True)[1]] = True
            fresh = first & ~seen[place]
            seen[place] = True
            yield rows[fresh]
        state.update((np.packbits(seen).tobytes(),))

    return work


def _timed(work: Callable, late_ms: int) -> Callable:
    """Forgets a patch ``late_ms`` after the watermark has reached its last arrival."""

    def with_timeout(key, arrivals, state):
        yield from work(key, arrivals, state)
        if state.exists:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + late_ms + 1)

    return with_timeout


def _versions(spark: SparkSession, root: str) -> DataFrame | None:
    try:
        return spark.read.parquet(root)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _newest(states: DataFrame, by: list[str], below: int | None = None) -> DataFrame:
    """The newest version of every partition (before version ``below``)."""
    some = states if below is None else states.filter(F.col("version") < below)
    best = some.groupBy(*by).agg(F.max_by("slot", "version").alias("slot"))  # one row a partition
    return some.join(F.broadcast(best), [*by, "slot"])


def add_to_composite(root: str, part: DataFrame, keys: list[str], by: list[str], number: int) -> None:
    """Merges sums and counts into the partitions (``by``, some of ``keys``) that they touch, as version ``number``."""
    part = written(part, "arrived")
    touched = part.select(*by).distinct()
    states = _versions(part.sparkSession, root)
    if states is None:
        out = part.withColumn("slot", F.lit(0))
    else:
        old = _newest(states.join(F.broadcast(touched), by, "left_semi"), by, number)
        slots = touched.join(old.select(*by, "slot").distinct(), by, "left").select(*by, F.expr("1 - coalesce(slot, 1)").alias("slot"))
        old = old.select(*[F.col(c).cast(t).alias(c) for c, t in part.dtypes])
        out = merge_composites(old, part).join(F.broadcast(slots), by)
    out.withColumn("version", F.lit(number).cast("long")).repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", *by).parquet(root)


def stream_composites(
    spark: SparkSession, source: str, schema, state_root: str, fields: list[str], keys: list[str], by: list[str], patch: list[str], cell: dict[str, tuple[int, int]],
    checkpoint: str, ts: str | None = None, late_hours: int = 240,
):
    """Adds new patches to the composite under ``state_root``; returns the finished query.

    ``patch``: the columns that tell a patch; ``cell``: (first, count) of each
    column that tells its cells.  Cells that were counted already are ignored.
    With an event time ``ts`` a patch is remembered for ``late_hours`` behind
    the newest one, so the memory stays bounded; without, for good.
    """
    arriving = spark.readStream.schema(schema).parquet(source)
    work, timeout = _fresh_cells(cell), GroupStateTimeout.NoTimeout
    if ts:
        arriving, work, timeout = arriving.withWatermark(ts, f"{late_hours} hours"), _timed(work, late_hours * 3_600_000), GroupStateTimeout.EventTimeTimeout
    fresh = arriving.groupBy(*patch).applyInPandasWithState(work, schema, "seen binary", "append", timeout)

    def add(batch: DataFrame, number: int) -> None:
        add_to_composite(state_root, build_composites(batch, fields, keys), keys, by, number)

    q = fresh.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def current_composite(spark: SparkSession, state_root: str, by: list[str]) -> DataFrame:
    """The newest version of every partition."""
    return _newest(spark.read.parquet(state_root), by).drop("slot", "version")


def stream_pending(spark: SparkSession, source: str, schema, done: Callable[[], DataFrame], keys: list[str], work: Callable[[DataFrame], None], checkpoint: str):
    """Hands each arriving catalogue's work that has no result yet to ``work``."""
    arriving = spark.readStream.schema(schema).option("header", True).csv(source)

    def each(batch: DataFrame, number: int) -> None:
        work(pending(batch, done(), keys))

    q = arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
