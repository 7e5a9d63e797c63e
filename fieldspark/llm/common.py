"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.sources.scratch import scratch as work_dir
from fieldspark.sources.scratch import written

__all__ = ["BROADCAST_IDS", "SLICE_BYTES", "keep_ids", "slices", "small", "table", "work_dir", "written"]

#: Largest number of ids that is sent to all executors (about 50 MB there).
BROADCAST_IDS = 1_000_000

#: Bytes of text that a task works on at once.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_ids(df: DataFrame, ids: DataFrame, column: str, how: str) -> DataFrame:
    """``left_semi`` or ``left_anti`` join on one id column.

    ``ids`` is a written table: its count is cheap and decides between a
    broadcast (at most BROADCAST_IDS rows) and a shuffle join.
    """
    return df.join(small(ids), column, how)


def small(rows: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be sent to all executors if it
    has at most BROADCAST_IDS rows (fewer, if they are wider than two numbers),
    else to be shuffled."""
    return F.broadcast(rows) if rows.count() * max(2, len(rows.columns)) <= 2 * BROADCAST_IDS else rows


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that ``column`` has about ``limit`` bytes in each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        yield batch.slice(start)
