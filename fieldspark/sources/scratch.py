"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import posixpath
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in ``spark.checkpoint.dir``.

    Only where that is unset and Spark is known to run in one process a local
    temporary folder takes its place, until the process ends.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="fieldspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", root)
    return posixpath.join(root, f"{name}-{uuid.uuid4().hex}")


#: Spark's own setting: what a query shuffled is removed when the query ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of Spark for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """The rows as a Parquet table there: cuts lineage, survives lost executors.

    What was shuffled for it goes at once, so a chain of tables holds the disk
    of its largest step, not of all steps.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    with setting(spark, CLEANUP, "true"):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
