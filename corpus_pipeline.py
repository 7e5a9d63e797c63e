"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; between stages
the rows are written as Parquet and read again.  All stages but the last
return the columns of ``documents``.  Stages judge rows, not ids: null and
repeated doc_ids are fine, an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldspark.llm import jaccard_join, language_id, packing, quality_rules
from fieldspark.llm.common import SLICE_BYTES, keep_ids, table, written
from fieldspark.llm.tokens import public_path
from fieldspark.sources.scratch import setting

END_ID = 2

#: Spark's own setting, and the most that goes to a worker at once: a slice of texts, with the one that passes the limit.
BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", SLICE_BYTES - (128 << 10)


def _in_slices(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage with texts sent to its workers a slice at a time: 10,000 rows, which Spark would send, are held several times
    over, by an executor and by the workers it keeps from stage to stage."""

    @wraps(stage)
    def sent(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with setting(spark, BATCH, str(BATCH_BYTES)):
            return stage(spark, docs, sf_dir)

    return sent


def _row_key(docs: DataFrame) -> Column:
    """A number that stands for the whole row: rows without a doc_id have one,
    and rows of one doc_id are told apart by what they hold."""
    return F.xxhash64(*docs.columns, *[F.col(c).isNull() for c in docs.columns])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc_id", _row_key(docs))


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose key is not in ``rejected`` (doc_id); columns stay as they are."""
    keys = written(rejected.select(F.col("doc_id").alias("row_key_")).distinct(), "rejected")
    return keep_ids(docs.withColumn("row_key_", _row_key(docs)), keys, "row_key_", "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected rows go; of an id with several rows only those that are rejected."""
    return _without(docs, quality_rules.quality_rules(_keyed(docs)).filter(~F.col("kept")))


@_in_slices
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a language that the evidence agrees on go."""
    return _without(docs, language_id.identify_documents(_keyed(docs)).filter(~F.col("kept")))


@_in_slices
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked rows one with the smallest doc_id stays (none: last).

    Rows of one doc_id are rows of their own here, and a repeated row stays
    once.  Rows without words link with nothing and stay.
    """
    found = jaccard_join.jaccard_components(_keyed(docs), count_links=False).select("doc_id", "component_id", "n_shingles")
    ids = docs.select(F.col("doc_id").alias("own"), _row_key(docs).alias("doc_id"))
    rows = written(ids.groupBy("doc_id").agg(F.first("own").alias("own"), F.count("*").alias("n")), "rows")
    groups = rows.join(found.filter("n_shingles > 0").distinct(), "doc_id")
    stays = groups.groupBy("component_id").agg(F.min_by("doc_id", F.struct(F.col("own").isNull(), "own", "doc_id")).alias("stays"))
    rejected = written(groups.join(stays, "component_id").filter("doc_id <> stays"), "apart")
    kept = _without(docs, rejected)
    again = written(rows.filter("n > 1").join(rejected, "doc_id", "left_anti").select(F.col("doc_id").alias("row_key_")), "again")
    if not again.limit(1).count():
        return kept
    keyed = kept.withColumn("row_key_", _row_key(kept))
    once = keep_ids(keyed, again, "row_key_", "left_semi").dropDuplicates(["row_key_"])
    return keep_ids(keyed, again, "row_key_", "left_anti").unionByName(once).select(docs.columns)


@_in_slices
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents and their places in sequences of 1024 tokens."""
    return packing.pack_documents(docs, public_path("byte_bpe_50k.json"), END_ID)


STAGES = [("quality rules", quality), ("language ID", language), ("n-gram Jaccard join", near_duplicates), ("best-fit packing", pack)]

#: Shingle components, the text model and packing have no plain SQL form;
#: tests/llm holds the stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
