"""Token counts of a unigram tokenizer without building its tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import slices
from fieldspark.llm.tokens import counter


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and score (of the best path) of every whole text.

    Counts are those of the tokenizer itself, ties and byte fallback included.
    Null and empty texts have 0 tokens and score 0.  Rows stay as they are,
    repeated ones too; other columns are ignored.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = counter(path)
        for batch in slices(batches, "text"):
            found = model.count([t or "" for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([c for c, _ in found], pa.int64()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "n_tokens", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        work, "doc_id long, n_tokens long, score double"
    )
