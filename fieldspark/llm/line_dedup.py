"""Lines that many documents share are kept in one document only.

Lines are exploded with their positions and normalised to a key, keys are
hashed (128 bits), and the distinct documents of each hash are counted.  Keys
over the threshold lose their lines everywhere but in the document with the
largest id; what stays is put together again by position.

A null or empty text is one empty line.  A row whose ``doc_id`` is null counts
as no document and is never the one that keeps a line.  Repeated rows are one
document for the count and each give a row of the result.  Other columns of
the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import BROADCAST_IDS, written

MIN_CHARS, MIN_DOCS = 40, 5
#: A key that holds at least this share of all (line, document) pairs of dropped keys is hot: there can be
#: no more hot keys than HOT, so they may be broadcast.
HOT = 100_000

BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case and nothing else changed."""
    key = F.btrim(line, F.lit(BLANK))
    # without letters beyond ASCII the fast function does the same
    return F.when(F.octet_length(key) == F.char_length(key), F.lower(key)).otherwise(F.translate(key, UPPER, LOWER))


def _lines() -> Column:
    return F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, t1 and t2 (hash of the text), at (position), h1 and h2 (hash of the key) of every line
    whose key is long enough."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), F.posexplode(_lines()).alias("at", "line"))
    rows = rows.where(F.char_length(F.btrim("line", F.lit(BLANK))) >= min_chars).withColumn("key", line_key(F.col("line")))
    return rows.select("doc_id", "t1", "t2", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """h1, h2, n_docs and last (largest doc_id) of every key found in so many documents."""
    keys = hashed_lines(docs, min_chars).groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last"))
    return keys.where(F.col("n_docs") >= min_docs)


def _dropped(lines: DataFrame, shared: DataFrame) -> DataFrame:
    """Those lines whose key is shared and whose document isn't the last that holds it."""
    late = ~F.col("doc_id").eqNullSafe(F.col("last"))
    on = ["h1", "h2"]
    if shared.count() * len(shared.columns) <= 2 * BROADCAST_IDS:
        return lines.join(F.broadcast(shared), on).where(late)
    total = shared.agg(F.sum("n_docs")).first()[0]
    hot = F.broadcast(shared.where(F.col("n_docs") * HOT >= total))
    cold = shared.where(F.col("n_docs") * HOT < total)
    return lines.join(hot, on).where(late).unionByName(lines.join(hot, on, "left_anti").join(cold, on).where(late))


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, text (what stays) of every row."""
    shared = written(shared_lines(docs, min_chars, min_docs), "shared-lines")
    gone = _dropped(hashed_lines(docs, min_chars), shared)
    gone = gone.groupBy("doc_id", "t1", "t2").agg(F.collect_set("at").alias("gone")).withColumnRenamed("doc_id", "gone_id")
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    rows = rows.join(gone, (rows.doc_id.eqNullSafe(gone.gone_id)) & (rows.t1 == gone.t1) & (rows.t2 == gone.t2), "left")
    rows = rows.select("doc_id", _lines().alias("lines"), F.coalesce("gone", F.array().cast("array<int>")).alias("gone"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    return rows.select(
        "doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_dropped"),
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n").alias("text"),
    )


def digests(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
e AS (SELECT rid, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM e),
s AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
f AS (SELECT k.*, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.last AS gone FROM k LEFT JOIN s ON k.key = s.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM f GROUP BY rid, doc_id
"""
