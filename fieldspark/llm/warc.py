"""WARC archives: writing, and reading by a verified chain of records.

Writing: Spark's text writer puts one record on each row, with the two blank
lines between WARC records as its line separator; its commit protocol makes
retried tasks safe.

Reading: tasks take byte ranges of the files and report every place that looks
like a record (the version line) together with the place where its successor
would start.  Records inside payloads look the same, so only those count that
the chain from the start of the file reaches.  A task joins its own range's
chains already; pointer jumping over the ranges' exits then finds where the
true chain enters each range, in as many rounds as the binary logarithm of
the ranges in the largest file.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm.common import work_dir, written
from fieldspark.llm.wavelet import open_fs

MAGIC = b"WARC/1.1\r\n"
SEPARATOR = "\r\n\r\n"
#: Payloads of fewer bytes are never replaced by a reference.
REVISIT_BYTES = 100
#: Bytes of a file that one row of a reading task stands for.
RANGE_BYTES = 4 << 20
#: So many bytes behind a range are read with it; a header block that is longer takes further reads.
HEADER_BYTES = 1 << 16
RECORDS_PER_FILE = 20_000
#: Bytes of records that one task reads, about.
TASK_BYTES = 128 << 20


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, payload (string), digest and refers_to of every page.

    refers_to: the smallest page_id with an equal payload of REVISIT_BYTES or
    more, null for that page itself and for short or lone payloads.  A null
    html is an empty payload; a null page_id refers to others, but is never
    referred to unless all its copies are null (then they are responses).
    """
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html"), F.lit("")).alias("payload"),
    )
    base = base.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    long = base.filter(F.octet_length("payload") >= REVISIT_BYTES)
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    # only payloads that occur twice or more are joined; small tables are sent to all tasks
    first = written(first, "copies")
    if first.count() <= 200_000:
        first = F.broadcast(first)
    refers = F.when(
        (F.octet_length("payload") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")
    )
    return base.join(first, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _header(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def records(pages: DataFrame) -> Column:
    """A WARC record without its closing blank lines, from ``with_originals`` columns."""
    revisit = F.col("refers_to").isNotNull()
    size = F.octet_length("payload").cast("string")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    uri = F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return F.concat(
        F.lit(MAGIC.decode()),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", urn(F.col("page_id"))),
        _header("WARC-Target-URI", uri),
        _header("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _header("WARC-Refers-To", urn(F.col("refers_to"))),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Writes one record per page under ``path``; a file has RECORDS_PER_FILE records at most."""
    rows = with_originals(pages)
    rows.select(records(rows).alias("value")).write.option("lineSep", SEPARATOR).option(
        "maxRecordsPerFile", RECORDS_PER_FILE
    ).text(path)


_LENGTH = re.compile(rb"\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", re.I)


def _ranges(spark, path: str, size: int) -> DataFrame:
    """file, n_bytes, range, lo, hi of every byte range under ``path``."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("n_bytes"))
    files = files.filter("n_bytes > 0")
    return files.select(
        "file", "n_bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_bytes") - 1) / size))).alias("range")
    ).select("*", (F.col("range") * size).alias("lo"), F.least("n_bytes", (F.col("range") + 1) * size).alias("hi"))


def candidates(spark, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """Every place that looks like a record, with the place of its successor.

    file, n_bytes, range, at, block_at, block_bytes, next, leave (where the
    chain from here leaves the range), pre and post: the chains of a range
    form trees towards their exits, and a record's chain passes ``c`` if c's
    numbers enclose its own: pre(c) <= pre < post(c).
    """
    schema = pa.schema(
        [("file", pa.string()), ("n_bytes", pa.int64()), ("range", pa.int64())]
        + [(c, pa.int64()) for c in ("at", "block_at", "block_bytes", "next", "leave", "pre", "post")]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = None
        for batch in batches:
            for row in batch.to_pylist():
                fs = fs or open_fs(row["file"])[0]
                found = []
                with fs.open_input_file(open_fs(row["file"])[1]) as f:
                    f.seek(row["lo"])
                    data = f.read(min(row["hi"] + HEADER_BYTES, row["n_bytes"]) - row["lo"])
                    end, length = -1, None
                    for m in re.finditer(re.escape(MAGIC), data):
                        if row["lo"] + m.start() >= row["hi"]:
                            break
                        start = m.end() - 2
                        if end < start:
                            end = data.find(b"\r\n\r\n", start)
                            while end < 0 and (more := f.read(len(data))):  # a long header: on to the end of the file
                                seen = max(start, len(data) - 3)
                                data += more
                                end = data.find(b"\r\n\r\n", seen)
                            if end < 0:
                                break
                            length = _LENGTH.search(data, start, end + 2)
                        elif length and length.start() < start:  # the same blank line ends this header, too
                            length = _LENGTH.search(data, start, end + 2)
                        if not length:
                            continue
                        at, block_at, n = row["lo"] + m.start(), row["lo"] + end + 4, int(length[1])
                        if block_at + n + 4 <= row["n_bytes"]:
                            found.append((at, block_at, n, block_at + n + 4))
                if found:
                    yield pa.RecordBatch.from_pydict(
                        {"file": [row["file"]] * len(found), "n_bytes": [row["n_bytes"]] * len(found), "range": [row["range"]] * len(found)}
                        | dict(zip(schema.names[3:], _number(found, row["hi"]))), schema
                    )

    return _ranges(spark, path, size).repartition("file", "range").mapInArrow(
        work,
        "file string, n_bytes long, range long, at long, block_at long, block_bytes long, next long, leave long, pre long, post long",
    )


def _number(found: list[tuple[int, int, int, int]], hi: int) -> list[list[int]]:
    """Adds exits and tree numbers; successors lie behind, so one pass from the end does."""
    place = {f[0]: i for i, f in enumerate(found)}
    n = len(found)
    parent = [place.get(f[3], -1) if f[3] < hi else -1 for f in found]
    leave, size = [0] * n, [1] * n
    for i in range(n - 1, -1, -1):
        # a successor inside the range that is no record ends the chain there
        leave[i] = leave[parent[i]] if parent[i] >= 0 else (found[i][3] if found[i][3] >= hi else -1)
    for i in range(n):
        if parent[i] >= 0:
            size[parent[i]] += size[i]
    pre, after = [0] * n, [0] * n
    used = 0
    for i in range(n - 1, -1, -1):  # parents before children
        if parent[i] < 0:
            pre[i] = used
            used += size[i]
        else:
            pre[i] = after[parent[i]]
            after[parent[i]] += size[i]
        after[i] = pre[i] + 1
    return [list(x) for x in zip(*found)] + [leave, pre, [a + b for a, b in zip(pre, size)]]


def verified(spark, path: str, size: int = RANGE_BYTES) -> DataFrame:
    """The candidates that the chain from the start of their file reaches, a written table.

    A chain that breaks off (a damaged or cut record) keeps what it reached;
    ``broken`` tells of it.
    """
    found = written(candidates(spark, path, size), "candidates")
    most = found.agg(F.max("range")).first()[0] or 0
    jumps = found.select("file", "at", F.col("leave").alias("to"))
    reached = found.filter("at = 0").select("file", "at")
    for _ in range(math.ceil(math.log2(most + 1)) if most else 0):
        step = reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at"))
        reached = written(reached.union(step).distinct(), "reached")
        over = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jumps = written(jumps.join(over, ["file", "to"]).select("file", "at", F.col("then").alias("to")), "jumps")
    # a place behind the last record, or none at all, joins with nothing
    enter = found.join(reached, ["file", "at"]).select("file", "range", F.col("pre").alias("entered"))
    chain = found.join(enter, ["file", "range"])
    return written(chain.filter("pre <= entered AND entered < post").drop("entered", "pre", "post", "leave"), "chain")


def broken(spark, path: str, chain: DataFrame) -> DataFrame:
    """file, n_bytes, reached of the files whose chain ends before they do."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("n_bytes")).filter("n_bytes > 0")
    ends = chain.groupBy("file").agg(F.max("next").alias("reached"))
    return files.join(ends, "file", "left").filter("reached IS NULL OR reached <> n_bytes")


def read_archives(spark, path: str, size: int = RANGE_BYTES, strict: bool = True) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest and
    digest_ok of every verified record; a response's digest is taken from the
    payload that was read, a revisit's from its header.

    A file that its chain does not pass to the end is an error, unless not
    ``strict``: then what was reached comes back.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, fs, f = None, None, None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for row in batch.to_pylist():
                if row["file"] != name:
                    name = row["file"]
                    if f:
                        f.close()
                    fs, local = open_fs(name)
                    f = fs.open_input_file(local)
                f.seek(row["at"])
                data = f.read(row["block_at"] + row["block_bytes"] - row["at"])
                head = {}
                for line in data[len(MAGIC) : row["block_at"] - row["at"]].split(b"\r\n"):
                    k, colon, v = line.partition(b":")
                    if colon:
                        head[k.strip().lower()] = v.strip()
                http, _, payload = data[row["block_at"] - row["at"] :].partition(b"\r\n\r\n")
                kind = head.get(b"warc-type", b"").decode()
                said = head.get(b"warc-payload-digest", b"").rpartition(b":")[2].decode()
                if kind == "revisit":
                    n, digest = int(_LENGTH.search(http + b"\r\n")[1]), said
                else:
                    n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                ids = [int(m[1]) if (m := re.search(rb"urn:page:(-?\d+)>", head.get(h, b""))) else None for h in (b"warc-record-id", b"warc-refers-to")]
                for o, x in zip(out, (ids[0], kind, ids[1], n, digest, digest == said)):
                    o.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))],
                ["page_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "digest_ok"],
            )
        if f:
            f.close()

    chain = verified(spark, path, size)
    if strict and (lost := broken(spark, path, chain)).limit(1).count():
        raise ValueError(f"{lost.count()} files with broken chains, such as {lost.first()}")
    # a number of its own: the rows are narrow, but each stands for a record that is read
    held = chain.agg(F.sum("block_bytes")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held // TASK_BYTES))
    where = chain.repartition(tasks, "file", "range").sortWithinPartitions("file", "at")
    return where.mapInArrow(
        work,
        "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, digest_ok boolean",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages to archives in a new shared folder and reads them back."""
    path = work_dir(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)


#: The same rows as ``round_trip(pages)`` without digest_ok.
SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
    sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""
