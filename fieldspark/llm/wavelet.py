"""Token ids on disk as one wavelet matrix per shard.

File layout (little-endian)::

    8 bytes   b"WVLTMX01"
    u32 x 4   bits per id, documents, rank block (in 8-byte words), reserved
    u64       tokens
    i64 x D   document ids
    u64 x D+1 where each document starts in the shard, and the end
    then for each bit plane, highest bit first:
    u64       zeros in the plane
    u64 x W   the plane, W = ceil(tokens / 64) words, bit i of word i // 64
    u64 x B+1 ones before each rank block

A plane holds one bit of every id; the next plane is ordered by it (zeros
first, stable).  Planes of b bits take b/32 of the plain form; access, rank
and select each read one word and one directory entry per plane.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm.common import slices, work_dir, written
from fieldspark.llm.tokens import word_encoder

MAGIC = b"WVLTMX01"
BLOCK = 8
#: Ids in a shard file, beyond which the next file starts.
SHARD_TOKENS = 1 << 21
#: Bytes of text whose distinct words are encoded at once.
ENCODE_BYTES = 16 << 20


def build(ids: np.ndarray, bits: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(zeros, words, directory) of every bit plane."""
    out = []
    kind = np.uint16 if bits <= 16 else np.uint32
    a = ids.astype(kind)
    n_words = (len(a) + 63) // 64
    for level in range(bits - 1, -1, -1):
        bit = (a & kind(1 << level)) != 0
        raw = np.zeros(n_words * 8, np.uint8)
        packed = np.packbits(bit, bitorder="little")
        raw[: len(packed)] = packed
        words = raw.view("<u8")
        ones = np.bitwise_count(words).astype(np.uint64)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(ones, dtype=np.uint64)])
        directory = np.append(sums[:-1:BLOCK], sums[-1]).astype("<u8")
        out.append((int(len(a) - sums[-1]), words, directory))
        a = np.concatenate([a[~bit], a[bit]])
    return out


def dump(doc_ids: np.ndarray, starts: np.ndarray, ids: np.ndarray, bits: int) -> bytes:
    parts = [MAGIC, struct.pack("<IIIIQ", bits, len(doc_ids), BLOCK, 0, len(ids))]
    parts += [doc_ids.astype("<i8").tobytes(), starts.astype("<u8").tobytes()]
    for zeros, words, directory in build(ids, bits):
        parts += [struct.pack("<Q", zeros), words.tobytes(), directory.tobytes()]
    return b"".join(parts)


class Shard:
    """Reads a shard file's bytes: whole, or one id, count or place at a time."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a wavelet shard")
        self.bits, n_docs, self.block, _, self.n = struct.unpack_from("<IIIIQ", data, 8)
        at = 32
        self.doc_ids = np.frombuffer(data, "<i8", n_docs, at)
        at += 8 * n_docs
        self.starts = np.frombuffer(data, "<u8", n_docs + 1, at).astype(np.int64)
        at += 8 * (n_docs + 1)
        n_words = (self.n + 63) // 64
        n_blocks = (n_words + self.block - 1) // self.block + 1
        self.planes = []
        for _ in range(self.bits):
            (zeros,) = struct.unpack_from("<Q", data, at)
            words = np.frombuffer(data, "<u8", n_words, at + 8)
            directory = np.frombuffer(data, "<u8", n_blocks, at + 8 + 8 * n_words)
            at += 8 + 8 * n_words + 8 * n_blocks
            self.planes.append((zeros, words, directory))

    def _ones(self, plane: int, i: int) -> int:
        """Ones among the first ``i`` bits of a plane."""
        _, words, directory = self.planes[plane]
        word = i >> 6
        block = word // self.block
        ones = int(directory[block])
        ones += int(np.bitwise_count(words[block * self.block : word]).sum())
        if i & 63:
            ones += (int(words[word]) & ((1 << (i & 63)) - 1)).bit_count()
        return ones

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        value = 0
        for p, (zeros, words, _) in enumerate(self.planes):
            bit = (int(words[i >> 6]) >> (i & 63)) & 1
            ones = self._ones(p, i)
            i = zeros + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, value: int, lo: int, hi: int) -> tuple[int, int]:
        for p, (zeros, _, _) in enumerate(self.planes):
            a, b = self._ones(p, lo), self._ones(p, hi)
            lo, hi = (zeros + a, zeros + b) if value >> (self.bits - 1 - p) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, value: int, lo: int, hi: int) -> int:
        """How often ``value`` occurs in places lo <= i < hi."""
        if value >> self.bits:
            return 0
        a, b = self._range(value, lo, hi)
        return b - a

    def _find(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) bit of this kind in a plane."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._ones(plane, mid + 1)
            if (ones if bit else mid + 1 - ones) <= k:
                lo = mid + 1
            else:
                hi = mid
        return lo

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of ``value``; -1 if there is none."""
        if not 0 <= k < self.rank(value, 0, self.n):
            return -1
        i = self._range(value, 0, 0)[0] + k
        for p in range(self.bits - 1, -1, -1):
            bit = value >> (self.bits - 1 - p) & 1
            i = self._find(p, bit, i - self.planes[p][0] if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids: planes are undone from the lowest bit up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        a = np.zeros(self.n, kind)
        for level, (zeros, words, _) in enumerate(reversed(self.planes)):
            bit = np.unpackbits(words.view(np.uint8), count=self.n, bitorder="little").astype(bool)
            up = np.empty(self.n, kind)
            up[~bit] = a[:zeros]
            up[bit] = a[zeros:] | kind(1 << level)
            a = up
        return a.astype(np.uint32)


def open_fs(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, path: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Encodes ``docs`` in ascending doc_id order and writes shard files.

    Returns the manifest, a written table: part, shard (their order is that of
    doc_id), file, n_docs, n_tokens, start (ids in all shards before).  A task
    that is run again writes files of new names; the manifest names those of
    the run that counted.  Null and empty texts hold only ``end_id``; rows of
    one doc_id are ordered by a hash of the text, then by the text; a null doc_id
    comes first and is written as the least long.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        model = word_encoder(tokenizer)
        bits = max(model.tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id).bit_length()
        fs, root = open_fs(path)
        end = np.array([end_id], np.uint32)
        held_ids, held, total, shard = [], [], 0, 0

        def flush():
            nonlocal held_ids, held, total, shard
            starts = np.concatenate([[0], np.cumsum([len(b) for b in held])])
            name = posixpath.join(root, f"part-{part:06d}-{shard:06d}-{uuid.uuid4().hex}.wm")
            with fs.open_output_stream(name) as f:
                f.write(dump(np.array(held_ids, np.int64), starts, np.concatenate(held), bits))
            row = {"part": part, "shard": shard, "file": name, "n_docs": len(held), "n_tokens": int(starts[-1])}
            held_ids, held, total, shard = [], [], 0, shard + 1
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema(
            [("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
        )
        for batch in slices(batches, "text", ENCODE_BYTES):
            flat, count = model.encode(batch.column("text"))
            for i, ids in zip(batch.column("doc_id").to_pylist(), np.split(flat, np.cumsum(count)[:-1])):
                held_ids.append(-(1 << 63) if i is None else i)
                held.append(np.concatenate([ids, end]))
                total += len(held[-1])
                if total >= shard_tokens:
                    yield flush()
        if held:
            yield flush()

    fs, root = open_fs(path)
    fs.create_dir(root, recursive=True)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    # ranges are drawn from a sample of two numbers a row; no text goes to the driver
    ordered = ordered.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    manifest = written(
        ordered.mapInArrow(work, "part int, shard int, file string, n_docs long, n_tokens long"), "manifest"
    )
    # running total by part first, so that no task sees more than one part's shards or one row per part
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(parts, "part").select(
        *manifest.columns, (F.col("part_start") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start")
    )


def read_shards(manifest: DataFrame, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_fs(path)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_stream(name) as f:
                    shard = Shard(f.read())
                raw = memoryview(shard.ids().astype("<u4").tobytes())
                at = shard.starts
                ids = [None if i == -(1 << 63) else i for i in shard.doc_ids.tolist()]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(start + at[:-1]), pa.array(np.diff(at)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    # a number of its own, so that these small rows are not put together in one task
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("file", "start").repartition(tasks, "file")
    return files.mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes all documents as shards in a new shared folder and reads them back."""
    path = work_dir(docs.sparkSession, "tokens")
    return read_shards(write_shards(docs, tokenizer, end_id, path), path)
