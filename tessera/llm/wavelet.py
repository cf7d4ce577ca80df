"""Token ids in wavelet matrix files (SPIRE 2012), one compressed file per shard.

A file holds the ids of a run of documents in ascending key order as bit-planes, most significant bit first; each
plane is stably sorted by the bits above it. With ranks stored for every 65,536 bits, one file answers: which token
stands at a place, how often a token occurs before a place, and where its k-th occurrence is.

Layout, little-endian: 8 bytes magic, 8 bytes header length, header (JSON), then zstd blocks in header order: keys
(int64; the first null_keys of the header are null), ends of documents (int64), the planes' bits (packed, first bit highest) and the planes' ranks (int64).
"""

from __future__ import annotations

import json
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import arrow_text, token_ids
from .workspace import fields, release_memory, shared_dir, table, written

MAGIC = b"WVMATRX1"
BLOCK = 1 << 16
LEVELS = 16
END_ID = 0


class WaveletMatrix:
    """Bit-planes over ids below 2^levels with rank and select."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int], ranks: list[np.ndarray]):
        self.n, self.planes, self.zeros, self.ranks = n, planes, zeros, ranks
        self.levels = len(planes)

    @classmethod
    def build(cls, ids: np.ndarray, levels: int = LEVELS) -> WaveletMatrix:
        ids = np.ascontiguousarray(ids, np.uint16 if levels <= 16 else np.uint32)
        if len(ids) and int(ids.max()) >> levels:
            raise ValueError("an id needs more bits")
        planes, zeros, ranks = [], [], []
        for level in range(levels - 1, -1, -1):
            one = (ids & ids.dtype.type(1 << level)) != 0
            plane = np.packbits(one)
            planes.append(plane)
            ones = np.bitwise_count(plane)
            sums = np.add.reduceat(ones, np.arange(0, len(ones), BLOCK >> 3), dtype=np.int64) if len(ones) else np.empty(0, np.int64)
            ranks.append(np.concatenate([[0], np.cumsum(sums)]).astype(np.int64))
            zeros.append(len(ids) - int(ranks[-1][-1]))
            if level:  # indices and take are several times faster than masks on bits without a pattern
                ids = np.concatenate([ids.take(np.flatnonzero(~one)), ids.take(np.flatnonzero(one))])
        return cls(len(ids), planes, zeros, ranks)

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level][at >> 3] >> (7 - (at & 7))) & 1

    def _ones(self, level: int, at: int) -> int:
        """Ones before a place of a plane."""
        block = at // BLOCK
        part = self.planes[level][block * BLOCK >> 3 : (at + 7) >> 3]
        n = int(np.bitwise_count(part).sum(dtype=np.int64))
        if at & 7:
            n -= int(part[-1] & ((1 << (8 - (at & 7))) - 1)).bit_count()
        return int(self.ranks[level][block]) + n

    def _where(self, level: int, bit: int, k: int) -> int:
        """The place of the k-th (from 0) one or zero of a plane."""
        ranks = self.ranks[level]
        have = ranks if bit else np.minimum(np.arange(len(ranks)) * BLOCK, self.n) - ranks
        block = int(np.searchsorted(have, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK >> 3 : (block + 1) * BLOCK >> 3])[: self.n - block * BLOCK]
        return block * BLOCK + int(np.flatnonzero(bits == bit)[k - int(have[block])])

    def access(self, at: int) -> int:
        if not 0 <= at < self.n:
            raise IndexError(at)
        token = 0
        for level in range(self.levels):
            bit, ones = self._bit(level, at), self._ones(level, at)
            token = token << 1 | bit
            at = self.zeros[level] + ones if bit else at - ones
        return token

    def _range(self, token: int, end: int) -> tuple[int, int]:
        first, last = 0, end
        for level in range(self.levels):
            a, b = self._ones(level, first), self._ones(level, last)
            if token >> (self.levels - 1 - level) & 1:
                first, last = self.zeros[level] + a, self.zeros[level] + b
            else:
                first, last = first - a, last - b
        return first, last

    def rank(self, token: int, end: int) -> int:
        """Occurrences of a token before a place."""
        if not 0 <= end <= self.n:
            raise IndexError(end)
        if token < 0 or token >> self.levels:
            return 0
        first, last = self._range(token, end)
        return last - first

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        return self.rank(token, self.n if end is None else end) - self.rank(token, start)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence of a token, from 0."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._range(token, self.n)[0] + k
        for level in range(self.levels - 1, -1, -1):
            bit = token >> (self.levels - 1 - level) & 1
            at = self._where(level, bit, at - (self.zeros[level] if bit else 0))
        return at

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane up: each plane undoes its stable partition."""
        out = np.zeros(self.n, np.uint16 if self.levels <= 16 else np.uint32)
        for level in range(self.levels - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.n).view(np.bool_)
            above = np.empty_like(out)
            above[np.flatnonzero(~one)] = out[: self.zeros[level]]
            above[np.flatnonzero(one)] = out[self.zeros[level] :] | out.dtype.type(1 << (self.levels - 1 - level))
            out = above
        return out


def to_bytes(keys: np.ndarray, ends: np.ndarray, matrix: WaveletMatrix, null_keys: int = 0) -> bytes:
    """The file's bytes; the first ``null_keys`` documents have no key."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    raw = [keys.astype("<i8"), ends.astype("<i8"), *matrix.planes, *[r.astype("<i8") for r in matrix.ranks]]
    blocks = [pack(x) for x in raw]
    crc = 0
    for block in blocks:
        crc = zlib.crc32(block, crc)
    header = {
        "tokens": matrix.n,
        "documents": len(keys),
        "null_keys": null_keys,
        "zeros": matrix.zeros,
        "blocks": [len(b) for b in blocks],
        "crc": crc,
    }
    head = json.dumps(header).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *blocks])


def from_bytes(data: bytes) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(keys, ends, matrix); keys are a masked array where some are null."""
    import zstandard

    if data[:8] != MAGIC:
        raise ValueError("not a wavelet matrix file")
    size = int.from_bytes(data[8:16], "little")
    head, at = json.loads(data[16 : 16 + size]), 16 + size
    rest = memoryview(data)
    if zlib.crc32(rest[at:]) != head["crc"]:
        raise ValueError("damaged wavelet matrix file")
    unpack, raw = zstandard.ZstdDecompressor().decompress, []
    for length in head["blocks"]:
        raw.append(unpack(rest[at : at + length]))
        at += length
    levels = len(head["zeros"])
    planes = [np.frombuffer(x, np.uint8) for x in raw[2 : 2 + levels]]
    ranks = [np.frombuffer(x, "<i8") for x in raw[2 + levels :]]
    matrix = WaveletMatrix(head["tokens"], planes, head["zeros"], ranks)
    keys = np.frombuffer(raw[0], "<i8")
    if head["null_keys"]:
        keys = np.ma.masked_array(keys, np.arange(len(keys)) < head["null_keys"])
    return keys, np.frombuffer(raw[1], "<i8"), matrix


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Any store that pyarrow knows (file, hdfs, s3, gs); a bare path is a local one."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def publish(uri: str, data: bytes) -> None:
    """Write under a name of its own, then move: a repeated or speculative task replaces whole files only."""
    files, path = filesystem(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    with files.open_output_stream(own) as out:
        out.write(data)
    files.move(own, path)


def read_file(uri: str) -> bytes:
    files, path = filesystem(uri)
    with files.open_input_stream(path) as stream:
        return stream.readall()


#: UTF-8 bytes of text that one file takes, about, and key ranges at most; a range may fill many files.
SHARD_BYTES, RANGES = 16 << 20, 50_000
#: Bytes of text that are encoded at once.
SLICE_BYTES = 4 << 20
#: Places for the files of one range in shard numbers, and manifest rows that one task writes.
FILES_PER_RANGE, MANIFEST_ROWS = 1 << 32, 10_000
MANIFEST = "shard bigint, path string, first_key bigint, documents bigint, tokens bigint, bytes bigint"


class _Shard:
    """Documents that go into one file."""

    def __init__(self):
        self.keys, self.nulls, self.ids, self.lengths, self.bytes = [], 0, [], [], 0

    def add(self, keys: pa.Array, ids: np.ndarray, lengths: np.ndarray, size: int) -> None:
        self.nulls += keys.null_count
        self.keys.append(keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.bytes += size

    def publish(self, number: int, folder: str) -> pa.RecordBatch:
        keys, ends, ids = np.concatenate(self.keys), np.cumsum(np.concatenate(self.lengths)), np.concatenate(self.ids)
        self.ids.clear()
        data = to_bytes(keys, ends, WaveletMatrix.build(ids), self.nulls)
        name = f"{folder}/shard-{number:016x}.wvm"
        publish(name, data)
        values = [number, name, None if self.nulls else int(keys[0]), len(keys), len(ids), len(data)]
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
        return pa.RecordBatch.from_arrays(
            [pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
            names=["shard", "path", "first_key", "documents", "tokens", "bytes"],
        )


def write_token_files(
    df: DataFrame,
    folder: str,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    end_id: int = END_ID,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, and write files in ascending key order; returns the manifest.

    Keys are whole numbers, null keys come first; a null text is empty. Rows are dealt to tasks by key ranges, rows of
    one key by their texts' hashes and equal rows by their numbers, so no key's rows must meet. A task ends a file as
    soon as it has ``shard_bytes`` of text, so a file is larger only by one slice of texts or one very long text,
    however texts of different lengths lie. The manifest has one row per file: shard (its number in key order), path,
    first_key, documents, tokens, bytes. An empty table has no files.
    """
    path = vocabulary or token_ids.vocabulary("byte_bpe_50k.json")
    rows = fields(df, key=key, text=text).select(F.col("key").cast("bigint").alias("key"), "text")
    total = rows.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    ranges = min(RANGES, max(1, math.ceil(total / shard_bytes)))
    order = ["key", "hash", "row"]
    rows = rows.select("key", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    ranged = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    placed = ranged.select("key", "text", F.spark_partition_id().alias("range"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, shard, number = token_ids.encoder(path), _Shard(), None
        for batch in batches:
            if number is None and batch.num_rows:
                number = batch.column(2)[0].as_py() * FILES_PER_RANGE
            data, offsets = arrow_text.flat(batch.column(1))
            for a, b in arrow_text.slices(offsets, min(SLICE_BYTES, shard_bytes)):
                found, counts = tool.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                ids, _ = token_ids.with_end(found, counts, end_id, "<u2")
                shard.add(batch.column(0).slice(a, b - a), ids, counts + 1, int(offsets[b] - offsets[a]) + b - a)
                if shard.bytes >= shard_bytes:
                    yield shard.publish(number, folder)
                    shard, number = _Shard(), number + 1
        if shard.bytes:
            yield shard.publish(number, folder)
        del shard
        release_memory()

    # the rows go together before they are written: a file of its own for each would be a waste of many small files
    manifest = placed.mapInArrow(run, MANIFEST).repartition(max(1, math.ceil(total / shard_bytes / MANIFEST_ROWS)))
    return written(manifest, "manifest")


def read_token_files(manifest: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document from the files alone: key, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all documents before it over all files: those of the ranges before, whose sums the
    only window over everything runs on (one row per range), and those of the files before in the range.
    """
    place = F.floor(F.col("shard") / F.lit(FILES_PER_RANGE)).alias("range")
    sums = manifest.groupBy(place).agg(F.sum("tokens").alias("tokens"))
    earlier = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select("range", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"))
    inside = W.partitionBy("range").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.select(place, "shard", "path", "tokens").withColumn("inside", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    files = files.join(before, "range").select("path", (F.col("before") + F.col("inside")).alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, ends, matrix = from_bytes(read_file(path))
                starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                ids = memoryview(matrix.ids().astype("<u4")).cast("B")
                crc = [zlib.crc32(ids[a * 4 : b * 4]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array(starts + base), pa.array(ends - starts), pa.array(crc, pa.int64())],
                    names=["key", "start", "n_tokens", "ids_crc32"],
                )

    spread = files.repartition(min(RANGES, max(1, manifest.count())))
    found = spread.mapInArrow(run, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    return found.withColumnRenamed("key", key)


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark) + "/tokens"
    return read_token_files(write_token_files(table(spark, sf_dir, "documents"), folder))
