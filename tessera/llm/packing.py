"""Packing documents into fixed windows by best-fit decreasing.

Documents longer than a window are first cut into full windows. What remains is placed, longest first, into the
tightest open window that still has room; a segment tree indexed by remaining capacity finds it in
O(log window) steps.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow_text, token_ids
from .workspace import fields, release_memory, table, written

WINDOW, END_ID = 2048, 1
#: Pieces that one task packs together.
PIECES_PER_BIN = 40_000
#: Bytes of text that are encoded before their pieces are handed on.
SLICE_BYTES = 8 << 20


class OpenWindows:
    """Open windows by remaining capacity: a segment tree over 0..window of how many have that capacity."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.stacks: dict[int, list[tuple[int, int]]] = {}

    def _add(self, capacity: int, n: int) -> None:
        node = capacity + self.leaves
        while node:
            self.tree[node] += n
            node >>= 1

    def put(self, capacity: int, window: tuple[int, int]) -> None:
        """window: (id, tokens already in it)."""
        self.stacks.setdefault(capacity, []).append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, tuple[int, int]] | None:
        """The tightest open window with room for ``need``: (its capacity, the window), taken out."""
        tree, node = self.tree, need + self.leaves
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):  # up until a right sibling holds something
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        capacity = node - self.leaves
        self._add(capacity, -1)
        return capacity, self.stacks[capacity].pop()


def best_fit_decreasing(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """(window index, offset there) of lengths given in descending order, each from 1 to ``window``."""
    opened = OpenWindows(window)
    where, offsets, n = [], [], 0
    for length in lengths:
        found = opened.take(length)
        if found is None:
            capacity, spot = window, (n, 0)
            n += 1
        else:
            capacity, spot = found
        where.append(spot[0])
        offsets.append(spot[1])
        if capacity > length:
            opened.put(capacity - length, (spot[0], spot[1] + length))
    return where, offsets


PIECES = "key {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def cut_pieces(df: DataFrame, kind: str, path: str, window: int, end_id: int) -> DataFrame:
    """Rows (key, text) -> pieces: full windows of overlong documents, then what remains of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_ids.encoder(path).encode
        for batch in batches:
            data, offsets = arrow_text.flat(batch.column(1))
            for a, b in arrow_text.slices(offsets, SLICE_BYTES):
                ids, counts = encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                flat, ends = token_ids.with_end(ids, counts, end_id)
                n = counts + 1
                pieces = -(-n // window)
                row = np.repeat(np.arange(b - a), pieces)
                start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * window
                length = np.minimum(n[row] - start, window)
                first = (ends - n)[row] + start
                raw = memoryview(flat.tobytes())
                crc = [zlib.crc32(raw[4 * i : 4 * (i + k)]) for i, k in zip(first.tolist(), length.tolist(), strict=True)]
                numbers = [pa.array(x, pa.int64()) for x in (start, length, crc, n[row])]
                keys = batch.column(0).take(pa.array(row + a, pa.int64()))
                yield pa.RecordBatch.from_arrays([keys, *numbers], names=["key", "start", "length", "ids_crc32", "doc_tokens"])
        release_memory()

    return df.mapInArrow(run, PIECES.format(kind=kind))


def pack(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str | None = None,
    window: int = WINDOW,
    end_id: int = END_ID,
    pieces_per_bin: int = PIECES_PER_BIN,
) -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every document counts as its ids and ``end_id``, so a null or empty text is one token. Each id lies in exactly
    one piece. Remainders are dealt by hash into bins of about ``pieces_per_bin``, however many rows there are, and
    each bin is packed alone: the padding lost to this is below one window for each capacity left open at a bin's
    end. A sequence id is the bin's number times 2^32 plus the window's number in it; equal rows are packed one by
    one; an empty table gives an empty result.
    """
    if window < 1:
        raise ValueError("window must be positive")
    path = vocabulary or token_ids.vocabulary("word_bpe_49k.json")
    kind = df.schema[key].dataType.simpleString()
    pieces = written(cut_pieces(fields(df, key=key, text=text), kind, path, window, end_id), "pieces")
    bins = max(1, math.ceil(pieces.count() / pieces_per_bin))
    columns = ["key", "start", "length", "ids_crc32", "doc_tokens"]
    # equal rows spread too: the row's number is stable, since the pieces are read from storage
    spread = F.xxhash64("key", "start", "length", "ids_crc32", F.monotonically_increasing_id() % 64)
    dealt = pieces.withColumn("bin", F.pmod(spread, F.lit(bins)))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "key", "start"], ascending=[False, True, True], kind="stable")
        where, offsets = best_fit_decreasing(rows["length"].tolist(), window)
        base = int(rows["bin"].iloc[0]) << 32
        return rows[columns].assign(sequence_id=np.array(where, np.int64) + base, offset=np.array(offsets, np.int64))

    packed = dealt.groupBy("bin").applyInPandas(run, PIECES.format(kind=kind) + ", sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("key", key)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
