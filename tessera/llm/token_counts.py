"""Token counts of byte-level BPE by rank-synchronous array merging.

Distinct pre-tokens are held as ragged numpy arrays: one flat array of symbol ids and the index of each symbol's
sequence. In every round each sequence finds its lowest-rank adjacent pair and applies all its occurrences at
once, all sequences together; a sequence without a mergeable pair leaves, and its surviving symbols are counted.

A sequence of very many symbols, as a text without a space is, goes through the same rounds by itself: only the places
that a round has changed are looked up again, so its cost follows its merges and not rounds times length.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from . import arrow_text
from .token_ids import ChunkMemory
from .workspace import fields, table

#: The published pre-token pattern of this vocabulary, a fixed value.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
NEVER = np.int32(2**31 - 1)
#: Symbols that are merged at once.
SYMBOLS = 1 << 20
#: A sequence of more symbols is merged by itself.
LONG = 4096


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_symbols() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


class PairTable:
    """Adjacent pair -> (rank, merged id), an open-addressing table that is read for whole arrays."""

    def __init__(self, pairs: np.ndarray, ranks: np.ndarray, merged: np.ndarray):
        self.bits = max(4, int(len(pairs) * 16).bit_length())
        size = 1 << self.bits
        self.keys = np.full(size, -1, np.int64)
        self.rank = np.full(size, NEVER, np.int32)
        self.merged = np.zeros(size, np.int32)
        left = np.arange(len(pairs))
        slot = self.home(pairs)
        while len(left):
            free = self.keys[slot] == -1
            firsts = np.unique(slot[free], return_index=True)[1]
            place = np.flatnonzero(free)[firsts]
            at = slot[place]
            self.keys[at], self.rank[at], self.merged[at] = pairs[left[place]], ranks[left[place]], merged[left[place]]
            stay = np.ones(len(left), bool)
            stay[place] = False
            left, slot = left[stay], (slot[stay] + 1) & (size - 1)

    def home(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, pairs: np.ndarray) -> np.ndarray:
        """The slot of each pair; a slot whose key differs holds no rank."""
        slot = self.home(pairs)
        key = self.keys[slot]
        seek = np.flatnonzero((key != pairs) & (key != -1))
        while len(seek):
            slot[seek] = (slot[seek] + 1) & (len(self.keys) - 1)
            key = self.keys[slot[seek]]
            seek = seek[(key != pairs[seek]) & (key != -1)]
        return slot


class Counter:
    """Counts the tokens of texts as the library does for a byte-level BPE file (no special tokens are added)."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE vocabulary is needed")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        done = np.array([vocab[a + b] for a, b in merges], np.int32)
        self.width = np.int64(max(vocab.values()) + 1)
        self.done = done
        self.pairs = PairTable(left * self.width + right, np.arange(len(merges), dtype=np.int32), done)
        self.of_byte = np.zeros(256, np.int32)
        for symbol, byte in byte_symbols().items():
            self.of_byte[byte] = vocab[symbol]
        self.memory = ChunkMemory(self.chunk_counts, self.text_counts, dtype="<i4")

    def merge(self, sequences: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(surviving ids, count of each sequence): the rank-synchronous merging itself."""
        lengths = np.array([len(s) for s in sequences], np.int64)
        ids = self.of_byte[np.frombuffer(b"".join(sequences), np.uint8)]
        owner = np.repeat(np.arange(len(sequences)), lengths)
        counts = np.zeros(len(sequences), np.int64)
        kept_ids, kept_owner = [], []
        while len(ids):
            same = owner[:-1] == owner[1:]
            slot = self.pairs.find(ids[:-1] * self.width + ids[1:])
            hit = same & (self.pairs.keys[slot] == ids[:-1] * self.width + ids[1:])
            rank = np.full(len(ids), NEVER, np.int32)
            rank[:-1][hit] = self.pairs.rank[slot[hit]]
            heads = np.flatnonzero(np.r_[True, ~same])
            sizes = np.diff(np.r_[heads, len(ids)])
            lowest = np.minimum.reduceat(rank, heads)
            over = lowest == NEVER
            counts[owner[heads[over]]] = sizes[over]
            ended = np.repeat(over, sizes)
            kept_ids.append(ids[ended])
            kept_owner.append(owner[ended])
            at = (rank == np.repeat(lowest, sizes)) & ~ended
            chosen = np.flatnonzero(at)
            if len(chosen):  # of overlapping occurrences, as in aaa, every second one counts from the left
                run = np.flatnonzero(np.r_[True, np.diff(chosen) != 1])
                place = np.arange(len(chosen)) - np.repeat(run, np.diff(np.r_[run, len(chosen)]))
                chosen = chosen[place % 2 == 0]
                ids[chosen] = self.pairs.merged[slot[chosen]]
                stay = ~ended
                stay[chosen + 1] = False
            else:
                stay = ~ended
            ids, owner = ids[stay], owner[stay]
        if not kept_ids:
            return np.empty(0, np.int32), counts
        ids, owner = np.concatenate(kept_ids), np.concatenate(kept_owner)
        return ids[np.argsort(owner, kind="stable")], counts

    def merge_long(self, sequence: bytes) -> np.ndarray:
        """The surviving ids of one sequence: places linked to their neighbours, and for each rank the places where a
        pair of that rank has come up, lowest rank first."""
        ids = self.of_byte[np.frombuffer(sequence, np.uint8)].astype(np.int64)
        n = len(ids)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive, rank = np.ones(n + 1, bool), np.full(n + 1, NEVER, np.int32)
        alive[n] = False
        came_up: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def look(at: np.ndarray) -> None:
            pair = ids[at] * self.width + ids[after[at]]
            slot = self.pairs.find(pair)
            found = np.where(self.pairs.keys[slot] == pair, self.pairs.rank[slot], NEVER)
            rank[at] = found
            order = np.argsort(found, kind="stable")
            order = order[: np.searchsorted(found[order], NEVER)]
            if not len(order):
                return
            heads = np.flatnonzero(np.r_[True, found[order][1:] != found[order][:-1]])
            for r, places in zip(found[order[heads]].tolist(), np.split(at[order], heads[1:]), strict=True):
                if r not in came_up:
                    came_up[r] = []
                    heapq.heappush(heap, r)
                came_up[r].append(places)

        if n > 1:
            look(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(came_up.pop(r)))
            at = at[alive[at] & (rank[at] == r)]
            if not len(at):
                continue
            run = np.flatnonzero(np.r_[True, after[at[:-1]] != at[1:]])
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[place % 2 == 0]  # of overlapping occurrences every second one counts from the left
            gone = after[at]
            ids[at] = self.done[r]
            alive[gone], rank[gone] = False, NEVER
            after[at] = after[gone]
            inner = after[at] < n
            before[after[at][inner]] = at[inner]
            rank[at] = NEVER
            look(np.unique(np.concatenate([at[inner], before[at][before[at] >= 0]])))
        return ids[alive[:n]]

    def count_pieces(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each piece without special tokens in it."""
        found = [[w.encode() for w in PRETOKEN.findall(p)] for p in pieces]
        words = sorted({w for ws in found for w in ws}, key=len)
        tokens: dict[bytes, int] = {}
        while words and len(words[-1]) > LONG:
            word = words.pop()
            tokens[word] = len(self.merge_long(word))
        first = 0
        while first < len(words):  # slices of like lengths and bounded size
            last, size = first, 0
            while last < len(words) and (last == first or size + len(words[last]) <= SYMBOLS):
                size += len(words[last])
                last += 1
            tokens.update(zip(words[first:last], self.merge(words[first:last])[1].tolist(), strict=True))
            first = last
        return np.array([sum(tokens[w] for w in ws) for ws in found], np.int64)

    def chunk_counts(self, chunks: list[str]) -> list[np.ndarray]:
        """Tokens of each chunk, special tokens in it included, as arrays of one number."""
        pieces, owner = chunks, np.arange(len(chunks))
        counts = np.zeros(len(chunks), np.int64)
        if self.cut and any(s in c for c in chunks for s in self.special):
            split = [self.cut.split(c) for c in chunks]
            pieces, owner = [p for ps in split for p in ps], np.repeat(owner, [len(ps) for ps in split])
            counts += np.array([len(ps) - 1 for ps in split], np.int64)
        np.add.at(counts, owner, self.count_pieces(pieces))
        return list(counts.astype("<i4").reshape(-1, 1))

    def text_counts(self, text: str) -> np.ndarray:
        return self.chunk_counts([text])[0]

    def count(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text, for texts as flat UTF-8."""
        values, n = self.memory.run(data, offsets)
        total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        ends = np.cumsum(n)
        return total[ends] - total[ends - n]


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, limit: int = 512
) -> DataFrame:
    """One row per input row: key, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Whole texts are counted; a null text counts as empty, with 0 bytes and tokens. Repeated rows are kept. The plan
    is one pass without a shuffle; a worker holds one Arrow batch and a bounded memory of distinct chunks.
    """
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in batches:
            data, offsets = arrow_text.flat(batch.column(1))
            tokens = tool.count(data, offsets)
            n_bytes = pa.array(np.diff(offsets), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), n_bytes, pa.array(tokens), pa.array(tokens > limit)],
                names=["key", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = fields(df, key=key, text=text)
    kind = df.schema[key].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return out.withColumnRenamed("key", key)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
