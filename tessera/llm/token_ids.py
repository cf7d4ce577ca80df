"""Token ids of whole texts by the tokenizers library, each distinct chunk encoded once while it is remembered.

No token of the two vocabularies spans the border between a non-space and a following space or newline, so a text
whose only white space is spaces and newlines is the sum of its chunks, each being white space and the word after
it. Chunks are cut and named by 64-bit hashes for whole batches with numpy; a hash table of arrays has the ids of
those that the library has encoded before. Texts with other white space are encoded whole. Both ways give the
library's ids.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

from .arrow_text import slices
from .chunks import odd_rows
from .words import PIECE, _hash_spans

#: Slots of the table of remembered chunks, half of which are filled at most.
TABLE_BITS = 21
#: Chunks that the library gets as one text.
TOGETHER = 64


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Known:
    """Chunk hash -> values, as arrays. Entries beyond the room are held for the present slice only."""

    def __init__(self, bits: int = TABLE_BITS, dtype: str = "<u2"):
        self.bits, self.size = bits, 1 << bits
        self.keys = np.zeros(self.size, np.uint64)
        self.entry = np.zeros(self.size, np.int32)
        self.ends = np.zeros(1024, np.int64)  # ends[k] .. ends[k + 1] is entry k in the pool
        self.pool = np.zeros(4096, dtype)
        self.n = 0

    def _probe(self, keys: np.ndarray, stop_at_free: bool) -> np.ndarray:
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        held = self.keys[slot]
        seek = np.flatnonzero((held != keys) & (held != 0))
        while len(seek):
            slot[seek] = (slot[seek] + 1) & (self.size - 1)
            held = self.keys[slot[seek]]
            seek = seek[(held != keys[seek]) & (held != 0)]
        return slot

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of each key, -1 where it isn't known."""
        slot = self._probe(keys, False)
        return np.where(self.keys[slot] == keys, self.entry[slot], -1)

    def add(self, keys: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
        """New distinct keys -> their entries."""
        lengths = np.array([len(v) for v in values], np.int64)
        first, used = self.n, int(self.ends[self.n])
        while len(self.ends) < first + len(keys) + 1:
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.pool) < used + int(lengths.sum()):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        if len(keys):
            self.ends[first + 1 : first + len(keys) + 1] = used + np.cumsum(lengths)
            self.pool[used : used + int(lengths.sum())] = np.concatenate(values)
        entries = np.arange(first, first + len(keys), dtype=np.int32)
        if first + len(keys) <= self.size // 2:
            self.n = first + len(keys)
            left = np.arange(len(keys))
            slot = self._probe(keys, True)
            while len(left):
                place = np.unique(slot, return_index=True)[1]
                self.keys[slot[place]], self.entry[slot[place]] = keys[left[place]], entries[left[place]]
                left = np.delete(left, place)
                slot = self._probe(keys[left], True)
        return entries

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the entries' values one after the other, their lengths)."""
        starts = self.ends[entries]
        lengths = self.ends[entries + 1] - starts
        total = int(lengths.sum())
        heads = np.cumsum(lengths) - lengths
        at = np.arange(total) + np.repeat(starts - heads, lengths)
        return self.pool[at], lengths


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin: at every text, and at white space after a non-space."""
    space = (data == 32) | (data == 10)
    first = np.zeros(len(data), bool)
    first[1:] = space[1:] & ~space[:-1]
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(first)


class ChunkMemory:
    """Runs a function of distinct chunks over whole texts; ``values`` maps chunks to arrays."""

    def __init__(self, values, whole, bits: int = TABLE_BITS, dtype: str = "<u2"):
        self.values, self.whole, self.known = values, whole, Known(bits, dtype)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = chunk_starts(data, offsets)
        ends = np.concatenate([starts[1:], [len(data)]]) if len(starts) else starts
        keys = _hash_spans(data, starts, ends, False)
        keys[keys == 0] = 1
        entries = self.known.find(keys)
        new = np.flatnonzero(entries < 0)
        if len(new):
            names, place, back = np.unique(keys[new], return_index=True, return_inverse=True)
            raw = data.tobytes()
            a, b = starts[new[place]].tolist(), ends[new[place]].tolist()
            found = self.values([raw[i:j].decode() for i, j in zip(a, b, strict=True)])
            entries[new] = self.known.add(names, found)[back]
        values, lengths = self.known.gather(entries)
        total = np.concatenate([[0], np.cumsum(lengths)])
        at = np.searchsorted(starts, offsets)
        return values, np.diff(total[at])

    def _text(self, data: np.ndarray) -> np.ndarray:
        """One text of any length, in pieces that end between chunks."""
        found, at = [], 0
        while at < len(data):
            stop = min(at + PIECE, len(data))
            while stop < len(data):
                part = data[stop - 1 : stop + PIECE]
                space = (part == 32) | (part == 10)
                cut = np.flatnonzero(space[1:] & ~space[:-1])
                if len(cut):
                    stop += int(cut[0])
                    break
                stop = min(stop + PIECE, len(data))
            found.append(self._slice(data[at:stop], np.array([0, stop - at]))[0])
            at = stop
        return np.concatenate(found) if found else self.known.pool[:0]

    def run(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values of all texts one after the other, how many each text has)."""
        parts, counts = [], []
        for a, b in slices(offsets):
            part, own = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            odd = odd_rows(part, own)
            if not len(odd) and len(part) <= PIECE:
                values, n = self._slice(part, own)
                parts.append(values)
                counts.append(n)
                continue
            skip = set(odd.tolist())
            for k in range(b - a):
                text = part[own[k] : own[k + 1]]
                values = self.whole(text.tobytes().decode()) if k in skip else self._text(text)
                parts.append(values)
                counts.append(np.array([len(values)]))
        none = self.known.pool[:0]
        return np.concatenate([none, *parts]), np.concatenate([np.empty(0, np.int64), *counts]).astype(np.int64)


class Encoder:
    """Texts -> ids below 65,536."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("ids must fit in 16 bits")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # bytes of text behind each id: a byte-level symbol stands for one byte, a word-end mark for none
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, number in vocab.items():
            self.width[number] = len(token.removesuffix("</w>"))
        self.normal = self.library.normalizer is not None  # NFC, no white space, lower case
        self.memory = ChunkMemory(self.chunk_ids, lambda t: self.whole([t])[0])

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u2") for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def chunk_ids(self, new: list[str]) -> list[np.ndarray]:
        """The ids of each chunk. Plain chunks go to the library as texts of some dozens; the ids are cut where the
        chunks' bytes end, and a text whose ids don't end there exactly is encoded chunk by chunk."""
        out: list[np.ndarray | None] = [None] * len(new)
        plain = [k for k, c in enumerate(new) if c[0] == " " and len(c) > 1 and " " not in c[1:] and "\n" not in c and "|" not in c]
        if self.normal:
            plain = [k for k in plain if new[k].isascii() or unicodedata.is_normalized("NFC", new[k])]
        groups = [plain[k : k + TOGETHER] for k in range(0, len(plain), TOGETHER)]
        texts = ["".join([new[k] for k in g]) for g in groups]
        for group, found in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u2")
            at = np.cumsum(self.width[ids])
            sizes = [len(new[k].lower().encode()) - 1 for k in group] if self.normal else [len(new[k].encode()) for k in group]
            ends = np.cumsum(sizes)
            cuts = np.searchsorted(at, ends)
            if len(at) and cuts[-1] == len(at) - 1 and (at[cuts] == ends).all():
                first = 0
                for k, stop in zip(group, (cuts + 1).tolist(), strict=True):
                    out[k] = ids[first:stop]
                    first = stop
        rest = [k for k, x in enumerate(out) if x is None]
        for k, ids in zip(rest, self.whole([new[k] for k in rest]), strict=True):
            out[k] = ids
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, ids of each text) for texts as flat UTF-8."""
        return self.memory.run(data, offsets)


@functools.lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int, dtype: str = "<u4") -> tuple[np.ndarray, np.ndarray]:
    """The texts' ids as unsigned numbers with ``end_id`` after each text, and where each text then ends."""
    ends = np.cumsum(counts + 1)
    out = np.full(len(ids) + len(counts), end_id, dtype)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = ids
    return out, ends
