"""Quality rules by line sequence labelling.

A linear-chain conditional random field labels each line of a text as content or boilerplate; Viterbi decoding finds
the likeliest labels and the share of content decides whether the text is kept.

The field is trained here on evidence about lines, from a bounded sample of labelled documents: a line that documents
which differ have in common is boilerplate, the other lines of a good document are content, and what the other lines
of a bad document are isn't known. Those are hidden, with odds against content, and are estimated anew (EM) as the
field learns, so a bad document can have good lines and a good one bad ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrow_text
from .words import PIECE, SPACE, _hash_spans, mix, spans, windows
from .workspace import fields, release_memory, table

#: Labelled documents of each quality that the field is trained on, at most about so many, picked by hash.
SAMPLE_PER_LABEL = 1_500
#: Share of word characters in content lines that a kept text has at least.
CONTENT_SHARE = 0.5
RUN, MIN_WORDS, MAX_REPEATED = 5, 10, 20
#: A line of this many documents of the sample, or more, whose longest lines differ, is boilerplate.
COMMON = 3
#: Log-odds of content for a line of a bad document about which nothing else is known, before its features speak.
BAD_PRIOR = -4.0
HIDDEN = -1

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_END = np.zeros(256, bool)
_END[list(b".!?:;")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _sums(mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[ends] - total[starts]


def _repeat_words(hashes: np.ndarray, before: np.ndarray, run: int) -> np.ndarray:
    """Words of each text that lie in a run of words found twice or more in it."""
    n = np.diff(before)
    owner = np.repeat(np.arange(len(n)), n)
    w = windows(hashes, run)
    if not len(w):
        return np.zeros(len(n), np.int64)
    inside = owner[: len(w)] == owner[run - 1 :]
    at = np.flatnonzero(inside)
    value = mix(w[at] + owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(value)
    same = value[order[1:]] == value[order[:-1]]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + run, -1)
    covered = np.cumsum(cover[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(n)).astype(np.int64)


N_FEATURES = 30
#: What is counted of a line, piece by piece.
LINE_COUNTS = ["words", "chars", "capitals", "letters", "digits", "symbols", "pipes", "bangs", "adjacent", "ends"]


def _features(lines: np.ndarray, share: np.ndarray, dup: np.ndarray, first: np.ndarray, last: np.ndarray, closed: np.ndarray) -> np.ndarray:
    """One row of 0/1 features for each line, from its LINE_COUNTS, its share of the text's characters and where it stands."""
    words, chars, upper, letters, digits, symbols, pipes, bangs, adjacent, ends = lines.T
    w, c, a = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(letters, 1)
    sentence = words / (ends + 1)
    columns = [
        np.ones(len(words), bool), words <= 2, (words > 2) & (words <= 5), (words > 5) & (words <= 10), words > 10,
        upper / a > 0.2, upper / a > 0.5, upper / a > 0.8, symbols / w > 0.1, symbols / w > 0.5, pipes / w > 0.2,
        bangs / w > 0.2, bangs / w > 0.6, adjacent / w > 0.1, adjacent / w > 0.4, ends == 0, ends / w > 0.4,
        sentence > 25, sentence > 60, digits / c > 0.2, chars / w > 9, chars / w < 3, dup, first, last, ~closed,
        share >= 0.5, share >= 0.2, share < 0.05, share < 0.01,
    ]
    return np.stack(columns, axis=1)


@dataclass
class Lines:
    """Base counts of texts and their lines that have a word."""

    counts: np.ndarray  # texts x COUNTS
    owner: np.ndarray  # the text of each line
    chars: np.ndarray  # word characters of each line
    hashes: np.ndarray  # of each line's bytes
    features: np.ndarray


@dataclass
class _Part:
    """The lines of a slice, before it is known what stands before and after."""

    sums: np.ndarray  # texts x (words, word characters, symbols)
    words: np.ndarray  # hashes
    before: np.ndarray  # words before each text
    owner: np.ndarray
    lines: np.ndarray  # lines x LINE_COUNTS
    hashes: np.ndarray
    closed: np.ndarray


def _part(data: np.ndarray, offsets: np.ndarray) -> _Part:
    starts, ends, before = spans(data, offsets)
    hashes = _hash_spans(data, starts, ends, False)
    lead = (data & 0xC0) != 0x80
    in_word = lead & ~SPACE[data]
    breaks = np.flatnonzero(data == 10)
    line_starts = np.union1d(offsets[:-1][np.diff(offsets) > 0], breaks + 1)
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.concatenate([line_starts[1:], [len(data)]]) if len(line_starts) else line_starts
    at_break = np.zeros(len(data) + 1, bool)
    at_break[breaks] = True
    line_ends = line_ends - (at_break[line_ends - 1] & (line_ends > line_starts)) if len(line_ends) else line_ends
    first_word = np.searchsorted(starts, line_starts)
    last_word = np.searchsorted(starts, line_ends)
    has = last_word > first_word
    line_starts, line_ends, first_word, last_word = line_starts[has], line_ends[has], first_word[has], last_word[has]
    upper = (data >= 65) & (data <= 90)
    wide = np.zeros(len(data), bool)
    wide[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    lower = ((data >= 97) & (data <= 122)) | (lead & (data >= 0x80))
    at = lambda m: _sums(m, line_starts, line_ends)
    adjacent = np.zeros(len(hashes) + 1, bool)
    if len(hashes) > 1:
        adjacent[1:-1] = hashes[1:] == hashes[:-1]
        adjacent[first_word] = False
    repeated = np.concatenate([[0], np.cumsum(adjacent[:-1], dtype=np.int64)]) if len(hashes) else np.zeros(1, np.int64)
    closing = np.concatenate([[0], np.cumsum(_END[data[ends - 1]], dtype=np.int64)]) if len(ends) else np.zeros(1, np.int64)
    lines = [
        last_word - first_word, at(in_word), at(upper) + at(wide), at(upper | lower), at((data >= 48) & (data <= 57)), at(_SYMBOL[data]),
        at(data == 124), at(data == 33), repeated[last_word] - repeated[first_word], closing[last_word] - closing[first_word],
    ]
    return _Part(
        np.stack([np.diff(before), _sums(in_word, offsets[:-1], offsets[1:]), _sums(_SYMBOL[data], offsets[:-1], offsets[1:])], axis=1),
        hashes,
        before,
        np.searchsorted(offsets, line_starts, side="right") - 1,
        np.stack(lines, axis=1).astype(np.int64),
        _hash_spans(data, line_starts, line_ends, False),
        _END[data[ends[last_word - 1] - 1]] if len(line_starts) else np.empty(0, bool),
    )


def _whole(part: _Part) -> Lines:
    """What depends on a whole text: lines that it has had before, its first and last ones, and words in repeated runs."""
    owner, rows = part.owner, len(part.sums)
    order = np.lexsort((part.hashes, owner))
    dup = np.zeros(len(owner), bool)
    dup[order[1:][(part.hashes[order[1:]] == part.hashes[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])]] = True
    first, last = np.ones(len(owner), bool), np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    last[:-1] = first[1:]
    share = part.lines[:, 1] / np.maximum(part.sums[owner, 1], 1)
    counts = np.column_stack([part.sums, np.bincount(owner[dup], minlength=rows), _repeat_words(part.words, part.before, RUN)]).astype(np.int64)
    return Lines(counts, owner, part.lines[:, 1], part.hashes, _features(part.lines, share, dup, first, last, part.closed))


def _long_line(data: np.ndarray, piece: int) -> _Part:
    """One line of more than ``piece`` bytes, counted in pieces that end between words."""
    found, at = [], 0
    while at < len(data):
        stop = min(at + piece, len(data))
        while stop < len(data) and not SPACE[data[stop]]:
            gap = np.flatnonzero(SPACE[data[stop : stop + piece]])
            stop = stop + int(gap[0]) if len(gap) else min(stop + piece, len(data))
        found.append(_part(data[at:stop], np.array([0, stop - at])))
        at = stop
    words = np.concatenate([f.words for f in found])
    lines = np.concatenate([f.lines for f in found]).sum(axis=0, keepdims=True)
    ends = [f.words for f in found if len(f.words)]
    lines[0, LINE_COUNTS.index("adjacent")] += sum(a[-1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    n = min(1, len(words))  # a line without words is none
    name = np.frombuffer(hashlib.blake2b(data.tobytes(), digest_size=8).digest(), np.uint64)[:n]
    closed = np.concatenate([f.closed for f in found])[-n:] if n else np.empty(0, bool)
    return _Part(np.sum([f.sums for f in found], axis=0), words, np.array([0, len(words)]), np.zeros(n, np.int64), lines[:n], name, closed)


def analyse(data: np.ndarray, offsets: np.ndarray, piece: int | None = None) -> Lines:
    """Counts and line features of some texts.

    A text beyond ``piece`` bytes (PIECE by default) is read in pieces that end between lines, and a line beyond that in pieces that end
    between words, so that memory stays bounded; the result doesn't depend on where pieces end.
    """
    piece = piece or PIECE
    if len(offsets) > 2 or len(data) <= piece:
        return _whole(_part(data, offsets))
    breaks = np.concatenate([np.flatnonzero(data == 10) + 1, [len(data)]])
    parts, at = [], 0
    while at < len(data):
        k = int(np.searchsorted(breaks, at + piece, side="right")) - 1
        if k >= 0 and breaks[k] > at:
            parts.append(_part(data[at : breaks[k]], np.array([0, breaks[k] - at])))
            at = int(breaks[k])
        else:  # a line as long as this is always taken alone, so that equal ones have equal names
            stop = int(breaks[k + 1])
            parts.append(_long_line(data[at : stop - (data[stop - 1] == 10)], piece))
            at = stop
    join = lambda f: np.concatenate([f(p) for p in parts])
    words = join(lambda p: p.words)
    return _whole(
        _Part(
            np.sum([p.sums for p in parts], axis=0),
            words,
            np.array([0, len(words)]),
            join(lambda p: p.owner),
            join(lambda p: p.lines),
            join(lambda p: p.hashes),
            join(lambda p: p.closed),
        )
    )


class LineField:
    """A linear-chain conditional random field with the labels 0 (boilerplate) and 1 (content)."""

    def __init__(self, weights: np.ndarray | None = None, moves: np.ndarray | None = None):
        self.weights = np.zeros(N_FEATURES) if weights is None else weights
        self.moves = np.zeros((2, 2)) if moves is None else moves

    @staticmethod
    def _ragged(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first line, lines) of each sequence, longest first."""
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
        n = np.diff(np.r_[first, len(owner)])
        order = np.argsort(-n, kind="stable")
        return first[order], n[order]

    def fit(self, features: np.ndarray, owner: np.ndarray, labels: np.ndarray, rounds: int = 200, every: int = 10, ridge: float = 1e-5) -> LineField:
        """Maximum likelihood of the known labels with a ridge, by gradient steps (Adam) over all sequences.

        HIDDEN labels are estimated every ``every`` steps, given the known ones around them and BAD_PRIOR.
        """
        x, y = features.astype(np.float64), labels.astype(np.int64)
        if not len(x):
            return self
        first, n = self._ragged(owner)
        hidden = y == HIDDEN
        theta = np.concatenate([self.weights, self.moves.ravel()])
        mean, square, size = np.zeros_like(theta), np.zeros_like(theta), len(x)
        for step in range(1, rounds + 1):
            e, moves = x @ theta[:-4], theta[-4:].reshape(2, 2)
            if step % every == 1 or every == 1:
                known = np.stack([y != 1, y != 0], axis=1).astype(float)
                known[hidden] = self._chances(e[hidden] + BAD_PRIOR)
                seen, seen_pairs = self._marginals(known, moves, first, n)
            p, pairs = self._marginals(self._chances(e), moves, first, n)
            slope = np.concatenate([x.T @ (p - seen), (pairs - seen_pairs).ravel()]) / size + ridge * theta
            mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
            theta = theta - 0.15 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        self.weights, self.moves = theta[:-4], theta[-4:].reshape(2, 2)
        return self

    @staticmethod
    def _chances(e: np.ndarray) -> np.ndarray:
        return np.exp(np.clip(np.stack([np.zeros_like(e), e], axis=1), -30, 30))

    @staticmethod
    def _marginals(emit: np.ndarray, moves: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chance of label 1 of each line, expected label moves) by the forward-backward algorithm, from how well each
        line (row) fits each label."""
        step = np.exp(moves)
        forward, scale = np.empty_like(emit), np.ones(len(emit))
        longest = int(n[0])
        counts = np.searchsorted(-n, -np.arange(longest), side="left")  # sequences with more than t lines
        for t in range(longest):
            at = first[: counts[t]] + t
            now = emit[at] * (forward[at - 1] @ step) if t else emit[at].copy()
            scale[at] = now.sum(axis=1)
            forward[at] = now / scale[at][:, None]
        backward = np.ones_like(emit)
        pairs = np.zeros((2, 2))
        for t in range(longest - 1, 0, -1):
            at = first[: counts[t]] + t
            after = emit[at] * backward[at] / scale[at][:, None]
            backward[at - 1] = after @ step.T
            pairs += step * (forward[at - 1].T @ after)
        both = forward * backward
        return both[:, 1] / both.sum(axis=1), pairs

    def decode(self, features: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """The likeliest labels (Viterbi); of equal ones the content label."""
        labels = np.zeros(len(owner), np.int64)
        if not len(owner):
            return labels
        e = features @ self.weights
        first, n = self._ragged(owner)
        longest = int(n[0])
        counts = np.searchsorted(-n, -np.arange(longest), side="left")
        best = np.stack([np.zeros_like(e), e], axis=1)
        back = np.zeros((len(e), 2), np.int8)
        for t in range(1, longest):
            at = first[: counts[t]] + t
            ways = best[at - 1][:, :, None] + self.moves[None]  # from, to
            back[at] = ways[:, 1] >= ways[:, 0]
            best[at] += ways.max(axis=1)
        for t in range(longest - 1, -1, -1):
            at = first[: counts[t]] + t
            ending = n[: counts[t]] == t + 1
            last = at[ending]
            labels[last] = best[last, 1] >= best[last, 0]
            on = at[~ending]
            labels[on] = back[on + 1, labels[on + 1]]
        return labels

    def shares(self, lines: Lines) -> np.ndarray:
        """The share of word characters in content lines of each text; 0 without lines."""
        labels = self.decode(lines.features, lines.owner)
        rows = len(lines.counts)
        total = np.bincount(lines.owner, lines.chars, rows)
        content = np.bincount(lines.owner, lines.chars * labels, rows)
        return np.divide(content, total, out=np.zeros(rows), where=total > 0)


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEATED * counts[:, 0])


def judge(column: pa.Array, field: LineField, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, content share, kept) of the texts of an Arrow column."""
    data, offsets = arrow_text.flat(column)
    counts, shares = [np.empty((0, len(COUNTS)), np.int64)], [np.empty(0)]
    for a, b in arrow_text.slices(offsets):
        lines = analyse(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        counts.append(lines.counts)
        shares.append(field.shares(lines))
    found, share = np.concatenate(counts), np.concatenate(shares)
    return found, share, ~base_failed(found) & (share >= least)


def line_labels(hashes: np.ndarray, owner: np.ndarray, chars: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Labels of lines (0, 1 or HIDDEN) by the documents that have them; ``good`` is each document's quality.

    Copies of a document don't make its lines common: documents count by their longest line's hash, so a line is common
    if it goes with COMMON different ones.
    """
    longest = np.zeros(len(good), np.uint64)
    order = np.lexsort((hashes, chars, owner))
    last = np.flatnonzero(np.r_[owner[order][1:] != owner[order][:-1], True]) if len(order) else order
    longest[owner[order[last]]] = hashes[order[last]]
    pairs = np.unique(np.stack([hashes, longest[owner]], axis=1), axis=0) if len(hashes) else np.empty((0, 2), np.uint64)
    names, n = np.unique(pairs[:, 0], return_counts=True)
    common = np.isin(hashes, names[n >= COMMON])
    return np.where(common, 0, np.where(good[owner] == 1, 1, HIDDEN))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE_PER_LABEL) -> LineField:
    """The field trained on at most about ``sample`` documents of each label, picked by hash; the driver gets the
    features and hashes of their lines. Of conflicting labels of a document the worse counts. Without labels of both
    kinds, every line counts as content."""
    known = fields(labels, key=key, label=label).where(F.col("label").isin(0, 1)).dropna().groupBy("key").agg(F.min("label").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        weights = np.zeros(N_FEATURES)
        weights[0] = 1.0
        return LineField(weights)
    share = F.when(F.col("label") == 0, F.lit(min(1.0, sample / counts[0]))).otherwise(F.lit(min(1.0, sample / counts[1])))
    chosen = known.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < share * (1 << 20))
    rows = fields(documents, key=key, text=text).join(F.broadcast(chosen), "key").select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = arrow_text.flat(batch.column(0))
            quality = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in arrow_text.slices(offsets):
                lines = analyse(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for k in range(b - a):
                    own = lines.owner == k
                    if own.any():
                        packed = [np.packbits(lines.features[own], axis=1).tobytes(), lines.hashes[own].tobytes(), lines.chars[own].astype("<i8").tobytes()]
                        values = [*[pa.array([x], pa.binary()) for x in packed], pa.array([int(quality[a + k])], pa.int32())]
                        yield pa.RecordBatch.from_arrays(values, names=["features", "hashes", "chars", "label"])

    found = rows.mapInArrow(run, "features binary, hashes binary, chars binary, label int").collect()
    found = sorted((bytes(r["features"]), bytes(r["hashes"]), bytes(r["chars"]), r["label"]) for r in found)
    if not found:
        return LineField()
    width = (N_FEATURES + 7) // 8
    features = np.unpackbits(np.frombuffer(b"".join(f for f, *_ in found), np.uint8).reshape(-1, width), axis=1, count=N_FEATURES)
    hashes = np.frombuffer(b"".join(h for _, h, *_ in found), np.uint64)
    chars = np.frombuffer(b"".join(c for _, _, c, _ in found), "<i8")
    owner = np.repeat(np.arange(len(found)), [len(h) // 8 for _, h, *_ in found])
    return LineField().fit(features, owner, line_labels(hashes, owner, chars, np.array([y for *_, y in found])))


def quality(documents: DataFrame, field: LineField, key: str = "doc_id", text: str = "text", least: float = CONTENT_SHARE) -> DataFrame:
    """One row per input row: key, the base counts, base_failed, content_share, kept.

    A null text has no words, fails the base rules and isn't kept. Lines are cut at \\n only; lines without a word
    have no label. Texts of any length are judged by the same rules. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, share, kept = judge(batch.column(1), field, least)
            arrays = [batch.column(0), *[pa.array(counts[:, k]) for k in range(len(COUNTS))], pa.array(base_failed(counts)), pa.array(share), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", *COUNTS, "base_failed", "content_share", "kept"])

    kind = documents.schema[key].dataType.simpleString()
    schema = f"key {kind}, {', '.join(f'{c} bigint' for c in COUNTS)}, base_failed boolean, content_share double, kept boolean"
    return fields(documents, key=key, text=text).mapInArrow(run, schema).withColumnRenamed("key", key)


def keep_good(documents: DataFrame, field: LineField, text: str = "text", least: float = CONTENT_SHARE) -> DataFrame:
    """The kept rows with all their columns, whatever these are called; a null or empty text has no words and goes."""
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(at), field, least)[2]))
        release_memory()

    return documents.mapInArrow(run, documents.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality(documents, train(documents, table(spark, sf_dir, "labels")))
