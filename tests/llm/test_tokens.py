import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import EDGE
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessera.llm import packing, token_counts, token_ids, wavelet, words
from tessera.llm.arrow_text import flat

ALPHABET = st.sampled_from(list("aabcXY '.,!12  \n\t\x1f\xa0 éÉß日🙂|<>") + ["<|endoftext|>", "<|startoftext|>", " the", "  "])
TEXTS = st.lists(st.lists(ALPHABET, max_size=30).map("".join), max_size=6)


@pytest.fixture(scope="module")
def libraries():
    return {n: Tokenizer.from_file(token_ids.vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@settings(max_examples=80, deadline=None)
@given(texts=TEXTS)
def test_ids_and_counts_are_the_library_s(texts):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        tool = token_ids.encoder(token_ids.vocabulary(name))
        want = [e.ids for e in tool.library.encode_batch(texts, add_special_tokens=False)]
        ids, counts = tool.encode(*flat(pa.array(texts, pa.string())))
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]
        if name == "byte_bpe_50k.json":
            got = token_counts.counter(token_counts.default_vocabulary()).count(*flat(pa.array(texts, pa.string())))
            assert got.tolist() == [len(w) for w in want]


def test_long_texts_and_a_small_memory(libraries, monkeypatch):
    texts = ["many words of all kinds, " * 40, "x" * 500, None, "été " * 90, "a b " * 30]
    monkeypatch.setattr(words, "PIECE", 64)
    monkeypatch.setattr(token_ids, "PIECE", 64)
    tool = token_ids.Encoder(token_ids.vocabulary("byte_bpe_50k.json"))
    tool.memory.known = token_ids.Known(bits=4)
    for _ in range(3):
        ids, counts = tool.encode(*flat(pa.array(texts, pa.string())))
        want = [e.ids for e in libraries["byte_bpe_50k.json"].encode_batch([t or "" for t in texts], add_special_tokens=False)]
        assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


@settings(max_examples=60, deadline=None)
@given(word=st.text(st.sampled_from("aabbthein gsé日"), min_size=1, max_size=200))
def test_a_sequence_by_itself_merges_as_together(word):
    tool = token_counts.counter(token_counts.default_vocabulary())
    together, _ = tool.merge([word.encode()])
    assert tool.merge_long(word.encode()).tolist() == together.tolist()


def test_very_long_words(libraries):
    r = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    texts = ["".join(r.choice(letters, 150_000)), "a" * 50_001, "the" * 20_000, "日本" * 5_000, "ab" * 3_000 + " end"]
    tool = token_counts.Counter(token_counts.default_vocabulary())
    start = time.perf_counter()
    got = tool.count(*flat(pa.array(texts, pa.string())))
    assert time.perf_counter() - start < 20
    assert got.tolist() == [len(e.ids) for e in libraries["byte_bpe_50k.json"].encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_edges(spark, edge, libraries):
    found = sorted(((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts.token_counts(edge).collect()), key=str)
    library = libraries["byte_bpe_50k.json"]
    want = []
    for k, t in EDGE:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((k, len((t or "").encode()), n, n > 512))
    assert found == sorted(want, key=str)
    assert token_counts.token_counts(edge.limit(0)).count() == 0


def test_best_fit_takes_the_tightest_window():
    lengths = [9, 7, 5, 3, 3, 2, 1]
    where, offsets = packing.best_fit_decreasing(lengths, 10)
    assert where == [0, 1, 2, 1, 2, 2, 0] and offsets == [0, 0, 0, 7, 5, 8, 9]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_best_fit_as_by_plain_search(lengths):
    lengths = sorted(lengths, reverse=True)
    where, offsets = packing.best_fit_decreasing(lengths, 64)
    room = []
    for n, w, o in zip(lengths, where, offsets, strict=True):
        fitting = [r for r in room if r >= n]
        if fitting:
            assert room[w] == min(fitting)
        else:
            assert w == len(room)
            room.append(64)
        assert o == 64 - room[w]
        room[w] -= n


@pytest.mark.parametrize("pieces_per_bin", [40_000, 3])
def test_packing_round_trip(edge, libraries, pieces_per_bin):
    library = libraries["word_bpe_49k.json"]
    want = defaultdict(int)
    for k, t in EDGE:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 256):
            want[k, a, len(ids[a : a + 256]), zlib.crc32(ids[a : a + 256].tobytes()), len(ids)] += 1
    rows = packing.pack(edge, window=256, pieces_per_bin=pieces_per_bin).collect()
    got = defaultdict(int)
    sequences = defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(edge.limit(0)).count() == 0


def test_wavelet_matrix_as_an_array():
    r = np.random.default_rng(5)
    for n in (0, 1, 7, 8, 9, 1000, (1 << 16) + 5):
        ids = r.integers(0, 40, n).astype(np.uint16) * 1000
        m = wavelet.from_bytes(wavelet.to_bytes(np.arange(2), np.array([n, n]), wavelet.WaveletMatrix.build(ids)))[2]
        assert (m.ids() == ids).all()
        for at in r.integers(0, n, 20).tolist() if n else []:
            assert m.access(at) == ids[at]
            token = int(ids[at])
            assert m.rank(token, at) == (ids[:at] == token).sum()
            places = np.flatnonzero(ids == token)
            k = int(r.integers(0, len(places)))
            assert m.count(token) == len(places) and m.select(token, k) == places[k]
        assert m.count(39_001) == 0 and m.count(70_000) == 0
        with pytest.raises(IndexError):
            m.access(n)


def test_token_files_round_trip(spark, edge, libraries, tmp_path):
    library = libraries["byte_bpe_50k.json"]
    rows = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for k, t in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((k, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    manifest = wavelet.write_token_files(edge, str(tmp_path / "files"), shard_bytes=60_000)
    assert manifest.count() > 1 and manifest.agg({"tokens": "sum"}).first()[0] == start
    found = sorted((tuple(r) for r in wavelet.read_token_files(manifest).collect()), key=lambda r: r[1])
    assert found == want
    empty = wavelet.write_token_files(edge.limit(0), str(tmp_path / "none"))
    assert wavelet.read_token_files(empty).count() == 0


def test_damaged_files_are_refused():
    data = wavelet.to_bytes(np.arange(1), np.array([3]), wavelet.WaveletMatrix.build(np.array([1, 2, 0], np.uint16)))
    with pytest.raises(ValueError):
        wavelet.from_bytes(data[:-1] + bytes([data[-1] ^ 1]))
    with pytest.raises(ValueError):
        wavelet.from_bytes(b"something else entirely")


def test_token_files_are_bounded_by_bytes(spark, documents, tmp_path):
    """Long texts that are neighbours, thousands of equal rows, the lowest key beside null ones."""
    rows = [(k, "long text of words " * (500 if 100 <= k < 140 else 1)) for k in range(300)]
    rows += [(150, "the same words")] * 3000 + [(None, "no key"), (None, None), (-(1 << 63), "lowest")]
    manifest = wavelet.write_token_files(documents(rows).repartition(5), str(tmp_path / "files"), shard_bytes=20_000)
    found = wavelet.read_token_files(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted([k for k, _ in rows], key=lambda k: (k is not None, k or 0))
    assert sum(r["n_tokens"] for r in found) == manifest.agg({"tokens": "sum"}).first()[0]
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(found, found[1:], strict=False))
    files = manifest.orderBy("shard").collect()
    assert max(r["tokens"] for r in files) < 20_000 and len(files) > 20
    assert files[0]["first_key"] is None and sum(r["documents"] for r in files) == len(rows)
