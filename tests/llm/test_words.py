import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import arrow_text, words

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\n\t\r🙂.", max_size=40)), max_size=12)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_cut_and_named_alike(texts):
    data, offsets = arrow_text.flat(pa.array(texts, pa.string()))
    hashes, before = words.word_hashes(data, offsets, lower=False)
    named = {}
    for k, t in enumerate(texts):
        found = WORD.findall(t or "")
        assert before[k + 1] - before[k] == len(found)
        for w, h in zip(found, hashes[before[k] : before[k + 1]].tolist(), strict=True):
            assert named.setdefault(w, h) == h
    assert len(set(named.values())) == len(named)


def test_lower_case_is_ascii_only():
    data, offsets = arrow_text.flat(pa.array(["ABC abc É é"]))
    h = words.word_hashes(data, offsets)[0]
    assert h[0] == h[1] and h[2] != h[3]


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    data, offsets = arrow_text.flat(pa.array(["some words " * 50, None, "more of them, some longerthanapiece"]))
    whole = words.word_hashes(data, offsets)
    monkeypatch.setattr(words, "PIECE", 16)
    parts = words.word_hashes(data, offsets)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_slices_cover_all_rows():
    offsets = np.array([0, 10, 10, 500, 501, 2000])
    found = list(arrow_text.slices(offsets, 100))
    assert [a for a, _ in found] == [0, *[b for _, b in found[:-1]]] and found[-1][1] == 5


def test_sliced_arrow_columns():
    column = pa.array(["aa", None, "bb cc", "dd"])[1:3]
    data, offsets = arrow_text.flat(column)
    assert data.tobytes() == b"bb cc" and offsets.tolist() == [0, 0, 5]


def test_scratch_tables_go_and_kept_ones_stay(spark):
    from tessera.llm.workspace import scratch, written

    with scratch(spark):
        with scratch(spark):
            inner = written(spark.range(3), "inner")
            outer = written(inner.where("id > 0"), "outer", keep=True)
        assert outer.count() == 2 and not inner_is_there(inner)
        result = written(outer.where("id > 1"), "result", keep=True)
    assert result.count() == 1 and not inner_is_there(outer)


def inner_is_there(df):
    import os

    return all(os.path.exists(f.removeprefix("file://")) for f in df.inputFiles())
