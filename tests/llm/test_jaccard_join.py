import random
import re

import pytest

from tessera.llm import jaccard_join
from tessera.llm.components import components

WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), k), k)
    return sorted((k, len(sets[i]), least[find(i)]) for i, (k, _) in enumerate(rows))


def corpus(seed, n=160):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [r.choice(vocabulary) for _ in range(60)]
    bases = [[r.choice(vocabulary) for _ in range(r.choice([3, 8, 40, 120]))] for _ in range(25)]
    rows = []
    for k in range(n):
        words = list(r.choice(bases))
        if r.random() < 0.3:
            words = words + passage
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            at = r.randrange(len(words) + 1)
            words[at : at + r.choice([0, 1])] = [r.choice(vocabulary)] if r.random() < 0.7 else []
        rows.append((1000 - k, " ".join(w.upper() if r.random() < 0.1 else w for w in words)))
    return rows + [(5, None), (6, ""), (7, " \n ")]


@pytest.mark.parametrize("region_points", [4_000, 15, 4])
def test_as_brute_force(documents, region_points, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PIVOTS", 5)
    rows = corpus(3, 160 if region_points > 100 else 110)
    found = jaccard_join.jaccard_components(documents(rows), region_points=region_points)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


@pytest.mark.parametrize("pivots", [2, 8])
def test_templated_texts_take_a_fixed_number_of_rounds(documents, monkeypatch, pivots):
    """Texts of three sentences out of a few: large regions without many links, which no pivot divides well."""
    r = random.Random(8)
    sentences = [[f"s{k}w{i}" for i in range(12)] for k in range(9)]
    rows = [(k, " ".join(w for s in r.sample(sentences, 3) for w in s) + r.choice(["", f" end{k % 50}"])) for k in range(300)]
    calls, divided = [], jaccard_join._divided
    monkeypatch.setattr(jaccard_join, "PIVOTS", pivots)
    monkeypatch.setattr(jaccard_join, "_divided", lambda *a: calls.append(1) or divided(*a))
    found = jaccard_join.jaccard_components(documents(rows), region_points=12)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    assert 0 < len(calls) <= jaccard_join.ROUNDS


def test_cells_hold_every_linked_pair_or_connect_it():
    """Voronoi cells and windows on random sets: each linked pair is linked to one pivot, or meets in a cell or the rest."""
    r = random.Random(2)
    base = [r.sample(range(1000), 60) for _ in range(6)]
    sets = [sorted({x if r.random() > p else r.randrange(1000) for x in r.choice(base)}) for p in (0, 0.03, 0.08, 0.2) for _ in range(40)]
    arrays = [jaccard_join.np.array(x, "u8") for x in sets]
    names = [jaccard_join.set_key(x) for x in arrays]
    rows = {name: (len(x), x.tobytes()) for name, x in zip(names, arrays, strict=True)}
    pivots = set(r.sample(sorted(rows), 6))
    data = [(1, 0, name, n, ids, flag) for name, (n, ids) in rows.items() for flag in ((False, True) if name in pivots else (False,))]
    table = jaccard_join.pa.table(dict(zip(["region", "salt", "set", "n", "ids", "is_pivot"], map(list, zip(*data, strict=True)), strict=True)))
    out = jaccard_join._assign(table).to_pylist()
    cells, of_pivot, home = {}, {}, {}
    for x in out:
        cells.setdefault(x["cell"], set()).add(x["set"])
        if x["linked"]:
            of_pivot.setdefault(x["pivot"], {x["pivot"]}).add(x["set"])
        if x["role"] == jaccard_join.HOME or x["role"] == jaccard_join.BALL:
            home[x["set"]] = x["cell"]
    by_name = {name: set(x) for name, x in zip(names, sets, strict=True)}
    pairs = 0
    for a in by_name:
        for b in by_name:
            shared = len(by_name[a] & by_name[b])
            if a < b and 4 * shared >= 3 * (len(by_name[a]) + len(by_name[b]) - shared):
                pairs += 1
                together = any(a in c and b in c and cell in (home.get(a, 0), home.get(b, 0)) for cell, c in cells.items())
                assert together or any(a in c and b in c for c in of_pivot.values())
    assert pairs > 100 and len(cells) > 3


def test_links_chain_through_texts_that_do_not_link(documents):
    words = [f"v{k}" for k in range(104)]
    rows = []
    for step in range(6):
        rows.append((step, " ".join(words)))
        words[step * 17 : step * 17 + 1] = [f"new{step}", f"more{step}"]
        words[step * 17 + 5] = f"changed{step}"
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(documents(rows)).collect()) == brute(rows)


@pytest.mark.parametrize("shingles", [0.02, 40])
def test_ranges_of_any_width(documents, shingles, monkeypatch):
    monkeypatch.setattr(jaccard_join, "RANGE_SHINGLES", shingles)  # 18 to 24 bits, and some dozens of ranges
    rows = corpus(8, 40)
    assert sorted(tuple(r) for r in jaccard_join.jaccard_components(documents(rows)).collect()) == brute(rows)


def test_edges(edge):
    found = sorted((tuple(r) for r in jaccard_join.jaccard_components(edge).collect()), key=str)
    by_key = {}
    for k, n, c in found:
        by_key.setdefault(k, []).append((n, c))
    assert by_key[1] == by_key[2] or [x[0] for x in by_key[1]] == [0]
    assert by_key[4] == [(1, 4)] and by_key[5] == [(1, 4)]
    assert by_key[6] == [(12, 6)] and by_key[7] == [(12, 6), (12, 6)]
    assert by_key[8] == [(1, 8)] and by_key[None][0][0] == 4
    assert len(found) == 13


def test_empty_table(documents):
    assert jaccard_join.jaccard_components(documents([])).count() == 0


def test_one_per_group_keeps_all_columns_and_one_row(edge):
    kept = jaccard_join.one_per_group(edge)
    assert kept.columns == edge.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert 5 not in ids and 7 not in ids and len(set(ids)) == len(ids) and {1, 2, 3, 4, 6, 8, 9, 10, 12, None} == set(ids)


def test_components_of_a_long_chain(spark):
    n = 40
    order = list(range(n))
    random.Random(1).shuffle(order)
    links = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)] + [(900, 901), (5, 5), (None, 3)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in components(links).collect()}
    assert all(found[k] == 0 for k in range(n)) and found[900] == found[901] == 900


def test_a_large_region_whose_pivots_are_not_within_reach_of_themselves(documents, monkeypatch):
    """80 of 100 shingles are shared: enough to be a point, too few to link to the pivot, even for the pivot itself."""
    tail = lambda k: [f"t{k}_{i}" for i in range(20)]
    common = [f"c{i}" for i in range(84)]
    rows = [(k, " ".join(common + tail(k))) for k in range(18)]
    rows += [(50, " ".join(common + tail(50))), (51, " ".join(common + tail(50) + ["end"]))]
    calls, divided = [], jaccard_join._divided
    monkeypatch.setattr(jaccard_join, "_divided", lambda *a: calls.append(1) or divided(*a))
    found = jaccard_join.jaccard_components(documents(rows), region_points=15)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)
    assert calls


def test_documents_meet_through_texts_without_an_id(documents):
    words = [f"v{k}" for k in range(104)]
    texts = [" ".join(words + [f"{side}{k}" for k in range(n)]) for side, n in (("a", 24), ("a", 0), ("b", 24))]
    for ids in ((1, None, 2), (None, None, 2)):
        rows = list(zip(ids, texts, strict=True)) + [(9, "alone in its group as far as anyone knows"), (None, "no id and alone in its group too")]
        found = sorted((tuple(r) for r in jaccard_join.jaccard_components(documents(rows)).collect()), key=str)
        named = min(k for k in ids if k is not None)
        assert [c for _, n, c in found if n >= 100] == [named] * 3
        assert [c for _, n, c in found if n < 100] == [9, None]


def test_a_repeated_id_joins_no_texts(documents):
    rows = corpus(4, 60)
    rows = [(k % 7 + 1, t) if k > 7 else (k, t) for k, t in rows]
    found = jaccard_join.jaccard_components(documents(rows))
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


def least_of_groups(rows):
    """The key of the row that stays of each group of texts: the least one, nulls last."""
    least = {}
    for i, _, group in brute([(i, t) for i, (_, t) in enumerate(rows)]):
        key = rows[i][0]
        least[group] = min(least.get(group, (True, 0)), (key is None, key or 0))
    return sorted(least.values())


def test_one_per_group_where_ids_are_null(documents):
    rows = [(1, "one two three four five six"), (None, "one two three four five six"), (None, "alone a b c d e f g"), (None, "twice h i j k l"), (None, "twice h i j k l")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.one_per_group(documents([*rows, (None, ""), (None, None)])).collect()]
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], rows[3], (None, ""), (None, None)], key=str)


def test_one_per_group_where_ids_repeat(documents):
    rows = [(7, "one two three four five six"), (7, "quite another text with that same id"), (8, "one two three four five six"), (8, "a third text by itself here"), (7, "one two three four five six")]
    kept = [(r["doc_id"], r["text"]) for r in jaccard_join.one_per_group(documents(rows)).collect()]
    assert sorted(kept) == sorted([rows[0], rows[1], rows[3]])


def test_one_per_group_of_many_null_and_repeated_ids(documents):
    r = random.Random(6)
    rows = [(r.choice([None, k % 9, k]), t) for k, t in corpus(5, 90)]
    kept = [(x["doc_id"] is None, x["doc_id"] or 0) for x in jaccard_join.one_per_group(documents(rows)).collect()]
    assert sorted(kept) == least_of_groups(rows)
