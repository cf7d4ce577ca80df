import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from llm_rows import EDGE
from pyspark.sql import functions as F

from tessera.llm import decontamination, language_id, quality, sharding, workspace
from tessera.llm.arrow_text import flat

WORD = re.compile("[^\x20\x09-\x0d]+")


# ---------------------------------------------------------------- sharding


def jump(key, shards):
    """The published algorithm with Python's integers."""
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_hash_as_published():
    keys = np.array([0, 1, -1, 7, 2**62, -(2**63), *range(100, 400)], np.int64)
    for n in (1, 2, 16, 17, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


@pytest.mark.parametrize("rows_per_block", [20_000, 1])
def test_shards(edge, rows_per_block):
    rows = sharding.shard_rows(edge, n_shards=4, rows_per_block=rows_per_block).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (k, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for k, t in EDGE
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        assert r["law"] == "key" and r["shard"] == jump(r["doc_id"] or 0, 4)
        assert r["grown_shard"] in (r["shard"], 4)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_rows(edge.limit(0)).count() == 0


def test_text_keys_have_shards(spark):
    df = spark.createDataFrame([("a", "x"), ("b", None), (None, "y")], "doc_id string, text string")
    assert sharding.shard_rows(df).count() == 3


# ---------------------------------------------------------------- decontamination


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_contained_items_as_brute_force(spark, documents, monkeypatch, broadcast):
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", broadcast)
    r = random.Random(11)
    word = lambda: f"w{r.randrange(60)}"
    items = [(k, " ".join(word() for _ in range(r.choice([3, 5, 9, 20, 41])))) for k in range(12)] + [(50, None), (51, ""), (3, "one more text of item three")]
    docs = [(k, t) for k, t in EDGE if k != 7]
    for k in range(100, 160):
        words = [word() for _ in range(r.choice([2, 40, 400]))]
        for _ in range(r.choice([0, 1, 2])):
            item = (items[r.randrange(12)][1] or "").split()
            if r.random() < 0.6 and item:
                item[r.randrange(len(item))] = "changed"
            at = r.randrange(len(words) + 1)
            words[at:at] = item
        docs.append((k, " ".join(words)))
    by_item = defaultdict(set)
    for k, t in items:
        by_item[k] |= shingles(t)
    want = set()
    for k, t in docs:
        own = shingles(t)
        for item, s in by_item.items():
            if s and 4 * len(s & own) >= 3 * len(s):
                want.add((k, item, len(s & own), len(s)))
    table = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.contained_items(documents(docs), table)
    assert {tuple(x)[:4] for x in found.collect()} == want and len(want) > 20
    kept = decontamination.decontaminated(documents(docs), table)
    assert sorted((x["doc_id"] for x in kept.collect()), key=str) == sorted((k for k, _ in docs if k not in {w[0] for w in want}), key=str)


def test_decontamination_without_rows(spark, edge):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contained_items(edge, none).count() == 0
    assert decontamination.decontaminated(edge, none).count() == len(EDGE)
    item = spark.createDataFrame([(1, "a document without an id but with words")], "item_id bigint, text string")
    left = decontamination.decontaminated(edge, item)
    assert left.count() == len(EDGE) - 1 and left.columns == edge.columns
    assert decontamination.contained_items(edge.limit(0), item).count() == 0


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_a_common_shingle_and_repeated_rows(spark, documents, monkeypatch, broadcast):
    """Every document has the shingles that many items begin with; rows that repeat are told one by one."""
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", broadcast)
    common = "these are the words that all of them begin with"
    items = [(k, f"{common} and item {k} ends so {k} here") for k in range(30)]
    docs = [(k, f"{common} but say number {k} " * 3) for k in range(300)] + [(500, "x " + items[7][1])] * 3 + [(None, items[9][1])] * 2
    found = decontamination.contained_items(documents(docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    got = sorted((r["doc_id"] or 0, r["item_id"]) for r in found if r["containment"] == 1)
    assert got == [(0, 9), (0, 9), (500, 7), (500, 7), (500, 7)]


def test_sketches_alone_are_searched(spark, documents):
    """The first join of the plan has sketch hashes only: a quarter of an item's shingles, about."""
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(44))) for k in range(5)], "item bigint, text string")
    found = decontamination.item_sketches(items, 5, (3, 4)).collect()
    assert {r["n_item"] for r in found} == {40} and {r["size_class"] for r in found} == {5}
    for k in range(5):
        own = sorted(r["hash"] for r in found if r["item"] == k)
        assert sorted(r["hash"] for r in found if r["item"] == k and r["in_sketch"]) == own[: 63 - 48 + 1]


@pytest.mark.parametrize("bound", [32 << 20, 0])
def test_without_treats_null_as_equal(spark, monkeypatch, bound):
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", bound)
    df = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k bigint, gone string")
    gone = spark.createDataFrame([(None,), (2,)], "k bigint")
    assert [tuple(r) for r in workspace.without(df, "k", gone).collect()] == [(1, "a")]


# ---------------------------------------------------------------- language


def brute_ngrams(text):
    letters = "".join(c if c.isalpha() else "\1" for c in text.lower())
    letters = re.sub("\1+", "\1", f"\1{letters}\1")
    found = Counter()
    for n in (1, 2, 3):
        for i in range(len(letters) - n + 1):
            g = letters[i : i + n]
            if (n == 3 and g[1] == "\1") or g.strip("\1") == "":
                continue
            found[g] += 1
    return found


@pytest.mark.parametrize("text", ["", "12 3!", "Aa bÉ\n\nbÉ a", "straße 日本 日本 x1y", "é" * 50])
def test_ngrams_as_brute_force(text, monkeypatch):
    code = lambda g: sum(ord(c) << 21 * k for k, c in enumerate(reversed(g)))
    want = {code(g): n for g, n in brute_ngrams(text).items()}
    codes, counts = language_id.ngrams(text)
    got = dict(zip(codes.tolist(), counts.tolist(), strict=True))
    assert got == want
    monkeypatch.setattr(language_id, "PART", 3)
    parts = language_id.ngrams(text + " tail of the text")
    monkeypatch.undo()
    whole = language_id.ngrams(text + " tail of the text")
    assert parts[0].tolist() == whole[0].tolist() and parts[1].tolist() == whole[1].tolist()


SENTENCES = {
    "aa": ["the cat and the hat of them", "that thing there with the others", "then they went to the north"],
    "bb": ["el gato y la casa de ellos", "una cosa con los otros que", "las dos mesas en el norte"],
}


def test_languages_are_learned_and_held_out(spark):
    r = random.Random(2)
    rows = [(k, " ".join(r.choice(SENTENCES[lang]) for _ in range(3)), lang) for k in range(300) for lang in ("aa", "bb")]
    rows = [(2 * k + (lang == "bb"), t, lang) for k, t, lang in rows] + [(9001, None, "aa"), (9002, "1234", "bb"), (9003, "la casa", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language_id.predict(df, language_id.learn(df, sample=50))
    got = {x["doc_id"]: x for x in found.collect()}
    for k, _, lang in rows[:600]:
        assert got[k]["lang_pred"] == lang and 0 < got[k]["score"] <= 1
        assert got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) == language_id.crc_is_held_out(k)
    assert (got[9001]["lang_pred"], got[9001]["score"]) == ("und", 0.0) and got[9002]["lang_pred"] == "und" and got[9003]["lang_pred"] == "bb"


def test_held_out_rows_teach_nothing(spark):
    k = next(i for i in range(100) if language_id.crc_is_held_out(i))
    df = spark.createDataFrame([(k, "some letters", "aa")], "doc_id bigint, text string, lang string")
    assert language_id.learn(df).languages == []
    assert [tuple(r) for r in language_id.predict(df, language_id.learn(df)).collect()] == [(k, True, "und", 0.0)]


def test_language_edges(edge):
    found = language_id.predict(edge, language_id.learn(edge))
    assert found.count() == len(EDGE) and found.where("score < 0 or score > 1").count() == 0
    kept = language_id.in_known_language(edge)
    assert kept.columns == edge.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 4, 5, 6, 7, 7, 8, 9, 10, 12]
    none = edge.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] or 0 for r in language_id.in_known_language(none).collect()) == [0, 4, 5, 6, 7, 7, 8, 9, 10, 12]
    assert language_id.predict(edge.limit(0), language_id.learn(edge.limit(0))).count() == 0


def test_the_profile_distance_as_brute_force():
    texts = {"aa": " ".join(SENTENCES["aa"]), "bb": " ".join(SENTENCES["bb"])}
    profiles = {k: language_id.ranked(*language_id.ngrams(t), 30).tolist() for k, t in texts.items()}
    tool = language_id.Profiles(profiles, 30)
    for text in ("the casa of cat", "zzz", "norte norte the"):
        own = language_id.ranked(*language_id.ngrams(text), 30).tolist()
        cost = {k: sum(abs(p.index(c) - i) if c in p else 30 for i, c in enumerate(own)) for k, p in profiles.items()}
        best = min(sorted(cost), key=cost.get)
        assert tool.predict(text) == (best, pytest.approx(1 - cost[best] / (30 * len(own))))


# ---------------------------------------------------------------- quality


def brute_counts(text):
    text = text or ""
    w = WORD.findall(text)
    runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return [len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)]


def random_texts():
    r = random.Random(4)
    parts = ["a", "b b", "Çé", "\n", "\n\n", " ", "\t", "x|y", "same line\n", "1 2 3 4 5 6 ", "END!!", "***"]
    return ["".join(r.choice(parts) + r.choice(["", " "]) for _ in range(r.randrange(60))) for _ in range(200)]


@pytest.mark.parametrize("piece", [8, 64, 1 << 30])
def test_base_counts_as_brute_force(piece):
    texts = random_texts() + [t for _, t in EDGE]
    found = quality.analyse(*flat(pa.array(texts, pa.string())))
    assert found.counts.tolist() == [brute_counts(t) for t in texts]
    for t in texts[:80]:
        assert quality.analyse(*flat(pa.array([t], pa.string())), piece).counts.tolist() == [brute_counts(t)]


def brute_lines(text):
    """(word characters, features) of each line with a word, from its characters."""
    lines = [t for t in text.split("\n") if WORD.search(t)]
    total = sum(len(w) for w in WORD.findall(text))
    out = []
    for k, line in enumerate(lines):
        w = WORD.findall(line)
        n, chars = len(w), sum(map(len, w))
        upper = sum("A" <= c <= "Z" or "\xc0" <= c <= "\xde" for c in line)
        letters = max(1, sum("A" <= c <= "Z" or "a" <= c <= "z" or ord(c) > 127 for c in line))
        symbols, ends = sum(c in "#*$%&|<>" for c in line), sum(x[-1] in ".!?:;" for x in w)
        again = sum(a == b for a, b in zip(w, w[1:], strict=False))
        sentence, share, digits = n / (ends + 1), chars / total, sum(c in "0123456789" for c in line)
        x = [True, n <= 2, 2 < n <= 5, 5 < n <= 10, n > 10, upper / letters > 0.2, upper / letters > 0.5, upper / letters > 0.8]
        x += [symbols / n > 0.1, symbols / n > 0.5, line.count("|") / n > 0.2, line.count("!") / n > 0.2, line.count("!") / n > 0.6]
        x += [again / n > 0.1, again / n > 0.4, ends == 0, ends / n > 0.4, sentence > 25, sentence > 60, digits / chars > 0.2, chars / n > 9, chars / n < 3]
        x += [line in lines[:k], k == 0, k == len(lines) - 1, w[-1][-1] not in ".!?:;", share >= 0.5, share >= 0.2, share < 0.05, share < 0.01]
        out.append((chars, x))
    return out


@pytest.mark.parametrize("piece", [8, 64, 1 << 30])
def test_lines_as_brute_force_wherever_pieces_end(piece):
    for t in [*random_texts(), "one line " * 50 + "\n" + "same same\n" * 30 + "one line " * 50, *[t for _, t in EDGE if t and len(t) < 20_000]]:
        found = quality.analyse(*flat(pa.array([t], pa.string())), piece)
        want = brute_lines(t)
        assert found.chars.tolist() == [c for c, _ in want]
        assert found.features.tolist() == [x for _, x in want]


def brute_kept(text, field):
    """The verdict on a whole text, by features from characters and a search over both labels of each line."""
    counts = brute_counts(text)
    if counts[0] < 10 or 100 * counts[4] > 20 * counts[0]:
        return False
    lines = brute_lines(text)
    ways = {y: (y * np.dot(lines[0][1], field.weights), [y]) for y in (0, 1)}
    for _, x in lines[1:]:
        e = np.dot(x, field.weights)
        ways = {y: max((s + field.moves[z, y] + y * e, [*way, y]) for z, (s, way) in ways.items()) for y in (0, 1)}
    best = max(ways.values())[1]
    return sum(c * y for (c, _), y in zip(lines, best, strict=True)) >= 0.5 * sum(c for c, _ in lines)


@pytest.mark.parametrize("piece", [64, 1 << 30])
def test_verdicts_as_brute_force(spark, monkeypatch, piece):
    """Documents of good and bad lines in all shares, trained and judged whatever the size of pieces."""
    r = random.Random(5)
    good = lambda: " ".join(r.choice("river stone quiet garden letter window house over under".split()) for _ in range(r.randrange(8, 16))).capitalize() + "."
    bad = lambda: " | ".join(r.choice("home login cart help".split()) + str(r.randrange(99)) for _ in range(r.randrange(6, 12)))
    common = ["Read more of this.", "All rights reserved by the owners of this site.", "Follow us today!"]
    rows, labels = [], []
    for k in range(200):
        share = r.choice([0, 0, 0.4, 0.7, 1, 1, 1])
        lines = [(good if r.random() < share else bad)() for _ in range(r.randrange(3, 9))] + r.sample(common, r.randrange(3))
        r.shuffle(lines)
        rows.append((k, "\n".join(lines)))
        if share in (0, 1):
            labels.append((k, int(share), 0))
    rows += [(1000, "\n".join(good() for _ in range(3000))), (1001, (bad() + "\n") * 2 + " ".join(good() for _ in range(3000))), (1002, rows[0][1]), (1002, rows[0][1])]
    docs, table = spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame([*labels, (labels[0][0], 0, 0)], "doc_id bigint, quality int, toxic int")
    monkeypatch.setattr(quality, "PIECE", piece)
    field = quality.train(docs, table)
    found = quality.quality(docs, field).collect()
    assert Counter((x["doc_id"], x["kept"]) for x in found) == Counter((k, brute_kept(t, field)) for k, t in rows)
    assert len({round(x["content_share"], 2) for x in found} - {0, 1}) > 20  # lines are told apart, not documents
    same = quality.train(docs.repartition(3), table.unionByName(table).orderBy("quality"))
    assert (same.weights == field.weights).all() and (same.moves == field.moves).all()


def test_what_makes_a_line_common():
    hashes = np.array([1, 2, 1, 3, 1, 4, 1, 5, 9, 9, 9], np.uint64)
    owner = np.array([0, 0, 1, 1, 2, 2, 3, 3, 4, 5, 6])
    chars = np.array([5, 90, 5, 90, 5, 90, 5, 90, 30, 30, 30])
    found = quality.line_labels(hashes, owner, chars, np.array([1, 1, 0, 0, 1, 1, 0]))
    assert found.tolist() == [0, 1, 0, 1, 0, quality.HIDDEN, 0, quality.HIDDEN, 1, 1, quality.HIDDEN]  # copies alone aren't common


def test_viterbi_and_marginals_as_by_enumeration():
    r = np.random.default_rng(0)
    field = quality.LineField(r.normal(size=quality.N_FEATURES), r.normal(size=(2, 2)))
    sizes = [1, 4, 2, 5]
    owner = np.repeat(np.arange(4), sizes)
    x = r.integers(0, 2, (len(owner), quality.N_FEATURES))
    labels = field.decode(x, owner)
    e = x @ field.weights
    first, n = field._ragged(owner)
    p, _ = field._marginals(field._chances(e), field.moves, first, n)
    at = 0
    for size in sizes:
        scores = {}
        for way in range(1 << size):
            y = [way >> k & 1 for k in range(size)]
            scores[tuple(y)] = sum(e[at + k] * y[k] for k in range(size)) + sum(field.moves[y[k], y[k + 1]] for k in range(size - 1))
        assert tuple(labels[at : at + size]) == max(scores, key=scores.get)
        total = sum(np.exp(s) for s in scores.values())
        for k in range(size):
            assert p[at + k] == pytest.approx(sum(np.exp(s) for y, s in scores.items() if y[k]) / total)
        at += size


def test_trained_field_tells_boilerplate(spark):
    r = random.Random(9)
    good = lambda: " ".join(r.choice("river stone quiet garden letter window".split()) for _ in range(12)).capitalize() + "."
    bad = lambda: " | ".join(r.choice("home login cart help".split()) for _ in range(8))
    rows = [(k, "\n".join((good if k % 2 else bad)() + f" {k}" for _ in range(4))) for k in range(80)]
    docs = spark.createDataFrame(rows + [(900, None), (901, "too short")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(60)] + [(61, None, 0), (1, 1, 0)], "doc_id bigint, quality int, toxic int")
    field = quality.train(docs, labels)
    found = {x["doc_id"]: x for x in quality.quality(docs, field).collect()}
    assert all(found[k]["kept"] == bool(k % 2) for k in range(60, 80))
    assert found[900]["base_failed"] and not found[900]["kept"] and found[901]["n_words"] == 2
    kept = quality.keep_good(docs, field)
    assert kept.columns == docs.columns and sorted(x["doc_id"] for x in kept.collect()) == list(range(1, 80, 2))


def test_quality_without_labels(spark, edge):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    field = quality.train(edge, labels)
    found = quality.quality(edge, field)
    assert Counter((r["doc_id"], r["n_words"], r["n_dup_lines"]) for r in found.collect()) == Counter((k, brute_counts(t)[0], brute_counts(t)[3]) for k, t in EDGE)
    assert quality.quality(edge.limit(0), field).count() == 0


def test_texts_in_no_learned_language_are_rejected(documents):
    r = random.Random(2)
    english = "the people of this town were all born free and equal in dignity and rights they have reason and should act towards one another in that spirit".split()
    known = {k: " ".join(r.choice(english) for _ in range(30)) for k in range(60)}
    known[60] = "the"
    noise = " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(2, 10))) for _ in range(300))
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto."
    rows = documents([*known.items(), (100, noise), (101, finnish), (102, "Все люди рождаются свободными"), (103, "12 34")])
    rows = rows.withColumn("lang", F.when(F.col("doc_id") < 60, "en"))
    assert {x["doc_id"] for x in language_id.in_known_language(rows).collect()} == set(known)
