import random
import re
from collections import Counter

import corpus_pipeline
from test_documents import brute_kept
from test_jaccard_join import brute, shingles
from tokenizers import Tokenizer

from tessera.llm import language_id, quality, registry, token_ids


def test_stages_one_by_one(spark, tmp_path):
    """A small corpus on which every stage's decisions are known beforehand."""
    r = random.Random(3)
    vocabulary = "river stone quiet garden letter window morning table winter forest".split()
    sentence = lambda n: " ".join(r.choice(vocabulary) + str(r.randrange(50)).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(n)).capitalize() + "."
    clean = {k: "\n".join(sentence(12) for _ in range(5)) for k in range(40)}
    copies = {100: clean[3], 101: clean[3] + " end", 102: clean[7]}
    junk = {200: "***free|***now|*** " * 30, 201: "buy " * 80, 202: "1234 5678 " * 20, 203: None, 204: ""}
    item = sentence(20)
    leaks = {300: clean[11] + "\n" + item}
    clean.pop(11)
    rows = [(k, t, "en", "s", len(t or "")) for part in (clean, copies, junk, leaks) for k, t in part.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, sentence(30))], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(k, int(k < 100), 0) for k in (*list(clean)[:20], 200, 201)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda df: sorted(x["doc_id"] for x in df.collect())
    expected = {"language_id": {202, 203, 204}, "quality_rules": {200, 201}, "jaccard_join": {100, 101, 102}, "decontamination": {300}}
    left = set(ids(docs))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left -= expected[name]
        assert set(ids(docs)) == left, name
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"] for p in pieces} == left == set(clean)


def test_stages_without_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registry_names():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{k}" for k in range(1, 11)]


def brute_language(rows):
    """(texts' best score by profile distances, from n-grams of characters) of (id, text, lang) rows."""

    def grams(text):
        t = "\1" + re.sub(r"[^\W\d_]+|(.)", lambda m: "\1" if m[1] else m[0], (text or "").lower(), flags=re.S) + "\1"
        t = re.sub("\1+", "\1", t)
        found = Counter(c for c in t if c != "\1")
        found.update(t[i : i + 2] for i in range(len(t) - 1))
        found.update(t[i : i + 3] for i in range(len(t) - 2) if t[i + 1] != "\1")
        return found if len(t) > 2 else Counter()

    top = lambda n: [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], len(x[0]), x[0]))[:400]]
    sums = {}
    for k, t, lang in rows:
        if t is not None and lang is not None and not language_id.crc_is_held_out(k):
            sums.setdefault(lang, Counter()).update(grams(t))
    profiles = [{g: r for r, g in enumerate(top(n))} for n in sums.values()]
    scores = {}
    for k, t, _ in rows:
        own = top(grams(t))
        cost = [sum(abs(p[g] - r) if g in p else 400 for r, g in enumerate(own)) for p in profiles]
        scores[k] = 1 - min(cost) / (400 * len(own)) if own and cost else 0
    return scores


def test_the_pipeline_as_by_brute_force(spark, tmp_path):
    """A corpus of clean, mixed, junk, foreign, copied and leaking texts, stage by stage by plain means, and the ids packed."""
    r = random.Random(21)
    vocabulary = "the river of stone and a quiet garden with letters in the window of this morning house over under winter".split()
    word = lambda: r.choice(vocabulary) + r.choice(["", "", "s", "ing", "ed"])
    sentence = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    junk = lambda: " | ".join(r.choice("home login cart help".split()) + str(r.randrange(99)) for _ in range(9))
    item = " ".join(word() + str(k) for k in range(25))
    texts, quality_of = {}, {}
    for k in range(150):
        share = r.choice([0, 0.5, 1, 1, 1])
        texts[k] = "\n".join(sentence(r.randrange(8, 18)) if r.random() < share else junk() for _ in range(r.randrange(3, 8)))
        if share != 0.5 and k % 3:
            quality_of[k] = int(share)
        if k % 17 == 5:
            texts[k] += "\n" + " ".join(item.split()[r.randrange(9) :])
    for k in range(150, 190):  # copies, near and exact
        words = texts[k - 150 - k % 7 if k % 7 <= k - 150 else 0].split(" ")
        for _ in range(k % 3):
            words[r.randrange(len(words))] = "changed"
        texts[k] = " ".join(words)
    texts |= {190: None, 191: "", 192: "12 34", 193: "Все люди рождаются свободными и равными в своем достоинстве и правах, они наделены", 194: "too short"}
    rows = [(k, t, "en" if k < 150 else None, "s", len(t or "")) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(k, q, 0) for k, q in quality_of.items()], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, stages = spark.read.parquet(f"{tmp_path}/documents.parquet"), dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(x["doc_id"] for x in df.collect())
    left = dict(texts)

    scores = brute_language([(k, t, lang) for k, t, lang, *_ in rows])
    left = {k: t for k, t in left.items() if scores[k] >= language_id.LEAST_SCORE}
    docs = stages["language_id"](spark, docs, str(tmp_path))
    assert ids(docs) == sorted(left) and 193 not in left and len(left) > 180

    field = quality.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    left = {k: t for k, t in left.items() if brute_kept(t, field)}
    docs = stages["quality_rules"](spark, docs, str(tmp_path))
    assert ids(docs) == sorted(left) and 80 < len(left) < 180

    left = {k: t for k, t in left.items() if (k, k) in {(a, c) for a, _, c in brute(list(left.items()))}}
    docs = stages["jaccard_join"](spark, docs, str(tmp_path))
    assert ids(docs) == sorted(left)

    found = shingles(item)
    left = {k: t for k, t in left.items() if 4 * len(found & shingles(t)) < 3 * len(found)}
    docs = stages["decontamination"](spark, docs, str(tmp_path))
    assert ids(docs) == sorted(left)

    library = Tokenizer.from_file(token_ids.vocabulary("word_bpe_49k.json"))
    lengths = {k: len(library.encode(t, add_special_tokens=False).ids) + 1 for k, t in left.items()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p["doc_id"]: p["doc_tokens"] for p in pieces} == lengths
    assert sum(p["length"] for p in pieces) == sum(lengths.values()) and all(p["offset"] + p["length"] <= 2048 for p in pieces)
