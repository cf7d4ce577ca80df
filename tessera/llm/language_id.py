"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

Each language is the list of its most frequent letter n-grams. A document's own list is compared to each by the
out-of-place distance: the sum of rank differences, a missing n-gram counting as much as the list is long.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import fields, release_memory, table

#: n-grams of 1 to 3 letters with word borders; three 21-bit code points fill one 64-bit code.
PROFILE = 400
#: Labelled documents that a profile is learned from, at most about so many per language, picked by hash.
SAMPLE_PER_LANGUAGE = 2_000
#: Characters taken at once from a long text; counts of all parts are summed.
PART = 1 << 21
#: Stands for everything between words; no letter has this code.
BORDER = 1
UNKNOWN = "und"

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def _part_codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.empty(0, np.int64)
    c = np.full(len(points) + 2, BORDER, np.int64)
    c[1:-1] = np.where(letter, points, BORDER)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != BORDER) | (c[:-1] != BORDER)  # one border between words
    c = c[keep]
    two = c[:-1] << 21 | c[1:]
    three = two[:-1] << 21 | c[2:]
    return np.concatenate([c[c != BORDER], two, three[c[1:-1] != BORDER]])


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(codes ascending, counts) of the whole text."""
    if len(text) <= PART:
        return np.unique(_part_codes(text), return_counts=True)
    codes, counts, at = np.empty(0, np.int64), np.empty(0, np.int64), 0
    while at < len(text):
        stop = min(at + PART, len(text))
        while stop < len(text) and text[stop].isalpha() and text[stop - 1].isalpha():
            stop += 1
        more, n = np.unique(_part_codes(text[at:stop]), return_counts=True)
        codes, place = np.unique(np.concatenate([codes, more]), return_inverse=True)
        counts = np.bincount(place, np.concatenate([counts, n]), len(codes)).astype(np.int64)
        at = stop
    return codes, counts


def ranked(codes: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent codes in order, ties by code."""
    return codes[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Rank-order profiles of some languages in one sorted table."""

    def __init__(self, profiles: dict[str, list[int]], size: int = PROFILE):
        self.languages, self.size = sorted(profiles), size
        self.codes = np.unique(np.array([c for p in profiles.values() for c in p], np.int64))
        self.ranks = np.full((len(self.languages), len(self.codes) + 1), -1, np.int64)
        for k, name in enumerate(self.languages):
            self.ranks[k, np.searchsorted(self.codes, np.array(profiles[name], np.int64))] = np.arange(len(profiles[name]))

    def predict(self, text: str) -> tuple[str, float]:
        """(language, score): 1 less the distance as a share of the greatest possible one; ties go to the first name."""
        codes, counts = ngrams(text)
        if not len(codes) or not self.languages:
            return UNKNOWN, 0.0
        own = ranked(codes, counts, self.size)
        at = np.searchsorted(self.codes, own)
        at[at == len(self.codes)] = 0
        known = self.codes[at] == own if len(self.codes) else np.zeros(len(own), bool)
        theirs = np.where(known, self.ranks[:, at], -1)
        distance = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own)))).sum(axis=1)
        best = int(distance.argmin())
        return self.languages[best], float(1.0 - distance[best] / (self.size * len(own)))


def _crc(key: Column) -> Column:
    """The unsigned crc32 of an id's text, that of an empty one for null."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def held_out(key: Column) -> Column:
    """Documents that nothing is learned from: crc32 of the id's text mod 4 is 2."""
    return F.coalesce(_crc(key) % 4 == 2, F.lit(False))


def learn(
    documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", size: int = PROFILE, sample: int = SAMPLE_PER_LANGUAGE
) -> Profiles:
    """Profiles from labelled rows that aren't held out: all of them, or about ``sample`` per language, by the upper bits
    of their ids' crc32.

    Counting is by language and n-gram with sums before the shuffle; the driver gets ``size`` n-grams a language.
    """
    rows = fields(documents, key=key, text=text, lang=lang)
    usable = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("key")) & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1.0)
    for name, n in counts.items():
        if n > sample:
            share = F.when(F.col("lang") == name, F.lit(sample / n)).otherwise(share)
    chosen = usable.where(F.shiftright(_crc(F.col("key")), 12) < share * (1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column(0).to_pylist(), np.array(batch.column(1).to_pylist(), object)
            for name in sorted(set(names)):
                found = [ngrams(texts[k]) for k in np.flatnonzero(names == name)]
                codes, place = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(place, np.concatenate([n for _, n in found]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes)), pa.array(codes), pa.array(n)], names=["lang", "code", "n"])

    from pyspark.sql import Window as W

    grams = chosen.select("text", "lang").mapInArrow(run, "lang string, code bigint, n bigint")
    summed = grams.groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "code"))
    top = summed.withColumn("place", place).where(F.col("place") <= size).collect()
    found: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["place"])):
        found.setdefault(r["lang"], []).append(r["code"])
    return Profiles(found, size)


def predict(documents: DataFrame, profiles: Profiles, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, held_out, lang_pred, score (0 to 1). Only the text is looked at.

    A null text, or one without letters, is ``und`` with score 0, as is every text when no language was learned. Of
    languages at the same distance the first by name wins. Long texts are counted whole, in parts whose counts are
    summed; repeated rows are told one by one. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t or "") for t in batch.column(1).to_pylist()]
            arrays = [batch.column(0), batch.column(2), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "held_out", "lang_pred", "score"])

    rows = fields(documents, key=key, text=text).withColumn("held_out", held_out(F.col("key")))
    kind = documents.schema[key].dataType.simpleString()
    out = rows.mapInArrow(run, f"key {kind}, held_out boolean, lang_pred string, score double")
    return out.withColumnRenamed("key", key)


#: Texts that resemble no learned language this much are rejected by ``in_known_language``. Of held-out labelled documents
#: the lowest score is 0.47, cut to their first word 0.33; random letters and unlearned Latin-script languages stay below 0.3.
LEAST_SCORE = 0.3


def in_known_language(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = LEAST_SCORE) -> DataFrame:
    """The rows whose text is in a learned language: not ``und`` and with a score of at least ``least``.

    Where no row has a language to learn from, every text with letters stays. All columns are kept as they are, whatever their names; the profiles are learned from the rows themselves.
    """
    profiles = learn(documents, key, text, lang)
    schema, at = documents.schema, documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            if profiles.languages:
                kept = [name != UNKNOWN and score >= least for name, score in map(profiles.predict, texts)]
            else:
                kept = [len(ngrams(t)[0]) > 0 for t in texts]
            yield batch.filter(pa.array(kept, pa.bool_()))
        release_memory()

    return documents.mapInArrow(run, schema)


def crc_is_held_out(key: object) -> bool:
    """``held_out`` for one id, for tests."""
    return key is not None and zlib.crc32(str(key).encode()) % 4 == 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return predict(documents, learn(documents))


OP4_SQL = f"""
WITH d AS (SELECT doc_id, lang, text, row_number() OVER () AS row, list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda x: coalesce(nullif(ord(x), -1), 0)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS c FROM documents),
k AS (SELECT doc_id, lang, text, row, xor(c, 4294967295::BIGINT) AS crc FROM d),
u AS (SELECT *, least(1::DOUBLE, {SAMPLE_PER_LANGUAGE} / count(*) OVER (PARTITION BY lang)::DOUBLE) AS share FROM k
  WHERE lang IS NOT NULL AND text IS NOT NULL AND crc % 4 <> 2),
w AS (SELECT row, chr(1) || trim(regexp_replace(lower(text), '[^\\p{{L}}]+', chr(1), 'g'), chr(1)) || chr(1) AS t FROM k WHERE text IS NOT NULL),
x AS (SELECT row, t, unnest(range(1, length(t) + 1)) AS i FROM w WHERE length(t) > 2),
g AS (SELECT row, unnest([CASE WHEN substr(t, i, 1) <> chr(1) THEN substr(t, i, 1) END, CASE WHEN i < length(t) THEN substr(t, i, 2) END,
  CASE WHEN i < length(t) - 1 AND substr(t, i + 1, 1) <> chr(1) THEN substr(t, i, 3) END]) AS g FROM x),
n AS (SELECT row, g, count(*) AS n FROM g WHERE g IS NOT NULL GROUP BY ALL),
o AS (SELECT row, g, row_number() OVER (PARTITION BY row ORDER BY n DESC, length(g), g) - 1 AS r FROM n QUALIFY r < {PROFILE}),
p AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, length(g), g) - 1 AS r
  FROM u JOIN n USING (row) WHERE u.crc >> 12 < share * 1048576 GROUP BY lang, g QUALIFY r < {PROFILE}),
s AS (SELECT row, lang, sum(CASE WHEN p.r IS NULL THEN {PROFILE} ELSE abs(p.r - o.r) END)::BIGINT AS d, count(*) AS m
  FROM (SELECT * FROM o, (SELECT DISTINCT lang FROM p)) o LEFT JOIN p USING (lang, g) GROUP BY ALL),
b AS (SELECT row, lang, 1::DOUBLE - d::DOUBLE / ({PROFILE} * m)::DOUBLE AS score FROM s QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, lang) = 1)
SELECT k.doc_id, k.crc % 4 = 2 AS held_out, coalesce(b.lang, '{UNKNOWN}') AS lang_pred, coalesce(b.score, 0::DOUBLE) AS score FROM k LEFT JOIN b USING (row)
"""
