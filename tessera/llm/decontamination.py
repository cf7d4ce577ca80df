"""Benchmark decontamination by size-partitioned MinHash containment search.

DataFrame functions only. Test items are partitioned into classes by their number of shingles, doubling from class
to class. Of an item with n shingles the sketch is its k smallest shingle hashes, where k = n - ceil(t * n) + 1 for
the largest n of the class: if a document holds a share t of the item, at least one sketch hash is in the document,
however long the document is. The search joins documents with sketches alone; what it hits are candidates, pairs of a
document and an item. Only the candidates' texts are looked at again, and a candidate counts if the item's whole
shingle set is contained to the share t.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import workspace
from .workspace import fields, table, without, written

SHINGLE, SHARE = 5, (3, 4)
#: Parts that a shingle's rows are spread over where a table of item shingles is too large for a broadcast.
SALTS = 16


def words(text: Column) -> Column:
    """Lower-cased words between runs of the bytes 0x20 and 0x09-0x0D; null for a null text."""
    return F.split(F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r")), "[ \t-\r]+")


def shingle_hashes(rows: DataFrame, size: int, keep: list[str]) -> DataFrame:
    """Rows (keep..., text) -> (keep..., hash), one per shingle. A text of fewer words is one shingle; none if empty."""
    w = F.col("words")
    at = F.sequence(F.lit(1), F.size(w) - (size - 1))
    some = F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + (k - 1)) for k in range(size)]))
    hashes = F.when(F.size(w) >= size, some).when(F.element_at(w, 1) != "", F.array(F.xxhash64(F.array_join(w, " "), F.size(w))))
    return rows.select(*keep, words(F.col("text")).alias("words")).select(*keep, F.explode(hashes).alias("hash"))


def item_sketches(items: DataFrame, size: int, share: tuple[int, int]) -> DataFrame:
    """(item, hash, n_item, size_class, in_sketch) for the distinct shingles of (item, text) rows; a class holds the
    items with 2^c to 2^(c+1) - 1 shingles, and all its items have the same k."""
    up, down = share
    shingles = shingle_hashes(items, size, ["item"]).distinct()
    counted = shingles.withColumn("n_item", F.count("*").over(W.partitionBy("item")))
    counted = counted.withColumn("size_class", F.floor(F.log2("n_item")).cast("int"))
    largest = F.pow(F.lit(2.0), F.col("size_class") + 1).cast("bigint") - 1
    k = largest - F.ceil(largest * up / down) + 1
    place = F.row_number().over(W.partitionBy("item").orderBy("hash"))
    return counted.select("item", "hash", "n_item", "size_class", (place <= k).alias("in_sketch"))


def _on_hash(shingles: DataFrame, items: DataFrame, spread: str) -> DataFrame:
    """Document shingles and item shingles that are equal. Items are broadcast where their bytes allow it; else both
    sides are shuffled, and the rows of a common shingle are dealt to several tasks by ``spread``."""
    if workspace.small(items):
        return shingles.join(F.broadcast(items), "hash")
    salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return shingles.withColumn("salt", F.pmod(F.col(spread), F.lit(SALTS)).cast("int")).join(salted, ["hash", "salt"]).drop("salt")


def contained_items(
    documents: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    item: str = "item_id",
    text: str = "text",
    size: int = SHINGLE,
    share: tuple[int, int] = SHARE,
) -> DataFrame:
    """One row per document row and item with shared * down >= n_item * up: key, item, n_shared, n_item, containment.

    ``share`` is (up, down), 3/4 by default. Null and empty texts and items match nothing; an item of fewer words
    than ``size`` is found in texts that are the same words. Repeated documents are told one by one; a repeated item
    id stands for all its texts together. Shingles are compared by 64-bit hashes. Texts are read twice, the second time
    only candidates are cut into shingles; they move only if there are too many candidates for a broadcast.
    """
    up, down = share
    items = written(item_sketches(fields(benchmark, item=item, text=text), size, share), "item_shingles")
    # rows are known by a hash of key and text: equal rows are the same candidate, and verified one by one
    rows = fields(documents, key=key, text=text).withColumn("mark", F.xxhash64("key", "text"))
    sketches = items.where("in_sketch").select("hash", "item")
    pairs = _on_hash(shingle_hashes(rows, size, ["mark"]), sketches, "mark").select("mark", "item").distinct()
    pairs = written(pairs, "candidates")
    found = written(pairs.groupBy("mark").agg(F.collect_set("item").alias("items")), "candidate_documents")
    found = F.broadcast(found) if workspace.small(pairs) else found
    kept = rows.join(found, "mark").withColumn("row", F.monotonically_increasing_id())
    hits = _on_hash(shingle_hashes(kept, size, ["row", "key", "items"]), items.select("hash", "item", "n_item"), "row")
    hits = hits.where(F.array_contains("items", F.col("item")))
    counted = hits.groupBy("row", "key", "item", "n_item").agg(F.size(F.collect_set("hash")).cast("bigint").alias("n_shared"))
    return counted.where(F.col("n_shared") * down >= F.col("n_item") * up).select(
        F.col("key").alias(key), F.col("item").alias(item), "n_shared", "n_item", (F.col("n_shared") / F.col("n_item")).alias("containment")
    )


def decontaminated(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The rows of documents whose id has no contained item; rows with a null id are judged by their id too."""
    return without(documents, key, contained_items(documents, benchmark, key, **options).select(key))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_DUCK_SHINGLES = """
SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3),
  lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END) AS s
FROM (SELECT {key}, list_filter(string_split_regex(lower(text), '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM {table}
  WHERE text IS NOT NULL)"""

OP2_SQL = f"""
WITH d AS ({_DUCK_SHINGLES.format(key="doc_id", table="documents")}),
b AS ({_DUCK_SHINGLES.format(key="item_id", table="benchmark")}),
n AS (SELECT item_id, count(*) AS n_item FROM b GROUP BY item_id),
h AS (SELECT d.doc_id, b.item_id, count(*) AS n_shared FROM d JOIN b USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM h JOIN n USING (item_id)
WHERE n_shared * 4 >= n_item * 3
"""
