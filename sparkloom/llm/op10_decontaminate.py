"""Benchmark decontamination: size-partitioned MinHash containment search, DataFrame functions only.

An item is contained in a document when at least `threshold` of the item's distinct word
shingles occur in the document. Items are partitioned by the power of two of their shingle
count n. An item's MinHash sketch is its k smallest shingle hashes, where k is one more
than the shingles an item of that partition may lack at the threshold; so a document that
contains the item shares at least one sketch value (pigeonhole), wherever in a long
document the item stands. Shared values give candidates; each is verified by exact
containment on the full sets.

Defined cases: null or blank texts have no shingles and match nothing; an item or a document of
fewer than five words has one shingle, its whole sequence; repeated (document, item) rows
give one result row with the larger containment; a null item_id or doc_id is a value like any
other; extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import bounded, fresh, stored, table

SHINGLE_WORDS = 5
THRESHOLD = 0.75
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` with A-Z in lower case."""
    ascii_lower = F.when(text.rlike("[A-Z]"), F.translate(text, UPPER, LOWER)).otherwise(text)
    return F.filter(F.split(ascii_lower, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")


def shingles_of(words: Column, size: int = SHINGLE_WORDS) -> Column:
    """Distinct 64-bit hashes of the word shingles.

    The words are bound to a lambda variable: inlined, they would be split anew for each shingle.
    """

    def one(w: Column) -> Column:
        n = F.size(w)
        many = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)]))
        few = F.array(F.xxhash64(F.concat_ws(" ", w), F.lit("short")))
        return F.when(n >= size, F.array_distinct(many)).when(n > 0, few).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), one), F.lit(0))


def with_shingles(df: DataFrame, text: str, out: str) -> DataFrame:
    return df.withColumn(out, shingles_of(words_of(F.coalesce(F.col(text), F.lit("")))))


def sketches(items: DataFrame, threshold: float) -> DataFrame:
    """(_item, item_set, n_item_shingles, sketch): the k smallest hashes, k by size partition."""
    n = F.col("n_item_shingles")
    largest = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) + 1) - 1
    k = F.least(n, (F.floor((1 - F.lit(threshold)) * largest + 1e-9) + 1).cast("int"))
    return (
        with_shingles(items, "text", "item_set")
        .withColumn("n_item_shingles", F.size("item_set"))
        .where("n_item_shingles > 0")
        .withColumn("sketch", F.slice(F.array_sort("item_set"), F.lit(1), k))
        .select("item_id", "item_set", "n_item_shingles", "sketch")
        .distinct()
    )


def contained(docs: DataFrame, items: DataFrame, key: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """Rows (*key, item_id, n_item_shingles, n_common, containment) for contained items.

    docs has the key columns and `text`; items has item_id and `text`.
    """
    index = stored(sketches(items.select("item_id", "text"), threshold))
    post = index.select("item_id", F.explode("sketch").alias("_h")).distinct()
    docs = docs.select(*key, "text")
    posted = with_shingles(docs, "text", "_set").select(*key, F.explode("_set").alias("_h"))
    found = stored(posted.join(bounded(post), "_h").select(*key, "item_id").distinct())
    same = lambda a, b, names: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in names]
    ids = found.select(*key).distinct()
    sets = with_shingles(docs.alias("d").join(bounded(ids).alias("i"), same("d", "i", key), "left_semi"), "text", "_set").drop("text")
    n_common = F.size(F.array_intersect("_set", "item_set"))
    return (
        sets.alias("s")
        .join(found.alias("f"), same("s", "f", key))
        .select(*[F.col(f"s.{c}") for c in key], "_set", "f.item_id")
        .alias("s")
        .join(index.drop("sketch").alias("x"), same("s", "x", ["item_id"]))
        .select(*[F.col(f"s.{c}") for c in key], "s.item_id", "n_item_shingles", n_common.alias("n_common"))
        .where(F.col("n_common") >= F.lit(threshold) * F.col("n_item_shingles"))
        .groupBy(*key, "item_id")
        .agg(F.max(F.struct((F.col("n_common") / F.col("n_item_shingles")).alias("containment"), "n_common", "n_item_shingles")).alias("m"))
        .select(*key, "item_id", F.col("m.n_item_shingles").cast("long").alias("n_item_shingles"), F.col("m.n_common").cast("long").alias("n_common"), F.round("m.containment", 6).alias("containment"))
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that contain no item; all columns are kept.

    Null and empty texts contain nothing; rows are told by doc_id (null or not) and text, so repeated rows go or stay
    together; an empty table, or one of items, takes nothing away.
    """
    text_hash, bad_id, bad_hash = fresh(docs, "text_hash", "bad_id", "bad_hash")
    keyed = docs.withColumn(text_hash, F.xxhash64("text"))
    bad = stored(contained(keyed, items, ["doc_id", text_hash]).select(F.col("doc_id").alias(bad_id), F.col(text_hash).alias(bad_hash)).distinct())
    on = [F.col("doc_id").eqNullSafe(F.col(bad_id)), F.col(text_hash) == F.col(bad_hash)]
    return keyed.join(bounded(bad), on, "left_anti").select(*docs.columns)


SQL = r"""
WITH t AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 'i', item_id, row_number() OVER (), text FROM benchmark),
w AS (
  SELECT kind, id, r, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+')) AS w,
         generate_subscripts(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), 1) AS pos
  FROM t),
g AS (
  SELECT kind, id, r, concat_ws(' ', w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o) AS sh,
         count(*) OVER (PARTITION BY kind, r) AS n, row_number() OVER o AS k
  FROM w WHERE w <> '' WINDOW o AS (PARTITION BY kind, r ORDER BY pos)),
s AS (SELECT DISTINCT kind, id, sh FROM g WHERE k <= greatest(n - 4, 1)),
n AS (SELECT id AS item_id, count(*) AS n_item_shingles FROM s WHERE kind = 'i' GROUP BY 1)
SELECT d.id AS doc_id, n.item_id, n.n_item_shingles, count(*) AS n_common, round(count(*) / n.n_item_shingles, 6) AS containment
FROM s d JOIN s i ON d.kind = 'd' AND i.kind = 'i' AND d.sh = i.sh JOIN n ON n.item_id = i.id
GROUP BY d.id, n.item_id, n.n_item_shingles HAVING count(*) >= 0.75 * n.n_item_shingles
"""
