"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's five-word shingles. Sketches of parts
merge into the sketch of the whole, and two sketches give estimates of resemblance, containment and distinct shingles.
All steps are DataFrame expressions inside the JVM.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from obsmat.llm.common import let, shingle_hashes, words

K = 128
SHINGLE = 5


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, shingle: int = SHINGLE) -> Column:
    """The sketch of a text; texts with fewer words than a shingle have one hash, of all their words; null and wordless texts none."""
    return bottom(shingle_hashes(words(text), shingle), k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what a and b were made of."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_parts(parts: DataFrame, key: str, sketch_col: str = "sketch", k: int = K) -> DataFrame:
    """One sketch for each key from the sketches of its parts. Distinct hashes are ranked within salted groups before they
    meet, so a key with a third of all parts brings at most k hashes from each of 64 groups into one task."""
    rows = parts.select(key, F.explode(sketch_col).alias("h")).distinct()
    first = Window.partitionBy(key, "salt").orderBy("h")
    rows = rows.withColumn("salt", F.pmod("h", F.lit(64))).withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return rows.groupBy(key).agg(F.slice(F.sort_array(F.collect_list("h")), 1, k).alias(sketch_col))


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity; 1 if both are empty, 0 if one is."""
    return let(
        F.struct(a.alias("a"), b.alias("b"), merge(a, b, k).alias("u")),
        lambda s: F.when(F.size(s["u"]) == 0, 1e0).otherwise(F.size(F.array_intersect(F.array_intersect(s["u"], s["a"]), s["b"])) / F.size(s["u"]).cast("double")),
    )


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Exact below k hashes, else (k-1) over the k-th smallest hash as a share of the range."""
    share = (F.element_at(a, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance times the union's size over a's, at most 1."""
    of_union = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1e0).otherwise(F.least(F.lit(1e0), of_union / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """Sixteen lowercase hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def with_next(docs: DataFrame, *, buckets_per_partition: int = 4) -> DataFrame:
    """doc_id, text and sketch with the same of the next document in descending doc_id; the first follows the last.

    Documents are dealt by buckets of doc_id (quantiles; the number follows spark.sql.shuffle.partitions) and ordered
    within; the first row of the next bucket is added to each as its end. So the texts are shuffled once and no task sees
    more than its buckets. Null ids come last, null texts count as empty; rows with one id are ordered by text.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = min(8000, max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))) * buckets_per_partition)
    cuts = d.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 20 * n)).first()[0] or []
    splits = [-float("inf"), *sorted({float(c) for c in cuts}), float("inf")]
    if len(splits) < 3:
        splits.insert(1, 0.0)
    d = d.withColumn("_x", -F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)))
    d = Bucketizer(splits=[-x for x in reversed(splits)], inputCol="_x", outputCol="_bucket").transform(d).drop("_x").withColumn("_bucket", F.col("_bucket").cast("int"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("text")]
    heads = d.groupBy("_bucket").agg(F.max("doc_id").alias("_head"))  # at most n + 1 rows of numbers
    by = Window.partitionBy(F.lit(0)).orderBy("_bucket")
    heads = heads.withColumn("_to", F.coalesce(F.lag("_bucket").over(by), F.max("_bucket").over(Window.partitionBy(F.lit(0)))))
    first = d.join(F.broadcast(heads), (d["_bucket"] == heads["_bucket"]) & d["doc_id"].eqNullSafe(heads["_head"]))
    first = first.groupBy(heads["_to"].alias("_bucket")).agg(F.min(F.struct("text", "doc_id")).alias("r")).select("r.doc_id", "r.text", "_bucket")
    rows = d.withColumn("_end", F.lit(0)).unionByName(first.withColumn("_end", F.lit(1))).repartition("_bucket")
    rows = rows.withColumn("sketch", sketch(F.col("text")))
    by = Window.partitionBy("_bucket").orderBy("_end", *order)
    rows = rows.withColumns({"next_text": F.lead("text").over(by), "next_sketch": F.lead("sketch").over(by)})
    return rows.where("_end = 0").drop("_end", "_bucket")


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row for each row of docs.

    The edited text has its last half (rounded down, in code points) replaced by as much of the start of the next document.
    """
    rows = with_next(docs)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("next_text").substr(F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", sketch(F.col("edited"), k).alias("edited_sketch"), "next_sketch")
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"), distinct_shingles(F.col("sketch"), k).alias("n_shingles"))
