"""Document fingerprints: bottom-k sketches of shingle hashes, as SQL expressions.

A text's words (``[^\\x20\\x09-\\x0D]+``, A-Z folded) are hashed, each run of
``n`` words gives one 64-bit shingle hash, and the ``k`` smallest distinct
hashes are the sketch. All functions take and return Columns; they are built-in
array functions, with no Python on the workers.

A sketch of a whole is the merge of its parts' sketches (shingles across the
parts' border aside), and sketches of any two texts compare: the k smallest of
their union are a sample of the union of both sets. ``merge`` takes two, and
``merged`` all sketches of each group of rows.

Defined results: with fewer words than n the whole sequence is one shingle; a
null text, or one without words, has an empty sketch. Two empty sketches have
resemblance and containment 1, an empty and another one 0. Up to k shingles
all figures are exact. A column named like an output is replaced, others of any
name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import row_key, saved, shared_dir, unused

K, WORDS = 128, 5
_SPACE = r"[\x20\x09-\x0D]+"


def _least(hashes: Column, k: int) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, out: str, *, k: int = K, n: int = WORDS) -> DataFrame:
    """df with the sketch of the column `text`. The hashes of words are a column
    of their own for the time, so that they are computed once a row."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.filter(F.split(low, _SPACE, -1), lambda w: w != "")
    (own,) = unused(df, "w")
    df = df.withColumn(own, F.transform(words, lambda w: F.xxhash64(w)))
    w, size = F.col(own), F.size(own)
    runs = F.transform(F.sequence(F.lit(0), size - n), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)]))
    whole = F.array(F.aggregate(w, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
    shingles = F.when(size >= n, runs).when(size > 0, whole).otherwise(F.array().cast("array<long>"))
    return df.withColumn(out, _least(shingles, k)).drop(own)


def merge(a: Column, b: Column, *, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merged(df: DataFrame, *by: str, sketch: str = "sketch", k: int = K) -> DataFrame:
    """(by, sketch): the sketch of all rows of each group together. Each task sends
    at most k hashes a group to the second shuffle, so a group may be of any size."""
    h, r = unused(df, "h", "r")
    rows = df.select(*by, F.explode_outer(sketch).alias(h)).distinct()
    order = Window.partitionBy(*by).orderBy(F.col(h).asc_nulls_last())
    least = rows.withColumn(r, F.row_number().over(order)).where(F.col(r) <= k)
    return least.groupBy(*by).agg(F.sort_array(F.collect_list(h)).alias(sketch))


def _common(a: Column, b: Column, union: Column) -> Column:
    return F.size(F.array_intersect(F.array_intersect(union, a), b)).cast("double")


def resemblance(a: Column, b: Column, *, k: int = K) -> Column:
    """Estimated size of the intersection over that of the union, 0 to 1."""
    union = merge(a, b, k=k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(_common(a, b, union) / F.size(union))


def distinct_shingles(sketch: Column, *, k: int = K) -> Column:
    """Estimated count of distinct shingles; exact below k."""
    # The k-th smallest of hashes that are even over [-2**63, 2**63).
    share = (F.element_at(sketch, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / share)


def containment(a: Column, b: Column, *, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1."""
    union = merge(a, b, k=k)
    shared = resemblance(a, b, k=k) * distinct_shingles(union, k=k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k=k)))


def as_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def followed(ids: DataFrame, path: str) -> DataFrame:
    """(id, next) for distinct ids: the next smaller id, and for the smallest the
    largest. Ids are range-partitioned; only one bound per partition comes to
    the driver, to close the gaps between partitions."""
    spark = ids.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = saved(ids.distinct().repartitionByRange(n, F.col("id").desc()).select("id", F.spark_partition_id().alias("part")), path)
    heads = sorted((r["part"], r["head"]) for r in parts.groupBy("part").agg(F.max("id").alias("head")).collect())
    if not heads:
        return parts.select("id", F.col("id").alias("next"))
    after = F.create_map(*[F.lit(x) for (part, _), (_, head) in zip(heads, heads[1:] + heads[:1]) for x in (part, head)])
    inside = F.lead("id").over(Window.partitionBy("part").orderBy(F.col("id").desc()))
    # The second is evaluated where the first is null: for the last id of a partition.
    return parts.select("id", F.coalesce(inside, after[F.col("part")]).alias("next"))


def edited(docs: DataFrame, *, k: int = K, n: int = WORDS) -> DataFrame:
    """For docs (doc_id, text): each text with its edit, whose last half is
    replaced by the beginning of the next document's, in falling order of id.

    Rows: id (doc_id, null as the largest long), text, edited, sketch,
    edited_sketch, next_sketch. Rows that share an id share the next document;
    where the next id repeats, its smallest text is taken.

    Texts are shuffled once, by id, for both joins; what goes to the row before
    is no more of a text than its edit takes.
    """
    path = shared_dir(docs.sparkSession)
    base = docs.select(row_key().alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    halves = base.groupBy("id").agg(F.max(F.floor(F.length("text") / 2)).cast("int").alias("half"))
    order = followed(base.select("id"), f"{path}/ids").join(halves, "id")
    order = order.select(F.col("id").alias("before"), F.col("next").alias("id"), "half")
    giving = with_sketch(base.join(order.hint("merge"), "id").select("before", "text", "half"), "text", "next_sketch", k=k, n=n)
    giving = giving.select("before", F.struct(F.col("text").substr(F.lit(1), F.col("half")).alias("lead"), "next_sketch").alias("given"))
    giving = giving.groupBy("before").agg(F.min("given").alias("given")).select(F.col("before").alias("id"), "given")
    out = base.join(giving.hint("merge"), "id")
    half = F.floor(F.length("text") / 2).cast("int")
    out = out.select("id", "text", F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("given.lead").substr(F.lit(1), half)).alias("edited"), F.col("given.next_sketch").alias("next_sketch"))
    return with_sketch(with_sketch(out, "text", "sketch", k=k, n=n), "edited", "edited_sketch", k=k, n=n)
