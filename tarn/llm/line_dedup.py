"""Line dedup against levelled sorted runs of line hashes.

Documents are taken in batches of rising doc_id. A line's key is the line
without white space at both ends and with A-Z lower-cased; keys of at least
``min_chars`` code points count. Each batch looks its keys up in the runs of
all earlier batches, adds the new ones, and drops the lines whose key an
earlier document holds; so each key's lines stay in the document with the
smallest id, and there all of them stay.

Lines are hashed once, to rows of 36 bytes that all batches read; the places
of dropped lines are joined back and the rest is put together by array
functions. There is no Python on the workers. Keys are compared by 128 bits of
two xxHash64 values.

With a ``store`` that the caller keeps, lines that earlier calls have seen go
too, whatever the ids, and this call's lines are added; ``RunStore.open`` takes
up a store again in a later session.

Defined results: a null or empty text is one empty line and stays. Rows with
the same doc_id count as one document (each of them keeps the lines that this
document owns); a null doc_id is one document after all others. Documents that
lose all lines remain with an empty text. An empty table gives no rows. Columns
named ``n_lines`` and ``n_dropped`` are replaced, others of any name are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import remove, row_key, saved, shared_dir, unused
from tarn.llm.first_seen import RunStore, batch_step

#: Documents are ranked into this many batches by default.
BATCHES = 4


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(" \t\n\x0b\x0c\r"))


def _bounds(ids: DataFrame, batches: int) -> list[int]:
    """At most batches - 1 increasing ids that cut the documents evenly."""
    cuts = ids.select(F.percentile_approx("id", [k / batches for k in range(1, batches)], 10000)).first()[0] if batches > 1 else []
    return sorted(set(cuts or []))


def _lines(docs: DataFrame, text: str, min_chars: int) -> DataFrame:
    """(id, tag, pos, h1, h2): the keys of at least min_chars; tag tells rows of
    one id with different texts apart."""
    base = docs.select(row_key().alias("id"), F.col(text).cast("string").alias("t"))
    keyed = base.select("id", F.xxhash64("t").alias("tag"), F.posexplode(F.transform(F.split("t", "\n", -1), line_key)).alias("pos", "key"))
    # Not pushed below the explosion: there a key would be made again for its length.
    return keyed.where(F.length("key") >= min_chars).select("id", "tag", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def dropped_lines(docs: DataFrame, path: str, *, text: str = "text", min_chars: int = 10, batches: int = BATCHES, store: RunStore | None = None) -> DataFrame:
    """(id, tag, pos) of the lines to drop; ids are row keys."""
    spark = docs.sparkSession
    bounds = _bounds(docs.select(row_key().alias("id")), batches)
    batch = sum(((F.col("id") > b).cast("int") for b in bounds), F.lit(0))
    lines = saved(_lines(docs, text, min_chars).withColumn("batch", batch), f"{path}/lines", by="batch")
    own, out = store or RunStore(spark), None
    try:
        for k in range(len(bounds) + 1):
            rows = lines.where(F.col("batch") == k).drop("batch")
            got = batch_step(own, rows, f"{path}/{k}", last=store is None and k == len(bounds))
            remove(spark, f"{path}/{k}-keys")
            out = got if out is None else out.unionAll(got)
    finally:
        if store is None:
            own.close()
    remove(spark, f"{path}/lines")
    return out


def dedup_lines(docs: DataFrame, *, text: str = "text", min_chars: int = 10, batches: int = BATCHES, store: RunStore | None = None) -> DataFrame:
    """docs with `text` rewritten and the columns n_lines and n_dropped added."""
    gone = dropped_lines(docs, shared_dir(docs.sparkSession), text=text, min_chars=min_chars, batches=batches, store=store)
    key, tag, out = unused(docs, "id", "tag", "out")
    per_doc = gone.groupBy(F.col("id").alias(key), F.col("tag").alias(tag)).agg(F.collect_set("pos").alias(out))
    whole = F.col(text).cast("string")
    joined = docs.withColumns({key: row_key(), tag: F.xxhash64(whole)}).join(per_doc, [key, tag], "left")
    lines = F.split(F.coalesce(whole, F.lit("")), "\n", -1)
    # array_except hashes, so long documents that lose many lines take no longer a line.
    places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(out))
    kept = F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
    lost = F.col(out).isNotNull()
    return joined.withColumns({
        text: F.when(lost, kept).otherwise(F.col(text)),
        "n_lines": F.size(lines).cast("long"),
        "n_dropped": F.when(lost, F.size(out)).otherwise(0).cast("long"),
    }).drop(key, tag, out)
