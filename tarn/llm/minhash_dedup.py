"""MinHash near-dedup on HyperMinHash registers.

A document's set holds its distinct n-word shingles (64-bit hashes of words
folded to lower case). Each of ``BANDS * ROWS`` buckets keeps the least hash of
its part as a 16-bit register: the count of leading zeros and ten bits of
mantissa. Sets of many shingles deal one hash to all buckets; smaller ones,
whose buckets would stay empty, take one hash function a bucket. Sizes between
get both, so any two sets of resemblance ``threshold`` share a scheme.

1. Documents of equal sets are one class; its smallest id goes on alone.
2. Bands of registers are keys. Two sets of resemblance 0.8 miss each other in
   all 48 bands of 6 with probability 5e-7.
3. Of each key's holders the smallest is the centre, and the others are tried
   against it (as many rows as holders, not pairs): the estimate, corrected for
   registers that collide by chance, sorts out far ones, and the full sets
   decide. Connected components of these links come first.
4. What a key leaves open are its other holders, as far as they lie in different
   components. Documents that open keys connect are a cluster. Those outside its
   largest component are compared on full sets with all of it, in blocks of bounded
   size that meet only blocks of fitting set sizes; links are all that a block
   returns. So no link is lost for want of a common centre, and no pairs are written.

Defined results: a text without words, or null, has an empty set and is linked
with nothing; with fewer words than a shingle its whole sequence is one. Rows
of equal doc_id are one document for linking and each is returned; a null
doc_id is one document that sorts last. An empty table gives no rows. Columns
named like the three outputs are replaced, others of any name are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import NULL_ID, bounded_batches, remove, row_key, saved, shared_dir, unused, without
from tarn.llm.components import components
from tarn.llm.wordhash import grams, mix, word_hashes

BANDS, ROWS = 48, 6
M = BANDS * ROWS
MANTISSA = 10
#: From this set size on one hash is dealt to all buckets; a bucket stays empty
#: with probability e**-8.
LARGE = 8 * M
#: Chance that the registers of unequal minima agree: 2**-10 times the integral
#: of exp(-2x) over mean cell widths.
BY_CHANCE = 0.18 * 2.0**-MANTISSA
#: Shingles in a block of the last comparison.
BLOCK = 40_000
#: Tasks that the rows of one cluster are dealt to when facts about it are joined.
SALTS = 32

_U = np.uint64
_SALT = mix(np.arange(1, M + 1, dtype=_U))
_ODD = mix(np.arange(1001, M + 1001, dtype=_U)) | _U(1)


def _registers(least: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of 64-bit minima, as uint16."""
    fraction, exponent = np.frexp(least.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    return zeros << MANTISSA | ((fraction - 0.5) * (2 << MANTISSA)).astype(np.uint16) & np.uint16((1 << MANTISSA) - 1)


def small_registers(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One hash function a bucket, for sets flat[offsets[i]:offsets[i + 1]], none empty."""
    out = np.empty((len(offsets) - 1, M), _U)
    for i in range(M):
        out[:, i] = np.minimum.reduceat((flat ^ _SALT[i]) * _ODD[i], offsets[:-1])
    return _registers(out)


def large_registers(shingles: np.ndarray) -> np.ndarray:
    """One hash dealt to all buckets; an empty one has the largest minimum."""
    bucket, value = (shingles >> _U(32)) % _U(M), mix(shingles)
    out = np.full(M, ~_U(0))
    np.minimum.at(out, bucket.astype(np.int64), value)
    return _registers(out)


def _band_keys(registers: np.ndarray, scheme: int) -> np.ndarray:
    x = registers.reshape(len(registers), BANDS, ROWS).astype(_U)
    out = np.broadcast_to(np.arange(BANDS, dtype=_U) + _U(scheme << 16), x.shape[:2]).copy()
    for k in range(ROWS):
        out = mix(out * _U(0x9E3779B97F4A7C15) + x[:, :, k] + _U(1))
    return out.view(np.int64)


def _sets(texts: pa.Array, n: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    for lo, hi, words, at in word_hashes(texts):
        yield lo, hi, [np.unique(grams(words[at[j] : at[j + 1]], n)) for j in range(hi - lo)]


def _schemes(sets: list[np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions and registers of the sets of either scheme."""
    size = np.array([len(s) for s in sets], np.int64)
    few = np.flatnonzero((size > 0) & (size < LARGE))
    many = np.flatnonzero(size >= int(LARGE * threshold))
    r1 = np.empty((0, M), np.uint16)
    if len(few):
        r1 = small_registers(np.concatenate([sets[i] for i in few]), np.append(0, np.cumsum(size[few])))
    r2 = np.array([large_registers(sets[i]) for i in many], np.uint16).reshape(-1, M)
    return few, r1, many, r2


def signatures(docs: DataFrame, *, shingle: int, threshold: float) -> DataFrame:
    """(id, n_shingles, d1, d2, bands): set size, 128-bit digest of the set, band keys."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            ids = batch.column(0)
            for lo, hi, sets in _sets(batch.column(1), shingle):
                raw = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                digest = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
                keys: list = [[] for _ in sets]
                few, r1, many, r2 = _schemes(sets, threshold)
                for at, regs, scheme in ((few, r1, 1), (many, r2, 2)):
                    if len(at):
                        for i, k in zip(at, _band_keys(regs, scheme)):
                            keys[i].append(k)
                counts = np.array([sum(map(len, k)) for k in keys])
                flat = np.concatenate([x for k in keys for x in k] or [np.empty(0, np.int64)])
                bands = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat))
                size = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([ids[lo:hi], size, pa.array(digest[:, 0]), pa.array(digest[:, 1]), bands], ["id", "n_shingles", "d1", "d2", "bands"])

    return docs.mapInArrow(work, "id long, n_shingles long, d1 long, d2 long, bands array<long>")


def _features(docs: DataFrame, *, shingle: int, threshold: float) -> DataFrame:
    """(id, small, large, shingles): registers of either scheme or null, and the sorted set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, sets in _sets(batch.column(1), shingle):
                r1s: list = [None] * len(sets)
                r2s: list = [None] * len(sets)
                few, r1, many, r2 = _schemes(sets, threshold)
                for i, r in zip(few, r1):
                    r1s[i] = r.tobytes()
                for i, r in zip(many, r2):
                    r2s[i] = r.tobytes()
                cols = [ids[lo:hi], pa.array(r1s, pa.binary()), pa.array(r2s, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["id", "small", "large", "shingles"])

    return docs.mapInArrow(work, "id long, small binary, large binary, shingles binary")


def estimate(a: bytes, b: bytes) -> float:
    """Resemblance from two register arrays, less what agrees by chance."""
    same = float(np.mean(np.frombuffer(a, np.uint16) == np.frombuffer(b, np.uint16)))
    return max(0.0, (same - BY_CHANCE) / (1 - BY_CHANCE))


def _linked(shared: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int, percent: int):
    return 100 * shared >= percent * (a + b - shared)


def _verifier(percent: int):
    # Six standard errors below the threshold.
    far = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / M) ** 0.5

    @F.pandas_udf(T.BooleanType())
    def holds(small_a: pd.Series, large_a: pd.Series, set_a: pd.Series, small_b: pd.Series, large_b: pd.Series, set_b: pd.Series) -> pd.Series:
        out = np.zeros(len(set_a), bool)
        for i, (s1, l1, x, s2, l2, y) in enumerate(zip(small_a, large_a, set_a, small_b, large_b, set_b)):
            r1, r2 = (s1, s2) if s1 is not None and s2 is not None else (l1, l2)
            if r1 is None or r2 is None or estimate(r1, r2) < far:
                continue
            a, b = np.frombuffer(x, _U), np.frombuffer(y, _U)
            out[i] = _linked(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent)
        return pd.Series(out)

    return holds


def _block_links(percent: int):
    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        """Links between the query and the member rows of one pair of blocks."""
        pdf = pdf.sort_values("id", kind="stable")
        ask, held = pdf[pdf["query"]], pdf[~pdf["query"]]
        none = pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        if not len(ask) or not len(held):
            return none
        sets = [np.frombuffer(x, _U) for x in held["shingles"]]
        size = np.array([len(s) for s in sets])
        names, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.append(0, np.cumsum(size))[:-1]
        ids, labels = held["id"].to_numpy(), held["label"].to_numpy()
        out: list[tuple[int, int]] = []
        mark = np.zeros(len(names), bool)
        for i, label, raw in zip(ask["id"], ask["label"], ask["shingles"]):
            own = np.frombuffer(raw, _U)
            at = np.searchsorted(names, own)
            ok = at < len(names)
            own_in, at = own[ok], at[ok]
            at = at[names[at] == own_in]  # absent shingles point at their successors
            mark[at] = True
            shared = np.add.reduceat(mark[flat].astype(np.int64), starts)
            mark[at] = False
            hit = _linked(shared, len(own), size, percent) & (labels != label)
            out += [(int(i), int(j)) for j in ids[hit]]
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64") if out else none

    return compare


def _labelled(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """nodes (id, ...) with `label`: the component, or the node itself."""
    return nodes.join(comps.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("label", F.coalesce("component", "id")).drop("component")


def _joined(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """rows (id, ...) with the few facts about their cluster. A cluster may hold
    most rows, so its rows are dealt by id and each share meets a copy of the facts."""
    salt = F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")
    copies = facts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", salt).join(copies, [*on, "salt"]).drop("salt")


def links(docs: DataFrame, *, shingle: int = 5, percent: int = 80, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """For docs (id, text): (classes, edges). classes has (id, n_shingles, rep)
    for each document; edges (a, b) between representatives have exactly the
    components of all links of at least percent / 100."""
    spark = docs.sparkSession
    bounded_batches(spark)
    path = path or shared_dir(spark)
    threshold = percent / 100
    sigs = saved(signatures(docs, shingle=shingle, threshold=threshold), f"{path}/signatures")
    digests = saved(sigs.where("n_shingles > 0").groupBy("d1", "d2").agg(F.min("id").alias("rep")), f"{path}/digests")
    classes = sigs.select("id", "n_shingles", "d1", "d2").join(digests, ["d1", "d2"], "left")
    classes = saved(classes.select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("id")).alias("rep")).distinct(), f"{path}/classes")

    reps = digests.select(F.col("rep").alias("id"))
    bands = sigs.where("n_shingles > 0").join(reps, "id", "left_semi").select("id", F.explode("bands").alias("band")).distinct()
    keys = bands.groupBy("band").agg(F.min("id").alias("centre"), F.max("id").alias("last")).where("centre < last").select("band", "centre")
    keys = saved(keys, f"{path}/keys")  # so that both sides of the join are plain shuffles, which AQE can split
    holders = saved(bands.join(keys, "band").select("band", "centre", "id"), f"{path}/holders")
    remove(spark, f"{path}/signatures")

    found = holders.select("id").distinct()
    feats = saved(_features(docs.join(found, "id", "left_semi"), shingle=shingle, threshold=threshold), f"{path}/features")
    holds = _verifier(percent)

    def side(s: str) -> DataFrame:
        return feats.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("small", "large", "shingles")])

    tried = holders.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct()
    tried = tried.join(side("a"), "a").join(side("b"), "b").where(holds("small_a", "large_a", "shingles_a", "small_b", "large_b", "shingles_b"))
    stars = saved(tried.select("a", "b"), f"{path}/stars")

    # The centre's pairs are settled. Of the others those matter whose key still holds
    # several components.
    labels = saved(_labelled(found, components(stars)), f"{path}/labels")
    others = holders.where("id <> centre").select("band", "id").join(labels, "id")
    left = others.groupBy("band").agg(F.min("label").alias("b"), F.max("label").alias("top"), F.min("id").alias("first")).where("b < top").select("band", "first")
    still = saved(others.join(saved(left, f"{path}/left"), "band").select("id", "label", "first").distinct(), f"{path}/still")
    clusters = components(still.select(F.col("id").alias("a"), F.col("first").alias("b"))).withColumnsRenamed({"node": "id", "component": "cluster"})
    rest = saved(still.select("id", "label").distinct().join(clusters, "id"), f"{path}/clustered")
    counted = rest.groupBy("cluster", "label").agg(F.count("*").alias("n"))
    largest = counted.groupBy("cluster").agg(F.max(F.struct("n", "label")).alias("x")).select("cluster", F.col("x.label").alias("main"))
    rest = _joined(rest, largest, ["cluster"]).withColumn("query", F.col("label") != F.col("main")).drop("main")
    rest = rest.join(feats.select("id", "shingles"), "id").withColumn("n", F.length("shingles") / 8)
    # Sets whose sizes differ by more than the threshold can't be linked: classes
    # of sizes within that factor meet themselves and their neighbours.
    rest = saved(rest.withColumn("size_class", F.floor(F.log(F.col("n")) / F.lit(float(-np.log(threshold))))), f"{path}/rest")
    parts = rest.groupBy("cluster", "size_class").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    asked = rest.where("query").groupBy("cluster", "size_class").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("asked"))

    def near(df: DataFrame, count: str) -> DataFrame:
        """(cluster, size_class, at, count): what the class `at` next to a class has."""
        return df.select("cluster", F.col("size_class").alias("at"), count).withColumn("size_class", F.explode(F.array(F.col("at") - 1, F.col("at"), F.col("at") + 1)))

    def blocks(df: DataFrame, n: str) -> F.Column:
        return F.pmod(F.xxhash64("id"), F.col(n)).cast("int")

    who = ["cluster", "size_class"]
    ask = _joined(_joined(rest.where("query"), asked, who).withColumn("qb", blocks(rest, "asked")), near(parts, "parts"), who)
    ask = ask.withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    ask = ask.select("cluster", F.col("size_class").alias("qc"), "qb", F.col("at").alias("mc"), "mb", "id", "label", "query", "shingles")
    held = _joined(_joined(rest, parts, who).withColumn("mb", blocks(rest, "parts")), near(asked, "asked"), who)
    held = held.withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("asked") - 1)))
    held = held.select("cluster", F.col("at").alias("qc"), "qb", F.col("size_class").alias("mc"), "mb", "id", "label", F.lit(False).alias("query"), "shingles")
    late = ask.unionAll(held).groupBy("cluster", "qc", "qb", "mc", "mb").applyInPandas(_block_links(percent), "a long, b long")
    edges = stars.unionAll(saved(late, f"{path}/late"))
    return classes, edges


def near_duplicates(docs: DataFrame, *, text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """docs with n_shingles, component_id (the smallest id reachable by links of
    at least percent / 100, the row's own included) and kept (id = component)."""
    spark = docs.sparkSession
    path = shared_dir(spark)
    classes, edges = links(docs.select(row_key().alias("id"), F.col(text).cast("string").alias("text")), shingle=shingle, percent=percent, path=path)
    comps = components(edges)
    found = classes.join(comps.select(F.col("node").alias("rep"), "component"), "rep", "left")
    found = saved(found.select("id", "n_shingles", F.coalesce("component", "rep").alias("component_id")), shared_dir(spark))
    remove(spark, path)
    rest = without(docs, "n_shingles", "component_id", "kept")
    (key,) = unused(rest, "id")
    # Rows of one id with different texts are one document: the smallest component holds.
    found = found.groupBy(F.col("id").alias(key)).agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    out = rest.withColumn(key, row_key()).join(found, key, "left")
    real = F.when(F.col("component_id") != NULL_ID, F.col("component_id"))
    return out.select(*rest.columns, "n_shingles", real.alias("component_id"), (F.col("component_id") == F.col(key)).alias("kept"))
