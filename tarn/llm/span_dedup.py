"""Substring dedup on sliding sentence spans.

A sentence ends after a word that ends in ``.``, ``!`` or ``?`` (quotes and
brackets may follow), and at a line's end. Each sentence starts a span, the
shortest run from there of at least ``min_sentences`` sentences and
``min_words`` words, and ends one, the shortest such run up to there; so a
repeated passage is covered to both of its edges. With ``alone`` a sentence of
that many words is a span by itself. Spans are hashed over words folded to lower
case, whatever the white space between them. A sentence of which only a part is
repeated stays, so the words that a passage shares with a sentence around it do.

1. Hashes of all spans are counted; what counts twice goes into a Bloom filter
   of at most ``filter_bytes`` that is broadcast. A full filter lets more spans
   through to the next step and loses none.
2. Spans that pass are joined to their first occurrence (smallest doc_id, then
   place) on 128 bits. Sentences covered by any later occurrence go.

Counts are summed up before they are shuffled, and the join back is one that
AQE can split, so a passage in a third of all documents needs no large task.

Defined results: a null or empty text has no sentences. An occurrence that
overlaps the first one in the same document loses only what lies beyond it.
Rows of one doc_id and equal texts are one document; equal ids with different
texts are different documents, ordered by a hash of the text; a null doc_id
sorts last. Texts of which nothing is left remain as empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import NULL_ID, bounded_batches, row_key, saved, shared_dir, unused
from tarn.llm.wordhash import buffers, located_words, mix

MIN_SENTENCES, MIN_WORDS = 2, 25
FILTER_BYTES, SEGMENTS, PROBES = 32 << 20, 64, 5

_U = np.uint64
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_CLOSING = np.zeros(256, bool)
_CLOSING[[ord(c) for c in "\"')]}*"]] = True
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
#: What is added to a key for each probe of the filter.
_STEPS = np.arange(1, PROBES + 1, dtype=_U) * _U(_BASES[1])


def sentence_ends(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For the words of one text: the index after the last word of each sentence."""
    if not len(begins):
        return np.empty(0, np.int64)
    tail = ends - 1
    while True:  # step back over closing marks
        back = _CLOSING[data[tail]] & (tail > begins)
        if not back.any():
            break
        tail = tail - back
    lines = np.append(0, np.cumsum(data[begins[0] : ends[-1]] == 10))
    broken = lines[begins[1:] - begins[0]] > lines[ends[:-1] - begins[0]]
    stop = _STOP[data[tail]]
    stop[:-1] |= broken
    stop[-1] = True
    return np.flatnonzero(stop) + 1


def spans(after: np.ndarray, min_sentences: int, min_words: int, alone: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence (exclusive) of the distinct spans of one text."""
    n = len(after)
    edge = np.append(0, after)
    i = np.arange(n)
    forward = np.maximum(np.searchsorted(edge, edge[:-1] + min_words), i + min_sentences)
    backward = np.minimum(np.searchsorted(edge, edge[1:] - min_words, "right") - 1, i + 1 - min_sentences)
    f, b = forward <= n, backward >= 0
    pairs = np.append(i[f] * (n + 1) + forward[f], backward[b] * (n + 1) + i[b] + 1)
    if alone is not None:
        one = i[np.diff(edge) >= alone]
        pairs = np.append(pairs, one * (n + 1) + one + 1)
    pairs = np.unique(pairs)
    return pairs // (n + 1), pairs % (n + 1)


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def _power(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of both bases and of their inverses, at least n."""
    if not _powers or len(_powers[0][0]) < n:
        _powers.clear()
        for base in _BASES:
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                x = np.full(max(n, 1 << 16), _U(b))
                x[0] = 1
                both.append(np.multiply.accumulate(x))
            _powers.append(tuple(both))
    return _powers


def _span_hashes(words: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int) -> np.ndarray:
    power, inverse = _power(len(words) + 1)[which]
    sums = np.append(_U(0), np.cumsum(words * power[: len(words)]))
    return mix((sums[hi] - sums[lo]) * inverse[lo] + (hi - lo).astype(_U))


def _spans_of(texts: pa.Array, min_sentences: int, min_words: int, alone: int | None):
    """(row, first sentence, last, words, first word, last) of each text with spans."""
    data, _ = buffers(texts)
    for lo, hi, words, at, begins, ends in located_words(texts):
        for j in range(hi - lo):
            a, b = at[j], at[j + 1]
            after = sentence_ends(data, begins[a:b], ends[a:b])
            first, last = spans(after, min_sentences, min_words, alone)
            if len(first):
                edge = np.append(0, after)
                yield lo + j, first, last, words[a:b], edge[first], edge[last]


def _hashes(docs: DataFrame, min_sentences: int, min_words: int, alone: int | None) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list = []
            size = 0
            for _, _, _, words, lo, hi in _spans_of(batch.column(0), min_sentences, min_words, alone):
                held.append(_span_hashes(words, lo, hi, 0))
                size += len(held[-1])
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["h1"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], ["h1"])

    return docs.select("text").mapInArrow(work, "h1 long")


def _bits(keys: np.ndarray, i: int, size: int) -> np.ndarray:
    return (mix(keys + _STEPS[i]) % _U(size)).astype(np.int64)


def _segment(keys: np.ndarray) -> np.ndarray:
    return (keys % _U(SEGMENTS)).astype(np.int64)


def _repeat_filter(repeated: DataFrame, filter_bytes: int) -> list[bytes]:
    """Bloom filters of the hashes by segment, filter_bytes in all at most. Tasks
    stream the keys of their segments and hold the bits alone."""
    n = repeated.count()
    size = min(filter_bytes * 8 // SEGMENTS, n * 10 // SEGMENTS // 64 * 64 + 640)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for batch in batches:
            keys = batch.column(0).to_numpy().view(_U)
            where = _segment(keys)
            for s in np.unique(where):
                bits = own.setdefault(int(s), np.zeros(size, bool))
                for i in range(PROBES):
                    bits[_bits(keys[where == s], i, size)] = True
        if own:
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.int32()), pa.array([np.packbits(b, bitorder="little").tobytes() for b in own.values()])], ["segment", "bits"])

    # SEGMENTS divides 2**64, so the remainder is that of the unsigned hash too.
    dealt = repeated.select("h1", F.pmod("h1", F.lit(SEGMENTS)).alias("s")).repartition(SEGMENTS, "s").select("h1")
    out = [b""] * SEGMENTS
    for r in dealt.mapInArrow(build, "segment int, bits binary").collect():
        out[r["segment"]] = bytes(r["bits"])
    return out


def _occurrences(docs: DataFrame, shared, min_sentences: int, min_words: int, alone: int | None) -> DataFrame:
    """(h1, h2, id, tag, first, last): spans that pass the filter, by sentence numbers."""
    names = ["h1", "h2", "id", "tag", "first", "last"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(x, np.uint8) for x in shared.value]
        size = np.array([max(1, len(x) * 8) for x in parts], _U)
        start = np.append(0, np.cumsum([len(x) for x in parts]))[:-1]
        bits = np.concatenate(parts) if any(map(len, parts)) else np.zeros(1, np.uint8)
        filled = np.array([len(x) > 0 for x in parts])

        def passes(keys: np.ndarray) -> np.ndarray:
            where = _segment(keys)
            ok = filled[where]
            for i in range(PROBES):
                k = np.flatnonzero(ok)
                bit = (mix(keys[k] + _STEPS[i]) % size[where[k]]).astype(np.int64)
                ok[k] = (bits[start[where[k]] + (bit >> 3)] >> (bit & 7).astype(np.uint8)) & 1 > 0
            return ok

        for batch in batches:
            ids, tags = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            got: list = []
            for row, first, last, words, lo, hi in _spans_of(batch.column(2), min_sentences, min_words, alone):
                h1 = _span_hashes(words, lo, hi, 0)
                ok = passes(h1)
                if ok.any():
                    k = int(ok.sum())
                    h2 = _span_hashes(words, lo[ok], hi[ok], 1)
                    got.append((h1[ok].view(np.int64), h2.view(np.int64), np.full(k, ids[row]), np.full(k, tags[row]), first[ok].astype(np.int32), last[ok].astype(np.int32)))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*got)], names)

    return docs.select("id", "tag", "text").mapInArrow(work, "h1 long, h2 long, id long, tag long, first int, last int")


def repeated_spans(docs: DataFrame, path: str, *, min_sentences: int, min_words: int, alone: int | None, filter_bytes: int) -> DataFrame:
    """(id, tag, first, last, of): sentences that a non-first occurrence covers, and
    the document of the first one, for docs (id, tag, text)."""
    spark = docs.sparkSession
    repeated = _hashes(docs, min_sentences, min_words, alone).groupBy("h1").agg(F.count("*").alias("n")).where("n > 1").select("h1")
    shared = spark.sparkContext.broadcast(_repeat_filter(saved(repeated, f"{path}/repeated"), filter_bytes))
    seen = saved(_occurrences(docs, shared, min_sentences, min_words, alone).distinct(), f"{path}/seen")
    place = F.struct("id", "tag", "first", "last")
    firsts = seen.groupBy("h1", "h2").agg(F.min(place).alias("f"), F.max(place).alias("l")).where("f < l").select("h1", "h2", "f")
    firsts = saved(firsts, f"{path}/firsts")  # so that both sides of the join are plain shuffles, which AQE can split
    later = seen.join(firsts, ["h1", "h2"]).where(place > F.col("f"))
    own = (F.col("id") == F.col("f.id")) & (F.col("tag") == F.col("f.tag"))
    begins = F.when(own, F.greatest("first", "f.last")).otherwise(F.col("first"))
    return later.select("id", "tag", begins.alias("first"), "last", F.col("f.id").alias("of")).where("first < last").distinct()


def dedup_spans(docs: DataFrame, *, text: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, alone: int | None = None, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """docs with `text` rewritten and n_sentences, n_removed and repeats_of added:
    the ids of the documents that hold what was removed (a null id is left out)."""
    bounded_batches(docs.sparkSession)
    path = shared_dir(docs.sparkSession)
    key, tag, lost, sources, done = unused(docs, "id", "tag", "lost", "sources", "done")
    as_text = F.col(text).cast("string")
    plain = docs.select(row_key().alias("id"), F.xxhash64(as_text).alias("tag"), as_text.alias("text"))
    gone = repeated_spans(plain, path, min_sentences=min_sentences, min_words=min_words, alone=alone, filter_bytes=filter_bytes)
    of = F.array_sort(F.collect_set(F.when(F.col("of") != NULL_ID, F.col("of"))))
    per_doc = gone.groupBy(F.col("id").alias(key), F.col("tag").alias(tag)).agg(F.collect_set(F.array("first", "last")).alias(lost), of.alias(sources))

    @F.arrow_udf("struct<text: string, n: long, removed: long>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, gone in batches:
            data, at = buffers(texts)
            out = []
            for lo, hi, _, words, begins, ends in located_words(texts):
                for j in range(hi - lo):
                    row, a, b = lo + j, words[j], words[j + 1]
                    after = sentence_ends(data, begins[a:b], ends[a:b])
                    drop = np.zeros(len(after), bool)
                    for first, last in gone[row].as_py() or ():
                        drop[first:last] = True
                    raw = data[at[row] : at[row + 1]]
                    if drop.any():
                        # A sentence runs up to where the next one's first word begins.
                        edge = begins[a:b][np.append(0, after[:-1])] - at[row]
                        keep = np.repeat(~np.append(False, drop), np.diff(np.append(np.append(0, edge), len(raw))))
                        raw = raw[keep]
                    out.append({"text": raw.tobytes().decode(), "n": len(after), "removed": int(drop.sum())})
            yield pa.array(out, pa.struct([("text", pa.string()), ("n", pa.int64()), ("removed", pa.int64())]))

    # Not deterministic in name, so that no filter copies the call below itself.
    cut = cut.asNondeterministic()
    whole = docs.withColumns({key: row_key(), tag: F.xxhash64(as_text)}).join(per_doc, [key, tag], "left")
    return whole.withColumn(done, cut(as_text, lost)).withColumns({
        text: F.when(F.col(f"{done}.removed") > 0, F.col(f"{done}.text")).otherwise(F.col(text)),
        "n_sentences": F.col(f"{done}.n"),
        "n_removed": F.col(f"{done}.removed"),
        "repeats_of": F.coalesce(sources, F.array().cast("array<long>")),
    }).drop(key, tag, lost, sources, done)
