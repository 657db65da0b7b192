"""Language-model scoring with a log-frequency Bloom filter.

Counting. Workers hash the tokens of whole training texts, sum up equal
unigrams and bigrams of about a million tokens, and send them as sorted
arrays, dealt by the top bits of the hash to segments; one task a segment adds
them up. A segment keeps exact unigram counts, and a Bloom filter of its
bigrams: a count c is quantised to 1 + floor(log(c) / log(STEP)) and the bigram
is inserted once for each level up to that.

Scoring. A model of at most ``block_bytes`` is broadcast, and one pass over the
texts does it. A bigram's count is found by asking for level 1, 2, ... until one
is missing, and is taken at the lower end of the level, so quantising never
gives a context more than its share; a false hit of the filter does, for one
unseen bigram in some 2**10. A token's probability is, with absolute discounting,
max(c(v, w) - D, 0) / c(v) + D * c(v)**-SPREAD * P1, P1 the unigram probability
(c + 0.5) / (N + 0.5 * (V + 1)). The second term gives back what the discount
takes; the share of a context's distinct followers, by which it is to be given back,
is taken as c(v)**-SPREAD, so probabilities add up to 1 on average (1.01 over
contexts as they occur) and not for each context.

A larger model isn't sent to all: the texts' distinct words and bigrams, a
million tokens at a time (a parcel), go to the segments that can tell their
counts, and the answers come back to the parcels. A segment looks up what many
parcels ask at once, each distinct key a single time. Texts are read once; what
is on disk grows with the tokens (at most 12 bytes a token at a time, measured at
407 million tokens), as shuffles go when their step ends. Rows, of some 60 bytes
besides their keys, grow with parcels times segments until there is one a key.
The scores are the same to the last rounding.

Tokens: words ``[^\\x20\\x09-\\x0D]+`` with A-Z folded, then one end, which is
also the context of the first token. Words are compared by 64-bit hashes.

Defined results: a null or empty text is the end alone. Without training texts
N and V are 0 and every score is 0. Repeated rows count and are scored each.
Columns named like the five outputs are replaced, others of any name are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import bounded_batches, saved, shared_dir, unused
from tarn.llm.wordhash import mix, word_hashes

#: Ratio of neighbouring quantisation levels, and probes of a membership test: many
#: at level 1, where a false hit makes an unseen bigram a seen one, and fewer above,
#: where it adds a level to a seen one.
STEP, PROBES, MORE = 1.5, 12, 6
#: Bits of the filter for each probe, at which half of them are set.
BITS = 1 / math.log(2)
#: An entry's probes lie in one block of 512 bits, a line of the processor's cache,
#: two in each word that is looked at. Keys that are out already are left behind
#: after each of these rounds of words. False hits are some three times 2 ** -PROBES.
_ROUNDS = {PROBES: ((0,), (1,), (2, 3, 4, 5)), MORE: ((0,), (1, 2))}
#: Tokens summed up before they are sent, and entries meant for a segment.
AT_ONCE, PER_SEGMENT = 1_000_000, 2_000_000
#: The largest model that is broadcast.
BLOCK_BYTES = 256 << 20
#: Parcels that ask one copy of a segment.
PARCELS = 20_000
#: What is taken off a bigram's count, and how a context's share of distinct
#: followers falls with its count: both chosen on training folds.
DISCOUNT, SPREAD = 0.8, 0.1

_U = np.uint64
_LEVELS = np.arange(256, dtype=_U) * _U(0xD6E8FEB86659FD93)
END = mix(np.array([2], _U))[0]


def level_of(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log(counts) / math.log(STEP) + 1e-9).astype(np.int64)


def least_count(levels: np.ndarray) -> np.ndarray:
    """The least count of a level; 0 for level 0."""
    return np.where(levels > 0, np.ceil(STEP ** (np.maximum(levels, 1) - 1.0) - 1e-9), 0.0)


def _tokens(words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of texts end to end, the token before each, and where texts begin."""
    n = len(at) - 1
    ends = at[1:] + np.arange(n)
    tokens = np.empty(len(words) + n, _U)
    is_end = np.zeros(len(tokens), bool)
    is_end[ends] = True
    tokens[is_end], tokens[~is_end] = END, words[at[0] : at[-1]] if n else words
    before = np.empty_like(tokens)
    before[:1], before[1:] = END, tokens[:-1]
    return tokens, before, np.append(0, ends + 1)


def _pair(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mix(before * _U(0x9E3779B97F4A7C15) + tokens + _U(1))


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _blocks(keys: np.ndarray, level: int, blocks: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The block of each key at a level, of less than 2**32 blocks, and its hash."""
    h = mix(keys + _LEVELS[level])
    return (h >> _U(32)) * blocks >> _U(32), h


def _probes(level: int) -> int:
    return PROBES if level == 1 else MORE


def _bits_of(h: np.ndarray, words: tuple[int, ...]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each word that is looked at, its number in the block and two bits of it:
    fifteen bits of a hash, the low ones of h for the first three words."""
    more = mix(h + _U(1)) if words[-1] > 2 else h
    for i in words:
        part = (h if i < 3 else more) >> _U(15 * (i % 3))
        yield part & _U(7), (part >> _U(3)) & _U(63), (part >> _U(9)) & _U(63)


def _filter(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Bits of a filter that holds each key at all levels up to its count's."""
    levels = level_of(counts) if len(counts) else np.empty(0, np.int64)
    entries = len(levels) * PROBES + int((levels - 1).sum()) * MORE
    blocks = int(entries * BITS) // 512 + 1
    bits = np.zeros(blocks * 512, bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        block, h = _blocks(keys[levels >= level], level, _U(blocks))
        for word, one, two in _bits_of(h, sum(_ROUNDS[_probes(level)], ())):
            at = block * _U(512) + word * _U(64)
            bits[(at + one).astype(np.int64)] = bits[(at + two).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones, and so on: the high
    bytes of sorted hashes and of small numbers are much the same and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def _from_planes(blob: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _all_planes(blobs: Iterable[bytes]) -> np.ndarray:
    """The hashes of several such arrays, end to end."""
    return np.concatenate([np.empty(0, _U), *(_from_planes(b, _U) for b in blobs)])


def _by_segment(keys: np.ndarray, shift: int) -> tuple[list[int], np.ndarray]:
    """The segments of sorted keys that aren't empty, and where each begins."""
    top = (keys >> _U(64 - shift)).astype(np.int64)
    first = np.flatnonzero(np.append(True, top[1:] != top[:-1])) if len(keys) else np.empty(0, np.int64)
    return top[first].tolist(), np.append(first, len(keys))


def _segment_rows(columns: list[tuple[np.ndarray, ...]], shift: int) -> Iterator[tuple]:
    """(segment, bytes of each array in it, in planes), for groups of arrays that run
    along their sorted first one. Segments of which no group has a key are left out."""
    cut = []
    for arrays in columns:
        segments, at = _by_segment(arrays[0], shift)
        cut.append({s: (a, b) for s, a, b in zip(segments, at, at[1:])})
    for s in sorted(set().union(*cut)):
        yield s, *[_planes(x[slice(*c.get(s, (0, 0)))]) for arrays, c in zip(columns, cut) for x in arrays]


def segments_for(text_bytes: int) -> int:
    """The bits of a hash that tell segments apart: some three bytes of text an entry."""
    return max(6, (text_bytes // 3 // PER_SEGMENT).bit_length())


def counted(docs: DataFrame, shift: int, *, text: str = "text") -> DataFrame:
    """(segment, k1, c1, k2, c2): sorted hashes and counts of words and bigrams of
    about AT_ONCE tokens, in planes; a row for each segment that has some."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones: list = []
        twos: list = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            summed = []
            for x in (ones, twos):
                keys = np.concatenate(x)
                summed.append(_summed(keys, np.ones(len(keys), np.uint32)))
            part: list[tuple] = []
            # Small batches: the JVM's buffers for large ones aren't given back.
            for row in _segment_rows([(k, c.astype(np.uint32)) for k, c in summed], shift):
                part.append(row)
                if len(part) == 64:
                    yield _record(part)
                    part = []
            if part:
                yield _record(part)

        def _record(part: list[tuple]) -> pa.RecordBatch:
            segment, *blobs = zip(*part)
            return pa.RecordBatch.from_arrays([pa.array(segment, pa.int32())] + [pa.array(b, pa.binary()) for b in blobs], ["segment", "k1", "c1", "k2", "c2"])

        for batch in batches:
            for _, _, words, at in word_hashes(batch.column(0)):
                tokens, before, _ = _tokens(words, at)
                ones.append(tokens)
                twos.append(_pair(before, tokens))
                held += len(tokens)
                if held >= AT_ONCE:
                    yield from flush()
                    ones, twos, held = [], [], 0
        if ones:
            yield from flush()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(work, "segment int, k1 binary, c1 binary, k2 binary, c2 binary")


def train(docs: DataFrame, path: str, *, text: str = "text") -> DataFrame:
    """The model: a row per segment (segment, shift, tokens, types, words, counts,
    filter); a segment is the top `shift` bits of a hash."""
    bounded_batches(docs.sparkSession)
    shift = segments_for(docs.agg(F.sum(F.octet_length(text))).first()[0] or 0)

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        def whole(k: str, c: str) -> tuple[np.ndarray, np.ndarray]:
            return _summed(_all_planes(pdf[k]), np.concatenate([_from_planes(b, np.uint32) for b in pdf[c]]).astype(np.int64))

        words, counts = whole("k1", "c1")
        bits = _filter(*whole("k2", "c2"))
        return pd.DataFrame({"segment": [int(pdf["segment"].iloc[0])], "shift": [shift], "tokens": [int(counts.sum())], "types": [len(words)], "words": [words.tobytes()], "counts": [counts.astype(np.int64).tobytes()], "filter": [bits]})

    parts = counted(docs, shift, text=text)
    # An Arrow-based reading of groups would hold no more than this: a segment's arrays.
    model = parts.groupBy("segment").applyInPandas(add_up, "segment int, shift int, tokens long, types long, words binary, counts binary, filter binary")
    return _written(model, path)


class ModelBlock:
    """Segments of a model in rising order, for look-ups. The arrays are views of
    the bytes that came by broadcast, so a worker holds them once."""

    def __init__(self, shift: int, segments: list[int], words: bytes, counts: bytes, bits: bytes, sizes: list[int]):
        self._shift = shift
        self._words = np.frombuffer(words, _U)
        self._counts = np.frombuffer(counts, np.uint32 if len(counts) < len(words) else np.int64)
        self._bits = np.frombuffer(bits, _U)
        self._size = np.zeros((1 << shift) + 1, _U)
        self._start = np.zeros((1 << shift) + 1, _U)
        for segment, n, at in zip(segments, sizes, np.append(0, np.cumsum(sizes))):
            self._size[segment], self._start[segment] = n // 64, at // 8

    def counts(self, words: np.ndarray) -> np.ndarray:
        """Exact counts of distinct words; 0 for what these segments don't hold."""
        if not len(self._words):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self._words, words), len(self._words) - 1)
        return np.where(self._words[at] == words, self._counts[at].astype(np.int64), 0)

    def levels(self, pairs: np.ndarray) -> np.ndarray:
        """The levels up to which the filter holds distinct pairs."""
        out = np.zeros(len(pairs), np.uint8)
        segment = (pairs >> _U(64 - self._shift)).astype(np.int64)
        live = np.flatnonzero(self._size[segment] > 0)
        keys, size, start = pairs[live], self._size[segment[live]], self._start[segment[live]]
        for level in range(1, 256):
            if not len(live):
                break
            block, h = _blocks(keys, level, size)
            line = start + block * _U(8)
            left = np.arange(len(live))
            for words in _ROUNDS[_probes(level)]:
                held = np.ones(len(left), _U)
                for word, one, two in _bits_of(h, words):
                    found = self._bits[(line + word).view(np.int64)]
                    held &= (found >> one) & (found >> two)
                kept = np.flatnonzero((held & _U(1)).view(np.int64))
                if len(kept) < len(left):
                    left, line, h = left[kept], line[kept], h[kept]
            live, keys, size, start = live[left], keys[left], size[left], start[left]
            out[live] = level
        return out


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and the number of each one among them."""
    coded = pa.array(hashes.view(np.int64)).dictionary_encode()
    return coded.dictionary.to_numpy().view(_U), coded.indices.to_numpy()


def _written(df: DataFrame, path: str) -> DataFrame:
    """As saved; what was shuffled for it goes at once, so that the disk holds the
    shuffles of one step and not of all."""
    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = conf.get(key, None)
    conf.set(key, "true")
    try:
        return saved(df, path)
    finally:
        conf.unset(key) if was is None else conf.set(key, was)


RESULT = "n_tokens long, n_known long, base_score double, score double"
_KIND = pa.struct([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


#: The least count of each level.
_LEAST = least_count(np.arange(256))


def _scores(words: np.ndarray, place: np.ndarray, c1: np.ndarray, pair: np.ndarray, q2: np.ndarray, starts: np.ndarray, n: int, v: int, discount: float) -> list[np.ndarray]:
    """n_tokens, n_known, base_score and score of texts end to end. c1 are counts of
    the distinct words, q2 levels of the distinct bigrams; place and pair number the
    word and the bigram of each token. Logarithms are taken once a distinct one."""
    end = int(np.flatnonzero(words == END)[0]) if len(words) else 0
    before = np.append(end, place[:-1])[: len(place)]
    before[starts[:-1]] = end
    some = np.zeros(len(q2), np.int64)
    some[pair] = np.arange(len(pair))  # a token of each bigram
    p1 = (c1 + 0.5) / (n + 0.5 * (v + 1))
    context, least = c1[before[some]], p1[place[some]]
    seen = np.maximum(np.minimum(_LEAST[q2], context) - discount, 0)
    times = np.maximum(context, 1).astype(np.float64)
    best = np.log10(np.where(context > 0, seen / times + discount * times**-SPREAD * least, least))
    sums = [(c1 > 0)[place].astype(np.int64), np.log10(p1)[place], best[pair]]
    return [np.diff(starts), *(np.add.reduceat(x, starts[:-1]) if len(x) else x for x in sums)]


def score(docs: DataFrame, model: DataFrame, *, text: str = "text", discount: float = DISCOUNT, block_bytes: int = BLOCK_BYTES, path: str | None = None) -> DataFrame:
    """docs with n_tokens, n_known, train_tokens, base_score and score added."""
    spark = docs.sparkSession
    bounded_batches(spark)
    held = F.length("words") + F.length("counts") + F.length("filter")
    total = model.agg(F.sum("tokens").alias("n"), F.sum("types").alias("v"), F.max("shift").alias("shift"), F.sum(held).alias("bytes")).first()
    n, v = total["n"] or 0, total["v"] or 0
    shift = total["shift"] or segments_for(0)
    (got,) = unused(docs, "got")
    if (total["bytes"] or 0) <= block_bytes:
        out = docs.withColumn(got, _look_up(_broadcast_model(model, shift), n, v, discount)(F.col(text).cast("string")))
    else:
        whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
        h1, h2 = unused(docs, "h1", "h2")
        rows = docs.select(F.xxhash64(whole).alias("h1"), F.xxhash64(F.lit(1), whole).alias("h2"), whole.alias("text"))
        found = _ask_segments(rows, model, shift, n, v, discount, path or shared_dir(spark))
        names = [f.split()[0] for f in RESULT.split(", ")]
        found = found.groupBy(F.col("h1").alias(h1), F.col("h2").alias(h2)).agg(F.min(F.struct(*names)).alias(got))
        out = docs.withColumns({h1: F.xxhash64(whole), h2: F.xxhash64(F.lit(1), whole)}).join(found, [h1, h2], "left").drop(h1, h2)
    new = {c: F.col(f"{got}.{c}") for c in ("n_tokens", "n_known")}
    return out.withColumns(new | {"train_tokens": F.lit(n).cast("long")} | {c: F.col(f"{got}.{c}") for c in ("base_score", "score")}).drop(got)


def _broadcast_model(segments: DataFrame, shift: int):
    """The model's arrays end to end, gathered a segment at a time."""
    at, sizes = [], []
    words, counts, bits = bytearray(), bytearray(), bytearray()
    for r in segments.select("segment", "words", "counts", "filter").orderBy("segment").toLocalIterator():
        at.append(r["segment"])
        sizes.append(len(r["filter"]))
        words += r["words"]
        counts += r["counts"]
        bits += r["filter"]
    wide = np.frombuffer(counts, np.int64)
    if len(wide) and wide.max() < 1 << 32:
        counts = bytearray(wide.astype(np.uint32).tobytes())
    del wide
    return segments.sparkSession.sparkContext.broadcast((shift, at, words, counts, bits, sizes) if at else None)


def _look_up(shared, n: int, v: int, discount: float):
    @F.arrow_udf(f"struct<{RESULT.replace(' ', ': ').replace(',:', ',')}>")
    def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = ModelBlock(*shared.value) if shared.value else None
        for texts in batches:
            out = [np.empty(0, t) for t in (np.int64, np.int64, np.float64, np.float64)]
            for _, _, words, at in word_hashes(texts):
                tokens, before, starts = _tokens(words, at)
                names, place = _distinct(tokens)
                pairs, pair = _distinct(_pair(before, tokens))
                c1 = block.counts(names) if block else np.zeros(len(names), np.int64)
                q2 = block.levels(pairs) if block else np.zeros(len(pairs), np.uint8)
                out = [np.append(x, y) for x, y in zip(out, _scores(names, place, c1, pair, q2, starts, n, v, discount))]
            yield pa.StructArray.from_arrays([pa.array(x, f.type) for x, f in zip(out, _KIND)], fields=list(_KIND))

    # Not deterministic in name, so that no filter copies the call below itself.
    return look_up.asNondeterministic()


def _parcels(rows: DataFrame) -> DataFrame:
    """(parcel, words, tokens, starts, digests): about AT_ONCE tokens of the texts,
    as numbers of their distinct words, both in planes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        tokens, sizes, digests, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            words, place = np.unique(np.concatenate(tokens), return_inverse=True)
            starts = np.append(0, np.cumsum(np.concatenate(sizes)))
            blobs = [_planes(words), _planes(place.astype(np.uint32)), starts.astype(np.int64).tobytes(), np.concatenate(digests).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([task << 32 | number], pa.int64())] + [pa.array([x], pa.binary()) for x in blobs], ["parcel", "words", "tokens", "starts", "digests"])

        for batch in batches:
            h = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            for lo, hi, words, at in word_hashes(batch.column(2)):
                own, _, starts = _tokens(words, at)
                tokens.append(own)
                sizes.append(np.diff(starts))
                digests.append(h[lo:hi])
                held += len(own)
                if held >= AT_ONCE:
                    yield flush()
                    tokens, sizes, digests, held, number = [], [], [], 0, number + 1
        if tokens:
            yield flush()

    return rows.mapInArrow(work, "parcel long, words binary, tokens binary, starts binary, digests binary")


def _unpacked(words: bytes, tokens: bytes, starts: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a parcel, their numbers token by token, the bigram of each
    token, and where texts begin."""
    names, place, at = _from_planes(words, _U), _from_planes(tokens, np.uint32), np.frombuffer(starts, np.int64)
    flat = names[place]
    before = np.append(END, flat[:-1])
    before[at[:-1]] = END
    return names, place, _pair(before, flat), at


def _runs(sizes: pd.Series, most: int) -> Iterator[slice]:
    """Runs of rows of `most` bytes and the rest of the row that reaches it."""
    before = np.cumsum(sizes.to_numpy(np.int64)) - sizes.to_numpy(np.int64)
    first = np.flatnonzero(np.diff(before // most, prepend=-1))
    for lo, hi in zip(first, np.append(first[1:], len(before))):
        yield slice(int(lo), int(hi))


def _answers(asked: pd.Series, look_up: Callable[[np.ndarray], np.ndarray] | None, kind: type) -> list[bytes]:
    """What look_up says of each row's keys. It is called once, with the distinct
    keys of all rows: a parcel asks a segment for few, and what is asked for by
    many parcels takes the most levels."""
    keys = _all_planes(asked)
    if look_up and len(keys):
        some, back = _distinct(keys)
        found = look_up(some).astype(kind)[back]
    else:
        found = np.zeros(len(keys), kind)
    at = np.append(0, np.cumsum([len(x) // 8 for x in asked], dtype=np.int64)).tolist()
    return [found[a:b].tobytes() for a, b in zip(at, at[1:])]


def _ask_segments(rows: DataFrame, model: DataFrame, shift: int, n: int, v: int, discount: float, path: str) -> DataFrame:
    """(h1, h2, results) of the texts, each segment asked once a parcel."""
    parcels = _written(_parcels(rows), f"{path}/parcels")
    copies = 1 + parcels.count() // PARCELS

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parcel, *blobs in zip(*(c.to_pylist() for c in batch.columns)):
                names, _, pairs, _ = _unpacked(*blobs)
                found = list(_segment_rows([(names,), (np.unique(pairs),)], shift))
                for k in range(0, len(found), 64):
                    segment, words, two = zip(*found[k : k + 64])
                    m = len(segment)
                    yield pa.RecordBatch.from_arrays([pa.array(segment, pa.int32()), pa.array([parcel % copies] * m, pa.int32()), pa.array([parcel] * m, pa.int64()), pa.array(words, pa.binary()), pa.array(two, pa.binary())], ["segment", "copy", "parcel", "asked", "pairs"])

    def answer(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = []
        block = None
        if len(held):
            r = held.iloc[0]
            block = ModelBlock(shift, [r["segment"]], r["words"], r["counts"], r["filter"], [len(r["filter"])])
        for some in _runs(asked["asked"].str.len() + asked["pairs"].str.len(), 8 * AT_ONCE):
            c1 = _answers(asked["asked"].iloc[some], block.counts if block else None, np.int64)
            q2 = _answers(asked["pairs"].iloc[some], block.levels if block else None, np.uint8)
            out.append(pd.DataFrame({"parcel": asked["parcel"].iloc[some], "segment": asked["segment"].iloc[some], "c1": c1, "q2": q2}))
        return pd.concat(out) if out else pd.DataFrame({"parcel": [], "segment": [], "c1": [], "q2": []})

    def finish(parcel: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        r, answers = parcel.iloc[0], answers.sort_values("segment")
        names, place, pairs, at = _unpacked(r["words"], r["tokens"], r["starts"])
        some, back = np.unique(pairs, return_inverse=True)
        # Segments are the hashes' top bits: answers in their order are in the keys' order.
        ones, twos = np.frombuffer(b"".join(answers["c1"]), np.int64), np.frombuffer(b"".join(answers["q2"]), np.uint8)
        if len(ones) != len(names) or len(twos) != len(some):
            raise RuntimeError("a parcel misses answers")
        found = _scores(names, place, ones, back, twos, at, n, v, discount)
        digests = np.frombuffer(r["digests"], np.int64).reshape(-1, 2)
        return pd.DataFrame({"h1": digests[:, 0], "h2": digests[:, 1], **dict(zip(_KIND.names, found))})

    asked = parcels.select("parcel", "words", "tokens", "starts").mapInArrow(split, "segment int, copy int, parcel long, asked binary, pairs binary")
    held = model.select("segment", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "words", "counts", "filter")
    who = ["segment", "copy"]
    answers = asked.groupBy(who).cogroup(held.groupBy(who)).applyInPandas(answer, "parcel long, segment int, c1 binary, q2 binary")
    answers = _written(answers, f"{path}/answers")
    return _written(parcels.groupBy("parcel").cogroup(answers.groupBy("parcel")).applyInPandas(finish, f"h1 long, h2 long, {RESULT}"), f"{path}/scores")
