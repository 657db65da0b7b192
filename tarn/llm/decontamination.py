"""Benchmark decontamination: size-partitioned MinHash containment search.

Short test items are looked for inside long documents. Items are partitioned by
their count of shingles, class p holding [2**p, 2**(p + 1)). For each class a
document is seen as overlapping windows of 2**(p + 2) shingles, a half apart,
so an occurrence of an item lies whole in a window at most some eight times as
large, whatever the document's length; the containment threshold so becomes a
bounded resemblance, and ``HASHES`` minima of the window meet one of the item's
but for a chance of under 1e-3 (under 1e-7 for an item that is wholly there).
Minima of windows come from minima of half-size blocks, those of the next class
from the previous one's, so all classes cost little more than the first.

Every pair that shares a minimum is verified by exact shingle containment in
the whole document.

Items travel to the workers in blocks of bounded size, so a large benchmark
costs passes over the documents and not memory. A block is indexed once, on the
driver, and the sorted arrays are broadcast; with several blocks one pass is
written before the next block is sent, so one block is held at a time. There is
no shuffle, hence no skew. ``clean`` drops documents in the pass that searches
them; with several blocks it gathers digests of the texts that hold an item, and
anti-joins on these.

Defined results: an item with fewer words than a shingle is one shingle, its
whole sequence; an item without words, or null, is found nowhere; a null or
empty document holds nothing. Repeated items, and repeated documents, are
reported each. Null ids stay null. ``clean`` judges each row by its own text,
also where ids repeat or are null; it adds no columns and keeps all of any name.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import bounded_batches, saved, shared_dir, unused
from tarn.llm.wordhash import grams, mix, word_hashes

HASHES = 48
#: Code points of item texts in a block.
BLOCK_CHARS = 8 << 20

_U = np.uint64
_SALT = mix(np.arange(501, 501 + HASHES, dtype=_U))
_ODD = mix(np.arange(1501, 1501 + HASHES, dtype=_U)) | _U(1)


def _key(minima: np.ndarray, i: int, p: int) -> np.ndarray:
    return mix(minima ^ mix(np.array([p << 16 | i], _U)))


def _values(shingles: np.ndarray, i: int) -> np.ndarray:
    return (shingles ^ _SALT[i]) * _ODD[i]


class ItemBlock:
    """Some items' shingles, and the keys that lead to them, by size class. What
    is broadcast are arrays of 8 bytes a shingle and some 600 an item."""

    def __init__(self, rows: list[tuple[int | None, str]], n: int):
        self.n, self.ids, self.sets, self.classes = n, [], [], set()
        keys, owners, short = [], [], {}
        for _, _, words, at in word_hashes(pa.array([t for _, t in rows], pa.string())):
            for j in range(len(at) - 1):
                own = words[at[j] : at[j + 1]]
                item_id = rows[len(self.ids)][0]
                s = np.unique(grams(own, n))
                k = len(self.ids)
                self.ids.append(item_id)
                self.sets.append(s)
                if 0 < len(own) < n:
                    short.setdefault(len(own), []).append((int(s[0]), k))
                elif len(s):
                    p = len(s).bit_length() - 1
                    self.classes.add(p)
                    for i in range(HASHES):
                        keys.append(_key(_values(s, i).min(keepdims=True), i, p)[0])
                        owners.append(k)
        order = np.argsort(np.array(keys, _U), kind="stable")
        self.keys, self.owners = np.array(keys, _U)[order], np.array(owners, np.int64)[order]
        self.short = {m: (np.array([h for h, _ in v], _U), np.array([k for _, k in v])) for m, v in short.items()}

    @functools.cached_property
    def maybe(self) -> np.ndarray:
        """By the low bits of a key, whether there may be such a key. Made where
        it is used, once a worker, and never sent."""
        out = np.zeros(1 << min(26, max(16, (len(self.keys) * 64).bit_length())), bool)
        out[(self.keys & _U(len(out) - 1)).astype(np.int64)] = True
        return out

    def _hits(self, shingles: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(first, last, items): ranges of shingles whose windows share minima with items."""
        if not len(self.keys) or not len(shingles):
            return
        top = max(self.classes)
        for i in range(HASHES):
            level = _values(shingles, i)  # minima of blocks of 2**0 shingles
            for p in range(top + 1):
                # blocks of 2**(p + 1): half of the windows of class p
                if len(level) % 2:
                    level = np.append(level, level[-1])
                level = np.minimum(level[0::2], level[1::2])
                if p not in self.classes:
                    continue
                windows = np.minimum(level[:-1], level[1:]) if len(level) > 1 else level
                probe = _key(windows, i, p)
                at = np.flatnonzero(self.maybe[(probe & _U(len(self.maybe) - 1)).astype(np.int64)])
                lo = np.searchsorted(self.keys, probe[at], "left")
                hi = np.searchsorted(self.keys, probe[at], "right")
                for w, a, b in zip(at[hi > lo], lo[hi > lo], hi[hi > lo]):
                    yield int(w) << p + 1, int(w) + 2 << p + 1, self.owners[a:b]

    def matches(self, words: np.ndarray, at: np.ndarray, percent: int) -> Iterator[tuple[int, int, int]]:
        """(text, item, shared shingles) of the items of which a text has at least
        percent / 100. The shingles of all texts stand end to end; a window that
        holds parts of several texts only leads to more to verify."""
        n = self.n
        texts = np.diff(at)
        each = np.maximum(texts - n + 1, 0)
        edge = np.append(0, np.cumsum(each))
        if len(words) >= n:
            whole = np.ones(len(words) - n + 1, bool)
            for k in range(1, n):  # runs that would cross the end of a text
                cut = at[1:-1] - k
                whole[cut[(cut >= 0) & (cut < len(whole))]] = False
            shingles = grams(words, n)[whole]
        else:
            shingles = np.empty(0, _U)
        found: set[tuple[int, int]] = set()
        for first, last, items in self._hits(shingles):
            lo = int(np.searchsorted(edge, first, "right")) - 1
            hi = int(np.searchsorted(edge, min(last, len(shingles)), "left"))
            found.update((d, k) for d in range(lo, hi) if each[d] for k in items.tolist())
        here, text = None, -1
        for d, k in sorted(found):
            if d != text:
                here, text = np.unique(shingles[edge[d] : edge[d + 1]]), d
            own = int(np.isin(self.sets[k], here, assume_unique=True).sum())
            if 100 * own >= percent * len(self.sets[k]):
                yield d, k, own
        for m, (hashes, owners) in self.short.items():
            for d in np.flatnonzero(texts >= m):
                for k in owners[np.isin(hashes, grams(words[at[d] : at[d + 1]], m))].tolist():
                    yield int(d), k, 1


def _item_blocks(items: DataFrame, item_id: str, text: str, chars: int) -> Iterator[list[tuple[int | None, str]]]:
    held, size = [], 0
    for r in items.select(F.col(item_id).cast("long").alias("i"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")).toLocalIterator():
        held.append((r["i"], r["t"]))
        size += len(r["t"])
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


def _each_block(items: DataFrame, item_id: str, text: str, chars: int, shingle: int, search: Callable, path: str) -> DataFrame | None:
    """The union of search(broadcast index) over the blocks of items. A single
    block's search stays lazy; of several each is written before the next is sent."""
    spark = items.sparkSession
    blocks = _item_blocks(items, item_id, text, chars)
    first = next(blocks, None)
    if first is None:
        return None
    out, k, block = None, 0, first
    while block is not None:
        following = next(blocks, None)
        shared = spark.sparkContext.broadcast(ItemBlock(block, shingle))
        found = search(shared)
        if k or following is not None:
            found = saved(found, f"{path}/{k}")
            shared.destroy()
        out = found if out is None else out.unionAll(found)
        block, k = following, k + 1
    return out


def find_items(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, percent: int = 80, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row (doc_id, item_id, item_shingles, shared, containment) for each
    document and item of which it holds at least percent / 100 of the shingles."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = "doc_id long, item_id long, item_shingles long, shared long, containment double"
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def search(shared) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for batch in batches:
                ids = batch.column(0).to_pylist()
                got: list[tuple] = []
                for lo, hi, words, at in word_hashes(batch.column(1)):
                    for d, k, n in own.matches(words, at, percent):
                        got.append((ids[lo + d], own.ids[k], len(own.sets[k]), n, n / len(own.sets[k])))
                if got:
                    cols = list(zip(*got))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if i == 4 else pa.int64()) for i, c in enumerate(cols)], ["doc_id", "item_id", "item_shingles", "shared", "containment"])

        return rows.mapInArrow(work, schema)

    out = _each_block(items, item_id, item_text, block_chars, shingle, search, shared_dir(spark))
    return spark.createDataFrame([], schema) if out is None else out


def _holds_item(shared, percent: int) -> Callable[[Column], Column]:
    """Whether a text holds an item of the block."""

    @F.arrow_udf("boolean")
    def holds(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for texts in batches:
            out = np.zeros(len(texts), bool)
            for lo, _, words, at in word_hashes(texts):
                for d, _, _ in own.matches(words, at, percent):
                    out[lo + d] = True
            yield pa.array(out)

    # Not deterministic in name, so that no filter copies the call below itself.
    return holds.asNondeterministic()


def clean(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = 5, percent: int = 80, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the rows in which an item is found."""
    spark = docs.sparkSession
    bounded_batches(spark)
    whole = F.col(text).cast("string")
    h1, h2 = unused(docs, "h1", "h2")
    digests = [F.xxhash64(whole).alias(h1), F.xxhash64(F.lit(1), whole).alias(h2)]
    only: list = []

    def search(shared) -> DataFrame:
        only.append(shared)
        (dirty,) = unused(docs, "dirty")
        return docs.select(*digests, _holds_item(shared, percent)(whole).alias(dirty)).where(dirty).select(h1, h2).distinct()

    found = _each_block(items, item_id, item_text, block_chars, shingle, search, shared_dir(spark))
    if found is None:
        return docs
    if len(only) == 1:
        return docs.where(~_holds_item(only[0], percent)(whole))
    kept = docs.withColumns({h1: digests[0], h2: digests[1]}).join(found.distinct(), [h1, h2], "left_anti")
    return kept.select(*[kept[c] for c in docs.columns])
