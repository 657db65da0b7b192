"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens by the vocabulary's pattern. Pre-tokens that the
worker hasn't met yet are laid end to end in one flat array of symbols with a
sequence number each (a ragged array). In each round every sequence finds its
pair of lowest rank and all sequences merge theirs at once, until none has a
pair left; what survives of a sequence is its count. Counts are kept for the
next batches in a table of bounded size.

A pre-token of more than ``LONG`` bytes (a base64 blob, an unspaced page) has as
many rounds as it has different pairs, each over all that is left of it. Such
sequences are held as linked arrays instead, with the places of each rank in a
list of its own: the lowest rank present is merged at all its places at once, as
before, and a round touches no more than these places and their neighbours.

Defined results: a null or empty text has 0 bytes and 0 tokens; the string of
a special token inside a text is one token, as the library's default. Repeated rows are counted each. A column named like the
output is replaced.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.bpe_files import vocabulary
from tarn.llm.common import bounded_batches

#: The pattern of byte-level BPE (a fixed value), with white space spelled out.
_WS = r"\t-\r \x85\xa0  -     　"
PRE_TOKEN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"

#: Pre-tokens whose counts a worker keeps, and bytes merged at once.
KEPT = 400_000
AT_ONCE = 1 << 20
#: Bytes from which a pre-token's pairs are listed by rank.
LONG = 512


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself
    if it prints, else the next one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b if b in prints else next(spare)) for b in range(256)]


class RankMerger:
    """Counts of what BPE leaves of byte strings, many at once."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        # A sentinel at the end keeps every search inside the array.
        self._key = np.append(key[order], np.iinfo(np.int64).max)
        self._rank = np.append(order, len(pairs))
        self._made = made
        self._none = len(pairs)
        self._first = np.array([vocab[c] for c in byte_letters()], np.int64)
        self.special = sorted((t["content"] for t in spec.get("added_tokens", ())), key=len, reverse=True)

    def _ranks(self, sym: np.ndarray, seq: np.ndarray) -> np.ndarray:
        """The rank of each neighbouring pair; none at the end of a sequence."""
        key = sym[:-1] << 32 | sym[1:]
        at = np.searchsorted(self._key, key)
        return np.where((self._key[at] == key) & (seq[:-1] == seq[1:]), self._rank[at], self._none)

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Counts of what is left of each; none of the words is empty."""
        long = np.array([len(w) > LONG for w in words], bool)
        out = np.zeros(len(words), np.int64)
        for which, count in ((long, self._by_rank), (~long, self._by_round)):
            if which.any():
                out[which] = count([words[i] for i in np.flatnonzero(which)])
        return out

    def _by_rank(self, words: list[bytes]) -> np.ndarray:
        lengths = np.array([len(w) for w in words], np.int64)
        n, starts = int(lengths.sum()), np.append(0, np.cumsum(lengths))
        # Place n is no symbol's: what stands before the first and after the last.
        sym = np.append(self._first[np.frombuffer(b"".join(words), np.uint8)], -1)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[starts[1:] - 1] = before[starts[:-1]] = after[n] = n
        held = np.ones(n, bool)
        places: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def ranks(at: np.ndarray) -> np.ndarray:
            right = sym[after[at]]
            key = sym[at] << 32 | right
            found = np.searchsorted(self._key, key)
            return np.where((self._key[found] == key) & (right >= 0), self._rank[found], self._none)

        def note(at: np.ndarray) -> None:
            rank = ranks(at)
            at, rank = at[rank < self._none], rank[rank < self._none]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            heads = np.flatnonzero(np.append(True, rank[1:] != rank[:-1])) if len(rank) else rank
            for r, lo, hi in zip(rank[heads].tolist(), heads.tolist(), [*heads[1:].tolist(), len(rank)]):
                if r not in places:
                    places[r] = []
                    heapq.heappush(heap, r)
                places[r].append(at[lo:hi])

        note(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[held[at]]
            at = at[ranks(at) == r]  # some have gone into other pairs since
            if not len(at):
                continue
            fresh = np.append(True, after[at[:-1]] != at[1:])
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run) % 2 == 0]
            right = after[at]
            sym[at] = self._made[r]
            held[right] = False
            after[at] = after[right]
            before[after[at]] = at
            before[n] = after[n] = n
            near = before[at]
            note(np.unique(np.append(at, near[near < n])))
        return np.add.reduceat(held.astype(np.int64), starts[:-1])

    def _by_round(self, words: list[bytes]) -> np.ndarray:
        lengths = np.array([len(w) for w in words], np.int64)
        out = lengths.copy()
        sym = self._first[np.frombuffer(b"".join(words), np.uint8)]
        seq = np.repeat(np.arange(len(words)), lengths)
        while len(sym) > 1:
            rank = self._ranks(sym, seq)
            heads = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            lowest = np.minimum.reduceat(np.append(rank, self._none), heads)
            group = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(sym))))
            live = lowest < self._none
            if not live.any():
                break
            hit = (rank == lowest[group[:-1]]) & (rank < self._none)
            # Of overlapping hits, as in "aaa", every second one merges.
            at = np.flatnonzero(hit)
            fresh = np.append(True, np.diff(at) > 1)
            start = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
            at = at[(at - start) % 2 == 0]
            sym[at] = self._made[rank[at]]
            np.subtract.at(out, seq[at], 1)
            keep = live[group]  # sequences without a pair are done
            keep[at + 1] = False
            sym, seq = sym[keep], seq[keep]
        return out


class Counter:
    """Counts tokens of texts, keeping those of pre-tokens met before."""

    def __init__(self, name: str):
        import regex

        self._merger = RankMerger(vocabulary(name))
        self._cut = regex.compile(PRE_TOKEN)
        self._special = regex.compile("|".join(map(regex.escape, self._merger.special))) if self._merger.special else None
        self._known: dict[str, int] = {}

    def _learn(self, words: list[str]) -> None:
        held: list[bytes] = []
        names: list[str] = []
        size = 0

        def flush() -> None:
            self._known.update(zip(names, self._merger.counts(held).tolist()))

        for w in words:
            held.append(w.encode())
            names.append(w)
            size += len(held[-1])
            if size >= AT_ONCE:
                flush()
                held, names, size = [], [], 0
        if held:
            flush()

    def count(self, texts: list[str | None]) -> list[int]:
        cut, known = self._cut.findall, self._known
        out, words, owner = [], [], []
        for t in texts:
            parts, n = [t or ""], 0
            if self._special and t and (found := self._special.findall(t)):
                parts, n = self._special.split(t), len(found)
            out.append(n)
            owner.append([w for p in parts for w in cut(p)])
        if len(known) > KEPT:
            known.clear()
        new = set().union(*owner) - known.keys() if owner else set()
        self._learn(list(new))
        get = known.__getitem__
        return [n + sum(map(get, words)) for n, words in zip(out, owner)]


@functools.cache
def counter(name: str) -> Counter:
    return Counter(name)


def with_token_counts(docs: DataFrame, *, text: str = "text", out: str = "n_tokens", name: str = "byte_bpe_50k.json") -> DataFrame:
    """docs with a column of token counts for the vocabulary file `name`."""
    bounded_batches(docs.sparkSession)

    @F.pandas_udf(T.LongType())
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = counter(name)
        for texts in batches:
            got: list[int] = []
            held, size = [], 0
            for t in texts:
                held.append(t)
                size += len(t or "")
                if size > 1 << 20:
                    got += own.count(held)
                    held, size = [], 0
            got += own.count(held)
            yield pd.Series(got, dtype="int64")

    # Not deterministic in name, so that no filter copies the call below itself.
    counted = counted.asNondeterministic()
    return docs.withColumn(out, counted(F.col(text).cast("string")))
