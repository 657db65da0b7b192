"""Language ID by compression.

Each language has a zstandard raw-content dictionary cut from labelled text. A
text is cut into short pieces, each piece is compressed once per dictionary,
and the language whose total is smallest wins; the pieces are short, so that
the dictionary and not the text itself explains most of what follows. All of
the text is compressed. The margin between the two smallest totals, as a share
of the larger one, is the score; a caller may reject texts whose margin is
narrow. Where totals tie, as whole bytes of short texts often do, the
dictionaries' counts of the first piece's ``GRAM``-byte strings decide; their
difference, as bytes and below one, is the margin.

Fitting takes a bounded sample: per language the texts with the smallest hash,
``docs_per_language`` of them, the first ``snippet_chars`` of each, and at most
``dict_bytes`` in all. Equal texts count once, so a language of many copies
keeps its snippets; every language of a labelled text with a letter gets a
dictionary, or fitting raises. Languages are few: their names and counts come to
the driver, and more than ``max_languages`` raise.

Defined results: a null text, and a text without a letter, is ``und`` with
score 0. With a single learned language the score is 1. With no labelled row at
all every text is ``und``. Ties that the counts leave go to the language that
sorts first. Rows are never merged or dropped. Columns named like the two
outputs are replaced, other columns of any name are kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import bounded_batches, unused

UNDETERMINED = "und"
#: Bytes compressed at once, the effort, and the shortest match.
PIECE, LEVEL, MIN_MATCH = 2048, 12, 3
#: Bytes of the strings that are counted where totals tie.
GRAM = 3
#: The least margin at which a prediction is accepted. Chosen on training folds,
#: where margins up to ten times as large reject nothing and larger ones only
#: right predictions; so it rejects texts of which no dictionary explains more.
MARGIN = 0.0005


def finer_cost(raw: bytes, dictionary: bytes) -> float:
    """Bytes that coding the strings of raw by their counts in dictionary takes."""
    padded, held = b" " + raw + b" ", b" " + dictionary + b" "
    grams = [padded[k : k + GRAM] for k in range(max(1, len(padded) - GRAM + 1))]
    return -sum(math.log2((held.count(g) + 0.5) / (len(held) + 0.5)) for g in grams) / 8 / GRAM


def fit(docs: DataFrame, *, text: str = "text", label: str = "lang", dict_bytes: int = 48 << 10, docs_per_language: int = 128, snippet_chars: int = 1500, max_languages: int = 1000) -> dict[str, bytes]:
    """Dictionaries by language. At most about 3 * docs_per_language snippets
    per language reach the driver, whatever the size of docs."""
    rows = docs.select(F.col(text).alias("t"), F.col(label).cast("string").alias("l")).where(F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    # Distinct texts, as copies share a hash: a language of copies keeps its snippets.
    counts = {r["l"]: max(1, r["n"]) for r in rows.groupBy("l").agg(F.approx_count_distinct(F.xxhash64("t")).alias("n")).limit(max_languages + 1).collect()}
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if not counts:
        return {}
    one = 1 << 40
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(one, one * 2 * docs_per_language // n + 1))])
    order = F.pmod(F.xxhash64("t"), F.lit(one))
    taken = rows.where(order < rate[F.col("l")]).select("l", order.alias("o"), F.substring("t", 1, snippet_chars).alias("s")).groupBy("l", "o").agg(F.min("s").alias("s")).collect()
    by: dict[str, list[tuple[int, str]]] = {k: [] for k in counts}
    for r in taken:
        by[r["l"]].append((r["o"], r["s"]))
    out = {}
    for k in sorted(by):
        snippets = [s for _, s in sorted(by[k])[:docs_per_language]]
        out[k] = "\n".join(snippets).lower().encode()[:dict_bytes]
    if lost := [k for k, v in out.items() if not v]:
        raise RuntimeError(f"no sample of {lost}: the rows have changed meanwhile")
    return out


def classify(docs: DataFrame, model: dict[str, bytes], *, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns pred and score added. The model is as large as its
    dictionaries, at most ``dict_bytes`` a language, and travels by broadcast."""
    bounded_batches(docs.sparkSession)
    names = sorted(model)
    shared = docs.sparkSession.sparkContext.broadcast([model[k] for k in names])

    @F.pandas_udf(T.StructType([T.StructField("p", T.IntegerType()), T.StructField("s", T.DoubleType())]))
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import numpy as np

        import zstandard as zstd

        coders = []
        for raw in shared.value:
            how = zstd.ZstdCompressionParameters.from_level(LEVEL, source_size=PIECE, dict_size=len(raw), min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0)
            d = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            coders.append(zstd.ZstdCompressor(dict_data=d, compression_params=how))
        for texts in batches:
            best = np.full(len(texts), -1, np.int32)
            sure = np.zeros(len(texts))
            for i, t in enumerate(texts):
                if t is None or not coders:
                    continue
                raw = t.lower().encode()
                pieces = [raw[k : k + PIECE] for k in range(0, len(raw), PIECE)] or [raw]
                sizes = [sum(len(c.compress(x)) for x in pieces) for c in coders]
                tied = [j for j, x in enumerate(sizes) if x == min(sizes)]
                if len(tied) > 1:
                    finer = {j: finer_cost(pieces[0], shared.value[j]) for j in tied}
                    for j in tied:  # less than a byte, so other totals keep their places
                        sizes[j] += min(finer[j] - min(finer.values()), 0.99)
                k = min(range(len(sizes)), key=sizes.__getitem__)
                best[i] = k
                rest = [s for j, s in enumerate(sizes) if j != k]
                sure[i] = 1.0 if not rest else 1 - sizes[k] / min(rest)
            yield pd.DataFrame({"p": best, "s": sure})

    # Not deterministic in name, so that no filter copies the call below itself.
    judge = judge.asNondeterministic()
    names_col = F.array(*[F.lit(x) for x in names]) if names else F.array(F.lit(UNDETERMINED))
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    (own,) = unused(docs, "_judged")
    out = docs.withColumn(own, judge(F.when(lettered, F.col(text).cast("string"))))
    known = F.col(f"{own}.p") >= 0
    return out.withColumns({pred: F.when(known, F.get(names_col, F.col(f"{own}.p"))).otherwise(UNDETERMINED), score: F.when(known, F.col(f"{own}.s")).otherwise(F.lit(0.0))}).drop(own)


def accepted(margin: float = MARGIN, *, pred: str = "lang_pred", score: str = "score") -> Column:
    """True where the language is known and its margin is at least `margin`."""
    return (F.col(pred) != UNDETERMINED) & (F.col(score) >= margin)
