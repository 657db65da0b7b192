"""Packing by power-of-two decomposition.

A document's ids, with an end id appended, are cut into pieces whose lengths
are powers of two: as many of ``max_len`` as fit, then the binary digits of the
rest from large to small. Each piece is a sequence of its own, so no sequence
holds two documents and none needs padding; sequences of one length form a
bucket, from which a trainer draws whole batches. ``write_buckets`` lays them out
so, a folder a bucket.

``sequence_id`` is bucket, then the task's number, then a running number, so
that the sequences of one bucket are consecutive ids and all ids are unique.
It needs no shuffle: a task that is run again reads the same rows in the same
order and assigns the same ids.

Defined results: a null or empty text is the end id alone (one piece of length
1). Repeated rows are packed once each. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.bpe_files import encoder
from tarn.llm.common import bounded_batches

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, bucket int"


def piece_lengths(n: int, max_len: int) -> list[int]:
    """Powers of two, in falling order, that add up to n."""
    out = [max_len] * (n // max_len)
    rest = n % max_len
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, *, max_len: int = 2048, end_id: int = 1, stem: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: ``ids`` holds little-endian unsigned 32-bit ids,
    ``start`` the document's ids before it, ``doc_tokens`` all of them with the
    end id, ``bucket`` the logarithm of its length."""
    if max_len & (max_len - 1):
        raise ValueError("max_len must be a power of two")
    bounded_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        from pyspark import TaskContext

        encode, task = encoder(stem).encode, TaskContext.get().partitionId()
        running = [0] * 32
        kinds = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32()]
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        cols: list[list] = [[] for _ in names]
        held = 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                raw, at = ids.tobytes(), 0
                for n in piece_lengths(len(ids), max_len):
                    b = n.bit_length() - 1
                    seq = b << 58 | task << 34 | running[b]
                    running[b] += 1
                    for c, v in zip(cols, (doc, at, n, raw[4 * at : 4 * (at + n)], len(ids), seq, 0, b)):
                        c.append(v)
                    at += n
                held += len(raw)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)
                    cols, held = [[] for _ in names], 0
        if cols[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, SCHEMA)


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes pieces as Parquet, a folder ``bucket=b`` for each length 2**b. Each
    task sorts its own rows by bucket, so it has one file open at a time and
    nothing is shuffled."""
    pieces.sortWithinPartitions("bucket", "sequence_id").write.partitionBy("bucket").parquet(path)
