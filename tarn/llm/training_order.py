"""Training-order materialisation of token sequences.

Texts are encoded, each followed by an end id, and every task cuts its stream
of ids into sequences of ``length`` (the last one of a task is padded). All
sequences are numbered; a keyed Feistel network on the least even-bit domain
that holds the numbers, walked along its cycle until the value is in range,
is a permutation, and gives every sequence its global slot: no sort by a random
key, and any slot can be computed, or inverted, by itself.

Slots are cut into shards of ``per_shard`` neighbours. A shard is one binary
file of fixed stride: record k holds slot shard * per_shard + k as little-endian
ids and one terminating byte (Spark's own file writers, which commit tasks and
reach any file system, put it there). A reader seeks to ``k * stride`` and goes
on from any slot.

Two passes encode the texts: the first keeps a short row a sequence (the
manifest), the second writes. Encoding again costs less disk than keeping all
ids beside their shuffle and the shards. Both passes read the same files in the
same splits; each task of the second one compares the chained CRC of all its
sequences with the manifest's before it ends, so changed input fails the job
before anything is written. Records go to range partitions: slots are even over
their range, so the bounds are known, every partition is a run of whole shards
of about ``task_bytes``, and nothing is sampled. A task's shards come into place
when it commits; a stopped job leaves those of the tasks that are done, and
writing again leaves out all shards that are there in full length.

Defined results: a null or empty text is its end id. Repeated rows are encoded
each. An empty table has no sequences and no shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.bpe_files import encoder
from tarn.llm.common import bounded_batches, saved
from tarn.llm.wordhash import mix

ROUNDS = 6
_U = np.uint64


def permute(index: np.ndarray, size: int, key: int, *, inverse: bool = False) -> np.ndarray:
    """The keyed permutation of range(size), or its inverse, at index."""
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = _U((1 << half) - 1)
    keys = mix(np.arange(1, ROUNDS + 1, dtype=_U) + _U(key & (2**64 - 1)))

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> _U(half), x & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (mix(right ^ k) & mask)
        return left << _U(half) | right

    out = once(np.asarray(index, _U))
    while len(at := np.flatnonzero(out >= _U(size))):
        out[at] = once(out[at])
    return out.astype(np.int64)


#: Bytes of shards that one task sorts and writes.
TASK_BYTES = 128 << 20


def _sequences(batches: Iterator[pa.RecordBatch], length: int, end_id: int, stem: str) -> Iterator[tuple[np.ndarray, int, list]]:
    """(ids, how many are real, doc ids) of one task's sequences."""
    encode = encoder(stem).encode
    buffer, fill, docs = np.zeros(length, np.uint32), 0, []
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids = np.append(encode(text.as_py() or ""), end_id)
            at = 0
            while at < len(ids):
                n = min(length - fill, len(ids) - at)
                buffer[fill : fill + n] = ids[at : at + n]
                fill, at = fill + n, at + n
                docs.append(doc)
                if fill == length:
                    yield buffer, fill, docs
                    buffer, fill, docs = np.zeros(length, np.uint32), 0, []
    if fill:
        yield buffer, fill, docs


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def plan(docs: DataFrame, path: str, *, length: int = 2048, end_id: int | None = None, stem: str = "byte_bpe_50k") -> DataFrame:
    """First pass: a row (task, number, n_ids, doc_ids, ids_crc32, chained) per
    sequence, saved at path; chained is the CRC of the task's ids so far."""
    bounded_batches(docs.sparkSession)
    dtype, end = _dtype(stem), _end(stem, end_id)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        task, kinds = TaskContext.get().partitionId(), [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
        kinds.append(pa.int64())
        held: list[tuple] = []
        names, chained = ["task", "number", "n_ids", "doc_ids", "ids_crc32", "chained"], 0
        for number, (ids, n, own) in enumerate(_sequences(batches, length, end, stem)):
            raw = ids.astype(dtype).tobytes()
            chained = zlib.crc32(raw, chained)
            held.append((task, number, n, own, zlib.crc32(raw), chained))
            if len(held) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return saved(_rows(docs).mapInArrow(work, "task int, number long, n_ids long, doc_ids array<long>, ids_crc32 long, chained long"), path)


def _dtype(stem: str) -> str:
    return "<u2" if encoder(stem).n_ids <= 1 << 16 else "<u4"


def _end(stem: str, end_id: int | None) -> int:
    return encoder(stem).n_ids - 1 if end_id is None else end_id


def stride(length: int, stem: str = "byte_bpe_50k") -> int:
    return length * np.dtype(_dtype(stem)).itemsize + 1


def ordered(manifest: DataFrame, *, key: int, per_shard: int, record: int) -> tuple[DataFrame, dict[int, tuple[int, int, int]], int]:
    """The manifest with sequence, slot, shard and byte_offset; by task its first
    number, its count and its chained CRC; and the count of all. Three numbers a
    task come to the driver."""
    tasks = manifest.groupBy("task").agg(F.count("*").alias("n"), F.max(F.struct("number", "chained")).alias("last"))
    counts = {r["task"]: (r["n"], r["last"]["chained"]) for r in tasks.collect()}
    first, total = {}, 0
    for t in sorted(counts):
        first[t] = (total, *counts[t])
        total += counts[t][0]
    starts = {t: a for t, (a, _, _) in first.items()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index = np.array([starts[t] for t in b.column(0).to_pylist()], np.int64) + b.column(1).to_numpy()
            slot = permute(index, total, key)
            new = [index, slot, slot // per_shard, slot % per_shard * record]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in new] + [b.column(k) for k in (2, 3, 4)], ["sequence", "slot", "shard", "byte_offset", "n_ids", "doc_ids", "ids_crc32"])

    return manifest.mapInArrow(work, "sequence long, slot long, shard long, byte_offset long, n_ids long, doc_ids array<long>, ids_crc32 long"), first, total


def finished(spark, path: str, total: int, per_shard: int, record: int) -> list[int]:
    """Shards that an earlier run has left in the folder in full length. What is
    there of others is removed."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    out = []
    for s in fs.listStatus(folder):
        name = s.getPath().getName()
        if not s.isDirectory() or not name.startswith("shard="):
            continue
        shard = int(name.split("=")[1])
        parts = [f.getLen() for f in fs.listStatus(s.getPath()) if f.getPath().getName().startswith("part-")]
        if parts == [min(per_shard, total - shard * per_shard) * record]:
            out.append(shard)
        else:
            fs.delete(s.getPath(), True)
    return sorted(out)


def write_shards(docs: DataFrame, first: dict[int, tuple[int, int, int]], total: int, path: str, *, key: int, length: int = 2048, per_shard: int = 4096, end_id: int | None = None, stem: str = "byte_bpe_50k", task_bytes: int = TASK_BYTES) -> None:
    """Second pass: writes the shards that aren't in the folder yet."""
    bounded_batches(docs.sparkSession)
    dtype, end, record = _dtype(stem), _end(stem, end_id), stride(length, stem)
    done = np.array(finished(docs.sparkSession, path, total, per_shard, record), np.int64)
    n_shards = -(-total // per_shard)
    if len(done) >= n_shards:
        return
    run = max(1, task_bytes // (per_shard * record))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        start, count, want = first.get(task, (0, 0, 0))
        number, held, chained = 0, [], 0

        def flush() -> pa.RecordBatch:
            slot = permute(np.arange(start + number - len(held), start + number), total, key)
            shard = slot // per_shard
            keep = ~np.isin(shard, done)
            rows = [x for x, k in zip(held, keep) if k]
            return pa.RecordBatch.from_arrays([pa.array(shard[keep]), pa.array(slot[keep]), pa.array(rows, pa.binary())], ["shard", "slot", "value"])

        for ids, _, _ in _sequences(batches, length, end, stem):
            if number == count:
                break
            held.append(ids.astype(dtype).tobytes())
            chained = zlib.crc32(held[-1], chained)
            number += 1
            if len(held) == 512:
                yield flush()
                held = []
        else:
            if number == count and chained == want:
                if held:
                    yield flush()
                return
        raise RuntimeError(f"task {task} has other sequences than the {count} planned: its input has changed")

    rows = _rows(docs).mapInArrow(work, "shard long, slot long, value binary")
    part = F.floor(F.col("shard") / run).cast("int")
    laid = rows.repartitionById(-(-n_shards // run), part).sortWithinPartitions("shard", "slot")
    out = laid.select("shard", F.col("value").cast("string").alias("value")).write.mode("append").partitionBy("shard")
    # Version 2 moves a task's files into place when the task commits.
    out = out.option("mapreduce.fileoutputcommitter.algorithm.version", "2")
    out.option("lineSep", "\n").option("compression", "none").text(path)
