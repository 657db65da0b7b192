"""Each operator on odd tables, on an empty one, and against a plain version."""

import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import components, decontamination, fingerprints, language_id, line_dedup, lm_scoring, minhash_dedup, packing, queries, span_dedup, token_counts, training_order
from tarn.llm import wordhash as wh
from tests.llm import brute
from tests.llm.conftest import filler


def by_id(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) for r in df.select("doc_id", *cols).collect()}


# Hashing


def test_word_hashes_agree_whatever_the_batch():
    import pyarrow as pa

    texts = ["A b  c", None, "", "b", " x\ty ", "é " * 3, "long" * 5]
    whole = {}
    for lo, hi, h, at in wh.word_hashes(pa.array(texts)):
        for j in range(hi - lo):
            whole[lo + j] = h[at[j] : at[j + 1]].tolist()
    for i, t in enumerate(texts):
        (_, _, h, _), = list(wh.word_hashes(pa.array([t], pa.string())))
        assert h.tolist() == whole[i] and len(h) == len(brute.words(t))
    assert whole[0][1] == whole[3][0]


def test_texts_longer_than_a_chunk(monkeypatch):
    import pyarrow as pa

    text = filler(9, 400) + " " + "w" * 300 + " end"
    (_, _, want, _, b1, e1), = list(wh.located_words(pa.array([text])))
    monkeypatch.setattr(wh, "CHUNK", 64)
    monkeypatch.setattr(wh, "_powers", [])
    (_, _, got, _, b2, e2), = list(wh.located_words(pa.array([text])))
    keep = [i for i, (b, e) in enumerate(zip(b1, e1)) if e - b <= 32]
    assert b1.tolist() == b2.tolist() and e1.tolist() == e2.tolist()
    assert want[keep].tolist() == got[keep].tolist()


# 1 packing


def test_pieces_are_powers_of_two_and_cover_each_document(odd, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(odd, max_len=64).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0, r.start)):
        assert r.length & (r.length - 1) == 0 and r.length <= 64 and r.offset == 0 and 1 << r.bucket == r.length
        got.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    for d in odd.where("doc_id in (1, 5, 9, 10)").collect():
        want = library.encode(d.text or "", add_special_tokens=False).ids + [1]
        parts = got[d.doc_id, len(want)]
        assert [x for _, ids in parts for x in ids] == want
        assert [s for s, _ in parts] == np.cumsum([0] + [len(i) for _, i in parts])[:-1].tolist()
    assert packing.pack(none).count() == 0
    assert packing.piece_lengths(2048 * 2 + 5, 2048) == [2048, 2048, 4, 1]


def test_buckets_are_laid_out_by_length(spark, small_df, tmp_path):
    pieces = packing.pack(small_df, max_len=256)
    packing.write_buckets(pieces, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    key = ["sequence_id", "doc_id", "start", "length", "ids"]
    assert sorted(map(tuple, back.select(key).collect())) == sorted(map(tuple, pieces.select(key).collect()))
    for b in range(9):
        assert {r.length for r in spark.read.parquet(str(tmp_path / "b" / f"bucket={b}")).select("length").distinct().collect()} == {1 << b}


def test_ids_are_the_librarys_over_the_basic_plane():
    import public_tokenizers
    from tokenizers import Tokenizer

    from tarn.llm.bpe_files import encoder

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plane = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000]
    texts = [f"a{''.join(plane[k : k + 8])} {plane[k]}x {plane[k]}{plane[k]}  1{plane[k]}" for k in range(0, len(plane), 8)]
    texts += ["<|endoftext|>", "a<|endoftext|> b", " " * 2000 + "x", "😀👨‍👩‍👧", "don't I'LL we've", "\r\n\n  \t x"]
    own = encoder("byte_bpe_50k")
    for t in texts:
        assert own.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


# 2 fingerprints


def test_fingerprints_estimate_and_merge(spark, odd, none, small_df, small):
    both = fingerprints.edited(small_df)
    rows = {r.id: r for r in both.select("id", "edited", fingerprints.resemblance(F.col("sketch"), F.col("edited_sketch")).alias("e"), fingerprints.resemblance(F.col("sketch"), F.col("next_sketch")).alias("n"), fingerprints.distinct_shingles(F.col("sketch")).alias("d")).collect()}
    docs = sorted(small, key=lambda d: -d[0])
    for k, (i, t) in enumerate(docs):
        following = docs[(k + 1) % len(docs)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert rows[i].edited == edited
        a, b, c = (brute.shingles(x, 5) for x in (t, edited, following))
        assert abs(rows[i].e - (len(a & b) / len(a | b) if a | b else 1)) < 0.25
        assert abs(rows[i].n - (len(a & c) / len(a | c) if a | c else 1)) < 0.25
        assert len(a) >= 128 or rows[i].d == len(a)
    assert fingerprints.edited(odd).count() >= odd.count() and fingerprints.edited(none).count() == 0
    text = "the quick brown fox jumps over the lazy dog again and again"
    df = spark.createDataFrame([(text, text[:40], text)], "a string, b string, c string")
    for c in "abc":
        df = fingerprints.with_sketch(df, c, f"s{c}", k=4, n=2)
    r = df.select(fingerprints.merge(F.col("sa"), F.col("sb"), k=4).alias("m"), "sa", fingerprints.resemblance(F.col("sa"), F.col("sc"), k=4).alias("one"), fingerprints.containment(F.col("sb"), F.col("sa"), k=4).alias("c")).first()
    assert r.m == r.sa and r.one == 1.0 and 0 < r.c <= 1


def test_sketches_of_parts_merge_to_that_of_the_whole(spark, small):
    parts = [(k % 3, t) for k, (_, t) in enumerate(small[:60])] + [(7, ""), (7, None), (8, "one two"), (None, "three four")] + [(9, small[5][1])] * 40
    df = fingerprints.with_sketch(spark.createDataFrame(parts, "part long, text string"), "text", "sketch", k=64)
    got = {r.part: r.sketch for r in fingerprints.merged(df, "part", k=64).collect()}
    each = {}
    for r in df.collect():
        each.setdefault(r.part, set()).update(r.sketch)
    assert got == {k: sorted(v)[:64] for k, v in each.items()} and got[7] == []


def test_edited_texts_of_repeated_and_missing_ids(odd):
    rows = fingerprints.edited(odd).collect()
    assert len(rows) == odd.count()
    docs = odd.select("doc_id", "text").collect()
    keys = sorted({2**63 - 1 if r.doc_id is None else r.doc_id for r in docs}, reverse=True)
    texts = {}
    for r in docs:
        texts.setdefault(2**63 - 1 if r.doc_id is None else r.doc_id, []).append(r.text or "")
    for r in rows:
        following = min(texts[keys[(keys.index(r.id) + 1) % len(keys)]])
        half = len(r.text) // 2
        assert r.text in texts[r.id] and r.edited == r.text[: len(r.text) - half] + following[:half]


# 3 decontamination


def test_items_are_found_as_by_brute_force(spark, odd, none):
    items = [(k, filler(100 + k, n)) for k, n in enumerate((5, 8, 17, 33, 60, 130))] + [(20, "two words"), (21, None), (22, ""), (None, filler(130, 20)), (23, filler(2, 4000)[500:700])]
    r = random.Random(3)
    docs = []
    for k, (i, t) in enumerate(items):
        if t:
            docs.append((k, filler(200 + k, r.randint(0, 900)) + " " + t.upper() + "\n" + filler(300 + k, r.randint(0, 900))))
            docs.append((100 + k, filler(400 + k, 300) + " " + t[: len(t) // 2] + " " + filler(500 + k, 30)))
    items_df = spark.createDataFrame(items, "item_id long, text string")
    docs_df = spark.createDataFrame(docs, "doc_id long, text string")
    for chars in (1 << 20, 200):
        got = decontamination.find_items(docs_df, items_df, block_chars=chars).collect()
        assert {(x.doc_id, x.item_id): x.shared for x in got} == brute.contained_items(docs, items)
    assert {(x.doc_id, x.item_id) for x in decontamination.find_items(odd, items_df).collect()} == {(9, 23)}
    assert decontamination.find_items(none, items_df).count() == 0 and decontamination.find_items(odd, items_df.limit(0)).count() == 0
    for chars in (1 << 20, 200):
        kept = decontamination.clean(odd, items_df, block_chars=chars)
        assert kept.columns == odd.columns and kept.count() == odd.count() - 1


def test_clean_judges_rows_by_their_own_texts(spark):
    item = filler(130, 20)
    rows = [(None, item), (None, "clean"), (1, item), (1, "clean"), (2, None), (3, item), (3, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, item), (2, filler(131, 30))], "item_id long, text string")
    for chars in (1 << 20, 20):
        got = sorted((r.doc_id or 0, r.text or "") for r in decontamination.clean(docs, items, block_chars=chars).collect())
        assert got == [(0, "clean"), (1, "clean"), (2, "")]
        assert len(decontamination.find_items(docs, items, block_chars=chars).collect()) == 4


# 4 language model


def test_scores_are_exact_bases_and_smoothed_bigrams(spark, small, small_df):
    train = [d for d in small if zlib.crc32(str(d[0]).encode()) % 5 != 1]
    ones, twos = brute.bigram_model(train)
    n, v = sum(ones.values()), len(ones)
    model = lm_scoring.train(spark.createDataFrame(train, "doc_id long, text string"), lm_scoring.shared_dir(spark) + "/m").cache()
    one = {r.doc_id: r for r in lm_scoring.score(small_df, model).collect()}
    many = {r.doc_id: r for r in lm_scoring.score(small_df, model, block_bytes=0).collect()}
    close = 0
    for i, t in small:
        w = [*brute.words(t), None]
        p1 = [(ones[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        assert one[i].n_tokens == len(w) and one[i].n_known == sum(ones[x] > 0 for x in w) and one[i].train_tokens == n
        assert one[i].base_score == pytest.approx(sum(map(math.log10, p1)))
        least = lambda c: math.ceil(1.5 ** (1 + math.floor(math.log(c) / math.log(1.5) + 1e-9) - 1) - 1e-9) if c else 0
        best = sum(math.log10(max(least(twos[a, b]) - 0.8, 0) / ones[a] + 0.8 * ones[a] ** -0.1 * p) if ones[a] else math.log10(p) for a, b, p in zip([None, *w[:-1]], w, p1))
        close += abs(one[i].score - best) <= 0.03 * abs(best)
        assert one[i].score >= best - 1e-6
        assert many[i][2:] == pytest.approx(one[i][2:])
    assert close >= 0.95 * len(small)


def test_segments_answer_as_the_broadcast_model_does(spark, odd, small_df, monkeypatch):
    monkeypatch.setattr(lm_scoring, "AT_ONCE", 3000)
    monkeypatch.setattr(lm_scoring, "PER_SEGMENT", 2000)
    monkeypatch.setattr(lm_scoring, "PARCELS", 4)
    for docs in (odd.select("doc_id", "text", F.lit(1).alias("h1"), F.lit(2).alias("got")), small_df):
        model = lm_scoring.train(docs.where("doc_id % 3 > 0"), lm_scoring.shared_dir(spark) + "/m")
        names = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        one, many = (sorted((tuple(r) for r in lm_scoring.score(docs, model, block_bytes=b).select(names).collect()), key=str) for b in (1 << 30, 0))
        assert len(one) == docs.count() and [x[:4] for x in one] == [x[:4] for x in many]
        assert [y for x in one for y in x[4:]] == pytest.approx([y for x in many for y in x[4:]])
    assert lm_scoring.score(docs.limit(0), model, block_bytes=0).count() == 0


def test_rows_sent_by_training_grow_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "AT_ONCE", 2000)
    monkeypatch.setattr(lm_scoring, "PER_SEGMENT", 20)
    sent = []
    for n in (20, 80):
        docs = spark.createDataFrame([(filler(4000 + k, 1000),) for k in range(n)], "text string").repartition(2)
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
        rows = lm_scoring.counted(docs, lm_scoring.segments_for(size))
        sent.append(rows.count())
        assert rows.where("length(k1) + length(k2) = 0").count() == 0
    assert 3 <= sent[1] / sent[0] <= 5


def test_segments_are_asked_for_many_parcels_at_once(spark, monkeypatch):
    """Look-ups grow with the keys, not with parcels times segments."""
    monkeypatch.setattr(lm_scoring, "AT_ONCE", 3000)
    calls = spark.sparkContext.accumulator(0)

    class Counting(lm_scoring.ModelBlock):
        def levels(self, pairs):
            calls.add(1)
            return lm_scoring.ModelBlock.levels(self, pairs)

    docs = spark.createDataFrame([(k, filler(6000 + k, 500)) for k in range(200)], "doc_id long, text string").repartition(4)
    model = lm_scoring.train(docs.where("doc_id % 3 > 0"), lm_scoring.shared_dir(spark) + "/m")
    one = {r.doc_id: r.score for r in lm_scoring.score(docs, model).collect()}
    monkeypatch.setattr(lm_scoring, "ModelBlock", Counting)
    many = {r.doc_id: r.score for r in lm_scoring.score(docs, model, block_bytes=0).collect()}
    keys = 2 * 200 * 501
    assert model.count() == 64 and many == pytest.approx(one)
    assert 64 <= calls.value <= 64 + keys // 3000


def test_shuffles_of_a_step_go_with_it(spark):
    def shuffled():
        found = [os.path.join(d, x) for top in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString() for d, _, names in os.walk(top) for x in names if x.startswith("shuffle_") and x.endswith(".data")]
        return sum(os.path.getsize(x) for x in found)

    docs = spark.createDataFrame([(k, filler(7000 + k, 500)) for k in range(200)], "doc_id long, text string")
    before = shuffled()
    model = lm_scoring.train(docs, lm_scoring.shared_dir(spark) + "/m")
    lm_scoring.score(docs, model, block_bytes=0)
    assert shuffled() - before < 50_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_planes_hold_all_numbers():
    for x in (np.empty(0, np.uint64), np.array([2**64 - 1, 0, 5], np.uint64), np.arange(70_000, dtype=np.uint32)):
        assert (lm_scoring._from_planes(lm_scoring._planes(x), x.dtype) == x).all()


def test_texts_that_occur_twice_score_higher(spark, small):
    """A copy's bigrams are counted twice, which the discount brings out."""
    docs = [(k, filler(5000 + k, 60)) for k in range(200)] + [(1000 + k, filler(5000 + k, 60)) for k in range(20)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = lm_scoring.score(df, lm_scoring.train(df, lm_scoring.shared_dir(spark) + "/m")).collect()
    mean = {r.doc_id: r.score / r.n_tokens for r in got}
    once = sorted(mean[k] for k in range(20, 200))
    assert sum(mean[k] > once[162] for k in range(20)) >= 18


def test_unseen_bigrams_seldom_pass_the_filter():
    keys = wh.mix(np.arange(1, 320_001, dtype=np.uint64))
    held, unseen = np.sort(keys[:20_000]), keys[20_000:]
    bits = lm_scoring._filter(held, np.ones(len(held), np.int64))
    block = lm_scoring.ModelBlock(1, [0, 1], b"", b"", bits + bits, [len(bits)] * 2)
    assert (block.levels(held) >= 1).all()
    rate = (block.levels(unseen) > 0).mean()
    print(f"false hits: {rate:.6f}")
    assert rate < 2**-10


def test_scores_of_odd_tables(spark, odd, none):
    path = lm_scoring.shared_dir(spark)
    rows = lm_scoring.score(odd, lm_scoring.train(odd, f"{path}/a")).collect()
    assert len(rows) == odd.count() and all(r.n_tokens == len(brute.words(r.text)) + 1 for r in rows)
    assert lm_scoring.score(none, lm_scoring.train(odd, f"{path}/b")).count() == 0
    assert {r.base_score for r in lm_scoring.score(odd, lm_scoring.train(none, f"{path}/c")).where("text is null").collect()} == {0.0}


# 5 line dedup


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_lines_as_by_brute_force(small_df, small, batches):
    got = by_id(line_dedup.dedup_lines(small_df, batches=batches), "n_lines", "n_dropped", "text")
    assert got == brute.dedup_lines(small)


def test_lines_of_odd_tables(odd, none):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_dropped"] and out.count() == odd.count()
    got = by_id(out.where("doc_id is not null"), "n_dropped", "text")
    assert got[2] == (1, "") and got[1][0] == 0 and got[11] == (1, filler(5, 40) + ".\nshort") and got[7] == (0, "one") and got[4] == (0, None)
    assert line_dedup.dedup_lines(none).count() == 0


def test_repeated_rows_and_long_texts_lose_lines_as_one_document(spark):
    line, other = "a line that is long enough", "another line of some length"
    many = "\n".join(f"line number {k}" for k in range(20_000))
    rows = [(1, f"{line}\nx"), (1, f"{line}\nx"), (1, f"{line}\n{other}"), (2, f"{line}\n{line}\nkept by number two"), (2, f"{line}\n{line}\nkept by number two"), (None, f"{other}\nkept by number two"), (3, many), (4, many + "\ntail")]
    got = sorted((r.doc_id or 0, r.n_lines, r.n_dropped, r.text[-20:]) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), batches=3).collect())
    want = [(0, 2, 2, ""), (1, 2, 0, f"{line}\nx"[-20:]), (1, 2, 0, f"{line}\nx"[-20:]), (1, 2, 0, f"{line}\n{other}"[-20:])]
    want += [(2, 3, 2, "kept by number two")] * 2 + [(3, 20_000, 0, many[-20:]), (4, 20_001, 20_000, "tail")]
    assert got == sorted(want)


def test_a_kept_store_drops_lines_of_earlier_calls(spark, small, tmp_path):
    from tarn.llm.first_seen import RunStore

    path, half = f"file://{tmp_path}/store", len(small) // 2
    parts = [spark.createDataFrame(x, "doc_id long, text string") for x in (sorted(small)[:half], sorted(small)[half:])]
    store = RunStore(spark, path, fanout=2)
    one = by_id(line_dedup.dedup_lines(parts[0], store=store), "n_lines", "n_dropped", "text")
    store.close()
    store = RunStore.open(spark, path)
    two = by_id(line_dedup.dedup_lines(parts[1], store=store), "n_lines", "n_dropped", "text")
    assert one | two == brute.dedup_lines(small)
    store.close()
    again = by_id(line_dedup.dedup_lines(parts[1], store=RunStore.open(spark, path)), "n_dropped", "text")
    whole = brute.dedup_lines(small + [(10**6 + i, t) for i, t in small])
    assert again == {i: whole[10**6 + i][1:] for i in again}


# 6 training order


def test_permutation_is_one():
    for size in (1, 2, 3, 10, 1000, 4097):
        slots = training_order.permute(np.arange(size), size, 42)
        assert sorted(slots.tolist()) == list(range(size))
        assert training_order.permute(slots, size, 42, inverse=True).tolist() == list(range(size))
    assert training_order.permute(np.arange(100), 100, 1).tolist() != training_order.permute(np.arange(100), 100, 2).tolist()


def test_shards_round_trip_and_resume(spark, odd, none, tmp_path):
    path, length, per = f"file://{tmp_path}", 64, 16
    manifest = training_order.plan(odd, f"{path}/m", length=length)
    rows, first, total = training_order.ordered(manifest, key=7, per_shard=per, record=training_order.stride(length))
    rows = rows.collect()
    assert sorted(r.slot for r in rows) == list(range(total)) == sorted(r.sequence for r in rows)
    write = lambda: training_order.write_shards(odd, first, total, f"{path}/s", key=7, length=length, per_shard=per)
    write()

    def read():
        files = {int(p.parent.name.split("=")[1]): p.read_bytes() for p in (tmp_path / "s").glob("shard=*/part*")}
        for r in rows:
            record = files[r.shard][r.byte_offset : r.byte_offset + training_order.stride(length)]
            assert zlib.crc32(record[:-1]) == r.ids_crc32 and record[-1:] == b"\n"
        return files

    before = read()
    assert sum(map(len, before.values())) == total * training_order.stride(length)
    import shutil

    shutil.rmtree(next((tmp_path / "s").glob("shard=1")))
    short = next((tmp_path / "s").glob("shard=2/part*"))  # one that a stop has cut off
    short.write_bytes(short.read_bytes()[:100])
    kept = {p: p.stat().st_mtime_ns for p in (tmp_path / "s").glob("shard=*/part*") if p != short}
    write()
    assert read() == before and all(p.stat().st_mtime_ns == t for p, t in kept.items())
    # Each document's ids, from the records in the order of sequences, are the library's.
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    stream = []
    for r in sorted(rows, key=lambda r: r.sequence):
        record = before[r.shard][r.byte_offset :][: 2 * length]
        stream.append((np.frombuffer(record, "<u2")[: r.n_ids].tolist(), r.doc_ids))
    flat = [x for ids, _ in stream for x in ids]
    texts = sorted(library.encode(r.text or "", add_special_tokens=False).ids + [50256] for r in odd.collect())
    cut, got = [], []
    for x in flat:
        cut.append(x)
        if x == 50256:
            got.append(cut)
            cut = []
    assert sorted(got) == texts and not cut
    assert {d for _, ids in stream for d in ids} == {r.doc_id for r in odd.collect()}
    empty = training_order.plan(none, f"{path}/e", length=length)
    assert training_order.ordered(empty, key=7, per_shard=per, record=1)[2] == 0
    # Input of equal counts but other ids writes nothing.
    changed = odd.withColumn("text", F.when(F.col("doc_id") == 9, F.concat(F.lit("X"), F.substring("text", 2, 10**6))).otherwise(F.col("text")))
    with pytest.raises(Exception):
        training_order.write_shards(changed, first, total, f"{path}/x", key=7, length=length, per_shard=per)
    assert not list((tmp_path / "x").glob("shard=*"))
    with pytest.raises(Exception):
        training_order.write_shards(odd, {t: (a, n + 1, c) for t, (a, n, c) in first.items()}, total + 1, f"{path}/x", key=7, length=length, per_shard=per)


def test_a_task_writes_runs_of_whole_shards(spark, odd, tmp_path):
    path, length, per = f"file://{tmp_path}", 64, 16
    _, first, total = training_order.ordered(training_order.plan(odd, f"{path}/m", length=length), key=7, per_shard=per, record=1)
    training_order.write_shards(odd, first, total, f"{path}/s", key=7, length=length, per_shard=per, task_bytes=3 * per * training_order.stride(length))
    tasks = {}
    for p in (tmp_path / "s").glob("shard=*/part*"):
        tasks.setdefault(p.name.split("-")[1], []).append(int(p.parent.name.split("=")[1]))
    n = -(-total // per)
    assert sorted(sorted(x) for x in tasks.values()) == [list(range(a, min(n, a + 3))) for a in range(0, n, 3)]


# 7 language ID


def test_language_of_held_out_texts(spark):
    vocab = {"aa": "der die das und nicht ist ein zu mit auf".split(), "bb": "le la les et ne est un avec sur pas".split(), "cc": "the and not is with on from that this have".split()}
    r = random.Random(5)
    rows = [(k, " ".join(r.choices(vocab[lang], k=r.randint(5, 200))), lang) for k in range(240) for lang in [r.choice(sorted(vocab))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(df.where("doc_id % 4 <> 2"))
    got = language_id.classify(df, model).where("doc_id % 4 = 2")
    assert got.where("lang = lang_pred").count() >= 0.95 * got.count()
    assert all(0 <= x.score <= 1 for x in got.collect())


def test_language_of_odd_tables(odd, none):
    model = language_id.fit(odd)
    assert set(model) == {"en", "de", "fr"} and all(len(x) <= 48 << 10 for x in model.values())
    out = language_id.classify(odd, model, score="sure")
    assert out.count() == odd.count()
    got = {r.doc_id: r.lang_pred for r in out.where("doc_id is not null").collect()}
    assert got[4] == got[5] == got[6] == got[8] == "und" and got[7] != "und"
    assert language_id.fit(none) == {} and {r.lang_pred for r in language_id.classify(odd, {}).collect()} == {"und"}
    assert language_id.classify(none, model).count() == 0
    assert {r.sure for r in language_id.classify(odd, {"en": model["en"]}, score="sure").where("doc_id = 1").collect()} == {1.0}


def test_predictions_as_by_plain_compression(spark, small):
    import zstandard as zstd

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs)
    coders = {}
    for name, raw in model.items():
        how = zstd.ZstdCompressionParameters.from_level(12, source_size=2048, dict_size=len(raw), min_match=3, write_content_size=0, write_checksum=0, write_dict_id=0)
        coders[name] = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=how)
    got = by_id(language_id.classify(docs.drop("lang", "source"), model), "lang_pred", "score")
    held = dict(small)
    for i, (pred, score) in got.items():
        raw = (held[i] or "").lower().encode()
        if not any(c.isalpha() for c in held[i] or ""):
            assert pred == "und" and score == 0
            continue
        sizes = {k: sum(len(c.compress(raw[j : j + 2048])) for j in range(0, len(raw), 2048)) for k, c in coders.items()}
        assert sizes[pred] == min(sizes.values())
        least, second = sorted(sizes.values())[:2]
        assert score == pytest.approx(1 - least / second) or (least == second and 0 <= score < 1 / least)


def test_samples_are_bounded_and_of_the_smallest_hashes(spark, odd):
    docs = spark.range(5000).select(F.concat(F.lit("text of number "), F.col("id")).alias("text"), F.lit("aa").alias("lang"))
    order = F.pmod(F.xxhash64("text"), F.lit(1 << 40))
    want = [r.text for r in docs.orderBy(order).limit(10).collect()]
    assert language_id.fit(docs, docs_per_language=10) == {"aa": "\n".join(want).encode()}
    assert len(language_id.fit(docs, dict_bytes=100)["aa"]) == 100
    with pytest.raises(ValueError):
        language_id.fit(odd, max_languages=2)


def test_a_language_of_copies_keeps_its_dictionary(spark):
    copies = [f"ein satz der nummer {k} von vielen" for k in range(3)]
    few = spark.range(60_000).select(F.element_at(F.array(*map(F.lit, copies)), (F.col("id") % 3 + 1).cast("int")).alias("text"), F.lit("aa").alias("lang"))
    many = spark.range(2000).select(F.concat(F.lit("a sentence with number "), F.col("id")).alias("text"), F.lit("bb").alias("lang"))
    model = language_id.fit(few.unionAll(many))
    assert all(c.encode() in model["aa"] for c in copies) and model["bb"].count(b"\n") == 127


def test_ties_of_short_texts_are_settled(spark):
    model = {"aa": b"und von der und nicht von " * 20, "bb": b"that the and that it with " * 20, "cc": b"pas les sur une est avec " * 20}
    rows = [(1, "Von.", "aa"), (2, "It.", "bb"), (3, "Une", "cc"), (4, "that", "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.classify(df, model)
    assert got.where("lang = lang_pred").count() == 4 == got.where(language_id.accepted(0.0005)).count()


# 8 near-dedup


@pytest.mark.parametrize("n", [2, 5])
def test_components_as_by_brute_force(spark, n):
    r = random.Random(n)
    docs, base = [], [filler(600 + k, r.choice((3, 12, 60, 90))) for k in range(12)]
    for k in range(160):
        w = r.choice(base).split()
        for _ in range(r.randint(0, max(1, len(w) // 12))):
            w[r.randrange(len(w))] = r.choice("qrstuv") * 3
        docs.append((k, " ".join(w)))
    docs += [(500, ""), (501, None), (502, " \n"), (503, "x"), (504, "X")]
    got = by_id(minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle=n), "n_shingles", "component_id")
    assert got == brute.near_components(docs, n, 80)


def test_sets_of_either_scheme_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 3000)
    docs = []
    for k, size in enumerate((1700, 1900, 2100, 2400, 2900)):
        w = filler(700 + k, size).split()
        docs.append((10 * k, " ".join(w)))
        docs.append((10 * k + 1, " ".join(w[: int(size * 0.86)])))
        docs.append((10 * k + 2, " ".join(w[: int(size * 0.70)])))
    got = by_id(minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")), "n_shingles", "component_id")
    assert got == brute.near_components(docs, 5, 80)


def test_blocks_confirm_links_on_full_sets():
    import pandas as pd

    r = np.random.default_rng(8)
    compare = minhash_dedup._block_links(80)
    for size in (45, 90, 900, 9000):
        least = -(-8 * size // 9)  # 80 shared of 100 for sets of equal size
        for short in (0, 1, 2):
            pool = r.integers(0, 2**63, 3 * size).astype(np.uint64) * np.uint64(2)
            a, shared = pool[:size], least - short
            b = np.append(a[:shared], pool[size : 2 * size - shared])
            rows = pd.DataFrame({"id": [1, 2], "label": [1, 2], "query": [True, False], "shingles": [np.sort(x).tobytes() for x in (a, b)]})
            assert len(compare(rows)) == (short == 0), (size, short)


def test_pairs_just_below_the_threshold_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK", 100)  # a query seldom meets a block that holds itself
    docs = []
    for k in range(8):
        w = filler(760 + k, 1100).split()
        far = 100 + k % 3  # of 900 shingles each; 100 is 80 %
        docs += [(10 * k, " ".join(w[:904])), (10 * k + 1, " ".join(w[far : 904 + far]))]
    got = by_id(minhash_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")), "n_shingles", "component_id")
    assert got == brute.near_components(docs, 5, 80)


def test_estimates_are_near():
    r = np.random.default_rng(1)
    pool = wh.mix(r.integers(0, 2**63, 9000).astype(np.uint64))
    a, b = pool[:6000], pool[600:6600]
    want = 5400 / 6600
    large = [minhash_dedup.large_registers(x) for x in (a, b)]
    small = minhash_dedup.small_registers(np.concatenate([a, b]), np.array([0, 6000, 12000]))
    for x, y in (large, small):
        assert abs(minhash_dedup.estimate(x.tobytes(), y.tobytes()) - want) < 0.1


def test_near_dedup_of_odd_tables(odd, none):
    out = minhash_dedup.near_duplicates(odd)
    assert out.columns == [*odd.columns, "n_shingles", "component_id", "kept"] and out.count() == odd.count()
    got = by_id(out.where("doc_id is not null"), "component_id", "kept")
    assert got[1] == (1, True) and got[2] == (1, False) and got[3][0] == 1 and got[7] == (7, True) and got[4] == (4, True)
    assert {(r.component_id, r.kept) for r in out.where("doc_id is null and text is not null").collect()} == {(1, False)}
    assert minhash_dedup.near_duplicates(none).count() == 0


def test_connected_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (200, 3), (None, 5), (300, 299)] + [(400, 400 + k) for k in range(1, 30)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {k: 1 for k in range(1, 41)} | {200: 1, 100: 100, 101: 100, 102: 100, 299: 299, 300: 299} | {400 + k: 400 for k in range(30)}
    assert got == want


# 9 token counts


@pytest.mark.parametrize("extra", [[], ["<|endoftext|>", "x<|endoftext|> y<|endoftext|>", " " * 3000 + "a", "a" * 5000, "é" * 700, "\x1c \x85 　x", "don't I'LL 12,345.67\r\n\r\n  z"]])
def test_token_counts_as_the_library(small, extra):
    from tokenizers import Tokenizer

    texts = [t for _, t in small[:120]] if not extra else extra
    import public_tokenizers

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert token_counts.Counter("byte_bpe_50k.json").count(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_long_unbroken_texts_count_in_time():
    import time

    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    own, r = token_counts.Counter("byte_bpe_50k.json"), random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    blob = "".join(r.choices(letters, k=1_000_000))
    began = time.time()
    got = own.count([blob])
    took = time.time() - began
    print(f"1 MB of letters: {took:.1f} s")
    assert took < 10
    texts = [blob, *("".join(r.choices("etaoin", k=r.randint(400, 1500))) for _ in range(150)), "a" * 5001, "ab" * 3000, "aab" * 1000 + "b" * 777, "漢字" * 900]
    assert got + own.count(texts[1:]) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_token_counts_of_odd_tables(odd, none):
    out = token_counts.with_token_counts(odd)
    assert {r.n_tokens for r in out.where("text is null or text = ''").collect()} == {0}
    assert out.count() == odd.count() and token_counts.with_token_counts(none).count() == 0


# 10 span dedup


def test_spans_as_by_brute_force(small_df, small):
    got = by_id(span_dedup.dedup_spans(small_df), "n_sentences", "n_removed", "text")
    assert got == brute.span_dedup(small)


def test_a_shared_passage_goes_but_once(spark):
    passage = " ".join(f"{filler(800 + k, 11)}." for k in range(6))
    docs = [(k, f"{filler(900 + k, 30)}. {passage} {filler(950 + k, 30)}.") for k in range(4)] + [(9, f"{filler(999, 40)}. {filler(998, 40)}.")]
    got = by_id(span_dedup.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string")), "n_removed", "text")
    assert got[0][0] == 0 and got[9][0] == 0 and all(got[k][0] == 6 and passage not in got[k][1] for k in (1, 2, 3))
    ids = by_id(span_dedup.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string")), "repeats_of")
    assert ids[2] == ([0],) and ids[0] == ids[9] == ([],)
    few = by_id(span_dedup.dedup_spans(spark.createDataFrame(docs, "doc_id long, text string"), filter_bytes=1024), "n_removed", "text")
    assert few == got


def test_passages_inside_sentences_lose_their_whole_sentences(spark, tmp_path):
    long, short = f"{filler(820, 47)}.", f"{filler(821, 6)}. {filler(822, 16)}."
    docs = []
    for k, whole in enumerate((long, short)):
        passage = f"{filler(830 + k, 8)}. {whole} {filler(840 + k, 8)}"
        docs += [(10 * k + j, f"{filler(850 + 10 * k + j, 20)} {passage} {filler(870 + 10 * k + j, 20)}.") for j in range(2)]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = by_id(queries.op10_sentence_span_dedup(spark, str(tmp_path)), "n_removed", "repeats_of")
    assert got == {0: (0, []), 1: (1, [0]), 10: (0, []), 11: (2, [10])}


def test_spans_of_odd_tables(odd, none):
    out = span_dedup.dedup_spans(odd)
    assert out.columns == [*odd.columns, "n_sentences", "n_removed", "repeats_of"] and out.count() == odd.count()
    assert span_dedup.dedup_spans(none).count() == 0


# All


def _applied(spark, docs, name):
    items = spark.createDataFrame([(1, "an item that none of the texts holds at all")], "item_id long, text string")
    model = lambda: lm_scoring.train(docs, lm_scoring.shared_dir(spark) + "/m")
    return {
        "sketch": lambda: fingerprints.with_sketch(docs, "text", "sketch"),
        "clean": lambda: decontamination.clean(docs, items),
        "clean in blocks": lambda: decontamination.clean(docs, items.unionAll(items), block_chars=10),
        "score": lambda: lm_scoring.score(docs, model()),
        "score by segment": lambda: lm_scoring.score(docs, model(), block_bytes=0),
        "lines": lambda: line_dedup.dedup_lines(docs),
        "language": lambda: language_id.classify(docs, language_id.fit(docs)),
        "near": lambda: minhash_dedup.near_duplicates(docs),
        "tokens": lambda: token_counts.with_token_counts(docs),
        "spans": lambda: span_dedup.dedup_spans(docs, min_words=12, alone=25),
    }[name]()


OUTPUTS = {
    "sketch": ["sketch"], "clean": [], "clean in blocks": [], "score": ["n_tokens", "n_known", "train_tokens", "base_score", "score"], "score by segment": ["n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "lines": ["text", "n_lines", "n_dropped"], "language": ["lang_pred", "score"], "near": ["n_shingles", "component_id", "kept"], "tokens": ["n_tokens"], "spans": ["text", "n_sentences", "n_removed", "repeats_of"],
}
HELPERS = "id _id tag _tag own w _w got _got done out lost sources others parcel h1 h2 d1 d2 dirty bucket batch pos key earlier component node rep _judged judged _cut _gone _of _text _c1 _q2 value shard slot".split()


@pytest.mark.parametrize("name", OUTPUTS)
def test_columns_of_any_name_come_back(spark, odd, name):
    clashing = sorted({c for x in OUTPUTS.values() for c in x} - {"text"}) + HELPERS
    docs = odd.select("doc_id", "text", "lang", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in clashing])
    got = _applied(spark, docs, name)
    outputs = OUTPUTS[name]
    assert sorted(got.columns) == sorted(docs.columns if not outputs else {*docs.columns, *outputs})
    plain = _applied(spark, odd.select("doc_id", "text", "lang"), name)
    kept = [c for c in docs.columns if c not in outputs]
    assert sorted(map(str, got.select(kept).collect())) == sorted(map(str, docs.select(kept).collect()))
    if outputs:
        assert sorted(map(str, got.select("doc_id", *outputs).collect())) == sorted(map(str, plain.select("doc_id", *outputs).collect()))


def test_row_makers_ignore_other_columns(spark, odd):
    docs = odd.select("doc_id", "text", *[F.lit(c).alias(c) for c in ["ids", "start", "length", "sequence_id", "offset", "task", "number", "n_ids", "item_id", "shared", "sketch", "edited", "half", "next"]])
    assert sorted(packing.pack(docs).select("doc_id", "start", "ids").collect(), key=str) == sorted(packing.pack(odd).select("doc_id", "start", "ids").collect(), key=str)
    assert fingerprints.edited(docs).count() == docs.count()
    path = lm_scoring.shared_dir(spark)
    assert training_order.plan(docs, f"{path}/a", length=64).count() == training_order.plan(odd, f"{path}/b", length=64).count()
    item = spark.createDataFrame([(1, filler(2, 4000)[500:700])], "item_id long, text string")
    assert decontamination.find_items(docs, item).count() == 1


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    from types import SimpleNamespace

    from tarn.llm import common

    far = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        common.shared_dir(far)
