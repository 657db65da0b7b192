"""The pipeline's stages, each on its own input, and as a whole."""

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute


def test_stages_keep_the_columns_of_documents(spark, odd, none, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "no such passage in any of these documents at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns, name
        assert stage(spark, none.select(docs.columns), folder).count() == 0, name


def test_stages_bring_columns_of_any_name_through(spark, odd, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, "no such passage in any of these documents at all")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    names = ["lang_pred", "score", "n_lines", "n_dropped", "n_shingles", "component_id", "kept", "id", "_id", "others", "tag", "out"]
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars", *[F.concat_ws(" ", F.lit(c), F.col("doc_id")).alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        want = stage(spark, odd.select(docs.columns[:5]), folder)
        assert got.columns == docs.columns, name
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())), name
        assert all(r[c] == f"{c} {r.doc_id}" for r in got.where("doc_id is not null").collect() for c in names), name


def test_whole_run_against_plain_stages(spark, tmp_path):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    named = dict(corpus_pipeline.STAGES)
    one = named["language_id"](spark, docs, folder).cache()
    assert one.count() >= 0.97 * docs.where(docs.text.rlike(r"\p{L}")).count()
    two = named["line_dedup"](spark, one, folder).cache()
    plain = brute.dedup_lines([(r.doc_id, r.text) for r in one.collect()])
    want = {i: t for i, (_, dropped, t) in plain.items() if not dropped or t.strip(" \t\n\x0b\x0c\r")}
    assert {r.doc_id: r.text for r in two.collect()} == want
    three = named["minhash_near_dedup"](spark, two, folder).cache()
    groups = brute.near_components(list(want.items()), 5, 80)
    assert {r.doc_id for r in three.collect()} == {i for i, (_, c) in groups.items() if i == c}
    four = named["decontamination"](spark, three, folder).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    left = [(r.doc_id, r.text) for r in three.collect()]
    dirty = {d for d, _ in brute.contained_items(left, items)}
    assert {r.doc_id for r in four.collect()} == {d for d, _ in left} - dirty
    five = named["packing"](spark, four, folder)
    whole = corpus_pipeline.run(spark, folder)
    key = ["doc_id", "start", "length", "ids", "doc_tokens"]
    assert sorted(map(tuple, whole.select(key).collect())) == sorted(map(tuple, five.select(key).collect()))
