from __future__ import annotations

import pandas as pd

import __spark_entry__ as entry
import corpus_pipeline
from textloom.llm import minhash
from textloom.llm.common import materialise

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    """Each stage on what the one before it kept: columns stay, decisions hold, and the last packs every row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts, ids = docs.columns, [docs.count()], [{r["doc_id"] for r in docs.select("doc_id").collect()}]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF), f"test-{name}")
        counts.append(docs.count())
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "packing":
            assert docs.columns == columns
        if name == "near_duplicates":
            again = minhash.near_duplicates(docs).where("not kept").count()
            assert again == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mixing", "packing"]
    assert ids[0] >= ids[1] >= ids[2] >= ids[3] == ids[4]
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    clean = set(labels[(labels["toxic"] == 0) & (labels["quality"] == 1)]["doc_id"])
    assert len(clean - ids[1]) <= 0.02 * len(clean)


def test_odd_rows_pass(spark):
    rows = [(None, "one two three four five six", "en", "a", 1), (1, None, "en", None, 0), (2, "", "en", "a", 0), (3, "x y z", "en", "a", 5), (3, "x y z", "en", "a", 5), (4, "x y z", "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = materialise(corpus_pipeline.drop_near_duplicates(spark, materialise(docs, "in"), SF), "kept")
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 3), (True, 0)]
    mixed = materialise(corpus_pipeline.mix_sources(spark, kept, SF), "mixed")
    assert corpus_pipeline.pack_sequences(spark, mixed, SF).count() == mixed.count()
    empty = materialise(docs.where("false"), "empty")
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, empty, SF).count() == 0


def test_empty_tables_long_texts_and_clashing_columns(spark):
    """Every stage on an empty table, on texts of thousands of words, and beside columns of the stages' own names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, ROW_number long, rejected string, copy int, copies int, rate double, size int"
    long = " ".join(f"w{i % 900}" for i in range(30_000))
    rows = [(1, long, "en", "a", 1, 7, "x", 1, 2, 0.5, 3), (2, long + " more", "en", "a", 1, 7, "x", 1, 2, 0.5, 3), (None, None, None, None, None, None, None, None, None, None, None), (3, "a b c d e f g", "en", "b", 1, 8, "y", 1, 2, 0.5, 3)]
    for given, kept in ((rows, [None, 1, 3]), ([], [])):
        docs = materialise(spark.createDataFrame(given, schema), "in")
        for name, stage in corpus_pipeline.STAGES:
            before = docs
            docs = materialise(stage(spark, docs, SF), f"odd-{name}")
            if name != "packing":
                assert docs.columns == before.columns
            if name == "near_duplicates":
                assert sorted((r["doc_id"] for r in docs.collect()), key=lambda x: (x is not None, x)) == kept
                for r in docs.where("doc_id = 1").collect():
                    assert tuple(r) == rows[0]


def test_rows_that_share_an_id(spark):
    """Unlike texts of one id both stay; a copy of another document goes, though its id has a row that stays."""
    rows = [(1, "a b c d e f", "en", "a", 5), (1, "g h i j k l", "en", "a", 5), (2, "A b c d e f", "en", "a", 5), (2, "m n o p q r", "en", "a", 5)]
    docs = materialise(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "in")
    got = sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect())
    assert got == [(1, "a b c d e f"), (1, "g h i j k l"), (2, "m n o p q r")]


def test_texts_stay_where_they_are(spark, monkeypatch):
    """Rows are repeated as told, in stretches or by a shuffle; in stretches no text goes through an exchange."""
    monkeypatch.setattr(corpus_pipeline, "STRETCH", 8)
    docs = spark.range(100).selectExpr("id doc_id", "concat('text ', id) text", "id stretch", "'x' n").repartition(3)
    numbered, row = corpus_pipeline._numbered(docs)
    counts = numbered.selectExpr(f"{row} key", "doc_id % 4 n")
    want = sorted((i, f"text {i}", i, "x") for i in range(100) for _ in range(i % 4))
    for shared in (1 << 24, 10):
        monkeypatch.setattr(corpus_pipeline, "SHARED", shared)
        got = corpus_pipeline._repeated(numbered, row, counts)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        monkeypatch.setattr(corpus_pipeline, "SHARED", 1 << 24)
        for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.mix_sources):
            plan = stage(spark, spark.read.parquet(f"{SF}/documents.parquet"), SF)._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
