import corpus_pipeline
import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, function in corpus_pipeline.STAGES[:-1]:
        before = kept
        out = function(spark, docs, SMALL)
        assert out.columns == columns
        docs = corpus_pipeline.stage(out, name)
        rows = docs.collect()
        kept = {r.doc_id: r.text for r in rows}
        assert set(kept) <= set(before) and len(rows) == len(kept)
        if name != "suffixes":
            assert all(before[d] == t for d, t in kept.items())
        assert len(kept) > 0.5 * len(before)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in last} == set(kept)
    assert all(r.round_trip and len(r.ids) == r.n_tokens for r in last)


def test_clean_rows_stay_and_odd_rows_pass(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (None, "no id here at all", "en", "s", 4), (2, "", "en", "s", 0), (3, "word", "en", "s", 4),
            (3, "word", "en", "s", 4), (4, "x " * 40_000, "en", "s", 80_000)]
    docs = spark.createDataFrame(rows, schema)
    for name, function in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stage(function(spark, docs, SMALL), name)
    got = docs.collect()
    assert sorted((r.doc_id or 0) for r in got) == [0, 1, 2, 3, 4]
    assert docs.columns == [c.split()[0] for c in schema.split(", ")]
    empty = spark.createDataFrame([], schema)
    for _, function in corpus_pipeline.STAGES:
        empty = function(spark, empty, SMALL)
    assert empty.count() == 0


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 11)}
    assert corpus_pipeline.ORACLE_SQL is None


def test_columns_with_the_names_used_inside(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _d string, _h int, _spans string, _component int"
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(1, "first text of its own " + passage, "en", "s", 1, "a", 1, "x", 7),
            (2, "another text, another start " + passage + " and an end of quite some more words that differs", "en", "s", 2, "b", 2, "y", 8),
            (3, "first text of its own " + passage, "en", "s", 1, "c", 3, "z", 9)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.drop_near_copies(spark, docs, SMALL)
    assert sorted((r.doc_id, r["_d"], r["_h"], r["_component"]) for r in kept.collect()) == [(1, "a", 1, 7), (2, "b", 2, 8)]
    cut = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, SMALL).collect()}
    assert cut[1].text == rows[0][1] and cut[1].n_chars == 1
    assert "word30" not in cut[2].text and cut[2].text.startswith("another") and cut[2].text.endswith("differs")
    assert cut[2].n_chars == len(cut[2].text) and (cut[2]["_d"], cut[2]["_spans"]) == ("b", "y")
    assert 3 not in cut  # nothing is left of it
