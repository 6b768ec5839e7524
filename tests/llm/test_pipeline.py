"""The pipeline, stage by stage, on documents with planted cases."""

import hashlib

import pyarrow.parquet as pq

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    documents = pq.read_table(f"{SF}/documents.parquet").slice(0, 300).to_pylist()
    benchmark = [r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist() if r["text"] and len(r["text"].split()) >= 10]
    long_one = max((d for d in documents if d["lang"] == "en"), key=lambda d: len(d["text"]))
    words = long_one["text"].replace("\n", " ").split()

    def like(i, text):
        return long_one | {"doc_id": i, "text": text, "n_chars": len(text or "")}

    planted = [like(10**6, None), like(10**6 + 1, "12 34"), like(10**6 + 2, long_one["text"]), like(10**6 + 3, " ".join(words[:-3]) + " another few words"), like(10**6 + 4, f"some own words before {benchmark[0]}")]
    rows = documents + planted
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select(*corpus_pipeline.COLUMNS)
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        assert docs.count() == len(kept[name])
    assert {d["doc_id"] for d in rows} - set(kept["language_id"]) == {10**6, 10**6 + 1}
    assert 10**6 + 2 not in kept["line_dedup"]  # every line stands earlier
    assert 10**6 + 4 in kept["line_dedup"] and 10**6 + 4 not in kept["decontamination"]
    last, before = kept["byte_bpe"], kept["decontamination"]
    assert set(last) == set(before) and len(last) > 150
    for i, r in last.items():
        assert r["decoded_sha256"] == hashlib.sha256((before[i]["text"] or "").encode()).hexdigest()


def test_documents_stay_while_text_is_left(spark):
    footer = "all rights reserved by the same owner"
    texts = [footer, f"roses are red\nviolets are blue\n{footer}", f"\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\n{footer}", f"{footer}\n\n  \nroses are red", " \n", "own"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_dedup(spark, docs, SF).collect()}
    assert got == {0: footer, 1: "roses are red\nviolets are blue", 2: "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0", 4: " \n", 5: "own"}


def test_near_copies_go(spark):
    text = " ".join(f"word{i}" for i in range(100))
    rows = [(i, text.replace(f"word{40 + i}", "other"), "en", "s", 1) for i in range(5)] + [(9, "nothing alike here in these words", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r["doc_id"] for r in corpus_pipeline.ngram_jaccard(spark, docs, SF).collect()) == [0, 9]


def test_rows_without_ids_and_repeated_ones(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    passage = next(r["text"] for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist() if r["text"] and len(r["text"].split()) >= 20)
    rows = [(None, passage, "en", None, None), (None, "own words here", None, "s", 1), (1, passage, "en", "s", 1), (2, "quite other words", "en", "s", 1), (2, "quite other words", "en", "s", 1), (2, None, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.decontamination(spark, docs, SF).collect()
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept) == [("2", ""), ("2", "quite other words"), ("2", "quite other words"), ("None", "own words here")]
    stays = {tuple(r) for parts in (1, 7) for r in corpus_pipeline.ngram_jaccard(spark, docs.repartition(parts), SF).collect() if r["doc_id"] == 2}
    assert len(stays) == 1  # the same row, however rows are dealt
    none = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).collect() == []


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns)
    assert out.count() > 0 and out.filter("octet_length(ids) <> 4 * n_tokens").count() == 0
