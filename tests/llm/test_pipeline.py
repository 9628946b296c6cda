"""The pipeline's stages, and the registered queries over small tables."""
import corpus_pipeline
import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / f"{k}"))
        out = spark.read.parquet(str(tmp_path / f"{k}"))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns and 0 < out.count() <= rows
            rows = out.count()
            docs = out
    assert out.select("doc_id").distinct().count() == rows
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} == {r["doc_id"] for r in out.select("doc_id").distinct().collect()}


def test_run_equals_the_operators_one_by_one(spark):
    from ledgerlens.llm import labelled, line_crf, minhash_oph, quality_cnn, secret_links
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sample = labelled.training(spark, SF)
    crf = {r["doc_id"] for r in line_crf.judge(docs, line_crf.fit(sample)).collect() if r["kept"]}
    cnn = {r["doc_id"] for r in quality_cnn.score(docs, quality_cnn.fit(sample)).collect() if r["predicted"]}
    left = docs.where(docs.doc_id.isin(sorted(crf & cnn)))
    kept = {r["doc_id"] for r in minhash_oph.near_duplicates(left, 5, 80).collect() if r["kept"]}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == kept
    masked = {r["doc_id"]: r["text"] for r in secret_links.redact(left).collect()}
    from tokenizers import Tokenizer
    import public_tokenizers
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    by_doc = {}
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        by_doc.setdefault(r["doc_id"], []).extend(r["tokens"])
    for doc, ids in by_doc.items():
        assert ids == [*t.encode(masked[doc], add_special_tokens=False).ids, 1]


def test_odd_documents_pass_all_stages(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES[2:4]:
            assert stage(spark, docs, SF).columns == docs.columns, name
        assert corpus_pipeline.pack_sequences(spark, docs, SF).count() >= 0


def test_registered():
    names = {q.split("_")[0] for q in E.queries() if q.startswith("op")}
    assert names >= {f"op{n}" for n in range(1, 11)} and "pipeline" in E.queries()
    assert {"op7_minhash_oph", "op9_secret_links", "op10_knn_tiles"} <= set(E.oracle_sql())
