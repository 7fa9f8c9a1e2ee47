"""The pipeline's tokenizer takes small batches of whole texts."""


def test_tokens_take_small_batches(spark, monkeypatch):
    import corpus_pipeline
    from trialgrid.llm import op2_bpe

    tidy, most = op2_bpe.tidy, corpus_pipeline.TOKEN_ROWS

    def checked(run):
        def small(batches):
            for batch in batches:
                assert batch.num_rows <= most
                yield batch

        return tidy(lambda batches: run(small(batches)))

    monkeypatch.setattr(op2_bpe, "tidy", checked)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(3 * most, numPartitions=1).selectExpr("id as doc_id", "concat('word ', id) as text", "'s' as source", "'en' as lang")
    out = corpus_pipeline.tokens(spark, docs, "")
    assert out.count() == 3 * most and out.where("n_tokens < 2").count() == 0
    assert spark.conf.get(key) == before
