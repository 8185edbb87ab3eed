import corpus_pipeline
from claimstead.llm.common import stored


def test_stages(spark):
    prose = lambda k: " ".join(f"word{(i * k) % 97} river{i % (k + 3)} stone" for i in range(120))
    rows = [(1, prose(1), "en", "s", 9), (2, prose(1), "en", "s", 9), (3, prose(2) + " mail a@b.cd now", "en", "s", 9), (4, None, None, None, None), (5, "short", "en", "s", 1), (3, prose(2) + " mail a@b.cd now", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, ""), "test")
        assert docs.columns == corpus_pipeline.COLUMNS, name
    assert not {4, 5} & {r.doc_id for r in docs.collect()}
    assert docs.where("text like '%a@b.cd%'").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").where("length > 1024").count() == 0
