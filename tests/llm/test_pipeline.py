"""The pipeline's stages, each on what the one before kept."""

import corpus_pipeline
from tessera.llm.common import materialize, read

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near dedup", "mixing", "sentencepiece"]
    docs = read(spark, SF, "documents")
    sizes, frames = [docs.count()], [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, SF), "test-stage")
        if name != "sentencepiece":
            assert docs.columns == frames[0].columns, name
        sizes.append(docs.count())
        frames.append(docs)
    assert 0 < sizes[1] < sizes[0]          # rejected documents go
    assert sizes[2] == sizes[1]             # lines go, documents stay
    assert sizes[3] <= sizes[2]             # one of each group stays
    assert frames[3].select("doc_id").distinct().count() == sizes[3]
    assert sizes[5] == sizes[4]
    chars = frames[2].selectExpr("sum(char_length(text)) t", "sum(n_chars) n").first()
    assert chars["t"] == chars["n"] < frames[1].selectExpr("sum(char_length(text)) t").first()["t"]


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert out.count() > 0
