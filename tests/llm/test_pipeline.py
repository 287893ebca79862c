import corpus_pipeline
from tests.llm.fixture import SCHEMA, at


def test_stages(spark, tmp_path):
    en = lambda k: " ".join(f"the river{k + i} and town{k + i} were quiet" for i in range(30))
    de = lambda k: " ".join(f"der Fluss{k + i} und Stadt{k + i} waren ruhig" for i in range(30))
    passage = "which of these four numbers is the least common multiple of six and eight"
    more = [(100 + k, (en, de)[k % 2](1000 * k + 5000), ("en", "de")[k % 2], "a") for k in range(24)]
    texts = [(1, en(0), "en", "a"), (2, en(0), "en", "b"), (3, de(0), "de", "a"), (4, None, "en", "a"), (5, "", None, None), (6, f"{en(500)} {passage}", "en", "c"), (7, f"token = 269b1cea0846965f2d3ecb5cdb87c0edc7a7a587 {en(700)}", "en", "a"), *more]
    d = at(tmp_path, spark, texts, [(1, passage)])
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        assert k == 4 or docs.columns == SCHEMA.names, name
        docs.write.parquet(f"{d}/stage{k}")
        docs = spark.read.parquet(f"{d}/stage{k}")
    got = {r["doc_id"]: r for r in docs.collect()}
    assert set(got) == {1, 3, 6, 7, *(100 + k for k in range(24))}
    assert got[1]["text"] == en(0) and got[7]["text"] == f"[SECRET] {en(700)}" and got[6]["text"] == f"{en(500)} "
    assert all(r["n_pieces"] == len(r["ids"]) for r in got.values())
