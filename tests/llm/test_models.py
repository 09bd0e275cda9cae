"""What the learned operators learn from, and what they give for odd ids."""

from quaystone.llm import op4_byte_bpe as op4
from quaystone.llm import op5_crf_toxicity as op5
from quaystone.llm import op7_hierarchical_langid as op7


def test_every_labelled_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(op7, "SAMPLE", 40)
    monkeypatch.setattr(op7, "LEAST", 3)
    rows = [(i, f"{chr(0x4E00 + 50 * (i % 30))} {chr(0x4E01 + 50 * (i % 30))}" * (1 + i % 3), f"l{i % 30:02}") for i in range(600)]
    model = op7.train_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert sorted(x for own in model["langs"].values() for x in own) == [f"l{k:02}" for k in range(30)]


def test_repeated_ids_do_not_grow_the_sample(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(op7, "fit", lambda texts, langs: seen.append(len(texts)))
    monkeypatch.setattr(op5, "fit", lambda toxic, other, prior: seen.append(len(toxic) + len(other)))
    rows = [(2 + i % 2, f"some words {i}", "en") for i in range(500)] + [(None, "no id", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    op7.train_model(df)
    op5.train_model(df, spark.createDataFrame([(2, 1), (3, 0), (3, 0)], "doc_id long, toxic int"))
    assert all(n <= 2 for n in seen) and len(seen) == 2


def test_toxic_spans_are_code_points():
    import numpy as np

    text = "é ugly words\nand\x0b中 vile end"
    p = np.array([0, 0.9, 0.6, 0, 0, 0.5, 0])
    got = op5.spans(text.encode(), p)
    assert [text[s["start"] : s["end"]] for s in got] == ["ugly words", "vile"]


def test_null_ids_are_not_held_out(spark, tmp_path):
    spark.createDataFrame([(None, "some words", "en"), (1, None, None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for query in (op5.query, op7.query):
        got = {r.doc_id: r.held_out for r in query(spark, str(tmp_path)).collect()}
        assert got[None] is False and set(got) == {None, 1}


def test_long_chunks_are_not_remembered():
    import public_tokenizers

    bpe = op4.ByteBpe(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["x" * 5000, "short " + "y" * 5000 + " words", "x" * 5000 + " again", "short words"]
    for _ in range(2):
        assert [bpe.decode(i) for i in bpe.encode(texts)] == [t.encode() for t in texts]
    assert max(map(len, [*bpe.seen.young, *bpe.heads])) <= op4.LONG
