from glyphmill.plans import catalog


def test_multilabel_decodes_every_component(spark):
    rows = catalog.QUERIES["decode_multilabel_all"](spark, "/root/testdata/sf0.001").collect()
    assert {label for r in rows for label in r["labels"].split(",") if label} == {f"c{i}" for i in range(1, 65)}


def test_buckets_over_the_limit_are_refused(spark):
    import pytest

    from glyphmill.operators.aggregate import agg, aggregate

    rows = spark.createDataFrame([(1,), (2,)], "a int")
    with pytest.raises(ValueError):
        aggregate(rows, {"t": {"terms": {"field": "a", "size": 100}}}, bucket_limit=10)
    with pytest.raises(ValueError):
        agg({"t": {"terms": {"field": "a"}}})


def test_hot_terms_of_a_stored_index(spark, tmp_path, monkeypatch):
    from glyphmill.functions.tokenizers import Tokenizer
    from glyphmill.operators import index as ix
    from glyphmill.operators import query as q

    monkeypatch.setattr(ix, "HOT_POSTINGS", 20)
    monkeypatch.setattr(ix, "HOT_TERMS", 10)
    monkeypatch.setattr(ix, "BUCKET_POSTINGS", 50)
    rows = spark.createDataFrame([(i, f"the word{i % 7} and{'' if i % 5 else ' more'}") for i in range(60)] + [(99, ""), (98, None)], "id int, text string")
    built = ix.build_index(rows, "id", {"text": Tokenizer()})
    built.save(f"{tmp_path}/x")
    stored = ix.load(spark, f"{tmp_path}/x", "id", {"text": Tokenizer()})
    assert stored.buckets > 1 and stored.stats("text") == (62, built.stats("text")[1])
    for query in (q.Match("text", "the more"), q.Phrase("text", ("the", "word3")), q.Term("text", "word1")):
        assert sorted(map(tuple, q.search(stored, query).collect())) == sorted(map(tuple, q.search(built, query).collect()))
    assert sorted(map(tuple, stored.terms("text").collect())) == sorted(map(tuple, built.terms("text").collect()))
    assert stored.files().agg({"postings": "sum"}).first()[0] == built.postings.count()


def test_a_stored_index_is_built_once_and_again_when_it_is_gone(spark, tmp_path):
    from glyphmill.functions.tokenizers import Tokenizer
    from glyphmill.operators import index as ix

    spark.createDataFrame([(1, "a b"), (2, "b")], "id int, text string").write.parquet(f"{tmp_path}/rows")
    ask = lambda: ix.stored(spark.read.parquet(f"{tmp_path}/rows"), "id", {"text": Tokenizer()}, f"file://{tmp_path}/x")
    first = ask()
    assert ask() is first
    ix._remove(spark, f"file://{tmp_path}/x")
    assert ask() is not first and ask().terms("text").count() == 2
