"""The pipeline, stage by stage, against brute-force versions, and the registration of the queries."""


import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from glyphmill.llm import catalog

SF = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert "pipeline" in names and set(catalog.QUERIES) <= set(names)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "bpe_encoding_and_decoding"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns, written and read again."""
    root, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
        out.append((before, docs))
    return out


def test_stages_keep_the_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and after.count() <= before.count()


def test_stages_against_brute_force(stages):
    from tests.llm.test_operators import brute_components, brute_repeats

    texts = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before, after = texts(stages[1][0]), texts(stages[1][1])
    components = {i: c for (i, _, c) in brute_components(list(before.items()))}
    assert set(after) == {i for i in before if components[i] == i}
    before, after = texts(stages[2][0]), texts(stages[2][1])
    left = {i: n - cut for (i, n, cut, _) in brute_repeats(list(before.items()))}
    assert {i: len(t.split()) for i, t in after.items()} == left
    before, after = texts(stages[3][0]), texts(stages[3][1])
    bench = [r["text"] for r in stages[3][0].sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert set(before) - set(after) == {i for i, t in before.items() if any(covered(t, x) for x in bench)}
    items = [r["text"].lower() for r in stages[3][0].sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not [i for i, t in after.items() if any(x in t.lower() for x in items)]
    assert all(any(x.split()[0] in before[i].lower() for x in items) for i in set(before) - set(after))


def covered(text, item):
    """Greedy tiling by brute force: whether tiles cover enough of the item."""
    from glyphmill.llm import decontamination as d
    from tests.llm.test_operators import brute_tiles

    b = d.words_of(item)
    known = set(b)
    a = [w if w in known else None for w in d.words_of(text)]
    near = [i for i, w in enumerate(a) if w is not None]
    if len(near) < 0.6 * len(b):
        return False
    runs = {tuple(b[i : i + 3]) for i in range(len(b) - 2)}
    at = {j for i in range(len(a) - 2) if tuple(a[i : i + 3]) in runs for j in range(i, i + 3)}
    a = [w if i in at else object() for i, w in enumerate(a) if i in at or i + 1 in at]
    return brute_tiles(a, b, 3) >= d.COVERAGE * len(b)


def test_toxicity_stage_drops_what_the_operator_predicts(spark):
    from glyphmill.llm import toxicity

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    scored = toxicity.op6(spark, "/root/testdata/sf0.01").collect()
    assert kept == {r["doc_id"] for r in scored if r["score"] < 0.7}
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert sum(i not in kept for i, t in toxic.items() if t == 1) > 0.7 * sum(t == 1 for t in toxic.values())
    assert sum(i in kept for i, t in toxic.items() if t == 0) > 0.99 * sum(t == 0 for t in toxic.values())


def test_encoding_stage_equals_the_library(stages):
    import hashlib

    import numpy as np
    import public_tokenizers
    import tokenizers

    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    before = {r["doc_id"]: r["text"] for r in stages[4][0].collect()}
    for r in stages[4][1].collect():
        ids = library.encode(before[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def small_corpus(spark, folder, rows, schema="doc_id long, text string, score string, predicted int, id int, key int, n_chars long"):
    tables = {
        "documents": spark.createDataFrame(rows, schema),
        "labels": spark.createDataFrame([], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame([], "item_id long, text string"),
    }
    for name, table in tables.items():
        table.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_nulls_repeats_clashing_columns_and_no_labels(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, "s", 1, 1, 1, 9), (1, text, "s", 1, 1, 1, 9), (2, text, "s", 1, 1, 1, 9), (3, None, None, None, None, None, None), (None, "", "s", 1, 1, 1, 0), (4, "x" * 100000, "s", 1, 1, 1, 9), (5, "z " + text + " z", "s", 1, 1, 1, 9)]
    folder = small_corpus(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
    found = {r["doc_id"]: r for r in docs.collect()}
    assert set(found) == {1, 3, 4, None} and docs.count() == 4  # 5 is a near duplicate of 1
    assert found[1]["score"] == "s" and found[3]["score"] is None
    out = {r["doc_id"]: r["n_tokens"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == {1, 3, 4, None} and out[3] == out[None] == 0 < out[4]


def test_empty_tables(spark, tmp_path):
    folder = small_corpus(spark, tmp_path, [])
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_run_gives_the_last_stage(spark, stages):
    out = corpus_pipeline.run(spark, SF)
    assert sorted(r[0] for r in out.select("doc_id").collect()) == sorted(r[0] for r in stages[-1][1].select("doc_id").collect())
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0
