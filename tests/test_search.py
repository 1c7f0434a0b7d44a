import itertools

import duckdb
import pytest
from pyspark.sql import functions as F

from glyphmill.functions.tokenizers import Tokenizer, tokenize
from glyphmill.operators import query as q
from glyphmill.operators.index import build_index
from glyphmill.operators.parser import ParseError, parse
from glyphmill.plans import catalog

ROWS = [
    (1, "the quick brown fox", 10), (2, "The lazy dog, the quick dog", 20), (3, "brown bread and butter", None), (4, "", 40), (5, None, 50), (6, "quick quick brown quick", 60),
]


@pytest.fixture(scope="module")
def index(spark):
    return build_index(spark.createDataFrame(ROWS, "id int, body string, size int"), "id", {"body": Tokenizer()})


def keys(index, query):
    return {r["id"] for r in q.search(index, query).collect()}


def test_term_match_and_typed_fields(index):
    assert keys(index, q.Term("body", "quick")) == {1, 2, 6}
    assert keys(index, q.Match("body", "Quick, brown!", all=True)) == {1, 6}
    assert keys(index, q.Term("size", 20)) == {2}
    assert keys(index, q.Exists("size")) == {1, 2, 4, 5, 6}
    assert keys(index, q.Empty()) == set()
    assert keys(index, q.All()) == {1, 2, 3, 4, 5, 6}


def test_phrases(index):
    assert keys(index, q.Phrase("body", ("quick", "brown"))) == {1, 6}
    assert keys(index, q.Phrase("body", ("the", "dog"))) == set()
    assert keys(index, q.Phrase("body", ("the", "dog"), 1)) == {2}
    assert keys(index, q.Phrase("body", ("brown", ("fox", "bread")))) == {1, 3}
    assert keys(index, q.PhrasePrefix("body", ("quick", "br"))) == {1, 6}


def test_proximity_and_boolean(index):
    assert keys(index, q.Proximity("body", q.near("dog", 1, "quick"))) == {2}
    assert keys(index, q.Proximity("body", q.near("fox", 3, "the", in_order=True))) == set()
    assert keys(index, q.Boolean(must=(q.Term("body", "quick"),), must_not=(q.Term("body", "dog"),))) == {1, 6}
    assert keys(index, ~q.Term("body", "quick")) == {3, 4, 5}


def test_scores_prefer_more_and_rarer_terms(index):
    best = q.top_k(index, q.Match("body", "quick"), 3).collect()
    assert [r["id"] for r in best][0] == 6
    assert q.top_k(index, q.Match("body", "quick").const(7.0), 1).first()["score"] == 7.0


def test_parser(index):
    assert keys(index, parse(index, "body:quick AND NOT body:dog")) == {1, 6}
    assert keys(index, parse(index, "+brown -fox", "body")) == {3, 6}
    assert keys(index, parse(index, "size:[20 TO 50}")) == {2, 4}
    assert keys(index, parse(index, "size:>=50")) == {5, 6}
    assert keys(index, parse(index, '"lazy dog" OR butter', "body")) == {2, 3}
    assert keys(index, parse(index, "quik~1", "body")) == {1, 2, 6}
    with pytest.raises(ParseError):
        parse(index, "(quick", "body")
    assert keys(index, parse(index, "(butter", "body", lenient=True)) == {3}


def test_plans_are_distributed(index, spark):
    plan = q.top_k(index, q.Match("body", "quick"), 3)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
    assert "CartesianProduct" not in plan


def test_tokenizer_nulls_and_unknown_kind(spark):
    df = spark.createDataFrame([(None,), ("",), ("A b",)], "t string")
    assert [r[0] for r in df.select(tokenize(F.col("t"))).collect()] == [[], [], ["a", "b"]]
    with pytest.raises(ValueError):
        Tokenizer("nothing")


def test_queries_as_json(index):
    from glyphmill.operators.codec import from_json, to_json

    asked = q.Boolean(must=(q.Term("body", "quick").boost(2.0),), must_not=(q.Proximity("body", q.near("dog", 1, "quick")), q.Range("size", 5, 10)))
    assert from_json(to_json(asked)) == asked
    assert keys(index, from_json(to_json(asked))) == {6}
    with pytest.raises(ValueError):
        from_json("[1]")


def test_table_function(spark):
    from glyphmill.operators.codec import register

    register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM text_tokens('Ab c-d')").collect()] == [("ab", 0), ("c", 1), ("d", 2)]


def test_saved_and_compacted_index(index, spark, tmp_path):
    from glyphmill.operators.index import compact, load

    index.save(f"{tmp_path}/a", 4)
    compact(spark, f"{tmp_path}/a", f"{tmp_path}/b")
    again = load(spark, f"{tmp_path}/b", "id", {"body": Tokenizer()})
    assert again.checksum().first()["checksum"] == index.checksum().first()["checksum"]
    assert keys(again, q.Term("body", "quick")) == {1, 2, 6}
    plan = q.search(again, q.Term("body", "quick"))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(field" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]


def test_index_stream_adds_batches_once(spark, tmp_path):
    from glyphmill.streaming.text import index_stream

    data = f"{tmp_path}/in"
    spark.createDataFrame([(1, "red fox")], "id int, body string").write.parquet(data)
    start = lambda: index_stream(spark.readStream.schema("id int, body string").parquet(data), "id", {"body": Tokenizer()}, f"{tmp_path}/ix", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    start()
    spark.createDataFrame([(2, "red hen")], "id int, body string").write.mode("append").parquet(data)
    start()
    start()
    postings = spark.read.parquet(f"{tmp_path}/ix/postings")
    assert postings.where("term = 'red'").count() == 2


def test_dictionary_query_has_every_term(spark):
    sf = "/root/testdata/sf0.001"
    found = catalog.QUERIES["index_terms"](spark, sf)
    assert found.count() == catalog.QUERIES["index_info"](spark, sf).first()["terms"]
    assert found.where("df = 1").count() > 0


def test_fuzzy_counts_exchanges_like_the_full_recurrence(spark):
    words = ["".join(w) for n in range(6) for w in itertools.product("abcd", repeat=n)]
    terms = spark.createDataFrame([(w,) for w in words], "term string").cache()
    con = duckdb.connect()
    for value in ("abcd", "abca", "dcb", "aabbc"):
        for distance in (0, 1, 2, 3):
            found = {r["term"] for r in terms.where(q._damerau(F.col("term"), value, distance)).collect()}
            assert found == {w for (w,) in con.execute("SELECT w FROM (SELECT unnest(?) AS w) WHERE damerau_levenshtein(w, ?) <= ?", [words, value, distance]).fetchall()}
