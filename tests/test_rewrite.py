"""Streams that stages must leave or change as whole pipelines do, and the lexicon's bounds."""

import dataclasses
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import memo
from glyphmill.operators import rewrite as rw
from glyphmill.plans import rewriting


def streams(spark, *rows):
    return rewriting.streams_of(spark.createDataFrame(list(enumerate(rows)), "id int, stream string")).drop("stream")


#: Words whose dictionary form stays that of their head through all stages.
LEMMAS = [
    ("飲ん/動詞/飲む だ/助動詞", "飲む"), ("飲ん/動詞/飲む で/助詞-接続助詞", "飲む"), ("読ん/動詞/読む だ/助動詞", "読む"), ("住ん/動詞/住む で/助詞-接続助詞 いる/動詞-非自立可能", "住む"), ("食べ/動詞/食べる て/助詞-接続助詞 いる/動詞-非自立可能", "食べる"),
    ("なっ/動詞/なる た/助動詞", "なる"), ("飲ん/動詞/飲む だら/助動詞/た", "飲む"), ("及ん/動詞/及ぶ だ/助動詞", "及ぶ"), ("並ん/動詞/並ぶ で/助詞-接続助詞", "並ぶ"), ("死ん/動詞/死ぬ だ/助動詞", "死ぬ"),
    ("食べ/動詞/食べる させ/助動詞/させる られ/助動詞/られる て/助詞-接続助詞 い/動詞-非自立可能/いる なかっ/助動詞/ない た/助動詞", "食べる"),
]


def test_merged_words_keep_the_dictionary_form(spark):
    out = rw.rewrite_streams(streams(spark, *(s for s, _ in LEMMAS))).orderBy("id").collect()
    assert [r["tokens"][0]["dictionary_form"] for r in out] == [lemma for _, lemma in LEMMAS]
    assert [len(r["tokens"]) for r in out] == [1] * len(LEMMAS)
    assert all(r["tokens"][0]["char_end"] == len(r["tokens"][0]["surface"]) for r in out)


def test_text_is_kept(spark):
    """Every stage but those that change surfaces keeps the characters of a stream, in order and without gaps."""
    df = rewriting.document_streams(spark, "/root/testdata/sf0.001").limit(40)
    before = {r["doc_id"]: "".join(t["surface"] for t in r["tokens"]) for r in df.collect()}
    for r in rw.rewrite_streams(df, only=tuple(s.name for s in rw.STAGES if not s.name.startswith("split_tan"))).collect():
        assert "".join(t["surface"] for t in r["tokens"]) == before[r["doc_id"]]


def test_other_columns_nulls_and_empty_streams(spark):
    df = streams(spark, "はさ/名詞", "").withColumn("note", F.lit("x"))
    rows = df.unionByName(df.limit(1).select(F.lit(9).alias("id"), F.lit(None).cast(df.schema["tokens"].dataType).alias("tokens"), "note")).select("note", "tokens", "id")
    out = {r["id"]: r for r in rw.rewrite_streams(rows).collect()}
    assert [t["surface"] for t in out[0]["tokens"]] == ["は", "さ"] and out[1]["tokens"] == [] and out[9]["tokens"] == [] and out[0]["note"] == "x"


def test_unknown_stages_and_large_lexicons_are_refused(spark, monkeypatch):
    df = streams(spark, "はさ/名詞")
    with pytest.raises(ValueError):
        rw.rewrite_streams(df, only=("no_such_stage",))
    monkeypatch.setattr(rw, "MOST_TERMS", 1)
    with pytest.raises(ValueError):
        rw.rewrite_streams(df, lexicon=spark.createDataFrame([("a",), ("b",)], "term string"))


def test_every_stage_has_a_query():
    from glyphmill.plans import catalog

    assert {f"stage_{s.name}" for s in rw.STAGES} <= set(catalog.ORACLES) and len(rw.STAGES) == 32


def token(spec):
    surface, pos, lemma, normal, reading = (spec.split("/") + [""] * 4)[:5]
    lemma, pos = lemma or surface, tuple(pos.split("-"))
    return rw.Token(surface, reading, lemma, normal or lemma, "", pos, rw.CLASSES.get(pos[0], "other"), 0, 0, ())


def placed(tokens, at=0):
    out = []
    for t in tokens:
        out.append(t._replace(char_start=at, char_end=at + len(t.surface)))
        at += len(t.surface)
    return out


def remembered(streams, own):
    kind = pa.list_(pa.struct(list(memo._TYPES.items())))
    column = pa.array([[t._asdict() for t in s] for s in streams], kind)
    return [stream for _, _, read in own.read(column) for stream in own.shown(own.run(read)).to_pylist()]


def plain(streams, lexicon, only):
    return [[{f: list(x) if isinstance(x, tuple) else x for f, x in t._asdict().items()} for t in rw.rewritten(s, lexicon, only)] for s in streams]


#: Stages of queries over the documents' words, and how often a rule may run over 30,000 tokens of the vocabulary.
ONCE = [("combine_particles", 100), ("combine_tte", 60), ("cleanup_filter_misparse", 200), ("repair_hasa_noun", 30), ("disambiguation_fix_reading_ambiguity", 1000), ("split_tawake_noun", 60)]


@pytest.mark.parametrize(("stage", "most"), ONCE)
def test_a_rule_runs_once_for_places_that_look_alike(stage, most, monkeypatch):
    monkeypatch.setattr(memo, "PIECE", 1000)
    words = [token(f"{s}/{p}///{r}") for s, p, r in rewriting.VOCABULARY]
    rnd, ran = random.Random(7), []
    some = [placed(rnd.choices(words, k=rnd.randint(0, 600)), 3) for _ in range(100)]
    own = memo.Rewriter(rw.Lexicon(), (stage,))
    own.stages = [dataclasses.replace(s, sweeps=tuple(tuple(lambda v, rule=rule: ran.append(1) or rule(v) for rule in rules) for rules in s.sweeps)) for s in own.stages]
    assert remembered(some, own) == plain(some, rw.Lexicon(), (stage,))
    assert 0 < len(ran) <= most


@pytest.mark.parametrize("deepest", [12, 2])
def test_remembered_decisions_are_those_of_the_rules(deepest, monkeypatch):
    """All stages over streams put together from the cases of each, with so few decisions kept that they are forgotten too."""
    monkeypatch.setattr(memo, "DEEPEST", deepest)
    monkeypatch.setattr(memo, "MOST_KINDS", 300)
    monkeypatch.setattr(memo, "PIECE", 200)
    cases = [[token(p) for p in s.split()] for rows in rewriting.CASES.values() for s, _, _ in rows] + [[token(p) for p in s.split()] for s, _ in rewriting.READING_CASES]
    lexicon = rw.Lexicon({t.lstrip("!"): not t.startswith("!") for rows in rewriting.CASES.values() for _, terms, _ in rows for t in terms.split()})
    rnd, words = random.Random(3), [t for c in cases for t in c]
    some = [placed(sum((rnd.choice(cases) if rnd.random() < 0.6 else rnd.choices(words, k=2) for _ in range(rnd.randint(0, 8))), []), rnd.randint(0, 9)) for _ in range(120)]
    for only in (None, *((s.name,) for s in rw.STAGES)):
        assert remembered(some, memo.Rewriter(lexicon, only)) == plain(some, lexicon, only)


def test_words_in_one_pass_are_the_streams_of_documents(spark, tmp_path):
    texts = ["a bb  ccc ", "", " ", "\u00e9t\u00e9 \u65e5\u672c\u8a9e \U0001f600x \tb\n c", None, "x " * 700, "z"]
    spark.createDataFrame([(k // 2, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    tokens = rewriting.document_streams(spark, str(tmp_path))
    by = ("surface", "cls", "reading", "pos")
    wanted = sorted(map(repr, rw.tally_streams(tokens, "tokens", by, ("repair_hasa_noun",)).collect()))
    found = rw.tally_streams(spark.read.parquet(str(tmp_path / "documents.parquet")).where("text is not null"), "text", by, ("repair_hasa_noun",), make=rewriting.word_streams)
    assert sorted(map(repr, found.collect())) == wanted
    counted = rw.rewrite_streams(tokens, only=("repair_hasa_noun",)).select("doc_id", F.explode("tokens").alias("t")).groupBy("doc_id", *(f"t.{f}" for f in by)).agg(F.count(F.lit(1)).alias("n"), F.sum("t.char_start").alias("places"))
    again = found.groupBy("doc_id", *by).agg(F.sum("n").alias("n"), F.sum("places").alias("places"))
    assert sorted(map(repr, counted.collect())) == sorted(map(repr, again.collect()))


def test_tokens_with_nulls_and_without_parts_of_speech(spark):
    df = spark.sql("SELECT 1 AS id, array(named_struct('surface', '\u306f\u3055', 'dictionary_form', cast(null AS string), 'pos', array('\u540d\u8a5e', null), 'char_start', cast(null AS bigint), 'char_end', 9L), "
                   "named_struct('surface', 'x', 'dictionary_form', 'y', 'pos', cast(array() AS array<string>), 'char_start', 9L, 'char_end', 10L)) AS tokens")  # fmt: skip
    (row,) = rw.rewrite_streams(df, only=("repair_hasa_noun",)).collect()
    assert [(t["surface"], t["cls"], t["char_start"], t["char_end"]) for t in row["tokens"]] == [("\u306f", "particle", None, None), ("\u3055", "particle", None, 9), ("x", "other", 9, 10)]
    assert {(r["cls"], r["n"], r["places"]) for r in rw.tally_streams(df, by=("cls",)).collect()} == {("particle", 2, None), ("other", 1, 9)}
