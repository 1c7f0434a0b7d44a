import pytest
from pyspark.sql import functions as F

from glyphmill.functions.tokenizers import Tokenizer, tokenize


@pytest.mark.parametrize("options", [{"stemmer": "klingon"}, {"stopwords_language": "klingon"}, {"kind": "nothing"}, {"kind": "lattice", "mode": "z"}])
def test_what_is_not_there_raises(options):
    with pytest.raises(ValueError):
        Tokenizer(**options)


def test_lexicon_of_a_tokenizer(spark):
    lexicon = tuple((w, 500, "n", "*", w, w, w, (), ()) for w in ("我们", "学习", "中文"))
    row = spark.createDataFrame([("我们学习中文",)], "text string")
    assert row.select(tokenize(F.col("text"), Tokenizer("jieba", lexicon=lexicon)).alias("t")).first()["t"] == ["我们", "学习", "中文"]


def test_frequent_words_take_the_most_probable_path():
    """Against all ways to cut a run."""
    import itertools
    import math

    from glyphmill.functions.lattice import WORD_FREQUENCIES, FrequentWords

    model = FrequentWords(WORD_FREQUENCIES)

    def weight(words):
        return sum(math.log(model.frequency.get(w) or 1.0) - model.total if len(w) == 1 or w in model.frequency else -math.inf for w in words)

    for text in ("清华大学生", "研究生命起源", "我来到北京", "中国人民大学"):
        cuts = (([0, *c, len(text)]) for n in range(len(text)) for c in itertools.combinations(range(1, len(text)), n))
        best = max(weight([text[a:b] for a, b in zip(c, c[1:])]) for c in cuts)
        assert "".join(model.run(text)) == text and math.isclose(weight(model.run(text)), best)


def test_lexicons_from_settings(spark, tmp_path):
    from glyphmill.functions import lattice

    names = "surface string, cost int, pos1 string, pos2 string, reading string, dictionary_form string, normalized_form string, split_b array<string>, split_a array<string>"
    row = ("東京大学", 5000, "名詞", "固有名詞", "トウダイ", "東京大学", "東京大学", [], [])
    spark.createDataFrame([row], names).write.parquet(f"{tmp_path}/user")
    assert lattice.lexicon_of(spark) == tuple(sorted(lattice.LEXICON, key=lambda r: r[1]))
    spark.conf.set("glyphmill.lexicon.user.paths", f"{tmp_path}/user")
    try:
        assert lattice.Lattice(lattice.lexicon_of(spark)).entries["東京大学"][4] == "トウダイ"
    finally:
        spark.conf.unset("glyphmill.lexicon.user.paths")
    with pytest.raises(ValueError):
        lattice.load_lexicon(spark.createDataFrame([row, row], names), most=1)


@pytest.mark.parametrize(
    "options",
    [Tokenizer(), Tokenizer("whitespace", remove_long=5), Tokenizer("unicode_words", stopwords_language="german"), Tokenizer("ngram", prefix_only=True), Tokenizer("source_code", lowercase=False), Tokenizer("chinese_compatible", ascii_folding=True),
     Tokenizer(stemmer="english"), Tokenizer(stemmer="french"), Tokenizer(stemmer="german"), Tokenizer("lattice", mode="search"), Tokenizer("lattice", mode="b"), Tokenizer("jieba"), Tokenizer("literal_normalized", remove_long=None), Tokenizer("regex_pattern", pattern="[a-z]+")],
)
def test_plain_tokens_equal_columns(spark, options):
    from glyphmill.functions import plain
    from glyphmill.functions.tokenizers import tokenize_table

    texts = ["The quick foxes' running, actives et précieuses häuser_Bücher!", "getHTTPResponse2xx fooBar", "私は東京大学の学生です。 abc", "我来到北京清华大学", " x ", "", None, "ab", "Änderungen der Möglichkeiten\tund   Straße"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    wanted = {(r["id"], r["position"], r["token"]) for r in tokenize_table(df, "text", options).collect()}
    assert {(i, p, t) for i, x in enumerate(texts) for t, p in plain.tokens(x, options)} == wanted
