"""Tokenizer queries over the documents and pages tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions.tokenizers import KINDS, Tokenizer, tokenize, tokenize_table, tokenizers
from glyphmill.session import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_SIMPLE = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' AND length(x) <= 255)"


def _counts(name: str, options: Tokenizer, sql: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> None:
    """Per row: the number of tokens, and a checksum-like summary (first, last, total length)."""

    def query(spark, sf_dir):
        t = table(spark, sf_dir, source).select(key, tokenize(F.col(text), options).alias("t"))
        return t.select(key, F.size("t").cast("long").alias("n"), F.try_element_at("t", F.lit(1)).alias("first"), F.try_element_at("t", F.lit(-1)).alias("last"), F.aggregate("t", F.lit(0).cast("long"), lambda a, x: a + F.char_length(x)).alias("chars"))

    QUERIES[name] = query
    ORACLES[name] = f"""SELECT {key}, len(t)::BIGINT AS n, t[1] AS first, t[len(t)] AS last,
        coalesce(list_sum(list_transform(t, lambda x: length(x))), 0)::BIGINT AS chars
        FROM (SELECT {key}, {sql.replace('text', text)} AS t FROM {source})"""


_counts("tok_simple", Tokenizer(), _SIMPLE)
_counts("tok_whitespace", Tokenizer("whitespace"), "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '' AND length(x) <= 255)")
_counts("tok_unicode_words", Tokenizer("unicode_words"), "list_transform(list_filter(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'), lambda x: length(x) <= 255), lambda x: lower(x))")
_counts("tok_regex_pattern", Tokenizer("regex_pattern", pattern="[a-z]+[0-9]*", lowercase=False), "regexp_extract_all(text, '[a-z]+[0-9]*')")
_counts("tok_literal", Tokenizer("literal", lowercase=False, remove_long=None), "[text]")
_counts("tok_literal_normalized", Tokenizer("literal_normalized", remove_long=None), "[lower(trim(text, ' '))]")
_counts("tok_alias", Tokenizer("alias", lowercase=False, remove_long=None), "[url]", "pages", "page_id", "url")
_counts("tok_ngram", Tokenizer("ngram", min_gram=2, max_gram=3, lowercase=False), "flatten(list_transform([2, 3], lambda n: list_transform(range(1, length(url) - n + 2), lambda i: substr(url, i, n))))", "pages", "page_id", "url")
_counts("tok_ngram_prefix", Tokenizer("ngram", min_gram=1, max_gram=5, prefix_only=True, lowercase=False), "list_transform(range(1, 6), lambda n: substr(url, 1, n))", "pages", "page_id", "url")
_counts(
    "tok_source_code",
    Tokenizer("source_code"),
    "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(html, '([\\p{Ll}\\p{N}])(\\p{Lu})', '\\1 \\2', 'g'), '(\\p{Lu}+)(\\p{Lu}\\p{Ll})', '\\1 \\2', 'g')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '' AND length(x) <= 255)",
    "pages", "page_id", "html",
)
_counts("tok_stopwords", Tokenizer(stopwords=("the", "of", "and", "der", "de", "la")), f"list_filter({_SIMPLE}, lambda x: x NOT IN ('the', 'of', 'and', 'der', 'de', 'la'))")
_counts("tok_remove_long", Tokenizer(remove_long=6), f"list_filter({_SIMPLE}, lambda x: length(x) <= 6)")
_counts("tok_ascii_folding", Tokenizer(ascii_folding=True), f"list_transform({_SIMPLE}, lambda x: translate(replace(replace(x, 'ß', 'ss'), 'œ', 'oe'), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'))")
_counts(
    "tok_stemmer",
    Tokenizer(stemmer="english"),
    f"""list_transform({_SIMPLE}, lambda x: CASE WHEN length(x) < 5 THEN x WHEN suffix(x, 'ies') THEN x[:-4] || 'y'
        WHEN suffix(x, 'ing') THEN x[:-4] WHEN suffix(x, 'ed') THEN x[:-3] WHEN suffix(x, 's') AND NOT suffix(x, 'ss') THEN x[:-2] ELSE x END)""",
)


def _positions(spark, sf_dir):
    options = Tokenizer(stopwords=("the", "of"))
    rows = tokenize_table(table(spark, sf_dir, "benchmark").select("item_id", "text"), "text", options)
    return rows.select("item_id", F.col("position").cast("long").alias("position"), "token")


QUERIES["tok_positions"] = _positions
ORACLES["tok_positions"] = f"""SELECT * FROM (SELECT item_id, unnest(range(len(t))) AS position, unnest(t) AS token FROM (SELECT item_id, {_SIMPLE} AS t FROM benchmark))
    WHERE token NOT IN ('the', 'of')"""

QUERIES["tokenizers"] = lambda spark, sf_dir: tokenizers(spark)
ORACLES["tokenizers"] = f"SELECT unnest([{', '.join(repr(k) for k in KINDS)}]) AS name"


def _chinese(spark, sf_dir):
    """Ideographs one by one, other text by white space."""
    rows = spark.sql("SELECT * FROM VALUES (1, '東京tower 大学'), (2, 'no kanji here'), (3, 'カナ混じりtext') AS t(id, text)")
    return rows.select("id", F.posexplode(tokenize(F.col("text"), Tokenizer("chinese_compatible"))).alias("position", "token"))


QUERIES["tok_chinese_compatible"] = _chinese
ORACLES["tok_chinese_compatible"] = "SELECT * FROM (VALUES (1, 0, '東'), (1, 1, '京'), (1, 2, 'tower'), (1, 3, '大'), (1, 4, '学'), (2, 0, 'no'), (2, 1, 'kanji'), (2, 2, 'here'), (3, 0, 'カ'), (3, 1, 'ナ'), (3, 2, '混'), (3, 3, 'じ'), (3, 4, 'り'), (3, 5, 'text')) AS t(id, position, token)"


def _stemmed(language: str) -> str:
    """The light stemmer of a language, over the words of a text."""
    from glyphmill.functions.tokenizers import STEMS

    least, stay, endings, replaced = STEMS[language]
    ordered = "|".join(sorted(dict.fromkeys(endings), key=lambda e: (-len(e), e)))
    out = f"regexp_replace(x, '^(.{{{stay},}}?)(?:{ordered})$', '\\1')"
    for ending, new in replaced.items():
        out = f"CASE WHEN regexp_full_match(x, '.{{{stay},}}{ending}') THEN regexp_replace(x, '{ending}$', '{new}') ELSE {out} END"
    return f"list_transform({_SIMPLE}, lambda x: CASE WHEN length(x) >= {least} THEN {out} ELSE x END)"


for _language in ("french", "german", "spanish", "italian", "portuguese", "dutch", "swedish", "russian"):
    _counts(f"tok_stemmer_{_language}", Tokenizer(stemmer=_language), _stemmed(_language))


def _stopped(language: str) -> str:
    from glyphmill.functions.tokenizers import STOPWORDS

    return f"list_filter({_SIMPLE}, lambda x: x NOT IN ({', '.join(f"'{w}'" for w in STOPWORDS[language])}))"


for _language in ("english", "french", "german", "spanish"):
    _counts(f"tok_stopwords_{_language}", Tokenizer(stopwords_language=_language), _stopped(_language))


def _words_of(texts: tuple[str, ...], options: Tokenizer):
    def query(spark, sf_dir):
        rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
        return rows.select("id", F.array_join(tokenize(F.col("text"), options), "/").alias("tokens"))

    return query


def _rows(*rows: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{r}')" for k, r in enumerate(rows)) + ") AS t(id, tokens)"


_JAPANESE = ("私は東京大学の学生です。", "国際空港へ行く", "")
QUERIES["tok_lattice_a"] = _words_of(_JAPANESE, Tokenizer("lattice", mode="a"))
ORACLES["tok_lattice_a"] = _rows("私/は/東京/大学/の/学生/です/。", "国際/空港/へ/行く", "")
QUERIES["tok_lattice_search"] = _words_of(_JAPANESE, Tokenizer("lattice", mode="search"))
ORACLES["tok_lattice_search"] = _rows("私/は/東京大学/東京/大学/の/学生/。", "国際空港/国際/空港/へ/行く", "")
_USER = (("大学の学生", 100, "名詞", "固有名詞", "ダイガクノガクセイ", "大学の学生", "大学の学生", (), ()), ("東京大学", 5000, "名詞", "固有名詞", "トウダイ", "東京大学", "東京大学", (), ()))
QUERIES["tok_lindera_user_lexicon"] = _words_of(_JAPANESE, Tokenizer("lindera", user_lexicon=_USER))
ORACLES["tok_lindera_user_lexicon"] = _rows("私/は/東京/大学の学生/です/。", "国際空港/へ/行く", "")
_CHINESE = ("我来到北京清华大学", "研究生命的起源", "我喜欢Spark 4.1和C++。", "他来了")
QUERIES["tok_jieba"] = _words_of(_CHINESE, Tokenizer("jieba", lowercase=False))
ORACLES["tok_jieba"] = _rows("我/来到/北京/清华大学", "研究/生命/的/起源", "我/喜欢/Spark/4.1/和/C/+/+/。", "他/来/了")
QUERIES["tok_jieba_user_words"] = _words_of(_CHINESE, Tokenizer("jieba", lowercase=False, user_lexicon=(("生命的起源",), ("他来了", 5000))))
ORACLES["tok_jieba_user_words"] = _rows("我/来到/北京/清华大学", "研究/生命的起源", "我/喜欢/Spark/4.1/和/C/+/+/。", "他来了")
