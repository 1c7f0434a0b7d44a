"""Queries of the Japanese operators over inline fixtures. Expected rows are written out, not computed alike."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions import lattice, search_tokens, verbs
from glyphmill.operators import deconjugate as dec
from glyphmill.operators import rewrite as rw
from glyphmill.operators import structure as st

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _rows(names: str, *rows: tuple) -> str:
    cell = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS fixture({names})"


# ---------------------------------------------------------------- morphology

VERBS = (("書く", "v5k"), ("行く", "v5k-s"), ("飲む", "v5m"), ("話す", "v5s"), ("買う", "v5u"), ("食べる", "v1"), ("勉強する", "vs-s"), ("来る", "vk"), ("ある", "v5r-i"))
EXPECTED = {
    "negative": "書かない 行かない 飲まない 話さない 買わない 食べない 勉強しない 来ない ない",
    "te": "書いて 行って 飲んで 話して 買って 食べて 勉強して 来て あって",
    "past": "書いた 行った 飲んだ 話した 買った 食べた 勉強した 来た あった",
    "polite": "書きます 行きます 飲みます 話します 買います 食べます 勉強します 来ます あります",
    "passive": "書かれる 行かれる 飲まれる 話される 買われる 食べられる 勉強される 来られる あられる",
    "causative": "書かせる 行かせる 飲ませる 話させる 買わせる 食べさせる 勉強させる 来させる あらせる",
    "potential": "書ける 行ける 飲める 話せる 買える 食べられる 勉強できる 来られる あれる",
    "volitional": "書こう 行こう 飲もう 話そう 買おう 食べよう 勉強しよう 来よう あろう",
    "imperative": "書け 行け 飲め 話せ 買え 食べろ 勉強しろ 来い あれ",
    "conditional_ba": "書けば 行けば 飲めば 話せば 買えば 食べれば 勉強すれば 来れば あれば",
    "desiderative": "書きたい 行きたい 飲みたい 話したい 買いたい 食べたい 勉強したい 来たい ありたい",
    "negative_zu": "書かず 行かず 飲まず 話さず 買わず 食べず 勉強せず 来ず あらず",
}


def _conjugate(spark, sf_dir):
    df = spark.sql(_rows("word, tag", *VERBS))
    return verbs.conjugations(df, "word", "tag", list(EXPECTED)).select("word", "form", "surface")


QUERIES["conjugate_verbs"] = _conjugate
ORACLES["conjugate_verbs"] = _rows("word, form, surface", *((w, f, s) for f, line in EXPECTED.items() for (w, _), s in zip(VERBS, line.split(), strict=True)))

_ADJ = (("高い", "adj-i", "negative_past", "高くなかった"), ("高い", "adj-i", "appearance", "高そうだ"), ("いい", "adj-ix", "past", "よかった"), ("いい", "adj-ix", "polite", "いいです"), ("いい", "adj-ix", "appearance", "よさそうだ"), ("静か", "adj-na", "negative", "静かじゃない"), ("静か", "adj-na", "attributive", "静かな"))


def _adjectives(spark, sf_dir):
    df = spark.sql(_rows("word, tag, form, expected", *_ADJ))
    every = verbs.conjugations(df.select("word", "tag").distinct(), "word", "tag", sorted({r[2] for r in _ADJ}))
    return every.join(df.select("word", "tag", "form"), ["word", "tag", "form"]).select("word", "form", "surface")


QUERIES["conjugate_adjectives"] = _adjectives
ORACLES["conjugate_adjectives"] = _rows("word, form, surface", *((w, f, s) for w, _, f, s in _ADJ))
QUERIES["verb_classes"] = lambda spark, sf_dir: verbs.verb_classes(spark).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
ORACLES["verb_classes"] = _rows("kind, n", ("godan", 13), ("ichidan", 2), ("irregular", 5), ("adjective", 3))

#: Surfaces: forms of the verbs above, of other classes, long chains, and what is no form.
_SURFACES = (
    "書かなかった", "飲んでいる", "食べさせられた", "行きたくない", "高くなかった", "来ました", "食べさせられていなかった", "待っとる", "読んどいた", "走りすぎる", "見えにくかった", "行かさない", "勉強しています", "泳いで", "死んだ",
    "しなければ", "帰ってしまった", "くれない", "東京", "あ",
)
QUERIES["deconjugate"] = lambda spark, sf_dir: dec.deconjugate(spark.sql(_rows("text", *((s,) for s in _SURFACES))), "text")
ORACLES["deconjugate"] = dec.recursion_sql(f"({_rows('text', *((s,) for s in _SURFACES))})", f"(VALUES {dec.rules_sql()}) AS q(con_end, dec_end, con_tag, dec_tag, detail, kind)")


#: Own golden cases: surface, dictionary form, class, chain of details from the verb outwards.
GOLDEN = (
    ("書いた", "書く", "v5k", "past"), ("書いて", "書く", "v5k", "te"), ("書かない", "書く", "v5k", "negative"), ("書きます", "書く", "v5k", "polite"), ("書きました", "書く", "v5k", "polite→past"), ("書きません", "書く", "v5k", "polite→negative"),
    ("書けば", "書く", "v5k", "provisional"), ("書こう", "書く", "v5k", "volitional"), ("書け", "書く", "v5k", "imperative"), ("書きたい", "書く", "v5k", "want"), ("書きたくなかった", "書く", "v5k", "want→negative→past"), ("書かせる", "書く", "v5k", "causative"),
    ("書かれた", "書く", "v5k", "passive→past"), ("書かせられる", "書く", "v5k", "causative→passive"), ("書いている", "書く", "v5k", "progressive"), ("書いてた", "書く", "v5k", "progressive→past"), ("書いちゃった", "書く", "v5k", "completion→past"),
    ("書いたら", "書く", "v5k", "conditional"), ("書いたり", "書く", "v5k", "representative"), ("書きながら", "書く", "v5k", "while"), ("書きすぎた", "書く", "v5k", "excess→past"), ("書きやすい", "書く", "v5k", "easy"),
    ("泳いだ", "泳ぐ", "v5g", "past"), ("泳がない", "泳ぐ", "v5g", "negative"), ("話した", "話す", "v5s", "past"), ("話さず", "話す", "v5s", "negative zu"), ("待った", "待つ", "v5t", "past"), ("待っとる", "待つ", "v5t", "toru (teoru)"),
    ("死んだ", "死ぬ", "v5n", "past"), ("死なない", "死ぬ", "v5n", "negative"), ("遊んで", "遊ぶ", "v5b", "te"), ("遊びましょう", "遊ぶ", "v5b", "polite→volitional"), ("飲んどく", "飲む", "v5m", "preparative"), ("飲める", "飲む", "v5m", "potential"),
    ("走った", "走る", "v5r", "past"), ("走られなかった", "走る", "v5r", "passive→negative→past"), ("買った", "買う", "v5u", "past"), ("買わない", "買う", "v5u", "negative"), ("行った", "行く", "v5k-s", "past"), ("行ってください", "行く", "v5k-s", "polite request"),
    ("食べた", "食べる", "v1", "past"), ("食べない", "食べる", "v1", "negative"), ("食べろ", "食べる", "v1", "imperative"), ("食べよう", "食べる", "v1", "volitional"), ("食べられる", "食べる", "v1", "potential"), ("食べさせられた", "食べる", "v1", "causative→passive→past"),
    ("食べれば", "食べる", "v1", "provisional"), ("食べております", "食べる", "v1", ""), ("勉強した", "勉強する", "vs-i", "past"), ("勉強できない", "勉強する", "vs-i", "potential→negative"), ("来なかった", "来る", "vk", "negative→past"), ("来い", "来る", "vk", "imperative"),
    ("高くない", "高い", "adj-i", "negative"), ("高かった", "高い", "adj-i", "past"), ("高ければ", "高い", "adj-i", "provisional"), ("高くて", "高い", "adj-i", "te"),
)


def _golden(spark, sf_dir):
    """Whether each case is among the forms of its surface."""
    cases = spark.createDataFrame(GOLDEN, "original string, form string, tag string, process string")
    found = dec.deconjugate(cases.select("original").distinct(), "original").withColumn("found", F.lit(True))
    return cases.join(found, ["original", "form", "tag", "process"], "left").select("original", "form", "process", F.coalesce("found", F.lit(False)).alias("found"))


QUERIES["deconjugate_golden"] = _golden
ORACLES["deconjugate_golden"] = _rows("original, form, process, found", *((s, f, p, p != "") for s, f, _, p in GOLDEN))


def _round_trip(spark, sf_dir):
    """Forms written out above, taken back: whether the verb is reached."""
    rows = [(w, form, s) for form, line in EXPECTED.items() for (w, _), s in zip(VERBS, line.split(), strict=True)]
    df = spark.createDataFrame(rows, "word string, form string, surface string")
    back = dec.deconjugate(df, "surface").select(F.col("original").alias("surface"), F.col("form").alias("word")).distinct().withColumn("reached", F.lit(True))
    return df.join(back, ["surface", "word"], "left").groupBy("form").agg(F.count_if(F.coalesce("reached", F.lit(False))).alias("reached"), F.count(F.lit(1)).alias("verbs"))


QUERIES["deconjugate_round_trip"] = _round_trip
#: ある has forms of its own in the negative and is of a class that the rules leave out.
_MISSED = {"te": 0, "past": 0, "polite": 0, "negative": 1, "imperative": 0}
ORACLES["deconjugate_round_trip"] = _rows("form, reached, verbs", *((f, len(VERBS) - _MISSED.get(f, 0), len(VERBS)) for f in EXPECTED))
_RULE_KINDS = (("きゃ", "く", "x", "v5k", "must", "only final"), ("た", "る", "past", "v1", "past", ""), ("せ", "す", "v5s", "v5s", "cause", "saspecial"), ("０", "0", "", "", "digit", "substitution"), ("り", "る", "v5r", "v5r", "", ""), ("んない", "らない", "adj-i", "v5r", "slurred", "never final"))


def _own_rules(spark, sf_dir):
    table = spark.createDataFrame(_RULE_KINDS, "con_end string, dec_end string, con_tag string, dec_tag string, detail string, kind string")
    return dec.deconjugate(spark.sql(_rows("text", ("書きゃ",), ("食べた",), ("させ",), ("話せ",), ("００",), ("走り",), ("やんない",), ("書きゃた",))), "text", table).select("original", "form", "process")


QUERIES["deconjugate_own_rules"] = _own_rules
ORACLES["deconjugate_own_rules"] = _rows("original, form, process", ("食べた", "食べる", "past"), ("書きゃ", "書く", "must"), ("話せ", "話す", "cause"), ("００", "０0", "digit"), ("書きゃた", "書きゃる", "past"))


def _to_lemma(spark, sf_dir):
    df = spark.sql(_rows("text, lemma", ("書かなかった", "書く"), ("食べさせられた", "食べる"), ("飲んでいる", "飲む")))
    return dec.deconjugate_to_lemma(df, "text", "lemma").where("tag in ('v5k', 'v1', 'v5m')").select("original", "form", "tag", dec.format_process(F.col("process")).alias("process")).where("not process like '%potential%'")


QUERIES["deconjugate_to_lemma"] = _to_lemma
ORACLES["deconjugate_to_lemma"] = _rows("original, form, tag, process", ("書かなかった", "書く", "v5k", "～negative→past"), ("食べさせられた", "食べる", "v1", "～causative→passive→past"), ("飲んでいる", "飲む", "v5m", "～progressive"))

# ---------------------------------------------------------------- lattice and search tokens

_TEXTS = ((1, "私は東京大学の学生です。"), (2, "日本語を読んだ"), (3, "国際空港へ行く"), (4, ""))


def _cuts(spark):
    df = spark.sql(_rows("id, text", *_TEXTS))
    return df.select("id", "text", lattice.all_modes(F.col("text")).alias("m"))


def _search_tokens(spark, sf_dir):
    t = _cuts(spark).select("id", F.posexplode(search_tokens.search_tokens(F.col("text"), F.col("m"), normalized=False)).alias("ord", "t")).select("id", "ord", "t.*")
    return search_tokens.positions(t, "id").select("id", "ord", "surface", "byte_start", "byte_end", "is_colocated", F.col("position").cast("int").alias("position"))


QUERIES["search_tokens"] = _search_tokens
ORACLES["search_tokens"] = _rows(
    "id, ord, surface, byte_start, byte_end, is_colocated, position",
    (1, 0, "私", 0, 3, False, 0), (1, 1, "は", 3, 6, False, 1), (1, 2, "東京大学", 6, 18, False, 2), (1, 3, "東京", 6, 12, True, 2), (1, 4, "大学", 12, 18, True, 2), (1, 5, "の", 18, 21, False, 3), (1, 6, "学生", 21, 27, False, 4), (1, 7, "。", 33, 36, False, 5),
    (2, 0, "日本語", 0, 9, False, 0), (2, 1, "日本", 0, 6, True, 0), (2, 2, "語", 6, 9, True, 0), (2, 3, "を", 9, 12, False, 1), (2, 4, "読ん", 12, 18, False, 2),
    (3, 0, "国際空港", 0, 12, False, 0), (3, 1, "国際", 0, 6, True, 0), (3, 2, "空港", 6, 12, True, 0), (3, 3, "へ", 12, 15, False, 1), (3, 4, "行く", 15, 21, False, 2),
)
QUERIES["detect_compounds"] = lambda spark, sf_dir: _cuts(spark).select("id", F.explode(search_tokens.compounds(F.col("m"))).alias("c")).select("id", "c.surface", F.array_join("c.components", "+").alias("components"))
ORACLES["detect_compounds"] = _rows("id, surface, components", (1, "東京大学", "東京+大学"), (2, "日本語", "日本+語"), (3, "国際空港", "国際+空港"))
QUERIES["extract_compounds"] = lambda spark, sf_dir: search_tokens.extract_compounds(_search_tokens(spark, sf_dir), "id").select("id", "surface", F.array_join("components", "+").alias("components"))
ORACLES["extract_compounds"] = ORACLES["detect_compounds"]
QUERIES["tok_modes"] = lambda spark, sf_dir: _cuts(spark).select("id", *[F.array_join(F.transform(F.col("m")[m], lambda x: x["surface"]), "/").alias(m) for m in "abc"])
ORACLES["tok_modes"] = _rows("id, a, b, c", (1, "私/は/東京/大学/の/学生/です/。", "私/は/東京/大学/の/学生/です/。", "私/は/東京大学/の/学生/です/。"), (2, "日本/語/を/読ん/だ", "日本/語/を/読ん/だ", "日本語/を/読ん/だ"), (3, "国際/空港/へ/行く", "国際/空港/へ/行く", "国際空港/へ/行く"), (4, "", "", ""))

# ---------------------------------------------------------------- rewriting

#: key, ord, surface, reading, dictionary form, part of speech joined by '-'
STREAMS = (
    (1, 0, "三", "サン", "三", "名詞-数詞"), (1, 1, "時", "トキ", "時", "名詞-普通名詞"), (1, 2, "に", "ニ", "に", "助詞-格助詞"), (1, 3, "は", "ハ", "は", "助詞-係助詞"),
    (2, 0, "食べ", "タベ", "食べる", "動詞-一般"), (2, 1, "て", "テ", "て", "助詞-接続助詞"), (2, 2, "そう", "ソウ", "そう", "名詞-普通名詞"), (2, 3, "だろう", "ダロウ", "だ", "助動詞-*"),
    (3, 0, "一", "イチ", "一", "名詞-数詞"), (3, 1, "人", "ニン", "人", "接尾辞-名詞的"), (3, 2, "何", "ナン", "何", "代名詞-*"), (3, 3, "を", "ヲ", "を", "助詞-格助詞"),
    (4, 0, "私", "シ", "私", "名詞-普通名詞"), (4, 1, "はさ", "ハサ", "はさ", "名詞-普通名詞"), (4, 2, "読ん", "ヨン", "読む", "動詞-一般"), (4, 3, "だ", "ダ", "た", "助動詞-*"),
)


def streams(spark):
    df = spark.sql(_rows("id, ord, surface, reading, dictionary_form, tags", *STREAMS))
    df = df.withColumn("pos", F.split("tags", "-")).withColumn("char_end", F.sum(F.char_length("surface")).over(rw._windows("id")).cast("int"))
    df = df.withColumn("char_start", F.col("char_end") - F.char_length("surface")).withColumn("cls", rw.coarse(F.col("pos"))).withColumn("rules", F.array().cast("array<string>"))
    return df.drop("tags")


def _rewritten(spark, only=None):
    out = rw.rewrite(streams(spark), "id", only)
    return out.select("id", "ord", "surface", "reading", "dictionary_form", "cls", "char_start", "char_end", F.array_join("rules", ",").alias("rules"))


QUERIES["rewrite_misparse"] = lambda spark, sf_dir: _rewritten(spark, ("cleanup_filter_misparse",)).where("rules <> ''").select("id", "surface", "dictionary_form", "cls")
ORACLES["rewrite_misparse"] = _rows("id, surface, dictionary_form, cls", (2, "そう", "そう", "adverb"), (2, "だろう", "だろう", "other"), (3, "人", "人", "counter"))
QUERIES["rewrite_readings"] = lambda spark, sf_dir: _rewritten(spark, ("disambiguation_fix_reading_ambiguity",)).where("rules <> ''").select("id", "surface", "reading", "cls")
ORACLES["rewrite_readings"] = _rows("id, surface, reading, cls", (1, "時", "ジ", "noun"), (3, "何", "ナニ", "pronoun"), (4, "私", "ワタシ", "pronoun"))
QUERIES["rewrite_pipeline"] = lambda spark, sf_dir: _rewritten(spark).groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "surface"))), lambda s: s["surface"]), "/").alias("surfaces"))
ORACLES["rewrite_pipeline"] = _rows("id, surfaces", (1, "三/時/には"), (2, "食べて/そう/だろう"), (3, "一人/何/を"), (4, "私/は/さ/読んだ"))

# ---------------------------------------------------------------- structure

QUERIES["split_sentences"] = lambda spark, sf_dir: spark.sql(_rows("id, text", (1, "今日は雨。明日は？晴れ！たぶん"), (2, "one!two?"), (3, ""))).select("id", F.posexplode(st.split_sentences(F.col("text"))).alias("n", "sentence"))
ORACLES["split_sentences"] = _rows("id, n, sentence", (1, 0, "今日は雨。"), (1, 1, "明日は？"), (1, 2, "晴れ！"), (1, 3, "たぶん"), (2, 0, "one!"), (2, 1, "two?"))
QUERIES["bucket_count"] = lambda spark, sf_dir: spark.sql(_rows("chunks, buckets", (15, None), (49, None), (50, None), (3, 8), (0, None), (100, 0))).select("chunks", F.coalesce("buckets", F.lit(-1)).alias("buckets"), st.bucket_count(F.col("chunks"), F.col("buckets"), F.lit(50)).alias("n"))
ORACLES["bucket_count"] = _rows("chunks, buckets, n", (15, -1, 1), (49, -1, 1), (50, -1, 4), (3, 8, 3), (0, -1, 1), (100, 0, 1))


def _argmax(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select("vec_id", st.argmax(F.col("embedding")).alias("best"))


QUERIES["decode_argmax"] = _argmax
ORACLES["decode_argmax"] = "SELECT vec_id, (list_position(embedding, list_max(embedding)) - 1)::INT AS best FROM embeddings"


def _multilabel(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return v.select("vec_id", F.array_join(st.labels_over(F.slice("embedding", 1, 3), ["x", "b", "c"], 0.05), ",").alias("labels"))


QUERIES["decode_multilabel"] = _multilabel
ORACLES["decode_multilabel"] = "SELECT vec_id, array_to_string(list_sort(list_filter([CASE WHEN embedding[1] >= 0.05 THEN 'x' END, CASE WHEN embedding[2] >= 0.05 THEN 'b' END, CASE WHEN embedding[3] >= 0.05 THEN 'c' END], lambda l: l IS NOT NULL)), ',') AS labels FROM embeddings"


def _multilabel_all(spark, sf_dir):
    """One label for each component, whole vectors decoded."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = v.agg(F.max(F.size("embedding"))).first()[0] or 0
    return v.select("vec_id", F.array_join(st.labels_over(F.col("embedding"), [f"c{i}" for i in range(1, n + 1)], 0.05), ",").alias("labels"))


QUERIES["decode_multilabel_all"] = _multilabel_all
ORACLES["decode_multilabel_all"] = "SELECT vec_id, array_to_string(list_sort(list_filter(list_transform(range(1, len(embedding) + 1), lambda i: CASE WHEN embedding[i] >= 0.05::DOUBLE THEN 'c' || i END), lambda l: l IS NOT NULL)), ',') AS labels FROM embeddings"
QUERIES["decode_bio"] = lambda spark, sf_dir: st.bio_spans(spark.sql(_rows("id, ord, tag, surface", (1, 0, "B-PERSON", "田"), (1, 1, "I-PERSON", "中"), (1, 2, "O", "は"), (1, 3, "I-DATE", "今"), (1, 4, "B-DATE", "日"), (2, 0, "O", "x"))), "id", "ord", "tag", "surface")
ORACLES["decode_bio"] = _rows("id, type, first, last, text", (1, "PERSON", 0, 1, "田中"), (1, "DATE", 3, 3, "今"), (1, "DATE", 4, 4, "日"))


def _crf(spark, sf_dir):
    df = spark.sql("SELECT 1 AS id, array(array(1.0D, 0.0D), array(0.0D, 1.0D), array(0.6D, 0.5D)) AS e UNION ALL SELECT 2, array(array(0.2D, 0.3D))")
    return df.select("id", F.array_join(st.viterbi(F.col("e"), [[0.5, -1.0], [-1.0, 0.5]], [0.0, 0.0], [0.0, 0.0]), ",").alias("path"))


QUERIES["crf_viterbi"] = _crf
ORACLES["crf_viterbi"] = _rows("id, path", (1, "0,0,0"), (2, "1"))
_NE = (("PERSON:田中", True), ("PERSON:たなか", False), ("ARTIFACT:本", False), ("ARTIFACT:本棚", True), ("DATE:きょう", True), ("OTHER:x", False), ("PERSON:", False), ("plain", False), ("MONEY:!!", False), ("LOCATION:東京", True))
QUERIES["filter_entities"] = lambda spark, sf_dir: spark.sql(_rows("value, expected", *_NE)).select("value", st.well_formed_entity(F.col("value")).alias("keep"))
ORACLES["filter_entities"] = _rows("value, keep", *_NE)


def _typo(spark, sf_dir):
    df = spark.sql("SELECT 1 AS id, array('a', 'b', 'c') AS c, array('K', 'D', 'z') AS k, array('', '', '-', '!') AS i")
    return df.select("id", st.apply_edits(F.col("c"), F.col("k"), F.col("i")).alias("text"))


QUERIES["typo_edits"] = _typo
ORACLES["typo_edits"] = _rows("id, text", (1, "a-z!"))
QUERIES["best_overlap"] = lambda spark, sf_dir: st.best_overlap(spark.sql("SELECT 1 AS id, 0 AS span, 0 AS start, 5 AS end UNION ALL SELECT 1, 1, 5, 9"), spark.sql("SELECT 1 AS id, 10 AS word, 0 AS wstart, 2 AS wend UNION ALL SELECT 1, 11, 2, 6 UNION ALL SELECT 1, 12, 6, 8"), "id")
ORACLES["best_overlap"] = _rows("id, span, word, overlap", (1, 0, 11, 3), (1, 1, 12, 2))

# ---------------------------------------------------------------- more rewriting and structure

MORE = (
    (1, 0, "お", "オ", "お", "接頭辞-*"), (1, 1, "茶", "チャ", "茶", "名詞-普通名詞"), (2, 0, "お金", "オカネ", "お金", "名詞-普通名詞"), (3, 0, "ほんとね", "ホントネ", "ほんとね", "感動詞-一般"),
    (4, 0, "走っ", "ハシッ", "走る", "動詞-一般"), (4, 1, "て", "テ", "て", "助詞-接続助詞"), (4, 2, "いる", "イル", "いる", "動詞-非自立可能"), (5, 0, "は", "ハ", "は", "助詞-係助詞"), (5, 1, "的", "テキ", "的", "接尾辞-形状詞的"),
)


def _more_streams(spark, rows=MORE):
    df = spark.sql(_rows("id, ord, surface, reading, dictionary_form, tags", *rows))
    df = df.withColumn("pos", F.split("tags", "-")).withColumn("char_end", F.sum(F.char_length("surface")).over(rw._windows("id")).cast("int"))
    return df.withColumn("char_start", F.col("char_end") - F.char_length("surface")).withColumn("cls", rw.coarse(F.col("pos"))).withColumn("rules", F.array().cast("array<string>")).drop("tags")


def _lexicon_rules(spark, sf_dir):
    lexicon = spark.sql(_rows("term", ("お茶",), ("金",), ("茶",)))
    out = rw.rewrite(_more_streams(spark), "id", lexicon=lexicon)
    return out.select("id", "ord", "surface", "dictionary_form", "cls", F.array_join("rules", ",").alias("rules"))


QUERIES["rewrite_lexicon"] = _lexicon_rules
ORACLES["rewrite_lexicon"] = _rows(
    "id, ord, surface, dictionary_form, cls, rules", (1, 0, "お茶", "お茶", "noun", "combine_prefixes"), (2, 0, "お金", "金", "noun", "repair_honorific_lemma"), (3, 0, "ほんと", "ほんと", "interjection", "repair_fused_interjection_particle"), (3, 1, "ね", "ね", "particle", "repair_fused_interjection_particle"),
    (4, 0, "走っている", "走る", "verb", "combine_inflections"), (5, 0, "は", "は", "particle", ""), (5, 1, "的", "的", "suffix", ""),
)
_INFLECTED = ((1, 0, "書か", "カカ", "書く", "動詞-一般"), (1, 1, "なかっ", "ナカッ", "ない", "助動詞-*"), (1, 2, "た", "タ", "た", "助動詞-*"), (1, 3, "本", "ホン", "本", "名詞-普通名詞"), (2, 0, "食べ", "タベ", "食べる", "動詞-一般"), (2, 1, "まし", "マシ", "ます", "助動詞-*"), (2, 2, "た", "タ", "た", "助動詞-*"), (2, 3, "よ", "ヨ", "よ", "助詞-終助詞"))
QUERIES["rewrite_inflections"] = lambda spark, sf_dir: rw.inflections(_more_streams(spark, _INFLECTED), "id").select("id", "surface", "dictionary_form")
ORACLES["rewrite_inflections"] = _rows("id, surface, dictionary_form", (1, "書かなかった", "書く"), (1, "本", "本"), (2, "食べました", "食べる"), (2, "よ", "よ"))
_PHRASES = ((1, 0, "adnominal"), (1, 1, "noun"), (1, 2, "particle"), (1, 3, "verb"), (1, 4, "auxiliary"))
QUERIES["base_phrases"] = lambda spark, sf_dir: st.base_phrases(spark.sql(_rows("id, ord, cls", *_PHRASES)), "id", "ord", "cls").select("id", F.col("phrase").cast("int").alias("phrase"), "first", "last", F.col("head").cast("int").alias("head"))
ORACLES["base_phrases"] = _rows("id, phrase, first, last, head", (1, 0, 0, 0, 1), (1, 1, 1, 2, 2), (1, 2, 3, 4, -1))


def _cohesion(spark, sf_dir):
    df = spark.sql(_rows("id, source, target, relation, score", (1, 0, 1, "ガ", 3.0), (1, 0, 2, "ガ", 0.0), (1, 0, 1, "ヲ", 0.1), (1, 0, 2, "ヲ", 0.1), (1, 0, 3, "ヲ", 0.1), (1, 2, 2, "ニ", 5.0), (1, 2, 0, "ニ", 0.0)))
    return st.cohesion(df.withColumn("score", F.col("score").cast("double")), "id")


QUERIES["decode_cohesion"] = _cohesion
ORACLES["decode_cohesion"] = _rows("id, source, relation, target", (1, 0, "ガ", 1))


def _discourse(spark, sf_dir):
    rows = [(1, 0, 1, 0, 1, "原因・理由", 4.0), (1, 0, 1, 0, 1, "談話関係なし", 1.0), (1, 0, 2, 0, 0, "目的", 9.0), (1, 1, 2, 1, 0, "談話関係なし", 5.0), (1, 1, 2, 1, 0, "目的", 1.0)]
    df = spark.createDataFrame(rows, "id int, left int, right int, left_sentence int, right_sentence int, relation string, score double")
    return st.discourse(df, "id").select("id", F.col("left").alias("source"), F.col("right").alias("target"), "relation")


QUERIES["decode_discourse"] = _discourse
ORACLES["decode_discourse"] = _rows("id, source, target, relation", (1, 0, 1, "原因・理由"))

_AXES = (
    (1, "食べる", "v1", ("passive", "polite", "negative", "past", "indicative"), "食べられませんでした", "passive:食べられる,polite_negative_past:食べられませんでした"), (2, "書く", "v5k", ("causative", "plain", "affirmative", "nonpast", "te"), "書かせて", "causative:書かせる,te:書かせて"),
    (3, "高い", "adj-i", ("active", "plain", "negative", "past", "indicative"), "高くなかった", "negative_past:高くなかった"), (4, "飲む", "v5m", ("active", "polite", "affirmative", "nonpast", "volitional"), "飲みましょう", "polite_volitional:飲みましょう"), (5, "飲む", "v5m", ("active", "polite", "negative", "past", "imperative"), None, None),
)


def _axes(spark, sf_dir):
    from functools import reduce

    from glyphmill.functions.axes import conjugate_axes

    parts = []
    for n, word, tag, (voice, politeness, polarity, tense, mood), _, _ in _AXES:
        c = conjugate_axes(F.col("word"), F.col("tag"), voice, politeness, polarity, tense, mood)
        parts.append(spark.sql(_rows("id, word, tag", (n, word, tag))).select("id", c.alias("c")))
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return both.select("id", "c.surface", F.array_join(F.transform("c.chain", lambda s: F.concat(s["axis"], F.lit(":"), s["surface"])), ",").alias("chain"))


QUERIES["conjugate_axes"] = _axes
ORACLES["conjugate_axes"] = _rows("id, surface, chain", *((n, s, c) for n, _, _, _, s, c in _AXES))
_CHAINS = ((1, "読む", "v5m", ["iru"], "past", "読んでいた"), (2, "食べる", "v1", ["sugiru", "shimau"], "polite_past", "食べすぎてしまいました"), (3, "書く", "v5k", ["yasui"], "negative", "書きやすくない"), (4, "待つ", "v5t", ["kudasai"], "dictionary", "待ってください"))


def _chains(spark, sf_dir):
    from functools import reduce

    from glyphmill.functions.axes import conjugate_chain

    parts = [spark.sql(_rows("id, word, tag", (n, w, t))).select("id", conjugate_chain(F.col("word"), F.col("tag"), aux, form).alias("surface")) for n, w, t, aux, form, _ in _CHAINS]
    return reduce(lambda a, b: a.unionByName(b), parts)


QUERIES["conjugate_chain"] = _chains
ORACLES["conjugate_chain"] = _rows("id, surface", *((c[0], c[5]) for c in _CHAINS))
QUERIES["rule_expand"] = lambda spark, sf_dir: dec.expand_rules(spark.sql("SELECT array('か', 'き') AS con_end, array('く') AS dec_end, array('a', 'i') AS con_tag, array('v5k') AS dec_tag, 'x' AS detail"))
ORACLES["rule_expand"] = _rows("con_end, dec_end, con_tag, dec_tag, detail", ("か", "く", "a", "v5k", "x"), ("き", "く", "i", "v5k", "x"))


# ---------------------------------------------------------------- copula, flags, processes

_COPULA = (
    ("da", "past", "だった", "のだった"), ("da", "negative", "じゃない", "のじゃない"), ("da", "polite", None, None), ("desu", "dictionary", "です", "のです"), ("desu", "polite_negative_past", "じゃありませんでした", "のじゃありませんでした"),
    ("dearu", "te", "であって", "のであって"), ("dearu", "polite_past", "でありました", "のでありました"), ("dearu", "conditional_ba", None, None), ("da", "conjectural", "だろう", "のだろう"),
)
QUERIES["conjugate_copula"] = lambda spark, sf_dir: spark.createDataFrame([r[:2] for r in _COPULA], "register string, form string").select("register", "form", verbs.conjugate_copula(F.col("register"), F.col("form")).alias("surface"), verbs.conjugate_explanatory(F.col("register"), F.col("form")).alias("explanatory"))
ORACLES["conjugate_copula"] = _rows("register, form, surface, explanatory", *_COPULA)
_FLAGS = (("dictionary", True, False, False, False), ("polite_negative_past", False, True, True, True), ("past_tari", False, False, True, False), ("prohibition", False, True, False, False), ("conjectural_polite", False, False, False, True), ("te", False, False, False, False))
QUERIES["form_flags"] = lambda spark, sf_dir: spark.createDataFrame([(r[0],) for r in _FLAGS], "form string").select("form", verbs.form_flags(F.col("form")).alias("f")).select("form", "f.*")
ORACLES["form_flags"] = _rows("form, is_base, is_negative, is_past, is_polite", *_FLAGS)
#: details outermost first; voice, politeness, polarity, tense, mood (all null: refused); the same, passing over unknown ones
_PROCESSES = (
    ("past,negative,causative", "causative plain negative past indicative", "causative plain negative past indicative"), ("polite past negative,passive/potential", "passive polite negative past indicative", "passive polite negative past indicative"),
    ("volitional,polite", "active polite affirmative nonpast volitional", "active polite affirmative nonpast volitional"), ("past,nonsense", None, "active plain affirmative past indicative"), ("", "active plain affirmative nonpast indicative", "active plain affirmative nonpast indicative"),
    ("te,(masu stem),potential", "potential plain affirmative nonpast te", "potential plain affirmative nonpast te"),
)


def _processes(spark, sf_dir):
    from glyphmill.functions.axes import axes_of_process

    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(_PROCESSES)], "id int, process string").withColumn("p", F.filter(F.split("process", ","), lambda d: d != ""))
    shown = lambda c: F.when(c.isNotNull(), F.concat_ws(" ", c["voice"], c["politeness"], c["polarity"], c["tense"], c["mood"]))
    return df.select("id", axes_of_process(F.col("p")).alias("s"), axes_of_process(F.col("p"), True).alias("l")).select("id", shown(F.col("s")).alias("strict"), shown(F.col("l")).alias("lenient"))


QUERIES["axes_of_process"] = _processes
ORACLES["axes_of_process"] = _rows("id, strict, lenient", *((k, r[1], r[2]) for k, r in enumerate(_PROCESSES)))
_CHAIN_PROCESSES = (("past,teiru,te,causative", "causative indicative", "iru", "past"), ("negative,completion,(te),excess", "active indicative", "sugiru+shimau", "nonpast"), ("past", "active indicative", "", "nonpast"))


def _chain_processes(spark, sf_dir):
    from glyphmill.functions.axes import chain_of_process

    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(_CHAIN_PROCESSES)], "id int, process string").withColumn("c", chain_of_process(F.split("process", ",")))
    return df.select("id", F.concat_ws(" ", "c.base.voice", "c.base.mood").alias("base"), F.array_join("c.auxiliaries", "+").alias("auxiliaries"), F.col("c.last.tense").alias("last"))


QUERIES["chain_of_process"] = _chain_processes
ORACLES["chain_of_process"] = _rows("id, base, auxiliaries, last", *((k, *r[1:]) for k, r in enumerate(_CHAIN_PROCESSES)))

# ---------------------------------------------------------------- text to rules, fused tokens, parts of speech, cleaning


def _analysed(spark, sf_dir):
    out = lattice.analyse(spark.sql(_rows("id, text", (1, "本を読んだ。"), (2, "日本語を食べている"), (3, ""), (4, None))), "text")
    return out.select("id", F.array_join(F.transform("tokens", lambda t: F.concat_ws(":", t["surface"], t["dictionary_form"], t["lemma_reading"])), " ").alias("tokens"))


QUERIES["analyse_text"] = _analysed
ORACLES["analyse_text"] = _rows("id, tokens", (1, "本:本:ホン を:を:ヲ 読んだ:読む:ヨム 。:。:。"), (2, "日本語:日本語:ニホンゴ を:を:ヲ 食べている:食べる:タベル"), (3, ""), (4, ""))


def _fused(spark, sf_dir):
    both = _cuts(spark).select("id", search_tokens.with_compounds(F.col("text"), F.col("m"), normalized=False).alias("b"))
    tokens = F.transform("b.tokens", lambda t: F.concat(t["surface"], F.when(t["is_colocated"], "*").otherwise("")))
    return both.select("id", F.array_join(tokens, " ").alias("tokens"), F.array_join(F.transform("b.compounds", lambda c: F.concat(c["surface"], F.lit("="), F.array_join(c["components"], "+"), F.lit("@"), c["byte_start"])), " ").alias("compounds"))


QUERIES["tokens_with_compounds"] = _fused
ORACLES["tokens_with_compounds"] = _rows(
    "id, tokens, compounds", (1, "私 は 東京大学 東京* 大学* の 学生 です 。", "東京大学=東京+大学@6"), (2, "日本語 日本* 語* を 読ん だ", "日本語=日本+語@0"), (3, "国際空港 国際* 空港* へ 行く", "国際空港=国際+空港@0"), (4, "", "")
)
_POS = (("形状詞", "一般", "形容詞", "*", False), ("代名詞", "*", "指示詞", "*", False), ("助詞", "格助詞", "助詞", "格助詞", True), ("補助記号", "句点", "特殊", "句点", True), ("外国語", None, "特殊", "*", False), ("動詞", "非自立可能", "動詞", "*", False))
QUERIES["structural_pos"] = lambda spark, sf_dir: spark.createDataFrame([r[:2] for r in _POS], "pos string, sub string").select("pos", F.coalesce("sub", F.lit("")).alias("sub"), st.structural_pos(F.col("pos")).alias("structural"), st.structural_subpos(F.col("sub")).alias("substructural"), st.is_function_pos(F.col("pos")).alias("is_function"))
ORACLES["structural_pos"] = _rows("pos, sub, structural, substructural, is_function", *((p, s or "", a, b, f) for p, s, a, b, f in _POS))


def _cleaned(spark, sf_dir):
    phrase = "named_struct('features', array({}), 'relations', array({}), 'head', {}, 'morphemes', array(named_struct('features', array({}))))"
    ne = lambda v: f"named_struct('key', 'NE', 'value', '{v}')"
    rows = ((1, [phrase.format(ne("PERSON:田中") + ", " + ne("PERSON:たなか"), "'x'", 1, "'m'"), phrase.format(ne("DATE:"), "", -1, "")], "'d'"), (2, [phrase.format("named_struct('key', 'X', 'value', 'PERSON:')", "", 0, "")], ""))
    made = " UNION ALL ".join(f"SELECT {k} AS id, array({', '.join(ps)}) AS phrases, array({d}) AS discourse" for k, ps, d in rows)
    df = spark.sql(made).withColumn("had", st.document_features(F.col("phrases"), F.col("discourse")))
    out = st.clean(df)
    return out.select("id", F.array_join(F.array_sort("had"), ",").alias("had"), F.array_join(F.flatten(F.transform("phrases", lambda p: F.transform(p["features"], lambda f: f["value"]))), ",").alias("features"), F.array_join("cleaned", ",").alias("cleaned"))


QUERIES["clean_documents"] = _cleaned
ORACLES["clean_documents"] = _rows("id, had, features, cleaned", (1, "arcs,discourse,entity_features,morpheme_features,phrase_features,relations", "PERSON:田中", "filter_ne"), (2, "arcs,phrase_features", "PERSON:", ""))


def _typo_threshold(spark, sf_dir):
    df = spark.sql("SELECT array('a', 'b', 'c') AS c, array('x', 'D', 'z') AS k, array('+', '', '-', '!') AS i, array(0.9D, 0.4D, 0.6D) AS ks, array(0.2D, 0.9D, 0.7D, 0.5D) AS is_")
    return df.select(*[st.apply_edits(F.col("c"), F.col("k"), F.col("i"), F.col("ks"), F.col("is_"), t).alias(f"t{int(10 * t)}") for t in (0.0, 0.5, 0.95)])


QUERIES["typo_edits_threshold"] = _typo_threshold
ORACLES["typo_edits_threshold"] = _rows("t0, t5, t9", ("+x-z!", "xb-z!", "abc"))


def _cohesion_kinds(spark, sf_dir):
    scores = spark.createDataFrame([(1, 2, 0, "ガ", 5.0), (1, 2, 1, "ガ", 0.0), (1, 1, 0, "ノ", 4.0), (1, 1, 2, "ノ", 9.0), (1, 0, 2, "ヲ", 7.0), (1, 2, 3, "ヲ", 9.0)], "id int, source int, target int, relation string, score double")
    kinds = spark.createDataFrame([(1, 0, False, True), (1, 1, False, True), (1, 2, True, False), (1, 3, False, False)], "id int, phrase int, predicate boolean, nominal boolean")
    return st.cohesion(scores, "id", kinds=kinds)


QUERIES["decode_cohesion_kinds"] = _cohesion_kinds
ORACLES["decode_cohesion_kinds"] = _rows("id, source, relation, target", (1, 2, "ガ", 0), (1, 1, "ノ", 0))


# ---------------------------------------------------------------- options of search tokens, kana, tags, vectors


def _search_options(spark, sf_dir):
    """Search tokens normalized and not, with and without function words, and surfaces alone."""
    df = spark.sql(_rows("id, text", (1, "本を食べている"), (2, "東京大学です")))
    df = df.select("id", "text", lattice.all_modes(F.col("text")).alias("m"))
    shown = lambda c: F.array_join(F.transform(c, lambda t: t["surface"]), " ")
    made = {(f, n): search_tokens.search_tokens(F.col("text"), F.col("m"), f, n) for f in (True, False) for n in (True, False)}
    return df.select("id", *[shown(c).alias(f"{'kept' if f else 'all'}_{'normal' if n else 'surface'}") for (f, n), c in made.items()], F.array_join(search_tokens.surfaces_only(made[True, False]), " ").alias("own"))


QUERIES["search_token_options"] = _search_options
ORACLES["search_token_options"] = _rows(
    "id, kept_normal, kept_surface, all_normal, all_surface, own", (1, "本 を 食べる 居る", "本 を 食べ いる", "本 を 食べる て 居る", "本 を 食べ て いる", "本 を 食べ いる"),
    (2, "東京大学 東京 大学", "東京大学 東京 大学", "東京大学 東京 大学 です", "東京大学 東京 大学 です", "東京大学"),
)


def _dependent(spark, sf_dir):
    tokens = _cuts(spark).select("id", F.explode("m.c").alias("t")).select("id", "t.*")
    return tokens.where(search_tokens.is_dependent_verb(F.col("pos1"), F.col("pos2"))).select("id", "surface")


QUERIES["dependent_verbs"] = _dependent
ORACLES["dependent_verbs"] = _rows("id, surface", (3, "行く"))
_KANA = (("カタカナ", "かたかな"), ("ヴァイオリン", "ゔぁいおりん"), ("ひらがなと漢字とABC", "ひらがなと漢字とABC"), ("コーヒー", "こーひー"), ("ヶ", "ゖ"), ("", ""))
QUERIES["katakana_to_hiragana"] = lambda spark, sf_dir: spark.createDataFrame([(k,) for k, _ in _KANA], "text string").select("text", verbs.katakana_to_hiragana(F.col("text")).alias("hiragana"))
ORACLES["katakana_to_hiragana"] = _rows("text, hiragana", *_KANA)


def _documents_kana(spark, sf_dir):
    """Katakana over the documents' words: letters a to z stand for katakana, which the query shifts and SQL maps."""
    letters, kata, hira = "aeioutnshrdlc", "アエイオウタナサハラダルカ", "あえいおうたなさはらだるか"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.md5(verbs.katakana_to_hiragana(F.translate("text", letters, kata))).alias("digest"))


QUERIES["documents_katakana"] = _documents_kana
ORACLES["documents_katakana"] = "SELECT doc_id, md5(translate(text, 'aeioutnshrdlc', 'あえいおうたなさはらだるか')) AS digest FROM documents"
_KEIGO = (("読む", "v5m", "お読みになる", "ご読みする"), ("説明する", "vs-s", "お説明しになる", "ご説明しする"), ("食べる", "v1", "お食べになる", "ご食べする"))
QUERIES["honorific_prefix"] = lambda spark, sf_dir: spark.createDataFrame([r[:2] for r in _KEIGO], "word string, tag string").select("word", verbs.conjugate_verb(F.col("word"), F.col("tag"), "honorific_oninaru").alias("honorific"), verbs.conjugate_verb(F.col("word"), F.col("tag"), "humble_osuru", "ご").alias("humble"))
ORACLES["honorific_prefix"] = _rows("word, honorific, humble", *((w, h, u) for w, _, h, u in _KEIGO))


def _tagged_sentences(spark, sf_dir):
    """Sentences of the benchmark's items from tags by character: a capital letter begins one."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    chars = items.select("item_id", F.posexplode(F.split("text", "")).alias("at", "c")).where("c <> ''").withColumn("tag", F.when(F.col("c").rlike("[A-Z]"), "B").otherwise("I"))
    return st.sentences_from_tags(chars, "item_id", "at", "c", "tag").select("item_id", "text")


QUERIES["sentences_from_tags"] = _tagged_sentences
ORACLES["sentences_from_tags"] = "SELECT item_id, s AS text FROM (SELECT item_id, unnest(regexp_extract_all(text, '(?s)^[^A-Z]+|[A-Z][^A-Z]*')) AS s FROM benchmark)"


def _pooled(spark, sf_dir):
    """Mean vectors of three embeddings at a time."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    out = st.pool_subwords(v.select(F.lit(1).alias("k"), F.floor(F.col("vec_id") / 3).alias("word"), "embedding"), "k", "word", "embedding")
    return out.select("word", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 3).alias("total"), F.size("embedding").alias("size"))


QUERIES["pool_subwords"] = _pooled
ORACLES["pool_subwords"] = "SELECT vec_id // 3 AS word, round(sum(list_sum(embedding::DOUBLE[])) / count(*), 3) AS total, max(len(embedding))::INT AS size FROM embeddings GROUP BY 1"


def _sentences_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.size(st.split_sentences(F.col("text"))).alias("sentences"), F.element_at(st.split_sentences(F.col("text")), -1).alias("last"))


QUERIES["documents_split_sentences"] = _sentences_of_documents
ORACLES["documents_split_sentences"] = "SELECT doc_id, len(s)::INT AS sentences, s[len(s)] AS last FROM (SELECT doc_id, regexp_extract_all(text, '(?s)[^。！？!?]*[。！？!?]|[^。！？!?]+$') AS s FROM documents)"


def _bio_of_documents(spark, sf_dir):
    """Runs of words by their first letters, from tags: t begins a T, h goes on with it; a begins an A."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = docs.select("doc_id", F.posexplode(F.split("text", " ")).alias("at", "w"))
    tag = F.when(F.col("w").startswith("t"), "B-T").when(F.col("w").startswith("h"), "I-T").when(F.col("w").startswith("a"), "B-A").otherwise("O")
    found = st.bio_spans(words.withColumn("tag", tag), "doc_id", "at", "tag", "w")
    return found.groupBy("doc_id", "type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("last") - F.col("first")).alias("more"))


QUERIES["documents_bio"] = _bio_of_documents
ORACLES["documents_bio"] = """WITH w AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents),
    t AS (SELECT doc_id, i, CASE WHEN w LIKE 't%' THEN 'B' WHEN w LIKE 'h%' THEN 'I' WHEN w LIKE 'a%' THEN 'B' ELSE 'O' END AS b, CASE WHEN w LIKE 't%' OR w LIKE 'h%' THEN 'T' WHEN w LIKE 'a%' THEN 'A' END AS k FROM w),
    s AS (SELECT *, k IS NOT NULL AND (b = 'B' OR coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY i), '') <> k) AS opens FROM t)
    SELECT doc_id, k AS type, count_if(opens) AS n, (count(*) - count_if(opens))::BIGINT AS more FROM s WHERE k IS NOT NULL GROUP BY ALL"""


def _viterbi_of_vectors(spark, sf_dir):
    """Two tags over the pairs of each embedding's components; with no transitions the best path is the larger of each."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    pairs = F.transform(F.sequence(F.lit(1), F.lit(7), F.lit(2)), lambda i: F.array(F.element_at("embedding", i).cast("double"), F.element_at("embedding", i + 1).cast("double")))
    return v.select("vec_id", F.array_join(st.viterbi(pairs, [[0.0, 0.0], [0.0, 0.0]], [0.0, 0.0], [0.0, 0.0]), "").alias("path"))


QUERIES["vectors_viterbi"] = _viterbi_of_vectors
ORACLES["vectors_viterbi"] = "SELECT vec_id, array_to_string(list_transform([1, 3, 5, 7], lambda i: CASE WHEN embedding[i + 1] > embedding[i] THEN 1 ELSE 0 END), '') AS path FROM embeddings"
