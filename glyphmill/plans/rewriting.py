"""Queries of the rewriting stages: one a stage over fixtures with expected rows written out, and stages over token streams
made of the documents' words, against SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from glyphmill.operators import rewrite as rw

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_HEAD = ("surface", "pos", "lemma", "normal", "reading")

#: stage: rows of (stream, terms of the lexicon, what the stream becomes). A token: surface/part of speech/dictionary
#: form/normalised form/reading, what is left out being the surface or empty. A term after ! is known not to exist.
#: What it becomes: surface:dictionary form:class of each token.
CASES: dict[str, list[tuple[str, str, str]]] = {
    "split_compound_auxiliary_verbs": [
        ("書き続け/動詞/書き続ける た/助動詞", "", "書き:書き:verb 続け:続ける:verb た:た:auxiliary"),
        ("滲み出し/動詞/滲み出す", "滲み出す", "滲み出し:滲み出す:verb"),
        ("食べ始める/動詞 飲み終わっ/動詞/飲み終わる", "!食べ始める", "食べ:食べ:verb 始める:始める:verb 飲み:飲み:verb 終わっ:終わる:verb"),
        ("出す/動詞 続ける/動詞", "", "出す:出す:verb 続ける:続ける:verb"),
    ],
    "split_tatte_particle": [
        ("だな/名詞/棚/棚", "", "だ:だ:auxiliary な:な:particle"),
        ("言っ/動詞/言う たって/助詞-接続助詞", "", "言っ:言う:verb た:た:auxiliary って:って:particle"),
        ("本/名詞 だって/助詞-接続助詞", "", "本:本:noun だって:だって:particle"),
    ],
    "split_tan_suffix": [
        ("食べ/動詞/食べる たん/接尾辞 だ/助動詞", "", "食べた:食べる:verb ん:の:particle だ:だ:auxiliary"),
        ("行って/動詞/行く たん/接尾辞 です/助動詞", "", "行ってた:行く:verb ん:の:particle です:です:auxiliary"),
        ("猫/名詞 たん/接尾辞 だ/助動詞", "!猫る", "猫:猫:noun たん:たん:suffix だ:だ:auxiliary"),
        ("食べ/動詞/食べる たん/接尾辞 が/助詞", "", "食べ:食べる:verb たん:たん:suffix が:が:particle"),
    ],
    "split_tawake_noun": [
        ("行っ/動詞/行く たわけ/名詞", "", "行っ:行く:verb た:た:auxiliary わけ:わけ:noun"),
        ("この/連体詞 たわけ/名詞", "", "この:この:adnominal たわけ:たわけ:noun"),
        ("っ/補助記号 たわけ/名詞/たわける", "", "っ:っ:symbol た:た:auxiliary わけ:わけ:noun"),
    ],
    "split_proper_noun_with_particle": [
        ("大阪と京都/名詞-固有名詞", "大阪 京都", "大阪:大阪:noun と:と:particle 京都:京都:noun"),
        ("大阪と京都/名詞-固有名詞", "大阪", "大阪と京都:大阪と京都:noun"),
        ("大阪と京都/名詞-普通名詞", "大阪 京都", "大阪と京都:大阪と京都:noun"),
    ],
    "repair_hasa_noun": [("はさ/名詞", "", "は:は:particle さ:さ:particle"), ("はさ/動詞/はす", "", "はさ:はす:verb")],
    "repair_n_tokenisation": [
        ("んだ/助動詞", "", "ん::auxiliary だ:だ:auxiliary"),
        ("行く/動詞 ん/助詞/の だけど/接続詞", "!行くむ !行くぶ !行くぬ", "行く:行く:verb ん:の:particle だ:だ:auxiliary けど:けど:conjunction"),
        ("そうだ/副詞", "", "そう:そう:auxiliary だ:だ:auxiliary"),
        ("飲ん/動詞/飲む で/助詞-接続助詞", "", "飲んで:飲む:verb"),
        ("飲/名詞 ん/助動詞 だ/助動詞", "", "飲んだ:飲:verb"),
    ],
    "repair_vowel_elongation": [
        ("ねー/助詞/ね", "", "ね:ね:particle"),
        ("ケドー/名詞", "", "けど:けど:conjunction"),
        ("すごーい/形容詞/すごーい/凄い", "", "すごい:すごい:adjective"),
        ("ちゃ/名詞 んー/感動詞", "", "ちゃん:ちゃ:suffix"),
        ("バズ/接頭辞 る/名詞 ー/補助記号", "", "バズる:バズる:verb"),
        ("行/名詞 こー/名詞", "", "行こう:行こう:verb"),
        ("行/名詞 こ/名詞 ー/補助記号", "", "行こう:行こう:verb"),
        ("早/形容詞/早い くー/感動詞", "", "早く:早い:adjective"),
        ("見/動詞/見る たあ/感動詞 ー/補助記号", "", "見た:見る:verb あ:あ:interjection ー:ー:symbol"),
        ("食べ/動詞/食べる るう/感動詞 ー/補助記号", "", "食べる:食べる:verb う:う:interjection ー:ー:symbol"),
    ],
    "repair_process_special_cases": [
        ("ノヨ/名詞", "", "ノ:の:particle ヨ:よ:particle"),
        ("で/助動詞/だ しょう/名詞", "", "でしょう:でしょう:other"),
        ("で/接続詞 本/名詞", "", "で:で:particle 本:本:noun"),
        ("で/接続詞 も/助詞", "", "で:で:conjunction も:も:particle"),
        ("ぬ/動詞/ぬる/寝る", "", "ぬ:ぬる:auxiliary"),
        ("なれ/代名詞/なれ/汝", "", "なれ:なれ:verb"),
        ("人前で/連語 様に/連語", "", "人前:人前:noun で:で:particle 様:様:noun に:に:particle"),
        ("おけばいい/連語", "", "おけ:おく:verb ば:ば:particle いい:いい:adjective"),
        ("死んで/連語", "", "死んで:死ぬ:verb"),
    ],
    "repair_colloquial_negative_nee": [
        ("知っ/動詞/知る て/助詞 ね/助詞 え/感動詞", "", "知っ:知る:verb て:て:particle ねえ:ない:auxiliary"),
        ("本/名詞 ね/助詞 え/感動詞", "", "本:本:noun ね:ね:particle え:え:interjection"),
    ],
    "repair_colloquial_ran_nai": [
        ("見て/動詞/見る らん/助動詞 ねえ/助動詞", "", "見て:見る:verb らんねえ:られない:auxiliary"),
        ("本/名詞 らん/助動詞 ない/助動詞", "", "本:本:noun らん:らん:auxiliary ない:ない:auxiliary"),
    ],
    "repair_honorific_lemma": [("お茶/名詞 ご飯/名詞 おかね/名詞", "茶 ご飯 飯 !かね", "お茶:茶:noun ご飯:ご飯:noun おかね:おかね:noun")],
    "repair_compound_noun_suffix": [("世界中/名詞 呼び出し/名詞 学生時/名詞 中/名詞", "世界 呼び 呼び出し", "世界中:世界:noun 呼び出し:呼び出し:noun 学生時:学生時:noun 中:中:noun")],
    "combine_prefixes": [
        ("お/接頭辞 茶/名詞", "お茶", "お茶:お茶:noun"),
        ("お/接頭辞 茶/名詞", "", "お:お:prefix 茶:茶:noun"),
        ("未/接頭辞 払う/動詞", "未払う", "未払う:未払う:noun"),
        ("お/接頭辞 飲む/動詞", "お飲む", "お:お:prefix 飲む:飲む:verb"),
    ],
    "combine_inflections": [
        ("書か/動詞/書く なかっ/助動詞/ない た/助動詞 本/名詞", "", "書かなかった:書く:verb 本:本:noun"),
        ("食べ/動詞/食べる させ/助動詞/させる られ/助動詞/られる て/助詞-接続助詞 い/動詞-非自立可能/いる なかっ/助動詞/ない た/助動詞", "", "食べさせられていなかった:食べる:verb"),
        ("食べ/動詞/食べる まし/助動詞/ます た/助動詞 よ/助詞", "", "食べました:食べる:verb よ:よ:particle"),
        ("勉強/名詞-サ変可能 し/動詞-非自立可能/する た/助動詞", "", "勉強:勉強:noun した:する:verb"),
        ("勉強/名詞-サ変可能 せん/名詞 本/名詞", "", "勉強:勉強:noun せん:せん:noun 本:本:noun"),
        ("食べ/動詞/食べる そうだ/副詞", "", "食べそう:食べる:verb だ:だ:auxiliary"),
        ("高く/形容詞/高い て/助詞-接続助詞", "", "高くて:高い:adjective"),
        ("飲み/動詞/飲む やすい/接尾辞-形容詞的", "", "飲みやすい:飲む:verb"),
        ("飲ん/動詞/飲む だ/助動詞", "", "飲ん:飲む:verb だ:だ:auxiliary"),
    ],
    "combine_amounts": [
        ("一/名詞-数詞 人/接尾辞 二/名詞-数詞 階/接尾辞 四/名詞-数詞 人/接尾辞", "", "一人:一人:noun 二階:二階:noun 四:四:noun 人:人:suffix"),
        ("十/名詞-数詞 分/接尾辞 十/名詞-数詞 日/接尾辞", "", "十分:十分:noun 十:十:noun 日:日:suffix"),
    ],
    "combine_tte": [("行っ/動詞/行く て/助詞 み/動詞/みる", "", "行って:行く:verb み:みる:verb")],
    "combine_auxiliary_verb_stem": [
        ("降り/動詞/降りる そう/形状詞-助動詞語幹", "", "降りそう:降りる:verb"),
        ("降る/動詞 よう/形状詞-助動詞語幹", "", "降る:降る:verb よう:よう:adjectival_noun"),
        ("早/接尾辞/早い そう/形状詞-助動詞語幹", "", "早そう:早い:suffix"),
    ],
    "combine_suffix": [
        ("高/形容詞/高い さ/接尾辞", "", "高さ:高さ:adjective"),
        ("慣れ/動詞/慣れる っこ/接尾辞", "", "慣れっこ:慣れる:verb"),
        ("彼/代名詞 ら/接尾辞 貴様/代名詞 ら/接尾辞", "", "彼ら:彼ら:pronoun 貴様:貴様:pronoun ら:ら:suffix"),
        ("久し/形容詞/久しい ぶり/接尾辞 二年/名詞 ぶり/接尾辞", "", "久しぶり:久しぶり:adjective 二年:二年:noun ぶり:ぶり:suffix"),
    ],
    "cleanup_reclassify_orphaned_suffixes": [("は/助詞 化/接尾辞 名/名詞 化/接尾辞 が/助詞 さん/接尾辞 の/助詞 的/接尾辞-形状詞的", "", "は:は:particle 化:化:noun 名:名:noun 化:化:suffix が:が:particle さん:さん:suffix の:の:particle 的:的:suffix")],
    "combine_conjunctive_particle": [("飲ん/動詞/飲む で/助詞-接続助詞 も/助詞 本/名詞 で/助詞-接続助詞", "", "飲んで:飲む:verb も:も:particle 本:本:noun で:で:particle")],
    "combine_auxiliary": [
        ("で/助動詞/だ ある/動詞", "", "である:である:verb"),
        ("行か/動詞/行く ない/助動詞 らしい/助動詞", "", "行かない:行く:verb らしい:らしい:auxiliary"),
        ("行く/動詞 です/助動詞 行き/動詞/行く ませ/助動詞/ます ん/助動詞 でし/助動詞/です た/助動詞", "", "行く:行く:verb です:です:auxiliary 行きませんでした:行く:verb"),
        ("飲ん/動詞/飲む だ/助動詞 静か/形状詞 だ/助動詞", "", "飲んだ:飲む:verb 静か:静か:adjectival_noun だ:だ:auxiliary"),
        ("について/連語 た/助動詞", "", "についてた:について:other"),
    ],
    "combine_to_naru": [("春/名詞 と/助詞 なり/動詞/なる 走る/動詞 と/助詞 なる/動詞", "", "春:春:noun となり:となる:verb 走る:走る:verb と:と:particle なる:なる:verb")],
    "repair_fused_interjection_particle": [
        ("ほんとよね/感動詞", "", "ほんと:ほんと:interjection よね:よね:particle"),
        ("さよなら/感動詞 こらな/感動詞", "さよなら !こら", "さよなら:さよなら:interjection こらな:こらな:interjection"),
    ],
    "repair_orphaned_auxiliary": [
        ("仕事頼/名詞 む/動詞/む", "仕事 頼む", "仕事:仕事:noun 頼む:頼む:verb"),
        ("本読/名詞 れる/助動詞", "本 読む", "本:本:noun 読れる:読む:verb"),
        ("本読/名詞 む/動詞/む", "本", "本読:本読:noun む:む:verb"),
    ],
    "combine_adverbial_particle": [("食べ/動詞/食べる たり/助詞-副助詞 本/名詞 だり/助詞-副助詞", "", "食べたり:食べる:verb 本:本:noun だり:だり:particle")],
    "combine_verb_dependant": [
        ("走って/動詞/走る いる/動詞-非自立可能", "", "走っている:走る:verb"),
        ("食べ/動詞/食べる まくる/動詞-非自立 食べ/動詞/食べる おる/動詞-非自立", "", "食べまくる:食べる:verb 食べ:食べる:verb おる:おる:verb"),
        ("勉強/名詞-サ変可能 し/動詞-非自立可能/する 勉強/名詞-サ変可能 する/動詞-非自立可能", "", "勉強し:勉強:noun 勉強:勉強:noun する:する:verb"),
        ("置い/動詞/置く て/助詞/て ある/動詞-非自立可能", "", "置いてある:置く:verb"),
        ("教えて/動詞/教える くれ/動詞/くれる 来て/動詞/来る よい/形容詞", "", "教えてくれ:教える:verb 来て:来る:verb よい:よい:adjective"),
        ("待っ/動詞/待つ とる/動詞", "", "待っとる:待つ:verb"),
        ("巻き/動詞/巻く 付く/動詞-非自立可能", "", "巻き:巻く:verb 付く:付く:verb"),
    ],
    "combine_particles": [
        ("に/助詞 は/助詞 の/助詞 に/助詞 は/助詞", "", "には:には:particle のに:のに:particle は:は:particle"),
        ("か/助詞 も/助詞 しれ/動詞/しれる ない/助動詞", "", "かもしれ:か:other ない:ない:auxiliary"),
        ("で/助詞 は/助詞 ない/形容詞 か/助詞", "", "ではないか:ではないか:other"),
        ("で/助詞 は/助詞 なかっ/形容詞/無い た/助動詞", "", "ではなかっ:ではない:other た:た:auxiliary"),
    ],
    "combine_final": [("行け/動詞/行く ば/助詞 本/名詞 ば/助詞", "", "行けば:行く:verb 本:本:noun ば:ば:particle")],
    "repair_tanka_to_ta_n_ka": [
        ("食べて/動詞/食べる たんか/名詞", "", "食べてた:食べる:verb ん:の:particle か:か:particle"),
        ("食べ/動詞/食べる 、/補助記号 たんか/名詞", "", "食べた:食べる:verb 、:、:symbol ん:の:particle か:か:particle"),
        ("食べ/動詞/食べる たんか/名詞 を/助詞", "", "食べ:食べる:verb たんか:たんか:noun を:を:particle"),
    ],
    "cleanup_filter_misparse": [
        ("なん/名詞 そう/名詞 おい/副詞 つ/接尾辞 本/接尾辞-助数詞", "", "なん:なん:prefix そう:そう:adverb おい:おい:interjection つ:つ:counter 本:本:counter"),
        ("三/名詞-数詞 人/接尾辞 犬/名詞 人/接尾辞", "", "三:三:noun 人:人:counter 犬:犬:noun 人:人:suffix"),
        ("家/接尾辞 から/助詞 家/接尾辞 山/接尾辞", "", "家:家:noun から:から:particle 家:家:suffix 山:山:noun"),
        ("だろう/助動詞/だ だろ/助動詞/だ だあ/感動詞 だー/感動詞", "", "だろう:だろう:other だろ:だろ:other だ:です:auxiliary だー:です:auxiliary"),
    ],
}

#: stream, readings it becomes.
READING_CASES = [
    ("表/名詞///ヒョウ へ/助詞", "オモテ "), ("紙/名詞 表/名詞///ヒョウ へ/助詞", " ヒョウ "), ("何/代名詞///ナン を/助詞 何/代名詞///ナン", "ナニ  ナニ"), ("何/代名詞///ナン で/助詞", "ナン "),
    ("一月/名詞 一日/名詞///ツイタチ 一日/名詞///ツイタチ", " ツイタチ イチニチ"), ("禍/名詞///カ 私/名詞///シ 私/代名詞///ワタクシ", "ワザワイ ワタシ ワタシ"), ("寒気/名詞///カンキ が/助詞 する/動詞", "サムケ  "),
    ("寒気/名詞///カンキ が/助詞 来る/動詞", "カンキ  "), ("後/名詞///ゴ 三/名詞-数詞 時/名詞///トキ 時/名詞///トキ", "アト  ジ トキ"), ("次/接頭辞///ジ 次/名詞///ジ 何時/名詞///ナンドキ 隙/名詞///ヒマ", "ツギ ジ ナンジ スキ"),
    ("弄っ/動詞/弄う//イラッ 今日/名詞///コンニチ 玩具/名詞///ガング 雪道/名詞///セツドウ 日本/名詞///ニッポン", "イジッ キョウ オモチャ ユキミチ ニホン"),
    ("明日/名詞///アス 山道/名詞///サンドウ 富士山/名詞///フジヤマ 二日/名詞///フタカ 昨日/名詞///キノウ", "アシタ ヤマミチ フジサン フツカ キノウ"),
]


def _values(names: str, rows) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(str(c) if isinstance(c, int) else f"'{c}'" for c in r) + ')' for r in rows)}) AS fixture({names})"


def streams_of(df):
    """A column `stream` of specifications as tokens."""
    parts = F.transform(F.filter(F.split("stream", " "), lambda t: t != ""), lambda t: F.split(t, "/"))
    part = lambda p, k: F.coalesce(F.get(p, F.lit(k)), F.lit(""))
    size = lambda ps: F.aggregate(ps, F.lit(0), lambda n, p: n + F.char_length(p[0]))

    def token(p, i):
        start = size(F.slice(parts, 1, i))
        lemma = F.when(part(p, 2) == "", p[0]).otherwise(part(p, 2))
        return F.struct(
            p[0].alias("surface"), part(p, 4).alias("reading"), lemma.alias("dictionary_form"), F.when(part(p, 3) == "", lemma).otherwise(part(p, 3)).alias("normalized_form"),
            F.split(part(p, 1), "-").alias("pos"), start.alias("char_start"), (start + F.char_length(p[0])).alias("char_end"),
        )

    return df.withColumn("tokens", F.transform(parts, token))


def _shown(field):
    return F.array_join(F.transform("tokens", field), " ")


def _stage_query(name: str):
    def query(spark, sf_dir):
        cases = CASES[name]
        by_terms: dict[str, list[int]] = {}
        for k, (_, terms, _) in enumerate(cases):
            by_terms.setdefault(terms, []).append(k)
        out = None
        for terms, ids in by_terms.items():  # streams that ask the same lexicon
            df = streams_of(spark.sql(_values("id, stream", [(k, cases[k][0]) for k in ids])))
            lexicon = spark.createDataFrame([(t.lstrip("!"), not t.startswith("!")) for t in terms.split()], "term string, known boolean") if terms else None
            found = rw.rewrite_streams(df.select("id", "tokens"), "tokens", (name,), lexicon)
            found = found.select("id", _shown(lambda t: F.concat_ws(":", t["surface"], t["dictionary_form"], t["cls"])).alias("tokens"), F.element_at("tokens", -1)["char_end"].alias("char_end"))
            out = found if out is None else out.unionByName(found)
        return out

    return query


def _chars(stream: str) -> int:
    return sum(len(t.split("/")[0]) for t in stream.split())


for _name, _cases in CASES.items():
    QUERIES[f"stage_{_name}"] = _stage_query(_name)
    ORACLES[f"stage_{_name}"] = _values("id, tokens, char_end", [(k, after, _chars(before)) for k, (before, _, after) in enumerate(_cases)])


def _readings(spark, sf_dir):
    df = streams_of(spark.sql(_values("id, stream", [(k, s) for k, (s, _) in enumerate(READING_CASES)])))
    return rw.rewrite_streams(df.select("id", "tokens"), "tokens", ("disambiguation_fix_reading_ambiguity",)).select("id", _shown(lambda t: t["reading"]).alias("readings"))


QUERIES["stage_disambiguation_fix_reading_ambiguity"] = _readings
ORACLES["stage_disambiguation_fix_reading_ambiguity"] = _values("id, readings", [(k, after) for k, (_, after) in enumerate(READING_CASES)])


# ---------------------------------------------------------------- streams of the documents' words

#: Tokens that words stand for: a word of n characters is the one at n + the code of its first character, modulo their number.
VOCABULARY = (
    ("三", "名詞-数詞", "サン"), ("人", "接尾辞-名詞的", "ニン"), ("家", "接尾辞-名詞的", "ケ"), ("から", "助詞-格助詞", "カラ"), ("を", "助詞-格助詞", "ヲ"), ("時", "名詞-普通名詞", "トキ"), ("何", "代名詞-*", "ナン"),
    ("そう", "名詞-普通名詞", "ソウ"), ("だろう", "助動詞-*", "ダロウ"), ("は", "助詞-係助詞", "ハ"), ("に", "助詞-格助詞", "ニ"), ("表", "名詞-普通名詞", "ヒョウ"), ("一日", "名詞-普通名詞", "ツイタチ"), ("一月", "名詞-普通名詞", "イチガツ"),
    ("はさ", "名詞-普通名詞", "ハサ"), ("たわけ", "名詞-普通名詞", "タワケ"), ("行っ", "動詞-一般", "イッ"), ("て", "助詞-接続助詞", "テ"), ("後", "名詞-普通名詞", "ゴ"),
)
_N = len(VOCABULARY)
_WORDS = f"""SELECT doc_id, ord, v.surface, v.pos, v.reading FROM (
    SELECT doc_id, generate_subscripts(w, 1) - 1 AS ord, unnest(w) AS word FROM (SELECT doc_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM documents)
) JOIN (VALUES {', '.join(f"({k}, '{s}', '{p}', '{r}')" for k, (s, p, r) in enumerate(VOCABULARY))}) AS v(k, surface, pos, reading) ON v.k = (length(word) + ascii(word)) % {_N}"""


def document_streams(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null")
    table = F.array(*[F.struct(F.lit(s).alias("surface"), F.lit(r).alias("reading"), F.lit(s).alias("dictionary_form"), F.array(*map(F.lit, p.split("-"))).alias("pos")) for s, p, r in VOCABULARY])
    words = F.filter(F.split("text", " "), lambda w: w != "")
    tokens = F.transform(words, lambda w, i: F.get(table, (F.char_length(w) + F.ascii(w)) % _N).withField("char_start", i).withField("char_end", i + 1))
    return docs.select("doc_id", tokens.alias("tokens"))


def word_streams(own, texts: pa.Array):
    """The streams of `document_streams`, of an array of texts: (first row, last row, streams), some rows at a time."""
    from glyphmill.operators.memo import Streams

    table = [rw.Token(s, r, s, s, "", tuple(p.split("-")), rw.CLASSES.get(p.split("-")[0], "other"), 0, 0, ()) for s, p, r in VOCABULARY]
    for first, last in own.pieces(np.asarray(pc.fill_null(pc.binary_length(texts), 0), np.int64) // 4):
        rows = pc.fill_null(texts.slice(first, last - first), "").cast(pa.large_string())
        _, offsets, data = rows.buffers()
        bounds = np.frombuffer(offsets, np.int64)[rows.offset : rows.offset + len(rows) + 1]
        text = np.frombuffer(data if data is not None else b"", np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        blank = text == ord(" ")
        after = np.concatenate([[True], blank])[: len(text)]
        after[bounds[bounds < len(text)]] = True
        begins = np.flatnonzero(~blank & after)
        lengths = np.diff(np.searchsorted(begins, bounds))
        chars = np.add.reduceat(~blank & (text & 0xC0 != 0x80), begins, dtype=np.int64) if len(begins) else begins
        kinds = np.array([own.kind(t) for t in table], np.int64)[(chars + _code_points(text, begins)) % _N]
        place = np.arange(len(begins)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        yield first, last, Streams(lengths, kinds, place, place + 1)


def _code_points(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The characters of UTF-8 text that begin at some bytes."""
    code = text[at].astype(np.int64)
    long = np.flatnonzero(code >= 0xC0)
    head = code[long]
    size = 2 + (head >= 0xE0) + (head >= 0xF0)
    value = head & (0x7F >> size)
    for k in range(1, 4):
        more = size > k
        value[more] = value[more] << 6 | text[at[long[more]] + k] & 0x3F
    code[long] = value
    return code


def _over_documents(stage: str):
    def query(spark, sf_dir):
        docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null").select("doc_id", "text")
        out = rw.tally_streams(docs, "text", ("surface", "cls", "reading"), (stage,), make=word_streams)
        return out.groupBy("doc_id", "surface", "cls", "reading").agg(F.sum("n").alias("n"), F.sum("places").alias("places"))

    return query


_CLASS = "CASE split_part(pos, '-', 1) " + " ".join(f"WHEN '{k}' THEN '{c}'" for k, c in rw.CLASSES.items()) + " ELSE 'other' END"
_BY = "SELECT doc_id, surface, cls, reading, count(*) AS n, sum(ord)::BIGINT AS places FROM x GROUP BY ALL"
_AROUND = f"""WITH t AS ({_WORDS}), a AS (SELECT *, {_CLASS} AS c, lag(surface) OVER w AS ps, lag(pos) OVER w AS pp, lead(surface) OVER w AS ns, lead(pos) OVER w AS np FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY ord))"""

QUERIES["documents_filter_misparse"] = _over_documents("cleanup_filter_misparse")
ORACLES["documents_filter_misparse"] = f"""{_AROUND}, x AS (SELECT doc_id, ord, surface, reading, CASE
    WHEN surface = 'そう' THEN 'adverb' WHEN surface = 'だろう' THEN 'other'
    WHEN surface = '人' AND pp LIKE '%数詞%' THEN 'counter' WHEN surface = '家' AND np LIKE '助詞%' AND ns IN ('から', 'を', 'は', 'に') THEN 'noun' ELSE c END AS cls FROM a) {_BY}"""
QUERIES["documents_fix_reading_ambiguity"] = _over_documents("disambiguation_fix_reading_ambiguity")
ORACLES["documents_fix_reading_ambiguity"] = f"""{_AROUND}, x AS (SELECT doc_id, ord, surface, c AS cls, CASE
    WHEN surface = '表' AND ns IN ('へ', 'に') AND NOT coalesce(pp LIKE '名詞%', false) THEN 'オモテ'
    WHEN surface = '何' AND coalesce(ns IN ('を', 'が', 'も'), true) THEN 'ナニ'
    WHEN surface = '一日' AND NOT coalesce(ps LIKE '%月', false) THEN 'イチニチ'
    WHEN surface = '後' AND np LIKE '%数詞%' THEN 'アト' WHEN surface = '時' AND pp LIKE '%数詞%' THEN 'ジ' ELSE reading END AS reading FROM a) {_BY}"""
QUERIES["documents_split_tawake_noun"] = _over_documents("split_tawake_noun")
ORACLES["documents_split_tawake_noun"] = f"""{_AROUND}, y AS (SELECT *, surface = 'たわけ' AND coalesce(split_part(pp, '-', 1) IN ('動詞', '助動詞', '形容詞', '助詞', '副詞'), false) AS cut FROM a),
    x AS (SELECT doc_id, ord, surface, c AS cls, reading FROM y WHERE NOT cut UNION ALL SELECT doc_id, ord, 'た', 'auxiliary', 'た' FROM y WHERE cut
        UNION ALL SELECT doc_id, ord + 1, 'わけ', 'noun', 'わけ' FROM y WHERE cut) {_BY}"""
QUERIES["documents_combine_tte"] = _over_documents("combine_tte")
ORACLES["documents_combine_tte"] = f"""{_AROUND}, x AS (SELECT doc_id, ord, CASE WHEN surface = '行っ' AND ns = 'て' THEN '行って' ELSE surface END AS surface, c AS cls,
    CASE WHEN surface = '行っ' AND ns = 'て' THEN reading || 'テ' ELSE reading END AS reading FROM a WHERE NOT coalesce(surface = 'て' AND ps = '行っ', false)) {_BY}"""
QUERIES["documents_combine_particles"] = _over_documents("combine_particles")
ORACLES["documents_combine_particles"] = f"""{_AROUND}, x AS (SELECT doc_id, ord, CASE WHEN surface = 'に' AND ns = 'は' THEN 'には' ELSE surface END AS surface, c AS cls,
    CASE WHEN surface = 'に' AND ns = 'は' THEN reading || 'ハ' ELSE reading END AS reading FROM a WHERE NOT coalesce(surface = 'は' AND ps = 'に', false)) {_BY}"""
QUERIES["documents_repair_hasa_noun"] = _over_documents("repair_hasa_noun")
ORACLES["documents_repair_hasa_noun"] = f"""{_AROUND}, x AS (SELECT doc_id, ord, surface, c AS cls, reading FROM a WHERE surface <> 'はさ'
    UNION ALL SELECT doc_id, ord, 'は', 'particle', 'は' FROM a WHERE surface = 'はさ' UNION ALL SELECT doc_id, ord + 1, 'さ', 'particle', 'さ' FROM a WHERE surface = 'はさ') {_BY}"""
