"""Forward conjugation as column expressions: a table of (form, stem, ending) over a few stems per class."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Verb classes: tag, dictionary ending (fixed values of the public word-class codes).
GODAN = {"v5u": "う", "v5k": "く", "v5k-s": "く", "v5g": "ぐ", "v5s": "す", "v5t": "つ", "v5n": "ぬ", "v5b": "ぶ", "v5m": "む", "v5r": "る", "v5r-i": "る", "v5aru": "る", "v5u-s": "う"}
ICHIDAN = {"v1": "る", "v1-s": "る"}
IRREGULAR = {"vs-i": "する", "vs-s": "する", "vs": "", "vk": "くる", "vz": "ずる"}
ADJECTIVES = {"adj-i": "い", "adj-ix": "い", "adj-na": ""}
#: The rows of the kana table that a final kana shifts to.
TERMINAL, ROW_A, ROW_I, ROW_E, ROW_O = "うくぐすつぬぶむる", "わかがさたなばまら", "いきぎしちにびみり", "えけげせてねべめれ", "おこごそとのぼもろ"
#: Sound changes before て and た, by final kana.
EUPHONY = {"う": "って", "つ": "って", "る": "って", "く": "いて", "ぐ": "いで", "ぬ": "んで", "ぶ": "んで", "む": "んで", "す": "して"}

#: form: (stem, ending of ichidan verbs, ending of the others). Stems: a, i, e, o rows; te, ta; dict.
FORMS: dict[str, tuple[str, str, str]] = {
    "dictionary": ("dict", "", ""), "stem_mizen": ("a", "", ""), "stem_renyou": ("i", "", ""), "stem_izen": ("e", "れ", ""),
    "negative": ("a", "ない", "ない"), "negative_past": ("a", "なかった", "なかった"), "negative_te": ("a", "なくて", "なくて"), "negative_ba": ("a", "なければ", "なければ"),
    "negative_nu": ("z", "ぬ", "ぬ"), "negative_zu": ("z", "ず", "ず"), "negative_without_doing": ("z", "ずに", "ずに"),
    "past": ("ta", "", ""), "past_tara": ("ta", "ら", "ら"), "past_tari": ("ta", "り", "り"), "te": ("te", "", ""),
    "polite": ("i", "ます", "ます"), "polite_past": ("i", "ました", "ました"), "polite_negative": ("i", "ません", "ません"), "polite_negative_past": ("i", "ませんでした", "ませんでした"),
    "polite_te": ("i", "まして", "まして"), "polite_volitional": ("i", "ましょう", "ましょう"),
    "causative": ("s", "させる", "せる"), "causative_short": ("s", "さす", "す"), "causative_passive": ("s", "させられる", "せられる"),
    "passive": ("s", "られる", "れる"), "honorific": ("s", "られる", "れる"), "potential": ("e", "られる", "る"), "potential_negative": ("e", "られない", "ない"),
    "volitional": ("o", "よう", "う"), "volitional_negative": ("dict", "まい", "まい"), "conjectural": ("dict", "だろう", "だろう"), "conjectural_polite": ("dict", "でしょう", "でしょう"),
    "imperative": ("e", "ろ", ""), "imperative_negative": ("dict", "な", "な"), "conditional_ba": ("e", "れば", "ば"), "conditional_tara": ("ta", "ら", "ら"), "provisional_nara": ("dict", "なら", "なら"),
    "desiderative": ("i", "たい", "たい"), "desiderative_other": ("i", "たがる", "たがる"),
    "progressive": ("te", "いる", "いる"), "progressive_contracted": ("te", "る", "る"), "resultative": ("te", "ある", "ある"), "preparative": ("te", "おく", "おく"), "attempt": ("te", "みる", "みる"),
    "completion": ("te", "しまう", "しまう"), "coming_to": ("te", "くる", "くる"), "going_to": ("te", "いく", "いく"), "receiving": ("te", "もらう", "もらう"), "giving_outward": ("te", "あげる", "あげる"), "giving_to_other": ("te", "くれる", "くれる"),
    "attempt_volitional": ("te", "みよう", "みよう"), "obligation": ("a", "なければならない", "なければならない"), "permission": ("te", "もいい", "もいい"), "prohibition": ("te", "はいけない", "はいけない"),
    "recommendation": ("dict", "べき", "べき"), "hearsay": ("dict", "そうだ", "そうだ"), "hearsay_polite": ("dict", "そうです", "そうです"), "appearance": ("i", "そうだ", "そうだ"), "appearance_polite": ("i", "そうです", "そうです"),
    "seems_like": ("dict", "みたいだ", "みたいだ"), "seems_like_polite": ("dict", "みたいです", "みたいです"), "reportedly": ("dict", "らしい", "らしい"), "explanatory": ("dict", "のだ", "のだ"), "explanatory_polite": ("dict", "のです", "のです"),
}
#: Forms with a prefix: stem, ending.
KEIGO = {"honorific_oninaru": ("i", "になる"), "humble_osuru": ("i", "する")}

#: Stems of the irregular verbs (z: before ぬ and ず; s: before passive and causative; for する the e stem takes ば).
SURU = {"dict": "する", "a": "し", "z": "せ", "s": "さ", "i": "し", "e": "すれ", "o": "しよ", "te": "して", "ta": "した"}
KURU = {"dict": "くる", "a": "こ", "z": "こ", "s": "こ", "i": "き", "e": "くれ", "o": "こよ", "te": "きて", "ta": "きた"}
KURU_KANJI = {k: "来" + v[1:] for k, v in KURU.items()}
SUPPLETIVE = {
    "vs": {"potential": "できる", "potential_negative": "できない", "imperative": "しろ", "volitional": "しよう", "passive": "される", "honorific": "される", "causative": "させる", "causative_short": "さす", "causative_passive": "させられる", "conditional_ba": "すれば"},
    "vk": {"potential": "こられる", "potential_negative": "こられない", "imperative": "こい", "volitional": "こよう", "passive": "こられる", "honorific": "こられる", "causative": "こさせる", "causative_short": "こさす", "causative_passive": "こさせられる", "conditional_ba": "くれば"},
}

ADJ_I: dict[str, str] = {
    "dictionary": "い", "negative": "くない", "past": "かった", "negative_past": "くなかった", "te": "くて", "adverbial": "く", "conditional_ba": "ければ", "conditional_tara": "かったら", "provisional_nara": "いなら",
    "polite": "いです", "polite_past": "かったです", "polite_negative": "くないです", "polite_negative_past": "くなかったです", "conjectural": "いだろう", "conjectural_polite": "いでしょう", "hearsay": "いそうだ", "hearsay_polite": "いそうです",
    "appearance": "そうだ", "appearance_polite": "そうです", "seems_like": "いみたいだ", "seems_like_polite": "いみたいです", "reportedly": "いらしい", "permission": "くてもいい", "prohibition": "くてはいけない", "obligation": "くなければならない",
}
ADJ_NA: dict[str, str] = {
    "dictionary": "だ", "polite": "です", "attributive": "な", "adverbial": "に", "te": "で", "negative": "じゃない", "negative_formal": "ではない", "past": "だった", "negative_past": "じゃなかった", "polite_past": "でした", "polite_negative": "じゃないです",
    "conjectural": "だろう", "conjectural_polite": "でしょう", "hearsay": "だそうだ", "hearsay_polite": "だそうです", "appearance": "そうだ", "appearance_polite": "そうです", "seems_like": "みたいだ", "seems_like_polite": "みたいです", "reportedly": "らしい",
}
_KEEP_I = {"dictionary", "provisional_nara", "polite", "conjectural", "conjectural_polite", "hearsay", "hearsay_polite", "seems_like", "seems_like_polite", "reportedly"}


def katakana_to_hiragana(text: Column) -> Column:
    low = "".join(chr(c) for c in range(0x30A1, 0x30F7))
    return F.translate(text, low, "".join(chr(ord(c) - 0x60) for c in low))


def verb_classes(spark) -> DataFrame:
    """tag, ending, and the kind of each class."""
    rows = [(t, e, kind) for kind, table in (("godan", GODAN), ("ichidan", ICHIDAN), ("irregular", IRREGULAR), ("adjective", ADJECTIVES)) for t, e in table.items()]
    return spark.createDataFrame(rows, "tag string, ending string, kind string")


def _godan_stem(word: Column, tag: Column, stem: str) -> Column:
    root, last = F.substring(word, 1, F.char_length(word) - 1), F.right(word, F.lit(1))
    if stem == "dict":
        return word
    rows = {"a": ROW_A, "z": ROW_A, "s": ROW_A, "i": ROW_I, "e": ROW_E, "o": ROW_O}
    if stem in rows:
        shifted = F.translate(last, TERMINAL, rows[stem])
        if stem == "i":  # なさる and the like take い
            shifted = F.when(tag == "v5aru", "い").otherwise(shifted)
        return F.concat(root, shifted)
    change = reduce(lambda acc, e: acc.when(last == e[0], e[1]), EUPHONY.items(), F.when(tag == "v5k-s", "って").when(tag == "v5u-s", "うて"))
    te = F.concat(root, change)
    return te if stem == "te" else F.concat(F.substring(te, 1, F.char_length(te) - 1), F.when(F.right(te, F.lit(1)) == "で", "だ").otherwise("た"))


def _ichidan_stem(word: Column, stem: str) -> Column:
    root = F.substring(word, 1, F.char_length(word) - 1)
    return {"dict": word, "te": F.concat(root, F.lit("て")), "ta": F.concat(root, F.lit("た"))}.get(stem, root)


def conjugate_verb(word: Column, tag: Column, form: str, prefix: str = "お") -> Column:
    """The surface of a form; null where the class is unknown."""
    stem, ichidan, other = FORMS.get(form) or (KEIGO[form][0], KEIGO[form][1], KEIGO[form][1])
    front = F.lit(prefix if form in KEIGO else "")
    godan = F.concat(front, _godan_stem(word, tag, stem), F.lit(other))
    if form.startswith("negative") or form == "obligation":  # ある has no stem of its own before ない
        godan = F.when((tag == "v5r-i") & (stem == "a"), F.concat(F.substring(word, 1, F.char_length(word) - 2), F.lit(other))).otherwise(godan)
    regular = F.concat(front, _ichidan_stem(word, stem), F.lit(ichidan))
    if form == "imperative":
        regular = F.when(tag == "v1-s", _ichidan_stem(word, "a")).otherwise(regular)

    def irregular(stems: dict[str, str], own: dict[str, str], cut: int) -> Column:
        ending = own.get(form)
        if ending is None:
            ending = stems[stem] + other
        before = F.substring(word, 1, F.char_length(word) - cut) if cut else word
        return F.concat(front, before, F.lit(ending))

    kanji = {k: "来" + v[1:] for k, v in SUPPLETIVE["vk"].items()}
    zuru = F.concat(front, F.substring(word, 1, F.char_length(word) - 2), F.lit("じ"), F.lit({"dict": "る", "te": "て", "ta": "た"}.get(stem, "")), F.lit(ichidan))
    return (
        F.when(tag.isin(*ICHIDAN), regular)
        .when(tag.isin(*GODAN), godan)
        .when(tag.isin("vs-i", "vs-s"), irregular(SURU, SUPPLETIVE["vs"], 2))
        .when(tag == "vs", irregular(SURU, SUPPLETIVE["vs"], 0))
        .when((tag == "vk") & word.endswith("来る"), irregular(KURU_KANJI, kanji, 2))
        .when(tag == "vk", irregular(KURU, SUPPLETIVE["vk"], 2))
        .when(tag == "vz", zuru)
    )


def conjugate_adjective(word: Column, tag: Column, form: str) -> Column:
    """Forms of い- and な-adjectives; いい bends as よい."""
    out = None
    if form in ADJ_I:
        stem = F.substring(word, 1, F.char_length(word) - 1)
        if form not in _KEEP_I:
            stem = F.when(word.endswith("いい"), F.concat(F.substring(word, 1, F.char_length(word) - 2), F.lit("よ"))).otherwise(stem)
        if form.startswith("appearance"):
            stem = F.when(word.endswith("いい") | (word == "良い") | (word == "ない"), F.concat(stem, F.lit("さ"))).otherwise(stem)
        out = F.when(tag.isin("adj-i", "adj-ix"), F.concat(stem, F.lit(ADJ_I[form])))
    if form in ADJ_NA:
        out = (F if out is None else out).when(tag == "adj-na", F.concat(word, F.lit(ADJ_NA[form])))
    return out


def conjugations(df: DataFrame, word: str, tag: str, forms: list[str] | None = None) -> DataFrame:
    """df with one row per form of its verb or adjective: form, surface."""
    names = forms or [*FORMS, *KEIGO, *(f for f in ADJ_I | ADJ_NA if f not in FORMS)]
    w, t = F.col(word), F.col(tag)

    def one(form: str) -> Column:
        parts = []
        if form in ADJ_I or form in ADJ_NA:
            parts.append(conjugate_adjective(w, t, form))
        if form in FORMS or form in KEIGO:
            parts.append(conjugate_verb(w, t, form))
        return F.struct(F.lit(form).alias("form"), F.coalesce(*parts).alias("surface"))

    rows = df.select("*", F.explode(F.array(*[one(f) for f in names])).alias("_c"))
    return rows.select(*df.columns, "_c.form", "_c.surface").where("surface is not null")


#: The copula by register and form (fixed values).
COPULA = {
    "da": {"dictionary": "だ", "negative": "じゃない", "past": "だった", "negative_past": "じゃなかった", "te": "で", "conditional_ba": "なら", "conditional_tara": "だったら", "provisional_nara": "なら", "conjectural": "だろう"},
    "desu": {
        "dictionary": "です", "negative": "じゃないです", "past": "でした", "negative_past": "じゃなかったです", "te": "でして", "conjectural": "でしょう", "polite_negative": "じゃありません", "polite_negative_past": "じゃありませんでした",
    },
    "dearu": {
        "dictionary": "である", "negative": "ではない", "past": "であった", "negative_past": "ではなかった", "te": "であって", "polite": "であります", "polite_past": "でありました", "polite_negative": "ではありません",
    },
}
#: Forms that are bases, negative, past, polite (fixed values).
FORM_FLAGS = {
    "base": ("dictionary", "stem_renyou", "stem_mizen", "stem_izen", "stem_meirei"),
    "negative": (
        "negative", "negative_past", "negative_te", "negative_ba", "negative_nu", "negative_zu", "negative_without_doing", "polite_negative", "polite_negative_past", "potential_negative", "volitional_negative",
        "imperative_negative", "prohibition",
    ),
    "past": ("past", "past_tara", "past_tari", "negative_past", "polite_past", "polite_negative_past"),
    "polite": ("polite", "polite_past", "polite_negative", "polite_negative_past", "polite_te", "polite_volitional", "conjectural_polite", "explanatory_polite"),
}


def conjugate_copula(register: Column, form: Column) -> Column:
    """The copula of a register (da, desu, dearu) in a form; null where there is none."""
    table = F.create_map(*[F.lit(x) for r, forms in COPULA.items() for f, surface in forms.items() for x in (f"{r}/{f}", surface)])
    return F.try_element_at(table, F.concat_ws("/", register, form))


def conjugate_explanatory(register: Column, form: Column, contracted: bool = False) -> Column:
    """の, or ん where contracted, with the copula."""
    return F.concat(F.lit("ん" if contracted else "の"), conjugate_copula(register, form))


def form_flags(form: Column) -> Column:
    """struct(is_base, is_negative, is_past, is_polite) of a form."""
    return F.struct(*[form.isin(*forms).alias(f"is_{flag}") for flag, forms in FORM_FLAGS.items()])
