"""Conjugation by axes (voice, politeness, polarity, tense, mood) and chains of auxiliaries, over the form tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glyphmill.functions.verbs import conjugate_adjective, conjugate_verb

VOICES = {"active": None, "passive": "passive", "causative": "causative", "causative_passive": "causative_passive", "potential": "potential", "honorific": "honorific"}
#: (politeness, polarity, tense) -> form, for the indicative.
INDICATIVE = {
    ("plain", "affirmative", "nonpast"): "dictionary", ("plain", "affirmative", "past"): "past", ("plain", "negative", "nonpast"): "negative", ("plain", "negative", "past"): "negative_past",
    ("polite", "affirmative", "nonpast"): "polite", ("polite", "affirmative", "past"): "polite_past", ("polite", "negative", "nonpast"): "polite_negative", ("polite", "negative", "past"): "polite_negative_past",
}
#: (mood, politeness, polarity) -> form; what is not here does not exist.
MOODS = {
    ("volitional", "plain", "affirmative"): "volitional", ("volitional", "polite", "affirmative"): "polite_volitional", ("volitional", "plain", "negative"): "volitional_negative",
    ("conditional_ba", "plain", "affirmative"): "conditional_ba", ("conditional_ba", "plain", "negative"): "negative_ba", ("conditional_tara", "plain", "affirmative"): "conditional_tara", ("provisional_nara", "plain", "affirmative"): "provisional_nara",
    ("te", "plain", "affirmative"): "te", ("te", "polite", "affirmative"): "polite_te", ("te", "plain", "negative"): "negative_te",
    ("imperative", "plain", "affirmative"): "imperative", ("imperative", "plain", "negative"): "imperative_negative", ("desiderative", "plain", "affirmative"): "desiderative",
    ("conjectural", "plain", "affirmative"): "conjectural", ("conjectural", "polite", "affirmative"): "conjectural_polite", ("hearsay", "plain", "affirmative"): "hearsay", ("hearsay", "polite", "affirmative"): "hearsay_polite",
    ("appearance", "plain", "affirmative"): "appearance", ("appearance", "polite", "affirmative"): "appearance_polite",
}
#: Auxiliaries of chains: (form they follow, surface, class of the result); class None ends a chain.
AUXILIARIES = {
    "iru": ("te", "いる", "v1"), "aru": ("te", "ある", "v5r-i"), "oku": ("te", "おく", "v5k"), "miru": ("te", "みる", "v1"), "shimau": ("te", "しまう", "v5u"), "kuru": ("te", "くる", "vk"), "iku": ("te", "いく", "v5k-s"),
    "morau": ("te", "もらう", "v5u"), "ageru": ("te", "あげる", "v1"), "kureru": ("te", "くれる", "v1-s"), "kudasai": ("te", "ください", None), "hoshii": ("te", "ほしい", "adj-i"),
    "hajimeru": ("stem_renyou", "はじめる", "v1"), "owaru": ("stem_renyou", "おわる", "v5r"), "tsuzukeru": ("stem_renyou", "つづける", "v1"), "sugiru": ("stem_renyou", "すぎる", "v1"), "yasui": ("stem_renyou", "やすい", "adj-i"), "nikui": ("stem_renyou", "にくい", "adj-i"), "tai": ("stem_renyou", "たい", "adj-i"),
}


def form_of(mood: str, politeness: str, polarity: str, tense: str) -> str | None:
    """The form of a combination; None if there is none."""
    if mood == "indicative":
        return INDICATIVE[politeness, polarity, tense]
    return MOODS.get((mood, politeness, polarity)) if tense == "nonpast" else None


def _any(word: Column, tag: Column, form: str) -> Column:
    adjective = conjugate_adjective(word, tag, form)
    verb = conjugate_verb(word, tag, form) if form not in ("attributive", "adverbial", "negative_formal") else None
    parts = [c for c in (adjective, verb) if c is not None]
    return F.coalesce(*parts)


def conjugate_axes(word: Column, tag: Column, voice: str = "active", politeness: str = "plain", polarity: str = "affirmative", tense: str = "nonpast", mood: str = "indicative") -> Column:
    """struct(surface, chain of (axis, surface)); null where the combination does not exist."""
    form = form_of(mood, politeness, polarity, tense)
    if form is None:
        return F.lit(None).cast("struct<surface:string,chain:array<struct<axis:string,surface:string>>>")
    steps, base, cls = [], word, tag
    if VOICES[voice]:
        base, cls = conjugate_verb(word, tag, VOICES[voice]), F.lit("v1")  # every voice bends like an ichidan verb
        steps.append(F.struct(F.lit(voice).alias("axis"), base.alias("surface")))
    surface = base if form == "dictionary" else _any(base, cls, form)
    if form != "dictionary":
        steps.append(F.struct(F.lit(form).alias("axis"), surface.alias("surface")))
    chain = F.array(*steps) if steps else F.array().cast("array<struct<axis:string,surface:string>>")
    return F.when(surface.isNotNull(), F.struct(surface.alias("surface"), chain.alias("chain")))


def conjugate_chain(word: Column, tag: Column, auxiliaries: list[str], form: str = "dictionary") -> Column:
    """The surface of a verb with auxiliaries stacked on it, the last one in the given form."""
    for k, name in enumerate(auxiliaries):
        after, surface, cls = AUXILIARIES[name]
        word = F.concat(conjugate_verb(word, tag, after), F.lit(surface))
        if cls is None:
            if k + 1 < len(auxiliaries) or form != "dictionary":
                raise ValueError(f"nothing follows {name}")
            return word
        tag = F.lit(cls)
    return word if form == "dictionary" else _any(word, tag, form)


#: What the details of a deconjugation say of the axes (fixed values): detail -> values that it sets.
PROCESS = {
    "past": {"tense": "past"}, "polite": {"politeness": "polite"}, "potential": {"voice": "potential"}, "causative passive": {"voice": "causative_passive"},
    **dict.fromkeys(("negative", "archaic negative", "archaic attributive negative", "adverbial negative", "slurred negative"), {"polarity": "negative"}),
    **dict.fromkeys(("causative", "short causative"), {"voice": "causative"}), **dict.fromkeys(("passive", "passive/potential", "passive/potential/honorific"), {"voice": "passive"}),
    **dict.fromkeys(("honorific", "honorific (ksb)"), {"voice": "honorific"}),
    **dict.fromkeys(("imperative", "imperative (ksb)", "polite imperative", "casual polite imperative", "polite request"), {"mood": "imperative"}), "imperative negative": {"mood": "imperative_negative"},
    "volitional": {"mood": "volitional"}, "polite volitional": {"mood": "volitional", "politeness": "polite"}, "want": {"mood": "desiderative"}, "garu": {"mood": "desiderative_other"},
    **dict.fromkeys(("(te)", "te"), {"mood": "te"}), "polite te": {"mood": "te", "politeness": "polite"},
    **dict.fromkeys(("conditional", "provisional conditional", "classical hypothetical conditional", "negative conditional", "polite conditional", "formal conditional", "colloquial negative conditional"), {"mood": "conditional_ba"}),
    "polite past": {"politeness": "polite", "tense": "past"}, **dict.fromkeys(("polite negative", "formal negative"), {"politeness": "polite", "polarity": "negative"}),
    **dict.fromkeys(("polite past negative", "formal negative past"), {"politeness": "polite", "polarity": "negative", "tense": "past"}),
    **dict.fromkeys(("(stem)", "(masu stem)", "(mizenkei)", "(izenkei)", "(adverbial stem)", "(ka stem)", "(ke stem)", "('a' stem)", "(unstressed infinitive)", ""), {}),
}
_AXES = {"voice": "active", "politeness": "plain", "polarity": "affirmative", "tense": "nonpast", "mood": "indicative"}


def axes_of_process(process: Column, lenient: bool = False) -> Column:
    """struct(voice, politeness, polarity, tense, mood) that an array of details (outermost first) stands for, applied from
    the innermost on; null if a detail says nothing known, unless lenient, where it is passed over."""
    known = F.array(*[F.lit(d) for d in PROCESS])

    def set_by(state: Column, detail: Column) -> Column:
        values = []
        for axis in _AXES:
            value = state[axis]
            for made in sorted({x[axis] for x in PROCESS.values() if axis in x}):
                value = F.when(detail.isin(*[d for d, x in PROCESS.items() if x.get(axis) == made]), made).otherwise(value)
            values.append(value.alias(axis))
        return F.struct(*values)

    start = F.struct(*[F.lit(v).alias(axis) for axis, v in _AXES.items()])
    out = F.aggregate(F.reverse(process), start, set_by)
    return out if lenient else F.when(F.forall(process, lambda d: F.array_contains(known, d)), out)


#: Details that stand for auxiliaries of a chain (fixed values).
CHAIN_DETAILS = {
    "teiru": "iru", "progressive": "iru", "teru": "iru", "tearu": "aru", "teoku": "oku", "preparative": "oku", "toku": "oku", "temiru": "miru", "attempt": "miru", "finish/completely/end up": "shimau", "completion": "shimau",
    "coming": "kuru", "tekuru": "kuru", "going": "iku", "teiku": "iku", "receiving": "morau", "temorau": "morau", "giving": "kureru", "tekureru": "kureru", "teageru": "ageru", "too much": "sugiru", "excess": "sugiru",
    "easy": "yasui", "hard": "nikui",
}


def chain_of_process(process: Column, lenient: bool = False) -> Column:
    """struct(base, auxiliaries, last) that an array of details stands for: the auxiliaries in order, and the details of the
    verb and of the last auxiliary as axes; a te before an auxiliary belongs to it. Null as in axes_of_process."""
    ordered = F.reverse(process)
    helpers = F.create_map(*[F.lit(x) for kv in CHAIN_DETAILS.items() for x in kv])
    named = F.transform(ordered, lambda d: F.struct(d.alias("d"), F.try_element_at(helpers, d).alias("aux")))
    own = F.filter(named, lambda x, i: ~(x["d"].isin("te", "(te)") & F.coalesce(F.get(named, i + 1)["aux"].isNotNull(), F.lit(False))))

    def part(values: Column) -> Column:
        return axes_of_process(F.reverse(F.transform(values, lambda x: x["d"])), lenient)

    places = F.filter(F.transform(own, lambda x, i: F.when(x["aux"].isNotNull(), i)), lambda i: i.isNotNull())
    begin, end = F.coalesce(F.array_min(places), F.size(own)), F.coalesce(F.array_max(places), F.lit(-1))
    base = part(F.filter(own, lambda x, i: i < begin))
    last = part(F.filter(own, lambda x, i: (i > end) & (F.size(places) > 0)))
    out = F.struct(base.alias("base"), F.transform(F.filter(own, lambda x: x["aux"].isNotNull()), lambda x: x["aux"]).alias("auxiliaries"), last.alias("last"))
    return out if lenient else F.when(base.isNotNull() & last.isNotNull(), out)
