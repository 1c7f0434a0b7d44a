"""Ordered rewriting of morpheme streams.

A stream is an array of tokens; its length is bounded by its text. A rule looks at the token at hand, at those to its
right as they came, and at those to its left as they have become, and answers with an edit: how many tokens to take
from either side, what to put in their place, and what to hand back to be looked at next. A sweep tries its rules at each
token, first come first served; a stage is one sweep or a few, and runs only over streams that hold its trigger; 32
stages make the pipeline. What a rule decides may hang on what it decided a token before, so streams are rewritten whole,
each in one Arrow pass without a shuffle (`rewrite_streams`); `rewrite` does the same for one row a token, and
`tally_streams` counts the rewritten tokens in that pass. What a rule answers hangs on the tokens it looks at alone, so
an answer is remembered by them and a rule runs once for all places that look alike (`operators/memo.py`).

Rules ask a lexicon, a table of (term, known): known, known not to exist, or nothing to tell; and the deconjugation
rules. A rule leaves the name of its stage in `rules` of the tokens it changed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.operators.deconjugate import Deconjugator, Form, default_deconjugator

#: Coarse classes by the first part of speech (fixed values).
CLASSES = {
    "名詞": "noun", "代名詞": "pronoun", "動詞": "verb", "形容詞": "adjective", "形状詞": "adjectival_noun", "副詞": "adverb", "助詞": "particle", "助動詞": "auxiliary", "接続詞": "conjunction",
    "感動詞": "interjection", "接頭辞": "prefix", "接尾辞": "suffix", "連体詞": "adnominal", "記号": "symbol", "補助記号": "symbol", "空白": "space",
}
#: Terms of a lexicon that are sent to tasks; a table of more is refused.
MOST_TERMS = 4_000_000

_TOKEN = {
    "surface": "string", "reading": "string", "dictionary_form": "string", "normalized_form": "string", "lemma_reading": "string", "pos": "array<string>", "cls": "string", "char_start": "int",
    "char_end": "int", "rules": "array<string>",
}
_STREAM = f"array<struct<{', '.join(f'{n}: {t}' for n, t in _TOKEN.items())}>>"


def coarse(pos: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv]), F.element_at(pos, 1)), F.lit("other"))


class Token(NamedTuple):
    surface: str
    reading: str
    dictionary_form: str
    normalized_form: str
    lemma_reading: str
    pos: tuple[str, ...]
    cls: str
    char_start: int
    char_end: int
    rules: tuple[str, ...]

    def has(self, *sections: str) -> bool:
        """Whether a finer part of speech is one of these."""
        return any(p in sections for p in self.pos[1:])

    def ends(self, *endings: str) -> bool:
        return self.surface.endswith(endings)


def hiragana(text: str) -> str:
    return "".join(chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c for c in text)


_KANJI, _HIRAGANA, _KATAKANA = re.compile("[一-龯]"), re.compile("[ぁ-ゟ]+"), re.compile("[゠-ヿ]+")


class Lexicon:
    """What rules may ask."""

    def __init__(self, entries: dict[str, bool] | None = None, deconjugator: Deconjugator | None = None):
        self.entries = entries or {}
        find = (deconjugator or default_deconjugator()).forms
        self.forms: Callable[[str], list[Form]] = lru_cache(100_000)(find)

    def known(self, term: str) -> bool | None:
        return self.entries.get(term)

    def verb_forms(self, surface: str, detail: str = "") -> list[Form]:
        """Forms that are verbs, none known not to exist, of chains with a detail that holds the given words."""
        return [f for f in self.forms(surface) if f.tags and f.tags[-1].startswith("v") and any(detail in d for d in f.process) and self.known(f.text) is not False]

    def is_past(self, surface: str) -> bool:
        return any("past" in f.process for f in self.verb_forms(surface))


# ---------------------------------------------------------------- edits and sweeps


class Edit(NamedTuple):
    put: tuple[Token, ...]
    #: tokens taken from the right, and from the left
    take: int = 1
    drop: int = 0
    #: tokens handed back, to be looked at next
    back: tuple[Token, ...] = ()


class View:
    """A token with what is around it."""

    def __init__(self, left: list[Token], rest: list[Token], before: Token | None, lexicon: Lexicon, stage: str):
        self.left, self.rest, self.before, self.lexicon, self.stage = left, rest, before, lexicon, stage

    @property
    def here(self) -> Token:
        return self.rest[-1]

    def next(self, n: int = 1) -> Token | None:
        return self.rest[-1 - n] if len(self.rest) > n else None

    def after(self, token: Token) -> Token | None:
        """The token that follows one to the right."""
        k = 0
        while (t := self.next(k)) is not None and t is not token:
            k += 1
        return self.next(k + 1) if t is not None else None

    def last(self, n: int = 1) -> Token | None:
        """The n-th token to the left, as it has become."""
        return self.left[-n] if len(self.left) >= n else None

    def marked(self, token: Token, **changes) -> Token:
        if "pos" in changes and "cls" not in changes:
            changes["cls"] = CLASSES.get(changes["pos"][0], "other")
        if "lemma" in changes:
            changes["dictionary_form"] = changes["normalized_form"] = changes.pop("lemma")
        rules = token.rules if self.stage in token.rules else (*token.rules, self.stage)
        return token._replace(rules=rules, **changes)

    def joined(self, *tokens: Token, **changes) -> Token:
        """The tokens as one: the first, with the surfaces and readings of all."""
        text, reading = ("".join(getattr(t, f) for t in tokens) for f in ("surface", "reading"))
        return self.marked(tokens[0], **{"surface": text, "reading": reading, "char_end": tokens[-1].char_end} | changes)

    def parts(self, token: Token, *made: tuple) -> tuple[Token, ...]:
        """The token as parts (surface, part of speech, [reading, dictionary form, normalised form])."""
        out, at = [], token.char_start
        for k, (surface, pos, *more) in enumerate(made):
            reading = more[0] if more else surface
            lemma = more[1] if len(more) > 1 else surface
            normal = more[2] if len(more) > 2 else lemma
            end = token.char_end if k == len(made) - 1 else at + len(surface)
            out.append(Token(surface, reading, lemma, normal, lemma, tuple(pos.split("-")), CLASSES.get(pos.split("-")[0], "other"), at, end, (self.stage,)))
            at = end
        return tuple(out)


Rule = Callable[[View], Edit | None]


def sweep(rules: Iterable[Rule], tokens: list[Token], lexicon: Lexicon, stage: str) -> list[Token]:
    left: list[Token] = []
    rest, before = tokens[::-1], None
    while rest:
        view = View(left, rest, before, lexicon, stage)
        edit = next((e for rule in rules if (e := rule(view)) is not None), None) or Edit((rest[-1],))
        before = rest[-edit.take] if edit.take else before
        del rest[len(rest) - edit.take :]
        del left[len(left) - edit.drop :]
        left += edit.put
        rest += edit.back[::-1]
    return left


def with_last(test: Callable[[View, Token, Token], bool], may: Callable[[Token], bool] | None = None, **changes) -> Rule:
    """A rule that joins the token at hand to the one on the left, where the test on (view, left, here) holds; `may` tells
    of the token at hand alone that it cannot."""

    def rule(v: View) -> Edit | None:
        if may is not None and not may(v.here):
            return None
        last = v.last()
        return Edit((v.joined(last, v.here, **changes),), drop=1) if last is not None and test(v, last, v.here) else None

    return rule


def with_next(test: Callable[[View, Token, Token], bool], made: Callable[[View, Token, Token], Token] = lambda v, a, b: v.joined(a, b)) -> Rule:
    """A rule that joins the token at hand and the next; what is made starts no other pair."""

    def rule(v: View) -> Edit | None:
        after = v.next()
        return Edit((made(v, v.here, after),), take=2) if after is not None and test(v, v.here, after) else None

    return rule


def changed(test: Callable[[View, Token], bool], change: Callable[[View, Token], dict]) -> Rule:
    """A rule that changes the token at hand."""
    return lambda v: Edit((v.marked(v.here, **change(v, v.here)),)) if test(v, v.here) else None


# ---------------------------------------------------------------- splits

#: Verbs that make a compound with the verb before them, and the stem their surface begins with (fixed values).
COMPOUND_STEMS = {"続ける": "続け", "始める": "始め", "終わる": "終わ", "終える": "終え", "出す": "出", "かける": "かけ"}
#: The same with those that have no such stem (fixed values).
COMPOUND_VERBS = (*COMPOUND_STEMS, "いたす", "いただく", "頂く", "する")
#: Particles that are found inside names that are none (fixed values).
INNER_PARTICLES = "はがをにでともへや"
STEMMED, VERBAL_CONTEXT = ("verb", "adjective", "auxiliary"), ("verb", "auxiliary", "adjective", "particle", "adverb")


def _compound_verb(v: View) -> Edit | None:
    t, lemma = v.here, v.here.dictionary_form
    if t.cls != "verb" or len(lemma) < 3 or v.lexicon.known(lemma) is True:
        return None
    for verb, stem in COMPOUND_STEMS.items():
        cut = len(lemma) - len(verb)
        if cut > 0 and lemma.endswith(verb) and t.surface[cut:].startswith(stem):
            return Edit(v.parts(t, (t.surface[:cut], "動詞", "", lemma[:cut]), (t.surface[cut:], "動詞-非自立可能", "", verb)))
    return None


def _tatte(v: View) -> Edit | None:
    t = v.here
    if t.surface == "だな" and t.cls == "noun" and t.normalized_form == "棚":
        return Edit(v.parts(t, ("だ", "助動詞"), ("な", "助詞-終助詞")))
    if t.surface in ("たって", "だって") and t.cls == "particle" and t.has("接続助詞") and v.before is not None and v.before.cls in STEMMED:
        return Edit(v.parts(t, (t.surface[0], "助動詞"), ("って", "助詞-接続助詞")))
    return None


def _completes_past(v: View, token: Token) -> bool:
    """Whether た after a token makes a past form, as て and で before it always do."""
    return token.ends("て", "で") or v.lexicon.is_past(token.surface + "た")


def _tan(v: View) -> Edit | None:
    t, last, after = v.here, v.last(), v.next()
    if t.surface != "たん" or t.cls != "suffix" or last is None or after is None or after.cls != "auxiliary" or after.dictionary_form not in ("だ", "です"):
        return None
    if not _completes_past(v, last):
        return None
    past = v.marked(last, surface=last.surface + "た", char_end=t.char_start + 1)
    (_, n) = v.parts(t, ("た", "助動詞"), ("ん", "助詞-準体助詞", "ん", "の", "ん"))
    return Edit((past, n), drop=1)


def _tawake(v: View) -> Edit | None:
    t = v.here
    if t.surface != "たわけ" or t.dictionary_form not in ("たわけ", "たわける") or (before := v.before) is None:
        return None
    if before.cls in VERBAL_CONTEXT or (before.cls == "symbol" and before.surface == "っ"):
        return Edit(v.parts(t, ("た", "助動詞"), ("わけ", "名詞")))
    return None


def _name_with_particle(v: View) -> Edit | None:
    t = v.here
    if t.cls != "noun" or "固有名詞" not in t.pos or len(t.surface) < 3:
        return None
    for k in range(1, len(t.surface) - 1):
        first, particle, second = t.surface[:k], t.surface[k], t.surface[k + 1 :]
        if particle in INNER_PARTICLES and v.lexicon.known(first) is True and v.lexicon.known(second) is True:
            noun = "名詞-普通名詞-一般"
            return Edit(v.parts(t, (first, noun, "", first), (particle, "助詞"), (second, noun, "", second)))
    return None


# ---------------------------------------------------------------- repairs

#: What is written together with an ん before it, and with the だ after such an ん (fixed values).
AFTER_N = ("だ", "です", "じゃ", "なら", "ても", "でも", "だろ", "だろう", "だって", "だけど", "だけ", "だが", "だし", "だから")
AFTER_DA = ("が", "けど", "けれど", "けれども", "から", "し", "って", "の")


def _hasa(v: View) -> Edit | None:
    return Edit(v.parts(v.here, ("は", "助詞"), ("さ", "助詞"))) if v.here.surface == "はさ" and v.here.cls == "noun" else None


def _remainder(v: View, t: Token) -> Token:
    rest = t.surface[1:]
    return v.marked(t, surface=rest, reading=rest, lemma=rest, char_start=t.char_start + 1)


def _n_apart(v: View) -> Edit | None:
    t, last = v.here, v.last()
    if t.surface[:1] == "ん" and t.surface[1:].startswith(AFTER_N):
        (n, _) = v.parts(t, ("ん", "助動詞", "ん", "の" if t.cls == "interjection" else "", "ん"), (t.surface[1:], "助動詞"))
        return Edit((n, _remainder(v, t)))
    if t.surface[:1] == "だ" and t.surface[1:] in AFTER_DA and last is not None and last.ends("ん"):
        (da, _) = v.parts(t, ("だ", "助動詞"), (t.surface[1:], "助動詞"))
        return Edit((da, _remainder(v, t)))
    if t.surface == "そうだ" and t.cls == "adverb":
        return Edit(v.parts(t, ("そう", "助動詞-助動詞語幹"), ("だ", "助動詞")))
    return None


def _n_with_da(v: View) -> Edit | None:
    t, after, last = v.here, v.next(), v.last()
    if after is None or after.surface not in ("だ", "で"):
        return None
    if len(t.surface) > 1 and t.ends("ん") and t.cls not in ("suffix", "adjectival_noun") and not t.dictionary_form.endswith("ん"):
        return Edit((v.joined(t, after, pos=("動詞",)),), take=2)
    if t.surface == "ん" and last is not None and last.cls in ("noun", "verb", "adjective", "adjectival_noun"):
        if v.lexicon.is_past(last.surface + t.surface + after.surface):
            return Edit((v.joined(last, t, after, pos=("動詞",)),), take=2, drop=1)
    return None


#: Words that are drawn out in katakana, and the kana before the う of a volitional (fixed values).
DRAWN_OUT = ("けど", "けども", "けれど", "けれども", "ので", "のに", "から", "まで")
O_ROW = "こごそぞとどのほぼぽもよろお"


def _drawn_out(v: View) -> Edit | None:
    """Tokens with ー in them, each on its own."""
    t = v.here
    body = t.surface[:-1] if t.ends("ー") else ""
    if body and t.cls in ("particle", "conjunction") and _HIRAGANA.fullmatch(body):
        return Edit((v.marked(t, surface=body),))
    if body and t.cls == "noun" and _KATAKANA.fullmatch(body) and hiragana(body) in DRAWN_OUT:
        return Edit((v.marked(t, surface=hiragana(body), lemma=hiragana(body), reading=body, pos=("接続詞",)),))
    plain = t.surface.replace("ー", "")
    if plain and plain != t.surface and not body and not t.ends("ー") and _HIRAGANA.fullmatch(plain) and (_KANJI.search(t.normalized_form) or plain == t.normalized_form):
        return Edit((v.marked(t, surface=plain, dictionary_form=t.dictionary_form.replace("ー", ""), reading=t.reading.replace("ー", "")),))
    return None


def _is_volitional(v: View, text: str) -> bool:
    return bool(v.lexicon.verb_forms(hiragana(text), "volitional"))


def _bar(t: Token) -> bool:
    return t.surface == "ー" and t.cls == "symbol"


def _all_kanji(text: str) -> bool:
    return bool(text) and all(_KANJI.match(c) for c in text)


def _filler(v: View) -> Edit | None:
    """ちゃ + んー: a drawn-out title."""
    last, t = v.last(), v.here
    if last is not None and t.cls == "interjection" and re.fullmatch("んー+", t.surface) and last.cls == "noun" and len(last.surface) <= 2 and not last.ends("ん"):
        return Edit((v.marked(last, surface=last.surface + "ん", char_end=t.char_end, pos=("接尾辞",)),), drop=1)
    return None


def _drawn_ru(v: View) -> Edit | None:
    """A verb of slang cut into an affix, る and ー."""
    last, first = v.last(), v.last(2)
    if first is not None and _bar(v.here) and last.surface == "る" and last.cls == "noun" and first.cls in ("prefix", "suffix"):
        text = first.surface + "る"
        return Edit((v.marked(first, surface=text, lemma=text, char_end=v.here.char_end, pos=("動詞",)),), drop=2)
    return None


def _drawn_volitional(v: View) -> Edit | None:
    """行 + こ + ー, or 行 + こー, for 行こう."""
    t, last, first = v.here, v.last(), v.last(2)
    if _bar(t) and first is not None and last.cls == "noun" and len(last.surface) == 1 and last.surface in O_ROW and _all_kanji(first.surface):
        head, o, more, drop = first, last.surface, last.reading, 2
    elif len(t.surface) == 2 and t.ends("ー") and t.surface[0] in O_ROW and last is not None and _all_kanji(last.surface):
        head, o, more, drop = last, t.surface[0], t.surface[0], 1
    else:
        return None
    text = head.surface + o + "う"
    if not _is_volitional(v, text):
        return None
    return Edit((v.marked(head, surface=text, lemma=text, reading=head.reading + more + "う", char_end=t.char_end, pos=("動詞",)),), drop=drop)


def _drawn_adjective(v: View) -> Edit | None:
    t, last = v.here, v.last()
    if last is None or t.cls != "interjection" or len(t.surface) < 2 or not t.ends("ー") or not _HIRAGANA.fullmatch(t.surface[:-1]):
        return None
    if last.cls in ("prefix", "adjective") and last.dictionary_form.endswith("い"):
        return Edit((v.marked(last, surface=last.surface + t.surface[:-1], char_end=t.char_end, pos=("形容詞",)),), drop=1)
    return None


def _doubled_u(v: View) -> Edit | None:
    """…るう: a verb and its last vowel drawn out."""
    t, last = v.here, v.last()
    if last is None or not t.ends("るう"):
        return None
    text = last.surface + t.surface[:-1]
    verb = hiragana(text)
    if not any(f.text == verb and f.tags and f.tags[-1] in ("v1", "v5r") for ending in ("ない", "らない") for f in v.lexicon.forms(verb[:-1] + ending)):
        return None
    cut = t.char_end - 1
    whole = v.marked(last, surface=text, lemma=text, reading=last.reading + t.surface[:-1], char_end=cut, pos=("動詞",))
    return Edit((whole, *v.parts(t._replace(char_start=cut), ("う", "感動詞"))), drop=1)


def _doubled_a(v: View) -> Edit | None:
    """たあ, ああ: a past form and its last vowel drawn out."""
    t, last = v.here, v.last()
    if last is None:
        return None
    if t.surface == "たあ" and v.lexicon.is_past(hiragana(last.surface + "た")):
        past = v.marked(last, surface=last.surface + "た", reading=last.reading + "た", char_end=t.char_start + 1, pos=("動詞",))
        return Edit((past, v.parts(t, ("た", "助動詞"), ("あ", "感動詞"))[1]), drop=1)
    if t.surface == "ああ" and last.cls != "verb" and hiragana(last.surface).endswith(("た", "だ")) and v.lexicon.is_past(hiragana(last.surface)):
        return Edit((v.marked(last, pos=("動詞",)), t), drop=1)
    return None


#: Expressions that are two words: head, tail, its part of speech and reading; and one that is three (fixed values).
EXPRESSIONS = {
    "人前で": (("人前", "名詞", ""), ("で", "助詞", "デ")), "様に": (("様", "名詞", ""), ("に", "助詞", "ニ")),
    "おけばいい": (("おけ", "動詞", "オケ", "おく"), ("ば", "助詞", "バ"), ("いい", "形容詞", "イイ")),
}
N_VERBS = ("v5b", "v5m", "v5n", "v5g")


def _noyo(v: View) -> Edit | None:
    t = v.here
    return Edit(v.parts(t, ("ノ", "助詞", "ノ", "の"), ("ヨ", "助詞", "ヨ", "よ"))) if t.surface == "ノヨ" and t.cls in ("noun", "adjectival_noun") else None


def _de(v: View) -> Edit | None:
    t, after = v.here, v.next()
    if t.surface != "で" or t.cls not in ("conjunction", "auxiliary"):
        return None
    if after is not None and after.surface == "しょう" and after.cls == "noun":
        whole = t._replace(char_end=after.char_end)
        return Edit(v.parts(whole, ("でしょう", "連語", "デショウ", "でしょう", "です")), take=2)
    if after is None or after.surface != "も":
        return Edit((v.marked(t, pos=("助詞",)),))
    return None


def _retagged(surface: str, cls: str, of: str, pos: str, normal: str) -> Rule:
    return changed(lambda v, t: t.surface == surface and t.cls == cls and t.normalized_form == of, lambda v, t: {"pos": (pos,), "normalized_form": normal})


def _expression(v: View) -> Edit | None:
    t = v.here
    if (t.cls == "other" or t.pos[:1] == ("連語",)) and t.surface in EXPRESSIONS:
        return Edit(v.parts(t, *EXPRESSIONS[t.surface]))
    if t.cls == "other" and len(t.surface) >= 3 and t.ends("んで", "んだ"):
        verb = next((f.text for f in v.lexicon.forms(t.surface) if f.tags and f.tags[-1] in N_VERBS), None)
        if verb:
            return Edit((v.marked(t, pos=("動詞",), lemma=verb),))
    return None


def _nee(v: View) -> Edit | None:
    t, last, context = v.here, v.last(), v.last(2)
    if context is None or t.surface != "え" or t.cls != "interjection" or last.surface != "ね" or last.cls != "particle":
        return None
    if (context.cls == "particle" and context.surface in ("て", "で")) or (context.cls == "verb" and context.ends("て", "で")):
        return Edit((v.marked(last, surface="ねえ", lemma="ない", reading="ネエ", char_end=t.char_end, pos=("助動詞",)),), drop=1)
    return None


def _ran(v: View) -> Edit | None:
    t, last, after = v.here, v.last(), v.next()
    if t.surface == "らん" and after is not None and after.surface in ("ない", "ねえ", "ねぇ", "ねー") and last is not None and last.ends("て", "で"):
        whole = t._replace(char_end=after.char_end)
        return Edit(v.parts(whole, (t.surface + after.surface, "助動詞", "ラン" + after.reading, "られない")), take=2)
    return None


#: Endings of nouns whose head is what a dictionary lists (fixed values).
NOUN_ENDINGS = ("出し", "中", "時", "代", "部", "機")


def _lemma_of_head(head_of: Callable[[Token], str], classes: tuple[str, ...]) -> Rule:
    def head(v: View, t: Token) -> bool:
        h = head_of(t) if t.cls in classes else ""
        return bool(h) and v.lexicon.known(t.dictionary_form) is not True and v.lexicon.known(h) is True

    return changed(head, lambda v, t: {"lemma": head_of(t)})


def _without_ending(t: Token) -> str:
    return next((t.surface[: -len(e)] for e in NOUN_ENDINGS if t.ends(e)), "")


#: Final particles that are written together with an interjection, longest first (fixed values).
FINAL_PARTICLES = ("よね", "なあ", "ねえ", "のよ", "もの", "ね", "な", "よ", "さ", "わ", "の")


def _fused_interjection(v: View) -> Edit | None:
    t = v.here
    if t.cls != "interjection" or len(t.surface) < 3 or v.lexicon.known(t.surface) is True:
        return None
    for particle in FINAL_PARTICLES:
        base = t.surface.removesuffix(particle)
        if base != t.surface and len(base) >= 2 and v.lexicon.known(base) is not False:
            return Edit(v.parts(t, (base, "感動詞"), (particle, "助詞")))
    return None


#: Auxiliaries that only follow verbs, and the endings of such verbs (fixed values).
VERBAL_AUXILIARIES, VERB_ENDINGS = ("られる", "れる", "せる", "させる"), "るすつくぐむぶぬう"


def _orphaned_auxiliary(v: View) -> Edit | None:
    """The end of a noun is the stem of the verb that an auxiliary or a lone ending lacks."""
    t, last = v.here, v.last()
    if last is None or last.cls != "noun" or len(last.surface) < 2:
        return None
    if t.cls == "auxiliary" and t.dictionary_form in VERBAL_AUXILIARIES:
        endings = VERB_ENDINGS
    elif len(t.surface) == 1 and t.surface in VERB_ENDINGS:
        endings = t.surface
    else:
        return None
    for n in range(1, min(3, len(last.surface) - 1) + 1):
        noun, stem = last.surface[:-n], last.surface[-n:]
        if not _KANJI.search(stem) or v.lexicon.known(noun) is not True:
            continue
        lemma = next((stem + e for e in endings if v.lexicon.known(stem + e) is True), None)
        if lemma is None:
            continue
        cut = last.char_end - n
        shorter = {f: getattr(last, f).removesuffix(stem) for f in ("dictionary_form", "normalized_form")}
        verb = t._replace(char_start=cut)
        return Edit((v.marked(last, surface=noun, char_end=cut, **shorter), *v.parts(verb, (stem + t.surface, "動詞", "", lemma))), drop=1)
    return None


def _tanka(v: View) -> Edit | None:
    t, after, last = v.here, v.next(), v.last()
    if t.surface != "たんか" or t.cls != "noun" or (after is not None and after.surface == "を") or (last is not None and last.surface in ("を", "の")):
        return None
    between = 0
    while (verb := v.last(between + 1)) is not None and verb.cls == "symbol":
        between += 1
    if verb is None or not _completes_past(v, verb):
        return None
    marks = [v.last(n) for n in range(between, 0, -1)]
    past = v.marked(verb, surface=verb.surface + "た", char_end=t.char_start + 1, pos=("動詞",))
    _, n, ka = v.parts(t, ("た", "助動詞"), ("ん", "助詞-準体助詞", "ん", "の", "ん"), ("か", "助詞"))
    return Edit((past, *marks, n, ka), drop=between + 1)


# ---------------------------------------------------------------- combinations


def _prefix(v: View, a: Token, b: Token) -> bool:
    kanji = bool(_KANJI.search(a.surface))
    takes = b.cls in ("noun", "adjectival_noun", "adverb") or (kanji and b.cls in ("verb", "adjective"))
    return a.cls == "prefix" and takes and v.lexicon.known(a.surface + b.surface) is True


def _prefixed(v: View, a: Token, b: Token) -> Token:
    text = a.surface + b.surface
    noun = {"pos": ("名詞",)} if b.cls in ("verb", "adjective") else {}
    return v.marked(b, surface=text, lemma=text, char_start=a.char_start, **noun)


#: What never joins a verb or adjective before it, by surface (fixed values).
NO_INFLECTION = ("は", "よ", "し", "を", "が", "か", "ください", "かな")
#: Verbs' stems before the endings of a suffix, and their endings (fixed values).
STEM_ROW, ENDING_ROW = "いきぎしちにびみり", "うくぐすつぬぶむる"


class _Merge:
    """A word that inflects, and what it has taken in so far."""

    def __init__(self, v: View):
        self.v, self.token, self.taken = v, v.here, 1

    def target(self) -> str:
        """The dictionary form that what is taken in must lead back to."""
        return hiragana(self.token.dictionary_form) + ("する" if self.token.cls == "noun" else "")

    def forms(self, text: str) -> list[Form]:
        return self.v.lexicon.forms(hiragana(text))

    def stops(self, b: Token) -> bool:
        """Whether b begins something else, whatever the rules of inflection say."""
        a, c = self.token, self.v.after(b)
        if b.surface == "な":
            excess = c is not None and c.has("非自立", "非自立可能") and c.dictionary_form in ("すぎる", "過ぎる")
            return not (b.cls == "auxiliary" and b.dictionary_form == "ない" and excess)
        return (
            b.surface in NO_INFLECTION
            or (b.surface == b.dictionary_form == "よう")
            or (b.dictionary_form == "いける" and a.ends("ちゃ", "じゃ", "きゃ", "にゃ"))
            or (b.surface == "ん" and b.dictionary_form in ("の", "ん"))
            or (b.surface == "って" and c is not None and c.surface in ("ん", "んだ", "んです"))
            or (a.ends("ん") and b.surface in ("だ", "です"))
            or (b.surface == "じゃ" and b.dictionary_form == "だ")
            or (a.cls == "adjectival_noun" and b.surface == "で" and b.dictionary_form == "だ")
        )

    def may_inflect(self, b: Token) -> bool:
        a = self.token
        return (
            b.cls in ("auxiliary", "suffix", "particle")
            or b.has("助動詞語幹", "接続助詞", "非自立", "非自立可能")
            or (b.surface == "やれ" and b.cls == "interjection" and a.ends("て"))
            or (b.surface == "ねえ" and b.cls == "noun" and a.ends("て", "で"))
            or (b.surface == "せん" and a.has("サ変可能"))
        )

    def take(self, surface: str, reading: str, end: int, **changes) -> None:
        """Take in what makes the surface; a noun becomes the verb of doing it."""
        if self.token.cls == "noun" and "dictionary_form" not in changes:
            changes |= {"dictionary_form": self.token.dictionary_form + "する", "cls": "verb"}
        self.token = self.v.marked(self.token, surface=surface, reading=self.token.reading + reading, char_end=end, **changes)

    def known_base(self) -> bool:
        lemma, normal = self.token.dictionary_form, self.token.normalized_form
        known = self.v.lexicon.known
        return known(lemma) is not False or (normal != lemma and known(normal) is True)

    def compound(self, b: Token, forms: list[Form]) -> Form | None:
        """A compound verb that the two make, known or not known to be none."""
        a = self.token
        if a.cls != "verb" or a.ends("て", "で", "たく", "なく", "たり", "だり") or b.dictionary_form in COMPOUND_VERBS:
            return None
        if not (b.has("動詞的") or (b.cls == "verb" and b.has("非自立可能", "非自立")) or b.cls == "suffix"):
            return None
        ending = hiragana(b.dictionary_form)
        endings = [ending]
        if b.cls == "suffix" and len(ending) > 1 and ending[-1] in STEM_ROW:
            endings.append(ending[:-1] + ENDING_ROW[STEM_ROW.index(ending[-1])])
        found = next((f for e in endings for f in forms if f.text.endswith(e) and len(f.text) > len(e)), None)
        if found is None:
            return None
        known = self.v.lexicon.known
        if known(found.text) is False and not any(known(f.text) is True for f in self.forms(found.text)):
            return None
        return found

    def step(self) -> Edit | None:
        """Take in the next token. An edit ends it all; a null one does where nothing was taken."""
        b = self.v.next(self.taken)
        if b is None or self.stops(b):
            return self.end()
        if not self.may_inflect(b):
            return self.steal(b) or self.end()
        text = self.token.surface + b.surface
        forms = self.forms(text)
        if any(f.text == self.target() for f in forms):
            if not self.known_base():
                return self.end()
            self.take(text, b.reading, b.char_end)
        elif (found := self.compound(b, forms)) is not None:
            self.take(text, b.reading, b.char_end, dictionary_form=found.text, cls="adjective" if found.tags and found.tags[-1] == "adj-i" else "verb")
        elif not self.ahead():
            return self.end()
        self.taken += 1
        return None

    def ahead(self) -> bool:
        """Take in the fewest further tokens that together lead back to the dictionary form, where one alone is a stem that
        no rule knows; all but the last, which the step counts."""
        start, k, tokens = self.token, self.taken, []
        while (b := self.v.next(k)) is not None and not self.stops(b) and self.may_inflect(b):
            tokens.append(b)
            k += 1
            self.token = start._replace(surface=self.token.surface + b.surface)
            if len(tokens) > 1 and any(f.text == self.target() for f in self.forms(self.token.surface)):
                text, self.token = self.token.surface, start
                if not self.known_base():
                    return False
                self.take(text, "".join(t.reading for t in tokens), b.char_end)
                self.taken = k - 1
                return True
        self.token = start
        return False

    def steal(self, b: Token) -> Edit | None:
        """そう of a そうだ or そうか that was read as one word, or a whole なさそう."""
        if b.surface in ("そうだ", "そうか") and any(f.text == self.target() for f in self.forms(self.token.surface + "そう")):
            self.take(self.token.surface + "そう", "ソウ", b.char_start + 2)
            last = b.surface[2]
            rest = Token(last, last, last, last, last, ("助動詞" if last == "だ" else "助詞",), "auxiliary" if last == "だ" else "particle", b.char_start + 2, b.char_end, ())
            return Edit((self.token,), take=self.taken + 1, back=(rest,))
        text = self.token.surface + b.surface
        if b.dictionary_form == "なさそう" and any(f.text == self.target() for f in self.forms(text)):
            self.take(text, b.reading, b.char_end)
            return Edit((self.token,), take=self.taken + 1)
        return None

    def end(self) -> Edit:
        return Edit((self.token,), take=self.taken)


def _inflection(v: View) -> Edit | None:
    t = v.here
    inflects = t.cls in ("verb", "adjective", "adjectival_noun") or t.has("サ変可能", "サ変形状詞可能") or (t.cls == "suffix" and t.has("動詞的"))
    if not inflects or t.normalized_form == "物" or t.has("助動詞語幹"):
        return None
    merge = _Merge(v)
    while (edit := merge.step()) is None:
        pass
    return edit


#: Amounts that are one word: numeral, what follows (fixed values).
AMOUNTS = (
    ("１", "つ"), ("２", "つ"), ("３", "つ"), ("４", "つ"), ("５", "つ"), ("一", "つ"), ("二", "つ"), ("三", "つ"), ("一", "日"), ("二", "日"), ("一", "人"), ("二", "人"), ("三", "人"), ("１", "人"),
    ("２", "人"), ("３", "人"), ("十", "分"), ("半", "分"), ("一", "回"), ("二", "回"), ("三", "回"), ("一", "階"), ("二", "階"), ("三", "階"), ("一", "個"), ("二", "個"), ("三", "個"),
)


def _amount(v: View) -> Edit | None:
    last, t = v.last(), v.here
    if last is None or not last.has("数詞", "助数詞", "助数詞可能") or (last.surface, t.surface) not in AMOUNTS:
        return None
    text = last.surface + t.surface
    return Edit((v.joined(last, t, lemma=text, pos=("名詞",), lemma_reading=last.lemma_reading + t.lemma_reading),), drop=1)


def _tte(v: View, a: Token, b: Token) -> bool:
    return a.ends("っ") and b.surface.startswith("て")


def _stem_auxiliary(v: View, a: Token, b: Token) -> bool:
    return b.has("助動詞語幹") and b.surface not in ("ように", "よう", "ようです", "みたい") and (a.cls in ("verb", "adjective", "noun") or (a.cls == "suffix" and a.dictionary_form.endswith("い")))


def _adjective_stem(t: Token) -> bool:
    return t.cls == "adjective" and not t.ends("い") and t.dictionary_form.endswith("い")


def _suffix(v: View) -> Edit | None:
    a, b = v.last(), v.here
    if a is None:
        return None
    lemma, is_suffix = b.dictionary_form, b.cls == "suffix" or b.has("接尾辞")
    joins = is_suffix and (
        lemma in ("っこ", "さ", "がる")
        or (lemma in ("ぶり", "振り") and _adjective_stem(a))
        or (lemma == "ら" and v.before is not None and v.before.cls == "pronoun" and v.before.surface != "貴様")
    )
    if not joins and not (b.cls == "adverb" and b.surface == "がったり" and _adjective_stem(a)):
        return None
    own = {"lemma": a.surface + lemma} if lemma in ("さ", "がる", "ぶり", "振り", "ら") else {}
    return Edit((v.joined(a, b, lemma_reading=a.lemma_reading + b.lemma_reading, **own),), drop=1)


#: Suffixes that stay suffixes wherever they stand (fixed values).
HONORIFICS = ("じまい", "仕舞い", "ちゃん", "さん", "くん", "様", "殿", "氏")


def _orphan(v: View, t: Token) -> bool:
    last = v.last()
    return t.cls == "suffix" and t.dictionary_form not in HONORIFICS and last is not None and last.cls not in ("noun", "pronoun", "prefix", "suffix") and not t.has("形容詞的", "形状詞的")


#: Auxiliaries that stand alone, by surface and by dictionary form (fixed values).
ALONE = ("な", "に", "なら", "なる", "だろう", "で", "や", "やろ", "やしない", "し", "なのだ", "だろ", "ハズ")
ALONE_LEMMAS = ("らしい", "べし", "む", "ごとし", "如し", "ようだ", "やがる", "たり", "筈")


def _dearu(v: View) -> Edit | None:
    a, b = v.last(), v.here
    if a is None or b.cls == "auxiliary" or a.surface != "で" or a.dictionary_form != "だ" or b.dictionary_form not in ("ある", "有る"):
        return None
    return Edit((v.joined(a, b, pos=b.pos, cls=b.cls, lemma="である", lemma_reading=a.lemma_reading + b.lemma_reading),), drop=1)


def _auxiliary(v: View, a: Token, b: Token) -> bool:
    if b.cls != "auxiliary":
        return False
    if a.cls == "other" and b.dictionary_form == "た":
        return a.ends("て", "で")
    if a.cls not in ("verb", "adjective", "adjectival_noun", "auxiliary") or b.surface in ALONE or b.surface.startswith("なん") or b.dictionary_form in ALONE_LEMMAS:
        return False
    if b.dictionary_form == "です" and not (a.cls == "verb" and b.surface in ("でし", "でした")):
        return False
    if b.surface == "じゃ" and b.dictionary_form == "だ":
        return False
    return b.surface != "だ" or (a.ends("ん") and v.lexicon.is_past(a.surface + "だ"))


def _to_naru(v: View, a: Token, b: Token) -> bool:
    last = v.last()
    naru = b.cls in ("verb", "auxiliary") and not {b.dictionary_form, b.normalized_form}.isdisjoint(("なる", "成る"))
    return a.cls == "particle" and a.surface == "と" and naru and len(b.surface) <= 3 and last is not None and last.cls in ("noun", "pronoun", "adjectival_noun")


#: Verbs that depend on the verb before them; those that follow て; those that make a chain with it (fixed values).
DEPENDANTS = ("得る", "しまう", "こなす", "いく", "貰う", "いる", "ない", "だす")
AFTER_TE = ("あげる", "上げる", "くれる", "呉れる", "もらう", "貰う", "やる", "さしあげる", "差し上げる", "くださる", "下さる", "おく", "置く", "みる", "見る")
TE_CHAIN = ("いる", "居る", "ある", "有る", "おく", "置く", "しまう", "仕舞う", "いく", "行く", "くる", "来る", "みる", "見る")


def _classical_te(t: Token) -> bool:
    return t.dictionary_form.endswith("う") and t.ends("いて")


def _dependant(v: View, a: Token, b: Token) -> bool:
    return a.cls == "verb" and b.has("非自立") and b.dictionary_form != "おる" and b.surface != a.surface


def _possible_dependant(v: View, a: Token, b: Token) -> bool:
    if a.cls != "verb" or not b.has("非自立可能") or a.ends("たり") or b.surface == a.surface or _classical_te(b):
        return False
    return (
        b.dictionary_form in DEPENDANTS
        or (b.dictionary_form == "する" and a.ends("た", "だ"))
        or (b.dictionary_form == "付く" and len(a.dictionary_form) >= 2 and v.lexicon.known(a.dictionary_form[:-1] + "り付く") is True)
    )


def _suru(v: View, a: Token, b: Token) -> bool:
    modern = b.dictionary_form == "する" and b.surface not in ("する", "しない") and not b.ends("すぎ", "過ぎ")
    return a.has("サ変可能") and (modern or (b.dictionary_form == "す" and b.normalized_form == "為る"))


def _te_chain(v: View) -> Edit | None:
    a, b, c = v.here, v.next(), v.next(2)
    if c is not None and a.cls == "verb" and b.dictionary_form == "て" and c.dictionary_form in TE_CHAIN:
        return Edit((v.joined(a, b, c),), take=3)
    return None


def _after_te(v: View, a: Token, b: Token) -> bool:
    if a.cls not in ("verb", "adjective") or not a.ends("て", "で") or b.cls == "adjective" or _classical_te(b):
        return False
    if b.cls == "verb" and b.dictionary_form != "おる":
        if (b.has("非自立可能") and b.dictionary_form in ("いる", "ない")) or not {b.dictionary_form, b.normalized_form}.isdisjoint(AFTER_TE):
            return True
    return any(f.text in AFTER_TE or (f.text in TE_CHAIN and any(t.startswith("v") for t in f.tags)) for f in v.lexicon.forms(b.surface))


def _toru(v: View, a: Token, b: Token) -> bool:
    if a.cls != "verb" or not a.ends("っ") or b.dictionary_form != "とる":
        return False
    # っ + とる: the contraction of て and おる shows only in both together
    return any(any("toru (teoru)" in d for d in f.process) and any(t.startswith(("v", "stem-te")) for t in f.tags) for f in v.lexicon.forms(a.surface[-1] + b.surface) + v.lexicon.forms(b.surface))


def _perhaps(v: View) -> Edit | None:
    a = v.here
    if a.surface == "か" and (b := v.next()) is not None and b.surface == "も" and (c := v.next(2)) is not None and c.surface.startswith("しれ"):
        return Edit((v.joined(a, b, c, pos=("連語",)),), take=3)
    return None


#: Particles that make one (fixed values).
PARTICLE_PAIRS = (("に", "は"), ("と", "は"), ("で", "は"), ("の", "に"))


def _particles(v: View) -> Edit | None:
    a = v.here
    if not any(a.surface == first for first, _ in PARTICLE_PAIRS) or (b := v.next()) is None or (a.surface, b.surface) not in PARTICLE_PAIRS:
        return None
    pair = v.joined(a, b, lemma=a.surface + b.surface, lemma_reading=a.lemma_reading + b.lemma_reading)
    if pair.surface != "では" or (c := v.next(2)) is None or c.dictionary_form not in ("ない", "無い"):
        return Edit((pair,), take=2)
    d = v.next(3)
    more = (c, d) if d is not None and d.surface == "か" else (c,)
    return Edit((v.joined(pair, *more, pos=("連語",), dictionary_form="ではない" + ("か" if len(more) == 2 else "")),), take=2 + len(more))


# ---------------------------------------------------------------- changes by table


@dataclass(frozen=True)
class Retag:
    """A change of tokens of these surfaces. Tests are on the token as it came (surface, cls, reading) and its
    neighbours; values left None stay. Of those that fit, a later one writes over an earlier one."""

    surfaces: tuple[str, ...]
    cls: str | None = None
    reading: str | None = None
    lemma: str | None = None
    pos_has: str | None = None
    before_pos: str | None = None
    before_cls_not: str | None = None
    not_before_ends: str | None = None
    next_in: tuple[str, ...] | None = None
    next_or_end: tuple[str, ...] | None = None
    next_class: str | None = None
    next_pos: str | None = None
    next_lemmas: tuple[str, str] | None = None
    to_cls: str | None = None
    to_pos: str | None = None
    to_reading: str | None = None
    to_lemma: str | None = None
    to_surface: str | None = None
    in_reading: tuple[str, str] | None = None

    def suits(self, t: Token) -> bool:
        """Whether the token itself is one that this changes."""
        return not (
            (self.surfaces and t.surface not in self.surfaces)
            or (self.cls is not None and t.cls != self.cls)
            or (self.reading is not None and t.reading != self.reading)
            or (self.lemma is not None and t.dictionary_form != self.lemma)
            or (self.pos_has is not None and not t.has(self.pos_has))
        )

    def fits(self, v: View) -> bool:
        """Whether the token and its neighbours are such; neighbours are looked at only where it hangs on them."""
        if not self.suits(v.here):
            return False
        if self.before_pos is not None or self.before_cls_not is not None or self.not_before_ends is not None:
            before = v.last()
            if (
                (self.before_pos is not None and (before is None or self.before_pos not in before.pos))
                or (self.before_cls_not is not None and before is not None and before.cls == self.before_cls_not)
                or (self.not_before_ends is not None and before is not None and before.ends(self.not_before_ends))
            ):
                return False
        if self.next_in is None and self.next_or_end is None and self.next_class is None and self.next_pos is None and self.next_lemmas is None:
            return True
        after = v.next()
        return not (
            (self.next_in is not None and (after is None or after.surface not in self.next_in))
            or (self.next_or_end is not None and after is not None and after.surface not in self.next_or_end)
            or (self.next_class is not None and (after is None or after.cls != self.next_class))
            or (self.next_pos is not None and (after is None or self.next_pos not in after.pos))
            or (self.next_lemmas is not None and ((later := v.next(2)) is None or (after.surface, later.dictionary_form) != self.next_lemmas))
        )

    def changes(self, t: Token) -> dict:
        out: dict = {"cls": self.to_cls, "surface": self.to_surface, "dictionary_form": self.to_lemma, "reading": self.to_reading}
        out = {k: x for k, x in out.items() if x is not None}
        if self.to_pos is not None:
            out |= {"pos": (self.to_pos,), "cls": self.to_cls or CLASSES.get(self.to_pos, "other")}
        if self.to_reading is not None and t.lemma_reading == self.reading:
            out["lemma_reading"] = self.to_reading
        if self.in_reading is not None:
            out |= {"reading": t.reading.replace(*self.in_reading), "normalized_form": self.to_lemma}
        return out


#: Misparses: tokens whose class the context shows to be wrong (fixed values).
MISPARSE = (
    Retag(("なん", "フン", "ふん"), to_pos="接頭辞"),
    Retag(("そう",), to_pos="副詞"),
    Retag(("おい",), to_pos="感動詞"),
    Retag(("つ",), cls="suffix", to_cls="counter"),
    Retag((), cls="suffix", pos_has="助数詞", to_cls="counter"),
    Retag(("人",), cls="suffix", before_pos="数詞", to_cls="counter"),
    Retag(("家",), cls="suffix", next_class="particle", next_in=("から", "を", "が", "に", "で", "へ", "の", "は", "も"), to_pos="名詞"),
    Retag(("山",), cls="suffix", to_pos="名詞"),
    Retag(("だろう",), cls="auxiliary", to_pos="連語", to_lemma="だろう"),
    Retag(("だろ",), cls="auxiliary", to_pos="連語", to_lemma="だろ"),
    Retag(("だあ",), to_pos="助動詞", to_lemma="です", to_surface="だ"),
    Retag(("だー",), to_pos="助動詞", to_lemma="です"),
)
#: Readings that the context decides (fixed values).
READINGS = (
    Retag(("表",), reading="ヒョウ", next_in=("へ", "に"), before_cls_not="noun", to_reading="オモテ"),
    Retag(("何",), reading="ナン", next_or_end=("を", "が", "も"), to_reading="ナニ"),
    Retag(("一日", "１日", "1日"), reading="ツイタチ", not_before_ends="月", to_reading="イチニチ"),
    Retag(("禍",), reading="カ", to_reading="ワザワイ"),
    Retag(("私",), reading="シ", to_reading="ワタシ", to_pos="代名詞"),
    Retag(("寒気",), reading="カンキ", next_lemmas=("が", "する"), to_reading="サムケ"),
    Retag(("後",), reading="ゴ", next_pos="数詞", to_reading="アト"),
    Retag(("時",), reading="トキ", before_pos="数詞", to_reading="ジ"),
    Retag(("次",), reading="ジ", cls="prefix", to_reading="ツギ", to_pos="名詞"),
    Retag(("何時",), reading="ナンドキ", to_reading="ナンジ"),
    Retag(("長",), reading="チョウ", cls="suffix", to_pos="名詞"),
    Retag(("隙",), reading="ヒマ", to_reading="スキ"),
    Retag((), lemma="弄う", to_lemma="弄る", in_reading=("イラ", "イジ")),
    Retag(("今日",), reading="コンニチ", to_reading="キョウ"),
    Retag(("私",), reading="ワタクシ", to_reading="ワタシ"),
    Retag(("玩具",), reading="ガング", to_reading="オモチャ"),
    Retag(("雪道",), reading="セツドウ", to_reading="ユキミチ"),
    Retag(("日本",), reading="ニッポン", to_reading="ニホン"),
    Retag(("明日",), reading="アス", to_reading="アシタ"),
    Retag(("山道",), reading="サンドウ", to_reading="ヤマミチ"),
    Retag(("富士山",), reading="フジヤマ", to_reading="フジサン"),
    Retag(("二日",), reading="フタカ", to_reading="フツカ"),
)


def retagging(table: tuple[Retag, ...]) -> Rule:
    anywhere = [r for r in table if not r.surfaces]
    surfaces = {s for r in table for s in r.surfaces}

    def rule(v: View) -> Edit | None:
        t = v.here
        rows = [r for r in (table if t.surface in surfaces else anywhere) if r.fits(v)]
        if not rows:
            return None
        out = t
        for r in rows:
            out = v.marked(out, **r.changes(t))
        return Edit((out,))

    return rule


# ---------------------------------------------------------------- the pipeline


@dataclass(frozen=True)
class Stage:
    """Sweeps, one after the other; over streams only that hold a token for which the trigger holds."""

    name: str
    sweeps: tuple[tuple[Rule, ...], ...]
    trigger: Callable[[Token], bool] | None = field(default=None)

    def run(self, tokens: list[Token], lexicon: Lexicon) -> list[Token]:
        for rules in self.sweeps:
            tokens = sweep(rules, tokens, lexicon, self.name)
        return tokens


def _one(name: str, *rules: Rule, trigger: Callable[[Token], bool] | None = None) -> Stage:
    return Stage(name, (rules,), trigger)


def _is(surface: str, cls: str | None = None) -> Callable[[Token], bool]:
    return lambda t: t.surface == surface and cls in (None, t.cls)


def _class(cls: str) -> Callable[[Token], bool]:
    return lambda t: t.cls == cls


def _section(*sections: str) -> Callable[[Token], bool]:
    return lambda t: t.has(*sections)


def _suffixed(t: Token) -> bool:
    return t.cls == "suffix" or t.has("接尾辞")


STAGES = (
    _one("split_compound_auxiliary_verbs", _compound_verb),
    _one("split_tatte_particle", _tatte, trigger=lambda t: (t.surface in ("たって", "だって") and t.has("接続助詞")) or (t.surface == "だな" and t.cls == "noun")),
    _one("split_tan_suffix", _tan, trigger=_is("たん", "suffix")),
    _one("split_tawake_noun", _tawake, trigger=_is("たわけ")),
    _one("split_proper_noun_with_particle", _name_with_particle),
    _one("repair_hasa_noun", _hasa, trigger=_is("はさ", "noun")),
    Stage("repair_n_tokenisation", ((_n_apart,), (_n_with_da,))),
    Stage("repair_vowel_elongation", ((_drawn_out,), (_filler, _drawn_ru, _drawn_volitional, _drawn_adjective, _doubled_u, _doubled_a)), lambda t: "ー" in t.surface),
    _one("repair_process_special_cases", _noyo, _de, _retagged("ぬ", "verb", "寝る", "助動詞", "ず"), _retagged("なれ", "pronoun", "汝", "動詞", "成る"), _expression),
    _one("repair_colloquial_negative_nee", _nee, trigger=_class("interjection")),
    _one("repair_colloquial_ran_nai", _ran, trigger=_is("らん")),
    _one("repair_honorific_lemma", _lemma_of_head(lambda t: t.surface[1:] if t.surface.startswith(("お", "ご")) else "", ("noun",))),
    _one("repair_compound_noun_suffix", _lemma_of_head(_without_ending, ("noun", "adjectival_noun"))),
    _one("combine_prefixes", with_next(_prefix, _prefixed), trigger=_class("prefix")),
    _one("combine_inflections", _inflection),
    _one("combine_amounts", _amount, trigger=_section("数詞", "助数詞可能")),
    _one("combine_tte", with_last(_tte, may=lambda t: t.surface.startswith("て")), trigger=lambda t: t.ends("っ")),
    _one("combine_auxiliary_verb_stem", with_last(_stem_auxiliary), trigger=_section("助動詞語幹")),
    _one("combine_suffix", _suffix, trigger=_suffixed),
    _one("cleanup_reclassify_orphaned_suffixes", changed(_orphan, lambda v, t: {"pos": ("名詞",), "reading": ""}), trigger=_suffixed),
    _one("combine_conjunctive_particle", with_last(lambda v, a, b: b.has("接続助詞") and b.surface in ("て", "で", "ちゃ", "ば") and a.cls in STEMMED), trigger=_section("接続助詞")),
    _one("combine_auxiliary", _dearu, with_last(_auxiliary)),
    _one("combine_to_naru", with_next(_to_naru, lambda v, a, b: v.marked(b, surface=a.surface + b.surface, reading=a.reading + b.reading, dictionary_form="となる", normalized_form="なる", lemma_reading="となる", char_start=a.char_start))),
    _one("repair_fused_interjection_particle", _fused_interjection, trigger=_class("interjection")),
    _one("repair_orphaned_auxiliary", _orphaned_auxiliary),
    _one("combine_adverbial_particle", with_last(lambda v, a, b: b.has("副助詞") and b.dictionary_form in ("だり", "たり") and a.cls == "verb"), trigger=_section("副助詞")),
    Stage("combine_verb_dependant", ((with_last(_dependant),), (with_last(_possible_dependant),), (with_next(_suru),), (_te_chain, with_next(_after_te), with_next(_toru)))),
    _one("combine_particles", _perhaps, _particles),
    _one("combine_final", with_next(lambda v, a, b: b.surface == "ば" and a.cls == "verb")),
    _one("repair_tanka_to_ta_n_ka", _tanka, trigger=_is("たんか", "noun")),
    _one("cleanup_filter_misparse", retagging(MISPARSE)),
    _one("disambiguation_fix_reading_ambiguity", retagging(READINGS)),
)


def rewritten(tokens: list[Token], lexicon: Lexicon, only: tuple[str, ...] | None = None) -> list[Token]:
    """A stream after the stages, or after the named ones. Triggers are looked for anew when the stream's length changes."""
    looked = tokens
    for stage in STAGES:
        if (only is None or stage.name in only) and (stage.trigger is None or any(map(stage.trigger, looked))):
            before = len(tokens)
            tokens = stage.run(tokens, lexicon)
            if len(tokens) != before:
                looked = tokens
    return tokens


# ---------------------------------------------------------------- tables


def collected_lexicon(lexicon: DataFrame) -> dict[str, bool]:
    """term -> known of a table; one of more than MOST_TERMS is refused, as every task gets them all."""
    known = F.coalesce("known", F.lit(True)) if "known" in lexicon.columns else F.lit(True)
    rows = lexicon.where("term is not null").groupBy("term").agg(F.max(known).alias("known")).limit(MOST_TERMS + 1).collect()
    if len(rows) > MOST_TERMS:
        raise ValueError(f"a lexicon of over {MOST_TERMS} terms")
    return {r["term"]: r["known"] for r in rows}


def _prepared(df: DataFrame, tokens: str, only: tuple[str, ...] | None, lexicon: DataFrame | None):
    """Names checked, the terms sent to the tasks, and what makes a task's own rewriter."""
    unknown = set(only or ()) - {s.name for s in STAGES}
    if unknown:
        raise ValueError(f"no such stages: {sorted(unknown)}")
    entries = df.sparkSession.sparkContext.broadcast(collected_lexicon(lexicon)) if lexicon is not None else None

    def rewriter():
        from glyphmill.operators.memo import Rewriter

        return Rewriter(Lexicon(entries.value if entries is not None else None), only)

    return rewriter


def _cast(df: DataFrame, tokens: str) -> Column:
    """The tokens with the fields there are, as the types they must have."""
    element = df.schema[tokens].dataType.elementType
    have = {f.name: f.dataType.simpleString() for f in element.fields}
    if all(have.get(n, kind) == kind for n, kind in _TOKEN.items()):
        return F.col(f"`{tokens}`")
    return F.transform(F.col(f"`{tokens}`"), lambda t: F.struct(*[t[n].cast(kind).alias(n) for n, kind in _TOKEN.items() if n in have]))


def rewrite_streams(df: DataFrame, tokens: str = "tokens", only: tuple[str, ...] | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """df with the array of tokens rewritten, in one pass over its rows. A token is a struct of surface, reading,
    dictionary_form, pos, char_start, char_end and, as far as there are any, normalized_form, lemma_reading, cls and
    rules. A null array is an empty stream; other columns pass through."""
    rewriter = _prepared(df, tokens, only, lexicon)
    kept = [c for c in df.columns if c != tokens]
    source = df.select(*[df[f"`{c}`"] for c in kept], _cast(df, tokens).alias(tokens))
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(tokens, T._parse_datatype_string(_STREAM))])
    names = [*kept, tokens]

    def run(batches):
        own = rewriter()
        for batch in batches:
            for first, last, streams in own.read(batch.column(len(kept))):
                columns = [c.slice(first, last - first) for c in batch.columns[: len(kept)]]
                yield pa.RecordBatch.from_arrays([*columns, own.shown(own.run(streams))], names=names)

    return source.mapInArrow(run, schema)


def tally_streams(
    df: DataFrame, tokens: str = "tokens", by: tuple[str, ...] = ("surface", "cls"), only: tuple[str, ...] | None = None, lexicon: DataFrame | None = None, make: Callable | None = None
) -> DataFrame:
    """A row for each stream and each combination of the fields `by` among its rewritten tokens: the other columns of df,
    the fields, how many tokens have them (n) and the sum of their char_start (places). Tokens are as for
    `rewrite_streams`; or the column holds something else, of which make(rewriter, array) gives (first row, last row,
    streams) within the same pass."""
    rewriter = _prepared(df, tokens, only, lexicon)
    kept = [c for c in df.columns if c != tokens]
    source = df.select(*[df[f"`{c}`"] for c in kept], (_cast(df, tokens) if make is None else df[f"`{tokens}`"]).alias(tokens))
    counts = [T.StructField("n", T.LongType()), T.StructField("places", T.LongType())]
    schema = T.StructType([*[df.schema[c] for c in kept], *[T.StructField(f, T._parse_datatype_string(_TOKEN[f])) for f in by], *counts])
    names = schema.names

    def run(batches):
        own = rewriter()
        for batch in batches:
            column = batch.column(len(kept))
            for first, last, streams in own.read(column) if make is None else make(own, column):
                row, found = own.tally(own.run(streams), by)
                columns = [c.slice(first, last - first).take(row) for c in batch.columns[: len(kept)]]
                yield pa.RecordBatch.from_arrays([*columns, *found], names=names)

    return source.mapInArrow(run, schema)


def rewrite(tokens: DataFrame, key: str, only: tuple[str, ...] | None = None, lexicon: DataFrame | None = None) -> DataFrame:
    """The same for one row a token: key, ord and the fields of tokens."""
    fields = [c for c in tokens.columns if c in _TOKEN]
    streams = tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", *fields))).alias("tokens"))
    out = rewrite_streams(streams, "tokens", only, lexicon)
    return out.select(key, F.posexplode("tokens").alias("ord", "t")).select(key, "ord", "t.*")


def inflections(tokens: DataFrame, key: str, lexicon: DataFrame | None = None) -> DataFrame:
    """The greedy merge of inflections alone."""
    return rewrite(tokens, key, ("combine_inflections",), lexicon)


def _windows(key: str):
    return Window.partitionBy(key).orderBy("ord")
