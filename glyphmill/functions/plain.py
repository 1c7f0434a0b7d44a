"""The tokenizers in plain Python, for places that no column expression reaches: SQL table functions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import regex

from glyphmill.functions import lattice
from glyphmill.functions.tokenizers import FOLD_FROM, FOLD_TO, STEMS, Tokenizer

_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)
_IDEOGRAPHS = r"\u3400-\u4DBF\u4E00-\u9FFF\u3040-\u30FF"


def _split(text: str, options: Tokenizer) -> list[str]:
    kind = options.kind
    if kind in ("alias", "literal"):
        return [text]
    if kind == "literal_normalized":
        return [text.strip(" ").lower()]
    if kind == "whitespace":
        return regex.findall(r"[^ \t\n\x0B\f\r]+", text)
    if kind == "unicode_words":
        return regex.findall(r"[\p{L}\p{N}_]+", text)
    if kind == "ngram":
        sizes = range(options.min_gram, options.max_gram + 1)
        return [text[i : i + n] for n in sizes for i in range(1 if options.prefix_only and len(text) >= n else len(text) - n + 1)]
    if kind == "regex_pattern":
        return [m[0] for m in regex.finditer(options.pattern, text)]
    if kind == "source_code":
        text = regex.sub(r"([\p{Ll}\p{N}])(\p{Lu})", r"\1 \2", text)
        return regex.findall(r"[\p{L}\p{N}]+", regex.sub(r"(\p{Lu}+)(\p{Lu}\p{Ll})", r"\1 \2", text))
    if kind == "chinese_compatible":
        return regex.findall(f"[{_IDEOGRAPHS}]|[^ \\t\\n\\x0B\\f\\r{_IDEOGRAPHS}]+", text)
    if kind == "jieba":
        return lattice._frequent(options.lexicon or lattice.WORD_FREQUENCIES, options.user_lexicon).words(text)
    if kind in ("lattice", "lindera"):
        cuts = _lattice(options).modes(text)
        if options.mode != "search":
            return [m["surface"] for m in cuts[options.mode]]
        out = []
        for c in cuts["c"]:
            if c["pos1"] != "助動詞" and (c["pos1"], c["pos2"]) != ("助詞", "接続助詞"):
                out += [c["surface"], *(b["surface"] for b in cuts["b"] if c["start"] <= b["start"] and b["end"] <= c["end"] and b["surface"] != c["surface"])]
        return out
    return regex.findall(r"[\p{L}\p{N}]+", text)


@lru_cache(4)
def _lattice(options: Tokenizer) -> lattice.Lattice:
    return lattice.Lattice(lattice.layered(options.lexicon or lattice.LEXICON, options.user_lexicon))


def _stem(token: str, language: str) -> str:
    if language == "english":
        if len(token) < 5:
            return token
        for ending, new in (("ies", "y"), ("ing", ""), ("ed", "")):
            if token.endswith(ending):
                return token[: -len(ending)] + new
        return token[:-1] if token.endswith("s") and not token.endswith("ss") else token
    least, stay, endings, replaced = STEMS[language]
    if len(token) < least:
        return token
    for ending, new in reversed(replaced.items()):
        if token.endswith(ending) and len(token) - len(ending) >= stay:
            return token[: -len(ending)] + new
    longest = max((e for e in endings if token.endswith(e) and len(token) - len(e) >= stay), key=len, default="")
    return token[: len(token) - len(longest)]


def tokens(text: str | None, options: Tokenizer = Tokenizer()) -> Iterator[tuple[str, int]]:
    """(token, position) of a text; a token that is removed leaves its position empty."""
    stop = set(options.all_stopwords())
    if text is None:
        return
    for position, token in enumerate(_split(text, options)):
        token = token.lower() if options.lowercase else token
        if options.ascii_folding:
            token = token.replace("ß", "ss").replace("œ", "oe").translate(_FOLD)
        if not (options.remove_long and len(token) > options.remove_long) and token not in stop:
            yield (_stem(token, options.stemmer) if options.stemmer else token), position
