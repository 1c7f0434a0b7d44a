"""A query-string language: field:term, "phrases"~slop, [a TO b] ranges, prefix*, term~distance, ^boost, AND OR NOT,
+ and -, parentheses. Side by side means OR, or AND with `conjunction`. `lenient` drops what does not parse."""

from __future__ import annotations

import re

from glyphmill.operators.index import Index
from glyphmill.operators.query import All, Boolean, Boost, Compare, Exists, Fuzzy, Match, Phrase, PhrasePrefix, Query, Range, Term, tokens_of

_LEX = re.compile(
    r"""\s*(?:(?P<open>\()|(?P<close>\))|(?P<op>AND\b|OR\b|NOT\b|&&|\|\|)|(?P<sign>[+-](?=\S))|(?P<field>[\w.]+):(?=\S)
    |(?P<range>[\[{]\s*(?P<low>\S+)\s+TO\s+(?P<high>\S+?)\s*[\]}])|"(?P<phrase>[^"]*)"(?:~(?P<slop>\d+))?
    |(?P<compare>[<>]=?)(?P<limit>[^\s()]+)|(?P<word>[^\s()"^]+))(?:\^(?P<boost>\d+(?:\.\d+)?))?""",
    re.VERBOSE,
)


class ParseError(ValueError):
    pass


class _Parser:
    def __init__(self, index: Index, text: str, default: str | None, conjunction: bool):
        self.index, self.default, self.conjunction = index, default, conjunction
        self.tokens, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = _LEX.match(text, at)
            if not m or m.end() == at:
                raise ParseError(f"unexpected {text[at : at + 10]!r}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def peek(self, group: str) -> str | None:
        return self.tokens[self.at][group] if self.at < len(self.tokens) else None

    def either(self) -> Query:
        sides = [self.both()]
        while self.peek("op") in ("OR", "||"):
            self.at += 1
            sides.append(self.both())
        return sides[0] if len(sides) == 1 else Boolean(should=tuple(sides))

    def both(self) -> Query:
        sides = [self.run()]
        while self.peek("op") in ("AND", "&&"):
            self.at += 1
            sides.append(self.run())
        return sides[0] if len(sides) == 1 else Boolean(must=tuple(sides))

    def run(self) -> Query:
        """Clauses side by side, with signs."""
        must, should, must_not = [], [], []
        while self.at < len(self.tokens) and not self.peek("close") and self.peek("op") not in ("AND", "OR", "&&", "||"):
            sign = self.peek("sign")
            negated = sign == "-" or self.peek("op") == "NOT"
            self.at += bool(sign) or self.peek("op") == "NOT"
            (must_not if negated else must if sign or self.conjunction else should).append(self.clause(self.default))
        if not (must or should or must_not):
            raise ParseError("a clause is missing")
        if must_not and not (must or should):
            must.append(All())
        if len(must) + len(should) == 1 and not must_not:
            return (must or should)[0]
        return Boolean(tuple(must), tuple(should), tuple(must_not))

    def clause(self, field: str | None) -> Query:
        if self.at >= len(self.tokens):
            raise ParseError("a clause is missing")
        token = self.tokens[self.at]
        self.at += 1
        if token["field"]:
            return self.clause(token["field"])
        if token["open"]:
            outer, self.default = self.default, field
            out = self.either()
            if not self.peek("close"):
                raise ParseError("a parenthesis is open")
            boost = self.tokens[self.at]["boost"]
            self.at, self.default = self.at + 1, outer
        else:
            if field is None:
                raise ParseError("a field is missing")
            out, boost = self.leaf(field, token), token["boost"]
        return Boost(out, float(boost)) if boost else out

    def leaf(self, field: str, token: re.Match) -> Query:
        text = field in self.index.fields
        if token["range"]:
            bound = lambda v: None if v == "*" else self.value(field, v)
            return Range(field, bound(token["low"]), bound(token["high"]), token["range"][0] == "[", token["range"][-1] == "]")
        if token["compare"]:
            return Compare(field, token["compare"], (self.value(field, token["limit"]),))
        if token["phrase"] is not None:
            words = tokens_of(self.index, field, token["phrase"]) if text else []
            if not text:
                return Term(field, self.value(field, token["phrase"]))
            return Match(field, tuple(words)) if len(words) < 2 else Phrase(field, tuple(words), int(token["slop"] or 0))
        word = token["word"]
        if word is None:
            raise ParseError(f"unexpected {token[0]!r}")
        if word == "*":
            return Exists(field)
        if not text:
            return Term(field, self.value(field, word))
        if word.endswith("*"):
            return PhrasePrefix(field, (word[:-1].lower(),))
        if m := re.fullmatch(r"(.+)~(\d?)", word):
            return Fuzzy(field, m[1].lower(), int(m[2] or 2))
        words = tokens_of(self.index, field, word)
        return Match(field, tuple(words)) if len(words) < 2 else Phrase(field, tuple(words))

    def value(self, field: str, word: str):
        kind = self.index.rows.schema[field].dataType.typeName()
        if kind in ("byte", "short", "integer", "long"):
            return int(word)
        if kind in ("float", "double", "decimal"):
            return float(word)
        return {"true": True, "false": False}[word.lower()] if kind == "boolean" else word


def parse(index: Index, text: str, field: str | None = None, conjunction: bool = False, lenient: bool = False) -> Query:
    """The query of a query string; field: the default field."""
    try:
        parser = _Parser(index, text, field, conjunction)
        out = parser.either()
        if parser.at < len(parser.tokens):
            raise ParseError(f"unexpected {parser.tokens[parser.at][0]!r}")
        return out
    except (ParseError, ValueError, KeyError):
        if not lenient:
            raise
        words = tuple(w for w in re.findall(r"\w+", text) if w not in ("AND", "OR", "NOT"))
        default = field or next(iter(index.fields))
        return Match(default, tuple(t for w in words for t in tokens_of(index, default, w)), all=conjunction)
