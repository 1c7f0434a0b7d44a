"""Queries as JSON, both ways, and a table function that tokenizes in SQL."""

from __future__ import annotations

import dataclasses
import json

from glyphmill.functions.tokenizers import Tokenizer
from glyphmill.operators import query as q

_KINDS = {c.__name__: c for c in [*q.Query.__subclasses__(), q.Near, Tokenizer]}


def _plain(value):
    if dataclasses.is_dataclass(value):
        given = {f.name: _plain(getattr(value, f.name)) for f in dataclasses.fields(value) if getattr(value, f.name) != f.default}
        return {type(value).__name__: given}
    return [_plain(v) for v in value] if isinstance(value, (tuple, list)) else value


def _value(value):
    if isinstance(value, dict) and len(value) == 1 and (name := next(iter(value))) in _KINDS:
        return _KINDS[name](**{k: _value(v) for k, v in value[name].items()})
    return tuple(_value(v) for v in value) if isinstance(value, list) else value


def to_json(query: q.Query) -> str:
    """{"Kind": {field: value}}; defaults are left out."""
    return json.dumps(_plain(query), ensure_ascii=False, sort_keys=True)


def from_json(text: str) -> q.Query:
    out = _value(json.loads(text))
    if not isinstance(out, q.Query):
        raise ValueError("not a query")
    return out


def tokenizer_from_json(text: str) -> Tokenizer:
    out = _value(json.loads(text))
    if not isinstance(out, Tokenizer):
        raise ValueError("not a tokenizer")
    return out


def register(spark, name: str = "text_tokens", options: Tokenizer | str = Tokenizer()) -> None:
    """SQL: SELECT * FROM text_tokens(text) gives token, position by a tokenizer, which may be given as JSON."""
    from pyspark.sql.functions import udtf

    from glyphmill.functions.plain import tokens

    chosen = tokenizer_from_json(options) if isinstance(options, str) else options

    @udtf(returnType="token string, position int")
    class Tokens:
        def eval(self, text: str):
            yield from tokens(text, chosen)

    spark.udtf.register(name, Tokens)
