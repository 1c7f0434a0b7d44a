"""Queries over the library's own operators, by name, with their SQL oracles."""

from __future__ import annotations

from glyphmill.plans import japanese, rewriting, search, tokens

QUERIES: dict = {**tokens.QUERIES, **search.QUERIES, **japanese.QUERIES, **rewriting.QUERIES}
ORACLES: dict[str, str] = {**tokens.ORACLES, **search.ORACLES, **japanese.ORACLES, **rewriting.ORACLES}
