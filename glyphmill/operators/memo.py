"""Rewriting of many streams at once, each distinct decision made once.

Tokens that differ only in where they are have one kind, a number. A rule decides by the tokens it looks at, so what it
looked at, in order, and its edit are kept in a tree: next time a few look-ups by kind take the place of the rule. Where
new tokens begin and end is kept as a distance from an edge of a token of the input, and worked out at the end. A rule that
looked at more than DEEPEST tokens is run each time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from glyphmill.operators.rewrite import _TOKEN, CLASSES, STAGES, Edit, Lexicon, Token, View

#: Tokens of one piece of work (a longer stream is one of its own); tokens looked at that are remembered; kinds and
#: branches after which all is forgotten and begun anew.
PIECE, DEEPEST, MOST_KINDS, MOST_BRANCHES = 200_000, 12, 200_000, 500_000

_HERE, _BEFORE = 0, 1 << 30  # features: n > 0 the n-th to the right, n < 0 to the left, and the last token taken
_SHIFT = 40
_NULL = -(1 << 62)
_TEXTS = [f for f, kind in _TOKEN.items() if kind == "string"]
_PA = {"string": pa.string(), "int": pa.int32(), "array<string>": pa.list_(pa.string())}
_TYPES = {f: _PA[kind] for f, kind in _TOKEN.items()}


class Streams(NamedTuple):
    """Streams one after the other: their lengths, and of each token its kind, begin and end."""

    lengths: np.ndarray
    kinds: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


class _Branch:
    __slots__ = ("feature", "nodes")

    def __init__(self, feature: int):
        self.feature, self.nodes = feature, {}


class _Probe(View):
    """A view that fetches kinds as they are asked for and takes down which. Begins and ends are edges of what was asked for."""

    def __init__(self, kinds: list[Token], fetch, lexicon: Lexicon, stage: str):
        self.kinds, self.fetch, self.lexicon, self.stage = kinds, fetch, lexicon, stage
        self.seen: dict[int, Token | None] = {}
        self.path: list[tuple[int, int]] = []

    def _get(self, feature: int) -> Token | None:
        if feature not in self.seen:
            kind, slot = self.fetch(feature), 2 * len(self.path) + 1
            self.path.append((feature, kind))
            self.seen[feature] = None if kind < 0 else self.kinds[kind]._replace(char_start=slot << _SHIFT, char_end=(slot + 1) << _SHIFT)
        return self.seen[feature]

    @property
    def here(self) -> Token:
        return self._get(_HERE)

    @property
    def before(self) -> Token | None:
        return self._get(_BEFORE)

    def next(self, n: int = 1) -> Token | None:
        return self._get(n)

    def last(self, n: int = 1) -> Token | None:
        return self._get(-n)

    def edge(self, value: int) -> tuple[int, int, int]:
        """A begin or end as (feature, 1 for its end, distance)."""
        slot = (value + (1 << (_SHIFT - 1))) >> _SHIFT
        if not 0 < slot <= 2 * len(self.path):
            raise ValueError("a token that begins or ends nowhere near those looked at")
        return self.path[(slot - 1) // 2][0], (slot - 1) % 2, value - (slot << _SHIFT)


class Rewriter:
    """The stages over streams of a task."""

    def __init__(self, lexicon: Lexicon, only: tuple[str, ...] | None = None):
        self.lexicon = lexicon
        self.stages = [s for s in STAGES if only is None or s.name in only]
        self.forget()

    def forget(self) -> None:
        self.tokens: list[Token] = []
        self.ids: dict[Token, int] = {}
        self.roots = [[{} for _ in s.sweeps] for s in self.stages]
        self.triggers = [set() for _ in self.stages]
        self.tried = [0] * len(self.stages)
        self.branches = 0

    def kind(self, token: Token) -> int:
        token = token._replace(char_start=0, char_end=0)
        found = self.ids.get(token)
        if found is None:
            found = self.ids[token] = len(self.tokens)
            self.tokens.append(token)
        return found

    # ------------------------------------------------------------ decisions

    def _decided(self, rules, stage: str, fetch, root: dict):
        """The edit at a place, by the rules themselves; kept in the tree."""
        probe = _Probe(self.tokens, fetch, self.lexicon, stage)
        here = probe.here
        edit: Edit | None = next((e for rule in rules if (e := rule(probe)) is not None), None)
        leaf = None
        if edit is not None:
            feature_of = {id(t): f for f, t in probe.seen.items() if t is not None}
            made = [tuple((feature_of[id(t)], -1, None, None) if id(t) in feature_of else (_HERE, self.kind(t), probe.edge(t.char_start), probe.edge(t.char_end)) for t in ts) for ts in (edit.put, edit.back)]
            if not (edit.take == 1 and not edit.drop and not edit.back and len(edit.put) == 1 and edit.put[0] is here):
                leaf = (edit.take, edit.drop, *made)
        nodes, key = root, probe.path[0][1]
        for feature, kind in probe.path[1:DEEPEST]:
            node = nodes.get(key)
            if node is None:
                node = nodes[key] = _Branch(feature)
                self.branches += 1
            nodes, key = node.nodes, kind
        nodes[key] = leaf if len(probe.path) <= DEEPEST else False
        return leaf

    def _sweep(self, rules, stage: str, root: dict, kinds: list[int], items: list[int], made: list[tuple]) -> tuple[list[int], list[int]]:
        """One sweep over a stream: its tokens' kinds and items. An item is a token's number in the input, or -1 - k for the
        k-th of those made: (kind, edge of the input that its begin is measured from, distance, the same for its end)."""
        out, out_kinds, n, i = [], [], len(kinds), 0
        over, over_kind, over_item = -1, -1, 0  # where tokens were handed back: the last token taken there

        def value(feature: int) -> int:
            if feature == _BEFORE:
                return over_kind if over == i else kinds[i - 1] if i else -1
            if feature >= 0:
                return kinds[i + feature] if i + feature < n else -1
            return out_kinds[feature] if len(out_kinds) >= -feature else -1

        def item(feature: int) -> int:
            if feature == _BEFORE:
                return over_item if over == i else items[i - 1]
            return items[i + feature] if feature >= 0 else out[feature]

        def edge(at: tuple[int, int, int]) -> tuple[int, int]:
            feature, end, distance = at
            of = item(feature)
            if of >= 0:
                return 2 * of + end, distance
            own = made[-1 - of]
            return (own[3], own[4] + distance) if end else (own[1], own[2] + distance)

        missing = _Branch(0)
        while i < n:
            kind = kinds[i]
            node = root.get(kind, missing)
            if node is None:
                out.append(items[i])
                out_kinds.append(kind)
                i += 1
                continue
            while node.__class__ is _Branch and node is not missing:
                f = node.feature
                if f > 0 and f != _BEFORE:
                    key = kinds[i + f] if i + f < n else -1
                elif f < 0:
                    key = out_kinds[f] if len(out_kinds) >= -f else -1
                else:
                    key = value(f)
                node = node.nodes.get(key, missing)
            if node is missing or node is False:
                node = self._decided(rules, stage, value, root)
                n = len(kinds)
            if node is None:
                out.append(items[i])
                out_kinds.append(kind)
                i += 1
                continue
            take, drop, put, back = node
            placed, placed_kinds = [], []
            for feature, of_kind, start, end in put:
                if of_kind < 0:
                    placed_kinds.append(value(feature))
                    placed.append(item(feature))
                else:
                    made.append((of_kind, *edge(start), *edge(end)))
                    placed_kinds.append(of_kind)
                    placed.append(-len(made))
            handed, handed_kinds = [], []
            for feature, of_kind, start, end in back:
                if of_kind < 0:
                    handed_kinds.append(value(feature))
                    handed.append(item(feature))
                else:
                    made.append((of_kind, *edge(start), *edge(end)))
                    handed_kinds.append(of_kind)
                    handed.append(-len(made))
            if drop:
                del out[len(out) - drop :], out_kinds[len(out_kinds) - drop :]
            out += placed
            out_kinds += placed_kinds
            last_kind, last_item = (kinds[i + take - 1], items[i + take - 1]) if take else (value(_BEFORE), item(_BEFORE) if value(_BEFORE) >= 0 else 0)
            i += take
            if handed:
                at = max(0, i - len(handed))
                kinds[at:i], items[at:i] = handed_kinds, handed
                i, n = at, len(kinds)
                over, over_kind, over_item = i, last_kind, last_item
        return out_kinds, out

    def run(self, streams: Streams) -> Streams:
        """The streams after the stages. Triggers are looked for anew when a stream's length changes."""
        all_kinds = streams.kinds.tolist()
        made: list[tuple] = []
        out: list[int] = []
        lengths, at = [], 0
        for length in streams.lengths.tolist():
            kinds, items = all_kinds[at : at + length], list(range(at, at + length))
            at += length
            looked = kinds
            for s, stage in enumerate(self.stages):
                if stage.trigger is not None:
                    while self.tried[s] < len(self.tokens):
                        if stage.trigger(self.tokens[self.tried[s]]):
                            self.triggers[s].add(self.tried[s])
                        self.tried[s] += 1
                    if self.triggers[s].isdisjoint(looked):
                        continue
                before = len(kinds)
                kinds, items = list(kinds), list(items)  # a sweep may hand tokens back in its own copy
                for rules, root in zip(stage.sweeps, self.roots[s], strict=True):
                    kinds, items = self._sweep(rules, stage.name, root, kinds, items, made)
                if len(kinds) != before:
                    looked = kinds
            out += items
            lengths.append(len(items))
        of = np.array(out, np.int64)
        edges = np.empty(2 * len(streams.kinds), np.int64)
        edges[::2], edges[1::2] = streams.starts, streams.ends
        new = np.flatnonzero(of < 0)
        old = np.maximum(of, 0)
        if len(streams.kinds):
            kinds, starts, ends = streams.kinds[old], streams.starts[old], streams.ends[old]
        else:
            kinds = starts = ends = np.zeros(len(of), np.int64)
        if len(new):
            table = np.array(made, np.int64)[-1 - of[new]]
            kinds[new] = table[:, 0]
            starts[new] = edges[table[:, 1]] + table[:, 2]
            ends[new] = edges[table[:, 3]] + table[:, 4]
        return Streams(np.array(lengths, np.int64), kinds, starts, ends)

    def _begin(self) -> None:
        if len(self.tokens) > MOST_KINDS or self.branches > MOST_BRANCHES:
            self.forget()

    # ------------------------------------------------------------ columns

    def pieces(self, lengths: np.ndarray) -> Iterator[tuple[int, int]]:
        """Rows first to last of some PIECE tokens; what is remembered is let go between them when it is too much."""
        bounds, first = np.concatenate([[0], np.cumsum(lengths)]), 0
        while first < len(lengths):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + PIECE, "right")) - 1)
            self._begin()
            yield first, last
            first = last

    def read(self, column: pa.Array) -> Iterator[tuple[int, int, Streams]]:
        """Streams of an array of structs, some rows at a time."""
        lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
        for first, last in self.pieces(lengths):
            own = lengths[first:last]
            yield first, last, self._encoded(own, column.slice(first, last - first).flatten())

    def _encoded(self, lengths: np.ndarray, tokens: pa.StructArray) -> Streams:
        fields = {tokens.type.field(k).name: c for k, c in enumerate(tokens.flatten())}
        n = len(tokens)
        edges = []
        for f in ("char_start", "char_end"):
            c = fields[f].cast(pa.int64())
            edges.append(np.asarray(pc.fill_null(c, _NULL)))
        code = np.zeros(n, np.int64)
        for f, kind in _TOKEN.items():
            if f not in fields or kind == "int":
                continue
            for more in _codes(fields[f], kind):
                code = _packed(code * (int(more.max(initial=0)) + 1) + more)
        first = np.zeros(int(code.max(initial=-1)) + 1, np.int64)
        first[code[::-1]] = np.arange(n)[::-1]
        rows = pa.array(first)
        values = {f: c.take(rows).to_pylist() for f, c in fields.items() if f in _TOKEN and _TOKEN[f] != "int"}
        ids = np.array([self.kind(_token({f: v[k] for f, v in values.items()})) for k in range(len(first))], np.int64)
        return Streams(lengths, ids[code], *edges)

    def _fields(self, kinds: np.ndarray, fields: Iterable[str]) -> list[pa.Array]:
        used = np.unique(kinds)
        at = pa.array(np.searchsorted(used, kinds))
        tokens = [self.tokens[k] for k in used.tolist()]
        return [pa.array([getattr(t, f) for t in tokens], _TYPES[f]).take(at) for f in fields]

    def shown(self, streams: Streams) -> pa.Array:
        """Streams as an array of structs."""
        edge = {f: pa.array(np.where(e < _NULL // 2, 0, e), mask=e < _NULL // 2).cast(pa.int32()) for f, e in (("char_start", streams.starts), ("char_end", streams.ends))}
        rest = [f for f in _TOKEN if f not in edge]
        columns = edge | dict(zip(rest, self._fields(streams.kinds, rest), strict=True))
        tokens = pa.StructArray.from_arrays([columns[f] for f in _TOKEN], fields=[pa.field(f, _TYPES[f]) for f in _TOKEN])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(streams.lengths)]), pa.int32()), tokens)

    def tally(self, streams: Streams, by: tuple[str, ...]) -> tuple[pa.Array, list[pa.Array]]:
        """The row of each group of tokens equal in some fields; the fields, how many tokens and the sum of their begins."""
        used = np.unique(streams.kinds)
        groups: dict[tuple, int] = {}
        group = np.array([groups.setdefault(tuple(getattr(self.tokens[k], f) for f in by), len(groups)) for k in used.tolist()], np.int64)
        width = max(1, len(groups))
        key = np.repeat(np.arange(len(streams.lengths)), streams.lengths) * width
        if len(used):
            to = np.zeros(int(used[-1]) + 1, np.int64)
            to[used] = group
            key += to[streams.kinds]
        cells = np.arange(0)
        if len(streams.lengths) * width > 4 * len(key) + 1_000_000:  # few of all groups in each row: number those there are
            cells, key = np.unique(key, return_inverse=True)
        known = streams.starts > _NULL // 2
        place = np.where(known, streams.starts, 0)
        size = len(cells) or len(streams.lengths) * width
        n = np.bincount(key, minlength=size)
        # halves of the begins: sums of floats are exact below 2 ** 53
        places = (np.bincount(key, place >> 16, size).astype(np.int64) << 16) + np.bincount(key, place & 0xFFFF, size).astype(np.int64)
        some = np.bincount(key, known, size) > 0
        there = np.flatnonzero(n)
        cell = cells[there] if len(cells) else there
        values = list(groups)
        which = pa.array(cell % width)
        found = [pa.array([v[k] for v in values], _TYPES[f]).take(which) for k, f in enumerate(by)]
        return pa.array(cell // width), [*found, pa.array(n[there].astype(np.int64)), pa.array(places[there], mask=~some[there])]


def _packed(codes: np.ndarray) -> np.ndarray:
    """Codes as numbers from 0 in the order they come in."""
    return np.asarray(pa.array(codes).dictionary_encode().indices, np.int64)


def _codes(column: pa.Array, kind: str) -> Iterator[np.ndarray]:
    """Numbers by which values differ: one for a string, some for a list."""
    if kind == "string":
        yield np.asarray(pc.fill_null(column, "").dictionary_encode().indices, np.int64)
        return
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    yield lengths
    inner = np.asarray(pc.fill_null(column.flatten().dictionary_encode().indices, -1), np.int64) + 1
    begin = np.cumsum(lengths) - lengths
    for k in range(int(lengths.max(initial=0))):
        out, there = np.zeros(len(lengths), np.int64), lengths > k
        out[there] = inner[begin[there] + k]
        yield out


def _token(values: dict) -> Token:
    """A token of the fields there are; what is null is empty, what was left out follows from the others."""
    known = {f: values.get(f) or "" for f in _TEXTS}
    pos = tuple(values.get("pos") or ())
    if "normalized_form" not in values:
        known["normalized_form"] = known["dictionary_form"]
    if "cls" not in values:
        known["cls"] = CLASSES.get(pos[0] if pos else "", "other")
    return Token(**known, pos=pos, rules=tuple(values.get("rules") or ()), char_start=0, char_end=0)
