"""Byte-pair encoding as a bounded-lookahead streaming transducer, vectorised over words.

`BpeModel` reads a tokenizer file (vocabulary, ranked merges, optional word-end suffix) and computes from the merge
list how many symbols to the right of a token's end can still change it (`lookahead`). A word is read in windows of
bounded size; a token is emitted once that many symbols behind it have been seen, or the word has ended, and reading
goes on at the end of the last emitted token. Memory is therefore constant in the length of the word. Every word goes
through this transducer (`step`), many at a time: a step reads the next window of each, and within it, in every word,
all occurrences of its lowest-ranked pair are merged at once, again and again. Most words end within their first window.

Why a bound exists: what lies to the right of a boundary can only act on it through a chain of overlapping merges of
falling rank (a symbol is taken away by an earlier merge with its right neighbour, whose own fate an earlier merge
still further right decides, and so on). `_sufficient_lookahead` takes the longest such chain, in one pass by rank.
"""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PairTable:
    """(left, right) -> value for arrays of pairs; open addressing, as many probes as the fullest run needs."""

    def __init__(self, left, right, value):
        self.bits = max(10, int(len(left) * 8 - 1).bit_length())
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.values = np.full((1 << self.bits) + 64, _NONE, np.int32)
        self.probes = 1
        for l, r, v in zip(left, right, value, strict=True):
            slot = int(self._slot(np.int64(l << 32 | r)))
            n = 1
            while self.keys[slot] >= 0:
                slot, n = slot + 1, n + 1
            self.keys[slot], self.values[slot], self.probes = l << 32 | r, v, max(self.probes, n)

    def _slot(self, key):
        with np.errstate(over="ignore"):
            return (np.asarray(key).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], _NONE)
        open_ = np.flatnonzero((found != key) & (found >= 0))
        for p in range(1, self.probes):
            if not len(open_):
                break
            at = slot[open_] + p
            found = self.keys[at]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out


class BpeModel:
    """A ranked merge list over bytes."""

    def __init__(self, path: str, window: int = 128):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.letters = byte_letters()
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        self.right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([self.vocab[a + b] for a, b in pairs], np.int64)
        self.ranks = PairTable(self.left.tolist(), self.right.tolist(), range(len(pairs)))
        self.inner = np.array([self.vocab[c] for c in self.letters], np.int32)
        self.final = np.array([self.vocab[c + self.suffix] for c in self.letters], np.int32)
        self.size = max(max(self.vocab.values()), *self.special.values()) + 1
        self.symbols = np.ones(self.size, np.int64)  # bytes that a token covers
        for l, r, m in zip(self.left, self.right, self.made, strict=True):
            self.symbols[m] = self.symbols[l] + self.symbols[r]
        self.lookahead = self._sufficient_lookahead()
        self.window = window + self.lookahead

    def _sufficient_lookahead(self) -> int:
        reach = np.zeros(self.size, np.int64)  # by token: through merges so far whose left part it is
        inherited = np.zeros(self.size, np.int64)  # what its right edge depended on before it was made
        for l, r, m in zip(self.left.tolist(), self.right.tolist(), self.made.tolist(), strict=True):
            now = self.symbols[r] + max(reach[r], inherited[r])
            inherited[m] = max(inherited[m], reach[r], inherited[r])
            reach[l] = max(reach[l], now)
        return int(max(reach.max(), inherited.max()))

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many symbol runs at once: (flat tokens, tokens per run)."""
        word = np.repeat(np.arange(len(lengths)), lengths)
        done_ids, done_words = [], []
        symbols = symbols.astype(np.int32)
        while len(symbols):
            rank = np.full(len(symbols), _NONE, np.int32)
            if len(symbols) > 1:
                same = word[1:] == word[:-1]
                rank[:-1] = np.where(same, self.ranks.get(symbols[:-1], symbols[1:]), _NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            spread = np.repeat(best, np.diff(np.r_[first, len(symbols)]))
            over = spread == _NONE
            if over.any():
                done_ids.append(symbols[over])
                done_words.append(word[over])
                keep = ~over
                symbols, word, rank, spread = symbols[keep], word[keep], rank[keep], spread[keep]
                if not len(symbols):
                    break
            match = rank == spread
            starts = match & ~np.r_[False, match[:-1]]
            run = np.maximum.accumulate(np.where(starts, np.arange(len(match)), 0))
            take = match & ((np.arange(len(match)) - run) % 2 == 0)  # leftmost first where matches overlap
            symbols = symbols.copy()
            symbols[take] = self.made[rank[take]]
            keep = np.r_[True, ~take[:-1]]
            symbols, word = symbols[keep], word[keep]
        if not done_ids:
            return np.zeros(0, np.int32), np.zeros(len(lengths), np.int64)
        ids, of = np.concatenate(done_ids), np.concatenate(done_words)
        return ids[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(lengths))

    def step(self, parts: list[bytes], ended: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What the transducer emits for the next window of each of many words, of which some have `ended` with it:
        (flat ids, ids per word, bytes read per word)."""
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        data = np.frombuffer(b"".join(parts), np.uint8)
        symbols = self.inner[data]
        last = np.cumsum(lengths)[ended & (lengths > 0)] - 1
        symbols[last] = self.final[data[last]]
        ids, counts = self.merge(symbols, lengths)
        if ended.all():
            return ids, counts, lengths
        word = np.repeat(np.arange(len(parts)), counts)
        first = np.cumsum(counts) - counts
        ends = np.cumsum(self.symbols[ids])
        ends -= (np.cumsum(lengths) - lengths)[word]  # of each token within its word's window
        stable = ended[word] | (ends <= (lengths - self.lookahead)[word])
        stable[first[counts > 0]] = True  # a window is longer than any token that could still change
        out = np.bincount(word[stable], minlength=len(parts))
        read = np.zeros(len(parts), np.int64)
        np.maximum.at(read, word[stable], ends[stable])
        return ids[stable], out, read

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of whole words: (flat ids, ids per word)."""
        at = np.zeros(len(words), np.int64)
        left = np.arange(len(words))
        ids, of = [], []
        while len(left):
            starts = at[left].tolist()
            parts = [words[i][a : a + self.window] for i, a in zip(left.tolist(), starts, strict=True)]
            ended = np.array([a + len(p) == len(words[i]) for i, a, p in zip(left.tolist(), starts, parts, strict=True)], bool)
            found, counts, read = self.step(parts, ended)
            ids.append(found)
            of.append(np.repeat(left, counts))
            at[left] += read
            left = left[~ended]
        if not ids:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(ids) == 1:
            return ids[0], np.bincount(of[0], minlength=len(words))
        flat, word = np.concatenate(ids), np.concatenate(of)
        return flat[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def stream(self, word: bytes):
        """Ids of one word of any length, in constant memory: each as soon as nothing further right can change it."""
        at = 0
        while at < len(word):
            part = word[at : at + self.window]
            ids, _, read = self.step([part], np.array([at + len(part) == len(word)]))
            yield from ids.tolist()
            at += int(read[0])
