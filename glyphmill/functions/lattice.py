"""A dictionary lattice tokenizer: the cheapest path over a lexicon, cut at three granularities from one search.

The lexicon is a table (surface, cost, pos1, pos2, reading, dictionary_form, normalized_form, split_b, split_a); a small
one comes with the package and any other can be given. Unknown runs of one script are words of their own at a high
cost. Modes: C the path itself, B and A its entries' own splits. The search is sequential, so it runs in an Arrow
function; everything after it is column expressions.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A small lexicon: surface, cost, part of speech (2), reading, dictionary form, normalized form, B split, A split.
LEXICON: tuple[tuple, ...] = (
    ("東京大学", 800, "名詞", "固有名詞", "トウキョウダイガク", "東京大学", "東京大学", ("東京", "大学"), ("東京", "大学")),
    ("東京都", 900, "名詞", "固有名詞", "トウキョウト", "東京都", "東京都", ("東京", "都"), ("東京", "都")),
    ("東京", 700, "名詞", "固有名詞", "トウキョウ", "東京", "東京", (), ()),
    ("大学", 700, "名詞", "普通名詞", "ダイガク", "大学", "大学", (), ()),
    ("都", 1200, "名詞", "普通名詞", "ト", "都", "都", (), ()),
    ("学生", 700, "名詞", "普通名詞", "ガクセイ", "学生", "学生", (), ()),
    ("国際空港", 900, "名詞", "普通名詞", "コクサイクウコウ", "国際空港", "国際空港", ("国際", "空港"), ("国際", "空港")),
    ("国際", 700, "名詞", "普通名詞", "コクサイ", "国際", "国際", (), ()),
    ("空港", 700, "名詞", "普通名詞", "クウコウ", "空港", "空港", (), ()),
    ("私", 600, "代名詞", "*", "ワタシ", "私", "私", (), ()),
    ("本", 700, "名詞", "普通名詞", "ホン", "本", "本", (), ()),
    ("日本", 600, "名詞", "固有名詞", "ニッポン", "日本", "日本", (), ()),
    ("日本語", 700, "名詞", "普通名詞", "ニホンゴ", "日本語", "日本語", ("日本", "語"), ("日本", "語")),
    ("語", 1200, "名詞", "接尾辞", "ゴ", "語", "語", (), ()),
    ("は", 200, "助詞", "係助詞", "ハ", "は", "は", (), ()),
    ("が", 200, "助詞", "格助詞", "ガ", "が", "が", (), ()),
    ("を", 200, "助詞", "格助詞", "ヲ", "を", "を", (), ()),
    ("に", 200, "助詞", "格助詞", "ニ", "に", "に", (), ()),
    ("へ", 200, "助詞", "格助詞", "ヘ", "へ", "へ", (), ()),
    ("の", 200, "助詞", "格助詞", "ノ", "の", "の", (), ()),
    ("で", 250, "助詞", "格助詞", "デ", "で", "で", (), ()),
    ("て", 250, "助詞", "接続助詞", "テ", "て", "て", (), ()),
    ("読ん", 500, "動詞", "一般", "ヨン", "読む", "読む", (), ()),
    ("読む", 500, "動詞", "一般", "ヨム", "読む", "読む", (), ()),
    ("行く", 500, "動詞", "非自立可能", "イク", "行く", "行く", (), ()),
    ("行っ", 500, "動詞", "非自立可能", "イッ", "行く", "行く", (), ()),
    ("食べ", 500, "動詞", "一般", "タベ", "食べる", "食べる", (), ()),
    ("食べる", 500, "動詞", "一般", "タベル", "食べる", "食べる", (), ()),
    ("いる", 400, "動詞", "非自立可能", "イル", "いる", "居る", (), ()),
    ("だ", 250, "助動詞", "*", "ダ", "だ", "だ", (), ()),
    ("です", 250, "助動詞", "*", "デス", "です", "です", (), ()),
    ("ます", 250, "助動詞", "*", "マス", "ます", "ます", (), ()),
    ("た", 250, "助動詞", "*", "タ", "た", "た", (), ()),
    ("。", 100, "補助記号", "句点", "。", "。", "。", (), ()),
    ("、", 100, "補助記号", "読点", "、", "、", "、", (), ()),
)
UNKNOWN_COST, STEP_COST = 3000, 300
_RUN = re.compile(r"[ァ-ヺー]+|[ぁ-ゖ]|[一-鿿]|[^\W_ァ-ヺーぁ-ゖ一-鿿]+|\s+|.", re.DOTALL)
MORPHEME = "surface string, start int, end int, pos1 string, pos2 string, reading string, dictionary_form string, normalized_form string, lemma_reading string"
MODES = f"struct<c:array<struct<{MORPHEME.replace(' string', ':string').replace(' int', ':int')}>>,b:array<struct<{MORPHEME.replace(' string', ':string').replace(' int', ':int')}>>,a:array<struct<{MORPHEME.replace(' string', ':string').replace(' int', ':int')}>>>"


class Lattice:
    def __init__(self, rows: tuple[tuple, ...]):
        self.entries: dict[str, tuple] = {}
        for row in rows:  # the first entry of a surface counts
            self.entries.setdefault(row[0], row)
        self.longest = max(map(len, self.entries), default=1)

    def path(self, text: str) -> list[tuple[int, int]]:
        """Spans of the cheapest path; of equal paths the one with the longer last word."""
        best: list[float] = [0.0] + [float("inf")] * len(text)
        back = [0] * (len(text) + 1)
        runs = {m.start(): m.end() for m in _RUN.finditer(text)}
        for i in range(len(text)):
            if best[i] == float("inf"):
                continue
            for j in range(i + 1, min(len(text), i + self.longest) + 1):
                entry = self.entries.get(text[i:j])
                if entry and best[i] + entry[1] + STEP_COST < best[j]:
                    best[j], back[j] = best[i] + entry[1] + STEP_COST, i
            j = runs.get(i, i + 1)
            if best[i] + UNKNOWN_COST < best[j]:
                best[j], back[j] = best[i] + UNKNOWN_COST, i
        out, at = [], len(text)
        while at:
            out.append((back[at], at))
            at = back[at]
        return out[::-1]

    def morpheme(self, surface: str, start: int) -> dict:
        e = self.entries.get(surface)
        kind = ("空白", "*") if surface.isspace() else ("名詞", "普通名詞")
        values = (*e[2:7],) if e else (*kind, surface, surface, surface)
        lemma = self.entries.get(values[3])
        # the reading of the dictionary form: its own entry's, or none
        values = (*values, values[2] if values[3] == surface else lemma[4] if lemma else "")
        names = ("pos1", "pos2", "reading", "dictionary_form", "normalized_form", "lemma_reading")
        return {"surface": surface, "start": start, "end": start + len(surface), **dict(zip(names, values, strict=True))}

    def modes(self, text: str) -> dict[str, list[dict]]:
        out: dict[str, list[dict]] = {"c": [], "b": [], "a": []}
        for start, end in self.path(text):
            surface = text[start:end]
            if surface.isspace():
                continue
            e = self.entries.get(surface)
            for mode, parts in (("c", ()), ("b", e[7] if e else ()), ("a", e[8] if e else ())):
                at = start
                for part in parts or (surface,):
                    out[mode].append(self.morpheme(part, at))
                    at += len(part)
        return out


@lru_cache(4)
def _lattice(rows: tuple[tuple, ...]) -> Lattice:
    return Lattice(rows)


def layered(system: tuple[tuple, ...], user: tuple[tuple, ...]) -> tuple[tuple, ...]:
    """A user's entries before the system's; of the same surface, the first counts, and of the system the cheapest."""
    return (*user, *sorted(system, key=lambda r: r[1])) if user else system


def load_lexicon(df: DataFrame, user: DataFrame | None = None, most: int = 2_000_000) -> tuple[tuple, ...]:
    """A lexicon table as rows for the tokenizer, a user's entries first. Its size is checked, since each task holds it."""
    names = ("surface", "cost", "pos1", "pos2", "reading", "dictionary_form", "normalized_form", "split_b", "split_a")
    parts = []
    for part in (df, user):
        rows = part.select(*names).limit(most + 1).collect() if part is not None else []
        parts.append(tuple(tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in rows))
    if sum(map(len, parts)) > most:
        raise ValueError(f"the lexicon has more than {most} entries")
    return layered(*parts) if parts[1] else tuple(sorted(parts[0], key=lambda r: r[1]))


def lexicon_of(spark, path: str | None = None) -> tuple[tuple, ...]:
    """The lexicon at a path, or at the one in the session's setting glyphmill.lexicon.path; the small one if there is
    none. Paths that glyphmill.lexicon.user.paths lists, parted by colons, go before it."""
    path = path or spark.conf.get("glyphmill.lexicon.path", None)
    users = [p for p in (spark.conf.get("glyphmill.lexicon.user.paths", "") or "").split(":") if p]
    system = load_lexicon(spark.read.parquet(path)) if path else tuple(sorted(LEXICON, key=lambda r: r[1]))
    return layered(system, tuple(r for p in users for r in load_lexicon(spark.read.parquet(p))))


def all_modes(text: Column, lexicon: tuple[tuple, ...] = LEXICON) -> Column:
    """struct(c, b, a) of morphemes from one search."""

    @F.arrow_udf(MODES)
    def run(column: pa.Array) -> pa.Array:
        lattice = _lattice(lexicon)
        kind = pa.struct([(n, t) for n, t in (("surface", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pos1", pa.string()), ("pos2", pa.string()), ("reading", pa.string()), ("dictionary_form", pa.string()), ("normalized_form", pa.string()), ("lemma_reading", pa.string()))])
        return pa.array([lattice.modes(t or "") for t in column.to_pylist()], pa.struct([(m, pa.list_(kind)) for m in "cba"]))

    return run(text)


def surfaces(text: Column, mode: str = "c", lexicon: tuple[tuple, ...] = LEXICON) -> Column:
    return F.transform(all_modes(text, lexicon)[mode], lambda m: m["surface"])


def search_surfaces(text: Column, lexicon: tuple[tuple, ...] = LEXICON) -> Column:
    """The surfaces of search tokens: each word, then its parts."""
    from glyphmill.functions.search_tokens import search_tokens

    cuts = F.transform(F.array(F.struct(text.alias("text"), all_modes(text, lexicon).alias("m"))), lambda x: search_tokens(x["text"], x["m"], normalized=False))[0]
    return F.transform(cuts, lambda t: t["surface"])


def streams(text: Column, mode: str = "c", lexicon: tuple[tuple, ...] = LEXICON) -> Column:
    """Morphemes as token streams, which `rewrite_streams` takes."""
    return F.transform(all_modes(text, lexicon)[mode], lambda m: F.struct(
        m["surface"].alias("surface"), m["reading"].alias("reading"), m["dictionary_form"].alias("dictionary_form"), m["normalized_form"].alias("normalized_form"), m["lemma_reading"].alias("lemma_reading"),
        F.array(m["pos1"], m["pos2"]).alias("pos"), m["start"].alias("char_start"), m["end"].alias("char_end")))


def analyse(df: DataFrame, text: str, lexicon: tuple[tuple, ...] = LEXICON, mode: str = "c", terms: DataFrame | None = None, to: str = "tokens") -> DataFrame:
    """df with the text's tokens after all rewriting stages: text to streams to rules in one call. terms: the lexicon that
    rules ask."""
    from glyphmill.operators.rewrite import rewrite_streams

    return rewrite_streams(df.withColumn(to, streams(F.col(text), mode, lexicon)), to, lexicon=terms)


# ---------------------------------------------------------------- words by frequency

#: A small list of words and how frequent they are.
WORD_FREQUENCIES: tuple[tuple, ...] = (
    ("我", 3000), ("来到", 400), ("来", 1500), ("到", 1500), ("北京", 900), ("清华", 300), ("清华大学", 250), ("华大", 20), ("大学", 800), ("学生", 500), ("中国", 1200), ("人民", 600), ("中", 1500), ("国", 800),
    ("是", 5000), ("的", 9000), ("在", 4000), ("有", 3500), ("研究", 600), ("研究生", 200), ("生命", 300), ("命", 100), ("起源", 120), ("生", 300), ("学习", 400), ("喜欢", 350), ("和", 3000), ("了", 6000),
)
_CHINESE = re.compile(r"[一-鿿㐀-䶿]+|[A-Za-z0-9]+(?:[.+#_-][A-Za-z0-9]+)*|[^\s一-鿿㐀-䶿A-Za-z0-9]")


class FrequentWords:
    """Words of a list, by the most probable path: each word's probability is its share of all frequencies, and a character
    that the list lacks is a word of frequency one."""

    def __init__(self, rows: tuple[tuple, ...], user: tuple[tuple, ...] = ()):
        self.frequency: dict[str, float] = {}
        for word, *more in (*user, *rows):
            self.frequency.setdefault(word, float(more[0]) if more else 0.0)
        self.total = math.log(sum(self.frequency.values()) or 1.0)
        self.longest = max(map(len, self.frequency), default=1)
        for word, *more in user:  # a user's word without a frequency gets one that keeps it whole
            if not more or not more[0]:
                parts = self.run(word) if len(word) > 1 else [word]
                self.frequency[word] = max(1.0, math.ceil(math.exp(sum(math.log(self.frequency.get(p) or 1.0) - self.total for p in parts) + self.total)) + 1.0)

    def run(self, text: str) -> list[str]:
        """A run of ideographs, cut; of equal paths the one with the longer words first."""
        best, step = [0.0] * (len(text) + 1), [1] * (len(text) + 1)
        for i in range(len(text) - 1, -1, -1):
            options = []
            for n in range(1, min(self.longest, len(text) - i) + 1):
                f = self.frequency.get(text[i : i + n], 0.0)
                if f or n == 1:
                    options.append((math.log(f or 1.0) - self.total + best[i + n], n))
            best[i], step[i] = max(options)
        out, at = [], 0
        while at < len(text):
            out.append(text[at : at + step[at]])
            at += step[at]
        return out

    def words(self, text: str) -> list[str]:
        return [w for m in _CHINESE.finditer(text) for w in (self.run(m[0]) if m[0][0] >= "㐀" else [m[0]])]


@lru_cache(4)
def _frequent(rows: tuple[tuple, ...], user: tuple[tuple, ...]) -> FrequentWords:
    return FrequentWords(rows, user)


def frequent_words(text: Column, rows: tuple[tuple, ...] = WORD_FREQUENCIES, user: tuple[tuple, ...] = ()) -> Column:
    """The words of Chinese text; runs of Latin letters and digits, and other marks, are words of their own."""

    @F.arrow_udf("array<string>")
    def run(column: pa.Array) -> pa.Array:
        find = _frequent(rows, user).words
        return pa.array([find(t or "") for t in column.to_pylist()], pa.list_(pa.string()))

    return run(text)
