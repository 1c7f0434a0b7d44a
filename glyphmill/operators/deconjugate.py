"""Deconjugation: a surface's possible dictionary forms, by suffix rules applied again and again.

The rules are the forward table turned round: (con_end, dec_end, con_tag, dec_tag, detail, kind). A rule replaces the
ending con_end by dec_end. At first any rule applies and gives the text the classes con_tag and dec_tag; later only one
whose con_tag is the class reached last, or "uninflectable". Kinds narrow that down:
- "only final": first only; "never final": later only;
- "v1inftrap": not to a text whose one class is stem-ren; "saspecial": not where さ precedes the ending; "never": not at all;
- "substitution": the ending changes, whatever the classes, unless the text was met before.
A rule without a detail may not come first. Texts grow by ten characters at most and classes by six over the length of
the surface, so that every chain ends; nothing else bounds them. Forms are looked up by the ending of the text.

Each distinct surface is analysed once, in one Arrow pass: a chain of joins would repeat all steps before it in each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.verbs import EUPHONY, GODAN, ROW_A, ROW_E, ROW_I, ROW_O, TERMINAL

#: Rules of a user's own table that are sent to tasks; more are refused.
MOST_RULES = 100_000
KINDS = ("", "only final", "never final", "v1inftrap", "saspecial", "never", "substitution")


class Rule(NamedTuple):
    con_end: str
    dec_end: str
    con_tag: str
    dec_tag: str
    detail: str
    kind: str = ""


class Form(NamedTuple):
    text: str
    tags: tuple[str, ...]
    #: details, innermost last
    process: tuple[str, ...]


def _row(last: str, row: str) -> str:
    return row[TERMINAL.index(last)]


@lru_cache(1)
def rule_rows() -> list[Rule]:
    """All rules, from the conjugation tables."""
    out: set[Rule] = set()

    def add(con: str, dec: str, con_tag: str, dec_tag: str, detail: str, kind: str = "") -> None:
        out.add(Rule(con, dec, con_tag, dec_tag, detail, "only final" if con_tag == "end" and detail == "imperative" else kind))

    def te_like(te: str, dec: str, tag: str) -> None:
        ta = te[:-1] + ("だ" if te[-1] == "で" else "た")
        add(te, dec, "te", tag, "te")
        add(ta, dec, "past", tag, "past")
        add(ta + "ら", dec, "end", tag, "conditional")
        add(ta + "り", dec, "end", tag, "representative")
        add(te + "いる", dec, "v1", tag, "progressive")
        add(te + "る", dec, "v1", tag, "progressive")
        add(te + "しまう", dec, "v5u", tag, "completion")
        add((te[:-1] + ("じゃう" if te[-1] == "で" else "ちゃう")), dec, "v5u", tag, "completion")
        add((te[:-1] + ("じまう" if te[-1] == "で" else "ちまう")), dec, "v5u", tag, "completion")
        add(te + "おく", dec, "v5k", tag, "preparative")
        add((te[:-1] + ("どく" if te[-1] == "で" else "とく")), dec, "v5k", tag, "preparative")
        add((te[:-1] + ("どる" if te[-1] == "で" else "とる")), dec, "v5r", tag, "toru (teoru)")
        add(te + "いく", dec, "v5k-s", tag, "going")
        add(te + "くる", dec, "vk", tag, "coming")
        add(te + "もらう", dec, "v5u", tag, "receiving")
        add(te + "くれる", dec, "v1", tag, "giving")
        add(te + "あげる", dec, "v1", tag, "giving")
        add(te + "みる", dec, "v1", tag, "attempt")
        add(te + "ください", dec, "end", tag, "polite request")

    def verb(a: str, i: str, e: str, o: str, dec: str, tag: str, ichidan: bool) -> None:
        add(a + "ない", dec, "adj-i", tag, "negative")
        add(a + "ず", dec, "end", tag, "negative zu")
        add(a + "ぬ", dec, "end", tag, "negative nu")
        add(a + ("られる" if ichidan else "れる"), dec, "v1", tag, "passive")
        add(a + ("させる" if ichidan else "せる"), dec, "v1", tag, "causative")
        add(e + ("られる" if ichidan else "る"), dec, "v1", tag, "potential")
        add(e + ("れば" if ichidan else "ば"), dec, "end", tag, "provisional")
        add(e + ("ろ" if ichidan else ""), dec, "end", tag, "imperative")
        add(o + ("よう" if ichidan else "う"), dec, "end", tag, "volitional")
        add(i + "ます", dec, "masu", tag, "polite")
        add(i + "たい", dec, "adj-i", tag, "want")
        add(i + "ながら", dec, "end", tag, "while")
        add(i + "そう", dec, "end", tag, "seemingness")
        add(i + "そうだ", dec, "end", tag, "seemingness")
        add(i + "すぎる", dec, "v1", tag, "excess")
        add(i + "やすい", dec, "adj-i", tag, "easy")
        add(i + "にくい", dec, "adj-i", tag, "hard")
        add(a + ("さす" if ichidan else "す"), dec, "v5s", tag, "short causative", "saspecial")
        add(a + "ねえ", dec, "end", tag, "slang negative")
        add(a + "ん", dec, "end", tag, "slang negative")

    for tag, last in GODAN.items():
        if tag in ("v5r-i", "v5aru", "v5u-s", "v5k-s"):
            continue
        verb(_row(last, ROW_A), _row(last, ROW_I), _row(last, ROW_E), _row(last, ROW_O), last, tag, False)
        te_like(EUPHONY[last], last, tag)
    te_like("って", "く", "v5k-s")
    te_like("うて", "う", "v5u-s")
    verb("", "", "", "", "る", "v1", True)
    te_like("て", "る", "v1")
    verb("し", "し", "", "し", "する", "vs-i", True)
    te_like("して", "する", "vs-i")
    for con, tag, detail in (("される", "v1", "passive"), ("させる", "v1", "causative"), ("できる", "v1", "potential"), ("すれば", "end", "provisional"), ("しろ", "end", "imperative"), ("せず", "end", "negative zu")):
        add(con, "する", tag, "vs-i", detail)
    for a, k in (("こ", "く"), ("来", "来")):
        add(a + "ない", k + "る", "adj-i", "vk", "negative")
        add(a + "られる", k + "る", "v1", "vk", "potential")
        add(a + "させる", k + "る", "v1", "vk", "causative")
        add(a + "よう", k + "る", "end", "vk", "volitional")
        add(a + "い", k + "る", "end", "vk", "imperative")
        i = "き" if a == "こ" else a
        add(i + "ます", k + "る", "masu", "vk", "polite")
        add(i + "たい", k + "る", "adj-i", "vk", "want")
        te_like(i + "て", k + "る", "vk")
    for con, detail, tag in (("くない", "negative", "adj-i"), ("かった", "past", "past"), ("くて", "te", "te"), ("ければ", "provisional", "end"), ("く", "adverbial", "end"), ("かったら", "conditional", "end"), ("そう", "seemingness", "end"), ("さ", "noun form", "end")):
        add(con, "い", tag, "adj-i", detail)
    for con, detail in (("ました", "past"), ("ません", "negative"), ("ませんでした", "negative past"), ("まして", "te"), ("ましょう", "volitional")):
        add(con, "ます", "end", "masu", detail)
    return sorted(r for r in out if r.con_end)


def rules(spark) -> DataFrame:
    return spark.createDataFrame(rule_rows(), "con_end string, dec_end string, con_tag string, dec_tag string, detail string, kind string")


def expand_rules(df: DataFrame) -> DataFrame:
    """Rules given as parallel arrays (con_end, dec_end, con_tag, dec_tag, with one detail) as one row each; an array of
    one value stands for all rows."""
    names = ("con_end", "dec_end", "con_tag", "dec_tag")
    size = F.greatest(*[F.size(n) for n in names])
    rows = df.withColumn("_i", F.explode(F.sequence(F.lit(1), size)))
    return rows.select(*[F.when(F.size(n) == 1, F.element_at(n, 1)).otherwise(F.try_element_at(n, F.col("_i"))).alias(n) for n in names], "detail")


def rules_sql() -> str:
    """The rules as a VALUES list."""
    return ", ".join("(" + ", ".join(f"'{v}'" for v in r) + ")" for r in rule_rows())


def recursion_sql(source: str, rule_source: str) -> str:
    """Forms reachable from the texts of `source` (text): recursive SQL that Spark and DuckDB both run, for rules of the
    kinds "", "only final", "never final" and "saspecial"."""
    return f"""WITH RECURSIVE forms(original, form, tag, process, depth) AS (
        SELECT text AS original, text AS form, CAST('' AS STRING) AS tag, CAST('' AS STRING) AS process, 0 AS depth FROM {source}
        UNION
        SELECT f.original, concat(substring(f.form, 1, length(f.form) - length(r.con_end)), r.dec_end), r.dec_tag,
            concat(r.detail, CASE WHEN f.process = '' THEN '' ELSE '→' END, f.process), f.depth + 1
        FROM forms f JOIN (SELECT * FROM {rule_source}) r
            ON r.con_end = right(f.form, length(r.con_end)) AND (f.tag = '' OR f.tag = r.con_tag OR r.con_tag = 'uninflectable')
        WHERE (r.kind <> 'only final' OR f.tag = '') AND (r.kind <> 'never final' OR f.tag <> '')
            AND (r.kind <> 'saspecial' OR substring(f.form, 1, length(f.form) - length(r.con_end)) NOT LIKE '%さ')
            AND (f.depth = 0 OR f.depth + 1 <= length(f.original) + 6) AND length(f.form) <= length(f.original) + 10
            AND length(f.form) - length(r.con_end) + length(r.dec_end) > 0
    ) SELECT DISTINCT original, form, tag, process FROM forms WHERE depth > 0"""


class Deconjugator:
    """Forms of surfaces under a table of rules."""

    def __init__(self, table: Iterable[Rule]):
        self.by_end: dict[str, list[Rule]] = defaultdict(list)
        for rule in table:
            if rule.kind not in KINDS:
                raise ValueError(f"unknown kind of rule {rule.kind!r}")
            self.by_end[rule.con_end].append(rule)
        self.longest = max(map(len, self.by_end), default=0)

    def _step(self, original: str, form: Form, met: frozenset[str]) -> Iterator[tuple[Form, frozenset[str]]]:
        text, tags, process = form
        grown = len(text) > len(original) + 10 or len(tags) > len(original) + 6
        for size in range(min(self.longest, len(text)) + 1):
            head = text[: len(text) - size]
            for rule in self.by_end.get(text[len(head) :], ()):
                new = head + rule.dec_end
                details = (rule.detail, *process) if rule.detail else process
                if rule.kind == "substitution":
                    if size and new not in met:
                        yield Form(new, tags, details), met | {new}
                    continue
                wrong_class = bool(tags) and rule.con_tag not in ("uninflectable", tags[-1])
                wrong_place = {"only final": bool(tags), "never final": not tags, "never": True, "v1inftrap": tags == ("stem-ren",), "saspecial": head.endswith("さ")}.get(rule.kind, False)
                if not (grown or wrong_class or wrong_place or not new or not (rule.detail or tags)):
                    yield Form(new, (*(tags or (rule.con_tag,)), rule.dec_tag), details), met

    def forms(self, surface: str) -> list[Form]:
        """Every form that rules reach with at least one detail, in the order of the number of steps."""
        start = Form(surface, (), ())
        seen, out, now = {start}, [], [(start, frozenset([surface]))] if surface else []
        while now:
            later = []
            for form, met in now:
                for new, new_met in self._step(surface, form, met):
                    if new not in seen:
                        seen.add(new)
                        later.append((new, new_met))
            out += [f for f, _ in later if f.process]
            now = later
        return out


@lru_cache(4)
def _deconjugator(table: tuple[Rule, ...]) -> Deconjugator:
    return Deconjugator(table)


def default_deconjugator() -> Deconjugator:
    return _deconjugator(tuple(rule_rows()))


def collected_rules(table: DataFrame) -> tuple[Rule, ...]:
    """The rules of a table; one of more than MOST_RULES is refused, as every task gets them all."""
    kind = F.coalesce("kind", F.lit("")) if "kind" in table.columns else F.lit("")
    rows = table.select("con_end", "dec_end", "con_tag", "dec_tag", "detail", kind.alias("kind")).limit(MOST_RULES + 1).collect()
    if len(rows) > MOST_RULES:
        raise ValueError(f"a table of over {MOST_RULES} rules")
    return tuple(sorted(Rule(*(v or "" for v in r)) for r in rows))


def deconjugate(df: DataFrame, text: str, rule_table: DataFrame | None = None) -> DataFrame:
    """original, form, tag, process (outermost last) of every reachable form, intermediate ones too. Null or empty
    surfaces have none."""
    table = tuple(rule_rows()) if rule_table is None else collected_rules(rule_table)

    def run(batches):
        find = _deconjugator(table).forms
        for batch in batches:
            rows = dict.fromkeys((surface, f.text, f.tags[-1] if f.tags else "", "→".join(f.process)) for surface in batch.column(0).to_pylist() for f in find(surface))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], names=["original", "form", "tag", "process"])

    surfaces = df.select(F.col(text).alias("original")).where("original <> ''").distinct()
    return surfaces.mapInArrow(run, "original string, form string, tag string, process string")


def deconjugate_to_lemma(df: DataFrame, text: str, lemma: str) -> DataFrame:
    """Only the analyses that reach the given dictionary form."""
    pairs = df.select(F.col(text).alias("original"), F.col(lemma).alias("lemma"))
    return deconjugate(df, text).join(pairs, "original").where("form = lemma")


def format_process(process: Column) -> Column:
    """～inner→outer."""
    return F.concat(F.lit("～"), process)
