"""Queries as values, and their compilation into DataFrames of (key, score).

Scores: BM25 (k1 1.2, b 0.75) for term, match and phrase (a phrase's occurrences count as its frequency, its terms' idf
add up); 1.0 for all queries over fields that are not text and for those that expand over the term dictionary (term
set, fuzzy, regex). Boolean: sum of must and should. Everything is a plan over the postings; no row-wise matching.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.functions.tokenizers import Tokenizer, tokenize
from glyphmill.operators.index import B, K1, Index


class Query:
    """Modifiers that every query has."""

    def boost(self, factor: float) -> Query:
        return Boost(self, factor)

    def const(self, score: float) -> Query:
        return ConstScore(self, score)

    def __and__(self, other: Query) -> Query:
        return Boolean(must=(self, other))

    def __or__(self, other: Query) -> Query:
        return Boolean(should=(self, other))

    def __invert__(self) -> Query:
        return Boolean(must=(All(),), must_not=(self,))


@dataclass(frozen=True)
class All(Query):
    pass


@dataclass(frozen=True)
class Empty(Query):
    pass


@dataclass(frozen=True)
class Exists(Query):
    field: str


@dataclass(frozen=True)
class Term(Query):
    field: str
    value: object


@dataclass(frozen=True)
class TermSet(Query):
    """values: a tuple, or a DataFrame with one column `term` (a semi-join)."""

    field: str
    values: object


@dataclass(frozen=True)
class Match(Query):
    """Tokens of the text, any or all of them; distance > 0: fuzzy."""

    field: str
    text: str | tuple[str, ...]
    all: bool = False
    distance: int = 0
    prefix: bool = False
    tokenizer: Tokenizer | None = None


@dataclass(frozen=True)
class Fuzzy(Query):
    """Terms within an edit distance; prefix: of whose beginning; transpositions cost one if asked for."""

    field: str
    value: str
    distance: int = 2
    transposition_cost_one: bool = True
    prefix: bool = False


@dataclass(frozen=True)
class Regex(Query):
    field: str
    pattern: str


@dataclass(frozen=True)
class Phrase(Query):
    """Each slot is a term or a tuple of alternatives; slop: extra words allowed in all, in order."""

    field: str
    slots: tuple
    slop: int = 0


@dataclass(frozen=True)
class PhrasePrefix(Query):
    field: str
    terms: tuple[str, ...]
    max_expansion: int = 50


@dataclass(frozen=True)
class RegexPhrase(Query):
    field: str
    patterns: tuple[str, ...]
    slop: int = 0
    max_expansions: int = 16384


@dataclass(frozen=True)
class Range(Query):
    """Bounds of None are open; inclusive by default at both ends."""

    field: str
    lower: object = None
    upper: object = None
    lower_inclusive: bool = True
    upper_inclusive: bool = True


@dataclass(frozen=True)
class RangeTerm(Query):
    """A value inside a range-typed field (struct lower, upper, lower_inc, upper_inc; null bounds are infinite)."""

    field: str
    value: object


@dataclass(frozen=True)
class RangeRelation(Query):
    """A range-typed field that intersects, contains or is within the given range."""

    field: str
    lower: object
    upper: object
    relation: str = "intersects"
    lower_inclusive: bool = True
    upper_inclusive: bool = False


@dataclass(frozen=True)
class Compare(Query):
    """A field against a value, or against any or all of several, by an operator."""

    field: str
    operator: str
    values: tuple
    all: bool = False


@dataclass(frozen=True)
class Boolean(Query):
    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()


@dataclass(frozen=True)
class DisjunctionMax(Query):
    disjuncts: tuple[Query, ...]
    tie_breaker: float = 0.0


@dataclass(frozen=True)
class Boost(Query):
    query: Query
    factor: float


@dataclass(frozen=True)
class ConstScore(Query):
    query: Query
    score: float = 1.0


@dataclass(frozen=True)
class MoreLikeThis(Query):
    """The best terms of a document (by key), of given text, or of a given document ({field: text}, or that as JSON), by
    tf-idf within bounds; over one field, or over several, whose scores add up."""

    field: str | tuple[str, ...]
    key: object = None
    text: str | None = None
    document: str | dict[str, str] | None = None
    min_doc_frequency: int = 5
    max_doc_frequency: int | None = None
    min_term_frequency: int = 2
    max_query_terms: int = 25
    min_word_length: int = 0
    max_word_length: int | None = None
    boost_factor: float = 1.0
    stopwords: tuple[str, ...] = ()


@dataclass(frozen=True)
class WithIndex(Query):
    """A query bound to an index of its own, wherever it stands; its keys are those of the index around it."""

    index: object
    query: Query


@dataclass(frozen=True)
class Near:
    """A proximity clause: terms (alternatives), a pattern over terms, or two clauses at a distance."""

    terms: tuple[str, ...] = ()
    pattern: str | None = None
    left: Near | None = None
    right: Near | None = None
    distance: int = 0
    in_order: bool = False
    max_expansions: int = 50

    def __floordiv__(self, distance: int) -> _Left:
        """a // 3 // b: at most three words between a and b, in either order."""
        return _Left(self, distance, False)

    def __rshift__(self, distance: int) -> _Left:
        """a >> 3 >> b: the same, in this order."""
        return _Left(self, distance, True)


@dataclass(frozen=True)
class _Left:
    """The left clause of a proximity and its distance."""

    left: Near
    distance: int
    in_order: bool

    def __floordiv__(self, right: Near | str) -> Near:
        return self._with(right, False)

    def __rshift__(self, right: Near | str) -> Near:
        return self._with(right, True)

    def _with(self, right: Near | str, in_order: bool) -> Near:
        if in_order != self.in_order:
            raise ValueError("// and >> do not mix in one proximity")
        return near(self.left, self.distance, right, in_order)


def words(*terms: str) -> Near:
    """A clause of one term, or of alternatives."""
    return Near(terms=terms)


@dataclass(frozen=True)
class Proximity(Query):
    """Two clauses with at most `distance` words between them, in either order or in this one."""

    field: str
    clause: Near


def near(left: Near | str, distance: int, right: Near | str, in_order: bool = False) -> Near:
    as_clause = lambda x: Near(terms=(x,)) if isinstance(x, str) else x
    return Near(left=as_clause(left), right=as_clause(right), distance=distance, in_order=in_order)


# ------------------------------------------------------------------ compilation


def search(index: Index, query: Query) -> DataFrame:
    """(key, score) of every row that matches."""
    return _compile(index, query)


def top_k(index: Index, query: Query, k: int, offset: int = 0) -> DataFrame:
    """The best rows by score, ties by key."""
    return search(index, query).orderBy(F.desc("score"), index.key).offset(offset).limit(k)


def _postings(index: Index, field: str) -> DataFrame:
    return index.of_field(field)


def _idf(df: Column, n: int) -> Column:
    return F.log1p((F.lit(float(n)) - df + 0.5) / (df + 0.5))


def _bm25(index: Index, field: str, hits: DataFrame, idf: Column | str) -> DataFrame:
    """hits: key, tf and what idf needs."""
    n, average = index.stats(field)
    lengths = index.lengths.where(F.col("field") == field).select(index.key, "len")
    tf = F.col("tf").cast("double")
    norm = K1 * (1 - B + B * F.col("len") / F.lit(average or 1.0))
    weight = F.col(idf) if isinstance(idf, str) else idf
    return hits.join(lengths, index.key).select(index.key, (weight * tf * (K1 + 1) / (tf + norm)).alias("score"))


def _terms_any(index: Index, field: str, terms: list[str], need: int = 1) -> DataFrame:
    """BM25 summed over the given terms; need: how many of them a row must have."""
    terms = list(dict.fromkeys(terms))
    if not terms:
        return _none(index)
    hits = index.of_field(field, terms).select(index.key, "term", "tf")
    counts = hits.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))  # as many rows as the query has terms
    n, _ = index.stats(field)
    weighed = hits.join(F.broadcast(counts), "term").withColumn("idf", _idf(F.col("df"), n))
    scored = _bm25(index, field, weighed, "idf")
    grouped = scored.groupBy(index.key).agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("c"))
    return grouped.where(F.col("c") >= need).drop("c")


def _none(index: Index) -> DataFrame:
    return index.rows.select(index.key, F.lit(1.0).alias("score")).limit(0)


def _constant(keys: DataFrame, score: float = 1.0) -> DataFrame:
    return keys.withColumn("score", F.lit(float(score)))


def _where(index: Index, condition: Column) -> DataFrame:
    return _constant(index.rows.where(condition).select(index.key))


def tokens_of(index: Index, field: str, text: str | tuple[str, ...], tokenizer: Tokenizer | None = None) -> list[str]:
    """Query text goes through the field's own tokenizer, unless it comes as tokens."""
    if not isinstance(text, str):
        return list(text)
    one = index.rows.sparkSession.createDataFrame([(text,)], "text string")  # a local relation, which needs no job
    return one.select(tokenize(F.col("text"), tokenizer or index.fields[field]).alias("t")).collect()[0]["t"]


def _damerau(term: Column, value: str, distance: int) -> Column:
    """Edit distance at most `distance`, an exchange of neighbours costing one: the plain distance to a value after
    exchanges, plus their cost. What lies between two exchanged letters may be removed first, at one a letter."""
    costs, at = {value: 0}, {value}
    while at:
        found: dict[str, int] = {}
        for s in at:
            for i in range(len(s)):
                for j in range(i + 1, min(len(s), i + 1 + distance - costs[s])):
                    swapped, cost = s[:i] + s[j] + s[i] + s[j + 1 :], costs[s] + j - i
                    if cost < min(costs.get(swapped, cost + 1), found.get(swapped, cost + 1)):
                        found[swapped] = cost
        costs |= found
        at = set(found)
    return reduce(lambda a, b: a | b, [F.levenshtein(term, F.lit(s)) <= distance - cost for s, cost in sorted(costs.items())])


def _expanded(index: Index, field: str, condition: Column, limit: int | None = None) -> DataFrame:
    """Terms of the dictionary that meet a condition."""
    found = index.terms(field).where(condition).select("term")
    return found.orderBy("term").limit(limit) if limit else found


def _fuzzy_condition(q: Fuzzy) -> Column:
    term = F.col("term")
    if q.prefix:
        cuts = [F.substring(term, 1, n) for n in range(max(1, len(q.value) - q.distance), len(q.value) + q.distance + 1)]
        tests = [_damerau(c, q.value, q.distance) if q.transposition_cost_one else F.levenshtein(c, F.lit(q.value)) <= q.distance for c in cuts]
        return reduce(lambda a, b: a | b, tests)
    return _damerau(term, q.value, q.distance) if q.transposition_cost_one else F.levenshtein(term, F.lit(q.value)) <= q.distance


def _holding(index: Index, field: str, terms: DataFrame) -> DataFrame:
    return _constant(_postings(index, field).join(terms, "term", "left_semi").select(index.key).distinct())


def _slot(index: Index, field: str, slot, k: int) -> DataFrame:
    """key and the positions of one phrase slot; slot: a term, alternatives, or a DataFrame of terms."""
    if isinstance(slot, DataFrame):
        base = _postings(index, field).join(slot, "term", "left_semi")
    else:
        base = index.of_field(field, [slot] if isinstance(slot, str) else list(slot))
    if isinstance(slot, str):
        return base.select(index.key, F.col("positions").alias(f"p{k}"))
    return base.groupBy(index.key).agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias(f"p{k}"))


def _phrase_frequency(slots: int, slop: int) -> Column:
    """How many occurrences: starts from which each slot follows in order, with at most slop words between in all."""
    if slop == 0:
        follows = lambda p: reduce(lambda a, k: a & F.array_contains(f"p{k}", p + k), range(1, slots), F.lit(True))
        return F.size(F.filter("p0", follows))

    def following(k: int, at: Column) -> Column:
        return F.array_min(F.filter(f"p{k}", lambda x: x > at))

    # the nearest following position of each slot in turn is the tightest fit from a start
    def reach(p: Column) -> Column:
        return reduce(lambda at, k: following(k, at), range(1, slots), p)

    return F.size(F.filter("p0", lambda p: (reach(p) - p - (slots - 1)) <= slop))


def _phrase(index: Index, field: str, slots: list, slop: int, idf_terms: list[str] | None) -> DataFrame:
    if not slots:
        return _none(index)
    joined = reduce(lambda a, b: a.join(b, index.key), [_slot(index, field, s, k) for k, s in enumerate(slots)])
    hits = joined.select(index.key, _phrase_frequency(len(slots), slop).cast("long").alias("tf")).where("tf > 0")
    if idf_terms is None:
        return _constant(hits.select(index.key))
    n, _ = index.stats(field)
    counts = index.of_field(field, idf_terms).groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))
    total = counts.agg(F.sum(_idf(F.col("df"), n)).alias("idf"))  # one row
    return _bm25(index, field, hits.crossJoin(F.broadcast(total)), "idf")


def _near(index: Index, field: str, c: Near) -> DataFrame:
    """key, first, last: spans of a clause."""
    if c.left is not None:
        a = _near(index, field, c.left)
        b = _near(index, field, c.right).select(index.key, F.col("first").alias("f2"), F.col("last").alias("l2"))
        ordered = (F.col("f2") > F.col("last")) & (F.col("f2") - F.col("last") - 1 <= c.distance)
        either = ordered | ((F.col("first") > F.col("l2")) & (F.col("first") - F.col("l2") - 1 <= c.distance))
        found = a.join(b, index.key).where(ordered if c.in_order else either)
        return found.select(index.key, F.least("first", "f2").alias("first"), F.greatest("last", "l2").alias("last")).distinct()
    base = _postings(index, field)
    if c.pattern is not None:
        base = base.join(_expanded(index, field, F.col("term").rlike(f"^(?:{c.pattern})$"), c.max_expansions), "term", "left_semi")
    else:
        base = index.of_field(field, list(c.terms))
    spans = base.select(index.key, F.explode("positions").alias("first"))
    return spans.withColumn("last", F.col("first"))


def _compare(column: Column, operator: str, value: object) -> Column:
    tests = {"=": column == value, "<>": column != value, "!=": column != value, "<": column < value, "<=": column <= value, ">": column > value, ">=": column >= value}
    return tests[operator]


def _range_bounds(q: RangeRelation) -> Column:
    f = F.col(q.field)
    low, high = F.lit(q.lower), F.lit(q.upper)
    starts_before_end = f["lower"].isNull() | high.isNull() | (f["lower"] < high) | ((f["lower"] == high) & f["lower_inc"] & F.lit(q.upper_inclusive))
    ends_after_start = f["upper"].isNull() | low.isNull() | (f["upper"] > low) | ((f["upper"] == low) & f["upper_inc"] & F.lit(q.lower_inclusive))
    if q.relation == "intersects":
        return starts_before_end & ends_after_start
    inner_low = f["lower"].isNull() | (low.isNotNull() & ((f["lower"] < low) | ((f["lower"] == low) & (f["lower_inc"] | F.lit(not q.lower_inclusive)))))
    inner_high = f["upper"].isNull() | (high.isNotNull() & ((f["upper"] > high) | ((f["upper"] == high) & (f["upper_inc"] | F.lit(not q.upper_inclusive)))))
    if q.relation == "contains":  # the field holds the whole range
        return inner_low & inner_high
    outer_low = low.isNull() | (f["lower"].isNotNull() & ((f["lower"] > low) | ((f["lower"] == low) & (F.lit(q.lower_inclusive) | ~f["lower_inc"]))))
    outer_high = high.isNull() | (f["upper"].isNotNull() & ((f["upper"] < high) | ((f["upper"] == high) & (F.lit(q.upper_inclusive) | ~f["upper_inc"]))))
    return outer_low & outer_high  # within


def best_terms(index: Index, q: MoreLikeThis) -> DataFrame:
    """term, weight: the seed's terms by tf-idf, within the bounds."""
    n, _ = index.stats(q.field)
    if q.text is not None:
        seed = index.rows.sparkSession.range(1).select(F.explode(tokenize(F.lit(q.text), index.fields[q.field])).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("tf"))
    else:
        seed = _postings(index, q.field).where(F.col(index.key) == q.key).select("term", "tf")
    size = F.char_length("term")
    seed = seed.where((F.col("tf") >= q.min_term_frequency) & (size >= q.min_word_length) & (size <= (q.max_word_length or 2**31 - 1)))
    if q.stopwords:
        seed = seed.where(~F.col("term").isin(list(q.stopwords)))
    counted = seed.join(index.terms(q.field), "term").where((F.col("df") >= q.min_doc_frequency) & (F.col("df") <= (q.max_doc_frequency or 2**62)))
    return counted.withColumn("weight", F.col("tf") * _idf(F.col("df").cast("double"), n)).orderBy(F.desc("weight"), "term").limit(q.max_query_terms)


def _like_document(index: Index, q: MoreLikeThis) -> DataFrame:
    """More like this over each of several fields, or those that a document gives."""
    given = json.loads(q.document) if isinstance(q.document, str) else q.document
    names = [q.field] if isinstance(q.field, str) else list(q.field)
    if given is not None:
        names = [n for n in names if given.get(n)]
    each = [_compile(index, replace(q, field=n, document=None, text=given[n] if given is not None else q.text)) for n in names]
    if not each:
        return _none(index)
    return reduce(DataFrame.unionByName, each).groupBy(index.key).agg(F.sum("score").alias("score"))


def bm25(index: Index, query: Query) -> DataFrame:
    """(key, rank) of every match, the rank being the negated score: the best come first in ascending order."""
    return search(index, query).select(index.key, (-F.col("score")).alias("rank"))


def _compile(index: Index, q: Query) -> DataFrame:
    key = index.key
    match q:
        case All():
            return _constant(index.rows.select(key))
        case Empty():
            return _none(index)
        case Exists(field):
            return _where(index, F.col(field).isNotNull())
        case Term(field, value):
            return _terms_any(index, field, [value]) if field in index.fields else _where(index, F.col(field) == value)
        case TermSet(field, values):
            if isinstance(values, DataFrame):
                if field in index.fields:
                    return _holding(index, field, values.select("term"))
                return _constant(index.rows.join(values.select(F.col("term").alias(field)).distinct(), field, "left_semi").select(key))
            if field in index.fields:
                return _constant(index.of_field(field, list(values)).select(key).distinct())
            return _where(index, F.col(field).isin(list(values)))
        case Match(field, text, all_, distance, prefix, tokenizer):
            terms = tokens_of(index, field, text, tokenizer)
            if distance or prefix:
                each = tuple(Fuzzy(field, t, distance, True, prefix) for t in dict.fromkeys(terms))
                return _compile(index, Boolean(must=each) if all_ else Boolean(should=each))
            return _terms_any(index, field, terms, len(set(terms)) if all_ else 1)
        case Fuzzy(field):
            return _holding(index, field, _expanded(index, field, _fuzzy_condition(q)))
        case Regex(field, pattern):
            return _holding(index, field, _expanded(index, field, F.col("term").rlike(f"^(?:{pattern})$")))
        case Phrase(field, slots, slop):
            named = [s for slot in slots for s in ([slot] if isinstance(slot, str) else slot)]
            return _phrase(index, field, list(slots), slop, named)
        case PhrasePrefix(field, terms, most):
            last = _expanded(index, field, F.col("term").startswith(terms[-1]), most)
            return _phrase(index, field, [*terms[:-1], last], 0, None)
        case RegexPhrase(field, patterns, slop, most):
            slots = [_expanded(index, field, F.col("term").rlike(f"^(?:{p})$"), most) for p in patterns]
            return _phrase(index, field, slots, slop, None)
        case Range(field, lower, upper, low_in, up_in):
            f, tests = F.col(field), [F.col(field).isNotNull()]
            if lower is not None:
                tests.append(f >= lower if low_in else f > lower)
            if upper is not None:
                tests.append(f <= upper if up_in else f < upper)
            return _where(index, reduce(lambda a, b: a & b, tests))
        case RangeTerm(field, value):
            f, v = F.col(field), F.lit(value)
            above = f["lower"].isNull() | (f["lower"] < v) | ((f["lower"] == v) & f["lower_inc"])
            return _where(index, f.isNotNull() & above & (f["upper"].isNull() | (f["upper"] > v) | ((f["upper"] == v) & f["upper_inc"])))
        case RangeRelation(field):
            return _where(index, F.col(field).isNotNull() & _range_bounds(q))
        case Compare(field, operator, values, all_):
            tests = [_compare(F.col(field), operator, v) for v in values]
            return _where(index, reduce((lambda a, b: a & b) if all_ else (lambda a, b: a | b), tests))
        case Boolean(must, should, must_not):
            return _boolean(index, must, should, must_not)
        case DisjunctionMax(disjuncts, tie):
            every = reduce(DataFrame.unionByName, [_compile(index, d) for d in disjuncts])
            return every.groupBy(key).agg((F.max("score") + tie * (F.sum("score") - F.max("score"))).alias("score"))
        case Boost(query, factor):
            return _compile(index, query).select(key, (F.col("score") * F.lit(float(factor))).alias("score"))
        case ConstScore(query, score):
            return _constant(_compile(index, query).select(key), score)
        case WithIndex(own, query):
            return _compile(own, query).select(F.col(own.key).alias(key), "score")
        case MoreLikeThis(field) if not isinstance(field, str) or q.document is not None:
            return _like_document(index, q)
        case MoreLikeThis(field):
            terms = [r["term"] for r in best_terms(index, q).collect()]  # at most max_query_terms
            found = _terms_any(index, field, terms).select(key, (F.col("score") * F.lit(float(q.boost_factor))).alias("score"))
            return found if q.key is None else found.where(F.col(key) != q.key)
        case Proximity(field, clause):
            return _constant(_near(index, field, clause).select(key).distinct())
    raise TypeError(f"not a query: {q!r}")


def _boolean(index: Index, must, should, must_not) -> DataFrame:
    """One aggregation over the scored sides: a row needs every must (or, without any, one should)."""
    key = index.key
    sides = [_compile(index, m).select(key, "score", F.lit(1).alias("m"), F.lit(0).alias("s")) for m in must]
    sides += [_compile(index, s).select(key, "score", F.lit(0).alias("m"), F.lit(1).alias("s")) for s in should]
    if not sides:
        return _none(index)
    counted = reduce(DataFrame.unionByName, sides).groupBy(key).agg(F.sum("score").alias("score"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    out = counted.where(F.col("m") == len(must) if must else F.col("s") > 0).select(key, "score")
    for n in must_not:
        out = out.join(_compile(index, n).select(key), key, "left_anti")
    return out
