"""Full-text queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glyphmill.functions.tokenizers import Tokenizer
from glyphmill.operators import aggregate as agg
from glyphmill.operators import query as q
from glyphmill.operators.index import build_index, load, stored
from glyphmill.operators.parser import parse
from glyphmill.operators.snippets import snippet_positions
from glyphmill.session import shared_folder, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

_SPLIT = "list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '' AND length(x) <= 255)"


def _base(source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""arr AS (SELECT {key} AS k, {_SPLIT.format(text=text)} AS t FROM {source}),
    tok AS (SELECT k, unnest(range(len(t))) AS p, unnest(t) AS term FROM arr),
    post AS (SELECT k, term, count(*)::DOUBLE AS tf, list(p ORDER BY p) AS positions FROM tok GROUP BY ALL),
    lens AS (SELECT k, len(t)::DOUBLE AS len FROM arr),
    stats AS (SELECT count(*)::DOUBLE AS n, avg(len) AS a FROM lens),
    terms AS (SELECT term, count(*)::DOUBLE AS df FROM post GROUP BY term)"""


_WEIGHT = "idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / a))"
_IDF = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"


def _any(terms: list[str], need: int = 1) -> str:
    """k, score of rows that have `need` of the terms."""
    names = ", ".join(f"'{t}'" for t in terms)
    return f"""SELECT k, sum(w) AS score FROM (SELECT k, {_WEIGHT} AS w FROM (SELECT k, tf, {_IDF} AS idf, a FROM post JOIN terms USING (term), stats WHERE term IN ({names})) JOIN lens USING (k))
    GROUP BY k HAVING count(*) >= {need}"""


def _docs(spark, sf_dir):
    """The documents' index, built and stored once for all queries of an application."""
    return stored(table(spark, sf_dir, "documents"), "doc_id", {"text": Tokenizer()}, shared_folder(spark))


def _parts(spark, sf_dir):
    return stored(table(spark, sf_dir, "part"), "p_partkey", {"p_name": Tokenizer(), "p_type": Tokenizer()}, shared_folder(spark))


def _register(name: str, query, sql: str, index=_docs, k: int | None = None) -> None:
    """Scores are rounded to six decimals on both sides."""

    def run(spark, sf_dir):
        ix = index(spark, sf_dir)
        asked = query(ix) if callable(query) else query
        found = q.top_k(ix, asked, k) if k else q.search(ix, asked)
        return found.select(F.col(ix.key).alias("k"), F.round("score", 6).alias("score"))

    QUERIES[name] = run
    source = "documents" if index is _docs else "part"
    base = _base() if index is _docs else _base("part", "p_partkey", "p_name")
    limit = f"ORDER BY score DESC, k LIMIT {k}" if k else ""
    ORACLES[name] = f"WITH {base.replace('documents', source)} SELECT k, round(score, 6) AS score FROM ({sql}) {limit}"


_one = "SELECT k, 1.0::DOUBLE AS score FROM"
_register("search_bm25_topk", q.Match("text", "the thing of"), _any(["the", "thing", "of"]), k=10)
_register("search_term", q.Term("text", "thing"), _any(["thing"]))
_register("search_match_any", q.Match("text", "thing nder le"), _any(["thing", "nder", "le"]))
_register("search_match_all", q.Match("text", "the and of", all=True), _any(["the", "and", "of"], 3))
_register("search_all", q.All(), f"{_one} lens")
_register("search_empty", q.Empty(), f"{_one} lens WHERE false")
_register("search_exists", q.Exists("text"), f"{_one} lens")
_register("search_term_typed", q.Term("lang", "de"), "SELECT doc_id AS k, 1.0::DOUBLE AS score FROM documents WHERE lang = 'de'")
_register("search_term_set", q.TermSet("text", ("thing", "nder", "und")), "SELECT DISTINCT k, 1.0::DOUBLE AS score FROM post WHERE term IN ('thing', 'nder', 'und')")
_register("search_term_set_numbers", q.TermSet("doc_id", (3, 5, 8, 9999999)), "SELECT doc_id AS k, 1.0::DOUBLE AS score FROM documents WHERE doc_id IN (3, 5, 8, 9999999)")
_register("search_boost", q.Match("text", "thing").boost(2.5), f"SELECT k, 2.5::DOUBLE * score AS score FROM ({_any(['thing'])})")
_register("search_const_score", q.Match("text", "thing").const(3.0), f"SELECT k, 3.0::DOUBLE AS score FROM ({_any(['thing'])})")
_register(
    "search_boolean",
    q.Boolean(must=(q.Term("text", "the"),), should=(q.Term("text", "thing"),), must_not=(q.Term("text", "nder"), q.Term("lang", "fr"))),
    f"""SELECT m.k, m.score + coalesce(s.score, 0) AS score FROM ({_any(["the"])}) m LEFT JOIN ({_any(["thing"])}) s USING (k)
    WHERE m.k NOT IN (SELECT k FROM post WHERE term = 'nder') AND m.k NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')""",
)
_register("search_boolean_should", q.Term("text", "le") | q.Term("text", "und"), f"SELECT k, sum(score) AS score FROM ({_any(['le'])} UNION ALL {_any(['und'])}) GROUP BY k")
_register("search_not", ~q.Term("text", "the"), f"{_one} lens WHERE k NOT IN (SELECT k FROM post WHERE term = 'the')")
_register(
    "search_dismax",
    q.DisjunctionMax((q.Term("text", "the"), q.Term("text", "thing")), 0.3),
    f"SELECT k, max(score) + 0.3::DOUBLE * (sum(score) - max(score)) AS score FROM ({_any(['the'])} UNION ALL {_any(['thing'])}) GROUP BY k",
)
_register("search_regex", q.Regex("text", "th[aeiou]+ng"), f"{_one} (SELECT DISTINCT k FROM post WHERE regexp_full_match(term, 'th[aeiou]+ng'))")
_register("search_fuzzy", q.Fuzzy("text", "thing", 1, False), f"{_one} (SELECT DISTINCT k FROM post WHERE levenshtein(term, 'thing') <= 1)")
_register("search_fuzzy_transposed", q.Fuzzy("text", "thign", 1), f"{_one} (SELECT DISTINCT k FROM post WHERE damerau_levenshtein(term, 'thign') <= 1)")
_register("search_fuzzy_transposed_two", q.Fuzzy("text", "htign", 2), f"{_one} (SELECT DISTINCT k FROM post WHERE damerau_levenshtein(regexp_replace(term, '[^a-z0-9]', '#', 'g'), 'htign') <= 2)")  # DuckDB counts bytes: a letter that the value lacks becomes one byte
_register("search_fuzzy_prefix", q.Fuzzy("text", "thin", 1, False, True), f"{_one} (SELECT DISTINCT k FROM post WHERE levenshtein(term[:3], 'thin') <= 1 OR levenshtein(term[:4], 'thin') <= 1 OR levenshtein(term[:5], 'thin') <= 1)")
_register("search_match_fuzzy", q.Match("text", "thing nder", all=True, distance=1), f"SELECT k, 2.0::DOUBLE AS score FROM (SELECT DISTINCT k FROM post WHERE damerau_levenshtein(term, 'thing') <= 1 INTERSECT SELECT DISTINCT k FROM post WHERE damerau_levenshtein(term, 'nder') <= 1)")


def _phrase_sql(terms: list[str], test: str) -> str:
    """Phrases by self-joins over positions; test: a condition over p0, p1, ..."""
    froms = " JOIN ".join(f"(SELECT k, p AS p{i} FROM tok WHERE term = '{t}') t{i}" + (" USING (k)" if i else "") for i, t in enumerate(terms))
    names = ", ".join(f"'{t}'" for t in terms)
    return f"""SELECT k, {_WEIGHT} AS score FROM (SELECT k, count(DISTINCT p0)::DOUBLE AS tf FROM {froms} WHERE {test} GROUP BY k) JOIN lens USING (k), stats,
    (SELECT sum({_IDF}) AS idf FROM terms, stats WHERE term IN ({names}))"""


_register("search_phrase", q.Phrase("text", ("in", "the")), _phrase_sql(["in", "the"], "p1 = p0 + 1"))
_register("search_phrase_three", q.Phrase("text", ("of", "the", "and")), _phrase_sql(["of", "the", "and"], "p1 = p0 + 1 AND p2 = p0 + 2"))
_register("search_phrase_slop", q.Phrase("text", ("the", "thing"), 2), _phrase_sql(["the", "thing"], "p1 > p0 AND p1 - p0 - 1 <= 2"))
_register(
    "search_phrase_prefix",
    q.PhrasePrefix("text", ("the", "thi"), 20),
    f"""{_one} (SELECT DISTINCT a.k FROM tok a JOIN tok b ON a.k = b.k AND b.p = a.p + 1 WHERE a.term = 'the'
    AND b.term IN (SELECT term FROM terms WHERE prefix(term, 'thi') ORDER BY term LIMIT 20))""",
)
_register(
    "search_regex_phrase",
    q.RegexPhrase("text", ("th.", "th.*ng")),
    f"{_one} (SELECT DISTINCT a.k FROM tok a JOIN tok b ON a.k = b.k AND b.p = a.p + 1 WHERE regexp_full_match(a.term, 'th.') AND regexp_full_match(b.term, 'th.*ng'))",
)
_near_sql = f"{_one} (SELECT DISTINCT a.k FROM tok a JOIN tok b ON a.k = b.k WHERE a.term = 'the' AND b.term = 'thing' AND {{test}})"
_register("search_proximity", q.Proximity("text", q.near("the", 3, "thing")), _near_sql.format(test="a.p <> b.p AND abs(b.p - a.p) - 1 <= 3"))
_register("search_proximity_in_order", q.Proximity("text", q.near("the", 3, "thing", True)), _near_sql.format(test="b.p > a.p AND b.p - a.p - 1 <= 3"))
_register(
    "search_proximity_clauses",
    q.Proximity("text", q.near(q.near("in", 1, "the"), 4, q.Near(pattern="thin.*"))),
    f"""{_one} (SELECT DISTINCT s.k FROM (SELECT a.k, least(a.p, b.p) AS f, greatest(a.p, b.p) AS l FROM tok a JOIN tok b ON a.k = b.k WHERE a.term = 'in' AND b.term = 'the' AND a.p <> b.p AND abs(a.p - b.p) - 1 <= 1) s
    JOIN tok c ON s.k = c.k WHERE c.term IN (SELECT term FROM terms WHERE regexp_full_match(term, 'thin.*') ORDER BY term LIMIT 50)
    AND ((c.p > s.l AND c.p - s.l - 1 <= 4) OR (s.f > c.p AND s.f - c.p - 1 <= 4)))""",
)
_register("search_proximity_operators", q.Proximity("text", q.words("the") // 3 // q.words("thing")), _near_sql.format(test="a.p <> b.p AND abs(b.p - a.p) - 1 <= 3"))
_register("search_proximity_operators_in_order", q.Proximity("text", q.words("the", "the") >> 3 >> "thing"), _near_sql.format(test="b.p > a.p AND b.p - a.p - 1 <= 3"))
_register("search_range", q.Range("n_chars", 500, 900, True, False), "SELECT doc_id AS k, 1.0::DOUBLE AS score FROM documents WHERE n_chars >= 500 AND n_chars < 900")
_register("search_compare_any", q.Compare("lang", "=", ("fr", "es")), "SELECT doc_id AS k, 1.0::DOUBLE AS score FROM documents WHERE lang IN ('fr', 'es')")
_register("search_compare_all", q.Compare("n_chars", ">", (100, 2000), True), "SELECT doc_id AS k, 1.0::DOUBLE AS score FROM documents WHERE n_chars > 2000")
_register(
    "search_more_like_this",
    q.MoreLikeThis("text", 1, min_doc_frequency=2, min_term_frequency=1, max_query_terms=8),
    f"""SELECT k, sum(w) AS score FROM (SELECT k, {_WEIGHT} AS w FROM (SELECT k, tf, {_IDF} AS idf, a FROM post JOIN terms USING (term), stats WHERE term IN
    (SELECT term FROM (SELECT term, tf * {_IDF} AS weight FROM post JOIN terms USING (term), stats WHERE k = 1 AND df >= 2 ORDER BY weight DESC, term LIMIT 8))) JOIN lens USING (k)) WHERE k <> 1 GROUP BY k""",
)
_register(
    "search_parse",
    lambda ix: parse(ix, 'text:thing AND (text:the OR text:und) AND NOT lang:fr'),
    f"""SELECT a.k, a.score + b.score AS score FROM ({_any(['thing'])}) a JOIN (SELECT k, sum(score) AS score FROM ({_any(['the'])} UNION ALL {_any(['und'])}) GROUP BY k) b USING (k)
    JOIN (SELECT doc_id AS k FROM documents WHERE lang <> 'fr') c USING (k)""".replace("a.score + b.score AS", "a.score + b.score + 1.0 AS"),
)
_register("search_parse_range", lambda ix: parse(ix, "n_chars:[500 TO 900}"), "SELECT doc_id AS k, 1.0::DOUBLE AS score FROM documents WHERE n_chars >= 500 AND n_chars < 900")
_register("search_parse_phrase", lambda ix: parse(ix, '"the thing"~2^2', "text"), f"SELECT k, 2.0::DOUBLE * score AS score FROM ({_phrase_sql(['the', 'thing'], 'p1 > p0 AND p1 - p0 - 1 <= 2')})")
_register("search_parse_lenient", lambda ix: parse(ix, 'thing ("nder', "text", lenient=True), _any(["thing", "nder"]))


def _term_set_join(spark, sf_dir):
    """A term set made from rows: documents that hold any word of the first benchmark items' vocabulary of long words."""
    from glyphmill.functions.tokenizers import tokenize

    words = table(spark, sf_dir, "benchmark").select(F.explode(tokenize(F.col("text"))).alias("term")).where("char_length(term) >= 9").distinct()
    return q.search(_docs(spark, sf_dir), q.TermSet("text", words)).select(F.col("doc_id").alias("k"), "score")


QUERIES["search_term_set_rows"] = _term_set_join
ORACLES["search_term_set_rows"] = f"WITH {_base()} SELECT DISTINCT k, 1.0::DOUBLE AS score FROM post WHERE term IN (SELECT unnest({_SPLIT.format(text='text')}) FROM benchmark) AND length(term) >= 9"

_RANGES = """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS lower, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice + 1000 END AS upper,
    o_orderkey % 2 = 0 AS lower_inc, o_orderkey % 3 = 0 AS upper_inc FROM orders"""


def _ranges(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("glyphmill_orders")
    rows = spark.sql(_RANGES.replace("FROM orders", "FROM glyphmill_orders"))
    rows = rows.select("id", F.struct("lower", "upper", "lower_inc", "upper_inc").alias("span"), F.lit("x").alias("note"))
    return build_index(rows, "id", {"note": Tokenizer("literal")})


def _range_query(name: str, query: q.Query, test: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: q.search(_ranges(spark, sf_dir), query).select("id")
    ORACLES[name] = f"SELECT id FROM ({_RANGES}) WHERE {test}"


_range_query("range_term", q.RangeTerm("span", 100000.0), "(lower IS NULL OR lower < 100000 OR (lower = 100000 AND lower_inc)) AND (upper IS NULL OR upper > 100000 OR (upper = 100000 AND upper_inc))")
_range_query("range_intersects", q.RangeRelation("span", 50000.0, 60000.0, "intersects"), "(lower IS NULL OR lower < 60000) AND (upper IS NULL OR upper > 50000 OR (upper = 50000 AND upper_inc))")
_range_query("range_contains", q.RangeRelation("span", 50100.0, 50200.0, "contains"), "(lower IS NULL OR lower < 50100 OR (lower = 50100 AND lower_inc)) AND (upper IS NULL OR upper >= 50200)")
_range_query("range_within", q.RangeRelation("span", 50000.0, 90000.0, "within"), "lower >= 50000 AND (upper < 90000 OR (upper = 90000 AND NOT upper_inc))")


# ---------------------------------------------------------------- aggregations


def _agg(name: str, source: str, spec: dict, part: str, sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: agg.aggregate(table(spark, sf_dir, source), spec)[part]
    ORACLES[name] = sql


_agg("agg_terms", "documents", {"langs": {"terms": {"field": "lang", "size": 3}}}, "langs", "SELECT lang AS langs, count(*) AS doc_count FROM documents GROUP BY lang ORDER BY doc_count DESC, langs LIMIT 3")
_agg("agg_histogram", "documents", {"h": {"histogram": {"field": "n_chars", "interval": 500}}}, "h", "SELECT floor(n_chars / 500.0::DOUBLE) * 500 AS h, count(*) AS doc_count FROM documents GROUP BY 1")
_agg("agg_date_histogram", "events", {"d": {"date_histogram": {"field": "ts", "calendar_interval": "day"}, "aggs": {"v": {"sum": {"field": "user_id"}}}}}, "d", "SELECT date_trunc('day', ts)::TIMESTAMP AS d, count(*) AS doc_count, sum(user_id)::BIGINT AS v FROM events GROUP BY 1")
_agg(
    "agg_range", "documents", {"r": {"range": {"field": "n_chars", "ranges": [{"to": 500}, {"from": 500, "to": 2000}, {"from": 2000}]}}}, "r",
    "SELECT CASE WHEN n_chars < 500 THEN '*-500' WHEN n_chars < 2000 THEN '500-2000' ELSE '2000-*' END AS r, count(*) AS doc_count FROM documents GROUP BY 1",
)
_agg(
    "agg_nested", "documents", {"l": {"terms": {"field": "lang"}, "aggs": {"s": {"terms": {"field": "source", "size": 2}}, "m": {"max": {"field": "n_chars"}}}}}, "l",
    """SELECT l, a.doc_count, m, s, s_doc_count FROM (SELECT lang AS l, count(*) AS doc_count, max(n_chars) AS m FROM documents GROUP BY 1) a
    LEFT JOIN (SELECT lang AS l, source AS s, count(*) AS s_doc_count FROM documents GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, source) <= 2) USING (l)""",
)


def _metrics(spark, sf_dir):
    found = agg.aggregate(table(spark, sf_dir, "lineitem"), {"m": {"terms": {"field": "l_returnflag"}, "aggs": {"q": {"stats": {"field": "l_linenumber"}}, "c": {"cardinality": {"field": "l_suppkey"}}, "p": {"percentiles": {"field": "l_linenumber", "percents": [50]}}}}})["m"]
    return found.withColumn("q_avg", F.round("q_avg", 6))


QUERIES["agg_metrics"] = _metrics
ORACLES["agg_metrics"] = """SELECT l_returnflag AS m, count(*) AS doc_count, count(l_linenumber) AS q_count, min(l_linenumber) AS q_min, max(l_linenumber) AS q_max, round(avg(l_linenumber), 6) AS q_avg,
    sum(l_linenumber)::BIGINT AS q_sum, count(DISTINCT l_suppkey) AS c, quantile_cont(l_linenumber, 0.5)::DOUBLE AS p_50 FROM lineitem GROUP BY 1"""


def _facet(spark, sf_dir):
    ix = _docs(spark, sf_dir)
    found = q.search(ix, q.Match("text", "thing")).select(F.col("doc_id").alias("k"), F.round("score", 6).alias("score"))
    return agg.facet_top_k(found, [F.desc("score"), "k"], 5)


QUERIES["facet_total"] = _facet
ORACLES["facet_total"] = f"WITH {_base()}, m AS (SELECT k, round(score, 6) AS score FROM ({_any(['thing'])})) SELECT k, score, (SELECT count(*) FROM m) AS total FROM m ORDER BY score DESC, k LIMIT 5"


QUERIES["index_terms"] = lambda spark, sf_dir: _docs(spark, sf_dir).terms("text")
ORACLES["index_terms"] = f"WITH {_base()} SELECT term, df::BIGINT AS df FROM terms"


def _index_files(spark, sf_dir):
    """The figures of the index's files add up to the postings."""
    found = _docs(spark, sf_dir).files()
    return found.groupBy("field").agg(F.sum("postings").alias("postings"), F.sum("tokens").alias("tokens"), F.sum("terms").alias("terms"), (F.min("terms") > 0).alias("none_empty"))


QUERIES["index_files"] = _index_files
ORACLES["index_files"] = f"WITH {_base()} SELECT 'text' AS field, count(*) AS postings, sum(tf)::BIGINT AS tokens, count(DISTINCT term) AS terms, true AS none_empty FROM post"


def _index_info(spark, sf_dir):
    return _docs(spark, sf_dir).info()


QUERIES["index_info"] = _index_info
ORACLES["index_info"] = f"WITH {_base()} SELECT 'text' AS field, count(DISTINCT term) AS terms, count(*) AS postings, sum(tf)::BIGINT AS tokens, (SELECT count(*) FROM lens) AS documents FROM post"


def _snippet_positions(spark, sf_dir):
    docs = table(spark, sf_dir, "benchmark")
    return docs.select("item_id", F.size(snippet_positions(F.col("text"), ["the", "thing"])).cast("long").alias("hits"))


QUERIES["snippet_positions"] = _snippet_positions
ORACLES["snippet_positions"] = f"SELECT item_id, len(list_filter({_SPLIT.format(text='text')}, lambda x: x IN ('the', 'thing')))::BIGINT AS hits FROM benchmark"
_register("search_part_phrase", q.Match("p_name", "the lace red"), _any(["the", "lace", "red"]), index=_parts)


# ---------------------------------------------------------------- sources, snippets and streams (rows only, or computed twice)


def _test_table(spark, sf_dir):
    from glyphmill.sources.fixtures import test_table

    return test_table(spark, "items", 30).groupBy("rating").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_stock").alias("in_stock"))


QUERIES["source_test_table"] = _test_table
ORACLES["source_test_table"] = "SELECT (i % 5 + 1)::INT AS rating, count(*) AS n, count_if(i % 3 = 0)::BIGINT AS in_stock FROM range(1, 31) t(i) GROUP BY 1"


def _snippet(spark, sf_dir):
    from glyphmill.operators.snippets import highlight

    rows = table(spark, sf_dir, "benchmark").select("item_id", highlight(F.col("text"), ["the", "thing"]).alias("marked"))
    return rows.select("item_id", ((F.char_length("marked") - F.char_length(F.regexp_replace("marked", "<b>", ""))) / 3).cast("long").alias("tags"))


QUERIES["snippet_highlight"] = _snippet
ORACLES["snippet_highlight"] = f"SELECT item_id, len(list_filter({_SPLIT.format(text='text')}, lambda x: x IN ('the', 'thing')))::BIGINT AS tags FROM benchmark"


def _snippet_documents(name: str, made, sql: str) -> None:
    """Snippets of the texts that are searched."""
    QUERIES[name] = lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", *made(F.col("text")))
    ORACLES[name] = f"SELECT doc_id, {sql} FROM documents"


def _window_columns(text):
    from glyphmill.operators.snippets import snippet, snippets, token_snippet

    found = snippets(text, ["thing", "the"], max_chars=60, limit=2**30)
    best, around = snippet(text, ["thing", "the"]), token_snippet(text, ["the"], "[", "]", "...", 8)
    return best.isNotNull().alias("best"), F.coalesce(F.size(found), F.lit(0)).cast("long").alias("windows"), around.isNotNull().alias("around")


def _tag_column(text):
    from glyphmill.operators.snippets import highlight

    plain = F.regexp_replace(text, "<b>", "")
    marked = highlight(plain, ["the", "thing"])
    return [((F.char_length(marked) - F.char_length(F.regexp_replace(marked, "<b>", ""))) / 3).cast("long").alias("tags")]


_PLAIN = "replace(text, '<b>', '')"
_HITS = f"len(list_filter({_SPLIT.format(text='text')}, lambda x: x IN ('the', 'thing')))::BIGINT"
_CLEAN = "list_transform(regexp_split_to_array(text, '\\s+'), lambda x: lower(regexp_replace(x, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')))"
_snippet_documents("snippet_positions_documents", lambda text: [F.size(snippet_positions(text, ["the", "thing"])).cast("long").alias("hits")], f"{_HITS} AS hits")
_snippet_documents("snippet_highlight_documents", _tag_column, f"{_HITS.replace('lower(text)', 'lower(' + _PLAIN + ')')} AS tags")
_snippet_documents(
    "snippets_documents",
    _window_columns,
    f"""list_has_any({_CLEAN}, ['thing', 'the']) AS best, list_contains({_CLEAN}, 'the') AS around,
    len(list_distinct(list_filter(list_transform({_CLEAN}, lambda x, i: CASE WHEN x IN ('thing', 'the') THEN (i - 1) // 7 END), lambda w: w IS NOT NULL)))::BIGINT AS windows""",
)


def _stream(spark, sf_dir):
    """Windowed counts of event types, run as a stream to its end."""
    import uuid

    from glyphmill.streaming.text import windowed_term_counts

    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    counts = windowed_term_counts(stream, "ts", "event_type", "1 day", "30 days", Tokenizer("literal")).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "token", "n")
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch, number: int) -> None:  # what a batch changed; a batch that is retried writes its folder again
        batch.write.mode("overwrite").parquet(f"{folder}/counts/batch={number}")

    query = counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    changed = spark.read.parquet(f"{folder}/counts")
    return changed.groupBy("day", "token").agg(F.max_by("n", "batch").alias("n"))


QUERIES["stream_windowed_counts"] = _stream
ORACLES["stream_windowed_counts"] = "SELECT date_trunc('day', ts)::TIMESTAMP AS day, lower(event_type) AS token, count(*) AS n FROM events GROUP BY ALL"


def _schema(spark, sf_dir):
    return _docs(spark, sf_dir).schema().select("name", "is_key", "tokenized")


QUERIES["index_schema"] = _schema
ORACLES["index_schema"] = "SELECT * FROM (VALUES ('doc_id', true, false), ('text', false, true), ('lang', false, false), ('source', false, false), ('n_chars', false, false)) AS t(name, is_key, tokenized)"


def _saved(spark, sf_dir):
    """The index written by term buckets and read back."""
    import uuid

    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    build_index(table(spark, sf_dir, "documents"), "doc_id", {"text": Tokenizer()}).save(path, 8)
    ix = load(spark, path, "doc_id", {"text": Tokenizer()})
    return q.top_k(ix, q.Match("text", "the thing of"), 10).select(F.col("doc_id").alias("k"), F.round("score", 6).alias("score"))


QUERIES["index_saved"] = _saved
ORACLES["index_saved"] = ORACLES["search_bm25_topk"]


# ---------------------------------------------------------------- more of queries, aggregates and snippets


def _negated(spark, sf_dir):
    """Ranks as negated scores, the best first in ascending order."""
    found = q.bm25(_docs(spark, sf_dir), q.Match("text", "the thing of"))
    return found.orderBy("rank", "doc_id").limit(10).select(F.col("doc_id").alias("k"), F.round("rank", 6).alias("rank"))


QUERIES["search_negated_bm25"] = _negated
ORACLES["search_negated_bm25"] = f"WITH {_base()} SELECT k, round(-score, 6) AS rank FROM ({_any(['the', 'thing', 'of'])}) ORDER BY score DESC, k LIMIT 10"


def _with_index(spark, sf_dir):
    """A query of its own index inside another's: parts whose key is that of a matching document."""
    own = q.WithIndex(_docs(spark, sf_dir), q.Match("text", "thing"))
    return q.search(_parts(spark, sf_dir), q.Boolean(must=(own, q.Range("p_partkey", 1, 500)))).select(F.col("p_partkey").alias("k"), F.round("score", 6).alias("score"))


QUERIES["search_with_index"] = _with_index
ORACLES["search_with_index"] = f"WITH {_base()} SELECT k, round(score + 1, 6) AS score FROM ({_any(['thing'])}) WHERE k IN (SELECT p_partkey FROM part WHERE p_partkey BETWEEN 1 AND 500)"


def _best(text_sql: str, least: int, most: int, base: str, key: str) -> str:
    return f"""(SELECT term FROM (SELECT term, tf * {_IDF} AS weight FROM (SELECT term, count(*)::DOUBLE AS tf FROM (SELECT unnest({_SPLIT.format(text=text_sql)}) AS term) GROUP BY term) JOIN terms USING (term), stats
        WHERE df >= {least} ORDER BY weight DESC, term LIMIT {most}))"""


_LIKED = "the lace red thing and lace"
_register(
    "search_more_like_document",
    q.MoreLikeThis(("text", "lang"), document='{"text": "the thing nder and thing", "lang": ""}', min_doc_frequency=2, min_term_frequency=1, max_query_terms=3),
    f"""SELECT k, sum(w) AS score FROM (SELECT k, {_WEIGHT} AS w FROM (SELECT k, tf, {_IDF} AS idf, a FROM post JOIN terms USING (term), stats WHERE term IN
    {_best("'the thing nder and thing'", 2, 3, "documents", "doc_id")}) JOIN lens USING (k)) GROUP BY k""",
)


def _like_fields(spark, sf_dir):
    asked = q.MoreLikeThis(("p_name", "p_type"), text=_LIKED, min_doc_frequency=1, min_term_frequency=1, max_query_terms=4)
    return q.search(_parts(spark, sf_dir), asked).select(F.col("p_partkey").alias("k"), F.round("score", 6).alias("score"))


def _like_field_sql(column: str) -> str:
    return f"""(WITH {_base("part", "p_partkey", column)} SELECT k, sum(w) AS score FROM (SELECT k, {_WEIGHT} AS w FROM (SELECT k, tf, {_IDF} AS idf, a FROM post JOIN terms USING (term), stats WHERE term IN
    {_best(f"'{_LIKED}'", 1, 4, "part", "p_partkey")}) JOIN lens USING (k)) GROUP BY k)"""


QUERIES["search_more_like_fields"] = _like_fields
ORACLES["search_more_like_fields"] = f"SELECT k, round(sum(score), 6) AS score FROM ({_like_field_sql('p_name')} UNION ALL {_like_field_sql('p_type')}) GROUP BY k"


def _agg_function(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    made = docs.groupBy("lang").agg(agg.agg({"n": {"value_count": {"field": "n_chars"}}, "most": {"max": {"field": "n_chars"}}, "kinds": {"cardinality": {"field": "source"}}}).alias("j"))
    return made.select("lang", F.from_json("j", "n long, most long, kinds long").alias("v")).select("lang", "v.*")


QUERIES["agg_function"] = _agg_function
ORACLES["agg_function"] = "SELECT lang, count(n_chars) AS n, max(n_chars) AS most, count(DISTINCT source) AS kinds FROM documents GROUP BY lang"
_agg("agg_fixed_interval", "events", {"d": {"date_histogram": {"field": "ts", "fixed_interval": "90000ms"}}}, "d", "SELECT make_timestamp((floor(epoch_us(ts) / 90000000.0::DOUBLE) * 90000000)::BIGINT) AS d, count(*) AS doc_count FROM events GROUP BY 1")
_agg("agg_approximate", "lineitem", {"p": {"terms": {"field": "l_returnflag"}, "aggs": {"x": {"percentiles": {"field": "l_linenumber", "percents": [50], "approximate": True}}}}}, "p", "SELECT l_returnflag AS p, count(*) AS doc_count, quantile_disc(l_linenumber, 0.5) AS x_50 FROM lineitem GROUP BY 1")


def _places(spark, sf_dir):
    """Where each hit is, in bytes, of whole documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(snippet_positions(F.col("text"), ["the", "thing"])).alias("s"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.sum(F.col("s")[0]).alias("begins"), F.sum(F.col("s")[1]).alias("ends"), F.min(F.col("s")[0]).alias("first"))


QUERIES["snippet_places"] = _places
ORACLES["snippet_places"] = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]+') AS parts FROM documents),
    p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM w),
    o AS (SELECT doc_id, part, sum(strlen(part)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM p)
    SELECT doc_id, count(*) AS hits, sum(stop - strlen(part))::BIGINT AS begins, sum(stop)::BIGINT AS ends, min(stop - strlen(part))::INT AS first FROM o WHERE lower(part) IN ('the', 'thing') GROUP BY doc_id"""


def _odd_tags(spark, sf_dir):
    from glyphmill.operators.snippets import highlight

    rows = spark.createDataFrame([(1, "the\u0001 cat and The\u0002 dog"), (2, "breathe"), (3, "")], "id int, text string")
    return rows.select("id", highlight(F.col("text"), ["the"], "$1", "\\").alias("marked"), highlight(F.col("text"), []).alias("plain"), F.to_json(snippet_positions(F.col("text"), ["the", "dog"])).alias("places"))


QUERIES["snippet_odd_tags"] = _odd_tags
ORACLES["snippet_odd_tags"] = r"SELECT * FROM (VALUES (1, '$1the\' || chr(1) || ' cat and $1The\' || chr(2) || ' dog', 'the' || chr(1) || ' cat and The' || chr(2) || ' dog', '[[0,3],[13,16],[18,21]]'), (2, 'breathe', 'breathe', '[]'), (3, '', '', '[]')) AS t(id, marked, plain, places)"


def _snippet_texts(spark, sf_dir):
    """The windows of the benchmark's items, whole."""
    from glyphmill.operators.snippets import snippets

    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(snippets(F.col("text"), ["thing", "the"], "[", "]", 56, 2**30, by_score=False)).alias("n", "window"))
    return rows.select("item_id", "n", "window")


QUERIES["snippets"] = _snippet_texts
ORACLES["snippets"] = r"""WITH w AS (SELECT item_id, regexp_split_to_array(text, '\s+') AS t FROM benchmark),
    p AS (SELECT item_id, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS i FROM w),
    m AS (SELECT *, regexp_replace(word, '(^|[^\p{L}\p{N}])(thing|the)($|[^\p{L}\p{N}])', '\1[\2]\3', 'gi') AS marked, lower(regexp_replace(word, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g')) IN ('the', 'thing') AS hit FROM p),
    c AS (SELECT item_id, i // 7 AS b, string_agg(marked, ' ' ORDER BY i) AS "window", count_if(hit) AS hits FROM m GROUP BY ALL)
    SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY b) - 1)::INT AS n, "window" FROM c WHERE hits > 0"""


def _compacted(spark, sf_dir):
    """An index compacted to one file a bucket answers as before, and its checksum is the same."""
    import uuid

    from glyphmill.operators.index import compact

    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    build_index(table(spark, sf_dir, "benchmark"), "item_id", {"text": Tokenizer()}).save(f"{path}/a", 4)
    compact(spark, f"{path}/a", f"{path}/b")
    one, two = (load(spark, f"{path}/{name}", "item_id", {"text": Tokenizer()}) for name in "ab")
    same = one.checksum().join(two.checksum().withColumnRenamed("checksum", "other"), "field").select("field", (F.col("checksum") == F.col("other")).alias("same"))
    files = two.files().groupBy("field").agg(F.countDistinct("bucket").alias("buckets"), F.count(F.lit(1)).alias("files"), F.sum("postings").alias("postings"))
    return same.join(files, "field").select("field", "same", (F.col("buckets") == F.col("files")).alias("compact"), "postings")


QUERIES["index_compacted"] = _compacted
ORACLES["index_compacted"] = f"WITH {_base('benchmark', 'item_id')} SELECT 'text' AS field, true AS same, true AS compact, count(*) AS postings FROM post"


def _storage(spark, sf_dir):
    import uuid

    from glyphmill.operators.index import storage

    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    build_index(table(spark, sf_dir, "benchmark"), "item_id", {"text": Tokenizer()}).save(path, 4)
    return storage(spark, path).select("part", (F.col("files") > 0).alias("some"), (F.col("bytes") > 0).alias("sized"))


QUERIES["index_storage"] = _storage
ORACLES["index_storage"] = "SELECT unnest(['postings', 'lengths', 'rows', 'terms', 'meta']) AS part, true AS some, true AS sized"


def _version(spark, sf_dir):
    from glyphmill import __version__
    from glyphmill.operators.index import version_info

    return version_info(spark).select((F.col("version") == __version__).alias("own"), (F.length("spark") > 0).alias("spark"))


QUERIES["version_info"] = _version
ORACLES["version_info"] = "SELECT true AS own, true AS spark"


def _random_words(spark, sf_dir):
    """The words are random; their number is not."""
    from glyphmill.sources.fixtures import random_words

    df = spark.range(20).select("id", random_words(7).alias("t"))
    return df.select("id", F.size(F.split("t", " ")).alias("n"))


QUERIES["random_words"] = _random_words
ORACLES["random_words"] = "SELECT i AS id, 7 AS n FROM range(20) t(i)"


def _fixture_kinds(spark, sf_dir):
    """The five kinds of test tables, by their rows and columns."""
    from glyphmill.sources.fixtures import KINDS, test_table

    out = None
    for kind in KINDS:
        df = test_table(spark, kind, 12)
        one = df.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(df.columns[0]).alias("keys")).select(F.lit(kind).alias("kind"), "n", "keys")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES["source_test_kinds"] = _fixture_kinds
ORACLES["source_test_kinds"] = "SELECT unnest(['items', 'orders', 'parts', 'deliveries', 'customers']) AS kind, 12::BIGINT AS n, 12::BIGINT AS keys"


def _json_query(spark, sf_dir):
    """A query through JSON and back."""
    from glyphmill.operators.codec import from_json, to_json

    asked = q.Boolean(must=(q.Match("text", "thing"),), must_not=(q.Term("lang", "fr"),)).boost(2.0)
    return q.search(_docs(spark, sf_dir), from_json(to_json(asked))).select(F.col("doc_id").alias("k"), F.round("score", 6).alias("score"))


QUERIES["search_json"] = _json_query
ORACLES["search_json"] = f"WITH {_base()} SELECT k, round(2 * score, 6) AS score FROM ({_any(['thing'])}) WHERE k NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')"


def _table_function(spark, sf_dir):
    """Tokens by SQL's own table function."""
    from glyphmill.operators.codec import register

    register(spark, "glyphmill_tokens")
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("glyphmill_benchmark")
    return spark.sql("SELECT b.item_id, count(*) AS n, max(t.position) AS last FROM glyphmill_benchmark b, LATERAL glyphmill_tokens(b.text) t GROUP BY b.item_id")


QUERIES["tok_table_function"] = _table_function
ORACLES["tok_table_function"] = f"SELECT item_id, len(t) AS n, (len(t) - 1)::INT AS last FROM (SELECT item_id, {_SPLIT.format(text='text')} AS t FROM benchmark) WHERE len(t) > 0"


def _table_function_options(spark, sf_dir):
    """The table function with a tokenizer given as JSON."""
    from glyphmill.operators.codec import register

    register(spark, "glyphmill_tokens_as", Tokenizer("ngram", min_gram=3, max_gram=3, stopwords=("the",)))
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("glyphmill_benchmark")
    return spark.sql("SELECT b.item_id, count(*) AS n, max(t.position) AS last FROM glyphmill_benchmark b, LATERAL glyphmill_tokens_as(b.text) t GROUP BY b.item_id")


QUERIES["tok_table_function_options"] = _table_function_options
ORACLES["tok_table_function_options"] = """SELECT item_id, count(*) AS n, max(i - 1)::INT AS last FROM (SELECT item_id, unnest(range(1, length(text) - 1)) AS i, text FROM benchmark) WHERE lower(substr(text, i::INT, 3)) <> 'the' GROUP BY 1"""
