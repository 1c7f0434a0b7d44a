"""Decoders and cleaners of structural analysis: logits, tags and spans given as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bucket_count(chunks: Column, buckets: Column, least: Column) -> Column:
    """How many length buckets a batch gets: four from `least` chunks on unless given, never more than chunks."""
    wanted = F.when(buckets.isNull(), F.when(chunks >= least, 4).otherwise(1)).otherwise(F.greatest(buckets, F.lit(1)))
    return F.least(wanted, F.greatest(chunks, F.lit(1)))


def split_sentences(text: Column) -> Column:
    """Sentences, each with its closing marks of 。！？!? ; what follows the last mark is one too."""
    return F.filter(F.split(text, "(?<=[。！？!?])"), lambda s: s != "")


def sentences_from_tags(chars: DataFrame, key: str, order: str, char: str, tag: str) -> DataFrame:
    """key, sentence number, text from one row per character with B/I tags."""
    w = Window.partitionBy(key).orderBy(order)
    numbered = chars.withColumn("sentence", F.sum(F.when(F.col(tag) == "B", 1).otherwise(0)).over(w))
    joined = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(char).alias("c")))), lambda s: s["c"])
    return numbered.groupBy(key, "sentence").agg(F.array_join(joined, "").alias("text"))


def argmax(scores: Column) -> Column:
    """Index of the largest score, the first of equals; null for an empty array."""
    return F.when(F.size(scores) > 0, F.array_position(scores, F.array_max(scores)).cast("int") - 1)


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    return F.transform(powers, lambda p: p / F.aggregate(powers, F.lit(0.0), lambda a, x: a + x))


def labels_over(probabilities: Column, labels: list[str], threshold: float = 0.5) -> Column:
    """Labels whose probability reaches the threshold, sorted."""
    names = F.array(*[F.lit(x) for x in labels])
    paired = F.zip_with(probabilities, names, lambda p, n: F.when(p >= threshold, n))
    return F.array_sort(F.filter(paired, lambda x: x.isNotNull()))


def bio_spans(tokens: DataFrame, key: str, order: str, tag: str, surface: str) -> DataFrame:
    """key, type, first, last, text of each B-x I-x .. run; an I that does not go on a run begins one."""
    w = Window.partitionBy(key).orderBy(order)
    kind, lead = F.regexp_extract(tag, "^[BI]-(.*)$", 1), F.substring(tag, 1, 1)
    rows = tokens.withColumn("_k", kind).withColumn("_b", lead)
    before = F.coalesce(F.lag("_k").over(w), F.lit(""))
    starts = (F.col("_k") != "") & ((F.col("_b") == "B") | (before != F.col("_k")))
    rows = rows.withColumn("_n", F.sum(F.when(starts, 1).otherwise(0)).over(w)).where("_k <> ''")
    joined = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(surface).alias("s")))), lambda x: x["s"])
    return rows.groupBy(key, "_n").agg(F.first("_k").alias("type"), F.min(order).alias("first"), F.max(order).alias("last"), F.array_join(joined, "").alias("text")).drop("_n")


def viterbi(emissions: Column, transitions: list[list[float]], start: list[float], end: list[float]) -> Column:
    """The best tag path of a linear-chain CRF over an array of score arrays; of equal paths the lower tag."""
    tags = range(len(start))
    column = lambda t: [transitions[p][t] for p in tags]

    def best(values: Column) -> Column:
        return F.array_position(values, F.array_max(values)).cast("int") - 1

    def step(state: Column, scores: Column) -> Column:
        arriving = [F.zip_with(state["score"], F.array(*[F.lit(float(x)) for x in column(t)]), lambda s, x: s + x) for t in tags]
        return F.struct(
            F.array(*[F.array_max(a) + F.element_at(scores, t + 1) for t, a in zip(tags, arriving, strict=True)]).alias("score"),
            F.concat(state["back"], F.array(F.array(*[best(a) for a in arriving]))).alias("back"),
        )

    first = F.struct(F.zip_with(F.element_at(emissions, 1), F.array(*[F.lit(float(x)) for x in start]), lambda s, x: s + x).alias("score"), F.array().cast("array<array<int>>").alias("back"))
    final = F.aggregate(F.slice(emissions, 2, F.greatest(F.size(emissions) - 1, F.lit(0))), first, step)
    ended = F.zip_with(final["score"], F.array(*[F.lit(float(x)) for x in end]), lambda s, x: s + x)
    walked = F.aggregate(F.reverse(final["back"]), F.array(best(ended)), lambda path, row: F.concat(F.array(F.element_at(row, F.element_at(path, 1) + 1)), path))
    return F.when(F.size(emissions) > 0, walked)


def apply_edits(chars: Column, keep: Column, insert: Column, keep_score: Column | None = None, insert_score: Column | None = None, threshold: float = 0.0) -> Column:
    """A corrected text: each character has an edit (K keep, D delete, else its replacement) and what goes before it;
    a last insertion goes to the end. With scores, edits below the threshold are not made."""
    if keep_score is not None:
        keep = F.zip_with(keep, keep_score, lambda k, s: F.when(s >= threshold, k).otherwise("K"))
    if insert_score is not None:
        insert = F.zip_with(insert, insert_score, lambda i, s: F.when(s >= threshold, i).otherwise(""))
    edited = F.transform(F.sequence(F.lit(1), F.size(chars)), lambda i: F.concat(
        F.element_at(insert, i), F.when(F.element_at(keep, i) == "K", F.element_at(chars, i)).when(F.element_at(keep, i) == "D", "").otherwise(F.element_at(keep, i))))
    return F.concat(F.array_join(edited, ""), F.coalesce(F.try_element_at(insert, F.size(chars) + 1), F.lit("")))


#: Entity types kept whatever their surface; those that drop pure hiragana (fixed values).
_ANY_SURFACE, _NAMES = ("DATE", "TIME", "MONEY", "PERCENT"), ("PERSON", "LOCATION", "ORGANIZATION", "ARTIFACT")


def well_formed_entity(value: Column) -> Column:
    """Whether an entity feature 'TYPE:surface' is worth keeping."""
    kind, surface = F.substring_index(value, ":", 1), F.expr("substring({v}, instr({v}, ':') + 1)".format(v="value")) if isinstance(value, str) else F.regexp_replace(value, "^[^:]*:", "")
    marks = surface.rlike(r"^[!-/:-@\[-`{-~]*$")
    name = kind.isin(*_NAMES) & ~surface.rlike("^[ぁ-ゖー]+$") & ~((kind == "ARTIFACT") & surface.rlike("^[一-鿿]$"))
    return value.contains(":") & (surface != "") & ~marks & (kind.isin(*_ANY_SURFACE) | name)


def filter_entities(features: Column) -> Column:
    """An array of (key, value) without ill-formed NE entries; others stay."""
    return F.filter(features, lambda f: (f["key"] != "NE") | well_formed_entity(f["value"]))


def best_overlap(spans: DataFrame, words: DataFrame, key: str) -> DataFrame:
    """For each span (key, span, start, end) the word (key, word, wstart, wend) with the longest overlap, the first of
    equals."""
    joined = spans.join(words, key).where("wstart < end and start < wend")
    joined = joined.withColumn("overlap", F.least("end", "wend") - F.greatest("start", "wstart"))
    return joined.groupBy(key, "span").agg(F.max_by("word", F.struct("overlap", -F.col("wstart"))).alias("word"), F.max("overlap").alias("overlap"))


def pool_subwords(pieces: DataFrame, key: str, word: str, vector: str) -> DataFrame:
    """Mean of the vectors of each word's pieces."""
    each = pieces.select(key, word, F.posexplode(vector).alias("i", "x")).groupBy(key, word, "i").agg(F.avg("x").alias("x"))
    return each.groupBy(key, word).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


#: Classes of words that open a base phrase, and those that modify the next one (fixed values).
CONTENT, ADNOMINAL = ("noun", "verb", "adjective", "adverb", "adjectival_noun", "pronoun"), ("adjective", "adnominal")


def base_phrases(tokens: DataFrame, key: str, order: str, cls: str, boundary: str | None = None) -> DataFrame:
    """key, phrase, first, last, head: base phrases end after a boundary mark if one is given, else a content word opens
    one. The last phrase has no head (-1); an adjective or adnominal goes to the next, others to the last."""
    w = Window.partitionBy(key).orderBy(order)
    opens = F.lag(boundary).over(w) if boundary else F.col(cls).isin(*CONTENT)
    rows = tokens.withColumn("_o", F.when(F.coalesce(opens, F.lit(False)), 1).otherwise(0)).withColumn("_first", F.row_number().over(w) == 1)
    rows = rows.withColumn("phrase", F.sum(F.when(F.col("_first"), 0).otherwise(F.col("_o"))).over(w))
    grouped = rows.groupBy(key, "phrase").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.min_by(cls, order).alias("_c"))
    total = F.max("phrase").over(Window.partitionBy(key))
    head = F.when(F.col("phrase") == total, -1).when(F.col("_c").isin(*ADNOMINAL), F.col("phrase") + 1).otherwise(total)
    return grouped.withColumn("head", head).drop("_c")


#: Relations between a predicate and its arguments, and those between nouns (fixed values).
CASES, NOMINAL_RELATIONS = ("ガ", "ヲ", "ニ", "ガ２", "デ", "ト", "時間"), ("ノ", "=")


def cohesion(scores: DataFrame, key: str, threshold: float = 0.5, kinds: DataFrame | None = None) -> DataFrame:
    """key, source, relation, target: for each source and relation the best target by softmax over all, if its share
    reaches the threshold and it is not the source. scores: key, source, target, relation, score. kinds: key, phrase,
    predicate, nominal: cases then need a predicate for a source, relations between nouns a nominal source and a target
    before it, and every target is nominal."""
    if kinds is not None:
        marks = lambda side: kinds.select(key, F.col("phrase").alias(side), F.col("predicate").alias(f"{side}_p"), F.col("nominal").alias(f"{side}_n"))
        both = scores.join(marks("source"), [key, "source"]).join(marks("target"), [key, "target"])
        noun = F.col("relation").isin(*NOMINAL_RELATIONS) & F.col("source_n") & (F.col("target") < F.col("source"))
        scores = both.where(((F.col("relation").isin(*CASES) & F.col("source_p")) | noun) & F.col("target_n")).select(*scores.columns)
    group = Window.partitionBy(key, "source", "relation")
    top = scores.withColumn("_e", F.exp(F.col("score") - F.max("score").over(group)))
    shares = top.withColumn("share", F.col("_e") / F.sum("_e").over(group))
    best = shares.groupBy(key, "source", "relation").agg(F.max_by(F.struct("target", "share"), F.struct("share", -F.col("target"))).alias("b"))
    return best.where(F.col("b.share") >= threshold).where("b.target <> source").select(key, "source", "relation", "b.target")


def discourse(scores: DataFrame, key: str, none: str = "談話関係なし", threshold: float = 0.5) -> DataFrame:
    """Relations between predicates of different sentences: the best label of each pair, unless it is `none` or below
    the threshold. scores: key, left, right, left_sentence, right_sentence, relation, score."""
    pairs = scores.where("left_sentence <> right_sentence")
    group = Window.partitionBy(key, "left", "right")
    top = pairs.withColumn("_e", F.exp(F.col("score") - F.max("score").over(group)))
    shares = top.withColumn("share", F.col("_e") / F.sum("_e").over(group))
    best = shares.groupBy(key, "left", "right").agg(F.max_by(F.struct("relation", "share"), F.struct("share", "relation")).alias("b"))
    return best.where((F.col("b.share") >= threshold) & (F.col("b.relation") != none)).select(key, "left", "right", "b.relation")


#: Parts of speech of the lattice tokenizer in the terms of structural analysis; others are 特殊 (fixed values).
POS_MAP = {
    "名詞": "名詞", "動詞": "動詞", "形容詞": "形容詞", "形状詞": "形容詞", "副詞": "副詞", "連体詞": "連体詞", "接続詞": "接続詞", "感動詞": "感動詞", "助詞": "助詞", "助動詞": "助動詞", "接頭辞": "接頭辞", "接尾辞": "接尾辞", "代名詞": "指示詞",
    "補助記号": "特殊", "記号": "特殊", "空白": "特殊",
}
#: Parts of speech that never open a base phrase (fixed values).
FUNCTION_POS = ("助詞", "助動詞", "接尾辞", "特殊", "補助記号", "記号")


def structural_pos(pos: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in POS_MAP.items() for x in kv]), pos), F.lit("特殊"))


def structural_subpos(pos: Column) -> Column:
    """A finer part of speech, or * where it says nothing."""
    return F.when(F.coalesce(pos, F.lit("")).isin("", "*", "一般", "非自立可能"), "*").otherwise(pos)


def clean_wildcard(value: Column) -> Column:
    return F.when(F.coalesce(value, F.lit("*")) == "*", "").otherwise(value)


def is_function_pos(pos: Column) -> Column:
    return pos.isin(*FUNCTION_POS)


#: What a document may hold; stages name what they need.
FEATURES = ("phrase_features", "entity_features", "morpheme_features", "arcs", "relations", "discourse")


def document_features(phrases: Column, discourse: Column) -> Column:
    """The names of FEATURES that a document has. phrases: structs of features (key, value), relations, head, morphemes (each
    with features); discourse: its relations."""
    some = lambda test: F.exists(phrases, test)
    tests = (
        some(lambda p: F.size(p["features"]) > 0), some(lambda p: F.exists(p["features"], lambda f: f["key"] == "NE")), some(lambda p: F.exists(p["morphemes"], lambda m: F.size(m["features"]) > 0)),
        some(lambda p: p["head"] >= 0), some(lambda p: F.size(p["relations"]) > 0), F.size(discourse) > 0,
    )
    return F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), name) for name, t in zip(FEATURES, tests, strict=True)]), lambda n: n.isNotNull())


#: Stages of the cleaner: (name, phase, feature that a document needs, what becomes of a phrase's features). The phases
#: validate and normalize have no stages.
CLEANERS = (("filter_ne", "filter", "entity_features", filter_entities),)
PHASES = ("filter", "validate", "normalize")


def _with_features(phrases: Column, change) -> Column:
    return F.transform(phrases, lambda p: p.withField("features", change(p["features"])))


def _feature_count(phrases: Column) -> Column:
    return F.aggregate(phrases, F.lit(0), lambda n, p: n + F.size(p["features"]))


def clean(documents: DataFrame, phrases: str = "phrases", discourse: str = "discourse", only: tuple[str, ...] | None = None) -> DataFrame:
    """Documents after the cleaner's stages, by phase: a stage changes only documents with the feature it needs, which are
    looked for anew after a stage that may have removed some. `cleaned`: the stages that changed the document."""
    out = documents.withColumn("cleaned", F.array().cast("array<string>"))
    for phase in PHASES:
        for name, where, needs, change in CLEANERS:
            if where != phase or (only is not None and name not in only):
                continue
            made = _with_features(F.col(phrases), change)
            has = F.array_contains(document_features(F.col(phrases), F.col(discourse)), needs)
            out = out.withColumn("_made", F.when(has, made).otherwise(F.col(phrases)))
            out = out.withColumn("cleaned", F.when(_feature_count(F.col("_made")) != _feature_count(F.col(phrases)), F.array_append("cleaned", F.lit(name))).otherwise(F.col("cleaned")))
            out = out.withColumn(phrases, F.col("_made")).drop("_made")
    return out
