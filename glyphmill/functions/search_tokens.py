"""Search tokens from the C and B cuts of a lattice: compounds with their parts at the same position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def is_function_word(pos1: Column, pos2: Column) -> Column:
    """Auxiliaries and conjunctive particles, which search leaves out."""
    return (pos1 == "助動詞") | ((pos1 == "助詞") & (pos2 == "接続助詞"))


def is_dependent_verb(pos1: Column, pos2: Column) -> Column:
    """Verbs that can depend on another, which search keeps."""
    return (pos1 == "動詞") & (pos2 == "非自立可能")


def surfaces_only(tokens: Column) -> Column:
    """The surfaces of search tokens, without those that share a position."""
    return F.transform(F.filter(tokens, lambda t: ~t["is_colocated"]), lambda t: t["surface"])


def with_compounds(text: Column, cuts: Column, normalized: bool = True) -> Column:
    """struct(tokens, compounds) from one pass. Nothing is left out for its part of speech here, and the components are
    named as the tokens are."""
    name = "normalized_form" if normalized else "surface"
    at = lambda n: F.octet_length(F.substring(text, F.lit(1), n))

    def token(m: Column, colocated: bool) -> Column:
        return F.struct(m[name].alias("surface"), at(m["start"]).alias("byte_start"), at(m["end"]).alias("byte_end"), F.lit(colocated).alias("is_colocated"))

    inner = lambda c: F.filter(cuts["b"], lambda b: (b["start"] >= c["start"]) & (b["end"] <= c["end"]))
    tokens = F.flatten(F.transform(cuts["c"], lambda c: F.concat(F.array(token(c, False)), F.transform(F.filter(inner(c), lambda b: b[name] != c[name]), lambda b: token(b, True)))))
    found = F.transform(cuts["c"], lambda c: F.struct(c[name].alias("surface"), F.transform(inner(c), lambda b: b[name]).alias("components"), at(c["start"]).alias("byte_start"), at(c["end"]).alias("byte_end")))
    return F.struct(tokens.alias("tokens"), F.filter(found, lambda x: F.size(x["components"]) > 1).alias("compounds"))


def search_tokens(text: Column, cuts: Column, filtered: bool = True, normalized: bool = True) -> Column:
    """Array of (surface, byte_start, byte_end, is_colocated): each C token, then the B tokens inside it that differ."""
    keep = (lambda m: ~is_function_word(m["pos1"], m["pos2"])) if filtered else (lambda m: F.lit(True))
    name = "normalized_form" if normalized else "surface"
    at = lambda n: F.octet_length(F.substring(text, F.lit(1), n))

    def token(m: Column, colocated: bool) -> Column:
        return F.struct(m[name].alias("surface"), at(m["start"]).alias("byte_start"), at(m["end"]).alias("byte_end"), F.lit(colocated).alias("is_colocated"))

    def of(c: Column) -> Column:
        inner = F.filter(cuts["b"], lambda b: (b["start"] >= c["start"]) & (b["end"] <= c["end"]) & (b[name] != c[name]) & keep(b))
        return F.concat(F.array(token(c, False)), F.transform(inner, lambda b: token(b, True)))

    return F.flatten(F.transform(F.filter(cuts["c"], keep), of))


def compounds(cuts: Column) -> Column:
    """C tokens with more than one B token: (surface, components, start, end)."""
    def parts(c: Column) -> Column:
        return F.filter(cuts["b"], lambda b: (b["start"] >= c["start"]) & (b["end"] <= c["end"]))

    found = F.transform(cuts["c"], lambda c: F.struct(c["surface"].alias("surface"), F.transform(parts(c), lambda b: b["surface"]).alias("components"), c["start"].alias("start"), c["end"].alias("end")))
    return F.filter(found, lambda x: F.size(x["components"]) > 1)


def positions(tokens: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """position: a colocated token shares that of the token before it."""
    w = Window.partitionBy(key).orderBy(order)
    return tokens.withColumn("position", F.sum(F.when(F.col("is_colocated"), 0).otherwise(1)).over(w) - 1)


def extract_compounds(tokens: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """Compounds of an exploded token table: each token with the colocated ones that follow within its bytes."""
    w = Window.partitionBy(key).orderBy(order)
    islands = tokens.withColumn("_g", F.sum(F.when(F.col("is_colocated"), 0).otherwise(1)).over(w))
    head = Window.partitionBy(key, "_g").orderBy(order)
    islands = islands.withColumn("_s", F.first("byte_start").over(head)).withColumn("_e", F.first("byte_end").over(head))
    inside = F.col("is_colocated") & (F.col("byte_start") >= F.col("_s")) & (F.col("byte_end") <= F.col("_e"))
    part = F.when(inside, F.struct(F.col(order), "surface"))
    grouped = islands.groupBy(key, "_g").agg(
        F.min_by(F.when(~F.col("is_colocated"), F.col("surface")), F.col(order)).alias("surface"), F.first("_s").alias("byte_start"), F.first("_e").alias("byte_end"),
        F.transform(F.array_sort(F.collect_list(part)), lambda p: p["surface"]).alias("components"),
    )
    return grouped.where(F.size("components") >= 1).drop("_g")
