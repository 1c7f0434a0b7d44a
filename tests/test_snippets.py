import re

from pyspark.sql import functions as F

from glyphmill.operators.snippets import snippet_positions, windows
from glyphmill.plans import catalog


def test_positions_in_a_long_text(spark):
    texts = ["é the thing, " * 1500, "", "nothing", "The", "the äö thing"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    for r in rows.select("text", snippet_positions(F.col("text"), ["the", "thing"]).alias("spans")).collect():
        places = [m.span() for m in re.finditer(r"(?i)\b(?:thing|the)\b", r["text"])]
        data = lambda n: len(r["text"][:n].encode())
        if len(places) > 100:
            assert len(r["spans"]) == len(places)
            places, spans = places[-5:], r["spans"][-5:]
        else:
            spans = r["spans"]
        assert spans == [[data(a), data(b)] for a, b in places]


def test_windows_of_a_long_text(spark):
    text = " ".join(["the"] + ["word"] * 6) + " "
    row = spark.createDataFrame([(text * 2000,)], "text string")
    assert row.select(F.size(windows(F.col("text"), ["the"], 60))).first()[0] == 2000


def test_snippet_queries_over_documents_are_registered():
    assert {"snippet_positions_documents", "snippet_highlight_documents", "snippets_documents"} <= set(catalog.ORACLES)
