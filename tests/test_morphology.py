from glyphmill.functions import verbs
from glyphmill.operators import deconjugate as dec

VERBS = [("書く", "v5k"), ("泳ぐ", "v5g"), ("話す", "v5s"), ("待つ", "v5t"), ("死ぬ", "v5n"), ("遊ぶ", "v5b"), ("飲む", "v5m"), ("走る", "v5r"), ("買う", "v5u"), ("食べる", "v1")]
FORMS = ["negative", "past", "te", "polite", "passive", "causative", "potential", "volitional", "conditional_ba", "desiderative", "negative_past", "polite_past", "progressive"]


def test_round_trip(spark):
    """What the forward table makes, the rules take back to the same verb."""
    df = spark.createDataFrame(VERBS, "word string, tag string")
    made = verbs.conjugations(df, "word", "tag", FORMS)
    back = {(r["original"], r["form"], r["tag"]) for r in dec.deconjugate(made, "surface").collect()}
    assert not [r for r in made.collect() if (r["surface"], r["word"], r["tag"]) not in back]


def test_unknown_class_has_no_forms(spark):
    df = spark.createDataFrame([("x", "n"), (None, "v1")], "word string, tag string")
    assert verbs.conjugations(df, "word", "tag", FORMS).count() == 0
