import random
import re
import string

import pytest
from pyspark.sql import functions as F

from plumbline import config
from plumbline.functions import serialize, text


def model_normalize(s):
    s = re.sub(r"\s+", " ", s.lower().strip())
    s = re.sub(r"\s+", " ", s.strip(string.punctuation + " \t\n\r")).strip()
    first, _, rest = s.partition(" ")
    return rest.strip() if rest and first in ("a", "an", "the") else s


def test_normalize_agrees_with_a_model(spark):
    rng = random.Random(1)
    alphabet = ["a", "an", "the", "The", "x", "É", "B2", " ", "  ", "\t", "\n", " ", ".", "'", '"', "-", "(", "!"]
    cases = ["".join(rng.choices(alphabet, k=rng.randint(0, 9))) for _ in range(400)] + ["the the cat", "a", ""]
    rows = spark.createDataFrame([(c,) for c in cases], "s string").select("s", text.normalize(F.col("s")).alias("n")).collect()
    assert [(r.s, r.n) for r in rows if r.n != model_normalize(r.s)] == []


def test_normalize_takes_one_article_each_time(spark):
    once = text.normalize(F.lit("The the cat"))
    assert spark.range(1).select(once, text.normalize(once)).first()[:] == ("the cat", "cat")


@pytest.mark.parametrize(("long", "short", "held"), [("new york city", "york", True), ("newyork", "york", False), ("a.b c", "a.b", True), ("axb c", "a.b", False), ("été chaud", "t", False), ("x", "", False)])
def test_containment_at_boundaries(spark, long, short, held):
    assert spark.range(1).select(text.contains_at_boundary(F.lit(long), F.lit(short))).first()[0] is held


def test_composite_and_risk(spark):
    rows = spark.createDataFrame([(0.5, 1.0), (0.5, None), (None, None)], "eg double, rp double")
    got = rows.select(text.composite(F.col("eg"), F.col("rp"), 0.7), text.risk(F.col("eg"), F.col("rp"), 0.7), text.risk(F.col("eg"), F.col("rp"), 0.7, 0.5)).collect()
    assert got[0][0] == pytest.approx(0.65) and got[1][0] == 0.5 and got[2][0] is None
    assert got[2][1] is None and got[2][2] == 0.5


def test_business_sentences():
    record = '{"open": true, "name": " Cafe ", "wifi": null, "a": {"b": [1, 2.0]}, "none": {}, "review_info": [{"review_text": " good "}, 3, {"review_text": null}]}'
    assert serialize.business_sentences(record) == "Cafe has open = true.\nThe business is named Cafe.\nCafe has wifi = null (unknown).\nCafe has a.b[0] = 1.\nCafe has a.b[1] = 2.0.\n\nCustomer reviews:\ngood"
    assert serialize.business_sentences('{"x": 1}', reviews=False) == "The business has x = 1."
    assert serialize.business_sentences("[1]") is None and serialize.business_sentences(None) is None


def test_settings_reject_unknown_names():
    assert config.from_mapping({"matching": {"entity_threshold": 0.8}}).matching.entity_threshold == 0.8
    with pytest.raises(ValueError, match="unknown"):
        config.from_mapping({"matching": {"entity_treshold": 0.8}})
    with pytest.raises(ValueError, match="mapping"):
        config.from_mapping({"matching": 3})
