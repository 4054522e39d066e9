import math
import random
import re

import pytest
from pyspark.sql import functions as F

from geograph.functions import taxonomy
from geograph.functions import text as tx
from geograph.functions.geo import haversine_km


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_titles(spark):
    rows = [("The Old Fort (ruined)",), ("!!",), ("किला",), ("A B  c",), (None,), ("Jal  Mahal-1",)]
    got = values(spark, rows, "t string", tx.normal_title("t"), F.array_join(tx.title_tokens("t"), " "))
    assert got == [("the old fort", "ruined"), ("", ""), ("", ""), ("a b c", ""), ("", ""), ("jal mahal1", "mahal")]


def test_places(spark):
    rows = [("x", "monument located in the Sawai  Madhopur district.", ""), ("x", "", "Officially originates from Molela, Rajsamand."), ("x", None, "Officially originates from Nowhere."), ("Mount Abu fort", None, None), ("nothing", "", "")]
    assert values(spark, rows, "t string, f string, d string", tx.place("t", "f", "d")) == [("sawai  madhopur",), ("rajsamand",), ("nowhere",), ("abu",), (None,)]


def test_eras(spark):
    eras = ["8th Century", "19th century", "21st century", "an Ancient site", None, "Local Heritage", "15th  century", "6th century", "ancients", " 3rd century "]
    got = values(spark, [(e,) for e in eras], "e string", tx.specific_era("e"), taxonomy.era_id("e"))
    assert [b for _, b in got] == ["era-early-medieval", "era-colonial", "era-modern", "era-ancient", "era-undated", "era-undated", "era-rajput-mughal", "era-ancient", "era-undated", "era-ancient"]
    assert got[5][0] is None and got[9][0] == "3rd century"


def test_categories_and_crafts(spark):
    rows = [("TANGIBLE_ASI_PROTECTED", "Blue Pottery of Jaipur"), (None, "Sanganeri hand block printing"), ("gastronomy_x", "Makrana marble"), ("INTANGIBLE_DANCE", "Ghoomar")]
    got = values(spark, rows, "c string, t string", tx.group_of("c"), tx.pretty_category("c"), taxonomy.subtype_id("c"), taxonomy.craft_id("t"))
    assert got == [("tangible", "Tangible ASI Protected", "subtype-asi-protected", "craft-pottery"), ("tangible", "Heritage Site", "subtype-general-monuments", "craft-block-printing"), ("gastro", "Gastronomy X", "subtype-general-monuments", "craft-stone-carving"), ("intangible", "Intangible Dance", "subtype-dance", None)]


def test_boilerplate(spark):
    long = "A thing of real beauty that has stood for long by the river side."
    rows = [("A local fort documented by open-source ground mapping.", long), (long, long), ("short", ""), (None, "It STANDS AS AN IMPORTANT node of all, in truth and for sure")]
    assert values(spark, rows, "f string, d string", tx.is_boilerplate("f", "d")) == [(True,), (False,), (True,), (True,)]


def test_event_titles(spark):
    titles = ["Desert Festival - 2027 in town", "FESTIVALS OF THE WHOLE STATE in one Fair", "Camel Fair", "x" * 48 + "Fair", "Fair", "Fa", "Kite FESTIVALS Utsav — 2026", None, "Market"]
    assert [v for (v,) in values(spark, [(t,) for t in titles], "t string", tx.event_title("t"))] == ["Desert Festival", None, "Camel Fair", None, "Fair", None, "Kite  Utsav", None, None]


def test_ids_and_points(spark):
    lng, lat = tx.wkt_point("w")
    rows = [("Point(75.8 -26.9)", 7, "Amber Fort!"), ("point(1 2)", 1234, ""), (None, 0, None)]
    got = values(spark, rows, "w string, i int, t string", lng, lat, tx.code_id("P-", "t", F.col("i")), tx.slug("t"))
    assert got == [(75.8, -26.9, "P-AMBERFORT-007", "amber-fort"), (None, None, "P--1234", ""), (None, None, "P--000", "")]


def test_distance(spark):
    ((km, none),) = values(spark, [(26.9239, 75.8267, 26.8398, 75.5427)], "a double, b double, c double, d double", haversine_km("a", "b", "c", "d"), haversine_km("a", "b", "a", "b"))
    assert 29 < km < 31 and none == 0
    ((half,),) = values(spark, [(0.0, 0.0, 0.0, 180.0)], "a double, b double, c double, d double", haversine_km("a", "b", "c", "d"))
    assert half == pytest.approx(math.pi * 6371)


def test_tokens_match_a_plain_version(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("abc AB-9 \n éÉ,") for _ in range(40)) for _ in range(50)]
    got = [v for (v,) in values(spark, [(t,) for t in texts], "t string", tx.tokens("t"))]
    assert got == [[w for w in re.sub(r"[^a-z0-9\s]", " ", t.lower()).split() if len(w) >= 3 and w not in tx.STOP_WORDS] for t in texts]
