"""The whole process on a few posts, stage by stage, and what posts are about."""

import math
import random
import re
from pathlib import Path

import pytest

from emberline.functions import text as T
from emberline.operators import context, grouping, review, scoring
from emberline.plans.process import process
from emberline.session import shared_dir
from pyspark.sql import functions as F
from tests.test_places import COMMON, names  # noqa: F401


@pytest.fixture(scope="module")
def common(spark):
    return spark.createDataFrame([(w,) for w in COMMON], "word string")


def posts(spark, texts):
    return spark.createDataFrame([(i, t, f"2013-06-2{i % 10} 10:00:00" if i else "never") for i, t in enumerate(texts)], "post_id long, text string, at string")


HOME = ["Water over the bridge in Calgary, people at the school need boats", "RT @x: Water over the bridge in Calgary, people at the school need boats", "High River and Calgary are wet #yyc", "sunny day here", "Calgary again near Frog Lake"]


def test_regions(spark, names, common):  # noqa: F811
    home = context.region_of(posts(spark, HOME), names, common)
    assert (home.mode, home.country, home.foreign, home.top[0]) == ("single", "CA", False, ("Calgary", 4)) and home.anchor == (51.05, -114.06)
    n = 5
    lat = round((51.05 * 4 + 50.58) / n, 4)
    assert home.centre[0] == lat and home.box == (round(lat * 4) / 4 - 1.0, round(home.centre[1] * 4) / 4 - 1.75, round(lat * 4) / 4 + 1.0, round(home.centre[1] * 4) / 4 + 1.75)
    abroad = context.region_of(posts(spark, ["near Boulder Colorado", "Flood near Boulder now", "all of Colorado"]), names, common)
    assert (abroad.mode, abroad.country, abroad.foreign, abroad.top) == ("single", "US", True, (("Boulder", 2),))
    world = context.region_of(posts(spark, ["near Boulder Colorado", "Manila", "in Philippines", "in France", "in Calgary"]), names, common)
    assert world.mode == "global" and world.context().centre is None
    assert context.region_of(posts(spark, ["nothing", "here"]), names, common).mode == "single"
    assert not context.is_global([]) and context.is_global([0.59]) and not context.is_global([0.7, 0.08]) and context.is_global([0.7, 0.1, 0.08])


def test_process(spark, names, common):  # noqa: F811
    p = posts(spark, HOME + ["Filler text number five", "Filler text number six"])
    seen = {}

    def vectors(masked):
        seen.update({r["post_id"]: r["masked"] for r in masked.collect()})
        return masked.select("post_id", F.array(F.contains("masked", F.lit("PLACE")).cast("double"), F.lit(1.0)).alias("embedding"))

    zero = ([0.0, 0.0], 0.0)
    heads = {"relevant": (["0", "1"], [zero, ([4.0, -2.0], 0.0)]), "category": (["EVAC", "INFRA"], [zero, ([1.0, 0.0], -0.5)]), "hazard": (["FIRE", "FLOOD"], [zero, ([0.0, 1.0], 0.0)])}
    asked = []

    def answer(prompt):
        asked.append(prompt)
        return "\n".join(f"{i}|1|9|STORM|NEEDS|3|-|Edmonton;17 Avenue;Canada;Nowhere" if "Frog" in line else f"{i}|0|8" for i, line in enumerate(prompt.split("\n")))

    before = spark.createDataFrame([(2, 0, 1, 0.7, "AID", 1, "", "ca", ["High River", "Lyons"])], "group_id long, pos int, rel int, conf double, cat string, urg int, hazard string, cc string, places array<string>")
    told = spark.createDataFrame([("Nowhere", ("Nowhere", 1.0, 2.0, "x", "geocoder", "point", None, "ZZ", None, None))], "name string, place struct<name:string,lat:double,lon:double,kind:string,source:string,precision:string,province:string,cc:string,pop:bigint,rel:bigint>")
    provider = review.Provider(answer, 2, "live")
    out = {r["post_id"]: r for r in process(p, names, common, vectors, heads, terms=["boats"], precomputed=before, budget=2, batch=2, provider=provider, time="at", answers=told).collect()}
    assert seen[0] == "Water over the bridge in PLACE , people at the school need PLACE" and 1 not in seen
    assert [x["place"]["name"] for x in out[0]["places"]] == ["Calgary"] and out[1]["places"] == out[0]["places"] and out[1]["group_id"] == 0
    # the budget covers four lines; the most uncertain by the probability of a flood come first
    assert len(asked) == 2 and sum(len(a.split("\n")) for a in asked) == 4 and "Frog" in "".join(asked)
    frog = out[4]
    assert (frog["rel"], frog["hz"], frog["cat"], frog["urg"], frog["decided_by"], frog["place_hint"]) == (1, "STORM", "NEEDS", 3, "llm", True)
    assert [x["place"]["name"] for x in frog["places"]] == ["Calgary", "Edmonton", "17 Avenue", "Nowhere"] and frog["cc"] == "CA"
    labelled = out[2]
    assert (labelled["rel"], labelled["cat"], labelled["hz"], labelled["cc"], labelled["decided_by"]) == (1, "AID", "FLOOD", "CA", "llm") and labelled["conf"] == 0.7
    assert [x["place"]["name"] for x in labelled["places"]] == ["High River", "Calgary"]
    flood = 1 / (1 + 2.718281828459045**-1)
    p_calgary = 1 / (1 + 2.718281828459045**-2)
    assert abs(out[0]["p"] - p_calgary) < 1e-9 and abs(out[0]["p_flood"] - p_calgary * flood) < 1e-9
    assert str(out[1]["timestamp"]) == "2013-06-21 10:00:00" and out[0]["timestamp"] is None
    assert all((r["cat"], r["hz"], r["urg"]) == ("", "", 0) for r in out.values() if r["rel"] == 0) and out[3]["cc"] == "CA"


def test_texts_are_written_once(spark):
    """Grouped posts are one table; none with keys, or with texts a second time, stays beside it."""
    folder = Path(shared_dir(spark).removeprefix("file:"))
    old = set(folder.iterdir())
    p = posts(spark, [*HOME, "", None])
    got = grouping.grouped_texts(p)
    made = [x for x in folder.iterdir() if x not in old]
    assert {x.name.rsplit("-", 1)[0] for x in made if {"text", "key", "inner_key"} & set(spark.read.parquet(str(x)).columns)} == {"grouped"}
    assert not any(x.name.startswith(("keyed-", "keys-of-posts-", "members-", "groups-", "told-")) for x in made)
    want = grouping.grouped(p).drop("key", "inner_key")
    assert set(got.columns) == set(want.columns) and sorted(got.select(want.columns).collect()) == sorted(want.collect()) and got.count() == 5


def test_planned_rows_get_their_texts(spark):
    rows = spark.createDataFrame([(i, 0.5 + i / 100, False, f"text {i}") for i in range(9)], "id long, p double, hinted boolean, text string")
    asked: list = []
    say = lambda prompt: asked.append(prompt) or "\n".join(f"{i}|1|8|AID|2|-" for i in range(2))
    for own, texts in ((rows, None), (rows.drop("text"), rows.select("id", "text"))):
        assert sorted(r["id"] for r in review.reviewed(own, review.Provider(say, 2, "live"), 2, 2, texts=texts).collect()) == [0, 1, 2, 3]
    assert len(asked) == 4 and asked[:2] == asked[2:] == ["0\ttext 0\n1\ttext 1", "0\ttext 2\n1\ttext 3"]


def test_predictions_without_heads(spark):
    x = spark.createDataFrame([(1, [1.0]), (2, None)], "id long, embedding array<double>")
    got = [r.asDict() for r in scoring.predicted(x, "embedding", {}).orderBy("id").collect()]
    assert [(r["p"], r["p_flood"], r["cat"], r["urg"], r["hz"], r["uncertainty"]) for r in got] == [(0.5, 0.5, "OTHER", 1, "FLOOD", 1.0)] * 2


def test_place_hint_reads_once(spark):
    got = lambda t, *known: spark.range(1).select(T.place_hint(F.lit(t), F.array(*map(F.lit, known)).cast("array<string>")).alias("x")).first()["x"]
    # the first hit takes the words that another alternative would take
    assert [got("we live in My Valley Road"), got("near Frog Lake"), got("near Frog Lake", "frog lake"), got("on 5 th Avenue"), got("the Old Bridge"), got("in Élan"), got(None)] == [False, True, False, True, True, False, False]


def test_heads_are_worked_out_once(spark):
    line = lambda i: ([0.5 * i, -1.0], 0.1 * i)
    pr = scoring.softmax("e", [line(i) for i in range(9)])
    # a product per class, not one per class for each use of the others
    assert str(pr).count("zip_with") <= 9
    got = spark.createDataFrame([([1.0, 2.0],), (None,)], "e array<double>").select(pr.alias("p")).collect()
    logits = [0.5 * i - 2.0 + 0.1 * i for i in range(9)]
    e = [math.exp(x - max(logits)) for x in logits]
    assert got[0]["p"] == pytest.approx([x / sum(e) for x in e])


def test_place_names_by_one_pattern(spark):
    n = r"[A-Z][\w'’]+"
    plain = re.compile(rf"(?<!\w)(?:in|at|near|on|by|across|along|off)\s+(?:the\s+)?({n}(?:\s+{n}){{0,3}})|(?<!\w)(\d+\s*(?:st|nd|rd|th)?\s+(?:St|Street|Ave|Avenue|Rd|Road|Dr|Drive|Blvd|Trail|Way|Cres)(?!\w))|(?<!\w)({n}\s+(?:Trail|Drive|Road|Bridge|Crossing|Park|Street|Avenue|Creek|Lake|Reserve|Nation)(?!\w))")
    words = ["in", "near", "the", "Calgary", "High", "River", "Bow", "Trail", "Park", "5", "12", "th", "St", "Ave", "Street", "x", "I", "Roads", "and,", "(in", "atlas", "O'Brien", "off"]
    rng = random.Random(3)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.place_names(F.col("t")).alias("p")).collect()
    assert len(rows) == 2000 and all(r["p"] == [a or b or c for a, b, c in plain.findall(texts[r["i"]])] for r in rows)
    # the pattern goes over a text once, not once for each of its groups
    assert str(T.place_names(F.col("t"))).count("regexp_extract_all") == 1
