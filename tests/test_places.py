"""Names, their resolution and extraction: literal cases, and whole small sources against plain versions."""

import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from emberline.functions import text as T
from emberline.operators import extraction as E
from emberline.operators import names as N
from emberline.operators import place_values as V

REGISTER = [
    ("Calgary", 51.05, -114.06, "Alberta", "City", "Populated Place", 8_000_000), ("Edmonton", 53.5, -113.5, "Alberta", "City", "Populated Place", 8_000_000),
    ("High River", 50.58, -113.87, "Alberta", "Town", "Populated Place", 1_500_000), ("Wilson", 50.0, -112.0, "Alberta", "Hamlet", "Populated Place", 100),
    ("Wilson", 45.0, -70.0, "Quebec", "Locality", "Populated Place", 5000), ("Siksika 146", 50.8, -113.1, "Alberta", "Indian Reserve", "x", 0),
    ("Kashechewan First Nation", 52.3, -81.6, "Ontario", "First Nation", "x", 0), ("Bow River", 51.0, -114.0, "Alberta", "River", "Water", 1_000_000),
    ("Elbow Creek", 51.0, -114.2, "Alberta", "Creek", "Water", 999_999), ("Lac-Mégantic", 45.58, -70.88, "Quebec", "City", "Populated Place", 1_200_000),
    ("Mission", 49.1, -122.3, "British Columbia", "City", "Populated Place", 2_000_000), ("Sun Peak", 50.9, -119.9, "British Columbia", "Mountain", "Terrain", 9_000_000),
    ("Tsuut'ina Nation 145", 51.0, -114.3, "Alberta", "Indian Reserve", "x", 0), ("Shaw", 46.0, -60.0, "Nova Scotia", "Town", "Populated Place", 4_000_000),
    ("Faraway", 60.0, -135.0, "Yukon", "Village", "Populated Place", 300),
]
FEATURES = [("Inglewood SE", "neighbourhood", [(51.04, -114.01), (60.0, -100.0)]), ("17 Avenue SW", "road", [(51.2, -114.0), (51.038, -114.08)]), ("17 Avenue SE", "river", [(51.0501, -114.0601)]), ("Park", "park", [(1.0, 1.0)]), ("Boulder", "town", [(51.1, -114.2)])]
CITIES = [
    ("Boulder", "Boulder", ["Bouldre"], 40.0, -105.3, "US", "CO", 103_000), ("Lyon", "Lyon", ["Lyons", "Lugdunum"], 45.75, 4.85, "FR", "84", 500_000),
    ("Lyons", "Lyons", [], 40.22, -105.27, "US", "CO", 2_000), ("Manila", "Manila", ["Maynila", "ab"], 14.6, 121.0, "PH", "NCR", 1_600_000), ("Moore", "Moore", [], 35.3, -97.5, "US", "OK", 62_000),
    ("Québec", "Quebec", [], 46.8, -71.2, "CA", "10", 530_000), ("Cagayan de Oro", "Cagayan de Oro", [], 8.5, 124.6, "PH", "X", 680_000), ("New York City", "New York City", [], 40.7, -74.0, "US", "NY", 8_000_000),
]
STATES = [("US.CO", "Colorado", "Colorado"), ("US.OK", "Oklahoma", "Oklahoma"), ("PH.NCR", "Metro Manila", "Metro Manila"), ("FR.84", "Rhône", "Rhone"), ("US.XX", "Empty", "Empty")]
COUNTRIES = [("US", "United States", "NA"), ("FR", "France", "EU"), ("PH", "Philippines", "AS"), ("CA", "Canada", "NA"), ("DE", "Germany", "EU")]
COMMON = ["mission", "boulder", "moore", "river", "people", "island", "sandy", "lyon"]
EVENT = N.Context(centre=(51.05, -114.07), anchor=(51.05, -114.06), world=True)
GLOBAL = N.Context(world=True)
ABROAD = N.Context(centre=(40.0, -105.3), canada=False, world=True, region_cc="US")


@pytest.fixture(scope="module")
def names(spark):
    at = lambda rows: [(i, *r) for i, r in enumerate(rows)]
    register = spark.createDataFrame(at(REGISTER), "at long, name string, lat double, lon double, province string, term string, category string, relevance long")
    features = spark.createDataFrame(at(FEATURES), "at long, name string, kind string, points array<struct<lat:double,lon:double>>")
    cities = spark.createDataFrame(at(CITIES), "at long, name string, ascii string, others array<string>, lat double, lon double, cc string, state_code string, pop long")
    states = spark.createDataFrame(at(STATES), "at long, code string, name string, ascii string")
    return N.sources(register, features, (cities, states, spark.createDataFrame(at(COUNTRIES), "at long, cc string, name string, continent string")))


@pytest.fixture(scope="module")
def gazetteers(spark, names):
    common = spark.createDataFrame([(w,) for w in COMMON], "word string")
    return {name: E.gazetteer(names, c, common) for name, c in (("event", EVENT), ("global", GLOBAL), ("abroad", ABROAD))}


def found(spark, g, texts):
    posts = spark.createDataFrame(list(enumerate(texts)), "post_id long, text string")
    got = {r["post_id"]: [(p["span"], p["place"]["name"]) for p in r["places"]] for r in E.extracted(posts, g).collect()}
    return [got.get(i, []) for i in range(len(texts))]


def test_variants(spark):
    got = lambda s: spark.range(1).select(N.variants(F.lit(s)).alias("v")).first()["v"]
    assert got("Tsuut’ina Nation 145") == ["tsuut'ina nation 145", "tsuut'ina"]
    assert got("Downtown 17th Avenue") == ["downtown 17th avenue", "downtown 17 avenue", "17th avenue", "17 avenue"]
    assert got("the Old First Nation area") == ["the old first nation area", "old first nation area", "the old first nation", "the old", "old first nation", "old"]
    assert got("") == []


def test_builders(names):
    official = {(r["key"], r["name"]) for r in names.official.collect()}
    assert {("siksika", "Siksika 146"), ("siksika 146", "Siksika 146"), ("kashechewan", "Kashechewan First Nation"), ("lac-megantic", "Lac-Mégantic"), ("tsuut'ina", "Tsuut'ina Nation 145")} <= official
    assert not {n for _, n in official} & {"Sun Peak", "Elbow Creek"}
    world = {(r["key"], r["tier"], r["name"], r["lat"], r["cc"]) for r in names.world.collect()}
    a, b = math.sqrt(103_000), math.sqrt(2_000)
    assert ("colorado", 2, "Colorado", round((40.0 * a + 40.22 * b) / (a + b), 3), "US") in world
    assert {("usa", 0), ("united states", 1), ("lugdunum", 3), ("québec", 3), ("quebec", 3), ("rhône", 2)} <= {(w[0], w[1]) for w in world}
    assert not {w[0] for w in world} & {"bouldre", "ab", "empty", "germany"}
    assert {r["cc"] for r in names.countries.collect()} == {"US", "FR", "PH", "CA"}
    together = {(r["squashed"], r["key"], r["source"]) for r in names.run_together.collect()}
    assert {("highriver", "high river", "official"), ("17avenuesw", "17 avenue sw", "features"), ("cagayandeoro", "cagayan de oro", "world")} <= together
    kinds = {r["key"]: r["kind"] for r in names.features.where("key = '17 avenue'").orderBy(F.desc("at")).collect()}
    assert kinds == {"17 avenue": "road"} and not names.features.where("key = 'park'").count()


def resolve(spark, names, c, asked):
    rows = spark.createDataFrame([(i, n, cc) for i, (n, cc) in enumerate(asked)], "id long, name string, hint string")
    return [r["place"] for r in N.resolved(rows, names, c, cc="hint").orderBy("id").collect()]


def test_resolution(spark, names):
    asked = ["YYC", "Downtown Calgary", "Inglewood", "17th Avenue", "Faraway", "Wilson", "Siksika First Nation", "Southern Alberta", "Northern Calgary", "highriver", "Canada", None, "qld", "Filipinos", "Lyons", "Colorado", "québec", "Quebec", "nowhere"]
    got = [(p["name"], p["source"], p["precision"]) if p else None for p in resolve(spark, names, EVENT, [(n, None) for n in asked])]
    assert got == [
        ("Calgary", "cgndb", "locality"), ("Calgary", "cgndb", "locality"), ("Inglewood", "osm", "point"), ("17 Avenue", "osm", "line"), None, ("Wilson", "cgndb", "locality"),
        ("Siksika 146", "cgndb", "locality"), ("Alberta", "alias", "region"), None, ("High River", "cgndb", "locality"), None, None, None, ("Philippines", "geonames", "region"),
        None, ("Colorado", "geonames", "state"), None, ("Quebec", "alias", "region"), None,
    ]
    where = resolve(spark, names, EVENT, [("17 Avenue", None), ("Inglewood", None), ("Wilson", None)])
    assert [(p["lat"], p["cc"]) for p in where] == [(51.0501, "CA"), (51.04, "CA"), (50.0, "CA")]  # nearest of all points; the nearer Wilson
    world = resolve(spark, names, GLOBAL, [("Lyons", None), ("Lyons", "fr"), ("Wilson", None), ("High River", None), ("High River", "US"), ("Siksika", "CA"), ("Faraway", None), ("Manila", None), ("ncr", None)])
    assert [(p["name"], p["cc"]) if p else None for p in world] == [("Lyons", "US"), ("Lyons", "US"), None, ("High River", "CA"), None, ("Siksika 146", "CA"), None, ("Manila", "PH"), ("Manila", "PH")]
    abroad = resolve(spark, names, ABROAD, [("Calgary", None), ("Alberta", None), ("Boulder", None), ("Moore", None), ("Manila", None)])
    assert [p and (p["name"], p["source"], p["cc"]) for p in abroad] == [None, None, ("Boulder", "osm", "US"), None, ("Manila", "geonames", "PH")]


def test_extraction(spark, gazetteers):
    texts = [
        "The Red Cross and Shaw help", "#calgaryflood and #yyc", "Water in High River, Alberta.", "We met Jeff Wilson today", "Flooding in Wilson now", "Hurricane Calgary hits Calgary",
        "on the bow river at bc and BC", "calgary is wet", "Mission is flooded", "we drive to Mission", "17 Avenue and 17 avenue", "#helpHighRiver please", "Siksika people", None, "", "Kashechewan; Lac-Megantic LAC-MÉGANTIC",
    ]
    assert found(spark, gazetteers["event"], texts) == [
        [], [("#calgaryflood", "Calgary")], [("High River", "High River"), ("Alberta", "Alberta")], [], [("Wilson", "Wilson")], [("Calgary", "Calgary")],
        [("BC", "British Columbia")], [("calgary", "Calgary")], [], [], [("17 Avenue", "17 Avenue")], [("#helpHighRiver", "High River")], [("Siksika", "Siksika 146")], [], [], [],
    ]
    texts = ["Boulder Colorado Lyons", "near Boulder Colorado and Lyons", "at Lyons", "Jeff Moore said", "manila is wet", "in Moore", "Filipinos in NYC and QLD", "Kashechewan; Lac-Megantic LAC-MÉGANTIC"]
    assert found(spark, gazetteers["global"], texts) == [[("Colorado", "Colorado"), ("Lyons", "Lyons")], [("Boulder", "Boulder"), ("Colorado", "Colorado"), ("Lyons", "Lyons")], [("Lyons", "Lyons")], [], [("manila", "Manila")], [], [("Filipinos", "Philippines"), ("NYC", "New York City")], [("Kashechewan", "Kashechewan First Nation"), ("Lac-Megantic", "Lac-Mégantic")]]


def test_masking_by_offset(spark, gazetteers):
    texts = ["We met in Calgary near Hurricane Calgary", "(High River), #HighRiverFlood!", "#yyc\n  #YYCfloods in  High River...", "none", None, "é High River é"]
    posts = spark.createDataFrame(list(enumerate(texts)), "post_id long, text string")
    spans = E.extracted(posts, gazetteers["event"])
    got = [r["masked"] for r in E.masked(posts, spans).orderBy("post_id").collect()]
    assert got == ["We met in PLACE near Hurricane Calgary", "(PLACE), #HighRiverFlood!", "#PLACE\n  #YYCfloods in  PLACE", "none", "", "é PLACE é"]
    for r in E.with_offsets(posts, spans).where("text is not null").collect():
        for p in r["places"]:
            assert r["text"][p["start"] : p["end"]].strip(".") == p["span"]


def plain_spans(text, keys, facts, common, world):
    """A plain reading of the rules over tables that the gazetteer holds: [(span, name)]."""
    fold = lambda s: "".join(c for c in unicodedata.normalize("NFKD", s.lower()) if not unicodedata.combining(c))
    toks = re.findall(T.GAZETTEER_TOKEN, text)
    look = lambda k: keys[k][0] if k in keys else keys.get(fold(k), (None, None))[1]
    upper = lambda w: bool(re.search("[A-ZÀ-ÖØ-Þ]", w)) and not re.search("[a-zß-öø-ÿ]", w)
    big = lambda w: bool(re.match("[A-ZÀ-ÖØ-Þ]", w))

    def judge(i, n):
        raw = toks[i : i + n]
        if any(t.startswith("#") for t in raw):
            return None
        words = [t.strip(".'’-") for t in raw]
        span = " ".join(words)
        key, before = span.lower(), toks[i - 1] if i else ""
        f, known = facts.get(key, {}), facts.get(fold(key), {}).get("known_city", False)
        place = look(key)
        if place is None or key in V.BLOCK or not words[0] or not words[-1]:
            return None
        if n > 1:
            ok = all(big(w) or w[:1].isdigit() or w.lower() in V.SMALL for w in words)
        elif key in V.STOP:
            ok = False
        elif len(span) < 3:
            ok = upper(span) and (key in V.ALIASES or world and key in V.REGION_ALIASES)
        elif not big(span):
            ok = key not in common and len(key) >= 5 and (f.get("small_ok") or known)
        elif key in common or key.endswith("s") and key[:-1] in common:
            ok = f.get("is_admin") and key not in V.VAGUE or i > 0 and f.get("mid_ok")
        else:
            ok = True
        if not ok or n == 1 and key in V.ALIASES and len(key) <= 3 and not upper(span) or before.lower().lstrip("#") in V.STORMS:
            return None
        if n == 1:
            person = i > 0 and big(before) and before.lower() not in V.PREPOSITIONS and look(before.lower()) is None
            official = place["source"] == "cgndb"
            small_town = place["source"] == "geonames" and place["kind"] == "city" and (place["pop"] or 0) < 1_000_000
            minor = official and (place["rel"] or 0) < 1_000_000 and place["kind"] in ("locality", "hamlet") and not f.get("is_nation")
            if person and (official or small_town) or minor and before.lower() not in V.PREPOSITIONS:
                return None
        return span, place

    out, i = [], 0
    while i < len(toks):
        hit = next(((n, r) for n in range(min(5, len(toks) - i), 0, -1) if (r := judge(i, n))), None)
        if hit and hit[1][1]["name"] not in {p["name"] for _, p in out}:
            out.append(hit[1])
        i += hit[0] if hit else 1
    votes = {}
    for _, p in out:
        if p["cc"]:
            votes[p["cc"]] = votes.get(p["cc"], 0) + (2 if p["kind"] in ("country", "state", "province") else 1)
    top = max(votes, key=votes.get, default=None)
    if world and top and votes[top] >= 2:
        out = [(s, p) for s, p in out if p["cc"] in (top, None) or p["kind"] in ("country", "state", "province") or (p["pop"] or 0) >= 1_000_000]
    return [(s, p["name"]) for s, p in out]


@pytest.mark.parametrize("which", ["event", "global", "abroad"])
def test_random_texts(spark, gazetteers, which):
    g, rng = gazetteers[which], random.Random(11)
    rows = g.keys.collect()
    keys = {r["key"]: (r["place"], r["plain"]) for r in rows}
    facts = {r["key"]: r.asDict() for r in rows}
    pool = [w for k in keys for w in (k, k.title(), k.upper(), *k.title().split())] + ["in", "near", "Jeff", "Hurricane", "storm", "the", "of", "#x", "People", "and,", "flood"] * 8
    texts = [" ".join(rng.choice(pool) + rng.choice(["", "", "", ".", ",", "'", "-"]) for _ in range(rng.randrange(1, 14))) for _ in range(600)]
    assert found(spark, g, texts) == [plain_spans(re.sub(r"#[^ ]*", "#x", t), keys, facts, set(COMMON), True) for t in texts]


def test_long_texts(spark, gazetteers):
    """Spans of a text are read a few times, whatever their number: a text of very many places is done at once."""
    named = [f"{w} {i}" for i in range(4000) for w in ("Calgary and Manila", "near Edmonton", "#calgaryFlood")]
    texts = [" ".join(named), "Nothing here", None]
    posts = spark.createDataFrame(list(enumerate(texts)), "post_id long, text string")
    got = E.extracted(posts, gazetteers["event"])
    assert got.count() == 1
    placed = E.with_offsets(posts, got, how="inner").collect()
    assert [p["place"]["name"] for p in placed[0]["places"]] == ["Calgary", "Manila", "Edmonton"]
    assert [texts[0][p["start"] : p["end"]] for p in placed[0]["places"]] == ["Calgary", "Manila", "Edmonton"]
    plan = E.known_spans(posts, gazetteers["event"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1  # the tokens are looked for once per text


def test_levels_by_their_own_size(spark):
    """A level of the trie that is small is sent to all, whatever the size of the whole."""
    g = E.plain_gazetteer(spark.createDataFrame([("calgary tower", None), ("calgary", None)], f"key string, place {N.PLACE}"))
    assert set(g.level_bytes) == {1, 2} and all(v > 0 for v in g.level_bytes.values())
    from dataclasses import replace

    wide = replace(g, level_bytes={1: 10, 2: 1 << 40})
    posts = spark.createDataFrame([(1, "the Calgary Tower")], "post_id long, text string")
    plan = E.known_spans(posts, wide)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 3  # the second level; the first, and the keys twice


def test_held_spans_need_no_keys(spark):
    keys = [("café",), ("bow river",), ("élan vital",), ("elan vital",)]
    g = E.plain_gazetteer(spark.createDataFrame(keys, "key string").select("key", F.lit(None).cast(N.PLACE).alias("place")))
    texts = spark.createDataFrame([(0, "Cafe Café, Bow River"), (1, "Élan vital élan Vital Elan vital"), (2, None)], "post_id int, text string")
    spans = E.held_spans(texts, g)
    # an accented key holds itself alone, a plain one also what is folded to it
    assert sorted((r["post_id"], r["pos"], r["key"]) for r in spans.collect()) == [(0, 1, "café"), (0, 2, "bow river"), (1, 0, "élan vital"), (1, 2, "élan vital"), (1, 4, "elan vital")]
    # spans are not dealt out by their keys: texts alone are, in tasks of bounded size
    plan = spans._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "RepartitionByExpression" in plan


def test_pieces_and_first_tokens(spark):
    texts = ["", "a #b  ##c, d", " … ", "#", "x" * 5 + "文" * 200000, "no-end's 12.5 #É# "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.pieces(F.col("t")).alias("p"), T.tokens(F.col("t"), T.GAZETTEER_TOKEN).alias("k"), T.first_tokens(F.col("t"), 2).alias("f")).collect()
    assert all("".join(r["p"]) == r["t"] and len(r["p"]) >= len(r["k"]) and all(p.endswith(k) for p, k in zip(r["p"], r["k"])) and r["f"] == r["k"][:2] for r in rows)
