"""Literal cases and invariants of the engine's own operators."""

import random

import pytest
from pyspark.sql import functions as F

from emberline.functions import text as T
from emberline.operators import extraction, gazetteer, grouping, metrics, review, scoring, view
from emberline.operators.components import connected_components
from emberline.operators.skew import join_on_hot_key
from emberline.session import written
from emberline.sources import files
from emberline.sources.services import Cached


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def labels(spark, text):
    return {r["id"]: r for r in review.parsed(spark.createDataFrame([(0, text)], "batch long, answer string")).collect()}


def test_answers(spark):
    got = labels(spark, "12|1|9|INFRA|2|Inglewood;Blackfoot Trail\n13|0|8\n14|1|8|QUAKE|HUMAN|3|CR|Nicoya\n5|1\nx|1|9\n6|2|9\n12|0|1\n15|1|x|AID|1|-")
    assert set(got) == {12, 13, 14, 15}
    assert (got[12]["rel"], got[12]["conf"], got[12]["cat"], got[12]["urg"], got[12]["places"]) == (1, 9, "INFRA", 2, ["Inglewood", "Blackfoot Trail"])
    assert (got[13]["rel"], got[13]["cat"], got[13]["places"]) == (0, "", [])
    assert (got[14]["hazard"], got[14]["cat"], got[14]["cc"], got[14]["places"]) == ("QUAKE", "HUMAN", "CR", ["Nicoya"])
    assert (got[15]["conf"], got[15]["places"]) == (5, [])


def test_text(spark):
    assert one(spark, T.norm_locations(F.lit("High River,AB"))) == "High River;Alberta"
    assert one(spark, T.fold(F.lit("Lac-Mégantic"))) == "lac-megantic"
    assert one(spark, T.squash(F.lit("Tsuu T'ina"))) == "tsuutina"
    assert one(spark, extraction.tag_keys(F.lit("#HighRiverFloods"))) == ["highriverfloods", "highriver"]
    assert one(spark, extraction.tag_keys(F.lit("#prayforyyc"))) == ["prayforyyc", "yyc"]
    assert one(spark, T.clean_text(F.lit(" a &amp;  b\n"))) == "a & b"
    assert one(spark, T.norm_key(F.lit("RT @x: Water rising http://t.co/1 @you…"))) == "water rising"


def test_proper_nouns(spark):
    from emberline.operators import terms

    mask = lambda t: one(spark, terms.mask_proper_nouns(F.lit(t), ("the", "and")))
    assert mask(" Near  Calgary, the #Bow's (High River). Then: They left I'm Ris\u212a And RIVER \u212anow A' #'Abc") == " Near  PLACE, the #PLACE (PLACE River). Then: They left I'm PLACE And RIVER PLACE PLACE' #'Abc"
    assert mask("") == "" and one(spark, terms.mask_proper_nouns(F.lit(None).cast("string"), ("the",))) is None
    # a text of very many words costs no more than as many short ones
    many = spark.range(1).select(F.repeat(F.lit("in Calgary now "), 200_000).alias("t")).select(terms.mask_proper_nouns(F.col("t"), ("the",)).alias("m"))
    assert many.select((F.length("m") - F.length(F.replace("m", F.lit("PLACE"), F.lit("")))).alias("n")).first()["n"] == 5 * 200_000


def posts(spark, order):
    text = "The river is over its banks at the old bridge and people are moving to the high school tonight"
    rows = [(1, text), (2, f"RT @x: {text}"), (3, f"RT @y: {text[:60]}…"), (4, "something else"), (5, None), (6, ""), (7, "RT @z: something else")]
    random.Random(order).shuffle(rows)
    return spark.createDataFrame(rows, "post_id long, text string")


def test_groups_whatever_the_order(spark):
    seen = []
    for i in (1, 2):
        g = grouping.grouped(posts(spark, i).repartition(i + 1))
        seen.append(sorted((r["post_id"], r["group_id"], r["group_size"], r["is_canonical"]) for r in g.collect()))
    assert seen[0] == seen[1]
    assert [(p, g) for p, g, _, _ in seen[0]] == [(1, 1), (2, 1), (3, 1), (4, 4), (7, 4)]
    assert [p for p, _, _, c in seen[0] if c] == [1, 4]


def test_entities(spark):
    import html

    texts = ["a &amp; b", "&lt&gt;&notit; &#65;&#x42 &#xD800; &unknown; &", "no entity", "&amp;amp;", "&&amp;&", "", None, "x &\u00e9t\u00e9; &Aacute y"]
    got = [r["x"] for r in spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", T.unescape(F.col("t")).alias("x")).orderBy("i").collect()]
    assert got == [t if t is None else html.unescape(t) for t in texts]
    plan = spark.createDataFrame([("a",)], "t string").select(T.clean_text(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "_entities(CASE" in plan  # entities go to Python, texts do not


def test_truncated_by_openings(spark):
    """Keys are read as far as the longest prefix; those that differ beyond it have owners of their own."""
    head = "the river is over its banks at the old bridge in the town"
    rows = [(1, f"{head} tonight and people move"), (2, f"{head} tonight and people stay"), (3, f"RT @x: {head} tonigh\u2026"), (4, f"{head} ton\u2026"), (5, "something else that is long enough to be a key of its own"), (6, f"{head} tonight and people move")]
    posts = grouping.keyed(spark.createDataFrame(rows, "post_id long, text string"))
    got = {(r["src"], r["dst"]) for r in grouping.trunc_edges(posts).collect()}
    assert got == {(s, t) for s in (1, 2, 3, 4) for t in (3, 4) if s != t}
    plan = grouping.dup_edges(posts)._jdf.queryExecution().optimizedPlan().toString()
    assert {(r["src"], r["dst"]) for r in grouping.dup_edges(posts).collect()} == {(1, 6)} and "inner_key" not in plan  # digests alone are dealt


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 230)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_hot_join(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 7}" if i % 3 else None) for i in range(400)], "i long, k string")
    groups = written(rows.groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("top")).where("k is not null"), "g")
    got = join_on_hot_key(rows, groups, "k", "n", ["top"], F.col("i"), share=4)
    want = {(r["i"], r["top"]) for r in rows.join(groups, "k", "left").collect()}
    assert {(r["i"], r["top"]) for r in got.collect()} == want and got.count() == 400


@pytest.mark.parametrize(("budget", "rows"), [(10, 1800), (5, 1000), (0, 0)])
def test_caps(budget, rows):
    assert review.cap(budget, 200) == rows


def test_provider_budget_and_replay():
    p = review.Provider(lambda s: s.upper(), 2, "live")
    assert p.answer("a") == "A" and p.answer("a") == "A" and p.spent == 1
    p.answer("b")
    with pytest.raises(review.BudgetSpent):
        p.answer("c")
    again = review.Provider(mode="replay", cache=p.cache)
    assert again.answer("b") == "B" and again.spent == 0
    with pytest.raises(LookupError):
        again.answer("c")
    assert review.Provider().answer("x") is None


def test_similarity():
    assert metrics.similarity("high river", "high rivers") > 85 > metrics.similarity("calgary", "edmonton")
    assert metrics.token_set("bow river", "the bow river valley") == 100
    assert metrics.matched_places(["Calgary", "#HighRiver", "Calgary"], ["calgary", "highriver", "Banff"]) == (2, 3, 3)


def test_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('id,Full_Text,Date\n1,"two\nlines, ""quoted""",2024-01-01\n2,b,2024-01-02\n')
    df = files.read_upload(spark, str(p))
    assert files.detect_columns(df) == ("Full_Text", "Date")
    assert df.where("id = 1").first()["Full_Text"] == 'two\nlines, "quoted"'
    (tmp_path / "empty.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        files.read_upload(spark, str(tmp_path / "empty.csv"))
    for e in ("flood", "fire"):
        (tmp_path / e).mkdir()
        (tmp_path / e / "x.csv").write_text("t\nhello\n")
    assert {r["event"] for r in files.read_by_event(spark, f"{tmp_path}/f*/x.csv").collect()} == {"flood", "fire"}
    (tmp_path / "t.tsv").write_text('# note\nAB\t"x\t3\n')
    assert files.read_tsv(spark, str(tmp_path / "t.tsv"), "cc string, name string, n int").first()["name"] == '"x'
    (tmp_path / "l.jsonl").write_text('{"ts":"1","hash":"a","failed":false,"requests_remaining":40}\n{"ts":"2","hash":"b","failed":true}\n')
    r = files.ledger_counts(spark, [str(tmp_path / "l.jsonl")], 100).first()
    assert (r["ok"], r["failed"], r["remaining"]) == (1, 1, 40)
    files.write_packed(df, df.limit(1), df.limit(1), str(tmp_path / "packed"))
    assert files.read_packed(spark, str(tmp_path / "packed"), "payload", "id string").count() == 2


def test_cache_keeps_negative_answers(tmp_path):
    calls = []
    c = Cached(str(tmp_path / "c.json"), lambda k: calls.append(k))
    assert c.get("x") is None and c.get("x") is None and calls == ["x"]


def test_missing_lines_are_asked_for_once(spark):
    rows = spark.createDataFrame([(i, f"post {i}", 0.5, False) for i in range(12)], "id long, text string, p double, hinted boolean")
    asked = []

    def answer(prompt):
        asked.append(prompt)
        lines = prompt.split("\n")
        return "\n".join(f"{x.split(chr(9))[0]}|1|9|INFRA|2|{x.split(chr(9))[1]}" for x in (lines[:-3] if len(asked) == 1 else lines[:-2] if len(asked) == 2 else lines[1:]))

    got = {r["id"]: r["places"] for r in review.reviewed(rows, review.Provider(answer, 5, "live"), 5, 6).collect()}
    assert len(asked) == 3 and asked[2].split("\n") == ["0\tpost 3", "1\tpost 4", "2\tpost 5"]
    assert got == {i: [f"post {i}"] for i in (0, 1, 2, 4, 5, 6, 7, 8, 9)}
    asked.clear()
    assert review.reviewed(rows, review.Provider(answer, 2, "live"), 2, 6).count() == 7
    assert review.reviewed(rows, review.Provider(), 5, 6).count() == 0


def test_prefixes_meet_their_keys(spark):
    """Nested prefixes, keys that equal one, an opening that most keys share, and prefixes that are open over many ranges."""
    rng = random.Random(5)
    keys = {"".join(rng.choice("ab é") for _ in range(rng.randrange(1, 9))) for _ in range(400)} | {"common opening " + "".join(rng.choice("abc") for _ in range(8)) for _ in range(900)}
    prefixes = {k[: rng.randrange(1, len(k) + 1)] for k in rng.sample(sorted(keys), 150)} | {"common opening ", "common", "zz"}
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(sorted(keys))], "k string, owner long").repartition(3)
    for parts in ("3", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = [tuple(r) for r in grouping.prefixed(rows, spark.createDataFrame([(p,) for p in prefixes], "prefix string")).collect()]
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(got) == len(set(got)) and set(got) == {(p, i) for i, k in enumerate(sorted(keys)) for p in prefixes if k.startswith(p)}


def test_rows_of_files_by_name(spark, tmp_path):
    """Files of unequal sizes, read in several splits, are numbered in the order of their names."""
    sizes = {"a": 3, "b": 4000, "c": 1, "d": 900}
    for name, n in sizes.items():
        (tmp_path / f"{name}.csv").write_text("".join(f"{name}{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = files.with_row_ids(spark.read.text(str(tmp_path))).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["value"] for r in sorted(got, key=lambda r: r["row_id"])] == [f"{name}{i}" for name, n in sizes.items() for i in range(n)]
    assert sorted(r["row_id"] for r in got) == list(range(sum(sizes.values())))


def test_place_scores_of_relevant_rows(spark):
    x = spark.createDataFrame([(1, ["Calgary", "Alberta"], ["calgary", "Alberta"]), (1, ["High River"], []), (0, ["Banff"], ["Banff"]), (1, None, ["Ontario"])], "rel int, gold array<string>, found array<string>")
    r = metrics.place_scores(x, "gold", "found", "rel", regions=False).first()
    assert (r["hits"], r["gold"], r["found"], r["recall"], r["precision"]) == (1, 2, 1, 0.5, 1.0)
    r = metrics.place_scores(x, "gold", "found").first()
    assert (r["hits"], r["gold"], r["found"]) == (3, 4, 4)


def area(pairs):
    good, bad = [p for y, p in pairs if y == 1], [p for y, p in pairs if y == 0]
    return sum((a > b) + (a == b) / 2 for a in good for b in bad) / (len(good) * len(bad)) if good and bad else None


def test_areas_of_groups(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(2), round(rng.random(), 2)) for g in ("a", "b", None) for _ in range(200)] + [("one", 1, 0.5)]
    got = {r["g"]: r["auc"] for r in metrics.auc(spark.createDataFrame(rows, "g string, y int, p double"), "y", "p", ["g"]).collect()}
    assert got.keys() == {"a", "b", None, "one"} and got["one"] is None
    assert all(abs(got[g] - area([r[1:] for r in rows if r[0] == g])) < 1e-12 for g in ("a", "b", None))


def test_each_event_by_a_head_of_the_others(spark):
    rng = random.Random(4)
    rows = [(e, y, [rng.gauss(y * 1.5, 1), rng.gauss(0, 1)], 1.0) for e in ("flood", "fire", "quake") for y in (0, 1) for _ in range(25)]
    df = spark.createDataFrame(rows, "event string, y int, x array<double>, weight double")
    got = {r["event"]: r for r in scoring.leave_one_out(df, "event", "x", "y").collect()}
    for e in ("flood", "fire", "quake"):
        m = scoring.train_head(df.where(F.col("event") != e), "y", "x", "weight")
        w, b = m.coefficientMatrix.toArray()[0], m.interceptVector[0]
        own = [(y, w[0] * x[0] + w[1] * x[1] + b) for v, y, x, _ in rows if v == e]
        assert got[e]["n"] == 50 and got[e]["right"] == sum((z >= 0) == (y == 1) for y, z in own) and abs(got[e]["auc"] - area(own)) < 1e-9


def test_mapped_features(spark):
    tags = [
        {"place": "town", "highway": "x"}, {"boundary": "administrative", "waterway": "river"}, {"waterway": "river", "bridge": "yes"}, {"highway": "primary", "bridge": "yes"}, {"man_made": "bridge"},
        {"highway": "primary", "leisure": "park"}, {"leisure": "park"}, {"boundary": "aboriginal_lands", "amenity": "x"}, {"leisure": "stadium"}, {"shop": "x"}, {"leisure": "pitch"}, {},
    ]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(tags)], "i int, tags map<string,string>")
    assert [r["k"] for r in df.select("i", gazetteer.kind_of_tags("tags").alias("k")).orderBy("i").collect()] == ["town", "neighbourhood", "river", "bridge", "bridge", "road", "park", "first_nation", "landmark", "landmark", "other", "other"]
    rows = [
        (2, {"name": "Old Bridge", "bridge": "yes", "old_name": "Langevin; Lang ;"}, 1.000001, 2.0), (1, {"name": "Bridgeland/Up/Riverside", "place": "suburb"}, 3.0, 4.0), (5, {"name": "Langevin", "highway": "x"}, 5.0, 6.0),
        (7, {"place": "town"}, 1.0, 1.0), (8, {"name": "Nowhere"}, None, None),
    ]
    names = gazetteer.feature_names(spark.createDataFrame(rows, "feature_id long, tags map<string,string>, lat double, lon double"))
    got = {r["name"]: (r["at"], r["kind"], [tuple(p) for p in r["points"]]) for r in names.collect()}
    assert got == {
        "Old Bridge": (2, "bridge", [(1.0, 2.0)]), "Langevin": (2, "bridge", [(1.0, 2.0), (5.0, 6.0)]), "Lang": (2, "bridge", [(1.0, 2.0)]), "Bridgeland/Up/Riverside": (1, "suburb", [(3.0, 4.0)]),
        "Bridgeland": (1, "suburb", [(3.0, 4.0)]), "Riverside": (1, "suburb", [(3.0, 4.0)]),
    }
    assert max(len(r["points"]) for r in gazetteer.feature_names(spark.createDataFrame([(i, {"name": "Long Road"}, 1.0, 1.0) for i in range(30)], "feature_id long, tags map<string,string>, lat double, lon double"), 20).collect()) == 20
    line = lambda n: [(float(i), 0.0) for i in range(n)]
    ways = spark.createDataFrame([(11, None, line(17)), (12, "Lang", line(9)), (13, None, line(3))], "way_id long, name string, points array<struct<lat:double,lon:double>>")
    relations = spark.createDataFrame([(1, "Bow", [11, 12]), (2, "Elbow", [11])], "relation_id long, name string, members array<long>")
    rivers = {r["name"]: (r["kind"], [p["lat"] for p in r["points"]]) for r in gazetteer.with_rivers(names, gazetteer.member_names(relations, ways)).collect()}
    assert rivers["Bow"] == ("river", [0.0, 8.0, 16.0]) and rivers["Lang"] == ("river", [0.0, 8.0]) and rivers["Langevin"][0] == "bridge" and len(rivers) == 7


def test_summaries_cite_rows_or_excerpt_them(spark):
    rows = [(i, 1 + i, i % 4, 0.5, "AID" if i % 2 else "", "FLOOD" if i else "", "CA" if i % 3 else None, f"text {i}", [{"name": "A"}] if i else []) for i in range(10)]
    df = spark.createDataFrame(rows, "id long, n int, urg int, conf double, cat string, hz string, cc string, text string, places array<struct<name:string>>")
    plain = view.summarised(df)
    assert plain["asked"] is False and len(plain["cited"]) == 8 and plain["markdown"].split("\n")[0] == f"- (AID, urgency 3) text {plain['cited'][0]}"
    seen = []
    told = view.summarised(df, review.Provider(lambda p: seen.append(p) or "all is wet [0]", 1, "live"), filters="all")
    assert told == {"markdown": "all is wet [0]", "cited": told["cited"], "asked": True} and sorted(told["cited"]) == list(range(10))
    assert seen[0].startswith("10 of 10: all\n[0] (FLOOD, AID, urgency 3, shared ") and "where: -) text 0" in seen[0]
    assert view.summarised(df, review.Provider()) == plain and view.summarised(df.limit(0))["cited"] == []
