"""Name indexes of several sources, and the place that a name stands for.

Sources stay tables of (key, record); a key may have many records. A lookup joins the keys asked for with each source, keeps each source's best
record by its own rule, and takes the first source that has one. Nothing is held on the driver but the short fixed tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import text as T
from emberline.operators import place_values as V
from emberline.operators.gazetteer import haversine
from emberline.operators.skew import as_small_as, join_on_hot_key, small_or_shuffled
from emberline.session import forget, written

#: What a name resolves to.
PLACE = "struct<name:string,lat:double,lon:double,kind:string,source:string,precision:string,province:string,cc:string,pop:bigint,rel:bigint>"
_NO_WORD = r"(?<![\p{L}\p{N}_])"
_QUADRANT = r"[\s\p{Z}]+(NE|NW|SE|SW|N|S|E|W)$"
_SPELLING = r"^[A-Za-z][A-Za-z .'\-]{3,40}$"


def _map(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


def _of(table: dict, key: Column) -> Column:
    return F.try_element_at(_map(table), key)


def small_table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """One of the fixed tables."""
    return spark.createDataFrame(rows, schema)


def variants(name: Column) -> Column:
    """Ever simpler forms of a name, in order, each once: ordinals as numbers, without what it begins with, without what it ends with."""
    key = F.trim(F.translate(F.lower(name), "’", "'"))
    plain = F.trim(F.regexp_replace(key, _NO_WORD + r"(\d+)(st|nd|rd|th)(?![\p{L}\p{N}_])", "$1"))
    first = F.array(key, plain)
    without = lambda v: F.array(*[F.when(v.startswith(b), F.trim(F.substr(v, F.lit(len(b) + 1)))).otherwise("") for b in V.BEGINNINGS])
    begun = F.array_distinct(F.concat(first, F.flatten(F.transform(F.array_distinct(first), without))))

    def cut(v: Column) -> Column:
        v = F.regexp_replace(v, r"[\s\p{Z}]+\d+[a-z]?$", "")
        for e in V.ENDINGS:  # one after another, as written
            v = F.regexp_replace(v, e + "$", "")
        return v

    # each cut is made from what the one before left, so the three are worked out one after another
    cuts = lambda v: F.aggregate(F.sequence(F.lit(1), F.lit(3)), F.array(v), lambda a, _: F.concat(a, F.array(cut(F.element_at(a, -1)))))
    ended = F.flatten(F.transform(begun, cuts))
    return F.array_distinct(F.filter(F.transform(F.concat(begun, ended), lambda v: F.trim(v)), lambda v: v != ""))


# --- builders: tables (key, at, record) -----------------------------------------------------------------------------------------


def official_names(raw: DataFrame) -> DataFrame:
    """(key, at, which, name, lat, lon, province, kind, rel) of a register (at, name, lat, lon, province, term, category, relevance).

    ``at`` is the order of the register; names are kept by their term and relevance, under themselves and without a number or the word for a
    reserve at their end.
    """
    rel = F.coalesce("relevance", F.lit(0)).cast("long")
    least = _of(V.KEEP_TERMS, F.col("term"))
    kept = raw.where(F.when(least.isNotNull(), rel >= least).otherwise(F.coalesce(F.col("category") == V.KEEP_CATEGORY, F.lit(False))))
    short = F.regexp_replace("name", r"[\s\p{Z}]+(\d+[A-Z]?|First Nation|Indian Reserve|No\. ?\d+)$", "")
    keys = F.filter(F.array(F.struct(F.lit(0).alias("which"), F.lower("name").alias("key")), F.struct(F.lit(1).alias("which"), F.when((short != F.col("name")) & (F.length(short) > 3), F.lower(short)).alias("key"))), lambda k: k["key"].isNotNull())
    kind = F.coalesce(_of(V.KIND_OF_TERM, F.col("term")), F.lit("locality"))
    return kept.select("at", F.explode(keys).alias("k"), "name", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"), "province", kind.alias("kind"), rel.alias("rel")).select("k.key", "at", "k.which", "name", "lat", "lon", "province", "kind", "rel")


def official_index(names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records by every key, folded and shorter forms included, and (squashed, key) of the names that hashtags run together.

    A key of the register itself wins over a form of another key; among forms, that of the first key in the register.
    """
    own = names.groupBy("key").agg(F.min(F.struct("at", "which")).alias("first"), F.max("rel").alias("rel"), F.bool_or(F.col("kind") == "first_nation").alias("nation"))
    longer = F.filter(F.slice(variants(F.col("key")), 2, 100), lambda v: F.length(v) > 3)
    forms = own.withColumn("form", F.explode(F.concat(F.array(T.fold(F.col("key"))), longer))).where(F.col("form") != F.col("key"))
    forms = forms.join(own.select(F.col("key").alias("form")), "form", "left_anti").groupBy("form").agg(F.min_by("key", F.struct("first", "key")).alias("key"))
    under = names.join(small_or_shuffled(forms), "key").select(F.col("form").alias("key"), *[c for c in names.columns if c != "key"])
    joined = own.where((F.col("rel") >= V.RUN_TOGETHER) | F.col("nation")).select("key", "first", F.explode(variants(F.col("key"))).alias("v")).select("key", "first", T.squash(F.col("v")).alias("squashed"))
    return names.unionByName(under), joined.groupBy("squashed").agg(F.min_by("key", F.struct("first", "key")).alias("key"))


def feature_index(features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, at, name, kind, points) of mapped features (at, name, kind, points), a point (lat, lon), and (squashed, key).

    Quadrants at the end of a name go; name and kind of a key are those of its first feature, its points those of all.
    """
    base = F.regexp_replace("name", _QUADRANT, "")
    keys = F.array_distinct(F.concat(F.array(F.lower("name"), F.lower(base)), F.slice(variants(base), 2, 100)))
    keys = F.filter(keys, lambda k: (F.length(k) >= 4) & ~k.isin(V.STOP))
    index = features.select(F.explode(keys).alias("key"), "at", base.alias("name"), "kind", "points")
    joined = index.where(F.contains("key", F.lit(" ")) | F.contains("key", F.lit("'"))).select(T.squash(F.col("key")).alias("squashed"), "key", "at")
    return index, joined.groupBy("squashed").agg(F.min_by("key", F.struct("at", "key")).alias("key"))


def world_index(cities: DataFrame, states: DataFrame, countries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, tier, at, name, lat, lon, cc, state, pop, kind, is_alt); (squashed, key); (cc, name, lat, lon, continent).

    Cities: (at, name, ascii, others, lat, lon, cc, state_code, pop), ``others`` an array of spellings, used of large cities alone and marked.
    States: (at, code, name, ascii), codes as "CC.STATE". Countries: (at, cc, name, continent). Centres of states and countries are means
    of their cities, weighted by the root of their people. Aliases stand before countries, these before states, these before cities.
    """
    code = F.concat("cc", F.lit("."), "state_code")
    named = states.select(F.col("code").alias("_code"), F.col("name").alias("state"))
    c = cities.join(small_or_shuffled(named), code == F.col("_code"), "left").withColumn("state", F.coalesce("state", F.lit(""))).withColumn("pop", F.coalesce("pop", F.lit(0)).cast("long"))
    own = F.array_distinct(F.array(F.lower("name"), F.lower("ascii")))
    spelled = F.when(F.col("pop") >= V.SPELLED, F.array_distinct(F.transform(F.filter(F.coalesce("others", F.array().cast("array<string>")), lambda o: o.rlike(_SPELLING)), F.lower))).otherwise(F.array().cast("array<string>"))
    keys = F.concat(F.transform(own, lambda k: F.struct(k.alias("key"), F.lit(False).alias("is_alt"))), F.transform(F.array_except(spelled, own), lambda k: F.struct(k.alias("key"), F.lit(True).alias("is_alt"))))
    record = lambda df, tier, kind, cc, state: df.select("key", F.lit(tier).alias("tier"), "at", "name", "lat", "lon", cc.alias("cc"), state.alias("state"), F.lit(0).cast("long").alias("pop"), F.lit(kind).alias("kind"), F.lit(False).alias("is_alt"))
    towns = c.select(F.explode(keys).alias("k"), F.lit(3).alias("tier"), "at", "name", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "cc", "state", "pop").select("k.key", "tier", "at", "name", "lat", "lon", "cc", "state", "pop", F.lit("city").alias("kind"), "k.is_alt")
    w = F.sqrt(F.greatest("pop", F.lit(1)))
    centre = lambda by: c.groupBy(by.alias("by")).agg(F.round(F.sum(F.col("lat") * w) / F.sum(w), 3).alias("lat"), F.round(F.sum(F.col("lon") * w) / F.sum(w), 3).alias("lon"))
    s = states.join(centre(code), F.col("code") == F.col("by")).withColumn("at", -F.col("at"))  # a later one was put in front
    s = record(s.withColumn("key", F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("ascii"))))), 2, "admin1", F.regexp_extract("code", r"^[^.]*", 0), F.col("name"))
    own_countries = countries.join(centre(F.col("cc")), F.col("cc") == F.col("by")).select("at", "cc", "name", "lat", "lon", "continent")
    n = record(own_countries.withColumn("key", F.lower("name")).withColumn("at", -F.col("at")), 1, "country", F.col("cc"), F.lit(""))
    aliases = small_table(cities.sparkSession, [(-i, k, cc) for i, (k, cc) in enumerate(V.COUNTRY_ALIASES.items())], "_at long, key string, _cc string")
    a = record(own_countries.join(F.broadcast(aliases), F.col("cc") == F.col("_cc")).withColumn("at", F.col("_at")), 0, "country", F.col("cc"), F.lit(""))
    index = towns.unionByName(s).unionByName(n).unionByName(a)
    joined = index.where(F.contains("key", F.lit(" "))).groupBy("key").agg(F.bool_or((F.col("kind") != "city") | (F.col("pop") >= V.SIZEABLE)).alias("large"), F.min(F.struct("tier", "at")).alias("first")).where("large")
    joined = joined.groupBy(T.squash(F.col("key")).alias("squashed")).agg(F.min_by("key", F.struct("first", "key")).alias("key"))
    return index, joined, own_countries.drop("at")


# --- lookups ----------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Context:
    """Where and how names are resolved: ``centre`` of the event, if there is one, and ``anchor``, the place most spoken of."""

    centre: tuple[float, float] | None = None
    anchor: tuple[float, float] | None = None
    canada: bool = True
    world: bool = False
    region_cc: str | None = None
    max_km: float = V.MAX_KM

    @property
    def own_cc(self) -> str | None:
        return self.region_cc or ("CA" if self.canada else None)


@dataclass(frozen=True)
class Sources:
    """Written tables; a source that is None has no names."""

    official: DataFrame | None = None
    features: DataFrame | None = None
    world: DataFrame | None = None
    countries: DataFrame | None = None
    run_together: DataFrame | None = None  # (squashed, key, rank): features, then the register, then the world

    def seen_by(self, c: Context) -> Sources:
        """The sources that a context uses; features are sought near an anchor alone."""
        near = bool(c.anchor or c.centre)
        ranks = ["features"] * near + ["official"] * c.canada + ["world"] * c.world
        run = self.run_together.where(F.col("source").isin(ranks)) if self.run_together is not None else None
        return Sources(self.official if c.canada else None, self.features if near else None, self.world if c.world else None, self.countries if c.world else None, run)


def sources(official: DataFrame | None = None, features: DataFrame | None = None, world: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> Sources:
    """Build and write the indexes: a register, mapped features, and cities, states and countries."""
    made, run = {}, []
    if official is not None:
        index, joined = official_index(written(official_names(official), "register"))
        made["official"] = written(index, "official")
        run.append(joined.withColumn("source", F.lit("official")).withColumn("rank", F.lit(1)))
    if features is not None:
        index, joined = feature_index(features)
        made["features"] = written(index, "features")
        run.append(joined.withColumn("source", F.lit("features")).withColumn("rank", F.lit(0)))
    if world is not None:
        index, joined, countries = world_index(*world)
        made["world"], made["countries"] = written(index, "world"), written(countries, "countries")
        run.append(joined.withColumn("source", F.lit("world")).withColumn("rank", F.lit(2)))
    together = run[0] if run else None
    for r in run[1:]:
        together = together.unionByName(r)
    return Sources(**made, run_together=None if together is None else written(together, "run-together"))


def _km(lat, lon, at: tuple[float, float]) -> Column:
    return haversine(lat, lon, F.lit(at[0]), F.lit(at[1]))


def _place(source: str, name, lat, lon, kind, precision, province, cc, pop=None, rel=None) -> Column:
    col = lambda x: F.lit(None) if x is None else x
    return F.struct(name.alias("name"), lat.alias("lat"), lon.alias("lon"), kind.alias("kind"), F.lit(source).alias("source"), precision.alias("precision"), col(province).alias("province"), col(cc).alias("cc"), col(pop).alias("pop"), col(rel).alias("rel")).cast(PLACE)


def _precision(kind: Column, other: str) -> Column:
    return F.coalesce(_of(V.PRECISION, kind), F.lit(other))


def _with_each_form(asked: DataFrame, target: Column) -> DataFrame:
    """(id, cc, k, folded): each key as it is and, where that differs, folded."""
    forms = F.array_distinct(F.array(F.struct(target.alias("k")), F.struct(T.fold(target).alias("k"))))
    return asked.select("id", "cc", F.posexplode(forms).alias("folded", "f")).select("id", "cc", "f.k", "folded")


def best_feature(asked: DataFrame, index: DataFrame, c: Context) -> DataFrame:
    """(id, place): of all points of a name the one nearest the anchor, under the name and kind of the first feature."""
    anchor = c.anchor or c.centre
    near = F.array_min(F.transform("points", lambda p: F.struct(_km(p.lat, p.lon, anchor).alias("km"), p.lat.alias("lat"), p.lon.alias("lon"))))
    hit = asked.join(as_small_as(index.withColumn("near", near).drop("points"), index), F.col("k") == F.col("key"))
    # the key itself is tried before its folded form
    each = hit.groupBy("id", "folded").agg(F.min_by(F.struct("name", "kind"), "at").alias("f"), F.min(F.struct("near.km", "at", "near.lat", "near.lon")).alias("p"))
    best = each.groupBy("id").agg(F.min_by(F.struct("f", "p"), "folded").alias("b"))
    return best.select("id", _place("osm", F.col("b.f.name"), F.col("b.p.lat"), F.col("b.p.lon"), F.col("b.f.kind"), _precision(F.col("b.f.kind"), "point"), None, F.lit(c.own_cc)).alias("feature"))


def best_official(asked: DataFrame, index: DataFrame, c: Context) -> DataFrame:
    """(id, near, wide): the register's best record by distance and relevance where an event has a centre, else by relevance alone."""
    hit = asked.where("cc is null or cc = 'CA'").join(small_or_shuffled(index), F.col("k") == F.col("key"))
    record = F.struct("name", "lat", "lon", "kind", "province", "rel")
    place = lambda r: _place("cgndb", r["name"], r["lat"], r["lon"], r["kind"], _precision(r["kind"], "locality"), r["province"], F.lit("CA"), None, r["rel"])
    if c.centre:
        km = _km(F.col("lat"), F.col("lon"), c.centre)
        score = km - V.KM_PER_TENFOLD * F.log10(F.greatest("rel", F.lit(1)))
        best = hit.groupBy("id").agg(F.min_by(F.struct(record.alias("r"), km.alias("km")), F.struct(F.col("folded"), score, F.col("at"), F.col("which"))).alias("b"))
        return best.where((F.col("b.km") <= c.max_km) | (F.col("b.r.rel") >= V.MAJOR)).select("id", place(F.col("b.r")).alias("near"), F.lit(None).cast(PLACE).alias("wide"))
    enough = (F.col("rel") >= V.SIGNIFICANT) | (F.col("kind") == "first_nation") if c.world else F.lit(True)
    first = hit.groupBy("id").agg(F.min("folded").alias("folded"))
    best = hit.join(first, ["id", "folded"]).where(enough).groupBy("id").agg(F.max_by(record, F.struct("rel", -F.col("at"), -F.col("which"))).alias("r"))
    return best.select("id", F.lit(None).cast(PLACE).alias("near"), place(F.col("r")).alias("wide"))


def best_world(asked: DataFrame, index: DataFrame, c: Context) -> DataFrame:
    """(id, world) of (id, k, cc): proper names before other spellings, the hinted country first, then by distance and size, or by rank and size."""
    hit = asked.join(as_small_as(index.withColumnRenamed("cc", "own"), index), F.col("k") == F.col("key"))
    record = F.struct("name", "lat", "lon", "own", "state", "pop", "kind")
    other = ~F.coalesce(F.col("own") == F.upper("cc"), F.lit(False))
    if c.centre:
        km = _km(F.col("lat"), F.col("lon"), c.centre)
        people = F.when(F.col("kind") == "city", F.col("pop")).otherwise(V.REGION_PEOPLE)
        score = km - V.KM_PER_TENFOLD * F.log10(F.greatest(people, F.lit(1000)))
        best = hit.groupBy("id").agg(F.min_by(F.struct(record.alias("r"), km.alias("km")), F.struct("is_alt", other, score, "tier", "at")).alias("b"))
        best = best.where(~((F.col("b.km") > c.max_km) & (F.col("b.r.kind") == "city") & (F.col("b.r.pop") < V.GREAT_CITY))).select("id", "b.r")
    else:
        rank = F.when(F.col("kind") == "country", 3.0).when(F.col("kind") == "admin1", 2.0).when(F.col("pop") >= V.GREAT_CITY, 2.5).otherwise(1.0)
        best = hit.groupBy("id").agg(F.min_by(record, F.struct("is_alt", other, -rank, -F.col("pop"), "tier", "at")).alias("r"))
    kind = F.when(F.col("r.kind") == "admin1", "state").otherwise(F.col("r.kind"))
    precision = F.when(F.col("r.kind") == "country", "region").when(F.col("r.kind") == "admin1", "state").otherwise("locality")
    return best.select("id", _place("geonames", F.col("r.name"), F.col("r.lat"), F.col("r.lon"), kind, precision, F.when(F.col("r.state") != "", F.col("r.state")), F.col("r.own"), F.col("r.pop")).alias("world"))


def looked_up(pairs: DataFrame, names: Sources, c: Context) -> DataFrame:
    """(key, cc, place, plain) of distinct pairs (key, cc): what a key stands for exactly as it is, and what the sources alone say.

    In order: short names of the register's country lead to full ones; short names of regions; peoples; provinces; mapped features nearest the anchor;
    the register near the centre; the world; the register without a centre.
    """
    spark, names = pairs.sparkSession, names.seen_by(c)
    target = F.coalesce(F.lower(_of(V.ALIASES, F.col("key"))), F.col("key")) if c.canada else F.col("key")
    pairs = pairs.select("key", "cc").distinct()
    # each key is sought in the sources once, whether asked for itself or as what a short name leads to
    each = pairs.union(pairs.select(target, "cc")).distinct() if c.canada else pairs
    asked = written(each.withColumn("id", F.monotonically_increasing_id()), "asked")
    forms = _with_each_form(asked, F.col("key"))
    found = asked
    if names.features is not None:
        found = found.join(best_feature(forms, names.features, c), "id", "left")
    if names.official is not None:
        found = found.join(best_official(forms, names.official, c), "id", "left")
    if names.world is not None:
        found = found.join(best_world(forms.groupBy("id", "cc").agg(F.max_by("k", "folded").alias("k")), names.world, c), "id", "left")
    tiers = [F.col(t) for t in ("feature", "near", "world", "wide") if t in found.columns] or [F.lit(None).cast(PLACE)]
    found = written(found.select("key", "cc", F.coalesce(*tiers).alias("plain")), "found")
    at_target = as_small_as(found.select(F.col("key").alias("target"), F.col("cc").alias("_target_cc"), F.col("plain").alias("whole")), found)
    out = found.withColumn("target", target).alias("f").join(at_target.alias("t"), (F.col("f.target") == F.col("t.target")) & F.col("f.cc").eqNullSafe(F.col("t._target_cc")), "left").select("f.*", "whole")
    whole = F.when(F.lit(False), F.lit(None).cast(PLACE))
    if names.world is not None:
        regions = small_table(spark, [(k, n.lower(), cc) for k, (n, cc) in V.REGION_ALIASES.items()], "id string, k string, cc string")
        region = best_world(regions, names.world, c).select(F.col("id").alias("_region"), F.col("world").alias("_by_region"))
        peoples = small_table(spark, list(V.DEMONYMS.items()), "_people string, _cc string").join(small_or_shuffled(names.countries), F.col("_cc") == F.col("cc"))
        peoples = peoples.select("_people", _place("geonames", F.col("name"), F.col("lat"), F.col("lon"), F.lit("country"), F.lit("region"), None, F.col("_cc")).alias("_by_people"))
        # both tables are as short as the fixed ones they come from
        out = out.join(F.broadcast(region), F.col("target") == F.col("_region"), "left").join(F.broadcast(peoples), F.col("target") == F.col("_people"), "left")
        whole = whole.when(F.col("target").isin(list(V.REGION_ALIASES)), F.col("_by_region")).when(F.col("_by_people").isNotNull(), F.col("_by_people"))
    if c.canada:
        full = {p.lower(): p for p in V.PROVINCES}
        name = _of(full, F.col("target"))
        at = lambda i: _of({p: V.PROVINCES[p][i] for p in V.PROVINCES}, name)
        whole = whole.when(name.isNotNull(), _place("alias", name, at(0), at(1), F.lit("province"), F.lit("region"), name, F.lit("CA")))
    return out.select("key", "cc", whole.otherwise(F.col("whole")).alias("place"), "plain")


def known_keys(names: Sources, c: Context, spark: SparkSession) -> DataFrame:
    """Every key that a source of the context, or a fixed table, has."""
    names = names.seen_by(c)
    fixed = (list(V.ALIASES) + [p.lower() for p in V.PROVINCES]) * c.canada + (list(V.REGION_ALIASES) + list(V.DEMONYMS)) * (names.world is not None)
    out = small_table(spark, [(k,) for k in fixed], "key string")
    for index in (names.official, names.features, names.world):
        if index is not None:
            out = out.union(index.select("key"))
    return out.where("key <> ''").distinct()


def resolved(mentions: DataFrame, names: Sources, c: Context, row_id: str = "id", name: str = "name", cc: str | None = None) -> DataFrame:
    """The mentions with ``place``: the first of a name's variants that stands for a place, else a region after a word of direction, else the name
    run together; null for names too broad. Each distinct pair of name and country is worked out once; names that hold many mentions are
    joined back salted.
    """
    hint = F.upper(cc) if cc else F.lit(None).cast("string")
    rows = mentions.withColumn("_pair", F.when(F.col(name).isNotNull(), F.to_json(F.struct(F.col(name).alias("n"), hint.alias("c")))))
    each = written(rows.where("_pair is not null").groupBy("_pair", F.col(name).alias("n"), hint.alias("cc")).agg(F.count("*").alias("_n")), "named")
    key = F.translate(F.lower(F.trim(F.col("n"))), "’", "'")
    as_try = lambda k, region: F.struct(k.alias("key"), F.lit(region).alias("region"))
    rest = F.regexp_extract(key, rf"^(?:{'|'.join(V.DIRECTIONS)})[\s\p{{Z}}]+(.+)$", 1)
    tries = F.concat(F.transform(variants(key), lambda k: as_try(k, False)), F.array(as_try(rest, True)))
    asked = each.where(~key.isin(V.TOO_BROAD))
    tried = asked.select("_pair", "cc", F.posexplode(tries).alias("at", "t")).select("_pair", "cc", "at", "t.*").where("key <> ''")
    together = names.seen_by(c).run_together
    if together is not None:
        first = together.groupBy("squashed").agg(F.min_by("key", "rank").alias("key"))
        run = asked.select("_pair", "cc", T.squash(key).alias("squashed")).join(small_or_shuffled(first), "squashed")
        tried = tried.unionByName(run.select("_pair", "cc", F.lit(1000).alias("at"), "key", F.lit(False).alias("region")))
    tried = written(tried, "tries")
    hits = looked_up(tried.select("key", "cc"), names, c).where("place is not null").select(F.col("key").alias("_k"), F.col("cc").alias("_c"), "place")
    hit = tried.join(hits, (F.col("key") == F.col("_k")) & F.col("cc").eqNullSafe(F.col("_c"))).where("not region or place.precision = 'region'")
    best = hit.groupBy("_pair").agg(F.min_by("place", "at").alias("place"))
    groups = written(each.select("_pair", "_n").join(best, "_pair", "left"), "resolved")
    out = join_on_hot_key(rows, groups, "_pair", "_n", ["place"], F.xxhash64(row_id)).drop("_pair")
    forget(each)
    return out


def places_of_labels(rows: DataFrame, names: Sources, c: Context, row_id: str = "id", label_names: str = "label_places", cc: str = "cc", answers: DataFrame | None = None, lookups: int = 0) -> DataFrame:
    """(row, more): the places that the names of a label stand for, in order, each once; names too broad stand for none.

    The label's country is a hint. Of the names that stand for nothing the first ``lookups``, in order of rows and names, are taken from
    ``answers`` (name, place) of a geocoder.
    """
    each = rows.select(row_id, F.upper(cc).alias("hint"), F.posexplode(label_names).alias("at", "name")).where(F.trim("name") != "").withColumn("_row", F.xxhash64(row_id, "at"))
    found = resolved(each, names, c, "_row", "name", "hint")
    if answers is not None and lookups:
        found = written(found, "named-places")
        asked = found.where(F.col("place").isNull() & ~F.lower(F.trim("name")).isin(V.TOO_BROAD)).orderBy(row_id, "at").limit(lookups).select(F.col(row_id).alias("_i"), F.col("at").alias("_at"), F.col("name").alias("_name"))
        told = answers.groupBy(F.col("name").alias("_name")).agg(F.min("place").cast(PLACE).alias("_told"))
        told = asked.join(told, "_name").select("_i", "_at", "_told")
        found = found.join(F.broadcast(told), (F.col(row_id) == F.col("_i")) & (F.col("at") == F.col("_at")), "left").withColumn("place", F.coalesce("place", "_told"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "name", "place")))
    got = found.where("place is not null").groupBy(row_id).agg(ordered.alias("s"))
    once = F.filter("s", lambda x, i: F.array_position(F.transform("s", lambda y: y.place["name"]), x.place["name"]) == i + 1)
    return got.select(row_id, F.transform(once, lambda x: F.struct(x["name"].alias("span"), x.place.alias("place"))).alias("more"))
