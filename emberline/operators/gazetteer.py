"""Geometry of places, mapped features, and what places together tell: countries, modes, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators import place_values as V
from emberline.operators.skew import small_or_shuffled

EARTH_KM = 6371.0
ADMIN = ["country", "state", "province"]


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def snapped_box(lat: Column, lon: Column) -> Column:
    """South, west, north, east around a centre on a quarter-degree grid."""
    y, x = F.bround(lat * 4) / 4, F.bround(lon * 4) / 4
    return F.struct((y - 1.0).alias("s"), (x - 1.75).alias("w"), (y + 1.0).alias("n"), (x + 1.75).alias("e"))


def kind_of_tags(tags: str) -> Column:
    """The kind of a mapped feature from its tags, by the first rule that holds."""
    t = lambda k: F.try_element_at(tags, F.lit(k))
    # fixed values: the rules in their order
    rules = [
        (t("place").isNotNull(), t("place")),
        (t("boundary") == "administrative", "neighbourhood"),
        (t("waterway").isNotNull(), "river"),
        ((t("bridge") == "yes") | (t("man_made") == "bridge"), "bridge"),
        (t("highway").isNotNull(), "road"),
        (t("leisure") == "park", "park"),
        (t("boundary") == "aboriginal_lands", "first_nation"),
        (t("leisure").isin("stadium", "sports_centre"), "landmark"),
        *[(t(k).isNotNull(), "landmark") for k in ("amenity", "tourism", "landuse", "shop")],
    ]
    out = F.lit("other")
    for holds, kind in reversed(rules):
        out = F.when(F.coalesce(holds, F.lit(False)), kind).otherwise(out)
    return out


def feature_names(features: DataFrame, most_points: int = 1500) -> DataFrame:
    """(at, name, kind, points) of features (feature_id, tags, lat, lon): under their name, its parts at slashes, and their old, alternative and short names.

    Kind and order of a name are those of its first feature; its points are those of the first ``most_points``. Features without a name or a place have none.
    """
    t = lambda k: F.coalesce(F.try_element_at("tags", F.lit(k)), F.lit(""))
    cut = lambda c, by: F.transform(F.split(c, by), lambda x: F.trim(x))
    others = F.filter(F.flatten(F.array(*[cut(t(k), ";") for k in ("old_name", "alt_name", "short_name")])), lambda x: x != "")
    parts = F.when(F.contains(t("name"), F.lit("/")), F.filter(cut(t("name"), "/"), lambda x: F.length(x) > 3)).otherwise(F.array().cast("array<string>"))
    named = features.where((t("name") != "") & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    e = named.select("feature_id", kind_of_tags("tags").alias("kind"), F.struct(F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon")).alias("point"), F.explode(F.concat(F.array(t("name")), others, parts)).alias("name"))
    # a name of very many features keeps its first ones: they are counted out before they meet
    nth = F.row_number().over(Window.partitionBy("name").orderBy("feature_id"))
    e = e.withColumn("_n", nth).where(F.col("_n") <= most_points)
    points = F.transform(F.array_sort(F.collect_list(F.struct("feature_id", "point"))), lambda x: x.point)
    return e.groupBy("name").agg(F.min("feature_id").alias("at"), F.min_by("kind", "feature_id").alias("kind"), points.alias("points")).select("at", "name", "kind", "points")


def with_rivers(names: DataFrame, ways: DataFrame, step: int = 8, most_points: int = 1500) -> DataFrame:
    """``names`` with rivers (way_id, name, points) by every ``step``-th vertex of their ways in place of what stood under their names."""
    sampled = ways.where(F.col("name").isNotNull()).withColumn("points", decimated("points", step, 1 << 30))
    points = F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("way_id", "points"))), lambda x: x.points)), 1, most_points)
    rivers = sampled.groupBy("name").agg(F.min("way_id").alias("way"), points.alias("points"))
    told = names.join(rivers.select("name", F.col("points").alias("_p")), "name", "left")
    kept = told.select("at", "name", F.when(F.col("_p").isNotNull(), "river").otherwise(F.col("kind")).alias("kind"), F.coalesce("_p", "points").alias("points"))
    new = rivers.join(names.select("name"), "name", "left_anti").select((F.lit(1 << 62) + F.col("way")).alias("at"), "name", F.lit("river").alias("kind"), "points")
    return kept.unionByName(new)


def decimated(points: str, step: int = 8, most: int = 1500) -> Column:
    return F.slice(F.filter(points, lambda x, i: i % step == 0), 1, most)


def member_names(relations: DataFrame, ways: DataFrame) -> DataFrame:
    """Ways with their own name, else that of the first relation that has them."""
    m = relations.select("relation_id", "name", F.posexplode("members").alias("at", "way_id")).groupBy("way_id").agg(F.min_by("name", F.struct("relation_id", "at")).alias("_n"))
    return ways.join(m, "way_id", "left").withColumn("name", F.coalesce("name", "_n")).drop("_n")


def nearest(mentions: DataFrame, candidates: DataFrame, on: str, lat: float, lon: float, weight: str = "size") -> DataFrame:
    """Of each mention's candidates the one with the least distance less 60 times the logarithm of its size."""
    d = haversine(F.lit(lat), F.lit(lon), F.col("lat"), F.col("lon")) - 60 * F.log10(F.greatest(F.col(weight), F.lit(1)))
    c = candidates.withColumn("_d", d)
    return mentions.join(c, on).groupBy(*mentions.columns).agg(F.min_by(F.struct("place_id", "name", "lat", "lon", "_d"), F.struct("_d", "place_id")).alias("b")).select(*mentions.columns, "b.place_id", "b.name", "b.lat", "b.lon", F.col("b._d").alias("score"))


def by_priority(candidates: DataFrame, mention: list[str]) -> DataFrame:
    """The candidate of the first source that has one."""
    return candidates.groupBy(*mention).agg(F.min_by(F.struct("source", "place_id"), F.struct("priority", "place_id")).alias("b")).select(*mention, "b.*")


def in_world(candidates: DataFrame, mention: list[str], cc: str | None = None) -> DataFrame:
    """World candidates without a centre: primary names before alternatives, hinted country first, then countries, great cities,
    states, cities, then population."""
    rank = F.when(F.col("kind") == "country", 3.0).when((F.col("kind") == "city") & (F.col("pop") >= 1_000_000), 2.5).when(F.col("kind") == "state", 2.0).otherwise(1.0)
    hinted = (F.col("cc") == cc).cast("int") if cc else F.lit(0)
    best = F.max_by(F.struct("place_id", "name", "cc"), F.struct((~F.col("is_alt")).cast("int"), hinted, rank, "pop", -F.col("place_id")))
    return candidates.groupBy(*mention).agg(best.alias("b")).select(*mention, "b.*")


def consistent(places: str) -> Column:
    """Places of the leading country, of no country, administrative ones and great cities, where a country leads with two votes or more."""
    weight = lambda x: F.when(x.kind.isin(ADMIN), 2).otherwise(1)
    codes = F.array_sort(F.array_distinct(F.filter(F.transform(places, lambda x: x.cc), lambda c: c.isNotNull())))
    votes = F.transform(codes, lambda c: F.struct(F.aggregate(places, F.lit(0), lambda a, x: a + F.when(x.cc == c, weight(x)).otherwise(0)).alias("v"), (-F.array_position(F.transform(places, lambda x: x.cc), c)).alias("at"), c.alias("c")))
    top = F.array_max(votes)
    return F.when(top.v >= 2, F.filter(places, lambda x: x.cc.isNull() | (x.cc == top.c) | x.kind.isin(ADMIN) | (F.coalesce(x["pop"], F.lit(0)) >= 1_000_000))).otherwise(F.col(places))


def country_vote(rows: DataFrame, row_id: str = "id", event_cc: str | None = None) -> DataFrame:
    """The given code if it has two letters, else the vote of the places (1 a region, 2 others; first seen of equals), else the event's."""
    places = F.col("places")
    codes = F.array_distinct(F.filter(F.transform(places, lambda x: x.cc), lambda c: c.isNotNull()))
    votes = F.transform(codes, lambda c: F.struct(F.aggregate(places, F.lit(0), lambda a, x: a + F.when(x.cc == c, F.when(x.prec == "region", 1).otherwise(2)).otherwise(0)).alias("v"), (-F.array_position(codes, c)).alias("at"), c.alias("c")))
    given = F.when(F.length("cc") == 2, F.col("cc"))
    return rows.withColumn("voted_cc", F.coalesce(given, F.array_max(votes).c, F.lit(event_cc)))


def mode(mentions: DataFrame, row_id: str = "id") -> DataFrame:
    """(top_cc, top_share, is_global): shares of countries in all that rows speak of; global if the top has under 0.6 or three have 0.08."""
    per = mentions.where("cc is not null").select(row_id, "cc").distinct()
    n = per.groupBy("cc").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cc").limit(12)
    shares = n.crossJoin(F.broadcast(per.agg(F.count("*").alias("m")))).withColumn("share", F.round(F.col("n") / F.col("m"), 3))
    return shares.agg(F.max_by("cc", F.struct("n", F.col("share"))).alias("top_cc"), F.max("share").alias("top_share"), ((F.max("share") < 0.6) | (F.count_if(F.col("share") >= 0.08) >= 3)).alias("is_global"))


def centroid(mentions: DataFrame, k: int = 5) -> DataFrame:
    """Frequency-weighted centre of the k most frequent places."""
    top = mentions.groupBy("name").agg(F.count("*").alias("n"), F.min("lat").alias("lat"), F.min("lon").alias("lon")).orderBy(F.desc("n"), "name").limit(k)
    return top.agg((F.sum(F.col("lat") * F.col("n")) / F.sum("n")).alias("lat"), (F.sum(F.col("lon") * F.col("n")) / F.sum("n")).alias("lon"))


def region(mentions: DataFrame, anchor: tuple[float, float], k: int = 5, far_km: float = 300.0) -> DataFrame:
    """Centre and box of the event: the centroid, or the anchor if that is too far from it."""
    c = centroid(mentions, k).withColumn("far", haversine(F.lit(anchor[0]), F.lit(anchor[1]), F.col("lat"), F.col("lon")) > far_km)
    c = c.withColumn("lat", F.when(F.coalesce("far", F.lit(True)), F.lit(anchor[0])).otherwise(F.col("lat"))).withColumn("lon", F.when(F.coalesce("far", F.lit(True)), F.lit(anchor[1])).otherwise(F.col("lon")))
    return c.withColumn("box", snapped_box(F.col("lat"), F.col("lon"))).select("lat", "lon", "box.*")


def weighted_centers(rows: DataFrame, by: str, weight: str) -> DataFrame:
    w = F.sqrt(F.greatest(F.col(weight), F.lit(1)))
    return rows.groupBy(by).agg((F.sum(F.col("lat") * w) / F.sum(w)).alias("lat"), (F.sum(F.col("lon") * w) / F.sum(w)).alias("lon"))


def resolved_names(named: DataFrame, index: DataFrame, lookups: int, row_id: str = "id") -> DataFrame:
    """(key, source, place_id): distinct names by the index; of the others the first ``lookups``, in order of first occurrence, are geocoded."""
    first = named.withColumn("key", F.lower("name")).where(~F.col("key").isin(V.TOO_BROAD)).groupBy("key").agg(F.min(F.struct(row_id, "pos")).alias("at"))
    hit = first.join(small_or_shuffled(index.select("key", F.col("place.place_id").alias("place_id"))), "key", "left")
    known = hit.where("place_id is not null").select("key", F.lit("gazetteer").alias("source"), "place_id")
    asked = hit.where("place_id is null").orderBy("at", "key").limit(lookups).select("key", F.lit("geocoder").alias("source"), F.lit(None).cast("long").alias("place_id"))
    return known.union(asked)
