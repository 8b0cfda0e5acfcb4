"""What a set of posts is about: one event or the whole world, its region, and the gazetteer that fits.

A first extraction, without a centre, says which countries and places are spoken of; the region worked out from it is what the second
extraction resolves names by. What comes to the driver are a dozen countries and at most ten places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators import extraction, names
from emberline.operators.gazetteer import haversine, snapped_box
from emberline.session import forget, written

# fixed values: share of a country under which, or number of countries with the second share from which, posts are about the world
ONE_EVENT, LARGE, MANY = 0.6, 0.08, 3
# fixed values: kilometres beyond which places are not of one region; places that a region is made of; countries told
FAR_KM, TOP, COUNTRIES = 300.0, 5, 12


@dataclass(frozen=True)
class Region:
    """Mode "single" or "global"; without a centre nothing is known of the place of an event."""

    mode: str
    country: str | None = None
    centre: tuple[float, float] | None = None
    anchor: tuple[float, float] | None = None
    box: tuple[float, float, float, float] | None = None
    foreign: bool = False
    top: tuple[tuple[str, int], ...] = ()

    def context(self) -> names.Context:
        if self.mode == "global":
            return names.Context(world=True)
        return names.Context(centre=self.centre, anchor=self.anchor, canada=not self.foreign, world=True, region_cc=self.country)


def place_rows(found: DataFrame, row_id: str = "post_id") -> DataFrame:
    """(row, name, lat, lon, precision, source, cc) of extracted places."""
    return found.select(row_id, F.explode("places.place").alias("p")).select(row_id, *[F.col(f"p.{c}").alias(c) for c in ("name", "lat", "lon", "precision", "source", "cc")])


def country_shares(places: DataFrame, row_id: str = "post_id") -> DataFrame:
    """(cc, n, share, place): the countries that most rows speak of, each with its share of all that rows speak of, to three digits."""
    per = places.where("cc is not null").select(row_id, "cc").distinct().groupBy("cc").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n").alias("total"))  # one row
    ranked = per.orderBy(F.desc("n"), "cc").limit(COUNTRIES)
    return ranked.crossJoin(F.broadcast(total)).select("cc", "n", F.round(F.col("n") / F.col("total"), 3).alias("share"))


def is_global(shares: list[float]) -> bool:
    """Whether shares, the largest first, are those of posts about the world."""
    return bool(shares) and (shares[0] < ONE_EVENT or sum(s >= LARGE for s in shares) >= MANY)


def top_places(places: DataFrame, k: int, by: list[str]) -> list:
    """The k places that are named most, with how often; equals by name."""
    return places.groupBy(*by).agg(F.count("*").alias("n"), F.min(F.struct("lat", "lon")).alias("at")).orderBy(F.desc("n"), *by).limit(k).collect()


def centre_of(spark: SparkSession, top: list, anchor: tuple[float, float], fall_back: bool) -> tuple[tuple[float, float], tuple]:
    """The weighted centre of places (n, at), and the box around it. Far from the anchor, the centre is the anchor (``fall_back``), or far places do not count."""
    rows = spark.createDataFrame([(r["n"], r["at"]["lat"], r["at"]["lon"]) for r in top], "n long, lat double, lon double")
    away = lambda: haversine(F.lit(anchor[0]), F.lit(anchor[1]), F.col("lat"), F.col("lon"))
    if not fall_back:
        rows = rows.where(away() < FAR_KM)
    mean = lambda c: (F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c)
    c = rows.agg(mean("lat"), mean("lon"))
    if fall_back:
        at = lambda name, i: F.when(away() > FAR_KM, F.lit(anchor[i])).otherwise(F.col(name)).alias(name)
        c = c.select(at("lat", 0), at("lon", 1))
    r = c.select(F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), snapped_box(F.col("lat"), F.col("lon")).alias("box")).first()
    return (r["lat"], r["lon"]), tuple(r["box"])


def home_region(places: DataFrame) -> Region:
    """The region of an event in the register's country, from the localities that its extraction without a centre gave."""
    top = top_places(places.where("precision = 'locality' and source <> 'osm'"), TOP, ["name"])
    if not top:
        return Region("single")
    anchor = (top[0]["at"]["lat"], top[0]["at"]["lon"])
    centre, box = centre_of(places.sparkSession, top, anchor, True)
    # far from the centre of all, the anchor itself is the centre, as it is
    return Region("single", "CA", centre, anchor, box, False, tuple((r["name"], r["n"]) for r in top))


def foreign_region(places: DataFrame, country: str) -> Region:
    """The region of an event elsewhere: those of the ten places named most that lie in the country, near the first of them."""
    top = [r for r in top_places(places.where("precision = 'locality' and cc is not null"), 10, ["name", "cc"]) if r["cc"] == country]
    if not top:
        return Region("single")
    anchor = (top[0]["at"]["lat"], top[0]["at"]["lon"])
    centre, box = centre_of(places.sparkSession, top, anchor, False)
    return Region("single", country, centre, anchor, box, True, tuple((r["name"], r["n"]) for r in top[:TOP]))


def region_of(posts: DataFrame, sources: names.Sources, common: DataFrame, row_id: str = "post_id", text: str = "text") -> Region:
    """The region that the posts are about, by an extraction over the world and, for the register's country, one by the register alone."""
    world = extraction.gazetteer(sources, names.Context(world=True), common)
    found = extraction.extracted(posts, world, row_id, text)
    said = written(place_rows(found, row_id), "said")
    forget(found)
    shares = country_shares(said, row_id).collect()
    if is_global([r["share"] for r in shares]):
        return Region("global")
    country = shares[0]["cc"] if shares else None
    if country not in (None, "CA"):
        return foreign_region(said, country)
    home = extraction.gazetteer(sources, names.Context(), common)
    found = extraction.extracted(posts, home, row_id, text)
    out = home_region(place_rows(found, row_id))
    forget(found)
    return out


def gazetteer_for(region: Region, sources: names.Sources, common: DataFrame) -> extraction.Gazetteer:
    """The gazetteer that fits a region."""
    return extraction.gazetteer(sources, region.context(), common)


def voted_country(given: Column, spans: Column, region: Region) -> Column:
    """The country given, if it has two letters; else that of most places, a region counting half; else that of a single event."""
    codes = F.array_distinct(F.filter(F.transform(spans, lambda x: x.place.cc), lambda c: c.isNotNull()))
    votes = F.transform(codes, lambda c, i: F.struct(F.aggregate(spans, F.lit(0), lambda a, x: a + F.when(x.place.cc == c, F.when(x.place.precision == "region", 1).otherwise(2)).otherwise(0)).alias("n"), (-i).alias("at"), c.alias("cc")))
    event = F.lit(region.country if region.mode == "single" else None).cast("string")
    return F.coalesce(F.when(F.length(given) == 2, F.upper(given)), F.array_max(votes).cc, event)
