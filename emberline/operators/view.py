"""Filters over records, and the panels that show what they leave."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ViewSpec:
    """A conjunctive filter; None stands for no condition."""

    unique: bool = True
    relevance: str = "rel"  # rel, irr, unsure, all
    hazards: tuple[str, ...] | None = None
    countries: tuple[str, ...] | None = None
    categories: tuple[str, ...] | None = None
    urgencies: tuple[int, ...] | None = None
    places: tuple[str, ...] | None = None
    mapped_only: bool = False
    query: str = ""
    start: str | None = None
    end: str | None = None
    loose: bool = False  # the other front end: blank hazards pass, blank categories are not OTHER


def cat() -> Column:
    return F.when(F.coalesce(F.col("cat"), F.lit("")) == "", "OTHER").otherwise(F.col("cat"))


def hazard() -> Column:
    return F.when(F.coalesce(F.col("hz"), F.lit("")) == "", "FLOOD").otherwise(F.col("hz"))


def country() -> Column:
    return F.coalesce("cc", F.lit("??"))


def unsure() -> Column:
    return ((F.col("decided_by") == "local") & F.col("p").between(0.15, 0.85)) | (F.col("conf") < 0.5)


def conditions(spec: ViewSpec) -> dict[str, Column]:
    """The filter's parts by name."""
    yes = F.lit(True)
    relevance = {"rel": F.col("rel") == 1, "irr": F.col("rel") == 0, "unsure": unsure(), "all": yes}[spec.relevance]
    if spec.hazards is None:
        hz = yes
    elif spec.loose:
        hz = F.col("hz").isin(*spec.hazards) | (F.coalesce("hz", F.lit("")) == "")
    else:
        hz = (F.col("rel") == 0) | hazard().isin(*spec.hazards)
    out = {
        "unique": F.col("canon") if spec.unique else yes,
        "relevance": relevance,
        "hazard": hz,
        "country": yes if spec.countries is None or spec.loose else country().isin(*spec.countries),
        "category": yes if spec.categories is None else (F.col("cat") if spec.loose else cat()).isin(*spec.categories),
        "urgency": yes if spec.urgencies is None else F.col("urg").isin(*spec.urgencies),
        "query": yes if not spec.query else F.contains(F.lower("text"), F.lit(spec.query.lower())),
        "time": yes if spec.start is None or spec.loose else F.coalesce(F.col("ts").between(F.lit(spec.start).cast("timestamp_ntz"), F.lit(spec.end).cast("timestamp_ntz")), F.lit(False)),
    }
    if spec.places is not None:
        out["place"] = F.exists("places", lambda x: x["name"].isin(*spec.places))
    if spec.mapped_only:
        out["mapped"] = F.exists("places", lambda x: x.prec != "region")
    return out


def matches(spec: ViewSpec, skip: str | None = None) -> Column:
    out = F.lit(True)
    for name, c in conditions(spec).items():
        if name != skip:
            out = out & c
    return out


def facets(records: DataFrame, spec: ViewSpec) -> DataFrame:
    """(facet, value, n): each facet counted under all other conditions, in one scan; categories and hazards of relevant rows only."""
    parts = {"hazard": (hazard(), F.col("rel") == 1), "category": (cat(), F.col("rel") == 1), "country": (country(), F.lit(True)), "urgency": (F.col("urg").cast("string"), F.lit(True))}
    each = F.array(*[F.when(matches(spec, name) & own, F.struct(F.lit(name).alias("facet"), value.alias("value"))) for name, (value, own) in parts.items()])
    return records.select(F.explode(F.array_compact(each)).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("n"))


def facet_countries(records: DataFrame, spec: ViewSpec, k: int = 12) -> DataFrame:
    """The k most frequent countries, the unknown one behind all others, and those selected."""
    n = facets(records, spec).where("facet = 'country'").select("value", "n")
    top = n.orderBy(F.col("value") == "??", F.desc("n"), "value").limit(k)
    return top.union(n.where(F.col("value").isin(*(spec.countries or ())))).distinct()


def kpis(records: DataFrame, spec: ViewSpec) -> DataFrame:
    inside = matches(spec)
    count = lambda c: F.count_if(c).cast("long")
    return records.agg(F.count("*").alias("rows"), count(F.col("canon")).alias("uniq"), count(F.col("canon") & (F.col("rel") == 1)).alias("relevant"), count(F.col("canon") & (F.col("rel") == 1) & (hazard() == "FLOOD")).alias("floods"), count(inside).alias("in_view"), count(inside & F.exists("places", lambda x: x.prec != "region")).alias("mapped"), F.count_distinct(F.when(inside, F.col("cc"))).alias("countries"))


def with_places(records: DataFrame, places: DataFrame) -> DataFrame:
    """The records with their places in order."""
    each = places.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "lat", "lon", "prec", F.col("cc")))), lambda x: F.struct(x["name"].alias("name"), x.lat.alias("lat"), x.lon.alias("lon"), x.prec.alias("prec"), x.cc.alias("cc"))).alias("places"))
    none = F.array().cast("array<struct<name:string,lat:double,lon:double,prec:string,cc:string>>")
    return records.join(each, "id", "left").withColumn("places", F.coalesce("places", none))


def place_agg(records: DataFrame, spec: ViewSpec, regions: bool = False) -> DataFrame:
    e = records.where(matches(spec)).select("id", "urg", cat().alias("c"), F.explode("places").alias("x"))
    e = e if regions else e.where("x.prec <> 'region'")
    by = e.groupBy(F.col("x.name").alias("name")).agg(F.count("*").alias("n"), F.max("urg").alias("urg"), F.min_by("x.lat", "id").alias("lat"), F.min_by("x.lon", "id").alias("lon"), F.min_by("x.prec", "id").alias("prec"))
    return by.withColumn("radius", F.least(F.lit(34.0), 5 + 3.2 * F.sqrt("n")))


def dominant(rows: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """The most frequent value of each group; of equals the one seen first."""
    n = rows.groupBy(by, value).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    return n.groupBy(by).agg(F.max_by(value, F.struct("n", -F.col("at"), value)).alias(value), F.max("n").alias("n"))


def country_agg(records: DataFrame, spec: ViewSpec, centres: DataFrame) -> DataFrame:
    n = records.where(matches(spec) & (F.col("rel") == 1) & F.col("cc").isNotNull()).groupBy("cc").agg(F.count("*").alias("n"))
    return n.join(centres, "cc").withColumn("radius", F.least(F.lit(40.0), 7 + 2.2 * F.sqrt("n")))


def timeline_of(records: DataFrame, spec: ViewSpec) -> DataFrame:
    """The timeline of a view: unique rows if the view is of these, relevant ones if it is of these; ``seen`` counts what all filters leave."""
    own = conditions(spec)
    base = own["unique"] & (own["relevance"] if spec.relevance == "rel" else F.lit(True))
    return timeline(records.where(base), matches(spec))


def described(spec: ViewSpec, country_names: dict[str, str] | None = None) -> str:
    """The filter in words."""
    parts = [{"rel": "relevant", "unsure": "uncertain", "irr": "not relevant", "all": "all"}[spec.relevance] + " tweets"]
    named = lambda c: "unknown" if c == "??" else (country_names or {}).get(c, c)
    for label, values, join in (("hazard", spec.hazards, "/"), ("countries", tuple(map(named, spec.countries or ())), ", "), ("categories", spec.categories, "/"), ("urgency", spec.urgencies, "/"), ("places", spec.places, ", ")):
        if values:
            parts.append(f"{label} {join.join(map(str, values))}")
    if spec.query:
        parts.append(f'text contains "{spec.query}"')
    if spec.start is not None:
        parts.append(f"time {spec.start} to {spec.end}")
    return "; ".join(parts)


def timeline(rows: DataFrame, inside: Column, ts: str = "ts") -> DataFrame:
    """(bin, total, seen): bins of a day, six hours or an hour by the span; empty bins count 0. The span is one aggregate row."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    t = rows.where(F.col(ts).isNotNull()).select(us.alias("t"), inside.alias("seen"))
    ends = t.agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    hour, day = 3_600_000_000, 86_400_000_000
    ends = ends.withColumn("w", F.when(F.col("hi") - F.col("lo") > 20 * day, day).when(F.col("hi") - F.col("lo") > 2 * day, 6 * hour).otherwise(hour))
    bins = ends.where("lo is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(hi - lo) div w"))).alias("bin"))
    n = t.join(F.broadcast(ends)).groupBy(F.expr("(t - lo) div w").alias("bin")).agg(F.count("*").alias("total"), F.count_if("seen").alias("seen"))
    return bins.join(n, "bin", "left").select("bin", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("seen", F.lit(0)).cast("long").alias("seen"))


def fit_bounds(records: DataFrame, spec: ViewSpec, tail: float = 0.01) -> DataFrame:
    """Index quantiles of the places' coordinates."""
    e = records.where(matches(spec)).select(F.explode("places").alias("x")).where("x.prec <> 'region'")
    def at(c: str, f: float) -> Column:
        return F.expr(f"percentile_disc({f}) within group (order by {c})")

    return e.select("x.lat", "x.lon").agg(at("lat", tail).alias("south"), at("lat", 1 - tail).alias("north"), at("lon", tail).alias("west"), at("lon", 1 - tail).alias("east"))


def fit_bounds_weighted(records: DataFrame, spec: ViewSpec, tail: float = 0.05, regions: bool = False) -> DataFrame:
    """South, north, west, east of the densest places by how often each is named, with the zoom and centre that show them.

    Quantiles are linear between the values as if each stood there as often as its place is named; the rows are places with their counts.
    """
    e = records.where(matches(spec)).select("id", F.explode("places").alias("x")).where(F.lit(regions) | (F.col("x.prec") != "region"))
    each = e.groupBy("x.name").agg(F.count("*").alias("n"), F.min_by("x.lat", "id").alias("lat"), F.min_by("x.lon", "id").alias("lon"))
    at = lambda c, f: F.expr(f"percentile({c}, {f}, n)")
    box = each.agg(at("lat", tail).alias("south"), at("lat", 1 - tail).alias("north"), at("lon", tail).alias("west"), at("lon", 1 - tail).alias("east"))
    span = F.greatest(F.greatest(F.col("north") - F.col("south"), F.lit(0.05)), F.greatest(F.col("east") - F.col("west"), F.lit(0.05)) / 1.6)
    zoom = F.least(F.lit(10.0), F.greatest(F.lit(1.0), 8 - F.sqrt(span)))
    return box.select("*", zoom.alias("zoom"), ((F.col("south") + F.col("north")) / 2).alias("lat"), ((F.col("west") + F.col("east")) / 2).alias("lon"))


def listed(records: DataFrame, spec: ViewSpec, how: str, k: int = 60) -> DataFrame:
    order = {"urgent": [F.desc("urg"), F.desc("n"), F.desc("conf"), "id"], "shared": [F.desc("n"), F.desc("urg"), "id"], "newest": [F.desc_nulls_last("ts"), "id"]}[how]
    return records.where(matches(spec)).orderBy(*order).limit(k)


def default_filters(records: DataFrame, global_mode: bool = True) -> DataFrame:
    r = records.where((F.col("rel") == 1) & F.col("canon"))
    out = r.agg(F.count_distinct(hazard()).alias("hazards"), F.avg((hazard() == "FLOOD").cast("double")).alias("share"))
    multi = (F.col("hazards") > 1) & (F.col("share") < 0.97)
    return out.select(F.col("hazards").cast("long").alias("hazards"), multi.alias("multi_hazard"), (multi & F.lit(global_mode)).alias("filter_hazard"))


def served(records: DataFrame) -> DataFrame:
    """Records as they are served: rounded, with ISO times."""
    return records.select("id", "g", "n", "canon", "rel", F.bround("p", 3).alias("p"), F.bround("conf", 2).alias("conf"), "cat", "urg", "hz", "cc", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("ts"))


def summary_rows(records: DataFrame) -> DataFrame:
    return records.where(F.col("canon") & (F.col("rel") == 1)).select("id", "g", "n", "urg", cat().alias("cat"), "conf", "hz", "cc", F.array_join(F.slice(F.transform("places", lambda x: x["name"]), 1, 3), ";").alias("places"))


def geojson(records: DataFrame, spec: ViewSpec) -> DataFrame:
    """(id, feature): one feature per row and place."""
    e = records.where(matches(spec)).withColumn("x", F.explode("places"))
    props = F.struct("id", "g", "n", "text", "rel", "p", "conf", cat().alias("cat"), "urg", hazard().alias("hz"), "cc", F.col("decided_by").alias("by"), F.col("x.name").alias("place"), F.col("x.prec").alias("prec"))
    return e.select("id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array("x.lon", "x.lat").alias("coordinates")).alias("geometry"), props.alias("properties"))).alias("feature"))


def csv_rows(records: DataFrame, spec: ViewSpec) -> DataFrame:
    names = F.array_join(F.transform("places", lambda x: x["name"]), ";")
    return records.where(matches(spec)).select("id", "g", "n", "rel", "p", "conf", cat().alias("cat"), "urg", "hz", "cc", names.alias("places"))


def representative(records: DataFrame, n: int = 150) -> DataFrame:
    """Quota per category of the best scored rows, filled up with the best others, cut at n.

    Only n rows of a category can matter: these are taken per slice of ids first, so that no category meets in one task whole.
    """
    score = F.log2(1 + F.col("n")) + 1.5 * F.col("urg") + F.col("conf") + 0.5 * (F.size("places") > 0).cast("int")
    r = records.withColumn("c", cat()).withColumn("score", score).withColumn("_p", F.pmod(F.xxhash64("id"), F.lit(256)))
    sizes = records.groupBy(cat().alias("c")).agg(F.count("*").alias("k")).withColumn("quota", F.greatest(F.lit(3.0), F.bround(n * F.col("k") / F.sum("k").over(Window.partitionBy()))))
    best = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id"))
    some = r.withColumn("r", best("c", "_p")).where(F.col("r") <= n)
    ranked = some.join(F.broadcast(sizes), "c").withColumn("r", best("c")).withColumn("picked", F.col("r") <= F.col("quota"))
    return ranked.orderBy(F.desc("picked"), F.desc("score"), "id").limit(n).drop("r", "quota", "k", "picked", "_p")


def cited_lines(records: DataFrame, n: int = 150, country_names: dict[str, str] | None = None) -> DataFrame:
    """(at, id, line, excerpt) of the representative rows, the best first, numbered from 0: what a summary cites, and what stands for one."""
    picked = representative(records, n)
    at = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("score"), "id")) - 1  # n rows at most
    named = F.array_join(F.transform(F.slice("places", 1, 3), lambda x: x["name"]), ",")
    places = F.when(named == "", "-").otherwise(named)
    country = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in country_names.items() for x in kv]), F.col("cc")), F.col("cc")) if country_names else F.col("cc")
    where = F.when(F.coalesce("cc", F.lit("")) != "", F.concat(places, F.lit("; "), country)).otherwise(places)
    what = F.concat_ws(", ", F.when(F.coalesce("hz", F.lit("")) != "", F.col("hz")), F.col("c"))
    line = F.format_string("[%d] (%s, urgency %d, shared %dx, where: %s) %s", at, what, F.col("urg"), F.col("n"), where, F.col("text"))
    return picked.select(at.alias("at"), "id", line.alias("line"), F.format_string("- (%s, urgency %d) %s", F.col("c"), F.col("urg"), F.col("text")).alias("excerpt"))


def summarised(records: DataFrame, provider=None, template: str = "{n} of {total}: {filters}\n{lines}", filters: str = "", n: int = 150, k: int = 8) -> dict:
    """A summary by a provider's model of the representative rows (at most ``n`` come to the driver); without one, the best ``k`` themselves.

    ``provider.answer`` takes a prompt, the template filled in, and gives the text, or nothing where it calls no model.
    """
    rows = cited_lines(records, n).orderBy("at").collect()
    if not rows:
        return {"markdown": "", "cited": [], "asked": False}
    said = provider.answer(template.format(n=len(rows), total=records.count(), filters=filters, lines="\n".join(r["line"] for r in rows))) if provider else None
    if said is None:
        return {"markdown": "\n".join(r["excerpt"] for r in rows[:k]), "cited": [r["id"] for r in rows[:k]], "asked": False}
    return {"markdown": said, "cited": [r["id"] for r in rows], "asked": True}


def place_popup(records: DataFrame, spec: ViewSpec, name: str, k: int = 4) -> DataFrame:
    return listed(records, replace(spec, places=(name,)), "urgent", k)
