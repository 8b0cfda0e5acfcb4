"""An upload from posts to labelled posts, in stages: grouped, given a region and its gazetteer, masked, scored, reviewed within the budget, given the
places and the country of their labels, and propagated to all copies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import text as T
from emberline.operators import context, extraction, grouping, names, review, scoring
from emberline.session import forget, written

#: What a post has after the process, beside its group.
LABELS = ["rel", "p", "p_flood", "conf", "cat", "urg", "hz", "cc", "decided_by", "places", "place_hint"]


def rule_answers(prompt: str) -> str:
    """A stand-in for a model: long lines are relevant."""
    out = []
    for line in prompt.split("\n"):
        i, _, text = line.partition("\t")
        out.append(f"{i}|1|8|INFRA|2|-" if len(text) > 100 else f"{i}|0|7")
    return "\n".join(out)


def masked(posts: DataFrame, found: DataFrame, terms: list[str], row_id: str = "id") -> DataFrame:
    """(row, masked): places by their offsets, then distinctive terms, links, mentions and broken characters."""
    return extraction.masked(posts, found, row_id).select(row_id, T.mask_terms(F.col("masked"), terms).alias("masked"))


def stamped(rows: DataFrame, posts: DataFrame, time: str, row_id: str = "post_id") -> DataFrame:
    """The rows with the ``timestamp`` of their post, sought by its id; null where it cannot be read."""
    return rows.join(posts.select(row_id, F.try_to_timestamp(F.col(time).cast("string")).alias("timestamp")), row_id, "left")


def with_label_places(rows: DataFrame, g: extraction.Gazetteer, answers: DataFrame | None = None, lookups: int = 0) -> DataFrame:
    """The rows (id, rel, cc, places, label_places) with the places of relevant labels behind their own, each name once."""
    own = F.transform("places", lambda x: x.place["name"])
    asked = rows.where("rel = 1").select("id", "cc", F.array_except("label_places", own).alias("label_places")).where(F.size("label_places") > 0)
    more = names.places_of_labels(asked, g.names, g.context, answers=answers, lookups=lookups)
    j = rows.join(more, "id", "left")
    new = F.filter(F.coalesce("more", F.array().cast(dict(more.dtypes)["more"])), lambda x: ~F.array_contains(own, x.place["name"]))
    as_span = F.transform(new, lambda x: F.struct(F.lit(None).cast("int").alias("pos"), F.lit(None).cast("int").alias("n"), x.span.alias("span"), F.lit(None).cast("string").alias("tag"), x.place.alias("place"))).cast(extraction.SPANS)
    return j.withColumn("places", F.concat("places", as_span)).drop("more")


def process(
    posts: DataFrame,
    sources: names.Sources,
    common: DataFrame,
    vectors: DataFrame | Callable[[DataFrame], DataFrame],
    heads: dict,
    terms: list[str] | None = None,
    precomputed: DataFrame | None = None,
    default_hazard: str = "FLOOD",
    budget: int = 0,
    batch: int = 200,
    provider: review.Provider | None = None,
    region: context.Region | None = None,
    time: str | None = None,
    answers: DataFrame | None = None,
    lookups: int = 80,
    with_text: bool = True,
) -> DataFrame:
    """The posts (post_id, text) with group, labels, places and country. Only canonical posts are scored and reviewed.

    Texts are written once, with their groups; the tables of each stage do without them. ``with_text``: the posts returned have theirs.

    ``vectors`` are (post_id, embedding), or what makes them of (post_id, masked). ``heads`` as :func:`scoring.predicted` takes them. ``precomputed`` labels,
    by group_id, come before the review. ``region`` is worked out from all posts if it is not given; ``answers`` are a geocoder's.
    """
    g = grouping.grouped_texts(posts)
    region = region or context.region_of(g, sources, common)
    gazetteer = context.gazetteer_for(region, sources, common)
    canon = g.where("is_canonical").select(F.col("post_id").alias("id"), "group_id", "text")
    found = extraction.extracted(canon, gazetteer, "id")
    if callable(vectors):
        vectors = vectors(masked(canon, found, terms or []).withColumnRenamed("id", "post_id"))
    x = canon.join(found, "id", "left").withColumn("places", F.coalesce("places", F.array().cast(extraction.SPANS)))
    x = x.join(vectors.select(F.col("post_id").alias("id"), "embedding"), "id", "left")
    x = x.withColumn("place_hint", T.place_hint(F.col("text"), F.transform("places", lambda s: s.span)))
    x = scoring.predicted(x, "embedding", heads, default_hazard).drop("embedding", "text")
    relevant, confident, _ = review.confidence(F.col("p"))
    x = x.withColumns({"rel": relevant, "conf": confident, "cc": F.lit(None).cast("string"), "label_places": F.array().cast("array<string>"), "decided_by": F.lit("local")})
    if precomputed is not None:
        x = review.precomputed(x, precomputed, "group_id", default_hazard=default_hazard)
    x = written(x, "scored")
    provider = provider or review.Provider(rule_answers, budget, "live")
    labels = review.reviewed(x.where("decided_by = 'local'"), provider, budget, batch, "p_flood", "place_hint", texts=canon.select("id", "text"))
    y = with_label_places(review.applied(x, labels), gazetteer, answers, lookups)
    y = review.blanked(y.withColumn("cc", context.voted_country(F.col("cc"), F.col("places"), region)))
    out = review.propagated(g if with_text else g.drop("text"), y, LABELS)
    out = written(stamped(out, posts, time) if time else out, "processed")
    forget(g, found, x)
    return out
