"""Places named in texts: spans that a gazetteer knows, by the rules that tell places from people, storms and words; their masking.

Texts are read once, token by token. Keys are a trie whose levels are tables of prefixes: a token stays only if some key begins with it, is followed
by the next only if some key goes on so, and makes a span where a key ends; keys, places and facts are joined, never held by tasks. Whether a span is a place depends on its own words, its position and the token before it
alone, so all spans are judged apart; of those accepted the longest at each token is taken, from left to right.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import text as T
from emberline.operators import names as N
from emberline.operators import place_values as V
from emberline.operators.skew import BROADCAST_BYTES, bytes_of, dealt, row_bytes
from emberline.session import forget, written

MAX_WORDS = 5
_EDGE = ".'’-"
_BLOCK_TAGS = sorted({b.replace(" ", "") for b in V.BLOCK} | set(V.BLOCK))
#: What extraction returns, per row.
SPANS = "array<struct<pos:int,n:int,span:string,tag:string,place:" + N.PLACE + ">>"


@dataclass(frozen=True)
class Gazetteer:
    """Written tables that texts are held against."""

    context: N.Context
    names: N.Sources
    keys: DataFrame  # (key, place, plain, facts)
    trie: DataFrame  # (n, prefix, ends, goes_on, whole, forms): first n words of keys, folded; whether they are a key, and keys folded to them
    words: int  # words of the longest key
    level_bytes: dict[int, int]  # bytes of each level of the trie
    tags: DataFrame  # (key, place)
    common: DataFrame  # (word)

    def hint(self, table: DataFrame) -> str:
        return "broadcast" if bytes_of(table) <= BROADCAST_BYTES else "shuffle_merge"


def _facts(names: N.Sources) -> DataFrame | None:
    """(key, small_ok, known_city, is_admin, mid_ok, is_nation): what the sources say of a key, beside its place.

    ``small_ok``: a town of an event or of the register that may be written in small letters; ``known_city``: likewise, of the world, by folded key;
    ``mid_ok``: may be a dictionary word where it does not begin the text.
    """
    parts, no = [], F.lit(False)
    row = lambda df, small=no, known=no, admin=no, mid=no, nation=no: df.select("key", small.alias("small_ok"), known.alias("known_city"), admin.alias("is_admin"), mid.alias("mid_ok"), nation.alias("is_nation"))
    if names.features is not None:
        first = names.features.groupBy("key").agg(F.min_by("kind", "at").alias("kind"))
        parts.append(row(first, small=F.coalesce(F.col("kind").isin("town", "city", "village"), no), mid=F.lit(True)))
    if names.official is not None:
        parts.append(row(names.official, small=(F.col("rel") >= V.SIGNIFICANT) & F.col("kind").isin("town", "city"), nation=F.col("kind") == "first_nation"))
    if names.world is not None:
        city = F.col("kind") == "city"
        parts.append(row(names.world, known=city & (F.col("pop") >= V.KNOWN), admin=~city, mid=city & (F.col("pop") >= V.SIZEABLE)))
    if not parts:
        return None
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("key").agg(*[F.bool_or(f).alias(f) for f in ("small_ok", "known_city", "is_admin", "mid_ok", "is_nation")])


def tag_keys(tag: Column) -> Column:
    """What a hashtag is looked up by, in order: itself, without each known ending, without each known beginning."""
    t = F.replace(F.lower(F.ltrim(tag, F.lit("#"))), F.lit("_"), F.lit(""))
    ends = [F.when(t.endswith(e) & (F.length(t) > len(e) + 1), F.substr(t, F.lit(1), F.length(t) - len(e))) for e in V.TAG_ENDINGS]
    begins = [F.when(t.startswith(b) & (F.length(t) > len(b) + 2), F.substr(t, F.lit(len(b) + 1))) for b in V.TAG_BEGINNINGS]
    return F.filter(F.array(t, *ends, *begins), lambda k: k.isNotNull() & (k != "") & ~k.isin(_BLOCK_TAGS))


def _tags(names: N.Sources, c: N.Context, keys: DataFrame) -> DataFrame:
    """(key, place) of hashtags: keys in one word, and names run together."""
    used = names.seen_by(c)
    aliases = list(V.ALIASES) * c.canada + list(V.REGION_ALIASES) * (used.world is not None)
    own = keys.where(~F.contains("key", F.lit(" ")) & (F.col("has_source") | F.col("key").isin(aliases))).select("key", F.col("key").alias("name"), F.lit(0).alias("how"))
    barred = own.where(F.col("key").isin(V.STOP) | ((F.length("key") < 4) & ~F.col("key").isin(list(V.ALIASES))))
    rows = own
    if used.run_together is not None:
        run = used.run_together.groupBy("squashed").agg(F.min_by("key", "rank").alias("name")).select(F.col("squashed").alias("key"), "name", F.lit(1).alias("how"))
        rows = rows.unionByName(run)
    rows = rows.join(barred.select("key"), "key", "left_anti").withColumn("id", F.monotonically_increasing_id())
    found = N.resolved(written(rows, "tag-names"), names, c).where("place is not null")
    return found.groupBy("key").agg(F.min_by("place", "how").alias("place"))


def gazetteer(names: N.Sources, c: N.Context, common: DataFrame) -> Gazetteer:
    """Everything that texts are held against, worked out once for a context. ``common`` (word): words of the language."""
    known = N.known_keys(names, c, common.sparkSession)
    looked = N.looked_up(known.select("key", F.lit(None).cast("string").alias("cc")), names, c).drop("cc")
    facts = _facts(names.seen_by(c))
    flags = ("small_ok", "known_city", "is_admin", "mid_ok", "is_nation")
    if facts is None:
        keys = looked.select("*", *[F.lit(False).alias(f) for f in flags], F.lit(False).alias("has_source"))
    else:
        keys = looked.join(facts, "key", "left").select("key", "place", "plain", *[F.coalesce(f, F.lit(False)).alias(f) for f in flags], F.col("small_ok").isNotNull().alias("has_source"))
    keys = written(keys, "keys")
    return Gazetteer(c, names, keys, *_trie(keys), written(_tags(names, c, keys), "tags"), written(common.select("word").distinct(), "common"))


def _trie(keys: DataFrame) -> tuple[DataFrame, int, dict[int, int]]:
    """The prefixes of all keys of at most five words, the most words, and the bytes of each level."""
    words = F.split(T.fold(F.col("key")), " ")
    each = keys.where(F.size(words) <= MAX_WORDS).select("key", words.alias("w")).select("key", "w", F.explode(F.sequence(F.lit(1), F.size("w"))).alias("n"))
    prefix = F.array_join(F.slice("w", 1, F.col("n")), " ")
    ends = F.size("w") == F.col("n")
    form = F.when(ends & (F.col("key") != F.array_join("w", " ")), F.col("key"))
    whole = ends & (F.col("key") == F.array_join("w", " "))
    trie = written(each.groupBy("n", prefix.alias("prefix")).agg(F.bool_or(ends).alias("ends"), F.bool_or(F.size("w") > F.col("n")).alias("goes_on"), F.bool_or(whole).alias("whole"), F.collect_set(form).alias("forms")), "trie")
    sizes = {r["n"]: r["b"] for r in trie.groupBy("n").agg(F.sum(row_bytes(trie)).alias("b")).collect()}  # five rows at most
    return trie, max(sizes, default=1), sizes


def plain_gazetteer(places: DataFrame) -> Gazetteer:
    """A gazetteer of ready-made places (key, place), without facts, hashtags or words of a language: for :func:`known_spans`."""
    spark = places.sparkSession
    keys = written(places.select("key", F.col("place").cast(N.PLACE).alias("place")).select("key", "place", F.col("place").alias("plain"), *[F.lit(False).alias(f) for f in ("small_ok", "known_city", "is_admin", "mid_ok", "is_nation")]), "keys")
    none = spark.createDataFrame([], "key string, place " + N.PLACE)
    return Gazetteer(N.Context(), N.Sources(), keys, *_trie(keys), none, none.select(F.col("key").alias("word")))


def token_rows(posts: DataFrame, row_id: str, text: str, words: int = 1) -> DataFrame:
    """(row, pos, t0, prev, t1, ...): tokens with the one before and the ``words`` - 1 that follow."""
    t = posts.select(row_id, T.tokens(F.col(text), T.GAZETTEER_TOKEN).alias("t"))
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0))))
    later = [F.slice("t", k + 1, F.size("t")) for k in range(1, words)]
    zipped = F.arrays_zip(F.col("t").alias("t0"), before.alias("prev"), *[x.alias(f"t{k}") for k, x in enumerate(later, 1)])
    # outer, as else the planner asks first, per text, whether there are any, and looks for the tokens many times over
    return t.select(row_id, F.posexplode_outer(zipped).alias("pos", "r")).select(row_id, "pos", "r.*").where("t0 is not null")


def _upper(c: Column) -> Column:
    return c.rlike(r"\p{Lu}") & ~c.rlike(r"\p{Ll}")


_cut = lambda k: F.trim(f"t{k}", F.lit(_EDGE))


def _level(g: Gazetteer, n: int) -> DataFrame:
    # the first levels are small whatever the number of keys; a level that is sent to all needs no shuffle, in which a frequent word would meet itself
    how = "broadcast" if g.level_bytes.get(n + 1, 0) <= BROADCAST_BYTES else "shuffle_merge"
    return g.trie.where(F.col("n") == n + 1).select(F.col("prefix").alias(f"p{n}"), *[F.col(c).alias(f"{c}{n}") for c in ("ends", "goes_on", "whole", "forms")]).hint(how)


def begun(posts: DataFrame, g: Gazetteer, row_id: str, text: str, tags: bool = False) -> DataFrame:
    """The token rows with which a key may begin, and (``tags``) those of hashtags, with what the first level of the trie says."""
    rows = token_rows(dealt(posts, row_id, text), row_id, text, g.words)
    is_tag = F.col("t0").startswith("#")
    if not tags:
        return rows.where(~is_tag).withColumn("p0", T.fold_token(_cut(0))).join(_level(g, 0), "p0")
    return rows.withColumn("p0", F.when(~is_tag, T.fold_token(_cut(0)))).join(_level(g, 0), "p0", "left").where(is_tag | F.col("goes_on0").isNotNull())


def spans_begun(rows: DataFrame, g: Gazetteer, row_id: str) -> DataFrame:
    """(row, pos, n, span, key, prev): runs of up to five tokens, from those of :func:`begun`, that are a key or whose folded form is one; hashtags have n 0."""
    is_tag = F.col("t0").startswith("#")
    for k in range(1, g.words):
        # what goes no further meets nothing, evenly
        on = F.col(f"goes_on{k - 1}") & ~F.col(f"t{k}").startswith("#")
        none = F.concat(F.lit("\x01"), F.pmod(F.xxhash64(row_id, "pos"), F.lit(1000)).cast("string"))
        rows = rows.withColumn(f"p{k}", F.when(on, F.concat_ws(" ", f"p{k - 1}", T.fold_token(_cut(k)))).otherwise(none)).join(_level(g, k), f"p{k}", "left")
    rows = rows.where(is_tag | F.expr(" or ".join(f"ends{k}" for k in range(g.words))))
    tag = F.when(is_tag, F.struct(F.lit(0).alias("n"), F.col("t0").alias("span"), F.lit(True).alias("whole"), F.array().cast("array<string>").alias("forms")))
    spans = F.array(tag, *[F.when(F.col(f"ends{k}"), F.struct(F.lit(k + 1).alias("n"), F.concat_ws(" ", *[_cut(i) for i in range(k + 1)]).alias("span"), F.col(f"whole{k}").alias("whole"), F.col(f"forms{k}").alias("forms"))) for k in range(g.words)])
    each = rows.select(row_id, "pos", "prev", F.explode(spans).alias("s")).where("s is not null").select(row_id, "pos", "prev", "s.*").withColumn("key", F.lower("span"))
    return each.where(F.col("whole") | F.array_contains("forms", F.col("key"))).select(row_id, "pos", "n", "span", "key", "prev")


def held_spans(posts: DataFrame, g: Gazetteer, row_id: str = "post_id", text: str = "text") -> DataFrame:
    """(row, pos, n, span, key, prev) of spans that the gazetteer holds, whatever places they stand for: the trie alone tells."""
    return spans_begun(begun(posts, g, row_id, text), g, row_id)


def known_spans(posts: DataFrame, g: Gazetteer, row_id: str = "post_id", text: str = "text") -> DataFrame:
    """(row, pos, n, span, key, prev, place, facts): runs of up to five tokens that some key of the gazetteer, or its folded form, equals."""
    return _with_places(held_spans(posts, g, row_id, text), g, row_id)


def _with_places(each: DataFrame, g: Gazetteer, row_id: str) -> DataFrame:
    how = g.hint(g.keys)
    exact = g.keys.select("key", F.col("place").alias("_place"), "small_ok", "is_admin", "mid_ok", "is_nation", F.lit(True).alias("_exact")).hint(how)
    folded = g.keys.select(F.col("key").alias("_fold"), F.col("plain").alias("_plain"), "known_city").hint(how)
    hit = each.withColumn("_fold", T.fold_token(F.col("key"))).join(exact, "key", "left").join(folded, "_fold", "left")
    place = F.when(F.col("_exact"), F.col("_place")).otherwise(F.col("_plain"))
    no = lambda f: F.coalesce(f, F.lit(False)).alias(f)
    return hit.where(place.isNotNull()).select(row_id, "pos", "n", "span", "key", "prev", place.alias("place"), (F.coalesce("small_ok", F.lit(False)) | F.coalesce("known_city", F.lit(False))).alias("small_ok"), no("is_admin"), no("mid_ok"), no("is_nation"))


def plausible(spans: DataFrame, g: Gazetteer) -> Column:
    """Whether a span of (span, key, pos, n, facts, is_word, is_plural) may be a place by its letters."""
    w, key = F.col("span"), F.col("key")
    words = F.split(w, " ")
    capital = F.forall(words, lambda x: x.rlike(r"^[\p{Lu}\p{N}]") | F.lower(x).isin(V.SMALL))
    short = list(V.ALIASES) + (list(V.REGION_ALIASES) if g.names.seen_by(g.context).world is not None else [])
    is_word = F.col("is_word") | F.col("is_plural")
    single = (
        F.when(F.length(w) < 3, key.isin(short) & _upper(w))
        .when(~w.rlike(r"^\p{Lu}"), ~F.col("is_word") & (F.length(w) >= 5) & F.col("small_ok"))
        .when(is_word, (F.col("is_admin") & ~key.isin(V.VAGUE)) | ((F.col("pos") > 0) & F.col("mid_ok")))
        .otherwise(True)
    )
    whole = (words[0] != "") & (F.element_at(words, -1) != "")
    return whole & F.when(F.col("n") == 1, ~key.isin(V.STOP) & single).otherwise(capital)


def possible(g: Gazetteer) -> Column:
    """What :func:`accepted` asks of (span, key, n, prev) alone: without it no span needs its place."""
    w, key = F.col("span"), F.col("key")
    capital = F.forall(F.split(w, " "), lambda x: x.rlike(r"^[\p{Lu}\p{N}]") | F.lower(x).isin(V.SMALL))
    short = list(V.ALIASES) + (list(V.REGION_ALIASES) if g.names.seen_by(g.context).world is not None else [])
    single = ~key.isin(V.STOP) & F.when(F.length(w) < 3, key.isin(short) & _upper(w)).otherwise(w.rlike(r"^\p{Lu}") | (F.length(w) >= 5))
    storm = F.ltrim(F.lower(F.coalesce("prev", F.lit(""))), F.lit("#")).isin(V.STORMS)
    return ~key.isin(V.BLOCK) & ~storm & ~(key.isin(list(V.ALIASES)) & (F.col("n") == 1) & (F.length("key") <= 3) & ~_upper(w)) & F.when(F.col("n") == 1, single).otherwise(capital)


def accepted(spans: DataFrame, g: Gazetteer) -> DataFrame:
    """The known spans that are places: not blocked, plausible, and neither a storm's name nor a person's."""
    words = g.common.hint(g.hint(g.common))
    x = spans.join(words.select(F.col("word").alias("key"), F.lit(True).alias("is_word")), "key", "left")
    stem = F.when(F.col("key").endswith("s"), F.substr("key", F.lit(1), F.length("key") - 1))
    x = x.withColumn("_stem", stem).join(words.select(F.col("word").alias("_stem"), F.lit(True).alias("is_plural")), "_stem", "left").na.fill(False, ["is_word", "is_plural"])
    short = F.col("key").isin(list(V.ALIASES)) & (F.col("n") == 1) & (F.length("key") <= 3) & ~_upper(F.col("span"))
    before = F.lower(F.coalesce("prev", F.lit("")))
    x = x.where(~F.col("key").isin(V.BLOCK) & plausible(x, g) & ~short & ~F.ltrim(before, F.lit("#")).isin(V.STORMS))
    # the token before, where it is capitalised and no preposition: a name of a person unless it is itself a place
    named = F.coalesce(F.col("prev").rlike(r"^\p{Lu}"), F.lit(False)) & ~before.isin(V.PREPOSITIONS)
    x = x.withColumn("_before", F.when((F.col("n") == 1) & named, before))
    how = g.hint(g.keys)
    place = g.keys.select(F.col("key").alias("_before"), F.lit(True).alias("_known"), F.col("place").isNotNull().alias("_is_place")).hint(how)
    plain = g.keys.select(F.col("key").alias("_before_fold"), F.col("plain").isNotNull().alias("_is_plain")).hint(how)
    x = x.withColumn("_before_fold", T.fold_token(F.col("_before"))).join(place, "_before", "left").join(plain, "_before_fold", "left")
    person = F.col("_before").isNotNull() & ~F.coalesce(F.when(F.col("_known"), F.col("_is_place")).otherwise(F.col("_is_plain")), F.lit(False))
    p = F.col("place")
    town = (p.source == "geonames") & (p.kind == "city") & (F.coalesce(p.pop, F.lit(0)) < V.GREAT_CITY)
    official = p.source == "cgndb"
    minor = official & (F.coalesce(p.rel, F.lit(0)) < V.SIGNIFICANT) & p.kind.isin("locality", "hamlet") & ~F.col("is_nation")
    out = (F.col("n") == 1) & (((town | official) & person) | (minor & ~before.isin(V.PREPOSITIONS)))
    return x.where(~out).select(*[c for c in spans.columns if c in ("pos", "n", "span", "place") or c == spans.columns[0]])


def hashtags(toks: DataFrame, g: Gazetteer, row_id: str = "post_id") -> DataFrame:
    """(row, pos, span, tag, place) of hashtags (row, pos, span): those that stand for a place, with the part of them that does."""
    each = toks.select(row_id, "pos", "span", F.posexplode(tag_keys(F.col("span"))).alias("at", "key"))
    hit = each.join(g.tags.hint(g.hint(g.tags)), "key")
    return hit.groupBy(row_id, "pos", "span").agg(F.min_by(F.struct("key", "place"), "at").alias("b")).select(row_id, "pos", "span", F.col("b.key").alias("tag"), "b.place")


def agreeing(spans: Column) -> Column:
    """The spans without small places of other countries, where one country leads with two votes or more: two for a country, state or province."""
    administrative = lambda x: x.place.kind.isin("country", "state", "province")
    codes = F.array_distinct(F.filter(F.transform(spans, lambda x: x.place.cc), lambda c: c.isNotNull()))
    votes = F.transform(codes, lambda c, i: F.struct(F.aggregate(spans, F.lit(0), lambda a, x: a + F.when(x.place.cc == c, F.when(administrative(x), 2).otherwise(1)).otherwise(0)).alias("n"), (-i).alias("at"), c.alias("cc")))
    keep = lambda top: F.filter(spans, lambda x: x.place.cc.isNull() | (x.place.cc == top.cc) | administrative(x) | (F.coalesce(x.place["pop"], F.lit(0)) >= V.GREAT_CITY))
    # the votes are counted once per row, not once per span
    return F.transform(F.array(F.array_max(votes)), lambda top: F.when(top.n >= 2, keep(top)).otherwise(spans))[0]


def firsts(spans: Column, name: Callable[[Column], Column]) -> Column:
    """The spans that are the first of their name, in order: names are sorted, so that nothing is compared with all others."""
    named = F.sort_array(F.transform(spans, lambda x, i: F.struct(name(x).alias("name"), i.alias("i"))))
    first = lambda w: F.filter(w, lambda x, i: (i == 0) | ~x["name"].eqNullSafe(F.get(w, i - 1)["name"]))
    at = F.transform(F.array(named), lambda w: F.sort_array(F.transform(first(w), lambda x: x.i)))[0]
    return F.transform(at, lambda i: F.get(spans, i))


def extracted(posts: DataFrame, g: Gazetteer, row_id: str = "post_id", text: str = "text") -> DataFrame:
    """(row, places) of rows that name a place: spans in order, each place once under its first span. A null text names none."""
    # texts are read once, for spans and for hashtags
    first = written(spans_begun(begun(posts, g, row_id, text, tags=True), g, row_id).where((F.col("n") == 0) | possible(g)), "begun")
    spans = _with_places(first.where("n > 0"), g, row_id)
    a = accepted(spans, g).select(row_id, "pos", "n", "span", F.lit(None).cast("string").alias("tag"), "place")
    t = hashtags(first.where("n = 0"), g, row_id).select(row_id, "pos", F.lit(1).alias("n"), "span", "tag", "place")
    ordered = F.sort_array(F.collect_list(F.struct("pos", (-F.col("n")).alias("shorter"), "n", "span", "tag", "place")))
    rows = a.union(t).groupBy(row_id).agg(ordered.alias("s"))
    # the longest span at each token, from left to right, that begins where no taken one reaches
    step = lambda acc, x, i: F.when(x.pos >= acc.end, F.struct((x.pos + x.n).alias("end"), F.concat(acc["at"], F.array(i)).alias("at"))).otherwise(acc)
    numbered = F.transform("s", lambda x, i: F.struct(x.pos.alias("pos"), x.n.alias("n"), i.alias("i")))
    taken = F.aggregate(numbered, F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("at")), lambda acc, x: step(acc, x, x.i))["at"]
    rows = rows.select(row_id, F.transform(taken, lambda i: F.get("s", i)).alias("s"))
    once = firsts(F.col("s"), lambda x: x.place["name"])
    rows = rows.select(row_id, F.transform(once, lambda x: F.struct(x.pos.alias("pos"), x.n.alias("n"), x.span.alias("span"), x.tag.alias("tag"), x.place.alias("place"))).cast(SPANS).alias("places"))
    rows = rows.withColumn("places", agreeing(F.col("places"))) if g.names.seen_by(g.context).world is not None else rows
    # a table: what callers ask of the places would else be worked out where the spans are, once per span
    out = written(rows, "places")
    forget(first)
    return out


def with_offsets(posts: DataFrame, found: DataFrame, row_id: str = "post_id", text: str = "text", how: str = "left") -> DataFrame:
    """(row, text, places): each place with the characters at which its span begins and ends (exclusive). Rows without places have none, or (``how`` inner) are left out."""
    x = _pieces(posts, found, row_id, text, how)
    size = lambda first, n: F.length(F.array_join(F.slice("_p", first + 1, n), ""))
    gap = lambda p: F.length(T.gap(F.get("_p", p.pos)))
    # characters from the end of the place before to this one's beginning, and within it; then their sums from left to right
    since = lambda i: F.coalesce(F.get("places", i - 1).pos + F.get("places", i - 1).n, F.lit(0))
    before = lambda p, i: size(since(i), p.pos - since(i)) + gap(p)
    within = lambda p: size(p.pos, p.n) - gap(p)
    lengths = F.transform("places", lambda p, i: F.struct(before(p, i).alias("before"), within(p).alias("within")))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<struct<start:int,stop:int>>").alias("at"))
    sums = lambda a, l: F.struct((a.end + l.before + l.within).alias("end"), F.concat(a["at"], F.array(F.struct((a.end + l.before).alias("start"), (a.end + l.before + l.within).alias("stop")))).alias("at"))
    x = x.withColumn("_at", F.aggregate(lengths, none, sums)["at"])
    placed = lambda p, at: F.struct(p.pos.alias("pos"), p.n.alias("n"), p.span.alias("span"), p.tag.alias("tag"), p.place.alias("place"), at.start.alias("start"), at.stop.alias("end"))
    return x.select(row_id, text, F.zip_with("places", "_at", placed).alias("places"))


def _pieces(posts: DataFrame, found: DataFrame, row_id: str, text: str, how: str = "left") -> DataFrame:
    """(row, text, places, _p): the texts cut behind each token, with what follows the last; those without places stay whole."""
    x = dealt(posts, row_id, text).join(found.select(row_id, "places"), row_id, how).withColumn("places", F.coalesce("places", F.array().cast(SPANS)))
    return x.withColumn("_p", F.when(F.size("places") > 0, T.pieces(F.col(text))))


def masked(posts: DataFrame, found: DataFrame, row_id: str = "post_id", text: str = "text", token: str = "PLACE") -> DataFrame:
    """(row, masked): the extracted spans, and nothing else, as ``token``; a hashtag keeps the rest of its letters, in small ones."""
    x = _pieces(posts, found, row_id, text)
    low = lambda p: F.lower(F.substr(p.span, F.lit(2)))
    at = lambda p: F.instr(low(p), p.tag)
    tag = lambda p: F.concat(F.lit("#"), F.when(at(p) > 0, F.concat(F.substr(low(p), F.lit(1), at(p) - 1), F.lit(token), F.substr(low(p), at(p) + F.length(p.tag)))).otherwise(F.lit(token)))
    new = lambda p: F.when(p.span.startswith("#"), tag(p)).otherwise(F.lit(token))
    # what stands between the places, each piece read once
    between = lambda first, n: F.array_join(F.slice("_p", first + 1, n), "")
    past = lambda p: F.coalesce(p.pos + p.n, F.lit(0))
    head = F.transform("places", lambda p, i: F.concat(between(past(F.get("places", i - 1)), p.pos - past(F.get("places", i - 1))), T.gap(F.get("_p", p.pos)), new(p)))
    last = past(F.get("places", F.size("places") - 1))
    whole = F.coalesce(F.col(text), F.lit(""))
    return x.select(row_id, F.when(F.size("places") > 0, F.concat(F.array_join(head, ""), between(last, F.size("_p") - last))).otherwise(whole).alias("masked"))
