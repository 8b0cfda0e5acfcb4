"""Queries over places of an event: a register, mapped features and words made from the texts themselves, and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.functions import text as T
from emberline.operators import extraction as E
from emberline.operators import names as N
from emberline.operators import place_values as V
from emberline.operators import terms
from emberline.plans import relations as R
from emberline.session import table, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CENTRE = (51.0, -114.0)
#: Texts with a hashtag made of their first long capitalised word.
POSTS = "select doc_id as post_id, text || ' #' || lower(regexp_extract(text, '[A-Z][a-z][a-z][a-z][a-z]+', 0)) || 'Flood' as text from documents"


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f"q_{f.__name__}"] = f
        if oracle:
            ORACLES[f"q_{f.__name__}"] = oracle
        return f

    return add


def event_posts(s: SparkSession, d: str) -> DataFrame:
    return R._sql(s, d, POSTS, "documents")


def _number(c) -> F.Column:
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 12), 16, 10).cast("long")


def frequent(s: SparkSession, d: str) -> DataFrame:
    """(token, df, h), written: registers, cities and words of a language are made of it, and read it many times."""
    return written(terms.document_frequency(table(s, d, "documents"), "text", 5, lower=False).withColumn("h", _number(F.col("token"))), "frequent")


def register(s: SparkSession, d: str, t: DataFrame | None = None) -> DataFrame:
    """A register of capitalised words that 5 to 40 texts have; what it says of them follows from a hash."""
    t = (t or frequent(s, d)).where(F.col("df").between(5, 40) & F.col("token").rlike("^[A-Z][a-z]{4,}$"))
    term = F.get(F.array(*map(F.lit, ("City", "Town", "Hamlet", "River"))), (F.col("h") % 4).cast("int"))
    return t.select(F.col("h").alias("at"), F.col("token").alias("name"), F.expr("50 + (h % 1000) / 50e0").alias("lat"), F.expr("-115 + (h % 89) / 50e0").alias("lon"), F.lit("Alberta").alias("province"), term.alias("term"), F.lit("").alias("category"), F.expr("(h % 13) * 150000").alias("relevance"))


def features(s: SparkSession, d: str) -> DataFrame:
    """Features named by the first two words of every fifth text, where both are capitalised; two points each."""
    toks = table(s, d, "documents").where("doc_id % 5 = 0").withColumn("t", F.transform(T.first_tokens(F.col("text"), 2), lambda w: F.trim(w, F.lit(".'’-"))))
    ok = (F.size("t") == 2) & F.forall("t", lambda w: w.rlike("^[A-Z][A-Za-z]{2,}$")) & ~F.lower(F.get("t", F.lit(0))).isin("the", "downtown")
    point = lambda a, b: F.struct(F.expr(f"50 + (doc_id % {a}) / 50e0").alias("lat"), F.expr(f"-115 + (doc_id % {b}) / 50e0").alias("lon"))
    kind = F.get(F.array(*map(F.lit, ("town", "road", "park"))), (F.col("doc_id") % 3).cast("int"))
    return toks.where(ok).select(F.col("doc_id").alias("at"), F.array_join("t", " ").alias("name"), kind.alias("kind"), F.array(point(100, 89), point(83, 71)).alias("points"))


def common(s: SparkSession, d: str, t: DataFrame | None = None) -> DataFrame:
    return (t or frequent(s, d)).where(F.col("token").rlike("^[a-z]{3,}$") & (F.col("h") % 7 == 0)).select(F.col("token").alias("word"))


def world(s: SparkSession, d: str, t: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Cities named by capitalised words that 41 to 90 texts have, in states of six countries, one of them the register's."""
    code = F.get(F.array(F.lit("CA"), *[F.lit(f"N{i}") for i in range(5)]), (F.col("h") % 6).cast("int"))
    t = (t or frequent(s, d)).where(F.col("df").between(41, 90) & F.col("token").rlike("^[A-Z][a-z]{4,}$"))
    cities = t.select(F.col("h").alias("at"), F.col("token").alias("name"), F.col("token").alias("ascii"), F.array().cast("array<string>").alias("others"), F.expr("(h % 170) - 85e0").alias("lat"), F.expr("(h % 359) - 179e0").alias("lon"), code.alias("cc"), F.expr("'S' || (h % 3)").alias("state_code"), F.expr("h % 3000000").alias("pop"))
    n = table(s, d, "nation").where("n_nationkey between 0 and 5").select(F.col("n_nationkey").cast("long").alias("at"), F.when(F.col("n_nationkey") == 5, "CA").otherwise(F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))).alias("cc"), F.initcap("n_name").alias("name"))
    states = n.select(F.col("at"), "cc", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).select((F.col("at") * 3 + F.col("k")).alias("at"), F.concat("cc", F.lit(".S"), F.col("k").cast("string")).alias("code"), F.concat(F.lit("Province"), F.col("cc"), F.col("k").cast("string")).alias("name")).withColumn("ascii", F.col("name"))
    return cities, states, n.withColumn("continent", F.lit("C"))


def event(s: SparkSession, d: str) -> E.Gazetteer:
    t = frequent(s, d)
    return E.gazetteer(N.sources(register(s, d, t), features(s, d)), N.Context(centre=CENTRE), common(s, d, t))


def _list(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _km(lat: str, lon: str) -> str:
    return f"2*6371*asin(sqrt(least(1.0, power(sin(radians({CENTRE[0]}-({lat}))/2),2) + cos(radians({lat}))*cos(radians({CENTRE[0]}))*power(sin(radians({CENTRE[1]}-({lon}))/2),2))))"


_FIXED = ", ".join(f"('{k}', '{v.lower()}')" for k, v in (V.ALIASES | {p.lower(): p for p in V.PROVINCES}).items())
_PROVINCES = ", ".join(f"('{p.lower()}', '{p}')" for p in V.PROVINCES)
_TOKS = r"regexp_extract_all(text, '#?[A-Za-zÀ-ÿ0-9''’\-.]+')"
_WORD = r"regexp_replace(regexp_replace({}, '^[.''’\-]+', ''), '[.''’\-]+$', '')"
_CTE = rf"""with recursive freq as (select token, count(*) as df, cast('0x' || left(md5(token), 12) as bigint) as h from (select distinct doc_id, unnest(regexp_extract_all(text, '#?[A-Za-zÀ-ÿ][\p{{L}}\p{{N}}_''’\-]*')) as token from documents) group by 1 having count(*) >= 5),
 reg0 as (select lower(token) as key, token as name, 50 + (h % 1000) / 50e0 as lat, -115 + (h % 89) / 50e0 as lon, ['city','town','hamlet','river'][h % 4 + 1] as kind, (h % 13) * 150000 as rel from freq where df between 5 and 40 and regexp_matches(token, '^[A-Z][a-z]{{4,}}$')),
 reg as (select *, {_km('lat', 'lon')} <= 600 as near from reg0 where kind <> 'river' or rel >= 250000),
 common as (select token as word from freq where regexp_matches(token, '^[a-z]{{3,}}$') and h % 7 = 0),
 ft0 as (select doc_id, {_WORD.format('t[1]')} as a, {_WORD.format('t[2]')} as b from (select doc_id, {_TOKS} as t from documents where doc_id % 5 = 0) where len(t) >= 2),
 ft1 as (select doc_id, a || ' ' || b as name, lower(a || ' ' || b) as key from ft0 where regexp_matches(a, '^[A-Z][A-Za-z]{{2,}}$') and regexp_matches(b, '^[A-Z][A-Za-z]{{2,}}$') and lower(a) not in ('the','downtown')),
 pts as (select key, doc_id, 50 + (doc_id % 100) / 50e0 as lat, -115 + (doc_id % 89) / 50e0 as lon from ft1 union all select key, doc_id, 50 + (doc_id % 83) / 50e0, -115 + (doc_id % 71) / 50e0 from ft1),
 feat as (select key, arg_min(name, doc_id) as name, (select round(min({_km('lat', 'lon')}), 3) from pts where pts.key = ft1.key) as km from ft1 group by key),
 fixed(key, target) as (values {_FIXED}), prov(key, name) as (values {_PROVINCES}),
 keys as (select key from reg union select key from feat union select key from fixed),
 dict as (select k.key, coalesce(p.name, ft.name, case when r.near then r.name end) as name, case when p.name is not null then 'alias' when ft.name is not null then 'osm' when r.near then 'cgndb' end as source, r.kind, r.rel,
   coalesce(ft2.name, case when r2.near then r2.name end) as plain, case when ft2.name is not null then 'osm' when r2.near then 'cgndb' end as plain_source, r2.kind as plain_kind, r2.rel as plain_rel,
   coalesce(r2.kind in ('city','town') and r2.rel >= 1000000, false) as small_ok
   from keys k left join fixed f on f.key = k.key left join prov p on p.key = coalesce(f.target, k.key) left join feat ft on ft.key = coalesce(f.target, k.key) left join reg r on r.key = coalesce(f.target, k.key)
   left join feat ft2 on ft2.key = k.key left join reg r2 on r2.key = k.key),
 posts as ({POSTS}),
 t as (select post_id, pos, tok, {_WORD.format('tok')} as w, lag(tok) over o as prev, lead(tok) over o as nxt from (select post_id, unnest({_TOKS}) as tok, unnest(range(len({_TOKS}))) as pos from posts) window o as (partition by post_id order by pos)),
 c0 as (select post_id, pos, 1 as n, w as span, prev, true as single from t where tok not like '#%' union all select post_id, pos, 2, w || ' ' || {_WORD.format('nxt')}, prev, false from t where nxt is not null and tok not like '#%' and nxt not like '#%'),
 c1 as (select c0.*, lower(span) as key, lower(coalesce(prev, '')) as before, regexp_matches(span, '\p{{Lu}}') and not regexp_matches(span, '\p{{Ll}}') as is_upper from c0),
 c2 as (select c1.*, case when e.key is not null then e.name else x.plain end as name, case when e.key is not null then e.source else x.plain_source end as source, case when e.key is not null then e.kind else x.plain_kind end as kind, case when e.key is not null then e.rel else x.plain_rel end as rel, coalesce(e.small_ok, false) as small_ok
   from c1 left join dict e on e.key = c1.key left join dict x on x.key = strip_accents(c1.key) where case when e.key is not null then e.name else x.plain end is not null),
 c3 as (select c2.*, w1.word is not null or (c2.key like '%s' and w2.word is not null) as is_word, w1.word is not null as is_common, coalesce(regexp_matches(prev, '^\p{{Lu}}'), false) and before not in {_list(V.PREPOSITIONS)} as named, case when e.key is not null then e.name else x.plain end as before_name
   from c2 left join common w1 on w1.word = c2.key left join common w2 on w2.word = left(c2.key, length(c2.key) - 1) left join dict e on e.key = c2.before left join dict x on x.key = strip_accents(c2.before)),
 ok as (select post_id, pos, n, span, name, null as tag from c3 where key not in {_list(V.BLOCK)} and ltrim(before, '#') not in {_list(V.STORMS)}
   and not (single and length(key) <= 3 and key in {_list(V.ALIASES)} and not is_upper)
   and case when not single then (select bool_and(regexp_matches(x, '^[\p{{Lu}}\p{{N}}]') or lower(x) in {_list(V.SMALL)}) from unnest(string_split(span, ' ')) u(x))
     when key in {_list(V.STOP)} then false when length(span) < 3 then key in {_list(V.ALIASES)} and is_upper when not regexp_matches(span, '^\p{{Lu}}') then not is_common and length(span) >= 5 and small_ok else not is_word end
   and not (single and source = 'cgndb' and named and before_name is null)
   and not (single and source = 'cgndb' and rel < 1000000 and kind = 'hamlet' and before not in {_list(V.PREPOSITIONS)})),
 tags as (select post_id, pos, tok, lower(tok[2:]) as tag from t where tok like '#%'),
 tagged as (select post_id, pos, 1 as n, tok as span, coalesce(d.name, f.name) as name, key as tag from (select *, left(tag, length(tag) - 5) as key from tags where tag like '%flood' and length(tag) > 6) g
   left join dict d using (key) left join (select replace(key, ' ', '') as squashed, min_by(name, key) as name from feat group by 1) f on f.squashed = g.key
   where coalesce(d.name, f.name) is not null and key not in {_list(V.BLOCK)} and key not in {_list(V.STOP)} and (length(key) >= 4 or key in {_list(V.ALIASES)})),
 best as (select post_id, pos, max(n) as n, arg_max(span, n) as span, arg_max(name, n) as name, arg_max(tag, n) as tag from (select * from ok union all select * from tagged) group by 1, 2),
 ahead as (select *, case when lead(pos) over o >= pos + n then lead(pos) over o else lead(pos, 2) over o end as follow, row_number() over o as k from best window o as (partition by post_id order by pos)),
 walk as (select post_id, pos, n, span, name, tag, follow from ahead where k = 1 union all select a.post_id, a.pos, a.n, a.span, a.name, a.tag, a.follow from walk w join ahead a on a.post_id = w.post_id and a.pos = w.follow),
 once as (select * from (select *, row_number() over (partition by post_id, name order by pos) as r from walk) where r = 1),
 cut as (select post_id, text, {_TOKS} as toks, string_split_regex(text, '#?[A-Za-zÀ-ÿ0-9''’\-.]+') as gaps from posts),
 placed as (select o.post_id, o.pos, o.n, o.span, o.name, o.tag, cast(list_sum(list_transform(gaps[1:pos + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(toks[1:pos], lambda g: length(g))), 0) as bigint) as start,
   cast(list_sum(list_transform(gaps[1:pos + n], lambda g: length(g))) + list_sum(list_transform(toks[1:pos + n], lambda g: length(g))) as bigint) as stop from once o join cut using (post_id))
"""


@query(_CTE + "select post_id, string_agg(concat(start, '-', stop, '=', name), ';' order by pos) as places from placed group by 1")
def extract(s, d):
    posts, g = event_posts(s, d), event(s, d)
    x = E.with_offsets(posts, E.extracted(posts, g), how="inner")
    return x.select("post_id", F.array_join(F.transform("places", lambda p: F.concat(p.start.cast("string"), F.lit("-"), p.end.cast("string"), F.lit("="), p.place["name"])), ";").alias("places"))


@query(
    _CTE
    + """, gap as (select post_id, pos, start, stop, coalesce(lag(stop) over (partition by post_id order by pos), 0) as since, case when span like '#%' then '#PLACE' || substr(lower(span[2:]), length(tag) + 1) else 'PLACE' end as new from placed),
 pieces as (select p.post_id, string_agg(substr(text, since + 1, start - since) || new, '' order by pos) as head, max(stop) as last from gap g join posts p using (post_id) group by 1)
 select posts.post_id, case when head is null then text else head || substr(text, last + 1) end as masked from posts left join pieces using (post_id)"""
)
def mask_spans(s, d):
    posts = event_posts(s, d)
    return E.masked(posts, E.extracted(posts, event(s, d)))


_SEED = r"seed as (select token, lower(token) as key from (select token, count(*) as df from (select distinct doc_id, unnest(regexp_extract_all(text, '#?[A-Za-zÀ-ÿ][\p{L}\p{N}_''’\-]*')) as token from documents) group by 1) where df between 5 and 40 and regexp_matches(token, '^[A-Z][a-z]{4,}$'))"


@query(
    rf"""with {_SEED}, t as (select doc_id, pos, tok, {_WORD.format('tok')} as w, lead(tok) over o as nxt, lead(tok, 2) over o as nxt2 from (select doc_id, unnest({_TOKS}) as tok, unnest(range(len({_TOKS}))) as pos from documents) window o as (partition by doc_id order by pos)),
 named as (select key from seed union select lower({_WORD.format('t[1]')} || ' ' || {_WORD.format('t[2]')} || ' ' || {_WORD.format('t[3]')}) from (select {_TOKS} as t from documents where doc_id % 3 = 0) where len(t) >= 3 union select lower({_WORD.format('t[1]')} || ' ' || {_WORD.format('t[2]')}) from (select {_TOKS} as t from documents where doc_id % 3 = 1) where len(t) >= 2),
 c as (select doc_id, 1 as n, lower(w) as key from t where tok not like '#%' union all select doc_id, 2, lower(w || ' ' || {_WORD.format('nxt')}) from t where nxt is not null and tok not like '#%' and nxt not like '#%' union all select doc_id, 3, lower(w || ' ' || {_WORD.format('nxt')} || ' ' || {_WORD.format('nxt2')}) from t where nxt2 is not null and tok not like '#%' and nxt not like '#%' and nxt2 not like '#%')
 select doc_id as post_id, n, count(*) as spans, count(distinct c.key) as names from c where n = 1 + length(c.key) - length(replace(c.key, ' ', '')) and (c.key in (select key from named) or strip_accents(c.key) in (select key from named)) group by 1, 2"""
)
def candidate_spans(s, d):
    """Spans of every length that a dictionary of words, and of the first two or three words of two texts in three, holds."""
    docs = table(s, d, "documents")
    seed = frequent(s, d).where(F.col("df").between(5, 40) & F.col("token").rlike("^[A-Z][a-z]{4,}$")).select(F.lower("token").alias("key"))
    t = docs.withColumn("t", F.transform(T.first_tokens(F.col("text"), 3), lambda w: F.trim(w, F.lit(".'’-")))).withColumn("k", 3 - F.col("doc_id") % 3)
    first = t.where("k > 1 and size(t) >= k").select(F.lower(F.array_join(F.slice("t", 1, F.col("k").cast("int")), " ")).alias("key"))
    keys = seed.union(first).distinct()
    place = F.struct(F.col("key").alias("name"), *[F.lit(None).alias(c) for c in ("lat", "lon", "kind", "source", "precision", "province", "cc", "pop", "rel")])
    g = E.plain_gazetteer(keys.select("key", place.alias("place")))
    spans = E.held_spans(docs.select(F.col("doc_id").alias("post_id"), "text"), g).where(F.size(F.split("key", " ")) == F.col("n"))
    return spans.groupBy("post_id", "n").agg(F.count("*").alias("spans"), F.count_distinct("key").alias("names"))


_ASKED = "select doc_id as id, case doc_id % 4 when 0 then 'Downtown ' when 1 then 'Town of ' when 2 then '' else 'Northern ' end || regexp_extract(text, '[A-Z][a-z][a-z][a-z][a-z]+', 0) || case doc_id % 3 when 0 then ' Nation 145' when 1 then ' area' else '' end as name from documents"


@query(
    _CTE
    + f"""select q.id, q.name, d.name as place, d.source from (select id, name, lower(regexp_extract(name, '[A-Z][a-z]{{4,}}(?: Nation| area|$)', 0)) as k0, id % 4 as a from ({_ASKED})) q left join dict d on d.key = replace(replace(k0, ' nation', ''), ' area', '') and a <> 3"""
)
def resolve_names(s, d):
    """Names with what people put around them; a word of direction leads to regions alone, of which this register has none."""
    asked = R._sql(s, d, _ASKED, "documents")
    g = N.sources(register(s, d), features(s, d))
    return N.resolved(asked, g, N.Context(centre=CENTRE)).select("id", "name", F.col("place.name").alias("place"), F.col("place.source").alias("source"))


@query()
def region_context(s, d):
    """The region that all posts are about, by two extractions."""
    from emberline.operators import context

    t = frequent(s, d)
    r = context.region_of(R.posts(s, d), N.sources(register(s, d, t), None, world(s, d, t)), common(s, d, t))
    lat, lon = r.centre or (None, None)
    return s.createDataFrame([(r.mode, r.country, lat, lon, r.foreign, ";".join(n for n, _ in r.top))], "mode string, country string, lat double, lon double, foreign boolean, top string")


@query()
def process_end_to_end(s, d):
    """The whole: region, gazetteer, masking, heads trained here, labels made before, review by rules, places and countries of labels."""
    from emberline.operators import review, scoring
    from emberline.plans.process import process

    posts, vectors = R.posts(s, d), table(s, d, "embeddings")
    n = vectors.agg(F.max("vec_id")).first()[0] + 1
    own = posts.select("post_id", (F.col("post_id") % n).alias("vec_id")).join(vectors.select("vec_id", "embedding"), "vec_id").select("post_id", "embedding")
    pick = lambda codes: F.get(F.array(*map(F.lit, codes)), (F.col("label") % len(codes)).cast("int"))
    train = vectors.select("embedding", (F.col("label") % 2).cast("int").alias("relevant"), pick(review.CATEGORIES).alias("category"), pick(review.HAZARDS).alias("hazard"))
    heads = scoring.trained_heads(train, "embedding", {"relevant": ["0", "1"], "category": review.CATEGORIES, "hazard": review.HAZARDS})
    before = table(s, d, "labels").where("doc_id % 7 = 0").select((F.col("doc_id") * 4).alias("group_id"), F.lit(0).alias("pos"), F.col("quality").alias("rel"), F.lit(0.9).alias("conf"), F.lit("AID").alias("cat"), F.lit(1).alias("urg"), F.lit("").alias("hazard"), F.lit("CA").alias("cc"), F.array(F.lit("Calgary"), F.lit("Alberta")).alias("places"))
    t = frequent(s, d)
    sources = N.sources(register(s, d, t), features(s, d), world(s, d, t))
    out = process(posts, sources, common(s, d, t), own, heads, precomputed=before, budget=3, batch=20, with_text=False)
    return out.select("post_id", "group_id", "rel", "cat", "urg", "hz", "cc", "decided_by", "place_hint", F.array_join(F.transform("places", lambda x: x.place["name"]), ";").alias("places"))
