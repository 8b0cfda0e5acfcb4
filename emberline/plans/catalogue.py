"""All queries of the engine and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.functions import text as T
from emberline.operators import gazetteer as G
from emberline.operators import extraction, grouping, metrics, review, sampling, scoring, terms, view
from emberline.plans import place_queries
from emberline.plans import relations as R
from emberline.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

S, W = r"[\s\p{Z}]", r"[\p{L}\p{N}_]"
P0, R0, L0 = f"({R.POSTS})", f"({R.RECORDS})", f"({R.PLACES})"
_KEY = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({{0}}), 'https?://[^\s\p{{Z}}]+', ' ', 'g'), '^{S}*rt{S}+@{W}+{S}*:?{S}*', ''), '@{W}+', ' ', 'g'), '(?:…|\.\.\.){S}*$', ''), '[^\p{{L}}\p{{N}}_#]+', ' ', 'g'))".replace("{S}", S).replace("{W}", W)


def _key(c: str) -> str:
    return _KEY.replace("{0}", c)


_CLEAN = rf"trim(regexp_replace(text, '{S}+', ' ', 'g'))"


def _posts_cte() -> str:
    inner = r"regexp_extract(text, '(?is)(?:^|[^\p{L}\p{N}_])RT" + S + "+@" + W + "+" + S + "*:?" + S + r"*(.+)$', 1)"
    return (
        "p as (select post_id, " + _CLEAN + " as text from " + P0 + "), k as (select *, " + _key("text") + " as key, " + _key(inner) + " as inner_key, "
        r"regexp_matches(text, '(?:^|[^\p{L}\p{N}_])RT" + S + "+@" + W + r"') as is_retweet, regexp_matches(text, '(?:…|\.\.\.)" + S + "*$') as truncated from p where text <> ''),"
        " b as (select distinct post_id, key as k from k where key <> '' union select distinct post_id, inner_key from k where inner_key <> ''), o as (select k, min(post_id) as owner from b group by k),"
        " e1 as (select distinct owner as src, post_id as dst from b join o using (k) where owner <> post_id),"
        " t as (select post_id as dst, regexp_replace(key, ' [^ ]*$', '') as prefix from k where truncated and length(key) >= 40),"
        " e2 as (select distinct owner as src, dst from t join o on starts_with(o.k, t.prefix) and t.prefix <> '' where owner <> dst)"
    )


_P = _posts_cte()
_G = _P + """, e as (select src a, dst b from e1 union select dst, src from e1 union select src, dst from e2 union select dst, src from e2),
 r as (select post_id as v, post_id as c from k union select e.b, r.c from r join e on e.a = r.v), m as (select v, min(c) as group_id from r group by v),
 g as (select k.*, m.group_id, count(*) over (partition by m.group_id) as group_size, row_number() over (partition by m.group_id order by (case when is_retweet then 0 else 10000 end) + length(text) desc, post_id) = 1 as is_canonical from k join m on m.v = k.post_id)"""

_CAT, _HZ = "case when coalesce(cat,'')='' then 'OTHER' else cat end", "case when coalesce(hz,'')='' then 'FLOOD' else hz end"
_UNSURE = "((decided_by='local' and p between 0.15 and 0.85) or conf < 0.5)"
SPEC = view.ViewSpec(hazards=("FLOOD", "STORM", "FIRE"), countries=("N1", "N2", "N3", "N4", "N5", "N6", "N7", "??"), urgencies=(1, 2, 3))
_C = {"unique": "canon", "relevance": "rel=1", "hazard": f"(rel=0 or {_HZ} in ('FLOOD','STORM','FIRE'))", "country": "coalesce(cc,'??') in ('N1','N2','N3','N4','N5','N6','N7','??')", "urgency": "urg in (1,2,3)"}
_WIDE, _WHERE_WIDE = view.ViewSpec(), "canon and rel=1"


def _where(skip: str = "") -> str:
    return " and ".join(v for k, v in _C.items() if k != skip)


def query(oracle: str | None = None):
    def add(f):
        name = "q_" + f.__name__.removeprefix("_")
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _docs(s, d):
    return table(s, d, "documents")


# --- grouping ---------------------------------------------------------------------------------------------------------------


@query(f"select post_id, {_key('text')} as key from {P0}")
def norm_key(s, d):
    return R.posts(s, d).select("post_id", T.norm_key(F.col("text")).alias("key"))


@query(f"with {_P} select src, dst from e1")
def dup_edges(s, d):
    return grouping.dup_edges(grouping.keyed(R.posts(s, d)))


@query(f"with {_P} select src, dst from e2")
def trunc_edges(s, d):
    return grouping.trunc_edges(grouping.keyed(R.posts(s, d)))


@query(f"with recursive {_G} select post_id, group_id from g")
def groups(s, d):
    return grouping.grouped(R.posts(s, d)).select("post_id", "group_id")


@query(f"with recursive {_G} select group_id, count(*) as group_size from g group by 1")
def group_size(s, d):
    return grouping.grouped(R.posts(s, d)).groupBy("group_id").agg(F.count("*").alias("group_size"))


@query(f"with recursive {_G} select post_id, group_id, group_size, text from g where is_canonical")
def canonical(s, d):
    return grouping.grouped(R.posts(s, d)).where("is_canonical").select("post_id", "group_id", "group_size", "text")


@query(f"with recursive {_G} select count(*) as n_rows, count(distinct group_id) as n_groups, count(*) filter (is_retweet) as retweets, count(*) filter (truncated) as truncated, count(distinct group_id) filter (group_size > 1) as multi from g")
def clean_report(s, d):
    return grouping.grouped(R.posts(s, d)).agg(F.count("*").alias("n_rows"), F.count_distinct("group_id").alias("n_groups"), F.count_if("is_retweet").alias("retweets"), F.count_if("truncated").alias("truncated"), F.count_distinct(F.when(F.col("group_size") > 1, F.col("group_id"))).alias("multi"))


# --- text -------------------------------------------------------------------------------------------------------------------


@query(f"select doc_id, {_CLEAN} as text from documents where {_CLEAN} <> ''")
def clean_nonempty(s, d):
    return _docs(s, d).select("doc_id", T.clean_text(F.col("text")).alias("text")).where("text <> ''")


@query(f"select post_id, regexp_matches(text, '(?:^|[^\\p{{L}}\\p{{N}}_])RT{S}+@{W}') as is_retweet, regexp_matches(text, '(?:…|\\.\\.\\.){S}*$') as truncated from {P0}")
def retweet_flags(s, d):
    return R.posts(s, d).select("post_id", T.is_retweet(F.col("text")).alias("is_retweet"), T.is_truncated(F.col("text")).alias("truncated"))


_TOK = r"#?[A-Za-zÀ-ÿ][\p{L}\p{N}_''’\-]*"


@query(f"select token, count(*) as n from (select unnest(regexp_extract_all(text, '{_TOK}')) as token from documents) group by 1")
def tokens(s, d):
    return _docs(s, d).select(F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_BARE = rf"regexp_replace(regexp_replace(text, 'https?://[^\s\p{{Z}}]+', ' ', 'g'), '@{W}+', ' ', 'g')"
_PLAIN = f"select distinct doc_id, lang, lower(ltrim(t, '#')) as token from (select doc_id, lang, unnest(regexp_extract_all({_BARE}, '{_TOK}')) as t from documents)"


@query(f"select token, count(*) as df from ({_PLAIN}) group by 1 having count(*) >= 3")
def doc_freq(s, d):
    return terms.document_frequency(_docs(s, d))


_CAPS = f"select distinct doc_id, ltrim(lower(t), '#') as token from (select doc_id, unnest(regexp_extract_all({_BARE}, '{_TOK}')) as t from documents where lang='fr') where regexp_matches(t, '^[#\\p{{Lu}}]')"
_COMMON = ("bien", "fait", "go", "mak")


def _listed_sql(words) -> str:
    return "(" + ",".join(f"'{w}'" for w in words) + ")"


@query(f"""with a as ({_CAPS}), f as (select token, count(*) as df from a group by 1), b as (select token, count(*) as back from ({_PLAIN}) where lang<>'fr' group by 1 having count(*) >= 3),
 z as (select (select count(*) from documents where lang='fr') as n, (select count(*) from documents where lang<>'fr') as m), x as (select *, regexp_replace(token, '[''’]s$', '') as base from f)
 select token, df from x left join b using (token) cross join z where df/n >= 0.004 and (df/n) / ((coalesce(back,0)+1)/(m+1)) >= 8 and length(token) >= 3 and token not in {_listed_sql(terms.KEEP)} and not regexp_matches(base, '[''’]')
 and base not in {_listed_sql(_COMMON)} and rtrim(base, 's') not in {_listed_sql(_COMMON)} and not (ends_with(base, 'ing') and (left(base, -3) in {_listed_sql(_COMMON)} or left(base, -3) || 'e' in {_listed_sql(_COMMON)}))""")
def distinctive_terms(s, d):
    x = _docs(s, d)
    return terms.distinctive_terms(x.where("lang = 'fr'"), x.where("lang <> 'fr'"), common=_COMMON)


@query("select doc_id, lower(strip_accents(text)) as folded from documents")
def fold(s, d):
    return _docs(s, d).select("doc_id", T.fold("text").alias("folded"))


@query(f"select post_id, cast(regexp_matches(text, '(?i){'|'.join(T.KEYWORDS)}') as int) as keyword, cast(contains(text, 'PLACE') as int) as place, cast(starts_with(text, 'RT ') as int) as retweet, cast(contains(text, 'URL') as int) as link from {P0}")
def flags(s, d):
    return R.posts(s, d).select("post_id", T.flags(F.col("text")).alias("f")).select("post_id", "f.*")


@query(rf"select post_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(^|[^\p{{L}}\p{{N}}_])(#?)(?i:other|that|the|for)', '\1\2PLACE', 'g'), 'https?://[^\s\p{{Z}}]+', 'URL', 'g'), '@{W}+', '@user', 'g'), '(?:PLACE{S}*)+', 'PLACE ', 'g'), '^{S}+|{S}+$', '', 'g') as masked from {P0}")
def mask_terms(s, d):
    return R.posts(s, d).select("post_id", T.mask_terms(F.col("text"), ["the", "that", "for", "other"]).alias("masked"))


@query()
def mask_nouns(s, d):
    return R.posts(s, d).select("post_id", terms.mask_proper_nouns(F.col("text"), ("the", "and")).alias("masked"))


@query()
def place_hint(s, d):
    return R.posts(s, d).select("post_id", T.place_hint(F.col("text"), F.lit(None).cast("array<string>")).alias("hinted"))


@query("select n_nationkey, case when n_nationkey % 2 = 0 then n_name || ';Alberta;' || 'Ontario' else n_name || ';Alberta' end as locs from nation")
def norm_locations(s, d):
    raw = F.when(F.col("n_nationkey") % 2 == 0, F.concat("n_name", F.lit(",ab; alberta;On;"), F.lower("n_name"))).otherwise(F.concat("n_name", F.lit(" , AB")))
    return table(s, d, "nation").select("n_nationkey", T.norm_locations(raw).alias("locs"))


@query("select n_nationkey, cast(n_nationkey % 5 as bigint) as a, cast(n_nationkey as bigint) as b from nation")
def citations(s, d):
    t = F.concat(F.lit("see ["), (F.col("n_nationkey") % 5).cast("string"), F.lit("] and ["), F.col("n_nationkey").cast("string"), F.lit("]."))
    return table(s, d, "nation").select("n_nationkey", T.citations(t).alias("c")).select("n_nationkey", F.get("c", F.lit(0)).alias("a"), F.get("c", F.lit(1)).alias("b"))


@query("select doc_id, left(sha256(text), 24) as h from documents")
def hash(s, d):  # noqa: A001
    return _docs(s, d).select("doc_id", F.substring(F.sha2(F.col("text"), 256), 1, 24).alias("h"))


@query("select 'words_of_it' as text_col, avg(length(text)) as mean_chars from documents")
def text_col_fallback(s, d):
    from emberline.sources.files import detect_columns

    x = _docs(s, d).withColumnRenamed("text", "words_of_it")
    name, _ = detect_columns(x)
    return x.agg(F.lit(name).alias("text_col"), F.avg(F.length(name)).alias("mean_chars"))


@query("select row_number() over (order by event_id) - 1 as row_id, event_id from events")
def row_ids(s, d):
    from emberline.sources.files import with_row_ids

    return with_row_ids(table(s, d, "events").select("event_id")).select("row_id", "event_id")


@query("select conv_id, turn, lag(role) over (partition by conv_id order by turn) as prev_role from conversations")
def prev_role(s, d):
    return table(s, d, "conversations").select("conv_id", "turn", F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("prev_role"))


@query(
    r"with t as (select doc_id, unnest(regexp_extract_all(text, '#?[A-Za-zÀ-ÿ0-9''’\-.]+')) as tok, unnest(range(len(regexp_extract_all(text, '#?[A-Za-zÀ-ÿ0-9''’\-.]+')))) as pos from documents), l as (select *, lag(tok) over (partition by doc_id order by pos) as prev from t) select doc_id, count(*) as tokens, count(*) filter (prev is null) as first, count(*) filter (regexp_matches(prev, '^\p{Lu}') and regexp_matches(tok, '^\p{Lu}')) as both_capital, count(*) filter (lower(prev) in ('in', 'at', 'of', 'to', 'the', 'de', 'des')) as after_small from l group by 1"
)
def prev_token(s, d):
    """What stands before each token, which tells people, storms and places apart."""
    t = extraction.token_rows(table(s, d, "documents"), "doc_id", "text")
    big = lambda c: F.coalesce(F.col(c).rlike(r"^\p{Lu}"), F.lit(False))
    count = lambda c: F.count_if(c).cast("long")
    return t.groupBy("doc_id").agg(F.count("*").alias("tokens"), count(F.col("prev").isNull()).alias("first"), count(big("prev") & big("t0")).alias("both_capital"), count(F.lower("prev").isin("in", "at", "of", "to", "the", "de", "des")).alias("after_small"))


# --- view -------------------------------------------------------------------------------------------------------------------


@query(f"select id, g, n from {R0} where {_where()}")
def view_filter(s, d):
    return R.plain_records(s, d).where(view.matches(SPEC)).select("id", "g", "n")


@query(f"select id from {R0} where canon and {_UNSURE}")
def view_filter_unsure(s, d):
    return R.plain_records(s, d).where(view.matches(view.ViewSpec(relevance="unsure"))).select("id")


@query(f"select id from {R0} where canon and (hz in ('STORM') or coalesce(hz,'')='') and cat in ('INFRA','AID') and urg in (0,1,2)")
def view_filter_alt(s, d):
    spec = view.ViewSpec(relevance="all", hazards=("STORM",), categories=("INFRA", "AID"), urgencies=(0, 1, 2), loose=True)
    return R.plain_records(s, d).where(view.matches(spec)).select("id")


@query(f"select id from {R0} r where canon and rel=1 and contains(lower(text),'th') and ts between '2024-01-01' and '2024-01-02' and exists (select 1 from {L0} l where l.id=r.id and prec<>'region')")
def view_filter_mapped(s, d):
    spec = view.ViewSpec(mapped_only=True, query="TH", start="2024-01-01", end="2024-01-02")
    return R.records(s, d).where(view.matches(spec)).select("id")


_FACETS = f"select 'hazard' as facet, {_HZ} as value, count(*) as n from {R0} where {_where('hazard')} and rel=1 group by 2 union all select 'category', {_CAT}, count(*) from {R0} where {_where('category')} and rel=1 group by 2 union all select 'country', coalesce(cc,'??'), count(*) from {R0} where {_where('country')} group by 2 union all select 'urgency', cast(urg as varchar), count(*) from {R0} where {_where('urgency')} group by 2"


@query(_FACETS)
def facets(s, d):
    return view.facets(R.plain_records(s, d), SPEC)


@query(f"with f as (select value, n from ({_FACETS}) where facet='country') select * from (select * from f order by value='??', n desc, value limit 12) union select * from f where value in ('N1','N2','N3','N4','N5','N6','N7','??')")
def facet_countries(s, d):
    return view.facet_countries(R.plain_records(s, d), SPEC)


@query(f"select name, count(*) as n, max(urg) as urg, arg_min(lat, r.id) as lat, arg_min(lon, r.id) as lon, arg_min(prec, r.id) as prec, round(least(34.0, 5 + 3.2*sqrt(count(*))), 6) as radius from {R0} r join {L0} l on l.id=r.id where {_WHERE_WIDE} and prec<>'region' group by name")
def place_agg(s, d):
    return view.place_agg(R.records(s, d), _WIDE).withColumn("radius", F.round("radius", 6))


@query(f"select cc, count(*) as n, any_value(lat) as lat, any_value(lon) as lon, round(least(40.0, 7 + 2.2*sqrt(count(*))), 6) as radius from {R0} r join (select distinct cc, lat, lon from {L0}) c using (cc) where {_WHERE_WIDE} group by cc")
def country_agg(s, d):
    return view.country_agg(R.plain_records(s, d), _WIDE, R.places(s, d).select("cc", "lat", "lon").distinct()).withColumn("radius", F.round("radius", 6))


@query(f"with x as (select name, {_CAT} as c, count(*) as n, min(r.id) as at0 from {R0} r join {L0} l on l.id=r.id where {_WHERE_WIDE} group by 1,2) select name, c, n from (select *, row_number() over (partition by name order by n desc, at0) as k from x) where k=1")
def dominant(s, d):
    rows = R.records(s, d).where(view.matches(_WIDE)).select("id", view.cat().alias("c"), F.explode("places").alias("x")).select("id", "c", "x.name")
    return view.dominant(rows, "name", "c", "id")


@query(f"select count(*) as rows, count(*) filter (canon) as uniq, count(*) filter (canon and rel=1) as relevant, count(*) filter (canon and rel=1 and {_HZ}='FLOOD') as floods, count(*) filter ({_where()}) as in_view, count(*) filter ({_where()} and id in (select id from {L0} where prec<>'region')) as mapped, count(distinct case when {_where()} then cc end) as countries from {R0}")
def kpis(s, d):
    return view.kpis(R.records(s, d), SPEC)


def _timeline_sql(source: str, inside: str) -> str:
    return f"""with t as (select epoch_us(ts) as t, {inside} as seen from {source} where ts is not null), e as (select min(t) lo, max(t) hi from t),
 w as (select lo, hi, case when hi-lo > 20*86400000000 then 86400000000 when hi-lo > 2*86400000000 then 6*3600000000 else 3600000000 end as w from e),
 b as (select unnest(range(0, (hi-lo)//w + 1)) as bin from w), n as (select (t-lo)//w as bin, count(*) as total, count(*) filter (seen) as seen from t, w group by 1)
 select b.bin as bin, coalesce(total,0) as total, coalesce(seen,0) as seen from b left join n on n.bin=b.bin"""


@query(_timeline_sql(f"(select * from {R0} where canon and rel=1)", _where()))
def timeline(s, d):
    return view.timeline_of(R.plain_records(s, d), SPEC)


@query(_timeline_sql("events", "event_type='click'"))
def timeline_events(s, d):
    return view.timeline(table(s, d, "events"), F.col("event_type") == "click")


@query(f"select quantile_disc(lat,0.01) as south, quantile_disc(lat,0.99) as north, quantile_disc(lon,0.01) as west, quantile_disc(lon,0.99) as east from {R0} r join {L0} l on l.id=r.id where {_WHERE_WIDE} and prec<>'region'")
def fit_bounds(s, d):
    return view.fit_bounds(R.records(s, d), _WIDE)


@query(
    f"with p as (select l.name, count(*) as n, arg_min(l.lat, r.id) as lat, arg_min(l.lon, r.id) as lon from {R0} r join {L0} l on l.id=r.id where {_WHERE_WIDE} and prec<>'region' group by 1), w as (select lat, lon, unnest(range(n)) as k from p), b as (select quantile_cont(lat, 0.05) as south, quantile_cont(lat, 0.95) as north, quantile_cont(lon, 0.05) as west, quantile_cont(lon, 0.95) as east from w) select round(south, 6) as south, round(north, 6) as north, round(west, 6) as west, round(east, 6) as east, round(least(10.0, greatest(1.0, 8 - sqrt(greatest(greatest(north - south, 0.05), greatest(east - west, 0.05) / 1.6)))), 6) as zoom, round((south + north) / 2, 6) as lat, round((west + east) / 2, 6) as lon from b"
)
def fit_bounds_weighted(s, d):
    x = view.fit_bounds_weighted(R.records(s, d), _WIDE)
    return x.select(*[F.round(c, 6).alias(c) for c in x.columns])


@query(f"select id, urg, n, conf from {R0} where {_WHERE_WIDE} order by urg desc, n desc, conf desc, id limit 60")
def list_urgent(s, d):
    return view.listed(R.plain_records(s, d), _WIDE, "urgent").select("id", "urg", "n", "conf")


@query(f"select id, n, urg from {R0} where {_WHERE_WIDE} order by n desc, urg desc, id limit 60")
def list_shared(s, d):
    return view.listed(R.plain_records(s, d), _WIDE, "shared").select("id", "n", "urg")


@query(f"select id from {R0} where {_WHERE_WIDE} order by ts desc nulls last, id limit 60")
def list_newest(s, d):
    return view.listed(R.plain_records(s, d), _WIDE, "newest").select("id")


@query(f"select name, count(*) as n from {L0} group by 1 order by n desc, name limit 10")
def top_places(s, d):
    return R.places(s, d).groupBy("name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "name").limit(10)


@query(f"select id from {R0} r where {_WHERE_WIDE} and id in (select id from {L0} where name=(select n_name from nation where n_nationkey=7)) order by urg desc, n desc, conf desc, id limit 4")
def place_popup(s, d):
    name = table(s, d, "nation").where("n_nationkey = 7").first()["n_name"]
    return view.place_popup(R.records(s, d), _WIDE, name).select("id")


@query(f"select count(distinct {_HZ}) as hazards, count(distinct {_HZ})>1 and avg(case when {_HZ}='FLOOD' then 1e0 else 0 end)<0.97 as multi_hazard, count(distinct {_HZ})>1 and avg(case when {_HZ}='FLOOD' then 1e0 else 0 end)<0.97 as filter_hazard from {R0} where rel=1 and canon")
def default_filters(s, d):
    return view.default_filters(R.plain_records(s, d))


@query(f"select id, g, n, canon, rel, p, conf, cat, urg, hz, cc, strftime(ts, '%Y-%m-%dT%H:%M:%S') as ts from {R0}")
def records(s, d):
    return view.served(R.plain_records(s, d))


_FIRST3 = f"(select id, string_agg(name, ';' order by pos) as places from {L0} where pos < 3 group by id)"


@query(f"select r.id as id, g, n, urg, {_CAT} as cat, conf, hz, cc, coalesce(places,'') as places from {R0} r left join {_FIRST3} l on l.id=r.id where canon and rel=1")
def summary_rows(s, d):
    return view.summary_rows(R.records(s, d))


@query(f"select r.id as id, name as place, lon, lat from {R0} r join {L0} l on l.id=r.id where {_WHERE_WIDE}")
def geojson(s, d):
    x = view.geojson(R.records(s, d), _WIDE)
    f = F.from_json("feature", "geometry struct<coordinates:array<double>>, properties struct<place:string>")
    return x.select("id", f.alias("f")).select("id", F.col("f.properties.place").alias("place"), F.col("f.geometry.coordinates")[0].alias("lon"), F.col("f.geometry.coordinates")[1].alias("lat"))


@query(f"select r.id as id, g, n, rel, p, conf, {_CAT} as cat, urg, hz, cc, coalesce(places,'') as places from {R0} r left join {_FIRST3} l on l.id=r.id where {_WHERE_WIDE}")
def csv_export(s, d):
    return view.csv_rows(R.records(s, d), _WIDE)


@query(f"select id, bool_or(prec='point') as any_point, string_agg(name, ';' order by pos) as names, count(*) as n from {L0} group by id")
def arrays(s, d):
    x = view.with_places(_docs(s, d).select(F.col("doc_id").alias("id")), R.places(s, d)).where(F.size("places") > 0)
    return x.select("id", F.exists("places", lambda p: p.prec == "point").alias("any_point"), F.array_join(F.transform("places", lambda p: p["name"]), ";").alias("names"), F.size("places").cast("long").alias("n"))


@query("select event_id, cast(json_extract_string(props, '$.k') as bigint) as k from events")
def json(s, d):
    return table(s, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') as iso from events")
def ts_parse(s, d):
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(s, d, "events").select("event_id", F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd'T'HH:mm:ss").alias("iso"))


_SCORE = "log2(1+n) + 1.5*urg + conf + 0.5*(case when places is null then 0 else 1 end)"


@query(f"""with r as (select r.*, {_CAT} as c, places, {_SCORE} as score from {R0} r left join {_FIRST3} l on l.id=r.id where {_WHERE_WIDE}),
 q as (select c, greatest(3, round_even(40 * count(*) / sum(count(*)) over (), 0)) as quota from r group by c), x as (select r.*, row_number() over (partition by r.c order by score desc, id) <= quota as picked from r join q using (c))
 select id, round(score, 6) as score from x order by picked desc, x.score desc, id limit 40""")
def representative(s, d):
    x = R.records(s, d).where(view.matches(_WIDE))
    return view.representative(x, 40).select("id", F.round("score", 6).alias("score"))


# --- metrics ----------------------------------------------------------------------------------------------------------------


def _scored(s, d):
    return table(s, d, "labels").withColumn("p", ((F.col("doc_id") * 37) % 1000) / F.lit(1000.0)).withColumn("guess", (F.col("p") >= 0.5).cast("int"))


_SC = "(select doc_id, quality, toxic, ((doc_id*37)%1000)/1000e0 as p, cast(((doc_id*37)%1000)/1000e0 >= 0.5 as int) as guess from labels)"


@query(f"""with a as (select count(*) as n, count(*) filter (quality=1 and guess=1) as tp, count(*) filter (quality<>1 and guess=1) as fp, count(*) filter (quality=1 and guess<>1) as fn, avg(case when quality=guess then 1e0 else 0 end) as acc from {_SC})
 select n, tp, fp, fn, round(acc,6) as acc, round(tp/greatest(tp+fp,1),6) as precision, round(tp/greatest(tp+fn,1),6) as recall, round(2*(tp/greatest(tp+fp,1))*(tp/greatest(tp+fn,1))/((tp/greatest(tp+fp,1))+(tp/greatest(tp+fn,1))),6) as f1 from a""")
def prf(s, d):
    x = metrics.prf(_scored(s, d), "quality", "guess")
    return x.select("n", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("acc", "precision", "recall", "f1")])


@query(f"with x as (select quality, (rank() over (order by p) + (count(*) over (partition by p) - 1)/2e0) as r from {_SC}) select round((sum(r) filter (quality=1) - count(*) filter (quality=1)*(count(*) filter (quality=1)+1)/2e0)/(count(*) filter (quality=1)*count(*) filter (quality<>1)),6) as auc from x")
def auc(s, d):
    return metrics.auc(_scored(s, d), "quality", "p").select(F.round("auc", 6).alias("auc"))


@query(f"select a, b, count(*) as n from (select toxic + 2*quality as a, cast(doc_id % 3 as int) as b from {_SC}) where a<>b group by 1,2 order by n desc, a, b limit 6")
def confusion(s, d):
    return metrics.confusion(_scored(s, d).select((F.col("toxic") + 2 * F.col("quality")).alias("a"), (F.col("doc_id") % 3).cast("int").alias("b")), "a", "b")


@query(f"""select lo, hi, round(avg(case when p between lo and hi then 1e0 else 0 end),6) as reviewed, round(avg(case when p between lo and hi then case when guess=quality then 1e0 else 0 end end),6) as acc_in,
 round(avg(case when not p between lo and hi then case when guess=quality then 1e0 else 0 end end),6) as acc_out, round(avg(case when (case when p between lo and hi then quality else guess end)=quality then 1e0 else 0 end),6) as acc
 from {_SC} cross join (values (0.15e0,0.85e0),(0.05e0,0.95e0),(0e0,1e0)) v(lo,hi) group by 1,2""")
def band_sim(s, d):
    x = metrics.bands(_scored(s, d), [(0.15, 0.85), (0.05, 0.95), (0.0, 1.0)], "quality", "p", "quality")
    return x.select("lo", "hi", *[F.round(c, 6).alias(c) for c in ("reviewed", "acc_in", "acc_out", "acc")])


@query("select quality, round(sqrt(max(count(*)) over () / count(*)),6) as weight from labels group by quality")
def class_weights(s, d):
    return metrics.class_weights(table(s, d, "labels"), "quality").withColumn("weight", F.round("weight", 6))


@query(f"select source, round(avg(case when p>=0.5 then 1e0 else 0 end),6) as share from {_SC} join documents using (doc_id) group by 1")
def event_share(s, d):
    return _scored(s, d).join(_docs(s, d).select("doc_id", "source"), "doc_id").groupBy("source").agg(F.round(F.avg((F.col("p") >= 0.5).cast("double")), 6).alias("share"))


@query("select lang, count(*) as n, round(avg(quality),6) as good, count(*) filter (toxic=1) as toxic from labels join documents using (doc_id) group by 1")
def label_balance(s, d):
    return table(s, d, "labels").join(_docs(s, d).select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"))


@query(f"select hz, count(*) as n from {R0} group by 1 order by n desc, hz limit 8")
def value_counts(s, d):
    return R.plain_records(s, d).groupBy("hz").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hz").limit(8)


@query()
def place_match(s, d):
    x = R.places(s, d).groupBy("id").agg(F.collect_list("name").alias("gold"))
    return metrics.place_scores(x.withColumn("found", F.transform("gold", lambda n: F.concat(n, F.lit("s")))), "gold", "found")


# --- review -----------------------------------------------------------------------------------------------------------------


@query(f"select id, cast(p>=0.5 as int) as relevant, round(2*abs(p-0.5),6) as confidence, round(1-2*abs(p-0.5),6) as uncertainty from {R0}")
def confidence(s, d):
    r, c, u = review.confidence(F.col("p"))
    return R.plain_records(s, d).select("id", r.alias("relevant"), F.round(c, 6).alias("confidence"), F.round(u, 6).alias("uncertainty"))


_PLAN = f"with q as (select *, case when p between 0.15 and 0.85 then 1 when p>0.85 then 2 else 3 end as tier from {R0} where canon and decided_by='local'), x as (select id, tier, row_number() over (order by tier, case when tier=2 then 1-cast(urg=3 as int) else 0 end, case when tier=1 then abs(p-0.5) else -p end, id) - 1 as pos from q)"


def _plan(s, d, budget, batch):
    x = R.plain_records(s, d).where("canon and decided_by = 'local'").withColumn("hinted", F.col("urg") == 3)
    return review.planned(x, budget, batch)


@query(f"{_PLAN} select id, tier, pos, pos // 20 as batch from x where pos < 9*20")
def plan_budget(s, d):
    return _plan(s, d, 10, 20).select("id", "tier", F.col("pos").cast("long").alias("pos"), "batch")


@query(f"{_PLAN} select pos // 7 as batch, count(*) as n, min(id) as lo from x where pos < 5*7 group by 1")
def batches(s, d):
    return _plan(s, d, 5, 7).groupBy("batch").agg(F.count("*").alias("n"), F.min("id").alias("lo"))


@query("select doc_id as id, cast(doc_id % 2 as int) as rel, cast(doc_id % 10 as int) as conf, case when doc_id % 2 = 0 then '' when doc_id % 5 = 0 then 'OTHER' else 'INFRA' end as cat, case when doc_id % 2 = 0 then 0 when doc_id % 5 = 0 then 1 else cast(doc_id % 4 as int) end as urg, case when doc_id % 2 = 1 then 'High River' else '' end as places, case when doc_id % 2 = 1 and doc_id % 7 = 0 then 'QUAKE' end as hazard, case when doc_id % 2 = 1 and doc_id % 7 = 0 and doc_id % 5 <> 0 then 'CA' end as cc from documents where doc_id % 3 <> 2 and not (doc_id % 7 = 0 and doc_id % 5 = 0)")
def parse_labels(s, d):
    i, odd = F.col("doc_id"), F.col("doc_id") % 2 == 1
    urg = (i % 4).cast("string")
    tail = F.when(odd & (i % 7 == 0), F.concat(F.lit("|quake|Infra|"), urg, F.lit("|ca|High River; -"))).when(odd & (i % 5 == 0), F.lit("|-|High River")).when(odd, F.concat(F.lit("|infra|-|"), urg, F.lit("|High River")))
    good = F.concat(F.lit(" `"), i.cast("string"), F.lit("| "), (i % 2).cast("string"), F.lit(" |"), (i % 10).cast("string"), F.coalesce(tail, F.lit("")), F.lit("`"))
    lines = F.when(i % 3 == 2, F.concat(i.cast("string"), F.lit("|2|9\nnot a line\n|1|"))).otherwise(F.concat(good, F.lit("\n"), i.cast("string"), F.lit("|0|1")))
    x = review.parsed(_docs(s, d).where("not (doc_id % 7 = 0 and doc_id % 5 = 0)").select((i * 1).alias("batch"), lines.alias("answer")))
    return x.select("id", "rel", "conf", "cat", "urg", F.array_join("places", ";").alias("places"), "hazard", "cc")


_FIRST = "select g, quality as lrel, case when doc_id % 2 = 0 then 'AID' else '' end as lcat, cast(doc_id % 4 as int) as lurg, case when doc_id % 5 = 0 then '' else 'FIRE' end as lhz, case when doc_id % 4 = 0 then 'C' when doc_id % 3 = 0 then 'CA' end as lcc, (doc_id % 10) / 10e0 as lconf from (select doc_id - doc_id % 3 as g, doc_id, quality, row_number() over (partition by doc_id - doc_id % 3 order by doc_id) as k from labels) where k=1"


@query(f"with f as ({_FIRST}) select id, coalesce(lrel, rel) as rel, round(coalesce(lconf, conf), 6) as conf, case when lrel=1 and lcat<>'' then lcat else cat end as cat, case when lrel=1 then lurg else urg end as urg, case when lrel=1 then case when lhz='' then 'STORM' else lhz end else hz end as hz, case when lrel=1 then case when length(lcc)=2 then lcc end else cc end as cc, case when f.g is not null then 'llm' else decided_by end as decided_by from {R0} r left join f on f.g=r.g")
def precomputed_override(s, d):
    i = F.col("doc_id")
    labels = table(s, d, "labels").select((i - i % 3).alias("g"), i.alias("pos"), F.col("quality").alias("rel"), F.when(i % 2 == 0, "AID").otherwise("").alias("cat"), (i % 4).cast("int").alias("urg"), F.when(i % 5 == 0, "").otherwise("FIRE").alias("hazard"), F.when(i % 4 == 0, "C").when(i % 3 == 0, "CA").alias("cc"), ((i % 10) / F.lit(10.0)).alias("conf"))
    x = review.precomputed(R.plain_records(s, d), labels, default_hazard="STORM")
    return x.select("id", "rel", F.round("conf", 6).alias("conf"), "cat", "urg", "hz", "cc", "decided_by")


@query(f"select r.id as id, c.urg as urg, c.cat as cat from {R0} r left join (select g, urg, cat from {R0} where canon) c on c.g=r.g")
def propagate(s, d):
    x = R.plain_records(s, d)
    return review.propagated(x.select("id", "g"), x.where("canon"), ["urg", "cat"], "g").select("id", "urg", "cat")


@query(f"select id, case when rel=0 then '' else cat end as cat, case when rel=0 then '' else hz end as hz, case when rel=0 then 0 else urg end as urg from {R0}")
def null_irrelevant(s, d):
    return review.blanked(R.plain_records(s, d)).select("id", "cat", "hz", "urg")


@query(f"with v as (select id, cc, sum(case when prec='region' then 1 else 2 end) as w, min(pos) as at0 from {L0} group by 1,2), b as (select id, cc from (select *, row_number() over (partition by id order by w desc, at0) as k from v) where k=1) select r.id as id, coalesce(case when length(r.cc)=2 then r.cc end, b.cc, 'ZZ') as voted_cc from {R0} r left join b on b.id=r.id")
def country_vote(s, d):
    return G.country_vote(R.records(s, d), event_cc="ZZ").select("id", "voted_cc")


@query(f"with l as (select l.*, case when prec='region' then 'state' else 'city' end as kind from (select id, pos, name, prec, concat('C', cast(length(name) % 3 as varchar)) as cc from {L0}) l), v as (select id, cc, sum(case when kind='state' then 2 else 1 end) as w, min(pos) as at0 from l group by 1,2), t as (select id, cc as top, w from (select *, row_number() over (partition by id order by w desc, at0) as k from v) where k=1) select l.id as id, string_agg(name, ';' order by pos) as names from l join t using (id) where w < 2 or cc = top or kind = 'state' group by 1")
def consistency(s, d):
    x = R.places(s, d).select("id", "pos", "name", F.when(F.col("prec") == "region", "state").otherwise("city").alias("kind"), F.concat(F.lit("C"), (F.length("name") % 3).cast("string")).alias("cc"), F.lit(0).cast("long").alias("pop"))
    a = x.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "kind", "cc", "pop"))), lambda p: F.struct(p["name"].alias("name"), p.kind.alias("kind"), p.cc.alias("cc"), p["pop"].alias("pop"))).alias("places"))
    return a.select("id", F.array_join(F.transform(G.consistent("places"), lambda p: p["name"]), ";").alias("names"))


@query(
    f"with r as (select *, {_CAT} as c from {R0} where {_WHERE_WIDE}), q as (select r.*, log2(1 + n) + 1.5 * urg + conf + (case when id % 13 % 4 > 0 then 0.5 else 0 end) as score from r), s as (select c, greatest(3.0, round_even(12 * count(*) / sum(count(*)) over (), 0)) as quota from r group by 1), k as (select q.*, quota, row_number() over (partition by q.c order by score desc, id) as rk from q join s on s.c = q.c), t as (select * from k order by rk <= quota desc, score desc, id limit 12), o as (select *, row_number() over (order by score desc, id) - 1 as nr from t),"
    f" p as (select id, string_agg(name, ',' order by pos) as named from {L0} group by 1) select nr, o.id, '[' || nr || '] (' || case when coalesce(hz, '') <> '' then hz || ', ' else '' end || o.c || ', urgency ' || urg || ', shared ' || n || 'x, where: ' || coalesce(named, '-') || case when cc is not null then '; ' || cc else '' end || ') ' || text as line from o left join p on p.id = o.id"
)
def cited_lines(s, d):
    rows = R.records(s, d).where(F.col("canon") & (F.col("rel") == 1))
    return view.cited_lines(rows, 12).select(F.col("at").cast("long").alias("nr"), "id", "line")


# --- splits, guards, joins --------------------------------------------------------------------------------------------------


@query("select doc_id, regexp_matches(lower(text), 'the|der|que') as proxy, regexp_matches(text, '(?i)" + "|".join(T.PROXY) + "') as relevant from documents")
def proxy_rel(s, d):
    text = F.col("text")
    return _docs(s, d).select("doc_id", T.proxy_relevant(text, ["the", "der", "que"]).alias("proxy"), T.proxy_relevant(text).alias("relevant"))


_SPLIT = "with b as (select doc_id, regexp_matches(lower(text), 'the') as pos, md5(cast(doc_id as varchar) || 's') as h from documents), r as (select *, row_number() over (partition by pos order by h, doc_id) as k from b), x as (select doc_id, pos, case when k <= 30 then 'gold' when k <= 45 then 'tune' else 'train' end as split from r)"


@query(f"{_SPLIT} select doc_id, split from x")
def split(s, d):
    g = _docs(s, d).select("doc_id", F.col("text").rlike("(?i)the").alias("pos"))
    return sampling.split(g, "doc_id", "pos", 60, 30).select("doc_id", "split")


@query(f"{_SPLIT} select split, count(*) as n, count(*) filter (pos) as positive, 0::bigint as crossing from x group by 1")
def split_integrity(s, d):
    g = _docs(s, d).select("doc_id", F.col("text").rlike("(?i)the").alias("pos"))
    x = sampling.split(g, "doc_id", "pos", 60, 30)
    crossing = x.groupBy("doc_id").agg(F.count_distinct("split").alias("k")).where("k > 1").agg(F.count("*").alias("crossing"))
    return x.groupBy("split").agg(F.count("*").alias("n"), F.count_if("pos").alias("positive")).crossJoin(F.broadcast(crossing))


@query("select doc_id from documents order by md5(cast(doc_id as varchar) || 's'), doc_id limit 50")
def hash_sample(s, d):
    return sampling.hash_sample(_docs(s, d), "doc_id", 50).select("doc_id")


@query("select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by md5(cast(doc_id as varchar) || 's'), doc_id) as k from documents) where k <= 25")
def cap_per_class(s, d):
    return sampling.cap_per_class(_docs(s, d).select("doc_id", "lang"), "lang", "doc_id", 25)


@query("select source, doc_id, lang from (select *, row_number() over (partition by source order by doc_id) as k from documents) where k=1")
def dedupe_first(s, d):
    return sampling.first_per_key(_docs(s, d).select("source", "doc_id", "lang"), "source", "doc_id")


def _keys(df):
    return df.withColumn("key", T.norm_key(F.col("text")))


_HELD = f"(select {_key('text')} as key from documents where doc_id % 20 = 0)"


@query(f"with h as (select {_key('text')} as key from benchmark union select key from {_HELD}) select doc_id from documents where {_key('text')} not in (select key from h where key <> '')")
def leakage_guard(s, d):
    x = _keys(_docs(s, d))
    held = _keys(table(s, d, "benchmark")).select("key").union(x.where("doc_id % 20 = 0").select("key"))
    return sampling.leakage_guard(x, held, "key").select("doc_id")


@query(f"select source, count(*) as n from documents where {_key('text')} in (select key from {_HELD} where key <> '') group by 1")
def leakage_report(s, d):
    x = _keys(_docs(s, d))
    return sampling.leaked(x, x.where("doc_id % 20 = 0"), "key", "source")


@query("select doc_id from documents where doc_id not in (select doc_id from labels)")
def resume(s, d):
    return _docs(s, d).select("doc_id").join(table(s, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders)")
def semi(s, d):
    return table(s, d, "customer").join(table(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select doc_id from labels where quality=1 intersect select doc_id from labels where toxic=1")
def intersect(s, d):
    x = table(s, d, "labels")
    return x.where("quality = 1").select("doc_id").intersect(x.where("toxic = 1").select("doc_id"))


@query("select d.doc_id as doc_id, quality, toxic from documents d left join labels l on l.doc_id=d.doc_id")
def truth_join(s, d):
    return _docs(s, d).select("doc_id").join(table(s, d, "labels"), "doc_id", "left")


@query("select doc_id, case lang when 'en' then 'English' when 'fr' then 'French' when 'de' then 'German' else 'other' end as name from documents")
def code_map(s, d):
    m = F.create_map(*[F.lit(x) for kv in {"en": "English", "fr": "French", "de": "German"}.items() for x in kv])
    return _docs(s, d).select("doc_id", F.coalesce(F.try_element_at(m, "lang"), F.lit("other")).alias("name"))


@query("select s_suppkey, n_name, r_name from supplier left join nation on n_nationkey=s_nationkey left join region on r_regionkey=n_regionkey")
def star_lookup(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    return table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "n_name", "r_name")


@query("select doc_id as group_id, case when quality=0 then '' else case when toxic=1 then 'BAD' else 'INFRA' end end as category, case when quality=1 and toxic=1 then 'category' else '' end as warning from labels")
def label_validation(s, d):
    x = table(s, d, "labels").select(F.col("doc_id").alias("group_id"), F.lit("gold").alias("split"), F.col("quality").alias("relevant"), F.when(F.col("toxic") == 1, " bad").otherwise("infrastructure").alias("category"))
    return sampling.validate_labels(x, review.CATEGORIES, {"INFRASTRUCTURE": "INFRA"}).select("group_id", "category", "warning")


@query("select doc_id, quality from labels where doc_id % 4 <> 0 union all select doc_id, 1 - quality from labels where doc_id % 4 = 0")
def upsert(s, d):
    x = table(s, d, "labels").select("doc_id", "quality")
    return sampling.upsert(x, x.where("doc_id % 4 = 0").withColumn("quality", 1 - F.col("quality")), "doc_id")


# --- scoring ----------------------------------------------------------------------------------------------------------------

_WEIGHTS = [[((i * k) % 7 - 3) / 10 for i in range(64)] for k in (3, 5, 11)]


def _dot(w: list[float]) -> str:
    return f"list_sum(list_transform(range(1, 65), lambda i: cast(embedding[i] as double) * ([{','.join(map(str, w))}])[i]))"


@query("select vec_id, round(list_sum(list_transform(embedding, lambda x: cast(x as double)/sqrt(list_sum(list_transform(embedding, lambda y: cast(y as double)*cast(y as double)))))), 5) as s from embeddings")
def l2_normalize(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(F.aggregate(scoring.l2_normalized("embedding"), F.lit(0.0), lambda a, x: a + x), 5).alias("s"))


@query(f"select vec_id, round(1/(1+exp(-({_dot(_WEIGHTS[0])} + 0.25))), 5) as p from embeddings")
def head_binary(s, d):
    return table(s, d, "embeddings").select("vec_id", F.round(scoring.binary("embedding", _WEIGHTS[0], 0.25), 5).alias("p"))


_Z = f"(select vec_id, {_dot(_WEIGHTS[0])} as a, {_dot(_WEIGHTS[1])} as b, {_dot(_WEIGHTS[2])} as c from embeddings)"


def _softmax(s, d):
    return table(s, d, "embeddings").select("vec_id", scoring.softmax("embedding", [(w, 0.0) for w in _WEIGHTS]).alias("pr"))


@query(f"select vec_id, round(exp(a)/(exp(a)+exp(b)+exp(c)),5) as a, round(exp(b)/(exp(a)+exp(b)+exp(c)),5) as b, round(exp(c)/(exp(a)+exp(b)+exp(c)),5) as c from {_Z}")
def head_softmax(s, d):
    return _softmax(s, d).select("vec_id", *[F.round(F.get("pr", F.lit(i)), 5).alias(n) for i, n in enumerate("abc")])


@query(f"select vec_id, case when a>=b and a>=c then 'a' when b>=c then 'b' else 'c' end as best, round(greatest(exp(a),exp(b),exp(c))/(exp(a)+exp(b)+exp(c)),5) as conf from {_Z}")
def predict(s, d):
    return _softmax(s, d).select("vec_id", scoring.argmax("pr", ["a", "b", "c"]).alias("best"), F.round(F.array_max("pr"), 5).alias("conf"))


@query(f"select id, case when cat in ('HUMAN','NEEDS') then 3 when cat in ('EVAC','INFRA','PROPERTY','ADVISORY') then 2 else 1 end as u from {R0}")
def urgency_fallback(s, d):
    return R.plain_records(s, d).select("id", scoring.fallback_urgency(F.col("cat")).alias("u"))


@query()
def train_heads(s, d):
    x = table(s, d, "embeddings").withColumn("y", (F.col("label") % 2).cast("int")).withColumn("w", F.lit(1.0))
    return scoring.heads_table(s, "rel", scoring.train_head(x, "y", "embedding", "w"))


# --- places -----------------------------------------------------------------------------------------------------------------

_HAV = "2*6371*asin(sqrt(least(1.0, power(sin(radians({b}-({a}))/2),2) + cos(radians({a}))*cos(radians({b}))*power(sin(radians({d}-({c}))/2),2))))"


def _hav(a, b, c, d):
    return _HAV.replace("{a}", a).replace("{b}", b).replace("{c}", c).replace("{d}", d)


@query(f"select id, pos, round({_hav('51.05', 'lat', '-114.07', 'lon')}, 3) as km from {L0}")
def haversine(s, d):
    return R.places(s, d).select("id", "pos", F.round(G.haversine(F.lit(51.05), F.lit(-114.07), F.col("lat"), F.col("lon")), 3).alias("km"))


@query(f"select id, pos, round_even(lat/3*4,0)/4 - 1.0 as s, round_even(lon/3*4,0)/4 - 1.75 as w, round_even(lat/3*4,0)/4 + 1.0 as n, round_even(lon/3*4,0)/4 + 1.75 as e from {L0}")
def bbox(s, d):
    return R.places(s, d).select("id", "pos", G.snapped_box(F.col("lat") / 3, F.col("lon") / 3).alias("b")).select("id", "pos", "b.*")


_TOP = f"(select name, count(*) as n, min(lat) as lat, min(lon) as lon from {L0} group by 1 order by n desc, name limit 5)"


@query(f"select round(sum(lat*n)/sum(n),6) as lat, round(sum(lon*n)/sum(n),6) as lon from {_TOP}")
def centroid(s, d):
    return G.centroid(R.places(s, d)).select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"select cc, round(sum(lat*sqrt(greatest(id,1)))/sum(sqrt(greatest(id,1))),6) as lat, round(sum(lon*sqrt(greatest(id,1)))/sum(sqrt(greatest(id,1))),6) as lon from {L0} group by 1")
def weighted_center(s, d):
    return G.weighted_centers(R.places(s, d), "cc", "id").select("cc", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


@query(f"with p as (select distinct id, cc from {L0}), n as (select cc, count(*) as n, round(count(*)/(select count(*) from p),3) as share from p group by 1 order by n desc, cc limit 12) select max(share) as top_share, max(share)<0.6 or count(*) filter (share>=0.08)>=3 as is_global from n")
def mode_detect(s, d):
    return G.mode(R.places(s, d)).select("top_share", "is_global")


@query(f"with c as (select sum(lat*n)/sum(n) as y, sum(lon*n)/sum(n) as x from {_TOP}), f as (select case when {_hav('10.0', 'y', '20.0', 'x')} > 300 then 10e0 else y end as lat, case when {_hav('10.0', 'y', '20.0', 'x')} > 300 then 20e0 else x end as lon from c) select round(lat,6) as lat, round(lon,6) as lon, round_even(lat*4,0)/4-1.0 as s, round_even(lon*4,0)/4-1.75 as w, round_even(lat*4,0)/4+1.0 as n, round_even(lon*4,0)/4+1.75 as e from f")
def region(s, d):
    return G.region(R.places(s, d), (10.0, 20.0)).withColumn("lat", F.round("lat", 6)).withColumn("lon", F.round("lon", 6))


_CAND = "(select n_nationkey as place_id, 'k' || (n_nationkey % 6) as key, n_name as name, (n_nationkey*7)%170-85e0 as lat, (n_nationkey*29)%350-175e0 as lon, n_nationkey*1000 as size from nation)"


def _candidates(s, d):
    n = F.col("n_nationkey")
    return table(s, d, "nation").select(n.alias("place_id"), F.concat(F.lit("k"), (n % 6).cast("string")).alias("key"), F.col("n_name").alias("name"), ((n * 7) % 170 - 85).cast("double").alias("lat"), ((n * 29) % 350 - 175).cast("double").alias("lon"), (n * 1000).alias("size"))


@query(f"with m as (select doc_id as id, 'k' || (doc_id % 6) as key from documents), x as (select m.id, m.key, place_id, {_hav('10.0', 'lat', '20.0', 'lon')} - 60*log10(greatest(size,1)) as score from m join {_CAND} c on c.key=m.key) select id, key, place_id, round(score,3) as score from (select *, row_number() over (partition by id order by score, place_id) as k from x) where k=1")
def nearest_place(s, d):
    m = _docs(s, d).select(F.col("doc_id").alias("id"), F.concat(F.lit("k"), (F.col("doc_id") % 6).cast("string")).alias("key"))
    return G.nearest(m, _candidates(s, d), "key", 10.0, 20.0).select("id", "key", "place_id", F.round("score", 3).alias("score"))


@query(f"select id, source, place_id from (select l.id, case prec when 'point' then 'osm' when 'line' then 'osm' when 'locality' then 'world' else 'province' end as source, pos as place_id, row_number() over (partition by l.id order by case prec when 'region' then 1 when 'point' then 2 when 'line' then 2 else 3 end, pos) as k from {L0} l) where k=1")
def resolve_priority(s, d):
    prec = F.col("prec")
    c = R.places(s, d).select("id", F.col("pos").alias("place_id"), F.when(prec.isin("point", "line"), "osm").when(prec == "locality", "world").otherwise("province").alias("source"), F.when(prec == "region", 1).when(prec.isin("point", "line"), 2).otherwise(3).alias("priority"))
    return G.by_priority(c, ["id"])


_WORLD = "(select s_suppkey as place_id, 'w' || (s_suppkey % 9) as key, s_name as name, 'N' || s_nationkey as cc, case s_suppkey % 4 when 0 then 'country' when 1 then 'state' else 'city' end as kind, (s_suppkey * 7919) % 3000000 as pop, s_suppkey % 5 = 0 as is_alt from supplier)"


@query(f"select key, place_id, cc from (select *, row_number() over (partition by key order by is_alt, (case when cc='N3' then 0 else 1 end), (case when kind='country' then 3.0 when kind='city' and pop>=1000000 then 2.5 when kind='state' then 2.0 else 1.0 end) desc, pop desc, place_id) as k from {_WORLD}) where k=1")
def resolve_world(s, d):
    k = F.col("s_suppkey")
    w = table(s, d, "supplier").select(k.alias("place_id"), F.concat(F.lit("w"), (k % 9).cast("string")).alias("key"), F.col("s_name").alias("name"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("cc"), F.when(k % 4 == 0, "country").when(k % 4 == 1, "state").otherwise("city").alias("kind"), ((k * 7919) % 3000000).alias("pop"), (k % 5 == 0).alias("is_alt"))
    return G.in_world(w, ["key"], "N3").select("key", "place_id", "cc")


@query("select n_nationkey, n_nationkey as place_id from nation where length(n_name) >= 4")
def hashtag_resolve(s, d):
    n = table(s, d, "nation").where(F.length("n_name") >= 4)
    tags = n.select("n_nationkey", F.explode(extraction.tag_keys(F.concat(F.lit("#"), F.regexp_replace("n_name", " ", ""), F.lit("Flood")))).alias("key"))
    index = table(s, d, "nation").select(F.lower(F.regexp_replace("n_name", "[ _]", "")).alias("key"), F.col("n_nationkey").alias("place_id"))
    return tags.join(F.broadcast(index), "key").select("n_nationkey", "place_id").distinct()


@query("select vec_id, list_transform(range(0, 8), lambda i: round(cast(embedding[i*8+1] as double),5))[3] as third, 8::bigint as n from embeddings")
def decimate(s, d):
    return table(s, d, "embeddings").select("vec_id", G.decimated("embedding").alias("p")).select("vec_id", F.round(F.get("p", F.lit(2)).cast("double"), 5).alias("third"), F.size("p").cast("long").alias("n"))


@query(f"with n as (select id, pos, lower(name) as key from {L0}), f as (select key, min(id*10+pos) as at0 from n group by 1), k as (select lower(n_name) as key, n_nationkey as place_id from nation where n_nationkey % 2 = 0), h as (select f.*, place_id from f left join k using (key)), g as (select key, 'geocoder' as source, null::bigint as place_id from h where place_id is null order by at0, key limit 5) select key, 'gazetteer' as source, place_id from h where place_id is not null union all select * from g")
def resolve_llm_places(s, d):
    index = table(s, d, "nation").where("n_nationkey % 2 = 0").select(F.lower("n_name").alias("key"), F.struct(F.col("n_nationkey").cast("long").alias("place_id")).alias("place"))
    return G.resolved_names(R.places(s, d), index, 5)


# --- extraction, resolution and the whole, with sources made from the texts -------------------------------------------------

QUERIES |= place_queries.QUERIES
ORACLES |= place_queries.ORACLES
