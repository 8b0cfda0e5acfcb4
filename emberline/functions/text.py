"""Text functions as columns. Character classes are spelled out: the short ones are ASCII-only in the JVM."""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

W, S = r"[\p{L}\p{N}_]", r"[\s\p{Z}]"
URL = r"https?://[^\s\p{Z}]+"
RT_PREFIX = rf"^{S}*rt{S}+@{W}+{S}*:?{S}*"
EMBEDDED = rf"(?is)(?:^|[^\p{{L}}\p{{N}}_])RT{S}+@{W}+{S}*:?{S}*(.+)$"
RETWEET = rf"(?:^|[^\p{{L}}\p{{N}}_])RT{S}+@{W}"
TRUNCATED = rf"(?:…|\.\.\.){S}*$"
MASK_TOKEN = r"#?[A-Za-zÀ-ÿ][\p{L}\p{N}_'’\-]*"
_RUN = r"A-Za-zÀ-ÿ0-9'’\-."
GAZETTEER_TOKEN = rf"#?[{_RUN}]+"


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``c``, which is worked out once, however often ``f`` names it within a function of an array."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, rf"{S}+", " "))


#: What may be an entity: as ``html.unescape`` takes it.
ENTITY = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"


@F.pandas_udf(ArrayType(StringType()))
def _entities(s: pd.Series) -> pd.Series:
    return s.map(lambda e: [html.unescape(x) for x in e], na_action="ignore")


def unescape(c: Column) -> Column:
    """Entities resolved. What goes to Python are the entities, not the texts; texts without an ampersand send nothing."""
    found = F.when(F.contains(c, F.lit("&")), F.regexp_extract_all(c, F.lit(ENTITY), 0))
    told = _entities(F.when(F.size(found) > 0, found))
    pieces = F.zip_with(F.split(c, ENTITY, -1), told, lambda g, e: F.concat(g, F.coalesce(e, F.lit(""))))
    return F.when(F.contains(c, F.lit("&")), F.coalesce(F.array_join(pieces, ""), c)).otherwise(c)


def clean_text(c: Column) -> Column:
    """Entities resolved, white space collapsed; null counts as empty."""
    return collapse(unescape(F.coalesce(c, F.lit(""))))


def norm_key(c: Column) -> Column:
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), URL, " ")
    c = F.regexp_replace(c, RT_PREFIX, "")
    c = F.regexp_replace(c, rf"@{W}+", " ")
    c = F.regexp_replace(c, TRUNCATED, "")
    return collapse(F.regexp_replace(c, r"[^\p{L}\p{N}_#]+", " "))


def embedded_key(c: Column) -> Column:
    """The key of the post that a retweet carries; empty without one."""
    c = F.coalesce(c, F.lit(""))
    return F.when(F.contains(c, F.lit("@")), norm_key(F.regexp_extract(c, EMBEDDED, 1))).otherwise("")


def is_retweet(c: Column) -> Column:
    c = F.coalesce(c, F.lit(""))
    return F.contains(c, F.lit("@")) & c.rlike(RETWEET)


def is_truncated(c: Column) -> Column:
    return F.coalesce(c, F.lit("")).rlike(TRUNCATED)


def tokens(c: Column, pattern: str = MASK_TOKEN) -> Column:
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), 0)


def first_tokens(c: Column, n: int) -> Column:
    """The first ``n`` gazetteer tokens; no more of the text is read."""
    return tokens(F.regexp_extract(c, rf"^(?:[^{_RUN}]*+[{_RUN}]++){{0,{n}}}", 0), GAZETTEER_TOKEN)


def pieces(c: Column) -> Column:
    """The text cut behind each gazetteer token; the last piece is what follows the last of them."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"[^{_RUN}]*(?:[{_RUN}]+|\z)"), 0)


def gap(piece: Column) -> Column:
    """What stands before the token of a piece."""
    return F.regexp_replace(piece, rf"{GAZETTEER_TOKEN}$", "")


@F.pandas_udf(StringType())
def fold(s: pd.Series) -> pd.Series:
    """Lower case without combining marks."""
    return s.map(lambda t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)).lower(), na_action="ignore")


_LATIN = {chr(c): "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)) for c in range(0xE0, 0x100)}
_ACCENTED = {k: v for k, v in _LATIN.items() if v != k}


def fold_token(c: Column) -> Column:
    """:func:`fold` for tokens, whose letters go no further than U+00FF: native. Those of ASCII alone are not looked through."""
    low = F.lower(c)
    return F.when(F.octet_length(c) > F.length(c), F.translate(low, "".join(_ACCENTED), "".join(_ACCENTED.values()))).otherwise(low)


def squash(c: Column) -> Column:
    return F.regexp_replace(fold(c), "[^0-9a-z]", "")


# fixed values: patterns of words that say what a message is about
KEYWORDS = [
    "flood", "evacu", "rescue", "donat", "sandbag", "shelter", "stranded", "power (?:is )?out", "boil", "volunteer", "relief", "emergency",
    "water level", "high water", "submerged", "washed out", "closed", "damage", "victims", "prayers",
]


def flags(c: Column, keywords: list[str] = KEYWORDS) -> Column:
    """Of a masked text: keyword, place mark, retweet, link mark."""
    c = F.coalesce(c, F.lit(""))
    return F.struct(c.rlike("(?i)" + "|".join(keywords)).cast("int").alias("keyword"), F.contains(c, F.lit("PLACE")).cast("int").alias("place"), c.startswith("RT ").cast("int").alias("retweet"), F.contains(c, F.lit("URL")).cast("int").alias("link"))


# fixed values: words that stand for relevance before any label is there
PROXY = [
    "flood", "water", "evac", "river", r"\bbow\b", "elbow", "high ?river", "canmore", "sandbag", "red ?cross", "nenshi", "disaster", "relief", "donat",
    "volunteer", "power outage", "boil", "rescue", "#yyc", "#ab", "shelter", "emergency", "stampede",
]


def proxy_relevant(c: Column, words: list[str] = PROXY) -> Column:
    """Whether a text has one of the words, whatever their case; a null text has none."""
    return F.coalesce(c, F.lit("")).rlike("(?i)" + "|".join(words))


# fixed values: province abbreviations
PROVINCES = {"AB": "Alberta", "BC": "British Columbia", "SK": "Saskatchewan", "MB": "Manitoba", "ON": "Ontario"}


def norm_locations(c: Column) -> Column:
    """Names by ``;``: commas split too, abbreviations of either case spelled out, repeats (whatever their case) dropped, order kept."""
    names = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[;,]"), lambda x: F.trim(x)), lambda x: x != "")
    table = F.create_map(*[F.lit(x) for kv in PROVINCES.items() for x in kv])
    full = F.transform(names, lambda x: F.coalesce(F.try_element_at(table, F.upper(x)), x))
    once = F.filter(full, lambda x, i: F.array_position(F.transform(full, F.lower), F.lower(x)) == i + 1)
    return F.array_join(once, ";")


JUNK = "[\u1f00-\u1fff\ufffd]+"


def without_links(c: Column) -> Column:
    """Links and mentions as spaces."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), URL, " "), rf"@{W}+", " ")


def plain_tokens(c: Column) -> Column:
    """The tokens outside links and mentions, lower case, without the hash of a hashtag."""
    return F.transform(tokens(without_links(c)), lambda t: F.lower(F.ltrim(t, F.lit("#"))))


def mask_terms(c: Column, terms: list[str]) -> Column:
    """Terms where a word or hashtag begins with them, links and mentions replaced by marks; the hash and the rest of the word stay; remains
    of broken characters go; marks in a row become one."""
    if terms:
        quoted = "|".join(rf"\Q{t}\E" for t in sorted(terms, key=lambda t: (-len(t), t)))
        c = F.regexp_replace(c, rf"(?iu)(?<![\p{{L}}\p{{N}}_])(#?)(?:{quoted})", "$1PLACE")
    c = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, JUNK, ""), URL, "URL"), rf"@{W}+", "@user")
    return F.regexp_replace(F.regexp_replace(c, rf"(?:PLACE{S}*)+", "PLACE "), rf"^{S}+|{S}+$", "")


# fixed values: what a name of a place looks like: after a preposition, a numbered street, or a word for a kind of place at its end
_NAME = r"[A-Z][\p{L}\p{N}_'’]++"
_LEADING = rf"(?:in|at|near|on|by|across|along|off){S}+(?:the{S}+)?"
# the first letter tells which of the three it is; a look at it spares most places the rest
PLACE_NAME = (
    rf"(?=[abino0-9A-Z])(?<![\p{{L}}\p{{N}}_])(?:{_LEADING}{_NAME}(?:{S}+{_NAME}){{0,3}}"
    rf"|\d+{S}*(?:st|nd|rd|th)?{S}+(?:St|Street|Ave|Avenue|Rd|Road|Dr|Drive|Blvd|Trail|Way|Cres)(?![\p{{L}}\p{{N}}_])"
    rf"|{_NAME}{S}+(?:Trail|Drive|Road|Bridge|Crossing|Park|Street|Avenue|Creek|Lake|Reserve|Nation)(?![\p{{L}}\p{{N}}_]))"
)
_NO_PLACE = ["i", "the", "my", "our", "rt"]


def place_names(c: Column) -> Column:
    """What the pattern finds, from left to right, without what leads to a name."""
    return F.transform(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(PLACE_NAME), 0), lambda x: F.regexp_replace(x, "^" + _LEADING, ""))


def place_hint(c: Column, found: Column) -> Column:
    """Whether the text seems to name a place that is in none of the surfaces ``found``."""
    known = F.lower(F.array_join(F.coalesce(found, F.array().cast("array<string>")), " "))
    return once(known, lambda k: F.exists(place_names(c), lambda x: ~F.contains(k, F.lower(x)) & ~F.lower(F.regexp_extract(x, rf"^[^\s\p{{Z}}]+", 0)).isin(_NO_PLACE)))


def citations(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), 1), lambda x: x.cast("long"))
