"""PII surrogates: personal data give way to keyed replacements of the same type and format, native.

Found are e-mail addresses, IPv4 and full IPv6 addresses, phone numbers, social security numbers, payment card numbers that pass the Luhn
check, bank accounts (IBAN) whose check digits hold, and names of up to three words after a form of address. In a text with such a name,
each of its words is also replaced wherever it stands again as a word of its own, so no bare repeat is left behind.

An entity is a type with a canonical value (lower case, or digits alone; of a phone number the last ten), so its mentions share one
replacement however they are written. Of names every word is an entity: a surname has one replacement under all forms of address, alone or
after a given name. A given name, what stands before a space within a name, takes the ending of the gender that the forms of address in its text tell; where
these tell none or both, and for surnames, the word's own ending decides. A replacement is drawn from an HMAC with SHA-512 of type, value and attempt: letters become letters of
the same script, digits digits, separators, case, country codes, top-level domains and card issuers stay, check digits hold, and name words
keep their length.

Collisions are checked over all entities of the table: one whose replacement is another's, or is an original value, draws again with the
next attempt until none is left. After every ``WIDEN`` attempts names and e-mail addresses grow by two letters, so a free one always
exists. Numbers keep their format; where their digits do not suffice for all values of a table an error is raised.

Defined cases: null texts stay null, empty texts stay empty, an empty table gives no rows, texts are searched whole, however long, repeated
rows get equal results, other columns are kept, whatever their names; of a text's matches the leftmost counts, and of those that begin
together the kind listed first; ties of a replacement go to an original value, then to the entity that has drawn most often, then to the least
value; letters of scripts other than Latin, Greek and Cyrillic stay, and numbers whose check fails are not taken for cards or accounts.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.operators.skew import small_or_shuffled
from emberline.session import forget, table, written

#: The setting that holds the key of the query; its tests run with the second value.
KEY_SETTING, TEST_KEY = "spark.emberline.pii.key", "surrogate-key"
#: Attempts after which a replacement of letters grows.
WIDEN = 6
#: Forms of address by the gender that they tell: female, male, untold.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Doña", "госпожа", "Κυρία"],
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "господин", "Κύριος"],
    "u": ["Dr", "Prof"],
}
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)"
EMAIL = r"(?<![\p{L}\p{N}._+-])[\p{L}\p{N}._+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
IP = rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\p{{N}}|\.\p{{N}})"
CARD = r"(?<![\p{L}\p{N}])\d(?:[ -]?\d){12,18}(?![\p{L}\p{N}])"
PHONE = r"(?<![\p{L}\p{N}])(?:\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?![\p{L}\p{N}])"
PERSON = r"(?<![\p{L}\p{N}])(?:" + "|".join(t for g in TITLES.values() for t in g) + r")\.? \p{Lu}\p{Ll}+(?:[ -]\p{Lu}\p{Ll}+){0,2}"
IP6 = r"(?<![\p{L}\p{N}:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}(?![\p{L}\p{N}:])"
SSN = r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"
IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
FOUND = f"{EMAIL}|{IP6}|{IP}|{IBAN}|{SSN}|{PHONE}|{CARD}|{PERSON}"
PATTERN = f"(?:{FOUND})"
KINDS = ["email", "ip", "phone", "card", "person", "ssn", "iban"]
_TITLE = r"^(?:" + "|".join(t for g in TITLES.values() for t in g) + r")\.? (?=\p{Lu})"
_LATIN = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüý"
_GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
_CYRILLIC = "абвгдежзийклмнопрстуфхцчшщъыьэюя"
#: Consonants, vowels, and the last letters of female and male names.
_SOUNDS = {"latin": ("bdfgklmnprstv", "aeiou", "a", "n"), "greek": ("βγδζθκλμνπρστφ", "αειου", "α", "ν"), "cyrillic": ("бвгдзклмнпрст", "аеиоу", "а", "н")}


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum in which the last digit counts once."""
    back = F.reverse(F.split(digits, ""))
    each = F.transform(back, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _mod97(value: Column) -> Column:
    """The remainder by 97 of a text of digits and capital letters, where A counts as 10."""
    code = lambda c: F.ascii(c) - F.when(c.between("0", "9"), 48).otherwise(55)
    return F.aggregate(F.split(value, ""), F.lit(0), lambda a, c: (a * F.when(c.between("0", "9"), 10).otherwise(100) + code(c)) % 97)


def _iban(m: Column) -> Column:
    """An account without its spaces, country and check digits last."""
    solid = F.replace(m, F.lit(" "), F.lit(""))
    return F.concat(F.substring(solid, F.lit(5), F.length(solid)), F.substring(solid, 1, 4))


def kind_of(m: Column) -> Column:
    """The type of a mention; null for a number that no check supports."""
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$") | m.rlike(f"^{IP6}$"), "ip")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), F.when(_mod97(_iban(m)) == 1, "iban"))
        .when(m.rlike(r"^\p{L}"), "person")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.startswith("+") | m.startswith("(") | (F.length(_digits(m)) < 13), "phone")
        .when(_luhn_sum(_digits(m)) % 10 == 0, "card")
    )


def gender(m: Column) -> Column:
    said = F.regexp_extract(m, r"^(\p{L}+)\.? \p{Lu}", 1)
    return F.when(said.isin(TITLES["f"]), "f").when(said.isin(TITLES["m"]), "m").otherwise("u")


def canonical(m: Column, kind: Column) -> Column:
    """The value of a mention that is not a name."""
    return F.when(kind.isin("email", "ip"), F.lower(m)).when(kind == "phone", F.right(_digits(m), F.lit(10))).when(kind == "iban", F.lower(_iban(m))).otherwise(_digits(m))


def bare_name(m: Column) -> Column:
    """A mention of a name without its form of address."""
    return F.regexp_replace(m, _TITLE, "")


def _byte(h: Column, i: Column) -> Column:
    """A number that differs from position to position; ``h`` has 128 hexadecimal digits."""
    return F.conv(F.substring(h, (i * 2) % 126 + 1, F.lit(3)), 16, 10).cast("int") + i


def _pick(alphabet: str, b: Column) -> Column:
    return F.substring(F.lit(alphabet), b % len(alphabet) + 1, F.lit(1))


def _letters(value: Column, h: Column) -> Column:
    """Each letter or digit of a lower-case value replaced by one of its kind."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(h, i)
        return (
            F.when(c.between("0", "9"), _pick("0123456789", b))
            .when(c.between("a", "z"), _pick("abcdefghijklmnopqrstuvwxyz", b))
            .when(c.between("à", "ÿ"), _pick(_LATIN, b))
            .when(c.between("α", "ώ"), _pick(_GREEK, b))
            .when(c.between("а", "я"), _pick(_CYRILLIC, b))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(value, ""), one), "")


def _name(value: Column, h: Column, told: Column) -> Column:
    """A name of the same script and word lengths; words end as the gender asks."""

    # without a gender told, a word that itself ends as female names do keeps such an ending
    first = F.substring(value, 1, 1)
    told = F.when((told == "u") & F.right(value, F.lit(1)).isin("a", "а", "я", "α", "η"), "f").otherwise(told)

    def drawn(script: str) -> Column:
        consonants, vowels, female, male = _SOUNDS[script]
        n = F.length(value)

        def one(c: Column, i: Column) -> Column:
            last = (i == n - 1) | F.substring(value, i + 2, F.lit(1)).isin(" ", "-")
            sound = F.when(i % 2 == 0, _pick(consonants, _byte(h, i))).otherwise(_pick(vowels, _byte(h, i)))
            return F.when(c.isin(" ", "-"), c).when(last & (told == "f"), female).when(last & (told == "m"), male).otherwise(sound)

        return F.array_join(F.transform(F.split(value, ""), one), "")

    return F.when(first.between("α", "ώ"), drawn("greek")).when(first.between("а", "я"), drawn("cyrillic")).otherwise(drawn("latin"))


def keyed_hash(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """HMAC with SHA-512, in hexadecimal digits."""
    block = key.encode() if len(key.encode()) <= 128 else hashlib.sha512(key.encode()).digest()
    block = block.ljust(128, b"\0")
    pad = lambda x: F.lit(bytes(b ^ x for b in block))
    inner = F.sha2(F.concat(pad(0x36), F.concat_ws("\u0001", kind, value, attempt.cast("string")).cast("binary")), 512)
    return F.sha2(F.concat(pad(0x5C), F.unhex(inner)), 512)


def drawn(kind: Column, value: Column, h: Column, attempt: Column) -> Column:
    """The replacement of a canonical value; ``h`` is the keyed hash of its ``attempt``. Of names, gender and a mark stand before the value."""
    more = F.floor(attempt / WIDEN).cast("int") * 2
    number = _letters(value, h)
    body = F.concat(F.substring(value, 1, 1), F.substring(number, F.lit(2), F.length(value) - 2))
    check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.conv(F.substring(h, i * 7 + 1, F.lit(5)), 16, 10).cast("int") % 254 + 1).cast("string")), ".")
    groups = F.array_join(F.transform(F.split(value, ":"), lambda g, i: F.substring(F.substring(h, i * 5 + 1, F.lit(4)), F.lit(1), F.length(g))), ":")
    domain = F.regexp_extract(value, r"(\.[^.]+)$", 1)
    mail = F.concat(_letters(F.concat(F.repeat(F.lit("x"), more), F.substring(value, F.lit(1), F.length(value) - F.length(domain))), h), domain)
    person = _name(F.concat(F.repeat(F.substring(value, 3, 1), more), F.substring(value, F.lit(3), F.length(value))), h, F.left(value, F.lit(1)))
    account, country = F.substring(number, F.lit(1), F.length(value) - 4), F.substring(value, F.length(value) - 3, F.lit(2))
    iban = F.concat(account, country, F.lpad((98 - _mod97(F.upper(F.concat(account, country, F.lit("00"))))).cast("string"), 2, "0"))
    return F.when(kind == "email", mail).when(kind == "ip", F.when(F.contains(value, F.lit(":")), groups).otherwise(octets)).when(kind == "person", person).when(kind == "card", F.concat(body, check.cast("string"))).when(kind == "iban", iban).otherwise(number)


def _capital(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word)))


def formatted(m: Column, kind: Column, value: Column, new: Column) -> Column:
    """The replacement, of a mention that is not a name, in the mention's format."""
    # digits go where digits stood; those before the canonical ones stay
    spare = F.length(_digits(m)) - F.length(value)
    put = F.aggregate(
        F.split(m, ""),
        F.struct(F.lit(0).alias("n"), F.lit("").alias("s")),
        lambda a, c: F.struct((a.n + c.between("0", "9").cast("int")).alias("n"), F.concat(a.s, F.when(c.between("0", "9") & (a.n >= spare), F.substring(new, a.n - spare + 1, F.lit(1))).otherwise(c)).alias("s")),
    ).s
    solid = F.upper(F.concat(F.right(new, F.lit(4)), F.substring(new, F.lit(1), F.length(new) - 4)))
    spaced = F.aggregate(
        F.split(m, ""),
        F.struct(F.lit(0).alias("n"), F.lit("").alias("s")),
        lambda a, c: F.struct((a.n + (c != " ").cast("int")).alias("n"), F.concat(a.s, F.when(c == " ", c).otherwise(F.substring(solid, a.n + 1, F.lit(1)))).alias("s")),
    ).s
    return F.when(kind.isin("phone", "card", "ssn"), put).when(kind == "iban", spaced).when(kind.isin("email", "ip") & (m == F.upper(m)) & (m != F.lower(m)), F.upper(new)).otherwise(new)


def _mentions(rows: DataFrame) -> DataFrame:
    """``rows`` (with ``text``) and what stands in them: the pattern of the text, its mentions, and its name words with the gender told."""
    hint = r"[@\p{Nd}]|[0-9A-Fa-f]:|(?:" + "|".join(t for g in TITLES.values() for t in g) + r")\.? \p{Lu}"
    none = F.array().cast("array<string>")
    titled = F.coalesce(F.when(F.col("text").rlike(hint), F.regexp_extract_all("text", F.lit(PERSON), 0)), none)
    rows = rows.withColumn("titled", titled).withColumn("hinted", F.coalesce(F.col("text").rlike(hint), F.lit(False)))
    # (word, gender told of it, or u) of each name word after a form of address
    words = F.flatten(F.transform("titled", lambda m: F.transform(F.split(bare_name(m), "[ -]"), lambda w: F.struct(w.alias("word"), F.when(F.contains(bare_name(m), F.lit(" ")) & F.array_contains(F.split(F.get(F.split(bare_name(m), " "), F.lit(0)), "-"), w), gender(m)).otherwise("u").alias("told")))))
    rows = rows.withColumn("words", F.when(F.size("titled") > 0, words).otherwise(F.array().cast("array<struct<word:string,told:string>>")))
    each = F.transform(F.array_distinct(F.transform("words", lambda w: w.word)), lambda w: F.struct(w.alias("word"), F.array_distinct(F.filter(F.transform(F.filter("words", lambda x: x.word == w), lambda x: x.told), lambda t: t != "u")).alias("t")))
    rows = rows.withColumn("told", F.map_from_entries(F.transform(each, lambda x: F.struct(x.word, F.when(F.size(x.t) == 1, F.get(x.t, F.lit(0))).otherwise("u")))))
    bare = F.concat(F.lit(f"(?:{FOUND}|(?<![\\p{{L}}\\p{{N}}])(?:"), F.array_join(F.array_sort(F.map_keys("told"), lambda a, b: F.length(b) - F.length(a)), "|"), F.lit(")(?![\\p{L}\\p{N}]))"))
    rows = rows.withColumn("bare", F.when(F.size("titled") > 0, bare))
    found = F.when(F.size("titled") > 0, F.regexp_extract_all("text", F.col("bare"), F.lit(0))).when(F.col("hinted"), F.regexp_extract_all("text", F.lit(PATTERN), 0))
    return rows.withColumn("m", F.coalesce(found, none)).drop("words", "titled")


def _entities_of(rows: DataFrame) -> Column:
    """The entities of a row: kind and value; of name words the value begins with the gender told and a mark."""
    name = lambda m: F.transform(F.split(bare_name(m), "[ -]"), lambda w: F.struct(F.lit("person").alias("kind"), F.concat(F.coalesce(F.try_element_at("told", w), F.lit("u")), F.lit("|"), F.lower(w)).alias("value")))
    return F.flatten(F.transform("m", lambda m: F.when(kind_of(m) == "person", name(m)).otherwise(F.array(F.struct(kind_of(m).alias("kind"), canonical(m, kind_of(m)).alias("value"))))))


def entities(docs: DataFrame, text: str = "text", *, key: str, attempts: int = 50) -> DataFrame:
    """(kind, value, attempt, surrogate): every entity of the table with its settled replacement; no two of a kind are equal.

    An error is raised if the colliding ones have not become fewer for ``attempts`` rounds in a row.
    """
    m = _mentions(docs.select(F.col(text).alias("text"))).where(F.size("m") > 0)
    held = m.select(F.explode(_entities_of(m)).alias("e")).select("e.*").where("kind is not null").distinct().withColumn("attempt", F.lit(0))

    def with_draw(rows: DataFrame) -> DataFrame:
        return written(rows.withColumn("h", keyed_hash(F.col("kind"), F.col("value"), F.col("attempt"), key)).withColumn("surrogate", drawn(F.col("kind"), F.col("value"), F.col("h"), F.col("attempt"))).select("kind", "value", "attempt", "surrogate"), "entities")

    held = with_draw(held)
    least, idle = None, 0
    while True:
        originals = held.select("kind", F.when(F.col("kind") == "person", F.expr("substring(value, 3)")).otherwise(F.col("value")).alias("surrogate"), F.lit("").alias("of"), F.lit(0).alias("attempt")).distinct()
        claims = originals.union(held.select("kind", "surrogate", F.col("value").alias("of"), "attempt"))
        # of one replacement's claimants an original value wins, else the one that has drawn most often, else the least value
        winner = claims.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct((F.col("of") != "").alias("late"), (-F.col("attempt")).alias("drawn"), "of")).alias("w")).where("n > 1")
        losers = held.join(winner, ["kind", "surrogate"]).where("w.of <> value").select("kind", "value", (F.col("attempt") + 1).alias("again"))
        losers = written(losers, "losers")
        left = losers.count()
        if left == 0:
            forget(losers)
            return held
        least, idle = (left, 0) if least is None or left < least else (least, idle + 1)
        if idle >= attempts:
            raise ValueError(f"{left} values have no free replacement of their format")
        fresh = held.join(small_or_shuffled(losers), ["kind", "value"], "left").withColumn("attempt", F.coalesce("again", "attempt")).drop("again", "surrogate")
        now = with_draw(fresh)
        forget(held, losers)
        held = now


def surrogated(docs: DataFrame, text: str = "text", *, key: str, found: str | None = None) -> DataFrame:
    """The rows with replacements in ``text``; with ``found``, a column of that name lists kind, original and replacement."""
    again = entities(docs, text, key=key).where("attempt > 0").select("kind", "value", "attempt")
    rows = _mentions(docs.select(F.struct("*").alias("row"), F.col(text).alias("text")))
    if again.limit(1).count():
        keyed = rows.withColumn("rid", F.xxhash64("text"))
        own = keyed.where(F.size("m") > 0)
        by_row = own.select("rid", F.explode(_entities_of(own)).alias("e")).select("rid", "e.*").join(small_or_shuffled(again), ["kind", "value"]).groupBy("rid").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "value").alias("k"), "attempt"))).alias("again"))
        rows = keyed.join(small_or_shuffled(written(by_row, "again")), "rid", "left").drop("rid")
    else:
        rows = rows.withColumn("again", F.lit(None).cast("map<string,int>"))

    def new(kind: Column, value: Column) -> Column:
        attempt = F.coalesce(F.try_element_at("again", F.concat_ws(":", kind, value)), F.lit(0))
        # bound by arrays of one entry, so that each step is worked out once
        drew = F.transform(F.array(attempt), lambda a: F.struct(a.alias("a"), keyed_hash(kind, value, a, key).alias("h")))
        return F.get(F.transform(drew, lambda x: drawn(kind, value, x.h, x.a)), F.lit(0))

    def name(m: Column) -> Column:
        gaps = F.regexp_extract_all(bare_name(m), F.lit("[ -]"), F.lit(0))
        words = F.transform(F.split(bare_name(m), "[ -]"), lambda w: _capital(new(F.lit("person"), F.concat(F.coalesce(F.try_element_at("told", w), F.lit("u")), F.lit("|"), F.lower(w)))))
        return F.concat(F.regexp_extract(m, _TITLE, 0), F.array_join(F.zip_with(words, gaps, lambda w, g: F.concat(w, F.coalesce(g, F.lit("")))), ""))

    # each step binds what the next ones use again
    steps = [
        lambda m: F.struct(m.alias("original"), kind_of(m).alias("kind")),
        lambda x: F.struct(x.original.alias("original"), x.kind.alias("kind"), F.when(x.kind != "person", canonical(x.original, x.kind)).alias("value")),
        lambda x: F.struct(x.original.alias("original"), x.kind.alias("kind"), x.value.alias("value"), F.when(x.kind != "person", new(x.kind, x.value)).alias("new")),
        lambda x: F.struct(x.kind.alias("kind"), x.original.alias("original"), F.when(x.kind.isNull(), x.original).when(x.kind == "person", name(x.original)).otherwise(formatted(x.original, x.kind, x.value, x.new)).alias("replacement")),
    ]
    at = "m"
    for i, step in enumerate(steps):
        rows = rows.withColumn(f"x{i}", F.transform(at, step))
        at = f"x{i}"
    pieces = F.when(F.col("bare").isNotNull(), F.split("text", F.col("bare"), F.lit(-1))).otherwise(F.split("text", PATTERN, -1))
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.transform(at, lambda x: x.replacement), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    rows = rows.withColumn("out", F.when(F.size("m") > 0, joined).otherwise(F.col("text")))
    kept = [F.col("out").alias(c) if c == text else F.col(f"row.`{c}`") for c in docs.columns]
    return rows.select(*kept, *([F.filter(at, lambda x: x.kind.isNotNull()).alias(found)] if found else []))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = spark.conf.get(KEY_SETTING, TEST_KEY)
    out = surrogated(table(spark, sf_dir, "documents").select("doc_id", "text"), key=key, found="found")
    return out.select("doc_id", *[F.size(F.filter("found", _is(kind))).cast("long").alias(f"n_{kind}") for kind in KINDS], "text")


def _is(kind: str):
    return lambda x: x.kind == kind
