"""Document frequencies, distinctive terms, and masking of proper nouns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import text as T

# fixed values: words that are distinctive for floods in general and stay visible
KEEP = [
    "flood", "floods", "flooding", "flooded", "water", "rain", "river", "evacuation", "evacuated", "rescue", "help", "donate", "relief", "emergency", "red",
    "cross", "storm", "prayers", "damage", "power", "bridge", "road", "closed", "shelter", "volunteers", "safe", "stay", "update", "news", "alert",
]


def document_frequency(docs: DataFrame, text: str = "text", least: int = 3, lower: bool = True) -> DataFrame:
    """(token, df): in how many texts each token stands, outside links and mentions and without the hash of hashtags."""
    t = T.plain_tokens(F.col(text)) if lower else T.tokens(F.col(text))
    return docs.select(F.explode_outer(F.array_distinct(t)).alias("token")).where("token is not null").groupBy("token").agg(F.count("*").alias("df")).where(F.col("df") >= least)


def distinctive_terms(docs: DataFrame, background: DataFrame, text: str = "text", share: float = 0.004, ratio: float = 8.0, keep: tuple[str, ...] = tuple(KEEP), common: tuple[str, ...] = ()) -> DataFrame:
    """(token, df): capitalised tokens and hashtags that many texts have and the background, smoothed, has an eighth as often or less.

    Words to keep, forms of the common words, and words with an apostrophe within are none. The background counts tokens of three texts or more.
    """
    marked = F.filter(T.tokens(T.without_links(F.col(text))), lambda t: t.rlike(r"^[#\p{Lu}]"))
    caps = F.transform(marked, lambda t: F.ltrim(F.lower(t), F.lit("#")))
    df = docs.select(F.explode(F.array_distinct(caps)).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    back = document_frequency(background, text).withColumnRenamed("df", "back")
    sizes = docs.agg(F.count("*").alias("n")).crossJoin(background.agg(F.count("*").alias("m")))
    j = df.join(back, "token", "left").crossJoin(F.broadcast(sizes))
    ok = (F.col("df") / F.col("n") >= share) & ((F.col("df") / F.col("n")) / ((F.coalesce("back", F.lit(0)) + 1) / (F.col("m") + 1)) >= ratio)
    base = F.regexp_replace("token", r"['’]s$", "")
    known = lambda c: c.isin(*common) if common else F.lit(False)
    stem = F.regexp_replace(base, "ing$", "")
    usual = known(base) | known(F.rtrim(base, F.lit("s"))) | (base.endswith("ing") & (known(stem) | known(F.concat(stem, F.lit("e")))))
    return j.where(ok & (F.length("token") >= 3) & ~F.col("token").isin(*keep) & ~base.rlike("['’]") & ~usual).select("token", "df")


_EDGES = r"[.,!?:;\"'()]"
_END = rf"{_EDGES}*(?!{T.S.replace('[', '[^', 1)})"


def _any_case(word: str) -> str:
    """A pattern of what ``lower`` makes this word of; the Kelvin sign is lowered to a letter of ASCII."""
    forms = lambda x: {x, *(y for y in (x.upper(), "\u212a", "\u212b", "\u2126", "\u1e9e") if len(y) == 1 and y.lower() == x)}
    return "".join("[" + "".join(rf"\x{{{ord(y):x}}}" for y in sorted(forms(x))) + "]" for x in word)


def _noun_pattern(common: tuple[str, ...]) -> str:
    """What stands before a proper noun and the noun itself: white space after a word that ends no sentence, marks, then a capital.

    Each step begins at white space and takes one word, so that the work grows with the text.
    """
    space = T.S
    before = rf"{space}(?<=[^\s\p{{Z}}.!?:]{space}){space}*+{_EDGES}*+#*+"
    usual = "|".join(_any_case(w) for w in (*common, *KEEP) if w == w.lower())
    fixed = "PLACE|URL|RT|I"
    return rf"({before})(?=\p{{Lu}})(?!I['’])(?!(?:{fixed}|{usual}){_END})\p{{Lu}}(?:[^\s\p{{Z}}]*[^\s\p{{Z}}.,!?:;\"'()])?(?={_END})"


def mask_proper_nouns(c: Column, common: tuple[str, ...], mark: str = "PLACE") -> Column:
    """Capitalised words that do not begin a sentence, are not common and not to be kept become marks; white space stays as it is."""
    return F.regexp_replace(c, _noun_pattern(common), "$1" + mark.replace("\\", "\\\\").replace("$", "\\$"))
