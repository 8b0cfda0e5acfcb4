"""Quality rules whose cutoffs a labelled holdout has to vouch for.

Each rule is a number that is higher for worse texts. For a stratum (a language) and a rule, the tightest cutoff of a fixed grid is taken
at which the exact binomial tail says that at most ``risk`` / rules of good documents lie above it: with k of n good holdout documents
above, P(Bin(n, risk) <= k) must be at most ``error`` divided by the number of all tests made (Bonferroni). Strata whose holdout cannot
vouch for any cutoff reject nothing beyond the base rule. All of it is native; the holdout is the whole label table.

Defined cases: a null text has no words and fails the base rule; a null language is the stratum ``und``; a null label is none; several
labels of a document count as their minimum; an empty table gives no rows; without labels only the base rule rejects; texts are counted
whole, however long; a value at a cutoff is kept; repeated rows are judged alike and count as often as they stand; columns beside those named
are kept under their own names, whatever these are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.words import trimmed, without_spaces, words
from emberline.operators.skew import small_or_shuffled
from emberline.session import table, written

RISK, ERROR, MIN_WORDS, WINDOW, REPEAT_PERCENT = 0.05, 0.05, 20, 8, 30
_SYMBOLS = "#*$%&|<>"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Name and value of each rule, from the columns of :func:`counts`.
RULES = {
    "symbols_per_word": "try_divide(n_symbols, n_words)",
    "marks_per_word": "try_divide(n_marks, n_words)",
    "capitals": "try_divide(n_capitals, word_chars)",
    "repeated_words": "try_divide(n_repeat_words, n_words)",
    "repeated_lines": "try_divide(n_dup_lines, n_lines)",
    "sameness": "1 - try_divide(n_distinct, n_words)",
    "word_length": "try_divide(word_chars, n_words) / 100",
}
#: Cutoffs that are tried for each rule.
GRID = [round(0.004 * 1.12**i, 6) for i in range(72)]


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with the base counts of the text and what the rules need."""
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_w", words(body)).withColumn("n_words", F.size("_w").cast("long"))
    d = d.withColumn("_h", F.transform("_w", lambda w: F.xxhash64(w)))
    last = F.col("n_words").cast("int") - WINDOW
    runs = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("_h", i + j) for j in range(WINDOW)]))
    d = d.withColumn("_g", F.when(last >= 0, runs).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_s", F.when(F.size("_g") > F.size(F.array_distinct("_g")), F.sort_array(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(F.array().cast("array<struct<g:bigint,i:int>>")))
    same = lambda s, j: F.coalesce(F.get("_s", j).g == s.g, F.lit(False))
    at = F.sort_array(F.transform(F.filter("_s", lambda s, j: same(s, j - 1) | same(s, j + 1)), lambda s: s.i))
    d = d.withColumn("_p", at)
    step = lambda a, p: F.struct((p + WINDOW).alias("end"), (a.n + p + WINDOW - F.greatest(a.end, p)).alias("n"))
    covered = F.aggregate("_p", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step).n
    lines = F.filter(F.split(body, "\n"), lambda x: trimmed(x) != "")
    solid = without_spaces(body)
    gone = lambda chars: (F.length(solid) - F.length(F.translate(solid, chars, ""))).cast("long")
    return (
        d.withColumn("word_chars", F.length(solid).cast("long"))
        .withColumn("n_symbols", gone(_SYMBOLS))
        .withColumn("n_marks", gone("!?"))
        .withColumn("n_capitals", gone(_CAPITALS))
        .withColumn("_l", lines)
        .withColumn("n_lines", F.size("_l").cast("long"))
        .withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
        .withColumn("n_distinct", F.size(F.array_distinct("_h")).cast("long"))
        .withColumn("n_repeat_words", covered.cast("long"))
        .withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))
        .drop("_w", "_h", "_g", "_s", "_p", "_l")
    )


def binomial_cdf(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), exactly: the largest term from logarithms, the others relative to it."""
    one_to_k = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    log_top = F.aggregate(one_to_k, F.lit(0.0), lambda a, i: a + F.log((n - i + 1) / i)) + k * F.log(F.lit(p)) + (n - k) * F.log(F.lit(1 - p))
    odds = (1 - p) / p
    down = F.aggregate(F.reverse(one_to_k), F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s")), lambda a, j: F.struct((a.t * j / (n - j + 1) * odds).alias("t"), (a.s + a.t * j / (n - j + 1) * odds).alias("s"))).s
    return F.when(k >= n, 1.0).otherwise(F.exp(log_top) * down)


def cutoffs(features: DataFrame, labels: DataFrame, key: str = "doc_id", stratum: str = "stratum", label: str = "quality", risk: float = RISK, error: float = ERROR) -> DataFrame:
    """(stratum, one column per rule): the chosen cutoffs; null where the holdout vouches for none."""
    good = labels.where(F.col(label).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(label).alias("_q")).where("_q = 1").select("_k")
    held = features.where("not base_failed").join(small_or_shuffled(good), F.col(key) == F.col("_k")).select(stratum, *RULES)
    long = held.select(stratum, F.explode(F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*RULES))).alias("rule", "value"))
    grid = F.array(*map(F.lit, GRID))
    level = F.size(F.filter(grid, lambda c: c < F.col("value")))  # cutoffs below the value: these would reject it
    by_level = long.groupBy(stratum, "rule", level.alias("level")).agg(F.count("*").alias("c"))
    total = by_level.groupBy(stratum, "rule").agg(F.sum("c").alias("n"), F.collect_list(F.struct("level", "c")).alias("levels"))
    each = risk / len(RULES)
    tests = max(1, features.select(stratum).distinct().count()) * len(RULES) * len(GRID)
    tried = total.select(stratum, "rule", "n", "levels", F.posexplode(grid).alias("i", "cutoff"))
    tried = tried.withColumn("k", F.aggregate("levels", F.lit(0).cast("long"), lambda a, x: a + F.when(x.level > F.col("i"), x.c).otherwise(0)))
    tail = F.when(F.col("k") <= F.col("n") * each, binomial_cdf(F.col("k"), F.col("n"), each)).otherwise(1.0)
    chosen = tried.where(tail <= error / tests).groupBy(stratum, "rule").agg(F.min("cutoff").alias("cutoff"))
    return chosen.groupBy(stratum).agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES])


def judged(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row: key, the base counts, base_failed, kept and the rules that reject it. Texts are read once and not shuffled."""
    # the caller's columns keep out of the way of those worked out here
    kept = {f"_keep{i}": c for i, c in enumerate((key, *keep))}
    f = counts(docs.select(*[F.col(c).alias(k) for k, c in kept.items()], F.col(text).alias("_t"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("stratum")), "_t")
    f = f.withColumns({r: F.coalesce(F.expr(f"cast({x} as double)"), F.lit(0.0)) for r, x in RULES.items()})
    f = written(f.drop("_t"), "features")
    cut = written(cutoffs(f, labels.withColumnRenamed(key, "_keep0"), "_keep0"), "cutoffs")
    rows = f.join(small_or_shuffled(cut.withColumnRenamed("stratum", "_st")), F.col("stratum") == F.col("_st"), "left")
    broken = F.array_compact(F.array(*[F.when(F.col(r) > F.col(f"cut_{r}"), F.lit(r)) for r in RULES]))
    rows = rows.withColumn("rejected_by", broken).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
    return rows.select(*[F.col(k).alias(c) for k, c in kept.items()], "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumn("rejected_by", F.array_join("rejected_by", ","))
