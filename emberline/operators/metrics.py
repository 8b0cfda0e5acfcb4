"""Evaluation as aggregates."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.place_values import PROVINCES


def prf(rows: DataFrame, truth: str, guess: str, by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1; denominators are at least 1."""
    t, g = F.col(truth) == 1, F.col(guess) == 1
    a = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.avg((t == g).cast("double")).alias("acc"))
    one = lambda c: F.greatest(c, F.lit(1))
    a = a.withColumn("precision", F.col("tp") / one(F.col("tp") + F.col("fp"))).withColumn("recall", F.col("tp") / one(F.col("tp") + F.col("fn")))
    return a.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def auc(rows: DataFrame, truth: str, score: str, by: list[str] | None = None) -> DataFrame:
    """Exact area under the curve with ties, from counts per score: no global sort of rows. ``by``: one for each group; null without both classes.

    Distinct scores are cut into ranges of a bounded number each; ranges are summed, then scores within a range.
    """
    by = by or []
    n = rows.groupBy(*by, F.col(score).alias("s")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("q"))
    part = n.withColumn("b", F.floor(F.col("s") * 1024))
    whole = part.groupBy(*by, "b").agg(F.sum("q").alias("bq"))
    earlier = Window.partitionBy(*by).orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    before = whole.withColumn("under", F.coalesce(F.sum("bq").over(earlier), F.lit(0))).select(*by, "b", "under")
    inside = F.coalesce(F.sum("q").over(Window.partitionBy(*by, "b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in by] + [F.col("l.b") == F.col("r.b")]
    met = part.withColumn("inside", inside).alias("l").join(before.alias("r"), same).select("l.*", "r.under")
    u = met.groupBy(*by).agg(F.sum(F.col("p") * (F.col("under") + F.col("inside") + F.col("q") / 2)).alias("u"), F.sum("p").alias("np"), F.sum("q").alias("nq"))
    return u.select(*by, F.try_divide("u", F.col("np") * F.col("nq")).alias("auc"))


def confusion(rows: DataFrame, truth: str, guess: str, k: int = 6) -> DataFrame:
    return rows.where(F.col(truth) != F.col(guess)).groupBy(truth, guess).agg(F.count("*").alias("n")).orderBy(F.desc("n"), truth, guess).limit(k)


def bands(rows: DataFrame, edges: list[tuple[float, float]], truth: str, p: str, reviewed: str) -> DataFrame:
    """Per band: share that is reviewed, accuracy inside and outside, accuracy of the cascade. One scan, no join."""
    local = (F.col(p) >= 0.5).cast("int")
    parts = []
    for lo, hi in edges:
        inside = F.col(p).between(lo, hi)
        right = (local == F.col(truth)).cast("double")
        final = (F.when(inside, F.col(reviewed)).otherwise(local) == F.col(truth)).cast("double")
        parts.append(F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), inside.cast("double").alias("i"), right.alias("r"), final.alias("f")))
    e = rows.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    return e.groupBy("lo", "hi").agg(F.avg("i").alias("reviewed"), F.avg(F.when(F.col("i") == 1, F.col("r"))).alias("acc_in"), F.avg(F.when(F.col("i") == 0, F.col("r"))).alias("acc_out"), F.avg("f").alias("acc"))


def class_weights(rows: DataFrame, label: str) -> DataFrame:
    n = rows.groupBy(label).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("m")))).select(label, F.sqrt(F.col("m") / F.col("n")).alias("weight"))


def similarity(a: str, b: str) -> float:
    """Normalised insertion-deletion similarity, 0 to 100, by the longest common subsequence."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        old = 0
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], old + 1 if x == y else max(row[j], row[j - 1])
    return 200.0 * row[-1] / (len(a) + len(b))


def token_set(a: str, b: str) -> float:
    """Similarity of the common words with each side's own words added; the best of the three comparisons."""
    x, y = set(re.findall(r"\w+", a)), set(re.findall(r"\w+", b))
    common, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not left or not right):
        return 100.0
    one, two = f"{common} {left}".strip(), f"{common} {right}".strip()
    return max([similarity(one, two)] + ([similarity(common, one), similarity(common, two)] if common else []))


def like(a: str, b: str) -> bool:
    return a == b or similarity(a, b) >= 85 or token_set(a, b) >= 95


def matched_places(gold: list[str], found: list[str], ignored: frozenset[str] = frozenset()) -> tuple[int, int, int]:
    """(hits, gold, found): in gold order, each name takes the first one like it that is still free.

    Likeness is told once for every two different names, as a matrix; names are then dealt by crossing out its columns.
    """
    plain = [[n for n in (str(x).lower().lstrip("#").strip() for x in names or []) if n and n not in ignored] for names in (gold, found)]
    wanted, offered = plain
    table = np.array([[like(a, b) for b in offered] for a in wanted], bool).reshape(len(wanted), len(offered))
    hits = 0
    for row in range(len(wanted)):
        at = np.flatnonzero(table[row])
        if len(at):
            table[:, at[0]] = False
            hits += 1
    return hits, len(wanted), len(offered)


def place_scores(rows: DataFrame, gold: str, found: str, relevant: str | None = None, regions: bool = True) -> DataFrame:
    """Micro-averaged recall and precision of place lists: of relevant rows alone, where ``relevant`` names a flag, and without provinces, which are
    trivially right, unless ``regions``."""
    ignored = frozenset() if regions else frozenset(p.lower() for p in PROVINCES)

    @F.pandas_udf("hits long, gold long, found long")
    def match(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        lists = lambda v: list(v) if v is not None else []
        return pd.DataFrame([matched_places(lists(x), lists(y), ignored) for x, y in zip(a, b, strict=True)], columns=["hits", "gold", "found"])

    kept = rows.where(F.col(relevant) == 1) if relevant else rows
    m = kept.select(match(gold, found).alias("m")).select("m.*").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("hits", "gold", "found")])
    return m.withColumn("recall", F.col("hits") / F.greatest("gold", F.lit(1))).withColumn("precision", F.col("hits") / F.greatest("found", F.lit(1)))
