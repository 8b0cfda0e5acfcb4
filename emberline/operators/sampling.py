"""Splits, samples, guards and label upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_hash(key: str, seed: str) -> Column:
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))


def hash_sample(df: DataFrame, key: str, n: int, seed: str = "s") -> DataFrame:
    return df.orderBy(order_hash(key, seed), key).limit(n)


def cap_per_class(df: DataFrame, label: str, key: str, k: int, seed: str = "s") -> DataFrame:
    """At most k rows per class, those of least hash: classes are first cut to k per slice of the hash, so no class meets in one task whole."""
    h = order_hash(key, seed)
    rows = df.withColumn("_h", h).withColumn("_p", F.substring("_h", 1, 2))
    some = rows.withColumn("_r", F.row_number().over(Window.partitionBy(label, "_p").orderBy("_h", key))).where(F.col("_r") <= k)
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy("_h", key))).where(F.col("_r") <= k).drop("_h", "_p", "_r")


def first_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, as an aggregate with partial sums."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_f")).select(key, "_f.*")


def split(groups: DataFrame, key: str, positive: str, gold: int = 200, tune: int = 100, seed: str = "s") -> DataFrame:
    """gold, then tune, each at most half from likely positives; all else train. Groups stay whole as they are the rows here."""
    per = gold + tune
    top = groups.select(key, positive, order_hash(key, seed).alias("_h"))
    half_gold, half_tune = gold // 2, tune // 2
    picked = []
    for value, g, t in ((True, half_gold, half_tune), (False, gold - half_gold, tune - half_tune)):
        some = top.where(F.col(positive) == value).orderBy("_h", key).limit(per)
        r = F.row_number().over(Window.partitionBy(positive).orderBy("_h", key))
        picked.append(some.withColumn("_r", r).select(key, F.when(F.col("_r") <= g, "gold").when(F.col("_r") <= g + t, "tune").alias("split")).where("split is not null"))
    chosen = picked[0].union(picked[1])
    return groups.join(F.broadcast(chosen), key, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def leakage_guard(train: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Training rows whose key does not occur in the held data."""
    return train.join(held.where(F.col(key) != "").select(key).distinct(), key, "left_anti")


def leaked(train: DataFrame, held: DataFrame, key: str, by: str) -> DataFrame:
    return train.join(held.where(F.col(key) != "").select(key).distinct(), key, "left_semi").groupBy(by).agg(F.count("*").alias("n"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def validate_labels(rows: DataFrame, categories: list[str], fixes: dict[str, str]) -> DataFrame:
    """Rows with relevance, their category corrected, and what is wrong with them; irrelevant rows are blanked."""
    missing = {"group_id", "split", "relevant"} - {c.lower() for c in rows.columns}
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    fixed = F.upper(F.trim(F.coalesce("category", F.lit(""))))
    if fixes:
        fixed = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fixes.items() for x in kv]), fixed), fixed)
    r = rows.where(F.trim(F.coalesce(F.col("relevant").cast("string"), F.lit(""))) != "").withColumn("category", fixed)
    bad = ~F.col("relevant").cast("string").isin("0", "1")
    wrong = (F.col("relevant").cast("string") == "1") & ~F.col("category").isin(*categories)
    r = r.withColumn("warning", F.when(bad, "relevant").when(wrong, "category").otherwise(""))
    return r.withColumn("category", F.when(F.col("relevant").cast("string") == "0", "").otherwise(F.col("category")))
