"""Mixing sources to target weights by temperature.

A source with token share p gets the weight p**a / sum(p**a). The exponent a is found by repeated section of an interval: each step
evaluates all section points in one aggregate over the table of sources, which is never gathered. Target: an entropy of the weights, or
a limit on repetition. The token budget is given, or as small as lets every source pass once in full. A source's budget is so many full
passes and a part of one: the first documents of a keyed permutation, which is a permutation of blocks and of rows within blocks. A cut
is thus a (block key, row key) pair per source, and each document compares its own keys with it: texts are not shuffled.

The mixture is realised as an order: pass by pass, a source's blocks are spread evenly over the whole, each pass in a permutation of its own,
so any stretch of the result has about the target weights. ``placed`` gives every copy its pass and its gapless position.

Defined cases: null and empty sources are one source, a null text has no tokens, a source without tokens passes once, texts count whole,
however long; rows with equal source, key and text are repeated rows: they are taken together or not at all, and have neighbouring
positions in an order that does not matter; ties of keys are ties of hashes only; a part of a pass never exceeds its budget. An empty
table gives no rows. Columns of the rows keep their names and values, whatever these are: the plan's columns stand beside the row, not in it.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.words import n_words
from emberline.operators.skew import join_on_hot_key
from emberline.session import forget, table, written

REPEATS, BLOCK_ROWS, LEAST_BLOCKS, SEED = 2.0, 1000, 64, "mix"
#: Copies that one task numbers, on average.
CELL_ROWS = 2_000


def _stats(sources: DataFrame, points: list[float]) -> list[tuple[float, float]]:
    """(sum p**a, sum p**a ln p) for each exponent a, in one pass."""
    row = sources.agg(*[x for i, a in enumerate(points) for x in (F.sum(F.exp(F.col("lp") * a)).alias(f"z{i}"), F.sum(F.exp(F.col("lp") * a) * F.col("lp")).alias(f"l{i}"))]).first()
    return [(row[f"z{i}"], row[f"l{i}"]) for i in range(len(points))]


def exponent(sources: DataFrame, entropy: float | None = None, repeats: float | None = None, budget: float | None = None, rounds: int = 6, parts: int = 16) -> float:
    """The largest exponent (the least change) whose weights have at least the entropy, or the least exponent that keeps to the repeats.

    ``sources`` has ln p in ``lp``. ``budget`` is in units of all tokens; None stands for the budget that lets every source pass once.
    """
    ends = sources.agg(F.min("lp").alias("lo"), F.max("lp").alias("hi")).first()
    if ends["lo"] is None or ends["lo"] == ends["hi"]:
        return 1.0
    low, high = 0.0, 1.0 if entropy is None else 8.0

    def fits(a: float, z: float, lz: float) -> bool:
        if entropy is not None:
            return math.log(z) - a * lz / z >= entropy
        passes = lambda lp: math.exp((a - 1) * lp) / z * (math.exp((1 - a) * ends["hi"]) * z if budget is None else budget)
        return max(passes(ends["lo"]), passes(ends["hi"])) > (repeats or REPEATS) * (1 + 1e-9)

    for _ in range(rounds):
        points = [low + (high - low) * i / parts for i in range(parts + 1)]
        ok = [fits(a, *s) for a, s in zip(points, _stats(sources, points), strict=True)]
        if not ok[0]:
            return low
        last = max(i for i, x in enumerate(ok) if x)
        if last == parts:
            return high
        low, high = points[last], points[last + 1]
    return low if entropy is not None else high


def plan(docs: DataFrame, entropy: float | None = None, repeats: float | None = REPEATS, budget_tokens: int | None = None, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(lean, sources): per row its source, keys and tokens; per source its weight, full passes and the keys at which a part ends."""
    lean = written(_keyed(docs, key, text, source, seed).select("_source", "_row", n_words(F.col(f"row.{text}")).alias("n_tokens")), "lean")
    raw = lean.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("rows"))
    sources = written(raw, "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    shares = sources.where("tokens > 0").withColumn("lp", F.log(F.col("tokens") / float(max(total, 1))))
    a = exponent(shares, entropy, repeats, None if budget_tokens is None else budget_tokens / max(total, 1))
    (z, _), = _stats(shares, [a]) if total else ((1.0, 0.0),)
    highest = shares.agg(F.max((1 - a) * F.col("lp"))).first()[0] or 0.0
    budget = float(budget_tokens) if budget_tokens is not None else total * z * math.exp(highest)
    weights = sources.withColumn("exponent", F.lit(float(a))).withColumn("weight", F.when(F.col("tokens") > 0, F.exp(a * F.log(F.col("tokens") / float(max(total, 1)))) / float(z)).otherwise(0.0))
    passes = F.when(F.col("tokens") > 0, F.round(F.col("weight") * budget / F.col("tokens"), 9)).otherwise(1.0)
    weights = weights.withColumn("passes", passes).withColumn("full", F.floor("passes")).withColumn("part", F.round((F.col("passes") - F.col("full")) * F.col("tokens")).cast("long")).withColumn("blocks", F.greatest(F.ceil(F.col("rows") / block_rows), F.least(F.col("rows"), F.lit(LEAST_BLOCKS)))).withColumn("exponent", F.lit(float(a)))
    weights = written(weights, "weights")
    rows = _blocked(join_on_hot_key(lean, weights, "_source", "rows", ["blocks", "part"], F.col("_row")), seed)
    by_block = written(rows.groupBy("_source", "_block").agg(F.sum("n_tokens").alias("t"), F.max("part").alias("part")), "blocks")
    # the cut is sought in slices of the block keys first, then among the blocks of one slice: no window holds all blocks of a source
    sliced = by_block.withColumn("slice", F.shiftright("_block", 52))
    by_slice = sliced.groupBy("_source", "slice").agg(F.sum("t").alias("t"), F.max("part").alias("part"))
    at_slice = _border(by_slice, "slice", F.lit(0))
    inner = sliced.join(at_slice.withColumnRenamed("before", "start"), ["_source", "slice"])
    border = written(_border(inner, "_block", F.col("start")).withColumnRenamed("_block", "cut_block"), "border")
    # rows of the blocks in which parts end: a source has one such block, of about block_rows rows
    at = rows.join(border.select(F.col("_source").alias("s2"), F.col("cut_block"), F.col("before")), (F.col("_source") == F.col("s2")) & (F.col("_block") == F.col("cut_block")))
    at = at.groupBy("_source", "_block", "_row").agg(F.sum("n_tokens").alias("n_tokens"), F.max("before").alias("before"), F.max("part").alias("part"))  # repeated rows go together
    inside = F.sum("n_tokens").over(Window.partitionBy("_source", "_block").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0))
    cut = at.withColumn("upto", F.col("before") + inside).where("upto <= part").groupBy("_source").agg(F.max("_row").alias("cut_row"))
    out = written(weights.join(border.select("_source", "cut_block"), "_source", "left").join(cut, "_source", "left"), "plan")
    forget(by_block, border, sources, weights)
    return lean, out


def _border(parts: DataFrame, by: str, start) -> DataFrame:
    """(_source, by, before): per source the first part, in order of ``by``, in which the tokens exceed the budget of a part of a pass."""
    upto = start + F.sum("t").over(Window.partitionBy("_source").orderBy(by).rowsBetween(Window.unboundedPreceding, 0))
    over = parts.withColumn("upto", upto).where("upto > part")
    return over.groupBy("_source").agg(F.min(F.struct(by, (F.col("upto") - F.col("t")).alias("before"))).alias("b")).select("_source", f"b.{by}", "b.before")


def _keyed(docs: DataFrame, key: str, text: str, source: str, seed: str) -> DataFrame:
    """(row, _source, _row): the rows as one column beside their source and key."""
    own = docs.select(F.struct("*").alias("row"))
    return own.select("row", F.coalesce(F.col(f"row.{source}").cast("string"), F.lit("")).alias("_source"), F.xxhash64(F.lit(seed), F.col(f"row.{key}"), F.crc32(F.coalesce(F.col(f"row.{text}"), F.lit("")).cast("binary"))).alias("_row"))


def _blocked(rows: DataFrame, seed: str) -> DataFrame:
    return rows.withColumn("_block", F.xxhash64(F.lit(seed), "_source", F.pmod(F.xxhash64("_row"), F.greatest(F.col("blocks"), F.lit(1)))))


def copies(docs: DataFrame, sources: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """(row, exponent, weight, passes, full, copies, block_key, row_key): each row of ``docs``, as one column, beside what a plan's sources say of it."""
    values = ["blocks", "exponent", "weight", "passes", "full", "part", "cut_block", "cut_row"]
    rows = _blocked(join_on_hot_key(_keyed(docs, key, text, source, seed), sources, "_source", "rows", values, F.col("_row")), seed)
    in_part = F.when(F.col("cut_block").isNull(), True).when(F.col("_block") != F.col("cut_block"), F.col("_block") < F.col("cut_block")).otherwise(F.coalesce(F.col("_row") <= F.col("cut_row"), F.lit(False)))
    many = (F.col("full") + (in_part & (F.col("part") > 0)).cast("long")).cast("long")
    return rows.select("row", "exponent", "weight", "passes", "full", many.alias("copies"), F.col("_block").alias("block_key"), F.col("_row").alias("row_key"))


def _passes(many: DataFrame, seed: str) -> DataFrame:
    """A line per copy: ``pass`` from 1, ``spot`` in [0, 1) and what orders copies at one spot.

    A full pass permutes blocks by a hash of its number; the part of a pass keeps the order in which it was cut, so its blocks fill its
    share of the whole evenly.
    """
    each = many.where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    block = F.when(F.col("pass") > F.col("full"), F.col("block_key")).otherwise(F.xxhash64(F.lit(seed), "pass", "block_key"))
    share = F.shiftright(block, 11).cast("double") / float(1 << 53) + 0.5
    spot = F.least((F.col("pass") - 1 + share) / F.greatest(F.col("passes"), F.col("pass") - 1 + share + 1e-9), F.lit(1 - 1e-12))
    return each.withColumn("spot", spot).withColumn("_b", block).withColumn("_r", F.xxhash64(F.lit(seed), "pass", "row_key"))


def placed(many: DataFrame, seed: str = SEED, keep: tuple = ()) -> DataFrame:
    """The lines of the mixture in their order: the columns ``keep`` of :func:`copies`, ``pass`` and ``position``, gapless from 0.

    Copies are dealt into cells by their spot; each cell is numbered alone and starts where the cells before it end.
    """
    lean = written(_passes(many, seed).select(*keep, "pass", "spot", "_b", "_r"), "passes")
    cells = max(1, -(-lean.count() // CELL_ROWS))
    lean = lean.withColumn("_cell", F.floor(F.col("spot") * cells).cast("int"))
    counts = lean.groupBy("_cell").agg(F.count("*").alias("_n")).withColumn("_slice", F.floor(F.col("_cell") / 4096))
    slices = counts.groupBy("_slice").agg(F.sum("_n").alias("_m"))
    ahead = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.join(slices.select("_slice", ahead("_m", Window.orderBy("_slice")).alias("_s")), "_slice").select("_cell", (F.col("_s") + ahead("_n", Window.partitionBy("_slice").orderBy("_cell"))).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_cell").orderBy("spot", "_b", "_r")) - 1
    return lean.withColumn("_i", inside).join(starts, "_cell").select(*keep, "pass", (F.col("_start") + F.col("_i")).cast("long").alias("position"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of the mixture, each as often as it has copies, with the columns of ``docs`` alone; sorted within its partitions by spot."""
    names = {k: options[k] for k in ("key", "text", "source", "seed") if k in options}
    lean, sources = plan(docs, **options)
    forget(lean)
    return _passes(copies(docs, sources, **names), names.get("seed", SEED)).sortWithinPartitions("spot", "_b", "_r").select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lean, sources = plan(docs)
    forget(lean)
    many = copies(docs.select("doc_id", "source", "text"), sources)
    keep = many.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), n_words("row.text").alias("n_tokens"), F.round("exponent", 6).alias("exponent"), F.round("weight", 9).alias("weight"), "passes", "full", "copies", "block_key", "row_key")
    return placed(keep, keep=("doc_id", "source", "n_tokens", "exponent", "weight", "copies", "block_key", "row_key"))
