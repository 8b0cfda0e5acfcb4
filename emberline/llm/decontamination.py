"""Benchmark decontamination by spaced seeds, native.

Words are lower-cased. A mask keeps some positions of a span of words and ignores the others; the hash of the kept words is a seed. The
seeds of all benchmark positions are joined with those of all document positions; a hit fixes how the item would lie in the document.
Each such placement is then verified word by word: the longest stretch of the item inside the document of which at least ``MIN_SHARE``
are equal must have at least ``MIN_WORDS`` words (all of the item's, if it has fewer). Substituted words count wherever they stand.

No such stretch is without a seed: n words with at most n / 5 substituted hold four equal words in a row if n is 13, 14 or over 15, and
of 15 words the one pattern without is met by the second mask, as is that of 11; items of up to ``FEW`` words are searched by three in a
row as well.

The benchmark's seeds are broadcast, in up to ``PASSES`` slices of bounded bytes, each of which reads the documents once; beyond that the join
shuffles. Of a placement only the words under the item go on. Defined cases: null texts have no words; items of fewer than ``SHORT`` words
are searched by all their words in a row and must be equal; items without an id are searched like others and are found as null; items
without words are in no text; texts are searched whole, however long; of an item's placements in a document that with most equal words
counts, of equal ones the shorter, then the one furthest to the left; repeated rows are treated alike; an empty table of either kind gives no
hits; columns of other names are ignored by ``find_overlaps`` and kept by ``decontaminated``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.words import words
from emberline.operators.skew import BROADCAST_BYTES, bytes_of, small_or_shuffled
from emberline.session import table, written

#: Kept positions of each mask.
MASKS = [(0, 1, 2, 3), (0, 1, 4, 6, 9, 10)]
SHORT, FEW, MIN_WORDS, MIN_SHARE = 6, 10, 13, 0.8
#: What an equal and a substituted word add to a sum that is not negative where ``MIN_SHARE`` are equal.
HIT, MISS = 1, -4
#: Slices of seeds, of ``BROADCAST_BYTES`` each, that are broadcast one after another before the join shuffles instead.
PASSES = 4


def _hashes(text: Column) -> Column:
    return F.transform(words(F.lower(text)), lambda w: F.xxhash64(w))


def _seed_at(hashes: str, m: int, kept: tuple[int, ...]):
    return lambda i: F.xxhash64(F.lit(m), *[F.get(hashes, i + k) for k in kept])


def _seeds(rows: DataFrame, masks: list[tuple[int, ...]], hashes: str = "_h") -> DataFrame:
    """The rows with one entry per mask and position: ``_at``, ``_seed``."""
    n = F.size(hashes)
    parts = []
    for m, kept in enumerate(masks):
        last = n - 1 - max(kept)
        whole = F.transform(F.sequence(F.lit(0), last), _seed_at(hashes, m, kept))
        parts.append(F.when(last >= 0, whole).otherwise(F.array().cast("array<bigint>")))
    starts = F.array(*[F.greatest(n - max(kept), F.lit(0)) for kept in masks])
    out = rows.withColumn("_n", starts).select("*", F.posexplode(F.concat(*parts)).alias("_j", "_seed"))
    at, before = F.lit(None).cast("int"), [sum((F.get("_n", i) for i in range(m)), F.lit(0)) for m in range(len(masks))]
    for m in reversed(range(len(masks))):
        at = F.when(F.col("_j") >= before[m], F.col("_j") - before[m]) if m == len(masks) - 1 else F.when(F.col("_j") < before[m + 1], F.col("_j") - before[m]).otherwise(at)
    return out.withColumn("_at", at).drop("_n", "_j")


def find_overlaps(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, _rid, item, doc_start, item_start, n_words, n_equal): the best verified placement of each item in each document."""
    items = benchmark.select(F.col(item).alias("_id"), _hashes(F.col(item_text)).alias("_b")).where(F.size("_b") > 0)
    items = written(items.distinct().withColumn("_item", F.xxhash64("_id", "_b")), "items")
    masks = MASKS + ([(0, 1, 2)] if items.where(F.size("_b").between(SHORT, FEW)).limit(1).count() else [])
    tests = _seeds(items.where(F.size("_b") >= SHORT), masks, "_b").select("_item", F.col("_at").alias("_item_at"), "_seed")
    for (n,) in items.where(F.size("_b") < SHORT).select(F.size("_b")).distinct().collect():
        whole = _seed_at("_b", len(masks), tuple(range(n)))(F.lit(0))
        tests = tests.union(items.where(F.size("_b") == n).select("_item", F.lit(0).alias("_item_at"), whole.alias("_seed")))
        masks = [*masks, tuple(range(n))]
    tests = written(tests.distinct(), "seeds")
    lean = docs.select(F.col(key).alias("_key"), F.xxhash64(F.col(key), F.col(text)).alias("_rid"), F.col(text).alias("_t"))
    sown = _seeds(lean.select("_rid", _hashes(F.col("_t")).alias("_h")), masks).select("_rid", "_at", "_seed")
    slices = -(-bytes_of(tests) // BROADCAST_BYTES)
    if slices <= 1 or slices > PASSES:
        found = sown.join(small_or_shuffled(tests), "_seed")
    else:
        slices += 1  # a slice is not exactly its share
        found = None
        for i in range(slices):
            part = sown.join(small_or_shuffled(tests.where(F.pmod("_seed", F.lit(slices)) == i)), "_seed")
            found = part if found is None else found.union(part)
    hits = written(found.groupBy("_rid", "_item", (F.col("_at") - F.col("_item_at")).alias("_shift")).agg(F.count("*").alias("_hits")), "hits")
    with_hits = small_or_shuffled(hits.select("_rid").distinct())
    bodies = lean.join(with_hits, "_rid").select("_key", "_rid", _hashes(F.col("_t")).alias("_h")).dropDuplicates(["_rid"])
    placed = bodies.join(hits.join(small_or_shuffled(items), "_item"), "_rid")
    first = F.greatest(F.lit(0), -F.col("_shift"))
    last = F.least(F.size("_b"), F.size("_h") - F.col("_shift"))
    same = F.zip_with(F.slice("_h", first + F.col("_shift") + 1, last - first), F.slice("_b", first + 1, last - first), lambda x, y: x == y)
    need = F.least(F.lit(MIN_WORDS), F.size("_b"))
    placed = placed.select("_key", "_rid", "_id", "_shift", first.alias("_first"), need.alias("_need"), same.alias("_e"))
    need = F.col("_need")
    likely = placed.where(F.size(F.filter("_e", lambda same: same)) >= MIN_SHARE * need)
    zero = F.lit(0)
    state = F.struct(zero.alias("at"), zero.alias("sum"), F.array().cast("array<int>").alias("low"), zero.alias("start"), zero.alias("n"))

    def step(a: Column, same: Column) -> Column:
        # low[k] is where the sum first fell to -(k + 1): the longest stretch that ends here starts where it first fell to what it is
        at, total = a["at"] + 1, a["sum"] + F.when(same, HIT).otherwise(MISS)
        low = F.when(-total > F.size(a.low), F.concat(a.low, F.array_repeat(at, -total - F.size(a.low)))).otherwise(a.low)
        start = F.when(total >= 0, 0).otherwise(F.get(low, -total - 1))
        better = at - start > a.n
        return F.struct(at.alias("at"), total.alias("sum"), low.alias("low"), F.when(better, start).otherwise(a.start).alias("start"), F.when(better, at - start).otherwise(a.n).alias("n"))

    best = likely.withColumn("_s", F.aggregate("_e", state, step)).withColumn("n_words", F.col("_s.n"))
    good = best.where(F.col("n_words") >= need).withColumn("item_start", F.col("_first") + F.col("_s.start"))
    good = good.withColumn("n_equal", F.size(F.filter(F.slice("_e", F.col("_s.start") + 1, F.col("n_words")), lambda same: same)))
    one = good.groupBy(F.col("_key").alias(key), "_rid", F.col("_id").alias(item)).agg(F.max_by(F.struct((F.col("item_start") + F.col("_shift")).alias("doc_start"), "item_start", "n_words", "n_equal"), F.struct("n_equal", -F.col("n_words"), -F.col("_shift"))).alias("o"))
    return one.select(key, "_rid", item, "o.*")


def decontaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found."""
    bad = written(find_overlaps(docs.select(key, text), benchmark, key, text).select("_rid").distinct(), "contaminated")
    rows = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("_rid"), F.struct("*").alias("row"))
    return rows.join(small_or_shuffled(bad), "_rid", "left_anti").select("row.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("_rid")
