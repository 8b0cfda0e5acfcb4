"""Toxicity by class-conditional Kneser-Ney models.

Two character models with one shared body: the longest order (a character after ``ORDER - 1`` others of its word) is counted for each
class; all shorter orders are continuation counts over both classes together, so a rare expression that one class has not seen falls
back to the same probability in both and tells nothing. A word's evidence is its toxic less its ordinary log-likelihood; a text's is
the sum over its words divided by their number. Strong words are told apart: their evidence per word of the text, and per word of the
``STRETCH`` words in a row that hold most of it. A logistic curve turns these, all of them per word, into a score.

Scoring tasks hold the log-likelihood ratio of every counted gram, keyed by a 64-bit hash of the gram, 12 bytes each: a gram that was
not counted is found in no entry and falls back to its context. One thing is bounded, as a documented parameter: the labelled rows to
which the curve is fitted (``FIT_ROWS``, those of least hash among a sixth that is left out of the counts until then). The final counts
cover every labelled training row, that sixth included.

Defined cases: a null or empty text has no words and gets the curve's value at no evidence; texts are scored whole, however long; a null
label is no label; several labels of one document count as their maximum; a null doc_id has no label and is not held out; without labels of
both classes every score is 0; equal texts, and so repeated rows, get equal scores; a score at the threshold counts as toxic; rows of equal
hash at the bound of the curve's rows are told apart by their features; an empty table gives no rows; ``without_toxic`` keeps the columns of
its rows, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.arrow import arrow_pass
from emberline.operators.skew import small_or_shuffled
from emberline.session import table, written

ORDER, DISCOUNT, FIT_ROWS, THRESHOLD = 5, 0.75, 20_000, 0.7
#: Evidence of a word from which it counts as strong.
STRONG = 3.0
#: Words of the stretch in which strong words are looked for, and the evidence per word that counts as none.
STRETCH, NONE = 128, 1e-3
_EDGES = "#*$%&|<>.,;:!?\"'()[]{}"
_FEATURES = ("mean", "share", "level", "densest")


def _plain(word: str) -> str:
    return word.strip(_EDGES).lower()


def word_counts(rows: DataFrame, text: str, label: str) -> DataFrame:
    """(word, ordinary, toxic): how often each word stands in the texts of each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: dict[str, list[int]] = {}
            for is_toxic in (0, 1):
                raw: Counter = Counter()
                for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    if t and y == is_toxic:
                        raw.update(t.split())
                for w, n in raw.items():
                    counts.setdefault(_plain(w), [0, 0])[is_toxic] += n
            counts.pop("", None)
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "ordinary": pa.array([c[0] for c in counts.values()], pa.int64()), "toxic": pa.array([c[1] for c in counts.values()], pa.int64())})

    parts = arrow_pass(rows.select(F.col(text).cast("string").alias("t"), F.col(label).cast("int").alias("y")), run, "word string, ordinary long, toxic long")
    return parts.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def gram_keys(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of grams, given as rows of code points."""
    out = np.full(len(grams), 0x9E3779B97F4A7C15, np.uint64)
    for at in range(grams.shape[1]):
        out = (out ^ grams[:, at]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return out


def ratios(words: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """(gram, kind, ratio): log-likelihood ratios of seen grams (kind 0) and of any other character after a seen context (kind 1)."""
    padded = F.concat(F.lit("^" * (order - 1)), "word", F.lit("$"))
    grams = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: padded.substr(i, F.lit(order)))).alias("gram"), "ordinary", "toxic")
    top = written(grams.groupBy("gram").agg(F.sum("ordinary").alias("c0"), F.sum("toxic").alias("c1")), "grams")
    # continuation counts of the shared shorter orders
    sizes = {}
    longer = top.select("gram")
    for k in range(order - 1, 0, -1):
        longer = sizes[k] = longer.groupBy(F.expr(f"right(gram, {k})").alias("gram")).agg(F.count("*").alias("n"))
        longer = longer.select("gram")
    shared = None
    for k in range(1, order):
        context = Window.partitionBy(F.expr(f"left(gram, {k - 1})"))
        own = sizes[k].select("gram", "n", F.sum("n").over(context).alias("s"), F.count("*").over(context).alias("t"))
        if shared is None:
            shared = own.select("gram", ((F.col("n") - discount + discount * F.col("t") / F.col("t")) / F.col("s")).alias("p"))
        else:
            below = shared.select(F.col("gram").alias("tail"), F.col("p").alias("q"))
            shared = own.withColumn("tail", F.expr(f"right(gram, {k - 1})")).join(below, "tail").select("gram", ((F.col("n") - discount + discount * F.col("t") * F.col("q")) / F.col("s")).alias("p"))
    context = Window.partitionBy(F.expr(f"left(gram, {order - 1})"))
    full = top.select("gram", "c0", "c1", *[F.sum(c).over(context).alias(f"s{c}") for c in ("c0", "c1")], *[F.sum((F.col(c) > 0).cast("int")).over(context).alias(f"t{c}") for c in ("c0", "c1")]).withColumn("tail", F.expr(f"right(gram, {order - 1})"))
    full = full.join(shared.select(F.col("gram").alias("tail"), F.col("p").alias("q")), "tail")

    def likely(c: str, seen: bool):
        left = F.when(F.col(f"s{c}") > 0, discount * F.col(f"t{c}") / F.col(f"s{c}")).otherwise(1.0)
        return (F.greatest(F.col(c) - discount, F.lit(0.0)) / F.greatest(F.col(f"s{c}"), F.lit(1)) + left * F.col("q")) if seen else left

    full = full.withColumn("h", F.expr(f"left(gram, {order - 1})"))
    seen = full.select("gram", F.lit(0).alias("kind"), F.log(likely("c1", True) / likely("c0", True)).alias("ratio"))
    other = full.groupBy("h").agg(*[F.first(x).alias(x) for x in ("sc0", "sc1", "tc0", "tc1")]).select(F.col("h").alias("gram"), F.lit(1).alias("kind"), F.log(likely("c1", False) / likely("c0", False)).alias("ratio"))
    return seen.union(other)


class Model:
    """What scoring tasks hold: the ratios of grams (kind 0) and contexts (kind 1), each with its sorted keys, and the curve."""

    def __init__(self, table: list[tuple[np.ndarray, np.ndarray]], order: int, curve: np.ndarray | None):
        self.table, self.order, self.curve, self.seen = table, order, curve, {}

    def __getstate__(self):
        return self.__dict__ | {"seen": {}}

    def ratios(self, kind: int, grams: np.ndarray) -> np.ndarray:
        """The ratios of grams or contexts, given as rows of code points; not a number where one was not counted."""
        (keys, values), sought = self.table[kind], gram_keys(grams)
        if not len(keys):
            return np.full(len(sought), np.nan)
        at = np.minimum(keys.searchsorted(sought), len(keys) - 1)
        return np.where(keys[at] == sought, values[at], np.nan)

    def remember(self, words: list[str]) -> None:
        """Keep the evidence of raw words."""
        k, plain = self.order, [_plain(w) for w in words]
        points = _points("".join(["^" * (k - 1) + p + "$" for p in plain]))
        sizes = np.array([len(p) + k for p in plain])
        starts = np.cumsum(sizes) - sizes
        # a window per character of each word and its end; none crosses into the next word
        counts = sizes - k + 1
        first = np.cumsum(counts) - counts
        at = np.arange(counts.sum()) + np.repeat(starts - first, counts)
        grams = np.lib.stride_tricks.sliding_window_view(points, k)[at]
        r = self.ratios(0, grams)
        unseen = np.flatnonzero(np.isnan(r))
        r[unseen] = np.nan_to_num(self.ratios(1, grams[unseen, : k - 1]))
        evidence = np.where(counts > 1, np.add.reduceat(r, first), 0.0)
        self.seen.update(zip(words, evidence.tolist(), strict=True))

    def features(self, text: str | None) -> tuple[float, ...]:
        """Evidence per word; of strong words alone, also as a logarithm; and that of the densest stretch."""
        words = text.split() if text else []
        if not words:
            return 0.0, 0.0, math.log(NONE), math.log(NONE)
        if len(self.seen) > 200_000:  # a bound on memory
            self.seen.clear()
        seen = self.seen
        new = [w for w in words if w not in seen]
        if new:
            self.remember(list(dict.fromkeys(new)))
        each = np.array([seen[w] for w in words])
        strong = np.where(each > STRONG, np.minimum(each, 12.0), 0.0)
        share = float(strong.mean())
        total = np.concatenate([[0.0], np.cumsum(strong)])
        size = min(STRETCH, len(each))
        densest = float((total[size:] - total[:-size]).max()) / size
        return float(np.clip(each, -12, 12).mean()), share, math.log(share + NONE), math.log(max(densest, 0.0) + NONE)

    def score(self, features: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(features))
        mean, spread, weights = self.curve
        z = (features - mean[:-1]) / spread[:-1] @ weights[:-1] + weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> np.ndarray | None:
    """Penalised logistic regression by Newton steps, each shortened until the loss falls as its slope says."""
    if not len(y) or y.min() == y.max():
        return None
    mean, spread = x.mean(0), x.std(0) + 1e-9
    a = np.column_stack([(x - mean) / spread, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    hold = ridge * np.eye(len(w))
    hold[-1, -1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float((np.logaddexp(0, z) - y * z).sum() + w @ hold @ w / 2)

    now = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        slope = a.T @ (p - y) + hold @ w
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + hold, slope)
        size = 1.0
        while (new := loss(w - size * step)) > now - 1e-4 * size * (slope @ step) and size > 1e-10:
            size /= 2
        w, now = w - size * step, min(new, now)
        if np.abs(size * step).max() < 1e-8:
            break
    return np.array([[*mean, 0], [*spread, 1], w])


def _features(rows: DataFrame, model, keep: list[str], text: str, score: str | None) -> DataFrame:
    kinds = dict(rows.dtypes)
    names = [score] if score else list(_FEATURES)
    kept = text in keep and kinds[text] == "string"  # then it need not come twice
    at = keep.index(text) if kept else len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value
        try:
            for b in batches:
                f = np.array([held.features(t) for t in b.column(at).to_pylist()]).reshape(-1, len(_FEATURES))
                new = [held.score(f)] if score else list(f.T)
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *[pa.array(v, pa.float64()) for v in new]], [*keep, *names])
        finally:
            held.seen.clear()  # the model outlives the task in its worker

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"{n} double" for n in names])
    return arrow_pass(rows.select(*keep, *([] if kept else [F.col(text).cast("string").alias("_text")])), run, schema)


def _ratio_table(found: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """The ratios of each kind with their sorted keys."""
    parts: list[list[tuple[np.ndarray, np.ndarray]]] = [[], []]
    for b in found.select("gram", "kind", F.col("ratio").cast("float").alias("ratio")).toArrow().to_batches():
        kinds, values = b.column(1).to_numpy(), b.column(2).to_numpy()
        for kind in (0, 1):
            own = b.column(0).filter(pa.array(kinds == kind)).to_pylist()
            if own:
                parts[kind].append((gram_keys(_points("".join(own)).reshape(len(own), -1)), values[kinds == kind]))
    out = []
    for own in parts:
        keys = np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in own]])
        order = np.argsort(keys)
        out.append((keys[order], np.concatenate([np.zeros(0, np.float32), *[v for _, v in own]])[order]))
    return out


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", order: int = ORDER, fit_rows: int = FIT_ROWS) -> Model:
    """Models from the rows whose crc32 of the key, as text, leaves 0 or 2 when divided by 3. A sixth of these is kept for
    the curve and counted after it is fitted."""
    spark = docs.sparkSession
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_y")).withColumn("_c", F.crc32(F.col(key).cast("string").cast("binary"))).where("_c % 3 <> 1")
    known = written(known.select(F.col(key).alias("_k"), "_y", (F.floor(F.col("_c") / 3) % 6 == 0).alias("_part"), F.xxhash64(key).alias("_h")), "known")
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(small_or_shuffled(known), "_k")
    counts = written(word_counts(rows.where("not _part"), "_t", "_y"), "words")
    model = Model(_ratio_table(ratios(counts, order)), order, None)
    # the curve's rows are chosen by their ids, so that texts stay where they are; what comes to the driver are their features
    chosen = written(known.where("_part").orderBy("_h", "_k").limit(fit_rows).select("_k"), "chosen")
    fit = _features(rows.join(F.broadcast(chosen), "_k", "left_semi"), spark.sparkContext.broadcast(model), ["_y", "_h"], "_t", None)
    seen = fit.orderBy("_h", "_y", *_FEATURES).limit(fit_rows).toPandas()
    curve = fit_curve(seen[list(_FEATURES)].to_numpy(float), seen["_y"].to_numpy(float))
    part = F.col("_part")
    every = counts.union(word_counts(rows.where(part), "_t", "_y")).groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    return Model(_ratio_table(ratios(every, order)), order, curve)


def scored(docs: DataFrame, model: Model, keep: list[str], text: str = "text", score: str = "score") -> DataFrame:
    """The columns ``keep`` and the score of each row."""
    return _features(docs, docs.sparkSession.sparkContext.broadcast(model), keep, text, score)


def without_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below ``threshold``, with their columns."""
    model = train(docs, labels, text, key)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # names that the score's cannot meet
    return scored(plain, model, plain.columns, plain.columns[docs.columns.index(text)]).where(F.col("score") < threshold).drop("score").toDF(*docs.columns)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
