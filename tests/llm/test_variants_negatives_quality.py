"""Spelling variants, hard negatives and the quality classifier on whole small tables against plain versions."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberline.llm import hard_negatives, quality_classifier, spelling
from emberline.llm.queries import QUERIES
from tests.llm.test_llm import prose


def brute_vocabulary(rows, typos):
    low = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
    counts = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(low)
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if typos and h % typos == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def is_near(a, b):
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def brute_variants(words):
    near = {w: [o for o in words if is_near(w, o)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-words[o], o), default=None)
        if best is not None and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, n, form.get(w), root(w), len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()}


def rows_of(df):
    return [(r["word"], r["n"], r["form"], r["root"], r["n_near"], r["form_n"]) for r in df.collect()]


def test_op11(spark, tmp_path):
    rng = random.Random(5)
    alphabet = "abcdeÀàéÿ×÷"
    base = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(5, 9))) for _ in range(60)]

    def typo(w):
        at, c = rng.randrange(len(w) + 1), rng.choice(alphabet)
        return rng.choice([w[:at] + c + w[at:], w[:at] + w[at + 1 :], w[:at] + c + w[at + 1 :]])

    words = base + [typo(w) for w in base for _ in range(4)]
    words += [typo(w) for w in words[60:120]]
    texts = [None, "", "1 2 3", "Straße ÀÈÌ Naïve naïve NAÏVE", " ".join(base) * 3, "z" * 30_000 + " " + "z" * 29_999 + " " + "z" * 15_000 + "y" + "z" * 14_999]
    texts += [texts[-1]] * 3 + [" ".join(rng.choices(words, weights=[20 if i < 60 else 4 for i in range(len(words))], k=300)) for _ in range(30)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, texts[-1], "c", 2), (3, texts[3], "clash", 1), (3, texts[3], "clash", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, word string, n int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_variants(brute_vocabulary([r[:2] for r in rows], 97))
    got = rows_of(QUERIES["op11_spelling"](spark, str(tmp_path)))
    assert set(got) == want and len(got) == len(want)
    assert any(r[2] and r[3] != r[2] for r in want) and any(len(r[0]) > 10_000 for r in want)


@pytest.mark.parametrize("limit", [0, 3])
def test_crowded_keys_lose_no_pair(spark, limit):
    """One opening for most words, and other keys than the ordinary ones for all of them."""
    rng = random.Random(8)
    words = {"qx" + "".join(rng.choice("ab") for _ in range(rng.randrange(3, 9))): rng.randrange(3, 90) for _ in range(260)}
    words |= {w[:4] + "é" + w[4:]: 7 for w in list(words)[:40]} | {"hello": 3, "hallo": 9, "hullo": 9}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    assert set(rows_of(spelling.variants(table, limit=limit))) == brute_variants(words)


def test_bigrams_of_near_words_meet():
    """Any edit leaves one of the three rarest bigrams of both words shared, whatever the order."""
    rng = random.Random(2)
    for _ in range(3000):
        w = "".join(rng.choice("abc") for _ in range(rng.randrange(5, 9)))
        at, c = rng.randrange(len(w) + 1), rng.choice("abc")
        o = rng.choice([w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])
        if o == w or not is_near(w, o) or len(o) < 5:
            continue
        order = {a + b: rng.random() for a in "abc" for b in "abc"}
        keys = []
        for x in (w, o):
            best = sorted((order[x[i : i + 2]], i) for i in range(len(x) - 1))[:3]
            keys.append({(m, side) for _, i in best for m in (len(x), len(x) - 1) for side in ("a" + x[: i + 2], "b" + x[i:])})
        assert keys[0] & keys[1], (w, o)


def brute_negatives(rows):
    """rows: (key, label, whole vector)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    last = lambda k: (k is None, k or 0)
    out = Counter()
    for at, (key, label, v) in enumerate(rows):
        if key is None or key % 50:
            continue
        scores = [(dot(v, o[2]), o) for i, o in enumerate(rows) if i != at]
        order = lambda x: (-x[0], last(x[1][0]))
        for ps, p in sorted((x for x in scores if x[1][1] == label), key=order)[:5]:
            window = sorted((x for x in scores if x[1][1] != label and 50 * ps <= 100 * x[0] <= 95 * ps), key=order)[:3]
            for rank, (ns, n) in enumerate(window, 1):
                out[(key, p[0], rank, n[0], ps, ns)] += 1
    return out


def vectors(rng):
    spread = lambda d=6: [float(np.float32(rng.gauss(0, 0.2))) for _ in range(d)]
    rows = [(i, spread(), i % 4) for i in range(400)]
    rows += [(1000 + i, spread(), 2) for i in range(60)] + [(i, [0.25] * 6, i % 3) for i in range(2000, 2060)]  # a group of equal vectors, hence ties
    rows += [(3000, None, 1), (3001, [0.1, None, 0.2], 1), (3002, [math.nan] * 6, 1), (3003, [math.inf] * 6, 1), (3004, spread(), None), (None, spread(), 1), (None, [0.25] * 6, 0)]
    rows += [(3050, [], 1), (3100, spread(3), 2), (3150, spread(9), 2), (3200, [0.0] * 6, 0), (3250, [-900.5] * 6, 3), (3300, [-0.9] * 6, 3)]
    return [*rows, rows[50], rows[50], rows[7], rows[420]]


def test_op12(spark, tmp_path):
    rows = vectors(random.Random(4))
    spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<float>, label int, id int, score int, block string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    whole = []
    for key, v, label in rows:
        if v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole.append((key, (label + 1) % 10 if key is not None and key % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    want = brute_negatives(whole)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = Counter(tuple(r[c] for c in names) for r in QUERIES["op12_hard_negatives"](spark, str(tmp_path)).collect())
    assert got == want and len(want) > 100
    taken = hard_negatives.whole_vectors(spark.read.parquet(f"{tmp_path}/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), "embedding", "label", "vec_id")
    small = hard_negatives.hard_negatives(taken, F.col("key") % 50 == 0, block_rows=40)  # many blocks
    assert Counter(tuple(r[c] for c in names) for r in small.collect()) == want


def test_blocks_meet_without_copies_of_anchors(spark):
    """Anchors are not sent along once per block of rows, by the driver or a shuffle; what a task finds does not grow with the blocks."""
    rng = np.random.default_rng(5)
    x = rng.integers(-90, 90, (600, 4))
    rows = spark.createDataFrame([(i, i % 3, [int(c) for c in v]) for i, v in enumerate(x)], "id long, label long, v array<long>").withColumn("key", F.col("id"))
    centroids = spark.sparkContext.broadcast(hard_negatives.fit_centroids(x))
    blocks = hard_negatives._row_blocks(rows, centroids, 4, 30).coalesce(1)
    anchors = hard_negatives._anchor_blocks(rows.where("id % 10 = 0"), 4, 3, False)
    found = hard_negatives._meeting(blocks, anchors.coalesce(1), hard_negatives._positives(centroids, 4, 5), ["id"], 5)
    got = Counter(r["id"] for r in found.collect())
    assert "BroadcastNestedLoop" not in found._jdf.queryExecution().executedPlan().toString() and "BroadcastHash" not in found._jdf.queryExecution().executedPlan().toString()
    assert got == dict.fromkeys(range(0, 600, 10), 5)


def test_best_rows_are_those_of_the_windows(spark):
    rng = np.random.default_rng(6)
    columns = [rng.integers(0, 4, 500), rng.integers(0, 3, 500), rng.integers(0, 60, 500), rng.integers(0, 2, 500), rng.integers(-4, 4, 500)]
    got = hard_negatives._best_rows(columns, 2, 3)
    order = sorted(zip(*(c.tolist() for c in columns), strict=True), key=lambda r: (r[0], r[1], -r[4], r[3], r[2]))
    seen: Counter = Counter()
    want = []
    for r in order:
        seen[r[:2]] += 1
        want += [r] * (seen[r[:2]] <= 3)
    assert list(zip(*(c.tolist() for c in got), strict=True)) == want
    assert [len(c) for c in hard_negatives._best_rows([c[:0] for c in columns], 2, 3)] == [0] * 5


def test_bounds_hold():
    """Every score lies within the norms' product of the sum of its lookups, for centroids of another table too."""
    rng = np.random.default_rng(1)
    x, a = rng.integers(-300, 300, (500, 7)), rng.integers(-300, 300, (20, 7))
    centroids = hard_negatives.fit_centroids(rng.integers(-90, 90, (300, 7)))
    codes = np.stack([hard_negatives._nearest(p, c) for p, c in zip(hard_negatives._parts(x), centroids, strict=True)], 1)
    guess = hard_negatives._approximate(codes, hard_negatives._lookup(a, centroids))
    missed = sum(np.square(p - c[codes[:, s]]).sum(1) for s, (p, c) in enumerate(zip(hard_negatives._parts(x), centroids, strict=True)))
    off = np.outer(hard_negatives._norms(a), np.sqrt(missed))
    assert (np.abs(a @ x.T - guess) <= np.ceil(off)).all() and off.max() > 0


def test_products_beyond_a_long_are_an_error(spark):
    rows = spark.createDataFrame([(0, 1, [1 << 40]), (1, 1, [5])], "key long, label long, v array<long>")
    with pytest.raises(ValueError, match="62 bits"):
        hard_negatives.hard_negatives(rows, F.col("key") == 0)


def test_op13(spark, tmp_path):
    rng = random.Random(9)
    good = lambda: prose(rng, rng.randrange(20, 60))
    junk = lambda: rng.choice([lambda: " ".join(w + "&&&" for w in good().split()), lambda: good().upper().replace(" ", "!! "), lambda: "spam " * rng.randrange(9, 40)])()
    texts = [junk() if i % 4 == 0 else good() for i in range(600)] + [None, "", " \n", prose(rng, 30_000), "x"]
    rows = [(i, t, "en", "s", 1, 2) for i, t in enumerate(texts)] + [(None, texts[0], "en", "s", 1, 2), (5, texts[5], "en", "s", 1, 2), (5, texts[5], "en", "s", 1, 2)]
    put = lambda name, df: df.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    put("documents", spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, held_out int, y int"))
    labels = [(i, int(i % 4 != 0), "x") for i in range(600) if i % 10] + [(None, 1, "x"), (1, None, "x"), (2, 0, "x"), (2, 1, "x")]
    put("labels", spark.createDataFrame(labels, "doc_id long, quality int, text string"))
    out = QUERIES["op13_quality_classifier"](spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    crc = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0
    for r in out:
        assert r["held_out"] == crc(r["doc_id"]) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in out if r["held_out"] and r["doc_id"] < 600]
    assert len(held) > 60 and np.mean([r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held]) > 0.97
    assert len({r["score"] for r in out if r["doc_id"] in (600, 601, 602)}) == 1
    # labels of held-out rows, and what is not text, are not looked at
    other = f"{tmp_path}/other"
    changed = spark.read.parquet(f"{tmp_path}/labels.parquet").withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    changed.write.parquet(f"{other}/labels.parquet")
    spark.read.parquet(f"{tmp_path}/documents.parquet").withColumn("lang", F.lit("zz")).write.parquet(f"{other}/documents.parquet")
    again = QUERIES["op13_quality_classifier"](spark, other).collect()
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in again) == Counter((r["doc_id"], round(r["score"], 9)) for r in out)
    changed.limit(0).write.parquet(f"{tmp_path}/none/labels.parquet")
    spark.read.parquet(f"{tmp_path}/documents.parquet").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert {r["score"] for r in QUERIES["op13_quality_classifier"](spark, f"{tmp_path}/none").collect()} == {0.5}


def test_updates_follow_the_leader():
    """After each row the weights are those that the closed form gives for all slopes seen."""
    rng = np.random.default_rng(0)
    z, n = np.zeros(9), np.zeros(9)
    slopes, pulls = np.zeros(9), np.zeros(9)  # sums of slopes, and of the pull towards each earlier leader
    for _ in range(40):
        at, values, y = np.sort(rng.choice(8, 3, replace=False)), rng.random(3), float(rng.random() < 0.5)
        w = quality_classifier.weights(z, n)
        full = np.zeros(9)
        full[at], full[8] = values, 1.0
        slope = (quality_classifier.logistic(w @ full) - y) * full
        before = n.copy()
        quality_classifier.follow(z, n, iter([(at, values, y)]))
        slopes += slope
        pulls += (np.sqrt(before + slope**2) - np.sqrt(before)) / quality_classifier.ALPHA * w
        assert np.allclose(z, slopes - pulls) and np.allclose(n, before + slope**2)
    groups = defaultdict(int)
    for t in ("a b a", "a  b\na", "a b a"):
        groups[tuple(quality_classifier.Features().of(t)[0])] += 1
    assert len(groups) == 1
