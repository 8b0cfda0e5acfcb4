"""Linear heads: scoring as expressions, training by spark.ml."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.functions import text as T
from emberline.operators.metrics import auc


def dot(vec: Column | str, weights: list[float]) -> Column:
    return F.aggregate(F.zip_with(vec, F.array(*map(F.lit, weights)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, x: s + x)


def binary(vec: str, weights: list[float], intercept: float) -> Column:
    return 1 / (1 + F.exp(-(dot(vec, weights) + intercept)))


def softmax(vec: str, heads: list[tuple[list[float], float]]) -> Column:
    """Class probabilities as an array."""
    logits = F.array(*[dot(vec, w) + b for w, b in heads])
    # logits, their top, powers and sum are each worked out once per row, not once per class
    exps = T.once(logits, lambda z: T.once(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp(x - top))))
    return T.once(exps, lambda e: T.once(F.aggregate(e, F.lit(0.0), lambda a, y: a + y), lambda total: F.transform(e, lambda x: x / total)))


def argmax(probabilities: str, names: list[str]) -> Column:
    return F.get(F.array(*map(F.lit, names)), (F.array_position(probabilities, F.array_max(probabilities)) - 1).cast("int"))


def l2_normalized(vec: str) -> Column:
    norm = F.sqrt(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(vec, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


# fixed values: urgency of a category where no head tells it
URGENCY = {"HUMAN": 3, "NEEDS": 3, "EVAC": 2, "INFRA": 2, "PROPERTY": 2, "ADVISORY": 2}


def fallback_urgency(cat: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in URGENCY.items() for x in kv]), cat), F.lit(1))


def predicted(rows: DataFrame, features: str, heads: dict[str, tuple[list[str], list[tuple[list[float], float]]]], hazard: str = "FLOOD") -> DataFrame:
    """The rows with p, cat, cat_conf, urg, hz, p_flood, uncertainty and flood_uncertainty.

    Heads: ``relevant`` and ``category``, and where they are there ``urgency`` and ``hazard``; without the last every relevant row is of ``hazard``. A row
    without features has probability 0.5 and category OTHER.
    """
    none = F.col(features).isNull()

    def of(name: str) -> tuple[list[str], Column] | None:
        classes, lines = heads.get(name, ([], []))
        return (classes, softmax(features, lines)) if lines else None

    relevant, category, urgency, kind = (of(n) for n in ("relevant", "category", "urgency", "hazard"))
    out = rows.withColumn("p", F.coalesce(F.when(~none, F.get(relevant[1], F.lit(1))), F.lit(0.5)) if relevant else F.lit(0.5))
    for name, head in (("category", category), ("urgency", urgency), ("hazard", kind)):
        out = out.withColumn(f"_{name}", F.when(~none, head[1]) if head else F.lit(None).cast("array<double>"))
    out = out.withColumn("cat", F.coalesce(argmax("_category", category[0]), F.lit("OTHER")) if category else F.lit("OTHER")).withColumn("cat_conf", F.coalesce(F.array_max("_category"), F.lit(0.0)))
    out = out.withColumn("urg", F.coalesce(argmax("_urgency", urgency[0]).cast("int"), fallback_urgency(F.col("cat"))) if urgency else fallback_urgency(F.col("cat")))
    out = out.withColumn("hz", F.coalesce(argmax("_hazard", kind[0]), F.lit(hazard)) if kind else F.lit(hazard))
    flood = F.get("_hazard", F.lit(kind[0].index(hazard))) if kind and hazard in kind[0] else F.lit(0.0) if kind else F.lit(1.0)
    out = out.withColumn("p_flood", F.col("p") * F.coalesce(flood, F.lit(1.0)))
    for p, name in (("p", "uncertainty"), ("p_flood", "flood_uncertainty")):
        out = out.withColumn(name, 1 - 2 * F.abs(F.col(p) - 0.5))
    return out.drop("_category", "_urgency", "_hazard")


def train_head(rows: DataFrame, label: str, features: str, weight: str, c: float = 2.0):
    """Weighted logistic regression whose penalty equals C times the weighted loss plus half the squared norm."""
    total = rows.agg(F.sum(weight)).first()[0]
    data = rows.select(F.col(label).cast("double").alias("label"), array_to_vector(F.transform(features, lambda x: x.cast("double"))).alias("features"), F.col(weight).cast("double").alias("weight"))
    return LogisticRegression(weightCol="weight", elasticNetParam=0.0, standardization=False, regParam=1 / (c * total), maxIter=200, tol=1e-8).fit(data)


def trained_heads(rows: DataFrame, features: str, heads: dict[str, list[str]], weight: str | None = None, balanced: bool = True) -> dict[str, tuple[list[str], list[tuple[list[float], float]]]]:
    """Per head its classes and a (weights, intercept) for each class that the rows have, in order; rows without a label are left out.

    With ``balanced`` a row weighs the square root of the largest class's size over its own's. Two classes are one binary head.
    """
    out = {}
    for name, classes in heads.items():
        own = rows.where(F.col(name).isNotNull()).withColumn("_c", F.col(name).cast("string")).where(F.col("_c").isin(*classes))
        sizes = {r["_c"]: r["count"] for r in own.groupBy("_c").count().collect()}  # as many rows as classes
        seen = [c for c in classes if c in sizes]
        if len(seen) < 2:
            out[name] = (seen, [])
            continue
        largest = max(sizes.values())
        w = F.coalesce(F.try_element_at(F.create_map(*[x for c in seen for x in (F.lit(c), F.lit((largest / sizes[c]) ** 0.5 if balanced else 1.0))]), "_c"), F.lit(1.0))
        y = (F.array_position(F.array(*map(F.lit, seen)), F.col("_c")) - 1).cast("int")
        model = train_head(own.withColumn("_y", y).withColumn("_w", w * (F.col(weight) if weight else F.lit(1.0))), "_y", features, "_w")
        lines = [([float(x) for x in model.coefficientMatrix.toArray()[i]], float(model.interceptVector[i])) for i in range(model.coefficientMatrix.numRows)]
        out[name] = (seen, [([0.0] * len(lines[0][0]), 0.0), lines[0]] if len(lines) == 1 else lines)
    return out


def imported_heads(table: DataFrame) -> dict[str, list[tuple[list[float], float]]]:
    """Heads from a table as :func:`heads_table` writes it; a head of one line is binary. The table has a line per head and class."""
    out: dict[str, list] = {}
    for r in table.orderBy("head", "class").collect():
        out.setdefault(r["head"], []).append((list(r["coef"]), r["intercept"]))
    return {name: [([0.0] * len(lines[0][0]), 0.0), *lines] if len(lines) == 1 else lines for name, lines in out.items()}


def leave_one_out(rows: DataFrame, by: str, features: str, label: str, weight: str = "weight") -> DataFrame:
    """(by, n, right, auc): for each value of ``by`` (few: one model each) how a head trained on all others does on its rows.

    All rows are scored together, each by the head that has not seen its value, and the areas are worked out in one pass.
    """
    heads = []
    for (value,) in rows.select(by).distinct().orderBy(by).collect():
        model = train_head(rows.where(~F.col(by).eqNullSafe(F.lit(value))), label, features, weight)
        heads.append((value, [float(x) for x in model.coefficientMatrix.toArray()[0]], float(model.interceptVector[0])))
    kind = dict(rows.dtypes)[by]
    table = rows.sparkSession.createDataFrame(heads, f"_by {kind}, _w array<double>, _b double")
    x = rows.join(F.broadcast(table), F.col(by).eqNullSafe(F.col("_by")))  # as many rows as there are values
    z = F.aggregate(F.zip_with(features, "_w", lambda a, w: a.cast("double") * w), F.col("_b"), lambda s, v: s + v)
    x = x.select(by, F.col(label).alias("_y"), (1 / (1 + F.exp(-z))).alias("_p"))
    counts = x.groupBy(by).agg(F.count("*").alias("n"), F.count_if((F.col("_p") >= 0.5).cast("int") == F.col("_y")).alias("right"))
    areas = auc(x, "_y", "_p", [by]).withColumnRenamed(by, "_of")
    return counts.join(areas, F.col(by).eqNullSafe(F.col("_of"))).select(by, "n", "right", "auc")


def heads_table(spark, name: str, model) -> DataFrame:
    """A fitted model as (head, class, intercept, coef)."""
    rows = [(name, i, float(model.interceptVector[i]), [float(x) for x in model.coefficientMatrix.toArray()[i]]) for i in range(model.coefficientMatrix.numRows)]
    return spark.createDataFrame(rows, "head string, class int, intercept double, coef array<double>")


def training_matrix(sources: list[tuple[DataFrame, float]], excluded: DataFrame, key: str) -> DataFrame:
    """Sources under one another with their weights, less the excluded keys."""
    out = None
    for df, w in sources:
        part = df.withColumn("weight", F.lit(w))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out.join(excluded.select(key), key, "left_anti")
