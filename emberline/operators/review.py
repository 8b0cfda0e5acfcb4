"""The budgeted review of uncertain rows: plan, batches, prompts, answers, and what they change."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.operators.skew import small_or_shuffled
from emberline.session import written

S = r"[\s\p{Z}]"
# fixed values: the closed sets of codes
CATEGORIES = ["INFRA", "EVAC", "HUMAN", "PROPERTY", "NEEDS", "AID", "ADVISORY", "SUPPORT", "OTHER"]
HAZARDS = ["FLOOD", "STORM", "QUAKE", "FIRE", "BLAST", "CRASH", "ATTACK", "OTHER"]


def cap(budget: int, batch: int) -> int:
    """Rows that a budget of calls covers; one call is kept back from ten on."""
    return max(0, budget - (1 if budget >= 10 else 0)) * batch


def planned(rows: DataFrame, budget: int, batch: int, p: str = "p", hint: str = "hinted", row_id: str = "id") -> DataFrame:
    """The rows to review in order, with tier, batch and line: uncertain ones, then likely ones (hinted first), then the others."""
    tier = F.when(F.col(p).between(0.15, 0.85), 1).when(F.col(p) > 0.85, 2).otherwise(3)
    first = F.when(tier == 1, F.lit(0)).when(tier == 2, 1 - F.col(hint).cast("int")).otherwise(0)
    second = F.when(tier == 1, F.abs(F.col(p) - 0.5)).otherwise(-F.col(p))
    q = rows.withColumn("tier", tier).withColumn("_a", first).withColumn("_b", second)
    top = q.orderBy("tier", "_a", "_b", row_id).limit(cap(budget, batch))
    # the limit bounds these rows by the budget, so that one window numbers them
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("tier", "_a", "_b", row_id)) - 1
    return top.withColumn("pos", n).withColumn("batch", F.floor(F.col("pos") / batch)).withColumn("line", (F.col("pos") % batch).cast("long")).drop("_a", "_b")


def prompts(rows: DataFrame, text: str = "text") -> DataFrame:
    """(batch, prompt, n): lines numbered from 0, line breaks as spaces, and how many."""
    line = F.struct("line", F.concat_ws("\t", F.col("line").cast("string"), F.regexp_replace(text, r"[\r\n]+", " ")).alias("said"))
    return rows.groupBy("batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x.said), "\n").alias("prompt"), F.count("*").alias("n"))


def parsed(answers: DataFrame, column: str = "answer") -> DataFrame:
    """Lines of answers as labels: id, rel, conf (0 to 9), hazard, cat, urg, cc, places.

    Codes are of either case; white space and backticks around a line, and fields of a dash, do not count. Relevant lines without a category
    are OTHER, without an urgency 1. Lines that are not labels, and those whose id is not below the batch's ``n`` where that is given, are
    dropped; of lines with one id in an answer the first counts.
    """
    lines = answers.select("batch", *(["n"] if "n" in answers.columns else [F.lit(None).cast("long").alias("n")]), F.posexplode(F.split(column, r"\r\n|\n|\r")).alias("at", "line"))
    bare = F.btrim(F.regexp_replace("line", rf"^{S}+|{S}+$", ""), F.lit("`"))
    lines = lines.withColumn("f", F.transform(F.split(bare, r"\|"), lambda x: F.regexp_replace(x, rf"^{S}+|{S}+$", "")))
    f = lambda i: F.get("f", F.lit(i))
    ok = (F.size("f") >= 3) & f(0).rlike(r"^\d{1,18}$") & f(1).isin("0", "1")
    x = lines.where(ok).withColumn("id", f(0).cast("long")).withColumn("rel", f(1).cast("int")).where(F.col("n").isNull() | (F.col("id") < F.col("n")))
    x = x.withColumn("conf", F.when(f(2).rlike(r"^\d+$"), F.least(F.coalesce(f(2).try_cast("int"), F.lit(9)), F.lit(9))).otherwise(5))
    levels = ["0", "1", "2", "3"]
    long = (F.size("f") >= 7) & F.upper(f(3)).isin(HAZARDS) & F.upper(f(4)).isin(CATEGORIES)
    tail = F.filter(F.slice("f", 4, F.size("f")), lambda t: t != "-")
    yes = F.col("rel") == 1
    cat = F.when(long, F.upper(f(4))).otherwise(F.coalesce(F.upper(F.get(F.filter(tail, lambda t: F.upper(t).isin(CATEGORIES)), F.lit(0))), F.lit("OTHER")))
    urg = F.coalesce(F.when(long, F.when(f(5).isin(levels), f(5))).otherwise(F.get(F.filter(tail, lambda t: t.isin(levels)), F.lit(0))).cast("int"), F.lit(1))
    free = F.filter(tail, lambda t: (t != "") & ~F.upper(t).isin(CATEGORIES) & ~t.isin(levels))
    named = F.when(long, F.coalesce(f(7), F.lit(""))).otherwise(F.coalesce(F.get(F.reverse(free), F.lit(0)), F.lit("")))
    places = F.filter(F.transform(F.split(named, ";"), lambda x: F.trim(x)), lambda t: ~t.isin("", "-"))
    x = x.withColumn("cat", F.when(yes, cat).otherwise("")).withColumn("urg", F.when(yes, urg).otherwise(0)).withColumn("hazard", F.when(yes & long, F.upper(f(3)))).withColumn("cc", F.when(yes & long & f(6).rlike("^[A-Za-z]{2}$"), F.upper(f(6))))
    x = x.withColumn("places", F.when(yes, places).otherwise(F.array().cast("array<string>")))
    first = F.row_number().over(Window.partitionBy("batch", "id").orderBy("at"))
    return x.withColumn("_r", first).where("_r = 1").select("batch", "id", "rel", "conf", "hazard", "cat", "urg", "cc", "places")


def _overwritten(rows: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """The rows with what labels (one per ``key`` at most; rel, conf from 0 to 1, cat, urg, hazard, cc) say of them. Irrelevant ones keep
    category, urgency and hazard, which are blanked later; a relevant one's country is that of its label, or none."""
    given = labels.select(F.col(key).alias("_id"), *[(F.col(c) if c in labels.columns else F.lit(None).cast(k)).alias(f"_{c}") for c, k in (("rel", "int"), ("conf", "double"), ("cat", "string"), ("urg", "int"), ("hazard", "string"), ("cc", "string"), ("places", "array<string>"))])
    j = rows.join(given, F.col(key) == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    yes = hit & (F.col("_rel") == 1)
    new = {
        "cat": F.when(yes & (F.coalesce("_cat", F.lit("")) != ""), F.col("_cat")).otherwise(F.col("cat")),
        "urg": F.when(yes & F.col("_urg").isNotNull(), F.col("_urg")).otherwise(F.col("urg")),
        "hz": F.when(yes & (F.coalesce("_hazard", F.lit("")) != ""), F.col("_hazard")).otherwise(F.col("hz")),
        "cc": F.when(yes, F.col("_cc")).otherwise(F.col("cc")),
        "rel": F.when(hit, F.col("_rel")).otherwise(F.col("rel")),
        "conf": F.when(hit & F.col("_conf").isNotNull(), F.col("_conf")).otherwise(F.col("conf")),
        "label_places": F.when(hit, F.coalesce("_places", F.array().cast("array<string>"))).otherwise(F.col("label_places")) if "label_places" in rows.columns else None,
        "decided_by": F.when(hit, "llm").otherwise(F.col("decided_by")),
    }
    return j.withColumns({c: v for c, v in new.items() if c in rows.columns and v is not None}).drop("_id", "_rel", "_conf", "_cat", "_urg", "_hazard", "_cc", "_places")


def applied(rows: DataFrame, labels: DataFrame, row_id: str = "id") -> DataFrame:
    """Local labels overwritten where a reviewed one came, whose confidence is out of nine."""
    return _overwritten(rows, labels.withColumn("conf", F.col("conf") / 9), row_id)


def precomputed(rows: DataFrame, labels: DataFrame, key: str = "g", order: str = "pos", default_hazard: str | None = None) -> DataFrame:
    """Labels made before: the first per key wins; a label without a hazard has the default one, a country code has two letters."""
    first = labels.groupBy(key).agg(F.min_by(F.struct(*[c for c in labels.columns if c != key]), order).alias("l")).select(key, "l.*")
    if default_hazard is not None:
        first = first.withColumn("hazard", F.coalesce(F.when(F.col("hazard") != "", F.col("hazard")), F.lit(default_hazard)) if "hazard" in first.columns else F.lit(default_hazard))
    if "cc" in first.columns:
        first = first.withColumn("cc", F.when(F.length("cc") == 2, F.col("cc")))
    return _overwritten(rows, first, key)


def blanked(rows: DataFrame) -> DataFrame:
    no = F.col("rel") == 0
    return rows.withColumn("cat", F.when(no, "").otherwise(F.col("cat"))).withColumn("hz", F.when(no, "").otherwise(F.col("hz"))).withColumn("urg", F.when(no, 0).otherwise(F.col("urg")))


def propagated(posts: DataFrame, canon: DataFrame, columns: list[str], key: str = "group_id") -> DataFrame:
    """Labels of the canonical rows on all copies."""
    return posts.join(canon.select(key, *columns), key, "left")


def confidence(p: Column) -> tuple[Column, Column, Column]:
    """relevant, confidence, uncertainty of a probability."""
    d = 2 * F.abs(p - 0.5)
    return (p >= 0.5).cast("int"), d, 1 - d


class BudgetSpent(RuntimeError):
    pass


@dataclass
class Provider:
    """Calls a model from the driver, never from executors. Answers are kept by the hash of their prompt; every attempt counts.

    ``mode``: live calls ``ask``; dry calls nothing; replay answers only from the cache.
    """

    ask: Callable[[str], str] | None = None
    budget: int = 0
    mode: str = "dry"
    cache: dict[str, str] = field(default_factory=dict)
    ledger: list[dict] = field(default_factory=list)
    spent: int = 0
    model: str = "rule"
    attempts: int = 4

    def key(self, prompt: str) -> str:
        return hashlib.sha256(json.dumps([self.model, 0.0, prompt]).encode()).hexdigest()[:24]

    def answer(self, prompt: str) -> str | None:
        h = self.key(prompt)
        if h in self.cache:
            return self.cache[h]
        if self.mode == "replay":
            raise LookupError(f"no cached answer for {h}")
        if self.mode == "dry" or self.ask is None:
            return None
        for attempt in range(self.attempts):
            if self.spent >= self.budget:
                raise BudgetSpent(f"{self.spent} of {self.budget} calls are spent")
            self.spent += 1
            try:
                out = self.ask(prompt)
            except ValueError as e:  # refused: asking again does not help
                self.ledger.append({"hash": h, "failed": True, "error": str(e)})
                return None
            except OSError as e:
                self.ledger.append({"hash": h, "failed": True, "error": str(e), "attempt": attempt})
                continue
            self.cache[h] = out
            self.ledger.append({"hash": h, "model": self.model, "failed": False})
            return out
        return None

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.cache))


def _asked(plan: DataFrame, provider: Provider) -> DataFrame:
    """The labels that the provider gives for the lines of a plan, by batch and line, until the budget is spent."""
    answers = []
    for r in prompts(plan).orderBy("batch").toLocalIterator():
        try:
            out = provider.answer(r["prompt"])
        except BudgetSpent:
            break
        if out:
            answers.append((r["batch"], out, r["n"]))
    return parsed(plan.sparkSession.createDataFrame(answers, "batch long, answer string, n long")).withColumnRenamed("id", "line")


def lacking(plan: DataFrame, labels: DataFrame, least: int = 3) -> DataFrame:
    """The lines that the labels lack, of batches that have some labels and lack at least ``least``, numbered from 0 again."""
    open_lines = plan.join(labels.select("batch").distinct(), "batch", "left_semi").join(labels.select("batch", "line"), ["batch", "line"], "left_anti")
    # a batch is bounded by the lines of a prompt
    own = Window.partitionBy("batch")
    again = open_lines.withColumn("_n", F.count("*").over(own)).withColumn("line", (F.row_number().over(own.orderBy("line")) - 1).cast("long"))
    return again.where(F.col("_n") >= least).drop("_n")


def reviewed(rows: DataFrame, provider: Provider, budget: int, batch: int, p: str = "p", hint: str = "hinted", texts: DataFrame | None = None) -> DataFrame:
    """Labels of the planned rows: id and the label columns. At most budget prompts come to the driver; a failed batch has no labels.

    ``texts`` (id, text) are for rows without a text: only those of planned rows are looked up.

    Batches whose answers lack three lines or more are asked for these once again, after all batches, while the budget lasts.
    """
    plan = planned(rows, budget, batch, p, hint)
    if texts is not None:
        plan = texts.join(small_or_shuffled(written(plan.select("batch", "line", "id"), "planned")), "id")
    plan = written(plan.select("batch", "line", "id", "text"), "plan")
    by_line = lambda labels, lines: labels.join(lines.select("batch", "line", "id"), ["batch", "line"]).drop("batch", "line")
    first = _asked(plan, provider)
    if provider.mode == "dry":
        return by_line(first, plan)
    again = written(lacking(plan, first), "lacking")
    return by_line(first, plan).unionByName(by_line(_asked(again, provider), again))
