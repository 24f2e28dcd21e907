"""The labeling loop's operators: arbitration, fallback, review ranking, feedback, reliability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELL = ["doc_id", "label"]


def arbitrate(unknown: DataFrame, probs: DataFrame, kappa: float) -> DataFrame:
    """doc_id, label, sign for unknown cells that have a probability: + from kappa on, else -. Never fed back to rules."""
    return unknown.select(*CELL).distinct().join(probs.select(*CELL, F.col("p").cast("double").alias("p")), CELL).select(*CELL, F.when(F.col("p") >= kappa, 1).otherwise(-1).alias("sign"))


def arbitrate_cells(unknown: DataFrame, probs: DataFrame, cuts: DataFrame) -> DataFrame:
    """The same with a cut a label (label, cut)."""
    x = unknown.select(*CELL).distinct().join(probs.select(*CELL, F.col("p").cast("double").alias("p")), CELL).join(cuts.select("label", "cut"), "label")
    return x.select(*CELL, F.when(F.col("p") >= F.col("cut"), 1).otherwise(-1).alias("sign"))


def undecided(docs: DataFrame, labels: DataFrame, *known: DataFrame) -> DataFrame:
    """Cells of the whole axis that none of the known tables has. labels is a bounded axis and is broadcast."""
    cells = docs.select("doc_id").distinct().crossJoin(F.broadcast(labels.select("label").distinct()))
    for k in known:
        cells = cells.join(k.select(*CELL).distinct(), CELL, "left_anti")
    return cells


def fallback(cells: DataFrame, probs: DataFrame, cuts: DataFrame) -> DataFrame:
    """Positive fill of undecided cells with p at or above their label's cut."""
    x = cells.join(probs.select(*CELL, F.col("p").cast("double").alias("p")), CELL).join(cuts.select("label", "cut"), "label")
    return x.where(F.col("p") >= F.col("cut")).select(*CELL)


def available(facts: DataFrame, arbitrated: DataFrame, filled: DataFrame) -> DataFrame:
    return facts.where("sign > 0").select(*CELL).unionByName(arbitrated.where("sign > 0").select(*CELL)).unionByName(filled.select(*CELL)).distinct()


def pending(docs: DataFrame, positive: DataFrame, unknown: DataFrame, trusted_empty: DataFrame | None = None) -> DataFrame:
    """Documents without a positive label (unless trusted to be empty) or with an unknown cell."""
    none = docs.select("doc_id").join(positive.select("doc_id"), "doc_id", "left_anti")
    if trusted_empty is not None:
        none = none.join(trusted_empty.select("doc_id"), "doc_id", "left_anti")
    return none.unionByName(unknown.select("doc_id")).distinct()


def uncertainty(probs: DataFrame) -> DataFrame:
    return probs.groupBy("doc_id").agg(F.round(F.avg(1 - F.abs(2 * F.col("p") - 1)), 9).alias("uncertainty"))


def evidence_scores(docs: DataFrame, cells: DataFrame, mean_card: float, ratio: float = 0.8) -> DataFrame:
    """doc_id, score of eligible documents, by doc and label cells (doc_id, label, pos, unknown, trusted, disagrees, p, cut)."""
    near = ~F.col("pos") & ~F.col("trusted") & (F.col("cut") > 0) & (F.col("p") >= ratio * F.col("cut")) & (F.col("p") < F.col("cut"))
    per = cells.groupBy("doc_id").agg(F.count_if("pos").alias("card"), F.count_if("unknown").alias("u"), F.count_if("disagrees").alias("dis"), F.count_if(near).alias("near"))
    x = docs.select("doc_id").distinct().join(per, "doc_id", "left").na.fill(0)
    missing = (F.col("card") < mean_card) & (F.col("near") > 0)
    ok = (F.col("card") == 0) | (F.col("u") > 0) | (F.col("dis") > 0) | missing
    score = 2.0 * F.col("u") + F.col("dis") + missing.cast("int") + (F.col("card") == 0).cast("int") + 0.05 * F.greatest(mean_card - F.col("card"), F.lit(0.0)) / max(mean_card, 1.0)
    return x.where(ok).select("doc_id", F.round(score, 9).alias("score"))


def legacy_scores(cells: DataFrame, mean_card: float, ratio: float = 0.7) -> DataFrame:
    """The earlier ranking: 2 [any unknown] + unknown / s + disagreements / s + deficit + .1 mean of the closest labels."""
    import math

    s, top, want = max(mean_card, 1.0), math.ceil(mean_card), ratio * mean_card
    per = cells.groupBy("doc_id").agg(F.count_if("pos").alias("card"), F.count_if("unknown").alias("u"), F.count_if("disagrees").alias("dis"), F.slice(F.reverse(F.array_sort(F.collect_list(1 - F.abs(F.col("p") - F.col("cut"))))), 1, max(1, top)).alias("close"))
    mean = F.aggregate("close", F.lit(0.0), lambda a, x: a + x) / F.size("close")
    score = 2 * (F.col("u") > 0).cast("int") + F.col("u") / s + F.col("dis") / s + F.greatest(want - F.col("card"), F.lit(0.0)) / max(want, 1.0) + 0.1 * mean
    return per.select("doc_id", F.round(score, 9).alias("score"))


def rank_review(scores: DataFrame, unanswered: DataFrame, limit: int, audit: float = 0.1, seed: str = "audit") -> DataFrame:
    """doc_id, place, reason: a share of `audit` by hash of the id, the rest by score (then id); refilled by hash."""
    import math

    random_n = math.ceil(limit * audit)
    h = F.sha2(F.concat(F.lit(seed + "|"), F.col("doc_id").cast("string")), 256)
    by_hash = unanswered.select("doc_id").distinct().withColumn("h", h).orderBy("h")
    picked = by_hash.limit(random_n).select("doc_id", F.lit("audit").alias("reason"))
    ranked = scores.join(unanswered.select("doc_id"), "doc_id", "left_semi").join(picked.select("doc_id"), "doc_id", "left_anti").orderBy(F.desc("score"), "doc_id").limit(limit - random_n).select("doc_id", F.lit("score").alias("reason"))
    both = picked.unionByName(ranked)
    short = by_hash.join(both.select("doc_id"), "doc_id", "left_anti").orderBy("h").limit(limit).select("doc_id", F.lit("refill").alias("reason"))
    order = F.when(F.col("reason") == "audit", 0).when(F.col("reason") == "score", 1).otherwise(2)
    return both.unionByName(short).withColumn("o", order).orderBy("o", "doc_id").limit(limit).drop("o")


def batch_size(initial: int, eligible: int, budget: int, fixed: int | None = None) -> int:
    """How many documents to ask for: `fixed`, or 1 % of the initial pool and 32 at least; not more than are eligible or the budget has left."""
    return min(max(32, -(-initial // 100)) if fixed is None else fixed, eligible, budget)


def weak_cells(logic: DataFrame, probs: DataFrame, cuts: DataFrame, gamma: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, label, target, p: derived cells of training rows whose model decision differs, outside validated ones."""
    x = logic.select(*CELL, "sign").join(train.select("doc_id"), "doc_id", "left_semi").join(gamma.select(*CELL), CELL, "left_anti")
    x = x.join(probs.select(*CELL, F.col("p").cast("double").alias("p")), CELL).join(cuts.select("label", "cut"), "label")
    return x.where((F.col("sign") > 0) != (F.col("p") >= F.col("cut"))).select(*CELL, (F.col("sign") > 0).cast("int").alias("target"), "p")


def weighted(cells: DataFrame, how: str = "uniform", discount: float = 0.0, floor: float = 0.0, cap: int | None = None, seed: str = "cap", trusted_mass: float | None = None, ratio: float = 1.0) -> DataFrame:
    """Adds weight. how: uniform, confidence or reliability (column q). Then floor, per-label cap by hash, and mass ratio."""
    w = {"uniform": F.lit(1.0), "confidence": F.when(F.col("target") == 1, F.col("p")).otherwise(1 - F.col("p")), "reliability": F.col("q") if "q" in cells.columns else F.lit(1.0)}[how]
    x = cells.withColumn("weight", w * (1 - discount * F.abs(F.col("p") - F.col("target")))).where(F.col("weight") >= floor)
    if cap is not None:
        h = F.sha2(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), "label"), 256)
        x = x.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(h))).where(F.col("r") <= cap).drop("r")
    if trusted_mass is not None:
        total = x.agg(F.sum("weight").alias("mass"))
        x = x.crossJoin(F.broadcast(total)).withColumn("weight", F.col("weight") * F.least(F.lit(1.0), ratio * trusted_mass / F.col("mass"))).drop("mass")
    return x


def rule_precision(conclusions: DataFrame, answers: DataFrame) -> DataFrame:
    """rule_id, support, correct, q = (correct + 1) / (support + 2) over distinct conclusions whose cell has an answer. Tables of doc_id, label, sign."""
    c = conclusions.select("rule_id", *CELL, "sign").distinct().join(answers.select(*CELL, F.col("sign").alias("truth")), CELL)
    return c.groupBy("rule_id").agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("sign") == F.col("truth")).alias("correct")).withColumn("q", (F.col("correct") + 1) / (F.col("support") + 2))


def direct_weights(conclusions: DataFrame, precision: DataFrame, roots: DataFrame) -> DataFrame:
    """doc_id, label, sign, weight: 1 for roots, else the best q of the rules that conclude the fact."""
    q = conclusions.join(precision.select("rule_id", "q"), "rule_id").groupBy(*CELL, "sign").agg(F.max("q").alias("weight"))
    r = roots.select(*CELL, "sign").distinct()
    return q.join(r, [*CELL, "sign"], "left_anti").unionByName(r.withColumn("weight", F.lit(1.0)))


def lineage(cat, rules: list, q: dict[int, float], policy: str = "halt") -> DataFrame:
    """doc_id, label, sign, rho: the largest t for which rules with q >= t still conclude the fact; roots 1. One closure a distinct q, from the top."""
    from marlstone.operators.closure import close_program

    roots = cat.gamma.select(*CELL, F.col("sign").cast("int").alias("sign")).distinct()
    out = roots.withColumn("rho", F.lit(1.0))
    for t in sorted(set(q.values()), reverse=True):
        found = close_program(cat, [r for i, r in enumerate(rules) if q[i] >= t], policy).facts
        out = out.unionByName(found.join(out, [*CELL, "sign"], "left_anti").select(*CELL, "sign").withColumn("rho", F.lit(t)))
    return out


def gate(before: dict, after: dict) -> bool:
    """A change is taken if neither F1 falls and their sum rises."""
    return after["macro"] >= before["macro"] and after["micro"] >= before["micro"] and after["macro"] + after["micro"] > before["macro"] + before["micro"]
