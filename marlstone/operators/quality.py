"""Further quality measures: precision and recall, observed cells only, utilities of models, reliability, repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.metrics import completeness, confusion, macro_micro

CELL = ["doc_id", "label"]


def precision_recall(per_label: DataFrame) -> DataFrame:
    """per_label (tp, fp, fn) with precision and recall, 0 on an empty denominator."""
    share = lambda d: F.when(d == 0, 0.0).otherwise(F.col("tp") / d)
    return per_label.withColumns({"precision": share(F.col("tp") + F.col("fp")), "recall": share(F.col("tp") + F.col("fn"))})


def observed_quality(pred: DataFrame, answers: DataFrame, labels: DataFrame) -> DataFrame:
    """macro_f1, micro_f1, tp, fp, fn, completeness, cells over cells that have an answer (doc_id, label, sign); completeness over rows with all of them."""
    a = answers.select(*CELL, "sign").distinct()
    own = pred.select(*CELL).distinct().join(a.select(*CELL), CELL, "left_semi")
    truth = a.where("sign > 0").select(*CELL)
    whole = a.groupBy("doc_id").agg(F.count_distinct("label").alias("n")).join(labels.agg(F.count(F.lit(1)).alias("k")), F.col("n") == F.col("k")).select("doc_id")
    c = completeness(own, truth.join(whole, "doc_id", "left_semi")).select("completeness")
    return macro_micro(confusion(own, truth, labels)).crossJoin(F.broadcast(c)).crossJoin(F.broadcast(a.agg(F.count(F.lit(1)).alias("cells"))))  # one row each


def label_cardinality(answers: DataFrame, labels: DataFrame, train: DataFrame) -> DataFrame:
    """rows, cardinality: mean number of positive labels of training rows whose every label has an answer."""
    k = labels.select("label").distinct().count()
    per = answers.join(train.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.count_distinct("label").alias("n"), F.count_distinct(F.when(F.col("sign") > 0, F.col("label"))).alias("pos")).where(F.col("n") == k)
    return per.agg(F.count(F.lit(1)).alias("rows"), F.avg("pos").alias("cardinality"))


def precision_gate(conclusions: DataFrame, gamma: DataFrame, floor: float = 0.9) -> DataFrame:
    """rule_id, agreements, blocked, passes: share of a rule's conclusions on validated cells that agree; a rule without such a cell passes."""
    c = conclusions.select("rule_id", *CELL, "sign").distinct()
    g = gamma.select(*CELL, F.col("sign").alias("truth")).distinct()
    n = c.join(g, CELL, "left").groupBy("rule_id").agg(F.count_if(F.col("sign") == F.col("truth")).alias("agreements"), F.count_if(F.col("sign") == -F.col("truth")).alias("blocked"))
    seen = F.col("agreements") + F.col("blocked")
    return n.withColumn("passes", (seen == 0) | (F.col("agreements") >= floor * seen))


def balanced_utility(scores: DataFrame) -> DataFrame:
    """doc_id, alias, u: 1 - squared error, averaged within a document's positive and negative labels and then over those of the two that exist. scores: doc_id, alias, label, p, target."""
    e = F.pow(F.col("p").cast("double") - F.col("target"), 2.0)
    by = scores.groupBy("doc_id", "alias", "target").agg(F.avg(e).alias("e"))
    return by.groupBy("doc_id", "alias").agg((1 - F.avg("e")).alias("u"))


def relative_utility(utility: DataFrame) -> DataFrame:
    """utility with u centred over a document's models."""
    return utility.withColumn("u", F.col("u") - F.avg("u").over(Window.partitionBy("doc_id")))


def static_quality(utility: DataFrame, clusters: DataFrame, fit: DataFrame, by_cluster: bool = True) -> DataFrame:
    """doc_id, alias, q: a model's mean utility over the fit rows, of the document's cluster if asked for and if it has any."""
    u = utility.join(fit.select("doc_id"), "doc_id", "left_semi")
    overall = u.groupBy("alias").agg(F.avg("u").alias("all"))
    x = clusters.select("doc_id", "cluster").crossJoin(F.broadcast(overall))  # models
    if by_cluster:
        own = u.join(clusters, "doc_id").groupBy("cluster", "alias").agg(F.avg("u").alias("own"))
        x = x.join(own, ["cluster", "alias"], "left").withColumn("all", F.coalesce("own", "all"))
    return x.select("doc_id", "alias", F.col("all").alias("q"))


def ridge_quality(utility: DataFrame, features: DataFrame, fit: DataFrame, penalty: float = 1.0) -> DataFrame:
    """doc_id, alias, q: ridge regression of each model's utility on the features (doc_id, x array<double>); the constant is not penalised.

    The normal equations are sums over rows; only they (features squared, a model) reach the driver.
    """
    import numpy as np

    spark = utility.sparkSession
    one = features.select("doc_id", F.concat(F.array(F.lit(1.0)), F.transform("x", lambda v: v.cast("double"))).alias("x"))
    d = one.select(F.size("x").alias("d")).first()["d"]
    rows = utility.join(fit.select("doc_id"), "doc_id", "left_semi").join(one, "doc_id")
    sums = [F.sum(F.col("x")[i] * F.col("x")[j]).alias(f"a{i}_{j}") for i in range(d) for j in range(i, d)] + [F.sum(F.col("x")[i] * F.col("u")).alias(f"b{i}") for i in range(d)]
    weights = []
    for r in rows.groupBy("alias").agg(*sums).collect():
        a = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)])
        a[np.arange(1, d), np.arange(1, d)] += penalty
        weights.append((r["alias"], np.linalg.lstsq(a, np.array([r[f"b{i}"] for i in range(d)]), rcond=None)[0].tolist()))
    w = spark.createDataFrame(weights, "alias string, w array<double>")
    dot = F.aggregate(F.zip_with("x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return one.crossJoin(F.broadcast(w)).select("doc_id", "alias", dot.alias("q"))  # models


def pseudo_labels(probs: DataFrame, low: float, high: float) -> DataFrame:
    """doc_id, label, target, weight of confident cells: p from `high` on is positive, up to `low` negative; weight is the confidence."""
    p = F.col("p").cast("double")
    return probs.where((p >= high) | (p <= low)).select(*CELL, (p >= high).cast("int").alias("target"), F.when(p >= high, p).otherwise(1 - p).alias("weight"))


def weighted_bce(scores: DataFrame, clip: float = 1e-7) -> DataFrame:
    """label, loss: weighted binary cross entropy. scores: label, p, target, weight."""
    p = F.least(F.greatest(F.col("p").cast("double"), F.lit(clip)), F.lit(1 - clip))
    loss = -F.when(F.col("target") == 1, F.log(p)).otherwise(F.log(1 - p))
    return scores.groupBy("label").agg((F.sum(F.col("weight") * loss) / F.sum("weight")).alias("loss"))


def repeats(metrics: DataFrame) -> DataFrame:
    """variant, metric, n, mean, std (of a sample; 0 for one run) over runs. metrics: variant, run, metric, value."""
    return metrics.groupBy("variant", "metric").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))


def same_facts(a: DataFrame, b: DataFrame) -> DataFrame:
    """only_a, only_b, both: whether two runs reached the same facts (doc_id, label, sign)."""
    key = [*CELL, "sign"]
    x = a.select(*key).distinct().withColumn("a", F.lit(1)).join(b.select(*key).distinct().withColumn("b", F.lit(1)), key, "full")
    return x.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("both"))


def independent_rows(calibration: DataFrame, others: DataFrame, text: str = "text") -> DataFrame:
    """The calibration rows whose text, white space collapsed and case folded, no row of others has: counts on them are independent of training."""
    from marlstone.functions.text import digest

    seen = others.select(digest(F.col(text)).alias("d_")).distinct()
    return calibration.withColumn("d_", digest(F.col(text))).join(seen, "d_", "left_anti").drop("d_")
