"""Quality of predicted label facts against truth, always over a declared set of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    """0 on an empty denominator."""
    d = 2 * tp + fp + fn
    return F.when(d == 0, 0.0).otherwise(2.0 * tp / d)


def confusion(pred: DataFrame, truth: DataFrame, labels: DataFrame) -> DataFrame:
    """label, tp, fp, fn, f1 for each row of labels. pred, truth: (doc_id, label) positives."""
    both = pred.select("doc_id", "label").distinct().withColumn("p", F.lit(1)).join(truth.select("doc_id", "label").distinct().withColumn("t", F.lit(1)), ["doc_id", "label"], "full")
    n = both.groupBy("label").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
    out = labels.select("label").join(n, "label", "left").na.fill(0, ["tp", "fp", "fn"])
    return out.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def macro_micro(per_label: DataFrame) -> DataFrame:
    return per_label.agg(F.avg("f1").alias("macro_f1"), f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro_f1"), F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))


def completeness(pred: DataFrame, truth: DataFrame) -> DataFrame:
    """Mean recall of documents with more than one true label; null if there is none."""
    hit = truth.select("doc_id", "label").distinct().join(pred.select("doc_id", "label").distinct().withColumn("hit", F.lit(1)), ["doc_id", "label"], "left")
    per = hit.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("hit").alias("k")).where("n > 1")
    return per.agg(F.avg(F.col("k") / F.col("n")).alias("completeness"), F.count(F.lit(1)).alias("documents"))


def coverage(pred: DataFrame, docs: DataFrame) -> DataFrame:
    return docs.select("doc_id").distinct().join(pred.select("doc_id").distinct().withColumn("c", F.lit(1)), "doc_id", "left").agg(F.count("c").alias("covered"), F.count(F.lit(1)).alias("documents"), (F.count("c") / F.count(F.lit(1))).alias("coverage"))


def subset_accuracy(pred: DataFrame, truth: DataFrame, docs: DataFrame) -> DataFrame:
    """Share of documents whose predicted labels are exactly the true ones."""
    key = ["doc_id", "label"]
    p, t = pred.select(*key).distinct(), truth.select(*key).distinct()
    wrong = p.join(t, key, "left_anti").unionByName(t.join(p, key, "left_anti")).select("doc_id").distinct().withColumn("w", F.lit(1))
    return docs.select("doc_id").distinct().join(wrong, "doc_id", "left").agg(F.count_if(F.col("w").isNull()).alias("exact"), F.count(F.lit(1)).alias("documents"))


def cell_changes(before: DataFrame, after: DataFrame, truth: DataFrame) -> DataFrame:
    """label, recovered_fn, added_fp, lost_tp, removed_fp between two predictions."""
    key = ["doc_id", "label"]
    flag = lambda df, n: df.select(*key).distinct().withColumn(n, F.lit(True))
    x = flag(before, "b").join(flag(after, "a"), key, "full").join(flag(truth, "t"), key, "left").na.fill(False, ["b", "a", "t"])
    c = lambda e: F.count_if(F.expr(e))
    return x.groupBy("label").agg(c("a and not b and t").alias("recovered_fn"), c("a and not b and not t").alias("added_fp"), c("b and not a and t").alias("lost_tp"), c("b and not a and not t").alias("removed_fp"))


def average_precision(scores: DataFrame) -> DataFrame:
    """label, ap of (label, p, target 0/1); equal scores count together; 0 without a positive."""
    ends = scores.groupBy("label", "p").agg(F.sum("target").alias("y"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("label").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    cum = ends.withColumns({"cy": F.sum("y").over(w), "cn": F.sum("n").over(w)})
    return cum.groupBy("label").agg(F.coalesce(F.sum(F.col("y") * F.col("cy") / F.col("cn")) / F.nullif(F.sum("y"), F.lit(0)), F.lit(0.0)).alias("ap"))


def majority(votes: DataFrame) -> DataFrame:
    """doc_id, label, vote: true if more than half of the votes are."""
    return votes.groupBy("doc_id", "label").agg(F.count_if("vote").alias("yes"), F.count(F.lit(1)).alias("models")).withColumn("vote", F.col("yes") * 2 > F.col("models"))


def margin_ensemble(scores: DataFrame, clip: float = 1e-6) -> DataFrame:
    """doc_id, label, p: sigmoid of the mean of logit p - logit cut over the experts. scores: doc_id, label, p, cut."""
    from marlstone.functions.text import logit, sigmoid

    return scores.groupBy("doc_id", "label").agg(sigmoid(F.avg(logit(F.col("p"), clip) - logit(F.col("cut"), clip))).alias("p"))


def grid_counts(scores: DataFrame, grid: list[float]) -> DataFrame:
    """label, cut, tp, fp, fn, f1 for every cut of the grid: one pass with a row a score, counted by cut interval, then summed."""
    cuts = F.array(*map(F.lit, sorted(grid)))
    # A score counts for all cuts up to the largest that it reaches.
    reach = F.size(F.filter(cuts, lambda c: c <= F.col("p").cast("double")))
    n = scores.groupBy("label", reach.alias("k")).agg(F.sum("target").alias("y"), F.count(F.lit(1)).alias("n"))
    flat = n.groupBy("label").agg(F.collect_list(F.struct("k", "y", "n")).alias("x"))  # one entry a cut
    e = flat.select("label", "x", F.posexplode(cuts).alias("i", "cut"))
    total = lambda f: F.aggregate("x", F.lit(0).cast("long"), f)
    tp = total(lambda a, r: a + F.when(r["k"] > F.col("i"), r["y"]).otherwise(0))
    all_p = total(lambda a, r: a + F.when(r["k"] > F.col("i"), r["n"]).otherwise(0))
    all_y = total(lambda a, r: a + r["y"])
    out = e.select("label", "cut", tp.alias("tp"), (all_p - tp).alias("fp"), (all_y - tp).alias("fn"), all_y.alias("support"))
    return out.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def best_cut(counts: DataFrame, tie: str = "near_half") -> DataFrame:
    """The cut with the best F1 a label. Ties: near_half (nearest .5, then smaller) or larger."""
    order = F.struct("f1", -F.abs(F.col("cut") - 0.5), -F.col("cut")) if tie == "near_half" else F.struct("f1", F.col("cut"))
    return counts.groupBy("label").agg(F.max_by("cut", order).alias("cut"), F.max("f1").alias("f1"))


def shrunk_cuts(scores: DataFrame, grid: list[float]) -> DataFrame:
    """label, global_cut, cut: the label's best cut pulled towards the global one in logit space, by positives / (positives + 20)."""
    from marlstone.functions.text import logit, sigmoid

    counts = grid_counts(scores, grid)
    overall = counts.groupBy("cut").agg(F.avg("f1").alias("macro"), f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("micro"))
    overall = overall.agg(F.max_by("cut", F.struct((F.col("macro") + F.col("micro")) / 2, -F.abs(F.col("cut") - 0.5), -F.col("cut"))).alias("global_cut"))
    c = counts.crossJoin(F.broadcast(overall))  # one row
    best = c.groupBy("label", "global_cut", "support").agg(F.max_by("cut", F.struct("f1", -F.abs(F.col("cut") - F.col("global_cut")), -F.col("cut"))).alias("own"))
    w = F.col("support") / (F.col("support") + 20)
    mixed = sigmoid(w * logit(F.col("own")) + (1 - w) * logit(F.col("global_cut")))
    return best.select("label", "global_cut", F.when(F.col("support") == 0, F.col("global_cut")).otherwise(mixed).alias("cut"))


def pooled_cuts(scores: DataFrame, grid: list[float], least: int = 5) -> DataFrame:
    """label, cut: best F1, larger cut on ties; labels with fewer than `least` positives share the cut of all of them."""
    counts = grid_counts(scores, grid)
    rare = counts.where(F.col("support") < least)
    shared = rare.groupBy("cut").agg(f1(F.sum("tp"), F.sum("fp"), F.sum("fn")).alias("f1")).agg(F.max_by("cut", F.struct("f1", "cut")).alias("cut"))
    own = best_cut(counts.where(F.col("support") >= least), "larger").select("label", "cut")
    return own.unionByName(rare.select("label").distinct().crossJoin(F.broadcast(shared)).select("label", "cut"))


def kappa(scores: DataFrame, grid: list[float], old: float = 0.5, least: int = 1) -> DataFrame:
    """label, cut: weighted accuracy best strictly above the old cut's, largest on ties; old without `least` of both signs. scores: label, p, target, weight."""
    cuts = F.array(*map(F.lit, sorted({*grid, old})))
    e = scores.select("label", "p", "target", "weight", F.explode(cuts).alias("cut"))
    right = F.when((F.col("p") >= F.col("cut")) == (F.col("target") == 1), F.col("weight")).otherwise(0.0)
    acc = e.groupBy("label", "cut").agg(F.round(F.sum(right), 9).alias("acc"), F.count_if(F.col("target") == 1).alias("pos"), F.count_if(F.col("target") == 0).alias("neg"))
    per = acc.groupBy("label").agg(F.max_by("cut", F.struct("acc", "cut")).alias("best"), F.max("acc").alias("top"), F.max(F.when(F.col("cut") == old, F.col("acc"))).alias("was"), F.max("pos").alias("pos"), F.max("neg").alias("neg"))
    return per.select("label", F.when((F.col("top") > F.col("was")) & (F.col("pos") >= least) & (F.col("neg") >= least), F.col("best")).otherwise(old).alias("cut"))
