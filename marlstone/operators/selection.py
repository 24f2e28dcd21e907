"""Choosing patterns and models: label assignment, greedy and capped selection, votes, candidate batches and folds.

Counts come from DataFrames. The greedy loops that pick a bounded number of patterns keep masks as rows too and
hold only a score a pattern on the driver.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.metrics import confusion, f1
from marlstone.operators.patterns import contingency, duplicate_masks, mcc, mutual_information
from marlstone.plans.store import written

CELL = ["doc_id", "label"]


def expand(counts: DataFrame, ops: tuple[str, ...] = ("==", "!=", "<", "<=", ">", ">="), high: int | None = None) -> DataFrame:
    """pattern, op, eta: every operation and integer threshold from 0 to a pattern's largest count and one more. counts: pattern, n."""
    top = counts.groupBy("pattern").agg(F.max("n").cast("int").alias("n"))
    most = F.col("n") + 1 if high is None else F.least(F.col("n") + 1, F.lit(high))
    return top.select("pattern", F.explode(F.sequence(F.lit(0), most)).alias("eta")).select("pattern", F.explode(F.array(*map(F.lit, ops))).alias("op"), "eta")


def assign_labels(hits: DataFrame, pred: DataFrame, truth: DataFrame, docs: DataFrame, labels: DataFrame, least: float = 0.0) -> DataFrame:
    """pattern, label, gain: labels whose F1 over docs rises by more than `least` if the pattern's documents get them too."""
    part = lambda df: df.select(*CELL).distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    p, t = part(pred), part(truth)
    now = confusion(p, t, labels)
    cells = hits.select("doc_id", "pattern").distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_semi").crossJoin(F.broadcast(labels.select("label")))  # a bounded axis
    add = cells.join(p, CELL, "left_anti").join(t.withColumn("t", F.lit(1)), CELL, "left").groupBy("pattern", "label").agg(F.count("t").alias("a"), F.count_if(F.col("t").isNull()).alias("b"))
    gain = f1(F.col("tp") + F.col("a"), F.col("fp") + F.col("b"), F.col("fn") - F.col("a")) - F.col("f1")
    return add.join(now, "label").select("pattern", "label", gain.alias("gain")).where(F.col("gain") > least)


def greedy_patterns(hits: DataFrame, truth: DataFrame, docs: DataFrame, labels: DataFrame, budget: int, least: float = 0.0, prefilter: int | None = None) -> list[tuple[str, str, float]]:
    """(pattern, label, macro F1 after it): in each step the pair whose addition raises the macro F1 over docs most; ties by name.

    All candidates of a step are scored in one job. With `prefilter` only that many of the best pairs of the first step
    go on, an approximation: the others are judged against the empty start alone.
    """
    hits = written(hits.select("doc_id", "pattern").distinct(), "hits")  # every step reads them
    n = labels.count()
    have = truth.where("false").select(*CELL)
    macro = 0.0
    out: list[tuple[str, str, float]] = []
    pool = None
    while len(out) < budget:
        gains = assign_labels(hits, have, truth, docs, labels, least * n)
        if pool is not None:
            gains = gains.join(pool, ["pattern", "label"], "left_semi")
        ranked = gains.orderBy(F.desc(F.round("gain", 12)), "pattern", "label")
        if prefilter is not None and pool is None:
            pool = written(ranked.limit(prefilter).select("pattern", "label"), "pool")
        best = ranked.first()
        if best is None:
            break
        macro += best["gain"] / n
        out.append((best["pattern"], best["label"], macro))
        new = hits.where(F.col("pattern") == best["pattern"]).select("doc_id", F.lit(best["label"]).alias("label"))
        have = written(have.unionByName(new).distinct(), "have")
    return out


def signed_groups(baseline: DataFrame, groups: dict[str, DataFrame], truth: DataFrame, labels: DataFrame, least: float = 0.0) -> list[tuple[str, float]]:
    """(group, macro F1 after it): groups of signed facts (doc_id, label, sign) taken one by one by gain over the baseline's predictions.

    Corrected predictions are the baseline's without denied cells, and the affirmed ones. A group that contradicts
    itself or what was taken before cannot be taken. The baseline is never a fact.
    """
    score = lambda p: confusion(p, truth, labels).agg(F.avg("f1")).first()[0]
    facts = next(iter(groups.values())).where("false").select(*CELL, "sign") if groups else None
    now, left, out = score(baseline), dict(groups), []
    while left:
        best = None
        for name, g in left.items():
            both = facts.unionByName(g.select(*CELL, "sign")).distinct()
            if not both.groupBy(*CELL).agg(F.count_distinct("sign").alias("n")).where("n > 1").isEmpty():
                continue
            fixed = baseline.select(*CELL).join(both.where("sign < 0"), CELL, "left_anti").unionByName(both.where("sign > 0").select(*CELL)).distinct()
            s = score(fixed)
            if s - now > least and (best is None or s > best[1]):
                best = (name, s, both)
        if best is None:
            break
        facts = written(best[2], "signed")
        now = best[1]
        out.append(best[:2])
        left.pop(best[0])
    return out


def _distinct_masks(hits: DataFrame, docs: DataFrame) -> DataFrame:
    """hits over docs, of patterns with equal masks only the first by name."""
    h = hits.select("doc_id", "pattern").distinct().join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return written(h.join(duplicate_masks(h).where("pattern = first"), "pattern", "left_semi"), "masks")


def _per_label(h: DataFrame, corr: DataFrame, taken: DataFrame, most: int) -> DataFrame:
    """label, pattern, place: each label's `most` best patterns that are not taken. corr: pattern, label, mcc, s, side; taken: pattern, label, side.

    A pattern is worth |mcc| * sqrt(novel / support), novel counting its documents that no pattern taken for the label with
    the same side (sign of the correlation) covers. Ties: |mcc|, support, name.
    """
    covered = h.join(F.broadcast(taken), "pattern").select("label", "side", "doc_id").distinct()
    seen = h.join(F.broadcast(corr.select("pattern", "label", "side")), "pattern").join(covered, ["label", "side", "doc_id"], "left_semi")
    left = corr.join(seen.groupBy("pattern", "label").agg(F.count(F.lit(1)).alias("seen")), ["pattern", "label"], "left").join(taken.select("pattern").distinct(), "pattern", "left_anti")
    worth = F.abs("mcc") * F.sqrt((F.col("s") - F.coalesce("seen", F.lit(0))) / F.greatest("s", F.lit(1)))
    best = Window.partitionBy("label").orderBy(F.desc(F.round(worth, 12)), F.desc(F.round(F.abs("mcc"), 12)), F.desc("s"), "pattern")
    return left.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most).select("label", "pattern", "side", "place")


def balanced_greedy(hits: DataFrame, truth: DataFrame, docs: DataFrame, quota: int) -> list[tuple[str, str | None]]:
    """(pattern, label it was taken for or None): diverse patterns by correlation with labels.

    Three quarters of the quota go to the labels in rounds, in which each label takes its best pattern (see _per_label); where
    labels want the same, the first by name has it. The rest covers documents that no taken pattern covers, most first;
    ties: largest |mcc| of any label, support, name. Of patterns with equal masks the first by name stands for all. A round
    is one job: labels do not see each other's covers, so as many ranks a label as there are labels settle it.
    """
    spark, h = hits.sparkSession, _distinct_masks(hits, docs)
    corr = written(mcc(contingency(h, truth, docs)).select("pattern", "label", "mcc", "s", (F.col("mcc") >= 0).alias("side")), "correlations")
    names = sorted(r["label"] for r in corr.select("label").distinct().collect())
    shared = math.ceil(0.75 * quota)
    picks: list[tuple[str, str, bool]] = []
    while names and len(picks) < shared:
        taken = spark.createDataFrame(picks, "pattern string, label string, side boolean")
        ranks = _per_label(h, corr, taken, len(names)).orderBy("label", "place").collect()  # labels squared at most
        if not ranks:
            break
        for label in names[: shared - len(picks)]:
            free = next(((r["pattern"], label, r["side"]) for r in ranks if r["label"] == label and all(r["pattern"] != p for p, _, _ in picks)), None)
            picks += [free] if free else []
    out: list[tuple[str, str | None]] = [(p, label) for p, label, _ in picks]
    strongest = corr.groupBy("pattern").agg(F.max(F.round(F.abs("mcc"), 12)).alias("c"), F.max("s").alias("s"))
    while len(out) < quota:
        taken = spark.createDataFrame([(p,) for p, _ in out], "pattern string")
        fresh = h.join(h.join(F.broadcast(taken), "pattern", "left_semi").select("doc_id").distinct(), "doc_id", "left_anti").groupBy("pattern").agg(F.count(F.lit(1)).alias("fresh"))
        left = strongest.join(F.broadcast(taken), "pattern", "left_anti").join(fresh, "pattern", "left").na.fill(0, ["fresh"])
        best = left.orderBy(F.desc("fresh"), F.desc("c"), F.desc("s"), "pattern").first()
        if best is None:
            break
        out.append((best["pattern"], None))
    return out


def capped_information(hits: DataFrame, families: DataFrame, truth: DataFrame, docs: DataFrame, budget: int, per_label: int | None = None, share: float = 0.5) -> DataFrame:
    """place, pattern, label (for which it is in; null for a filler), mi: patterns by mutual information under caps.

    First come each label's best patterns of positive information, max(2, min(32, budget / (2 labels))) a label or `per_label`,
    labels by name (a pattern that is among those of several labels stands with the first); then all others by their best
    information. Along that list a family (families: pattern, family) keeps its first `share` of the budget, rounded up,
    and the list ends with the budget. Ties: support, name. Of patterns with equal masks the first by name stands for all.
    """
    h = _distinct_masks(hits, docs)
    table = mutual_information(contingency(h, truth, docs)).select("pattern", "label", F.round("mi", 12).alias("mi"), "s")
    labels = table.agg(F.count_distinct("label").alias("k"))
    each = F.lit(per_label) if per_label else F.greatest(F.lit(2), F.least(F.lit(32), F.floor(F.lit(budget) / (2 * F.greatest("k", F.lit(1))))))
    own = Window.partitionBy("label").orderBy(F.desc("mi"), F.desc("s"), "pattern")
    ranked = table.withColumn("r", F.row_number().over(own)).crossJoin(F.broadcast(labels))  # one row
    wanted = F.when((F.col("mi") > 0) & (F.col("r") <= each), F.struct("label", "r", "mi"))
    listed = ranked.groupBy("pattern").agg(F.min(wanted).alias("w"), F.max(F.struct("mi", "s")).alias("best")).join(families.select("pattern", "family"), "pattern")
    along = (F.col("w").isNull(), F.col("w.label"), F.col("w.r"), F.desc("best.mi"), F.desc("best.s"), F.col("pattern"))
    cap = max(1, math.ceil(share * budget))
    kept = listed.withColumn("in_family", F.row_number().over(Window.partitionBy("family").orderBy(*along))).where(F.col("in_family") <= cap).orderBy(*along).limit(budget)
    # At most `budget` rows from here on.
    return kept.withColumn("place", F.row_number().over(Window.orderBy(*along))).select("place", "pattern", F.col("w.label").alias("label"), F.coalesce("w.mi", "best.mi").alias("mi"))


def candidate_votes(utility: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """cluster, alias, votes, place: the k models with most votes, a document voting for its k models of largest utility; ties by alias. utility: doc_id, alias, u."""
    w = Window.partitionBy("doc_id").orderBy(F.desc("u"), "alias")
    votes = utility.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).join(clusters.select("doc_id", "cluster"), "doc_id").groupBy("cluster", "alias").agg(F.count(F.lit(1)).alias("votes"))
    all_ = clusters.select("cluster").distinct().crossJoin(F.broadcast(utility.select("alias").distinct()))  # models
    votes = all_.join(votes, ["cluster", "alias"], "left").na.fill(0, ["votes"])
    best = Window.partitionBy("cluster").orderBy(F.desc("votes"), "alias")
    return votes.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)


def best_subsets(utility: DataFrame, clusters: DataFrame, k: int, most: int = 100_000) -> DataFrame:
    """cluster, models: the k models whose best utility in a document is largest on average; ties within 1e-12 by mean utility, then by names."""
    aliases = sorted(r["alias"] for r in utility.select("alias").distinct().collect())  # models
    if math.comb(len(aliases), k) > most:
        raise ValueError(f"more than {most} sets of models")
    sets = F.array(*[F.array(*map(F.lit, c)) for c in itertools.combinations(aliases, k)])
    by_doc = utility.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("alias", "u"))).alias("m")).join(clusters.select("doc_id", "cluster"), "doc_id")
    e = by_doc.select("cluster", "m", F.explode(sets).alias("models"))
    u = F.transform("models", lambda a: F.col("m")[a])
    s = e.groupBy("cluster", "models").agg(F.avg(F.array_max(u)).alias("top"), F.avg(F.aggregate(u, F.lit(0.0), lambda a, x: a + x) / k).alias("mean"))
    top = F.max("top").over(Window.partitionBy("cluster"))
    near = s.withColumn("best", top).where(F.col("top") >= F.col("best") - 1e-12)
    near = near.withColumn("second", F.max("mean").over(Window.partitionBy("cluster"))).where(F.col("mean") >= F.col("second") - 1e-12)
    return near.groupBy("cluster").agg(F.min("models").alias("models"))


def vote_oracle(votes: DataFrame, truth: DataFrame, k: int, most: int = 100_000) -> DataFrame:
    """doc_id, models, correct: the k models whose majority is right on most labels of the document; ties by names. votes: doc_id, label, alias, vote (boolean)."""
    aliases = sorted(r["alias"] for r in votes.select("alias").distinct().collect())
    if math.comb(len(aliases), k) > most:
        raise ValueError(f"more than {most} sets of models")
    sets = F.array(*[F.array(*map(F.lit, c)) for c in itertools.combinations(aliases, k)])
    cell = votes.groupBy(*CELL).agg(F.collect_set(F.when(F.col("vote"), F.col("alias"))).alias("yes")).join(truth.select(*CELL, F.lit(True).alias("t")), CELL, "left")
    e = cell.select("doc_id", "yes", F.coalesce("t", F.lit(False)).alias("t"), F.explode(sets).alias("models"))
    right = (2 * F.size(F.array_intersect("models", "yes")) > k) == F.col("t")
    n = e.groupBy("doc_id", "models").agg(F.count_if(right).alias("correct"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("correct"), "models")
    return n.withColumn("r", F.row_number().over(w)).where("r = 1").select("doc_id", "models", "correct")


def fold_gain(before: DataFrame, after: DataFrame, truth: DataFrame, labels: DataFrame, folds: DataFrame, weight: float = 0.25, spread: float = 0.25) -> DataFrame:
    """gain, mean, std, objective: change of .8 macro + .2 micro over all rows, and of the mean and deviation over folds (doc_id, fold)."""
    def by_fold(pred: DataFrame, name: str) -> DataFrame:
        both = pred.select(*CELL).distinct().withColumn("p", F.lit(1)).join(truth.select(*CELL).distinct().withColumn("t", F.lit(1)), CELL, "full").join(folds.select("doc_id", "fold"), "doc_id")
        n = both.groupBy("fold", "label").agg(F.count_if(F.col("p").isNotNull() & F.col("t").isNotNull()).alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"), F.count_if(F.col("p").isNull()).alias("fn"))
        grid = folds.select("fold").distinct().crossJoin(F.broadcast(labels.select("label")))  # folds and labels
        n = grid.join(n, ["fold", "label"], "left").na.fill(0)
        one = lambda df, *by: df.groupBy(*by).agg((0.8 * F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))) + 0.2 * f1(F.sum("tp"), F.sum("fp"), F.sum("fn"))).alias(name))
        whole = n.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
        return one(n, "fold").unionByName(one(whole).withColumn("fold", F.lit(-1)))

    d = by_fold(before, "b").join(by_fold(after, "a"), "fold").select("fold", (F.col("a") - F.col("b")).alias("d"))
    own = F.when(F.col("fold") >= 0, F.col("d"))
    out = d.agg(F.max(F.when(F.col("fold") < 0, F.col("d"))).alias("gain"), F.avg(own).alias("mean"), F.stddev_pop(own).alias("std"))
    return out.withColumn("objective", F.col("gain") + weight * (F.col("mean") - spread * F.col("std")))
