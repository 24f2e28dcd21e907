"""The labeling loop: ledger, training batches, residual corrections, gates, and rounds of query, answer and closure."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import review
from marlstone.operators.closure import Closure, close_program
from marlstone.operators.metrics import f1
from marlstone.operators.quality import label_cardinality
from marlstone.operators.splits import smallest
from marlstone.plans.compile import Catalog
from marlstone.plans.rules import ML, Doc, Label, Rule
from marlstone.plans.store import written

CELL = ["doc_id", "label"]


def in_scope(valuations: DataFrame, disabled: DataFrame) -> DataFrame:
    """The rule instances that are not disabled, by rule_id and every variable's document."""
    return valuations.join(disabled, disabled.columns, "left_anti")


def routed_votes(docs: DataFrame, routes: DataFrame, decisions: DataFrame) -> DataFrame:
    """doc_id, label, vote: majority of the models that a document's key is routed to. docs: doc_id, key; routes: key, cluster, alias.

    A key that is routed to two clusters is an error.
    """
    bad = routes.groupBy("key").agg(F.count_distinct("cluster").alias("n")).where("n > 1").limit(1).collect()
    if bad:
        raise ValueError(f"key {bad[0]['key']!r} is routed to several clusters")
    own = docs.select("doc_id", "key").join(routes.select("key", "alias").distinct(), "key").join(decisions.select(*CELL, "alias", "vote"), ["doc_id", "alias"])
    return own.groupBy(*CELL).agg((F.count_if("vote") * 2 > F.count(F.lit(1))).alias("vote"))


def ledger(answers: DataFrame, labels: DataFrame, train: DataFrame, acquired: DataFrame, pending: DataFrame) -> DataFrame:
    """doc_id, complete of training rows to learn from: acquired rows with every label answered, and pending rows with any."""
    k = labels.select("label").distinct().count()
    n = answers.groupBy("doc_id").agg(F.count_distinct("label").alias("n")).join(train.select("doc_id").distinct(), "doc_id", "left_semi")
    whole = n.where(F.col("n") == k).join(acquired.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit(True).alias("complete"))
    some = n.join(pending.select("doc_id"), "doc_id", "left_semi").select("doc_id", F.lit(False).alias("complete"))
    return whole.unionByName(some).groupBy("doc_id").agg(F.max("complete").alias("complete"))


def evenly_spaced(rows: DataFrame, share: float, key: str = "doc_id") -> DataFrame:
    """ceil(n share) rows at the places i * n // count of the order by key, by two levels of ranks."""
    n = rows.count()
    count = -(-int(n * share * 1_000_000) // 1_000_000) if share < 1 else n
    if not count:
        return rows.where("false")
    part = F.spark_partition_id()
    ordered = rows.repartitionByRange(key).withColumn("part_", part)
    ordered = written(ordered, "ordered")
    sizes = ordered.groupBy("part_").agg(F.count(F.lit(1)).alias("c_"))
    before = sizes.withColumn("before_", F.coalesce(F.sum("c_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row a partition
    place = F.col("before_") + F.row_number().over(Window.partitionBy("part_").orderBy(key)) - 1
    ranked = ordered.join(F.broadcast(before), "part_").withColumn("place_", place)
    # Place p is taken if p = i * n // count for the smallest i with i * n >= p * count.
    i = F.ceil(F.col("place_") * count / n)
    return ranked.where(F.floor(i * n / count) == F.col("place_")).where(i < count).select(*rows.columns)


def incremental_batch(weak: DataFrame, previous: DataFrame, answers: DataFrame, train: DataFrame, fresh: DataFrame, replay: float) -> DataFrame:
    """doc_id, label, target, weight, origin: weak cells whose signed target is new or changed, all answers of fresh rows, and a share of older answered rows.

    weak: doc_id, label, target, weight; previous: doc_id, label, target. Answers replace weak cells.
    """
    known = answers.join(train.select("doc_id").distinct(), "doc_id", "left_semi")
    new = known.join(fresh.select("doc_id"), "doc_id", "left_semi")
    old = known.join(fresh.select("doc_id"), "doc_id", "left_anti")
    again = evenly_spaced(old.select("doc_id").distinct(), replay)
    trusted = new.select(*CELL, "sign", F.lit("fresh").alias("origin")).unionByName(old.join(again, "doc_id", "left_semi").select(*CELL, "sign", F.lit("replay").alias("origin")))
    trusted = trusted.select(*CELL, (F.col("sign") > 0).cast("int").alias("target"), F.lit(1.0).alias("weight"), "origin")
    changed = weak.join(previous.select(*CELL, "target"), [*CELL, "target"], "left_anti").join(trusted.select(*CELL), CELL, "left_anti")
    return trusted.unionByName(changed.select(*CELL, F.col("target").cast("int").alias("target"), "weight", F.lit("weak").alias("origin")))


def limit_rows(batch: DataFrame, fresh: DataFrame, most: int, seed: str = "rows") -> DataFrame:
    """The batch of at most `most` documents: all fresh ones, the others by hash of the id."""
    active = batch.select("doc_id").distinct()
    must = active.join(fresh.select("doc_id").distinct(), "doc_id", "left_semi")
    n = must.count()
    if n > most:
        raise ValueError("the row budget cannot hold the newly verified documents")
    rest = smallest(active.join(must, "doc_id", "left_anti"), "doc_id", most - n, seed + "|")
    return batch.join(must.unionByName(rest), "doc_id", "left_semi")


def residual_cuts(cells: DataFrame, positive: list[float], negative: list[float], least: int = 5, loss: float = 0.1) -> DataFrame:
    """label, gain, pos_cut, neg_cut (null: no removals): the pair of cuts of best F1 a label that is better than none.

    cells: doc_id, label, p, old and target (booleans). Absent cells with p >= pos_cut are added, present ones with
    p <= neg_cut < pos_cut removed; a negative cut needs `least` removals that lose at most a share `loss` of the
    label's true cells. Ties: larger F1, then larger pos_cut, then smaller neg_cut.
    """
    p, n = F.array(*map(F.lit, sorted(positive))), F.array(*map(F.lit, sorted(negative)))
    # Each cell counts at the number of cuts that it reaches; sums over the grid come from these few rows a label.
    up = F.size(F.filter(p, lambda c: F.col("p").cast("double") >= c))
    down = F.size(F.filter(n, lambda c: F.col("p").cast("double") <= c))
    c = cells.groupBy("label", F.when(~F.col("old"), up).alias("u"), F.when(F.col("old"), down).alias("d")).agg(F.count_if("target").alias("t"), F.count_if(~F.col("target")).alias("f"))
    base = cells.groupBy("label").agg(F.count_if(F.col("old") & F.col("target")).alias("tp"), F.count_if(F.col("old") & ~F.col("target")).alias("fp"), F.count_if(~F.col("old") & F.col("target")).alias("fn"))
    added = c.where("u is not null").select("label", "u", "t", "f", F.posexplode(p).alias("i", "pos_cut")).where(F.col("u") > F.col("i")).groupBy("label", "pos_cut").agg(F.sum("t").alias("at"), F.sum("f").alias("af"))
    removed = c.where("d is not null").select("label", "d", "t", "f", F.posexplode(n).alias("i", "neg_cut")).where(F.col("d") >= F.size(n) - F.col("i")).groupBy("label", "neg_cut").agg(F.sum("t").alias("rt"), F.sum("f").alias("rf"))
    every = base.select("label", F.explode(p).alias("pos_cut")).join(added, ["label", "pos_cut"], "left").na.fill(0, ["at", "af"])
    cut = base.select("label", F.explode(F.concat(F.array(F.lit(None).cast("double")), n)).alias("neg_cut"))
    cut = cut.join(removed, ["label", "neg_cut"], "left").na.fill(0, ["rt", "rf"]).join(base, "label")
    true = F.col("tp") + F.col("fn")
    safe = F.col("neg_cut").isNull() | ((F.col("rt") + F.col("rf") >= least) & (true > 0) & (F.col("rt") <= loss * true))
    g = every.join(cut.where(safe), "label").where(F.col("neg_cut").isNull() | (F.col("neg_cut") < F.col("pos_cut")))
    now = f1(F.col("tp") + F.col("at") - F.col("rt"), F.col("fp") + F.col("af") - F.col("rf"), F.col("fn") - F.col("at") + F.col("rt"))
    g = g.withColumn("gain", now - f1(F.col("tp"), F.col("fp"), F.col("fn"))).where(F.col("gain") > 1e-12)
    order = F.struct(F.round("gain", 12), "pos_cut", -F.coalesce("neg_cut", F.lit(-1.0)))
    return g.groupBy("label").agg(F.max_by(F.struct("gain", "pos_cut", "neg_cut"), order).alias("b")).select("label", "b.*")


def joint_cuts(cells: DataFrame, cuts: DataFrame) -> DataFrame:
    """The rows of residual_cuts that are kept in a pass over the labels by gain (ties by name), with place: one is kept if micro F1 over all labels,
    with those kept before, does not fall.

    The pass folds one row a label.
    """
    known = cells.join(F.broadcast(cuts.select("label", "pos_cut", "neg_cut")), "label", "left")  # a row a label
    p = F.col("p").cast("double")
    new = F.when(F.col("old"), F.coalesce(~(p <= F.col("neg_cut")), F.lit(True))).otherwise(F.coalesce(p >= F.col("pos_cut"), F.lit(False)))
    count = lambda pred, name: [F.count_if(pred & F.col("target")).alias(f"tp{name}"), F.count_if(pred & ~F.col("target")).alias(f"fp{name}"), F.count_if(~pred & F.col("target")).alias(f"fn{name}")]
    per = known.groupBy("label").agg(*count(F.col("old"), ""), *count(new, "_")).join(cuts, "label", "left")
    total = per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.array_sort(F.collect_list(F.when(F.col("gain").isNotNull(), F.struct(
        (-F.round("gain", 12)).alias("order"), "label", *[(F.col(f"{c}_") - F.col(c)).alias(c) for c in ("tp", "fp", "fn")])))).alias("changes"))
    start = F.struct("tp", "fp", "fn", F.array().cast("array<string>").alias("kept"))

    def step(a, x):
        after = {c: a[c] + x[c] for c in ("tp", "fp", "fn")}
        good = f1(after["tp"], after["fp"], after["fn"]) >= f1(a["tp"], a["fp"], a["fn"]) - 1e-12
        return F.struct(*[F.when(good, after[c]).otherwise(a[c]).alias(c) for c in after], F.when(good, F.concat(a["kept"], F.array(x["label"]))).otherwise(a["kept"]).alias("kept"))

    kept = total.select(F.posexplode(F.aggregate("changes", start, step)["kept"]).alias("place", "label"))
    return cuts.join(F.broadcast(kept), "label").select(*cuts.columns, "place")


def residual_rules(rules: list[Rule], cuts: dict[str, tuple[float, float | None]], alias: str) -> list[Rule]:
    """rules and, for each label, a rule that adds absent cells of high probability and one that denies present cells of low probability.

    They read frozen tables only (static aliases <alias>__scope, __old_absent, __old_present and <alias>__complement), so they add no cycle.
    """
    out = list(rules)
    static = lambda name, label: ML("x", f"{alias}__{name}", label, 0.5, dynamic=False)
    for label, (pos, neg) in sorted(cuts.items()):
        out.append(Rule((Doc("x"), ML("x", alias, label, pos), static("old_absent", label), static("scope", label)), Label("x", label)))
        if neg is not None:
            if not 0 <= neg < pos:
                raise ValueError("the negative cut must be below the positive one")
            out.append(Rule((Doc("x"), ML("x", f"{alias}__complement", label, 1 - neg), static("old_present", label), static("scope", label)), Label("x", label, "neg")))
    return out


def auxiliary_tables(before: DataFrame, probs: DataFrame, scope: DataFrame, labels: DataFrame, alias: str) -> DataFrame:
    """The static model rows that residual_rules read: the probability itself, its complement, and frozen 0/1 tables of the cells that were there before."""
    p = probs.select(*CELL, F.col("p").cast("double").alias("p"))
    cells = scope.select("doc_id").distinct().crossJoin(F.broadcast(labels.select("label").distinct()))  # a bounded axis
    was = cells.join(before.select(*CELL).distinct().withColumn("w", F.lit(1.0)), CELL, "left").na.fill(0.0, ["w"])
    row = lambda df, name, value, static: df.select("doc_id", F.lit(alias + name).alias("alias"), "label", value.alias("p"), F.lit(static).alias("is_static"))
    out = row(p, "", F.col("p"), False).unionByName(row(p, "__complement", 1 - F.col("p"), False))
    out = out.unionByName(row(was, "__old_present", F.col("w"), True)).unionByName(row(was, "__old_absent", 1 - F.col("w"), True))
    return out.unionByName(row(cells, "__scope", F.lit(1.0), True))


def auxiliary_rules(rules: list[Rule], cuts: dict[str, float], alias: str, taken: dict[str, list[tuple[float, float]]] | None = None, gap: float = 0.0) -> list[Rule]:
    """rules and `P[alias] >= cut -> label` for each label; a cut that comes within `gap` of a label's denied band [low, high) is an error."""
    out = list(rules)
    for label, cut in sorted(cuts.items()):
        for _, high in (taken or {}).get(label, []):
            if cut < high + gap:
                raise ValueError(f"the cut {cut} of {label} runs into the band below {high}")
        out.append(Rule((Doc("x"), ML("x", alias, label, cut)), Label("x", label)))
    return out


def correction_cuts(scores: DataFrame, grid: list[float], precision: float = 0.9, support: int = 5, gain: int = 1) -> DataFrame:
    """label, cut, n, hits: the smallest cut whose cells (p >= cut) are `support` or more, with `precision`, and at least `gain` true ones. scores: label, p, target of cells absent so far."""
    cuts = F.array(*map(F.lit, sorted(grid)))
    e = scores.select("label", "p", "target", F.explode(cuts).alias("cut")).where(F.col("p") >= F.col("cut"))
    n = e.groupBy("label", "cut").agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("hits"))
    ok = n.where((F.col("n") >= support) & (F.col("hits") >= gain) & (F.col("hits") >= precision * F.col("n")))
    return ok.groupBy("label").agg(F.min_by(F.struct("cut", "n", "hits"), "cut").alias("b")).select("label", "b.*")


def denial_cuts(scores: DataFrame, grid: list[float], low: float = 0.5, precision: float = 0.9, support: int = 5, gain: int = 1) -> DataFrame:
    """context, label, cut, n, false: negative cuts within contexts of low precision.

    scores: context, label, p, target of cells that the program affirms, by a static context (a rule, a guard, a source). In a context whose cells of a label are
    right in less than `low` of the cases, the largest cut is taken below which (p <= cut) there are `support` cells or more, of which a share `precision`
    and at least `gain` more than are lost are false.
    """
    weak = scores.groupBy("context", "label").agg(F.avg(F.col("target").cast("double")).alias("q")).where(F.col("q") < low).select("context", "label")
    cuts = F.array(*map(F.lit, sorted(grid)))
    # A cell counts at the smallest cut that it reaches; sums over the grid come from these rows.
    reach = F.size(F.filter(cuts, lambda c: F.col("p").cast("double") > c))
    at = scores.join(weak, ["context", "label"], "left_semi").where(reach < len(grid)).groupBy("context", "label", reach.alias("k")).agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("target").cast("long")).alias("t"))
    upto = Window.partitionBy("context", "label").orderBy("k")
    run = at.withColumn("n", F.sum("m").over(upto)).withColumn("hits", F.sum("t").over(upto)).withColumn("next", F.coalesce(F.lead("k").over(upto), F.lit(len(grid))))
    # Up to the next cut at which a cell is added the sums stay; the largest such cut stands for all.
    run = run.withColumn("false", F.col("n") - F.col("hits")).withColumn("cut", F.get(cuts, F.col("next") - 1))
    ok = run.where((F.col("n") >= support) & (F.col("false") >= precision * F.col("n")) & (F.col("false") - F.col("hits") >= gain))
    return ok.groupBy("context", "label").agg(F.max_by(F.struct("cut", "n", "false"), "cut").alias("b")).select("context", "label", "b.*")


def joint_gate(before: dict, after: dict, fn_share: float = 0.0, completeness_loss: float = 0.0) -> bool:
    """Whether a change of model and output is taken: no macro, micro F1 or average precision of either falls, false negatives and
    completeness stay within their tolerances, and something rises. Keys: aux_macro, aux_micro, aux_ap, macro, micro, ap, fn, completeness."""
    eps = 1e-12
    keys = [k for k in ("aux_macro", "aux_micro", "aux_ap", "macro", "micro", "ap") if k in before]
    if any(after[k] < before[k] - eps for k in keys):
        return False
    if after["fn"] > before["fn"] * (1 + fn_share) + eps or after["completeness"] < before["completeness"] - completeness_loss - eps:
        return False
    return any(after[k] > before[k] + eps for k in keys)


@dataclass
class Round:
    number: int
    asked: int
    pending: int
    facts: int


@dataclass
class Loop:
    """status: all_documents_resolved, label_budget_exhausted, no_eligible_uncovered_documents, inner_round_cap_not_saturated or a closure's own; the last closure; gamma with all answers; a row a round."""

    status: str
    closure: Closure
    gamma: DataFrame
    rounds: list[Round]


def label_loop(cat: Catalog, rules: list[Rule], labels: DataFrame, probs: DataFrame, answer: Callable[[DataFrame], DataFrame], budget: int, batch: int | None = None,
               train: DataFrame | None = None, policy: str = "retain_protect", cut: float = 0.5, max_rounds: int = 20, retrain: Callable[[DataFrame, DataFrame], DataFrame] | None = None, weighting: str = "uniform") -> Loop:
    """Rounds of closure, review ranking, answers and closure again, until every document is resolved or the budget is spent.

    answer: documents (doc_id) -> their cells (doc_id, label, sign). Answers become validated facts. retrain: (batch of
    feedback cells, probs) -> new probabilities, applied after each round; a cell has the weight that review.weighted gives it (`weighting`: uniform or confidence). batch: documents
    a round, else 1 % of the documents that are pending at first, and 32 at least. Only counts reach the driver.
    """
    gamma, log, spent, initial = cat.gamma, [], 0, None
    rows = cat.docs if train is None else train
    cuts = labels.select("label", F.lit(cut).alias("cut"))
    while True:
        now = replace(cat, gamma=gamma, model_prob=probs)
        closure = close_program(now, rules, policy)
        if closure.status != "fixpoint":
            return Loop(closure.status, closure, gamma, log)
        open_ = written(review.pending(rows, closure.predictions(), closure.unknown, gamma.groupBy("doc_id").agg(F.count_distinct("label").alias("n")).where(F.col("n") == labels.count()).select("doc_id")), "pending")
        n = open_.count()
        initial = n if initial is None else initial
        log.append(Round(len(log), 0, n, closure.facts.count()))
        if not n:
            return Loop("all_documents_resolved", closure, gamma, log)
        if spent >= budget:
            return Loop("label_budget_exhausted", closure, gamma, log)
        if len(log) > max_rounds:
            return Loop("inner_round_cap_not_saturated", closure, gamma, log)
        unanswered = open_.join(gamma.select("doc_id").distinct(), "doc_id", "left_anti")
        axis = open_.crossJoin(F.broadcast(labels.select("label")))  # a bounded axis
        flag = lambda df, name: df.select(*CELL).distinct().withColumn(name, F.lit(True))
        cells = axis.join(flag(closure.predictions(), "pos"), CELL, "left").join(flag(closure.unknown, "unknown"), CELL, "left").join(flag(gamma, "trusted"), CELL, "left")
        cells = cells.join(probs.groupBy(*CELL).agg(F.avg(F.col("p").cast("double")).alias("p")), CELL, "left").na.fill(False, ["pos", "unknown", "trusted"]).na.fill(0.0, ["p"]).join(cuts, "label")
        cells = cells.withColumn("disagrees", F.col("pos") & (F.col("p") < F.col("cut")))
        size = review.batch_size(initial, n, budget - spent, batch)
        usual = label_cardinality(gamma, labels, rows).first()["cardinality"] or 1.0
        asked = written(review.rank_review(review.evidence_scores(open_, cells, usual), unanswered, size).select("doc_id"), "asked")
        k = asked.count()
        if not k:
            return Loop("no_eligible_uncovered_documents", closure, gamma, log)
        spent += k
        log[-1].asked = k
        gamma = written(gamma.select(*CELL, "sign").unionByName(answer(asked).select(*CELL, F.col("sign").cast("int").alias("sign"))).distinct(), "gamma")
        if retrain is not None:
            weak = review.weighted(review.weak_cells(closure.facts, probs, cuts, gamma, rows), weighting)
            probs = written(retrain(weak, probs), "probs")
