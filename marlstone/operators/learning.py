"""The loop that learns: closure, arbitration, fallback, refinement of the model by what the logic says, and questions.

One round: the program is closed; unknown cells are arbitrated by the models; cells that nothing decides are filled where the
model is sure; while the logic and the model disagree on training cells the model is trained on them again and the program
closed on its new probabilities, as long as the outcome on the calibration documents does not get worse; only then documents
are asked for, and what was answered may also correct what is left by residual rules under the same gate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import logit, sigmoid
from marlstone.operators import loop, metrics, review
from marlstone.operators.closure import Closure, close_program
from marlstone.operators.quality import label_cardinality
from marlstone.plans.compile import Catalog
from marlstone.plans.rules import Rule
from marlstone.plans.store import written

CELL = ["doc_id", "label"]
Trainer = Callable[[DataFrame, DataFrame], DataFrame]


def arbitrate_models(unknown: DataFrame, probs: DataFrame, aliases: tuple[str, ...], cuts: DataFrame) -> DataFrame:
    """doc_id, label, sign of every unknown cell: + where all models reach their cut (alias, label, cut), - where none does.

    A cell for which a model has no probability, or on which models differ, is an error: nothing is decided then.
    """
    cells = unknown.select(*CELL).distinct()
    votes = cells.join(probs.where(F.col("alias").isin(list(aliases))).join(F.broadcast(cuts), ["alias", "label"]), CELL, "left")  # a row a model and label
    yes = F.count_if(F.col("p").cast("double") >= F.col("cut"))
    per = written(votes.groupBy(*CELL).agg(F.count("p").alias("n"), yes.alias("yes")), "votes")
    bad = per.where((F.col("n") != len(aliases)) | ((F.col("yes") > 0) & (F.col("yes") < F.col("n")))).first()
    if bad:
        raise ValueError(f"cell {bad['doc_id']}, {bad['label']}: {bad['n']} of {len(aliases)} models, {bad['yes']} for it")
    return per.select(*CELL, F.when(F.col("yes") > 0, 1).otherwise(-1).alias("sign"))


def prior_shift(cells: DataFrame, probs: DataFrame) -> DataFrame:
    """A trainer: each label's log odds move by what its training cells (doc_id, label, target, weight) hold beyond what the model expects of them.

    The shift is log((1 + positives) / (1 + expected)) less the same of the negatives, in weighted cells; labels without cells stay.
    """
    x = cells.select(*CELL, "target", "weight").join(probs.select(*CELL, F.col("p").cast("double").alias("p")), CELL)
    y, w = F.col("target").cast("double"), F.col("weight")
    up = F.log((1 + F.sum(w * y)) / (1 + F.sum(w * F.col("p"))))
    down = F.log((1 + F.sum(w * (1 - y))) / (1 + F.sum(w * (1 - F.col("p")))))
    shift = x.groupBy("label").agg((up - down).alias("b_"))
    moved = probs.join(F.broadcast(shift), "label", "left")  # a row a label
    p = F.col("p").cast("double")
    inner = (p > 0) & (p < 1) & F.col("b_").isNotNull()
    return moved.withColumn("p", F.when(inner, sigmoid(logit(p) + F.col("b_"))).otherwise(p)).select(*probs.columns)


@dataclass
class Outcome:
    """What a round holds: the closure, arbitrated cells, filled cells, and the positive predictions of all three."""

    closure: Closure
    arbitrated: DataFrame
    filled: DataFrame
    predictions: DataFrame


@dataclass
class Event:
    """kind: start, refine, residual, ask; kept: whether the change was taken; n: training cells, residual labels or documents asked; macro: on the calibration documents."""

    kind: str
    kept: bool
    n: int
    pending: int
    macro: float


@dataclass
class Learned:
    """status: all_documents_resolved, label_budget_exhausted, no_eligible_uncovered_documents, inner_round_cap_not_saturated or a closure's own."""

    status: str
    outcome: Outcome
    gamma: DataFrame
    probs: DataFrame
    rules: list[Rule]
    events: list[Event] = field(default_factory=list)


@dataclass
class Settings:
    """cut: the models' decision; kappa: arbitration; sure: fallback; weighting: of weak cells (see review.weighted); replay: share of old answers in training."""

    cut: float = 0.5
    kappa: float = 0.5
    sure: float = 0.9
    weighting: str = "uniform"
    replay: float = 1.0
    policy: str = "retain_protect"
    batch: int | None = None
    most_refinements: int = 5
    calibrate_kappa: bool = False
    residual: bool = False
    grid: tuple[float, ...] = tuple(k / 20 for k in range(1, 20))


def learning_loop(cat: Catalog, rules: list[Rule], labels: DataFrame, probs: DataFrame, answer: Callable[[DataFrame], DataFrame], budget: int, calibration: DataFrame,
                  train: DataFrame | None = None, retrain: Trainer = prior_shift, how: Settings | None = None, most_rounds: int = 50) -> Learned:
    """Until every document is resolved or the budget is spent.

    probs: doc_id, alias, label, p, is_static of one model, which the rules read by its alias. calibration: signed cells (doc_id, label, sign) of documents that
    are not trained on and never asked; a change of the model or of the rules is kept if neither F1 on them falls and one rises, or,
    for the model, if it does no harm. answer: documents (doc_id) -> their signed cells. Only counts and scores reach the driver.
    """
    how = how or Settings()
    spark = cat.docs.sparkSession
    held = calibration.select("doc_id").distinct()
    rows = (cat.docs if train is None else train).select("doc_id").distinct().join(held, "doc_id", "left_anti")
    truth = calibration.where("sign > 0").select(*CELL)
    cuts = labels.select("label", F.lit(how.cut).alias("cut"))
    sure = labels.select("label", F.lit(how.sure).alias("cut"))
    kappas = labels.select("label", F.lit(how.kappa).alias("cut"))
    gamma, events, spent = cat.gamma.select(*CELL, F.col("sign").cast("int").alias("sign")), [], 0
    alias = probs.select("alias").first()["alias"]

    def resolve(program: list[Rule], model: DataFrame, known: DataFrame, extra: DataFrame | None = None) -> Outcome:
        table = model if extra is None else model.unionByName(extra)
        c = close_program(replace(cat, gamma=known, model_prob=table), program, how.policy)
        decided = review.arbitrate_cells(c.unknown, model, kappas)
        open_ = review.undecided(cat.docs, labels, c.facts, decided)
        filled = review.fallback(open_, model, sure)
        return Outcome(c, decided, filled, written(review.available(c.facts, decided, filled), "predictions"))

    def score(o: Outcome) -> dict[str, float]:
        mine = o.predictions.join(held, "doc_id", "left_semi")
        r = metrics.macro_micro(metrics.confusion(mine, truth, labels)).first()
        return {"macro": r["macro_f1"], "micro": r["micro_f1"]}

    def pending(o: Outcome) -> DataFrame:
        whole = gamma.groupBy("doc_id").agg(F.count_distinct("label").alias("n")).where(F.col("n") == n_labels).select("doc_id")
        left = o.closure.unknown.join(o.arbitrated, CELL, "left_anti")
        return written(review.pending(rows, o.predictions, left, whole), "pending")

    n_labels = labels.count()
    extra: DataFrame | None = None
    now = resolve(rules, probs, gamma)
    done = lambda status: Learned(status, now, gamma, probs, rules, events)
    if now.closure.status != "fixpoint":
        return done(now.closure.status)
    best, fresh, trained, initial = score(now), spark.createDataFrame([], "doc_id long"), None, None
    for _ in range(most_rounds):
        open_ = pending(now)
        n = open_.count()
        initial = n if initial is None else initial
        events.append(Event("start", True, 0, n, best["macro"]))
        if not n:
            return done("all_documents_resolved")
        for k in range(how.most_refinements + 1):
            # What is new to train on: weak cells whose target changed, all fresh answers, and a share of older ones.
            weak = review.weighted(review.weak_cells(now.closure.facts, probs, cuts, gamma, rows), how.weighting).select(*CELL, "target", "weight")
            before = trained if trained is not None else weak.where("false").select(*CELL, "target")
            cells = written(loop.incremental_batch(weak, before, gamma.join(held, "doc_id", "left_anti"), rows, fresh, how.replay), "cells")
            changed = cells.where("origin <> 'replay'").count()
            if not changed:
                break
            if k == how.most_refinements:
                return done("inner_round_cap_not_saturated")
            trained, fresh = written(weak.select(*CELL, "target"), "trained"), fresh.where("false")
            tried_probs = written(retrain(cells, probs), "probs")
            tried = resolve(rules, tried_probs, gamma, extra)
            s = score(tried) if tried.closure.status == "fixpoint" else None
            kept = s is not None and all(s[x] >= best[x] - 1e-12 for x in s)
            if kept:
                now, probs, best = tried, tried_probs, s
            events.append(Event("refine", kept, changed, n, best["macro"]))
            if not kept:
                break
        open_ = pending(now)
        n = open_.count()
        if not n:
            return done("all_documents_resolved")
        if spent >= budget:
            return done("label_budget_exhausted")
        unanswered = open_.join(gamma.select("doc_id").distinct(), "doc_id", "left_anti")
        size = review.batch_size(initial, n, budget - spent, how.batch)
        asked = written(review.rank_review(review.evidence_scores(open_, _cells(open_, labels, now, gamma, probs, cuts), _usual(gamma, labels, rows)), unanswered, size).select("doc_id"), "asked")
        k = asked.count()
        if not k:
            return done("no_eligible_uncovered_documents")
        spent += k
        said = answer(asked).select(*CELL, F.col("sign").cast("int").alias("sign"))
        gamma, fresh = written(gamma.unionByName(said).distinct(), "gamma"), asked
        if how.calibrate_kappa:
            known = gamma.join(probs.select(*CELL, F.col("p").cast("double").alias("p")), CELL).select("label", "p", (F.col("sign") > 0).cast("int").alias("target"), F.lit(1.0).alias("weight"))
            kappas = written(labels.join(metrics.kappa(known, list(how.grid), how.kappa), "label", "left").select("label", F.coalesce("cut", F.lit(how.kappa)).alias("cut")), "kappa")
        now = resolve(rules, probs, gamma, extra)
        if now.closure.status != "fixpoint":
            return done(now.closure.status)
        best = score(now)
        events.append(Event("ask", True, k, n, best["macro"]))
        if how.residual:
            grown = _residual(rules, now, probs, gamma, rows, labels, how, f"{alias}_residual")
            if grown is not None:
                program, table, size = grown
                tried = resolve(program, probs, gamma, table)
                s = score(tried) if tried.closure.status == "fixpoint" else None
                kept = s is not None and review.gate(best, s)
                if kept:
                    now, rules, extra, best = tried, program, table, s
                    how = replace(how, residual=False)  # its tables are frozen: once
                events.append(Event("residual", kept, size, n, best["macro"]))
    return done("inner_round_cap_not_saturated")


def _usual(gamma: DataFrame, labels: DataFrame, rows: DataFrame) -> float:
    return label_cardinality(gamma, labels, rows).first()["cardinality"] or 1.0


def _cells(open_: DataFrame, labels: DataFrame, now: Outcome, gamma: DataFrame, probs: DataFrame, cuts: DataFrame) -> DataFrame:
    """The cells of open documents as review.evidence_scores reads them."""
    axis = open_.crossJoin(F.broadcast(labels.select("label")))  # a bounded axis
    flag = lambda df, name: df.select(*CELL).distinct().withColumn(name, F.lit(True))
    cells = axis.join(flag(now.predictions, "pos"), CELL, "left").join(flag(now.closure.unknown, "unknown"), CELL, "left").join(flag(gamma, "trusted"), CELL, "left")
    cells = cells.join(probs.groupBy(*CELL).agg(F.avg(F.col("p").cast("double")).alias("p")), CELL, "left").na.fill(False, ["pos", "unknown", "trusted"]).na.fill(0.0, ["p"])
    return cells.join(F.broadcast(cuts), "label").withColumn("disagrees", F.col("pos") & (F.col("p") < F.col("cut")))


def _residual(rules: list[Rule], now: Outcome, probs: DataFrame, gamma: DataFrame, rows: DataFrame, labels: DataFrame, how: Settings, alias: str) -> tuple[list[Rule], DataFrame, int] | None:
    """Rules and tables that correct the predictions by cuts fitted on answered cells, or None if no cut helps."""
    p = probs.select(*CELL, F.col("p").cast("double").alias("p"))
    known = gamma.join(rows, "doc_id", "left_semi").join(p, CELL).select("doc_id", "label", "p", (F.col("sign") > 0).alias("target"))
    facts = now.closure.facts.where("sign > 0").join(gamma.select(*CELL), CELL, "left_anti")
    # What the program without the answers says of answered cells is not known; the model's decision stands for it.
    cells = written(known.join(F.broadcast(labels.select("label", F.lit(how.cut).alias("c_"))), "label").select("doc_id", "label", "p", (F.col("p") >= F.col("c_")).alias("old"), "target"), "residual")
    cuts = loop.residual_cuts(cells, list(how.grid), list(how.grid))
    kept = loop.joint_cuts(cells, cuts).collect()  # a row a label
    if not kept:
        return None
    scope = rows.join(gamma.select("doc_id").distinct(), "doc_id", "left_anti")
    table = loop.auxiliary_tables(facts, p, scope, labels, alias)
    program = loop.residual_rules(rules, {r["label"]: (r["pos_cut"], r["neg_cut"]) for r in kept}, alias)
    return program, written(table.select(*probs.columns), "residual_tables"), len(kept)
