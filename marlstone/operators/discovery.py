"""Rule discovery: scoring candidates in batches, ordered admission, pruning, Beta-Bernoulli proposals, clusters."""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators import batch
from marlstone.operators.closure import close_program
from marlstone.operators.metrics import confusion, f1, macro_micro
from marlstone.plans.compile import Catalog, fire
from marlstone.operators.session import rule_key
from marlstone.plans.rules import Label, LabelCompare, Rule, rule_from


def score_rules(cat: Catalog, rules: list[Rule], truth: DataFrame, labels: DataFrame) -> DataFrame:
    """rule_id, tp, fp, f1 of each rule's own conclusions, all rules in one job. For rules without label premises this is their closure."""
    out = None
    for i, r in enumerate(rules):
        if isinstance(r.head, Label) and r.head.sign > 0:
            one = fire(r, cat, cat.gamma.select("doc_id", "label", F.col("sign").cast("int").alias("sign"))).select(F.lit(i).alias("rule_id"), "doc_id", "label")
            out = one if out is None else out.unionByName(one)
    pos = truth.groupBy("label").agg(F.count_distinct("doc_id").alias("pos"))
    hit = out.join(truth.select("doc_id", "label").distinct().withColumn("t", F.lit(1)), ["doc_id", "label"], "left")
    n = hit.groupBy("rule_id", "label").agg(F.count("t").alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"))
    return n.join(labels.select("label"), "label", "left_semi").join(pos, "label", "left").na.fill(0, ["pos"]).select("rule_id", "label", "tp", "fp", f1(F.col("tp"), F.col("fp"), F.col("pos") - F.col("tp")).alias("f1"))


def program_score(cat: Catalog, rules: list[Rule], truth: DataFrame, labels: DataFrame, policy: str = "halt") -> dict[str, float] | None:
    """macro and micro F1 of a program's closure; None if it is not a fixpoint."""
    c = close_program(cat, rules, policy)
    if c.status != "fixpoint":
        return None
    r = macro_micro(confusion(c.predictions(), truth, labels)).first()
    return {"macro": r["macro_f1"], "micro": r["micro_f1"]}


def admit(cat: Catalog, candidates: list[Rule], scores: list[float], truth: DataFrame, labels: DataFrame, epsilon: float = 0.0, policy: str = "halt", size: int = 32) -> list[int]:
    """Candidates by score (ties by number); one is taken if the closure with it is a fixpoint and macro F1 rises by more than epsilon.

    Closed in batches (see operators.batch); one by one under policies, or with rules, that batches do not know.
    """
    order = sorted(range(len(candidates)), key=lambda k: (-scores[k], k))
    if policy in ("halt", "protect") and cat.relations is None and not any(isinstance(a, LabelCompare) for r in candidates for a in (*r.body, r.head)):
        return batch.admit(cat, candidates, order, truth, labels, epsilon=epsilon, policy=policy, size=size).taken
    taken: list[int] = []
    best = (program_score(cat, [], truth, labels, policy) or {"macro": 0.0})["macro"]
    for i in order:
        s = program_score(cat, [candidates[k] for k in (*taken, i)], truth, labels, policy)
        if s and s["macro"] > best + epsilon:
            taken.append(i)
            best = s["macro"]
    return taken


def refilter(cat: Catalog, pool: DataFrame, truth: DataFrame, labels: DataFrame, floor: float = 0.0, policy: str = "halt", size: int = 32) -> tuple[list[Rule], DataFrame]:
    """Admit a stored pool of tried rules anew. pool: rule (JSON), score, trial. Returns the admitted rules, in order, and a report: trial, rule_key, score, reason.

    Of a rule that was tried several times the best score counts, then the first trial. Rules are taken by score if macro F1 rises by more than `floor`.
    reason: admitted, no_gain, repeated, or unreadable for JSON that is no rule.
    """
    rows, first, why = pool.orderBy(F.desc("score"), "trial").collect(), {}, []  # trials of a search, a bounded number
    for r in rows:
        try:
            rule = rule_from(json.loads(r["rule"]))
        except (ValueError, KeyError, TypeError):
            why.append((r["trial"], None, r["score"], "unreadable"))
            continue
        key = rule_key(rule)
        if key in first:
            why.append((r["trial"], key, r["score"], "repeated"))
        else:
            first[key] = (rule, r["score"], r["trial"])
    rules = [r for r, *_ in first.values()]
    taken = admit(cat, rules, [s for _, s, _ in first.values()], truth, labels, floor, policy, size)
    why += [(t, k, s, "admitted" if i in taken else "no_gain") for i, (k, (_, s, t)) in enumerate(first.items())]
    return [rules[i] for i in taken], pool.sparkSession.createDataFrame(why, "trial long, rule_key string, score double, reason string")


def prune(cat: Catalog, rules: list[Rule], truth: DataFrame, labels: DataFrame, policy: str = "halt") -> list[Rule]:
    """Drop rules, last first, as long as neither F1 falls."""
    kept = list(rules)
    now = program_score(cat, kept, truth, labels, policy)
    for r in list(reversed(rules)):
        less = [x for x in kept if x is not r]
        s = program_score(cat, less, truth, labels, policy)
        if s and now and s["macro"] >= now["macro"] and s["micro"] >= now["micro"]:
            kept, now = less, s
    return kept


def effective(cat: Catalog, rules: list[Rule], families: dict[str, list[int]], policy: str = "halt") -> dict[str, int]:
    """Facts lost when a family of rules is left out and the closure is computed again."""
    whole = close_program(cat, rules, policy).facts
    out = {}
    for name, ids in families.items():
        less = close_program(cat, [r for i, r in enumerate(rules) if i not in ids], policy).facts
        out[name] = whole.select("doc_id", "label", "sign").exceptAll(less.select("doc_id", "label", "sign")).count()
    return out


def propose(history: list[tuple[tuple[int, ...], float]], size: int, samples: int = 64, good_share: float = 0.25, startup: int = 12, seed: int = 0) -> tuple[int, ...]:
    """The next include-vector: Beta-Bernoulli densities of the best share and the rest, best log ratio of `samples` draws."""
    rnd = random.Random(seed * 1_000_003 + len(history))
    if len(history) < startup:
        return tuple(rnd.randint(0, 1) for _ in range(size))
    ranked = sorted(history, key=lambda h: -h[1])
    k = max(1, math.ceil(good_share * len(ranked)))
    density = lambda rows: [(1 + sum(r[0][j] for r in rows)) / (2 + len(rows)) for j in range(size)]
    good, rest = density(ranked[:k]), density(ranked[k:] or ranked)
    draws = [tuple(int(rnd.random() < g) for g in good) for _ in range(samples)]
    ratio = lambda v: sum(math.log(g / r) if b else math.log((1 - g) / (1 - r)) for b, g, r in zip(v, good, rest, strict=True))
    return max(draws, key=lambda v: (ratio(v), v))


def choose(programs: list[dict], base: dict, macro_tolerance: float = 0.0, micro_tolerance: float = 0.002, first: str = "diversity") -> dict:
    """Of programs whose macro and micro F1 are not below the base's by more than their tolerances, the best.

    first: diversity (number of families with facts of their own) before macro F1, or macro before diversity; micro F1 and fewer rules follow.
    """
    if first not in ("diversity", "macro"):
        raise ValueError(f"unknown order {first}")
    near = 1e-12
    ok = [p for p in programs if p["macro"] >= base["macro"] - macro_tolerance - near and p["micro"] >= base["micro"] - micro_tolerance - near] or [base]
    wide = lambda p: (p.get("diversity", 0), p["macro"], p["micro"])
    deep = lambda p: (p["macro"], p["micro"], p.get("diversity", 0))
    return max(ok, key=lambda p: (*(wide if first == "diversity" else deep)(p), -p.get("rules", 0)))


def allocate(f1s: dict[str, float], supports: dict[str, int], budget: int, least: int = 8) -> dict[str, int]:
    """Trials a label: `least` each; of the others six tenths by what its F1 leaves to gain plus .1, four by the root of its training
    documents and one. Largest remainders first, then the order of the labels."""
    names = list(f1s)
    free = budget - least * len(names)
    if free < 0:
        raise ValueError("the budget is too small")
    need, root = {n: 0.1 + 1 - f1s[n] for n in names}, {n: math.sqrt(supports[n] + 1) for n in names}
    share = {n: free * (0.6 * need[n] / sum(need.values()) + 0.4 * root[n] / sum(root.values())) for n in names}
    out = {n: least + math.floor(share[n]) for n in names}
    for n in sorted(names, key=lambda n: -(share[n] - math.floor(share[n])))[: budget - sum(out.values())]:
        out[n] += 1
    return out


def clusters(vectors: DataFrame, id_col: str, vec_col: str, k: int, fit: DataFrame | None = None, seed: int = 1) -> DataFrame:
    """id, cluster: k-means fitted on the fit rows, predicted for all."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = vectors.select(F.col(id_col), array_to_vector(F.transform(vec_col, lambda x: x.cast("double"))).alias("features"))
    part = v if fit is None else v.join(fit.select(id_col), id_col, "left_semi")
    return KMeans(k=k, seed=seed, maxIter=20).fit(part).transform(v).select(id_col, F.col("prediction").alias("cluster"))


def linear_classifier(train: DataFrame, apply_to: DataFrame, text_col: str = "text", label_col: str = "y", dim: int = 1 << 16) -> DataFrame:
    """doc_id, p: TF-IDF and logistic regression; constant labels give their constant."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, Tokenizer
    from pyspark.ml.functions import vector_to_array

    r = train.agg(F.min(label_col).alias("a"), F.max(label_col).alias("b")).first()
    if r["a"] == r["b"]:
        return apply_to.select("doc_id", F.lit(float(r["a"] or 0)).alias("p"))
    steps = [Tokenizer(inputCol=text_col, outputCol="tok"), HashingTF(inputCol="tok", outputCol="tf", numFeatures=dim), IDF(inputCol="tf", outputCol="x"), LogisticRegression(featuresCol="x", labelCol=label_col, regParam=0.1, maxIter=30)]
    return Pipeline(stages=steps).fit(train).transform(apply_to).select("doc_id", vector_to_array("probability")[1].alias("p"))
