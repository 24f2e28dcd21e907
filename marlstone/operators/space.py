"""The configuration space of rules, the fit witnesses that say where good ones lie, and starts drawn from them.

A configuration names a head and which parts its body has: model cuts, text guards, labels and copies along attributes. It is
plain data; instantiate() turns it into a rule or says what is wrong with it. Witnesses are counted by one grouped
job for all models, labels, cuts and guards.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import predicate
from marlstone.operators.metrics import f1
from marlstone.plans.compile import Catalog, _there, column
from marlstone.plans.rules import ML, OPS, AttrEqual, Doc, Label, Predicate, Rule, Text, form_errors


class InvalidConfiguration(ValueError):
    """A configuration that is no rule; a search counts it as a trial without a score."""


@dataclass(frozen=True)
class Space:
    """labels: heads and label premises. models: (alias, label of the probability). guards: named predicates. attributes: to copy along. cuts: model thresholds."""

    labels: tuple[str, ...]
    models: tuple[tuple[str, str], ...] = ()
    guards: dict[str, Predicate] = field(default_factory=dict)
    attributes: tuple[str, ...] = ()
    cuts: tuple[float, ...] = tuple(k / 20 for k in range(1, 20))
    signs: tuple[str, ...] = ("pos",)

    def size(self) -> int:
        """How many bodies there are for one head: each model with a cut or not, each guard with or without, each label premise here, at a copy or not."""
        here = (len(self.cuts) + 1) ** len(self.models) * 2 ** len(self.guards)
        return here * (1 + len(self.labels) * (1 + len(self.attributes)))

    def instantiate(self, config: dict) -> Rule:
        """head: label; sign: pos or neg; cuts: {(alias, label): cut}; guards: {name: {op, eta} of a count, or {}}; premise: label; copy: attribute along which the premise's document is found."""
        unknown = set(config) - {"head", "sign", "cuts", "guards", "premise", "copy"}
        if unknown or config.get("head") not in self.labels or config.get("sign", "pos") not in self.signs:
            raise InvalidConfiguration(f"unknown parts {sorted(unknown)} or head {config.get('head')} {config.get('sign', 'pos')}")
        body: list = [Doc("x")]
        for model, cut in config.get("cuts", {}).items():
            if model not in self.models or not 0 <= cut <= 1:
                raise InvalidConfiguration(f"no cut {cut} of {model}")
            body.append(ML("x", *model, eta=float(cut)))
        for name, how in config.get("guards", {}).items():
            if name not in self.guards:
                raise InvalidConfiguration(f"no guard {name}")
            p = self.guards[name]
            if how and (p.type != "freq" or how.get("op", p.op) not in OPS or how.get("eta", 1) < 0):
                raise InvalidConfiguration(f"guard {name} does not take {how}")
            body.append(Text("x", replace(p, **how) if how else p))
        premise, copy = config.get("premise"), config.get("copy")
        if (copy is not None and (premise is None or copy not in self.attributes)) or (premise is not None and premise not in self.labels):
            raise InvalidConfiguration(f"no premise {premise} along {copy}")
        if premise is not None and copy is None:
            if premise == config["head"]:
                raise InvalidConfiguration("a label does not conclude itself")
            body.append(Label("x", premise))
        elif copy is not None:
            body += [Doc("y"), AttrEqual("x", copy, "y", copy), Label("y", premise)]
        if len(body) == 1:
            raise InvalidConfiguration("an empty body")
        rule = Rule(tuple(body), Label("x", config["head"], config.get("sign", "pos")))
        wrong = [e for e in form_errors(rule) if "ML atom" not in e]  # a model alone is a rule of its own here
        if wrong:
            raise InvalidConfiguration("; ".join(wrong))
        return rule


def witnesses(cat: Catalog, space: Space, truth: DataFrame, fit: DataFrame) -> DataFrame:
    """head, alias, label, cut, guard (null: none), support, tp, pos, precision, f1: what each model and cut says for each head over the fit
    documents (doc_id), with each guard and without.

    One pass over the texts marks the guards, one join brings the probabilities; a cell counts at the largest cut that it
    reaches, and running sums from above give all cuts. Cuts that nothing reaches have no row.
    """
    fit = fit.select("doc_id").distinct()
    marks = F.array(F.lit(None).cast("string"), *[F.when(predicate(p, F.col(column(p.attr)), _there(cat.docs, p.attr)) & _there(cat.docs, p.attr), F.lit(name)) for name, p in space.guards.items()])
    named = F.filter(marks, lambda g: g.isNotNull())
    docs = cat.docs.join(fit, "doc_id", "left_semi").select("doc_id", F.concat(F.array(F.lit(None).cast("string")), named).alias("guards"))
    asked = cat.docs.sparkSession.createDataFrame(list(space.models), "alias string, label string")
    cuts = F.array(*[F.lit(c) for c in sorted(space.cuts)])
    p = cat.model_prob.where("not is_static").join(F.broadcast(asked), ["alias", "label"]).select("doc_id", "alias", "label", F.size(F.filter(cuts, lambda c: F.col("p").cast("double") >= c)).alias("reach")).where("reach > 0")
    heads = truth.join(fit, "doc_id", "left_semi").where(F.col("label").isin(list(space.labels))).groupBy("doc_id").agg(F.collect_set("label").alias("heads"))
    rows = p.join(docs, "doc_id").join(heads, "doc_id", "left").select("alias", "label", "reach", F.explode("guards").alias("guard"), F.coalesce("heads", F.array().cast("array<string>")).alias("heads"))
    each = rows.select("alias", "label", "reach", "guard", "heads", F.explode(F.array(*[F.lit(x) for x in space.labels])).alias("head"))
    n = each.groupBy("head", "alias", "label", "guard", "reach").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.array_contains("heads", F.col("head"))).alias("t"))
    n = n.select("head", "alias", "label", "guard", F.explode(F.sequence(F.lit(1), F.col("reach"))).alias("k"), "n", "t").groupBy("head", "alias", "label", "guard", "k").agg(F.sum("n").alias("support"), F.sum("t").alias("tp"))
    pos = truth.join(fit, "doc_id", "left_semi").select("doc_id", F.col("label").alias("head")).distinct().groupBy("head").agg(F.count(F.lit(1)).alias("pos"))
    out = n.join(F.broadcast(pos), "head", "left").na.fill(0, ["pos"]).withColumn("cut", F.get(cuts, F.col("k") - 1))  # a row a label
    score = f1(F.col("tp"), F.col("support") - F.col("tp"), F.col("pos") - F.col("tp"))
    return out.select("head", "alias", "label", "cut", "guard", "support", "tp", "pos", (F.col("tp") / F.col("support")).alias("precision"), score.alias("f1"))


def starts(found: DataFrame, count: int = 30, least: int = 1) -> DataFrame:
    """place, head, alias, label, guard, cut, f1: the best cut of each head, model and guard with `least` true documents; then the heads in turn, each with
    its next best. Ties: precision, larger cut, names; a guard comes before none at a tie only by precision."""
    best = Window.partitionBy("head", "alias", "label", "guard").orderBy(F.desc(F.round("f1", 12)), F.desc(F.round("precision", 12)), F.desc("cut"))
    one = found.where(F.col("tp") >= least).withColumn("r", F.row_number().over(best)).where("r = 1")
    order = (F.desc(F.round("f1", 12)), F.desc(F.round("precision", 12)), F.col("alias"), F.col("label"), F.col("guard").asc_nulls_first())
    turn = F.row_number().over(Window.partitionBy("head").orderBy(*order))
    rows = one.withColumn("turn", turn).orderBy("turn", "head").limit(count)  # `count` rows from here on
    return rows.withColumn("place", F.row_number().over(Window.orderBy("turn", "head"))).select("place", "head", "alias", "label", "guard", "cut", "f1")


def start_rules(space: Space, rows: DataFrame) -> list[Rule]:
    """The rules of starts()."""
    out = []
    for r in rows.orderBy("place").collect():  # `count` rows
        out.append(space.instantiate({"head": r["head"], "cuts": {(r["alias"], r["label"]): r["cut"]}, "guards": {r["guard"]: {}} if r["guard"] is not None else {}}))
    return out
