"""Programs of one-document text rules, evaluated without a closure: bitmaps of the rules' documents, combined by program.

No rule reads what another concludes, so the closure of such a program is the union of its roots and heads: ors of
bitmaps. A conflict is an and of both signs of a label, and corrected predictions are (baseline and not denied) or affirmed.
Thousands of programs cost one job over the bitmaps of their rules, each of which is made once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.batch import fire_unary
from marlstone.operators.bitmaps import both, either, pack, size, without
from marlstone.operators.metrics import f1
from marlstone.plans.compile import Catalog
from marlstone.plans.rules import Doc, Label, Rule, Text
from marlstone.plans.store import written


def analytic(rule: Rule) -> bool:
    """Whether the rule is one that this module evaluates: Doc and Text atoms of one variable, and a signed label."""
    return isinstance(rule.head, Label) and len(rule.bound) == 1 and all(isinstance(a, Doc | Text) for a in rule.body)


def rule_bits(cat: Catalog, rules: list[Rule]) -> DataFrame:
    """rule, label, sign, block, bits of all rules: one scan of the documents evaluates every text."""
    if not all(analytic(r) for r in rules):
        raise ValueError("only rules of texts of one document are evaluated without a closure")
    texts = {i: r for i, r in enumerate(rules) if any(isinstance(a, Text) for a in r.body)}
    spark = cat.docs.sparkSession
    out = fire_unary(cat, texts, cat.gamma).select(F.col("run").alias("rule"), "doc_id", "label", "sign") if texts else spark.createDataFrame([], "rule int, doc_id long, label string, sign int")
    whole = [(i, r.head.label, r.head.sign) for i, r in enumerate(rules) if i not in texts]
    if whole:  # a rule without a text holds everywhere
        out = out.unionByName(cat.docs.select("doc_id").distinct().crossJoin(F.broadcast(spark.createDataFrame(whole, "rule int, label string, sign int"))).select(*out.columns))  # a row a rule
    return written(pack(out, "rule", "label", "sign"), "rule_bits")


def evaluate(bits: DataFrame, programs: DataFrame, gamma: DataFrame, truth: DataFrame, labels: DataFrame, docs: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """program, status, macro_f1, micro_f1, facts, conflicts of each program.

    bits: rule_bits(); programs: program, rule (a program without rules has a null rule); gamma: signed roots; truth: doc_id, label; docs: the
    documents that are scored; baseline: predictions that the facts correct, none if not given. Scores are null for a conflict.
    """
    cell = ["label", "block"]
    side = lambda s, name: pack(gamma.where(F.col("sign") == s).select("doc_id", "label"), "label").withColumnRenamed("bits", name)
    fixed = side(1, "gp").join(side(-1, "gn"), cell, "full")
    packed = lambda df, name: pack(df.join(labels.select("label"), "label", "left_semi").select("doc_id", "label"), "label").withColumnRenamed("bits", name)
    fixed = fixed.join(packed(truth, "t"), cell, "full")
    fixed = fixed.join(packed(baseline, "b"), cell, "full") if baseline is not None else fixed.withColumn("b", F.lit(None).cast("long"))
    made = programs.where("rule is not null").distinct().join(bits, "rule").groupBy("program", *cell).agg(
        F.bit_or(F.when(F.col("sign") > 0, F.col("bits"))).alias("p"), F.bit_or(F.when(F.col("sign") < 0, F.col("bits"))).alias("n"))
    scored = pack(docs.select("doc_id")).withColumnRenamed("bits", "d")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    fixed = written(fixed.select(*cell, *[zero(F.col(c)).alias(c) for c in ("gp", "gn", "t", "b")]), "fixed")

    def counts(rows: DataFrame, *by: str) -> DataFrame:
        """Of rows with p, n, gp, gn, t, b and d: what the cells of a label count."""
        rows = rows.withColumn("pos", either(F.col("p"), F.col("gp"))).withColumn("neg", either(F.col("n"), F.col("gn")))
        rows = rows.withColumn("y", both(either(without(F.col("b"), F.col("neg")), F.col("pos")), F.col("d"))).withColumn("t", both(F.col("t"), F.col("d")))
        return rows.groupBy(*by, "label").agg(F.sum(size(both(F.col("y"), F.col("t")))).alias("tp"), F.sum(size(without(F.col("y"), F.col("t")))).alias("fp"), F.sum(size(without(F.col("t"), F.col("y")))).alias("fn"),
                                              F.sum(size(F.col("pos")) + size(F.col("neg"))).alias("facts"), F.sum(size(both(F.col("pos"), F.col("neg")))).alias("conflicts"))

    # A program changes the counts of the roots alone only in its own blocks: what those give with it, less what they give without.
    none = F.lit(0).cast("long")
    base = written(counts(fixed.join(scored, "block", "left").withColumns({"d": zero(F.col("d")), "p": none, "n": none})), "base")
    touched = made.join(fixed, cell, "left").join(scored, "block", "left").select("program", *cell, *[zero(F.col(c)).alias(c) for c in ("p", "n", "gp", "gn", "t", "b", "d")])
    touched = written(touched, "touched")
    with_it, less = counts(touched, "program"), counts(touched.withColumns({"p": none, "n": none}), "program")
    names = ("tp", "fp", "fn", "facts", "conflicts")
    change = with_it.join(less.select("program", "label", *[F.col(c).alias(f"_{c}") for c in names]), ["program", "label"]).select("program", "label", *[(F.col(c) - F.col(f"_{c}")).alias(f"d_{c}") for c in names])
    axis = labels.select("label").distinct().join(base, "label", "left").na.fill(0)
    # Facts and conflicts of labels that are not scored count too.
    off = change.join(labels, "label", "left_anti").groupBy("program").agg(F.sum("d_facts").alias("o_facts"), F.sum("d_conflicts").alias("o_conflicts"))
    rest = base.join(labels, "label", "left_anti").agg(F.coalesce(F.sum("facts"), F.lit(0)).alias("r_facts"), F.coalesce(F.sum("conflicts"), F.lit(0)).alias("r_conflicts"))
    grid = programs.select("program").distinct().crossJoin(F.broadcast(axis)).join(change, ["program", "label"], "left").na.fill(0)  # labels
    at = {c: F.col(c) + F.col(f"d_{c}") for c in names}
    out = grid.groupBy("program").agg(F.avg(f1(at["tp"], at["fp"], at["fn"])).alias("macro"), f1(F.sum(at["tp"]), F.sum(at["fp"]), F.sum(at["fn"])).alias("micro"), F.sum(at["facts"]).alias("facts"), F.sum(at["conflicts"]).alias("conflicts"))
    out = out.join(off, "program", "left").na.fill(0, ["o_facts", "o_conflicts"]).crossJoin(F.broadcast(rest))  # one row
    conflicts = F.col("conflicts") + F.col("o_conflicts") + F.col("r_conflicts")
    fine = conflicts == 0
    return out.select("program", F.when(fine, "fixpoint").otherwise("conflict").alias("status"), F.when(fine, F.col("macro")).alias("macro_f1"), F.when(fine, F.col("micro")).alias("micro_f1"),
                      (F.col("facts") + F.col("o_facts") + F.col("r_facts")).alias("facts"), conflicts.alias("conflicts"))


def grow(bits: DataFrame, count: int, gamma: DataFrame, truth: DataFrame, labels: DataFrame, docs: DataFrame, baseline: DataFrame | None = None, most: int = 10, epsilon: float = 1e-12) -> list[tuple[int, float]]:
    """(rule, macro F1 with it): rules 0 to count - 1 taken greedily by macro F1, ties by number; each step tries all of them in one job."""
    spark, taken = bits.sparkSession, []
    score = evaluate(bits, spark.createDataFrame([(0, None)], "program int, rule int"), gamma, truth, labels, docs, baseline).first()
    now = score["macro_f1"]
    if now is None:
        raise ValueError("the roots are in conflict")
    while len(taken) < most:
        tried = [(i, r) for i in range(count) if i not in [t for t, _ in taken] for r in (*[t for t, _ in taken], i)]
        if not tried:
            break
        best = evaluate(bits, spark.createDataFrame(tried, "program int, rule int"), gamma, truth, labels, docs, baseline).where("status = 'fixpoint'").orderBy(F.desc(F.round("macro_f1", 12)), "program").first()
        if best is None or best["macro_f1"] <= now + epsilon:
            break
        now = best["macro_f1"]
        taken.append((best["program"], now))
    return taken
