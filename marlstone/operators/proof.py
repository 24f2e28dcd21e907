"""Why a fact holds: one derivation of each fact with its premises, and certificates of conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.closure import CELL, Closure
from marlstone.plans.compile import Catalog, column, fire
from marlstone.plans.rules import AttrEqual, Label, LabelCompare, Rule
from marlstone.plans.store import written

FACT = [*CELL, "sign"]
PREMISES = "array<struct<doc_id:bigint,label:string,sign:int>>"


def witnesses(rule: Rule, cat: Catalog, facts: DataFrame) -> DataFrame:
    """doc_id, label, sign, depth, premises of the rule's conclusions: of all valuations the one whose latest premise is earliest.

    facts: doc_id, label, sign, round (0 for roots). The body's variables are linked by attributes as a tree. A variable
    beside the head's is reduced to one best witness a key, so a group of equal attributes makes no pairs.
    """
    if any(isinstance(a, LabelCompare) for a in (*rule.body, rule.head)):
        raise ValueError("premises of rules over label-set relations are not traced")
    head = rule.head.var
    links = [a for a in rule.body if isinstance(a, AttrEqual) and a.left_var != a.right_var]
    # Text, model and one-variable conditions as fire() applies them: each variable's documents without its label premises.
    frames = {}
    for v in rule.bound:
        own = Rule(tuple(a for a in rule.body if not isinstance(a, Label) and {*_vars(a)} == {v}), Label(v, rule.head.label))
        df = fire(own, cat, facts).select("doc_id").join(cat.docs, "doc_id")
        keys = sorted({column(x) for a in links for w, x in ((a.left_var, a.left_attr), (a.right_var, a.right_attr)) if w == v})
        for k in keys:
            df = df.where(F.col(k).isNotNull() & (F.col(k) != ""))
        df = df.select("doc_id", *keys).withColumns({"depth": F.lit(0), "premises": F.array().cast(PREMISES)})
        for n, a in enumerate(a for a in rule.body if isinstance(a, Label) and a.var == v):
            held = facts.where((F.col("label") == a.label) & (F.col("sign") == a.sign)).select("doc_id", F.col("round").alias(f"r{n}"))
            one = F.array(F.struct("doc_id", F.lit(a.label).alias("label"), F.lit(a.sign).alias("sign")))
            df = df.join(held, "doc_id").withColumns({"depth": F.greatest("depth", f"r{n}"), "premises": F.concat("premises", one)}).drop(f"r{n}")
        frames[v] = df
    live = set(rule.bound)
    while len(live) > 1:
        near = {v: {w for a in links for w in _vars(a) if v in _vars(a) and w != v and w in live} for v in live}
        leaf = next((v for v in sorted(live - {head}) if len(near[v]) <= 1), None)
        if leaf is None:
            raise ValueError("the body's links are not a tree")
        live.discard(leaf)
        best = F.min(F.struct("depth", "premises")).alias("best")
        if not near[leaf]:  # only has to exist
            u, on, key = head, [], []
            reduced = frames[leaf].agg(best).where("best is not null")
            joined = frames[u].crossJoin(F.broadcast(reduced))  # one row
        else:
            u = near[leaf].pop()
            pairs = [(column(a.left_attr), column(a.right_attr)) if a.left_var == leaf else (column(a.right_attr), column(a.left_attr)) for a in links if {*_vars(a)} == {leaf, u}]
            key = [f"key{i}" for i in range(len(pairs))]
            reduced = frames[leaf].select(*[F.col(p).alias(k) for k, (p, _) in zip(key, pairs, strict=True)], "depth", "premises").groupBy(*key).agg(best)
            on = [F.col(q) == F.col(k) for k, (_, q) in zip(key, pairs, strict=True)]
            joined = frames[u].join(reduced, on)
        frames[u] = joined.withColumns({"depth": F.greatest("depth", "best.depth"), "premises": F.concat("premises", "best.premises")}).drop("best", *key)
    out = frames[head].groupBy("doc_id").agg(F.min(F.struct("depth", "premises")).alias("b"))
    return out.select("doc_id", F.lit(rule.head.label).alias("label"), F.lit(rule.head.sign).alias("sign"), "b.depth", "b.premises")


def _vars(a) -> tuple[str, ...]:
    return (a.left_var, a.right_var) if isinstance(a, AttrEqual | LabelCompare) else (a.var,)


def proof_rows(cat: Catalog, rules: list[Rule], closure: Closure) -> DataFrame:
    """doc_id, label, sign, rule_id, round, premises: one derivation of every fact; rule_id -1, round 0 and no premises for roots.

    All premises of a row are of earlier rounds, so proofs end in roots.
    """
    fired = closure.firings.select(*FACT, "rule_id", "round")
    roots = cat.gamma.select(*CELL, F.col("sign").cast("int").alias("sign")).distinct()
    base = roots.withColumns({"rule_id": F.lit(-1), "round": F.lit(0), "premises": F.array().cast(PREMISES)})
    timed = written(roots.withColumn("round", F.lit(0)).unionByName(fired.drop("rule_id").join(roots, FACT, "left_anti")), "timed")
    parts = [base]
    for i in sorted({r["rule_id"] for r in fired.select("rule_id").distinct().collect()} - {-1}):  # the program's rules at most
        why = witnesses(rules[i], cat, timed)
        parts.append(fired.where(F.col("rule_id") == i).join(why, FACT).where(F.col("depth") < F.col("round")).select(*FACT, "rule_id", "round", "premises"))
    return reduce(DataFrame.unionByName, parts)


def certificate(proof: DataFrame, cells: DataFrame, max_depth: int = 100) -> DataFrame:
    """The rows of proof that the facts of the cells (doc_id, label), of either sign, rest on."""
    now = written(proof.join(cells.select(*CELL).distinct(), CELL, "left_semi"), "certificate")
    front = now
    for _ in range(max_depth):
        need = front.select(F.explode("premises").alias("p")).select("p.*").distinct()
        front = written(proof.join(need, FACT, "left_semi").join(now.select(*FACT), FACT, "left_anti"), "front")
        if front.isEmpty():
            return now
        now = written(now.unionByName(front), "certificate")
    raise RuntimeError(f"the proof is deeper than {max_depth}")


def holds(proof: DataFrame, facts: DataFrame) -> DataFrame:
    """proof with valid: whether all premises of the row are among the facts (a recorded derivation that is still good)."""
    p = proof.withColumn("row", F.xxhash64(*FACT, "rule_id"))
    broken = p.select("row", F.explode("premises").alias("p")).select("row", "p.*").join(facts.select(*FACT).distinct(), FACT, "left_anti").select("row").distinct().withColumn("broken", F.lit(True))
    return p.join(broken, "row", "left").withColumn("valid", F.col("broken").isNull()).drop("row", "broken")


def support_counts(cat: Catalog, rules: list[Rule], facts: DataFrame) -> DataFrame:
    """doc_id, label, sign, rule_id, ways: of each fact all that supports it, a row a rule, ways being its valuations over the facts; roots have rule_id -1 and 1.

    facts: a fixpoint's (doc_id, label, sign). Valuations are counted, not listed: a variable beside the head's is reduced to its
    number of valuations a key, so a group of equal attributes makes no pairs. The bodies are those that witnesses() traces.
    """
    roots = cat.gamma.select(*CELL, F.col("sign").cast("int").alias("sign")).distinct()
    parts = [roots.join(facts.select(*FACT), FACT, "left_semi").select(*FACT, F.lit(-1).alias("rule_id"), F.lit(1).cast("decimal(38,0)").alias("ways"))]
    for i, rule in enumerate(rules):
        if any(isinstance(a, LabelCompare) for a in (*rule.body, rule.head)):
            raise ValueError("premises of rules over label-set relations are not traced")
        links = [a for a in rule.body if isinstance(a, AttrEqual) and a.left_var != a.right_var]
        frames = {}
        for v in rule.bound:
            own = Rule(tuple(a for a in rule.body if {*_vars(a)} == {v}), Label(v, rule.head.label))
            keys = sorted({column(x) for a in links for w, x in ((a.left_var, a.left_attr), (a.right_var, a.right_attr)) if w == v})
            df = fire(own, cat, facts).select("doc_id").join(cat.docs.select("doc_id", *keys), "doc_id")
            for k in keys:
                df = df.where(F.col(k).isNotNull() & (F.col(k) != ""))
            frames[v] = df.withColumn("ways", F.lit(1).cast("decimal(38,0)"))
        live, head = set(rule.bound), rule.head.var
        while len(live) > 1:
            near = {v: {w for a in links for w in _vars(a) if v in _vars(a) and w != v and w in live} for v in live}
            leaf = next((v for v in sorted(live - {head}) if len(near[v]) <= 1), None)
            if leaf is None:
                raise ValueError("the body's links are not a tree")
            live.discard(leaf)
            total = F.sum("ways").cast("decimal(38,0)").alias("more")
            if near[leaf]:
                u = near[leaf].pop()
                pairs = [(column(a.left_attr), column(a.right_attr)) if a.left_var == leaf else (column(a.right_attr), column(a.left_attr)) for a in links if {*_vars(a)} == {leaf, u}]
                reduced = frames[leaf].groupBy(*[F.col(p).alias(f"key{k}") for k, (p, _) in enumerate(pairs)]).agg(total)
                joined = frames[u].join(reduced, [F.col(q) == F.col(f"key{k}") for k, (_, q) in enumerate(pairs)]).drop(*[f"key{k}" for k in range(len(pairs))])
            else:
                u = head
                joined = frames[u].crossJoin(F.broadcast(frames[leaf].agg(total).where("more is not null")))  # one row
            frames[u] = joined.withColumn("ways", (F.col("ways") * F.col("more")).cast("decimal(38,0)")).drop("more")
        out = frames[head].groupBy("doc_id").agg(F.sum("ways").cast("decimal(38,0)").alias("ways"))
        out = out.select("doc_id", F.lit(rule.head.label).alias("label"), F.lit(rule.head.sign).alias("sign"), F.lit(i).alias("rule_id"), "ways")
        parts.append(out.join(facts.select(*FACT), FACT, "left_semi"))
    return reduce(DataFrame.unionByName, parts)
