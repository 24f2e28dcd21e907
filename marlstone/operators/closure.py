"""Fixpoint of a rule program: semi-naive rounds of DataFrame plans, under a conflict policy.

halt        a cell with both signs ends the run with status `conflict`
protect     a derivation opposite to a validated fact is blocked and counted; other clashes are conflicts
quarantine  clashing cells become unknown, and the run starts again from the roots without them
retain      clashing cells become unknown, what was derived from them stays
retain_protect  the same, but validated facts win as in protect
Each round is one action over all rules whose premises changed: a rule with label premises reads the last round's new
facts in one of them, and only what the round adds is written to the shared folder. Label-set relations are held by
components and group nodes, see plans.relation.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.relations import infeasible, violations
from marlstone.plans.compile import FACTS, Catalog, fire, fire_blocks, fire_new
from marlstone.plans.relation import COMPS, EDGES, GROUPS, Relation, block_edges, group_nodes, relate, stars
from marlstone.plans.rules import ML, Label, LabelCompare, Rule
from marlstone.plans.store import written

CELL = ["doc_id", "label"]


@dataclass
class Closure:
    """status: fixpoint, conflict or max_rounds. firings: rule_id and round of each derived fact; see operators.proof for its premises."""

    status: str
    rounds: int
    facts: DataFrame
    relation: Relation | None
    unknown: DataFrame
    blocked: DataFrame
    firings: DataFrame

    @property
    def edges(self) -> DataFrame | None:
        """The closed relation in pairs (src, dst, strict), if there is one. As many rows as there are pairs; relation holds it by components."""
        return self.relation and self.relation.pairs()

    def predictions(self) -> DataFrame:
        neg = self.facts.where("sign < 0").select(*CELL)
        return self.facts.where("sign > 0").select(*CELL).join(neg, CELL, "left_anti")


def clashes(facts: DataFrame) -> DataFrame:
    return facts.groupBy(*CELL).agg(F.count_distinct("sign").alias("n")).where("n > 1").select(*CELL)


def new_clashes(delta: DataFrame, facts: DataFrame) -> DataFrame:
    """Cells of the new facts whose other sign is a fact too: all clashes, if there was none before."""
    other = delta.select(*CELL, (-F.col("sign")).cast("int").alias("sign"))
    return other.join(facts.select(*CELL, "sign"), [*CELL, "sign"], "left_semi").select(*CELL).distinct()


def close_program(cat: Catalog, rules: list[Rule], policy: str = "halt", unknown: DataFrame | None = None, roots: DataFrame | None = None, max_rounds: int = 100, first: set[int] | None = None) -> Closure:
    """Run the program to its fixpoint. roots: further facts that are not validated. unknown: cells that take no fact.

    first: the rules of the first round, if the roots are closed under all others. With cat.labels a strict inclusion
    that no label can make strict, or no completion of the facts can meet, is a conflict.
    """
    if policy not in ("halt", "protect", "quarantine", "retain", "retain_protect"):
        raise ValueError(f"unknown policy {policy}")
    spark = cat.docs.sparkSession
    none = spark.createDataFrame([], "doc_id bigint, label string")
    unknown = none if unknown is None else unknown.select(*CELL).distinct()
    gamma = cat.gamma.select("doc_id", "label", F.col("sign").cast("int").alias("sign")).distinct()
    start = gamma if roots is None else gamma.unionByName(roots.select("doc_id", "label", F.col("sign").cast("int").alias("sign"))).distinct()
    related = cat.relations is not None or any(isinstance(r.head, LabelCompare) for r in rules)
    if policy in ("quarantine", "retain", "retain_protect"):
        unknown = unknown.unionByName(clashes(start)).distinct()
    restarts = 0
    # Rules without label premises conclude the same in every restart.
    free = [(i, r) for i, r in enumerate(rules) if isinstance(r.head, Label) and not r.reads()] if policy == "quarantine" else []
    fixed = {i: written(fire(r, cat, gamma), "free") for i, r in free}
    while True:
        out = _run(cat, rules, policy, start, gamma, unknown, related, max_rounds, first, fixed)
        if policy != "quarantine" or out.status != "conflict":
            return out
        bad = clashes(out.facts)
        if bad.isEmpty():  # the relation itself is inconsistent
            return out
        unknown = written(unknown.unionByName(bad).distinct(), "unknown")
        restarts += 1
        if restarts > max_rounds:
            out.status = "max_rounds"
            return out


class _Facts:
    """Facts in rounds: each round's are appended, none is written again, but for merging when there are many rounds and when cells go."""

    def __init__(self, first: DataFrame, most: int = 8):
        self.parts, self.most = [first], most

    @property
    def all(self) -> DataFrame:
        return reduce(DataFrame.unionByName, self.parts)

    @property
    def old(self) -> DataFrame:
        """Without the last round's."""
        return reduce(DataFrame.unionByName, self.parts[:-1])

    def append(self, delta: DataFrame) -> None:
        if len(self.parts) >= self.most:
            self.parts = [written(self.all, "facts")]
        self.parts.append(delta)

    def drop(self, unknown: DataFrame) -> None:
        """Without the unknown cells, the last round's kept apart."""
        last = self.parts[-1].join(unknown, CELL, "left_anti")
        self.parts = [written(self.old.join(unknown, CELL, "left_anti"), "facts"), written(last, "facts")]


class _Order:
    """The relation as rules add to it."""

    def __init__(self, cat: Catalog, rules: list[Rule], careful: bool):
        self.cat, self.spark = cat, cat.docs.sparkSession
        heads = {r.head.op for r in rules if isinstance(r.head, LabelCompare)}
        asked = {a.op for r in rules for a in r.body if isinstance(a, LabelCompare)}
        inclusions = cat.relations is not None or bool(heads - {"eq"})
        # Hop by hop, labels would not pass cells that take no fact; and order is asked for by strict inclusions and by premises.
        self.ordered = cat.relations is not None or "strict_subset" in heads or bool(asked - {"eq"}) or (inclusions and bool(asked)) or (inclusions and careful)
        self.strict = "strict_subset" in heads or (cat.relations is not None and not cat.relations.where("strict").isEmpty())
        self.equal: DataFrame | None = None
        self.edges = cat.relations.select("src", "dst", "strict") if cat.relations is not None else self.spark.createDataFrame([], EDGES)
        self.nodes: dict[int, DataFrame] = {}
        self.now = relate(self.spark, None, self.edges, self.ordered)

    def add(self, todo: list[tuple[int, Rule]], facts: DataFrame, n: int) -> bool:
        """The heads of the rules; tells whether the relation changed."""
        equal, edges = ([] if self.equal is None else [self.equal]), [self.edges]
        for i, r in todo:
            sides = fire_blocks(r, self.cat, facts, self.now)
            if sides is None:
                pairs = fire(r, self.cat, facts, self.now)
                if r.head.op == "eq":
                    equal.append(pairs.select(F.col("src").alias("a"), F.col("dst").alias("b")))
                else:
                    edges.append(pairs)
                continue
            left, right = (written(s, "side") for s in sides)
            if r.head.op == "eq":
                equal.append(stars(left, right))
            else:
                known = self.nodes.get(i, self.spark.createDataFrame([], "value string, node bigint"))
                self.nodes[i] = group_nodes(left, right, known, n)
                edges.append(block_edges(left, right, self.nodes[i], r.head.op == "strict_subset"))
        self.equal = written(reduce(DataFrame.unionByName, equal).distinct(), "equal") if equal else None
        self.edges = written(reduce(DataFrame.unionByName, edges).distinct(), "edges")
        before, self.now = self.now, relate(self.spark, self.equal, self.edges, self.ordered)
        return not (self.now.comps.exceptAll(before.comps).isEmpty() and self.now.links.exceptAll(before.links).isEmpty())

    def broken(self, facts: DataFrame, n_labels: int | None) -> bool:
        return self.strict and not violations(self.now.pairs(), facts, n_labels).isEmpty()


def _run(cat: Catalog, rules: list[Rule], policy: str, start: DataFrame, gamma: DataFrame, unknown: DataFrame, related: bool, max_rounds: int, first: set[int] | None = None, fixed: dict | None = None) -> Closure:
    spark = cat.docs.sparkSession
    fact = [*CELL, "sign"]
    opposite = gamma.select("doc_id", "label", (-F.col("sign")).cast("int").alias("sign"))
    careful = policy != "halt" or not unknown.isEmpty()
    n_labels = len(cat.labels) if cat.labels else None
    if policy == "halt" and cat.relations is not None:  # what the given inclusions alone contradict needs no closure of them
        given = Relation(spark.createDataFrame([], COMPS), cat.relations.select("src", "dst", "strict"), closed=False, settled=False)
        known = start.join(unknown, CELL, "left_anti").select(*fact)
        known = written(known.unionByName(given.copies(known).join(unknown, CELL, "left_anti")).distinct(), "facts")
        if not clashes(known).isEmpty() or not violations(given.links, known, n_labels).isEmpty():
            empty = spark.createDataFrame([], FACTS)
            return Closure("conflict", 0, known, given, unknown, empty, spark.createDataFrame([], "rule_id int, round int, " + FACTS))
    order = _Order(cat, rules, careful) if related else None
    of_docs = lambda df: df.where(F.col("doc_id") >= GROUPS)
    begin = start.join(unknown, CELL, "left_anti")
    if related:
        begin = begin.unionByName(order.now.copies(begin).join(unknown, CELL, "left_anti")).distinct()
    facts = _Facts(written(begin.select(*fact), "facts"))
    fired = spark.createDataFrame([], "rule_id int, round int, " + FACTS)
    blocked = spark.createDataFrame([], FACTS)
    memo: dict = {}  # text filters of rules that fire again

    def state(status: str, n: int) -> Closure:
        return Closure(status, n, of_docs(facts.all), order and order.now, unknown, blocked.distinct(), of_docs(fired))

    if policy in ("halt", "protect", "quarantine") and not clashes(facts.all).isEmpty():
        return state("conflict", 0)
    if related and order.broken(facts.all, n_labels):
        return state("conflict", 0)
    delta: DataFrame | None = None
    changed: set[str] | None = None  # None: all rules run
    for n in range(1, max_rounds + 1):
        todo = [(i, r) for i, r in enumerate(rules) if (first is None or i in first if changed is None else r.reads() & changed)]
        label_rules = [(i, r) for i, r in todo if isinstance(r.head, Label)]
        parts = []
        for i, r in label_rules:
            if changed is None or ("=" in changed and "=" in r.reads()):
                found = [fixed[i] if fixed and i in fixed else fire(r, cat, facts.all, order and order.now)]
            else:
                found = fire_new(r, cat, facts.old, delta, changed, order and order.now, memo)
            parts += [f.select(F.lit(i).alias("rule_id"), *fact) for f in found]
        grown = bool(related) and order.add([(i, r) for i, r in todo if isinstance(r.head, LabelCompare)], facts.all, n) if any(isinstance(r.head, LabelCompare) for _, r in todo) else False
        if related:
            moved = order.now.copies(facts.all if grown or delta is None else delta)
            parts.append(moved.select(F.lit(-1).alias("rule_id"), *fact))
        found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "rule_id int, " + FACTS)
        known = facts.all if related else facts.all.where(F.col("label").isin(sorted({r.head.label for _, r in label_rules})))
        found = found.groupBy(*fact).agg(F.min("rule_id").alias("rule_id")).join(unknown, CELL, "left_anti").join(known, fact, "left_anti")
        found = written(found.select("rule_id", *fact), "found")
        if policy in ("protect", "retain_protect"):
            stopped = found.join(opposite, fact, "left_semi").select(*fact)
            blocked = written(blocked.unionByName(stopped).distinct(), "blocked")
            found = found.join(opposite, fact, "left_anti").select("rule_id", *fact)
        names = [r["label"] for r in found.select("label").distinct().collect()]  # the program's labels at most
        if not names and not grown:
            if related and cat.labels and order.strict and not infeasible(order.now.pairs(), of_docs(facts.all), cat.labels).isEmpty():
                return state("conflict", n)
            return state("fixpoint", n)
        delta = found.select(*fact)
        fired = fired.unionByName(found.withColumn("round", F.lit(n)))
        facts.append(delta)
        if policy.startswith("retain"):
            bad = new_clashes(delta, facts.all)
            if not bad.isEmpty():
                unknown = written(unknown.unionByName(bad).distinct(), "unknown")
                facts.drop(unknown)
                delta = facts.parts[-1]
        elif not new_clashes(delta, facts.all).isEmpty():
            return state("conflict", n)
        if related and order.broken(of_docs(facts.all), n_labels):
            return state("conflict", n)
        changed = {*names} | ({"="} if grown else set())
    return state("max_rounds", max_rounds)


def insert_roots(cat: Catalog, rules: list[Rule], before: Closure, added: DataFrame, policy: str = "halt") -> Closure:
    """Incremental closure after new validated facts: starts from what was derived, which stays valid in a conflict-free run."""
    grown = replace(cat, gamma=cat.gamma.unionByName(added).distinct())
    if before.status != "fixpoint":
        return close_program(grown, rules, policy)
    return close_program(grown, rules, policy, unknown=before.unknown, roots=before.facts)


@dataclass
class Step:
    """What new documents and roots add to a closed program: added (doc_id, label, sign), roots among them."""

    status: str
    rounds: int
    added: DataFrame


def advance(cat: Catalog, rules: list[Rule], old: DataFrame, docs: DataFrame | None = None, roots: DataFrame | None = None, policy: str = "halt", max_rounds: int = 100) -> Step:
    """The closure after new documents and roots, by deltas only.

    old: the facts of the closure before, under halt or protect, without label-set relations. cat: the catalog with all
    documents and validated facts, new ones too. docs: the new documents, as in cat; roots: new facts. In the first round a rule
    runs once for each of its variables, which then ranges over the new documents, and once for each premise that has new facts.
    """
    if policy not in ("halt", "protect") or any(isinstance(a, LabelCompare) for r in rules for a in (*r.body, r.head)):
        raise ValueError("deltas are for halt and protect, and for rules without label-set relations")
    spark, fact, memo = cat.docs.sparkSession, [*CELL, "sign"], {}
    opposite = cat.gamma.select("doc_id", "label", (-F.col("sign")).cast("int").alias("sign")).distinct()
    old = old.select(*fact)
    first = cat.gamma.select("doc_id", "label", F.col("sign").cast("int").alias("sign")) if roots is None else roots.select("doc_id", "label", F.col("sign").cast("int").alias("sign"))
    delta = written(first.distinct().join(old, fact, "left_anti"), "delta")
    facts = _Facts(old)
    facts.append(delta)
    changed = {r["label"] for r in delta.select("label").distinct().collect()}  # the program's labels at most
    if not new_clashes(delta, facts.all).isEmpty():
        return Step("conflict", 0, delta)
    added = [delta]
    for n in range(1, max_rounds + 1):
        parts = [f for r in rules if r.reads() & changed for f in fire_new(r, cat, facts.old, delta, changed, None, memo)]
        if n == 1 and docs is not None:
            parts += [fire(r, cat, facts.all, ranges={v: docs}) for r in rules for v in r.bound]
        if not parts:
            break
        found = reduce(DataFrame.unionByName, [p.select(*fact) for p in parts]).distinct()
        if policy == "protect":
            found = found.join(opposite, fact, "left_anti")
        delta = written(found.join(facts.all, fact, "left_anti"), "delta")
        changed = {r["label"] for r in delta.select("label").distinct().collect()}
        if not changed:
            break
        facts.append(delta)
        added.append(delta)
        if not new_clashes(delta, facts.all).isEmpty():
            return Step("conflict", n, reduce(DataFrame.unionByName, added))
    else:
        return Step("max_rounds", max_rounds, reduce(DataFrame.unionByName, added))
    return Step("fixpoint", n, reduce(DataFrame.unionByName, added))


def extend(cat: Catalog, rules: list[Rule], before: Closure, candidate: Rule, policy: str = "halt") -> Closure:
    """The closure of rules and one more, from the fixpoint of rules: only the candidate runs at first, then what reads its conclusions."""
    grown = [*rules, candidate]
    if before.status != "fixpoint" or before.relation is not None:
        return close_program(cat, grown, policy)
    return close_program(cat, grown, policy, unknown=before.unknown, roots=before.facts, first={len(rules)})


def withdraw(old: Catalog, new: Catalog, rules: list[Rule], before: Closure, policy: str = "halt") -> Closure:
    """The closure after model probabilities changed, from the one before: over-delete, then derive again.

    Facts of instances that no longer hold go, and all that some rule can conclude from facts that went (not
    roots). What is left is rooted again and the program runs from there, which brings back what has another
    derivation and what the new probabilities add. Runs with a conflict, unknown cells or relations start anew.
    """
    if before.status != "fixpoint" or before.relation is not None or not before.unknown.isEmpty():
        return close_program(new, rules, policy, unknown=before.unknown)
    fact = [*CELL, "sign"]
    roots = old.gamma.select(*CELL, F.col("sign").cast("int").alias("sign"))
    model = [r for r in rules if any(isinstance(a, ML) for a in r.body)]
    gone = None
    for r in model:  # a fact goes if the rule concluded it and does not any more
        if isinstance(r.head, Label):
            lost = fire(r, old, before.facts).select(*fact).join(fire(r, new, before.facts).select(*fact), fact, "left_anti")
            gone = lost if gone is None else gone.unionByName(lost)
    if gone is None:
        return close_program(new, rules, policy, roots=before.facts)
    gone = written(gone.join(roots, fact, "left_anti").distinct(), "gone")
    gone = _descendants(old, rules, before.facts, gone, roots)
    left = written(before.facts.select(*fact).join(gone, fact, "left_anti"), "left")
    return close_program(new, rules, policy, roots=left)


def _descendants(cat: Catalog, rules: list[Rule], facts: DataFrame, gone: DataFrame, roots: DataFrame) -> DataFrame:
    """gone and all facts (but roots) that some rule can conclude from them, step by step: over-deletion."""
    fact = [*CELL, "sign"]
    front = gone
    while not front.isEmpty():
        touched = {r["label"] for r in front.select("label").distinct().collect()}
        parts = [h.select(*fact) for r in rules if isinstance(r.head, Label) and r.reads() & touched for h in fire_new(r, cat, facts, front, touched)]
        if not parts:
            break
        front = reduce(DataFrame.unionByName, parts).distinct().join(facts, fact, "left_semi").join(roots, fact, "left_anti").join(gone, fact, "left_anti")
        front = written(front, "front")
        gone = written(gone.unionByName(front), "gone")
    return gone


def hide(cat: Catalog, rules: list[Rule], before: Closure, cells: DataFrame, policy: str = "halt") -> Closure:
    """The view of a closure in which cells (doc_id, label) are unknown: their facts go, roots too, and what rests on nothing else.

    What has another derivation stays: descendants of the hidden facts are deleted and derived again from what is left.
    """
    if before.status != "fixpoint" or before.relation is not None:
        return close_program(cat, rules, policy, unknown=before.unknown.unionByName(cells.select(*CELL)))
    fact, hidden = [*CELL, "sign"], cells.select(*CELL).distinct()
    unknown = before.unknown.unionByName(hidden).distinct()
    roots = cat.gamma.select(*CELL, F.col("sign").cast("int").alias("sign")).distinct().join(unknown, CELL, "left_anti")
    gone = written(before.facts.select(*fact).join(hidden, CELL, "left_semi"), "gone")
    gone = _descendants(cat, rules, before.facts.select(*fact), gone, roots)
    left = written(before.facts.select(*fact).join(gone, fact, "left_anti"), "left")
    return close_program(cat, rules, policy, unknown=unknown, roots=left)


def local_check(cat: Catalog, rules: list[Rule], seeds: DataFrame, depth: int = 2, policy: str = "halt") -> Closure:
    """The program on the documents that seeds (doc_id) reach in `depth` steps along its attribute links, and only with their roots."""
    links = {(a.left_attr, a.right_attr) for r in rules for a in r.body if type(a).__name__ == "AttrEqual" and a.left_var != a.right_var}
    near = seeds.select("doc_id").distinct()
    col = lambda x: x.replace(".", "_")
    for _ in range(depth):
        more = [near]
        for a, b in links | {(b, a) for a, b in links}:
            values = cat.docs.join(near, "doc_id", "left_semi").where(F.col(col(a)) != "").select(F.col(col(a)).alias("v_")).distinct()
            more.append(cat.docs.join(values, F.col(col(b)) == F.col("v_"), "left_semi").select("doc_id"))
        near = written(reduce(DataFrame.unionByName, more).distinct(), "near")
    part = replace(cat, docs=cat.docs.join(near, "doc_id", "left_semi"), gamma=cat.gamma.join(near, "doc_id", "left_semi"))
    return close_program(part, rules, policy)


def influence(cat: Catalog, rules: list[Rule], before: Closure, hypotheses: DataFrame) -> DataFrame:
    """For each hypothetical fact (doc_id, label) how many uncovered documents one firing of the rules would reach."""
    covered = before.predictions().select("doc_id").distinct()
    one = [r for r in rules if sum(isinstance(a, Label) for a in r.body) == 1 and isinstance(r.head, Label)]
    reached = None
    for r in one:
        copies = [a for a in r.body if type(a).__name__ == "AttrEqual" and a.left_var != a.right_var]
        premise = next(a for a in r.body if isinstance(a, Label))
        if len(copies) != 1 or premise.sign < 0:
            continue
        a = copies[0]
        src, dst = (a.left_attr, a.right_attr) if a.left_var == premise.var else (a.right_attr, a.left_attr)
        col = lambda x: x.replace(".", "_")
        open_docs = cat.docs.join(covered, "doc_id", "left_anti").where(F.col(col(dst)) != "").groupBy(F.col(col(dst)).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        sources = cat.docs.select("doc_id", F.col(col(src)).alias("value")).join(hypotheses.where(F.col("label") == premise.label), "doc_id")
        part = sources.join(open_docs, "value").select("doc_id", "label", "n")
        reached = part if reached is None else reached.unionByName(part)
    base = hypotheses.select("doc_id", "label").distinct()
    if reached is None:
        return base.withColumn("reached", F.lit(0).cast("long"))
    return base.join(reached.groupBy("doc_id", "label").agg(F.max("n").alias("reached")), ["doc_id", "label"], "left").na.fill({"reached": 0})
