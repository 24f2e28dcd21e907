"""Many candidate rules at once: their closures over one shared prefix as one fixpoint with a column that tells the runs apart.

A run is a candidate on top of the same prefix program. What the prefix concludes is shared; a run holds only the facts that
it has beyond it. Each round is one job for all runs, and every plan in it starts at the last round's new facts.
Scores follow from counts of the prefix and of a run's own facts, so a batch costs what its own facts cost.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import predicate
from marlstone.operators.closure import CELL, Closure, close_program, extend
from marlstone.operators.metrics import confusion, f1
from marlstone.plans.compile import Catalog, _there, column, fire, premises
from marlstone.plans.rules import ML, Doc, Label, LabelCompare, Rule, Text
from marlstone.plans.store import written

FACT = [*CELL, "sign"]
OWN = "run bigint, doc_id bigint, label string, sign int"


@dataclass
class Batch:
    """status: run, status (fixpoint, conflict or max_rounds). own: run, doc_id, label, sign beyond the shared facts. rounds: of the longest run."""

    shared: DataFrame
    own: DataFrame
    status: DataFrame
    rounds: int

    def facts(self, run: int) -> DataFrame:
        return self.shared.select(*FACT).unionByName(self.own.where(F.col("run") == run).select(*FACT))


@dataclass
class Firings:
    """What rules without label premises conclude: the same in every batch, so each rule is evaluated once. tables: rule (its number), doc_id, label, sign."""

    numbers: dict[Rule, int] = field(default_factory=dict)
    tables: list[DataFrame] = field(default_factory=list)

    def of(self, cat: Catalog, rules: list[Rule], shared: DataFrame) -> DataFrame | None:
        """The rows of these rules; those that are new are evaluated in one job."""
        new = [r for r in rules if r not in self.numbers]
        if new:
            self.numbers |= {r: len(self.numbers) + k for k, r in enumerate(new)}
            self.tables.append(written(_first(cat, {self.numbers[r]: r for r in new}, shared), "firings"))
        asked = F.col("rule").isin([self.numbers[r] for r in rules])
        return reduce(DataFrame.unionByName, [t.where(asked) for t in self.tables]) if rules else None


def _first(cat: Catalog, rules: dict[int, Rule], facts: DataFrame) -> DataFrame:
    """rule, doc_id, label, sign that the rules conclude from the facts."""
    plain = {k: r for k, r in rules.items() if one_variable(r)}
    parts = [fire_unary(cat, plain, facts).withColumnRenamed("run", "rule")] if plain else []
    parts += [fire(r, cat, facts).select(F.lit(k).alias("rule"), *FACT) for k, r in rules.items() if k not in plain]
    return reduce(DataFrame.unionByName, parts)


def one_variable(rule: Rule) -> bool:
    """Whether the rule is a conjunction of texts, models and labels of one document."""
    return len(rule.bound) == 1 and all(isinstance(a, Doc | Text | ML | Label) for a in rule.body) and any(not isinstance(a, Doc) for a in rule.body)


def fire_unary(cat: Catalog, rules: dict[int, Rule], facts: DataFrame) -> DataFrame:
    """run, doc_id, label, sign of one-variable rules, all by one plan that does not grow with their number.

    Each document and rule has as many met atoms as three scans find: one of the documents for all texts, one of the model
    probabilities and one of the facts, against tables of the rules' atoms; a rule holds where none is missing.
    """
    spark = cat.docs.sparkSession
    met: list[DataFrame] = []
    texts = []
    for i, r in rules.items():
        own = [a.predicate for a in r.body if isinstance(a, Text)]
        if own:
            holds = reduce(lambda a, b: a & b, [predicate(p, F.col(column(p.attr)), _there(cat.docs, p.attr)) & _there(cat.docs, p.attr) for p in own])
            texts += [F.lit(i), F.lit(len(own)), holds]
    if texts:  # a stack, as in patterns.masks
        stacked = cat.docs.select("doc_id", F.stack(F.lit(len(texts) // 3), *texts).alias("run", "n", "holds"))
        met.append(stacked.where("holds").select("run", "doc_id", "n").distinct())
    models = [(i, a.alias, a.label, float(a.eta), None if a.upper is None else float(a.upper), not a.dynamic, k) for i, r in rules.items() for k, a in enumerate(r.body) if isinstance(a, ML)]
    if models:
        asked = spark.createDataFrame(models, "run int, alias string, label string, low double, high double, is_static boolean, k int")
        p = F.col("p").cast("double")
        hit = cat.model_prob.join(F.broadcast(asked), ["alias", "label", "is_static"]).where((p >= F.col("low")) & (F.col("high").isNull() | (p < F.col("high"))))
        met.append(hit.select("run", "doc_id", "k").distinct().select("run", "doc_id", F.lit(1).alias("n")))
    labels = [(i, a.label, a.sign, k) for i, r in rules.items() for k, a in enumerate(r.body) if isinstance(a, Label)]
    if labels:
        asked = spark.createDataFrame(labels, "run int, label string, sign int, k int")
        met.append(facts.join(F.broadcast(asked), ["label", "sign"]).select("run", "doc_id", "k").distinct().select("run", "doc_id", F.lit(1).alias("n")))
    heads = spark.createDataFrame([(i, sum(not isinstance(a, Doc) for a in r.body), r.head.label, r.head.sign) for i, r in rules.items()], "run int, atoms int, label string, sign int")
    count = reduce(DataFrame.unionByName, met).groupBy("run", "doc_id").agg(F.sum("n").alias("n"))
    return count.join(F.broadcast(heads), "run").where("n = atoms").join(cat.docs.select("doc_id").distinct(), "doc_id", "left_semi").select("run", *FACT)


def fire_runs(rule: Rule, cat: Catalog, shared: DataFrame, old: DataFrame, delta: DataFrame, changed: set[str]) -> list[DataFrame]:
    """Conclusions (run, fact) of a rule that need a new fact of a run.

    For each premise that has new facts: it reads these, an earlier premise the shared facts or the run's older ones, a later
    one the shared facts or all of the run's. Shared facts have no run, so they are read once, not once a run.
    """
    at, out = premises(rule), []
    both = old.unionByName(delta)
    for k, i in enumerate(at):
        if rule.body[i].label not in changed:
            continue
        options = [[delta] if n == k else [shared, old] if n < k else [shared, both] for n in range(len(at))]
        out += [fire(rule, cat, None, None, dict(zip(at, choice, strict=True))) for choice in itertools.product(*options)]
    return out


def close_batch(cat: Catalog, prefix: list[Rule], candidates: list[Rule], base: Closure, policy: str = "halt", max_rounds: int = 100) -> Batch:
    """The closures of prefix and each candidate, numbered as the candidates are. base: the prefix's closure, a fixpoint.

    Policies are halt and protect. A run with a conflict stops; the others go on. Relations between label sets are not for batches.
    """
    if policy not in ("halt", "protect"):
        raise ValueError(f"candidates are not tried in batches under {policy}")
    if base.status != "fixpoint" or base.relation is not None or any(isinstance(a, LabelCompare) for r in (*prefix, *candidates) for a in (*r.body, r.head)):
        raise ValueError("a batch needs a prefix at its fixpoint, and rules without label-set relations")
    return _close_all(cat, prefix, [[c] for c in candidates], base, policy, max_rounds)


def close_programs(cat: Catalog, programs: list[list[Rule]], policy: str = "halt", max_rounds: int = 100, fired: Firings | None = None) -> Batch:
    """The closures of whole programs, numbered as they are. A rule of several programs is evaluated once for all of them; one without label
    premises once for all batches that share `fired`."""
    if any(isinstance(a, LabelCompare) for p in programs for r in p for a in (*r.body, r.head)):
        raise ValueError("programs with label-set relations are closed one by one")
    return _close_all(cat, [], programs, close_program(cat, [], policy), policy, max_rounds, fired)


def _close_all(cat: Catalog, prefix: list[Rule], own: list[list[Rule]], base: Closure, policy: str, max_rounds: int, fired: Firings | None = None) -> Batch:
    spark = cat.docs.sparkSession
    runs_of: dict[Rule, list[int]] = {}
    for i, rules in enumerate(own):
        for r in dict.fromkeys(rules):
            runs_of.setdefault(r, []).append(i)
    shared = base.facts.select(*FACT)
    free = [r for r in runs_of if not r.reads()] if fired is not None else []
    parts = []
    for rules, rows in ((free, fired and fired.of(cat, free, shared)), ([r for r in runs_of if r not in free], None)):
        if rules:
            number = {r: fired.numbers[r] if rows is not None else k for k, r in enumerate(rules)}
            rows = _first(cat, {k: r for r, k in number.items()}, shared) if rows is None else rows
            # A row a rule, with the runs that have it.
            has = spark.createDataFrame([(number[r], runs_of[r]) for r in rules], "rule int, runs array<bigint>")
            parts.append(rows.join(F.broadcast(has), "rule").select(F.explode("runs").alias("run"), *FACT))
    runs = spark.createDataFrame([(i,) for i in range(len(own))], "run long")
    return _spread(cat, prefix, runs_of, base, runs, parts, policy, max_rounds)


def close_hypotheses(cat: Catalog, rules: list[Rule], base: Closure, hypotheses: DataFrame, policy: str = "halt", max_rounds: int = 100) -> Batch:
    """The closures of the program with one further fact each. hypotheses: run (a long), doc_id, label, sign. base: the program's closure, a fixpoint."""
    if policy not in ("halt", "protect") or base.status != "fixpoint" or base.relation is not None:
        raise ValueError("hypotheses need a program at its fixpoint without label-set relations, under halt or protect")
    seeds = hypotheses.select(F.col("run").cast("long").alias("run"), *FACT)
    return _spread(cat, rules, {}, base, seeds.select("run").distinct(), [seeds], policy, max_rounds)


def _spread(cat: Catalog, rules: list[Rule], own_rules: dict[Rule, list[int]], base: Closure, runs: DataFrame, parts: list[DataFrame], policy: str, max_rounds: int) -> Batch:
    """All runs to their fixpoints from the first conclusions in parts. rules hold in all runs, own_rules in the runs that they have."""
    spark = cat.docs.sparkSession
    shared = base.facts.select(*FACT)
    opposite = cat.gamma.select("doc_id", "label", (-F.col("sign")).cast("int").alias("sign")).distinct()
    none = spark.createDataFrame([], OWN)
    own, old, conflicts, rounds = none, none, spark.createDataFrame([], "run long"), 0
    signs = {(r["label"], r["sign"]) for r in shared.select("label", "sign").distinct().collect()} if parts else set()  # the program's labels at most
    changed: set[str] = set()
    delta = none
    while rounds < max_rounds:
        if not parts:  # no rule reads what is new
            changed = set()
            break
        found = reduce(DataFrame.unionByName, parts)
        found = found.select(F.col("run").cast("long").alias("run"), *FACT).distinct().join(base.unknown, CELL, "left_anti").join(shared, FACT, "left_anti").join(own, ["run", *FACT], "left_anti")
        if policy == "protect":
            found = found.join(opposite, FACT, "left_anti")
        delta = written(found.select("run", *FACT), "found")
        made = {(r["label"], r["sign"]) for r in delta.select("label", "sign").distinct().collect()}
        changed = {x for x, _ in made}
        if not changed:
            break
        rounds += 1
        old, own = own, own.unionByName(delta)
        signs |= made
        if any((x, -sign) in signs for x, sign in made):  # else no cell has both signs
            other = delta.select("run", *CELL, (-F.col("sign")).cast("int").alias("sign"))
            bad = other.join(shared, FACT, "left_semi").select("run").unionByName(other.join(own, ["run", *FACT], "left_semi").select("run")).distinct()
            bad = written(bad, "conflicts")
            conflicts = conflicts.unionByName(bad)
            delta = delta.join(bad, "run", "left_anti").select("run", *FACT)
        parts = [f for r in rules if r.reads() & changed for f in fire_runs(r, cat, shared, old, delta, changed)]
        for r, some in own_rules.items():
            if r.reads() & changed:
                mine = F.col("run").isin(some)
                parts += fire_runs(r, cat, shared, old.where(mine), delta.where(mine), changed)
        if rounds % 8 == 0:
            own = written(own, "own")
    late = delta.select("run").distinct().withColumn("late", F.lit(True)) if changed else spark.createDataFrame([], "run long, late boolean")
    status = runs.join(conflicts.withColumn("bad", F.lit(True)).distinct(), "run", "left").join(late, "run", "left")
    status = status.select("run", F.when(F.col("bad"), "conflict").when(F.col("late"), "max_rounds").otherwise("fixpoint").alias("status"))
    return Batch(shared, own, status, rounds)


def influence(cat: Catalog, rules: list[Rule], base: Closure, hypotheses: DataFrame, policy: str = "halt") -> DataFrame:
    """doc_id, label, status, reached of hypothetical positive facts (doc_id, label): how many documents without any predicted label get one.

    All hypotheses are one fixpoint, however many hops their consequences take; what they derive is held a hypothesis, so
    they are meant to be the pending rows that are ranked, not the whole table against groups of millions. reached is null in a conflict.
    """
    asked = written(hypotheses.select(*CELL).distinct().withColumn("run", F.monotonically_increasing_id()), "hypotheses")
    b = close_hypotheses(cat, rules, base, asked.select("run", *CELL, F.lit(1).alias("sign")), policy)
    covered = base.predictions().select("doc_id").distinct()
    reached = b.own.where("sign > 0").join(covered, "doc_id", "left_anti").groupBy("run").agg(F.count_distinct("doc_id").alias("n"))
    out = asked.join(b.status, "run").join(reached, "run", "left")
    return out.select(*CELL, "status", F.when(F.col("status") != "conflict", F.coalesce("n", F.lit(0))).alias("reached"))


def influence_rank(cat: Catalog, rules: list[Rule], base: Closure, rows: DataFrame, labels: DataFrame, policy: str = "halt") -> DataFrame:
    """doc_id, influence: the mean over labels of what a row would reach if the label were true there; a label in conflict counts 0."""
    each = influence(cat, rules, base, rows.select("doc_id").distinct().crossJoin(F.broadcast(labels.select("label").distinct())), policy)  # labels
    return each.groupBy("doc_id").agg(F.avg(F.coalesce("reached", F.lit(0)).cast("double")).alias("influence"))


def batch_scores(batch: Batch, truth: DataFrame, labels: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """run, status, macro_f1, micro_f1, gain (of macro F1 over the shared facts) of each run's predictions; no scores unless it is a fixpoint.

    docs (doc_id): the documents that count, all if not given. truth: doc_id, label.
    """
    mine = lambda df: df if docs is None else df.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    t = mine(truth.select(*CELL).distinct())
    now = confusion(mine(batch.shared.where("sign > 0").select(*CELL)), t, labels).select("label", "tp", "fp", "fn")
    # At a fixpoint no cell has both signs, so a run's positive facts are further predictions.
    extra = mine(batch.own.where("sign > 0")).join(labels.select("label"), "label", "left_semi").join(t.withColumn("t", F.lit(1)), CELL, "left")
    extra = extra.groupBy("run", "label").agg(F.count("t").alias("a"), F.count_if(F.col("t").isNull()).alias("b"))
    grid = batch.status.crossJoin(F.broadcast(now))  # candidates and labels
    cell = grid.join(extra, ["run", "label"], "left").na.fill(0, ["a", "b"])
    tp, fp, fn = F.col("tp") + F.col("a"), F.col("fp") + F.col("b"), F.col("fn") - F.col("a")
    out = cell.groupBy("run", "status").agg(F.avg(f1(tp, fp, fn)).alias("macro_f1"), f1(F.sum(tp), F.sum(fp), F.sum(fn)).alias("micro_f1"), F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("before"))
    done = F.col("status") == "fixpoint"
    return out.select("run", "status", F.when(done, F.col("macro_f1")).alias("macro_f1"), F.when(done, F.col("micro_f1")).alias("micro_f1"), F.when(done, F.col("macro_f1") - F.col("before")).alias("gain"))


def standalone(cat: Catalog, rules: list[Rule], truth: DataFrame, labels: DataFrame, docs: DataFrame | None = None, policy: str = "halt") -> DataFrame:
    """rule_id, status, score of each rule's own closure from the validated facts: macro F1; for a negative head the F1 of what its closure
    denies of its label against the documents without it; -1 for a conflict."""
    base = close_program(cat, [], policy)
    batch = close_batch(cat, [], rules, base, policy)
    signs = cat.docs.sparkSession.createDataFrame([(i, r.head.label, r.head.sign) for i, r in enumerate(rules)], "run long, label string, sign int")
    s = batch_scores(batch, truth, labels, docs).join(F.broadcast(signs), "run")
    pool = (cat.docs if docs is None else docs).select("doc_id").distinct()
    wanted = signs.where("sign < 0").select("label").distinct()
    pos = truth.select(*CELL).distinct().join(pool, "doc_id", "left_semi")
    size = pool.agg(F.count(F.lit(1)).alias("size"))
    absent = wanted.crossJoin(F.broadcast(size)).join(pos.groupBy("label").agg(F.count(F.lit(1)).alias("pos")), "label", "left").select("label", (F.col("size") - F.coalesce("pos", F.lit(0))).alias("absent"))  # labels
    denied = batch.own.where("sign < 0").select("run", *CELL).unionByName(signs.where("sign < 0").select("run", "label").join(batch.shared.where("sign < 0").select(*CELL), "label").select("run", *CELL))
    denied = denied.join(signs.where("sign < 0").select("run", "label"), ["run", "label"], "left_semi").join(pool, "doc_id", "left_semi").distinct()
    count = denied.join(pos.withColumn("t", F.lit(1)), CELL, "left").groupBy("run").agg(F.count_if(F.col("t").isNull()).alias("tn"), F.count("t").alias("wrong"))
    s = s.join(absent, "label", "left").join(count, "run", "left").na.fill(0, ["tn", "wrong"])
    negative = f1(F.col("tn"), F.col("wrong"), F.col("absent") - F.col("tn"))
    return s.select(F.col("run").cast("int").alias("rule_id"), "status", F.when(F.col("status") != "fixpoint", -1.0).when(F.col("sign") < 0, negative).otherwise(F.col("macro_f1")).alias("score"))


@dataclass
class Admission:
    """taken: the candidates' numbers in the order of admission. macro: F1 with all of them. trace: number, whether taken, and macro F1 after it, of
    each candidate in order (strict only). runs: how many batches were closed. closure: of prefix and taken rules, made when asked for."""

    taken: list[int]
    macro: float
    runs: int
    close: Callable[[], Closure]
    trace: list[tuple[int, bool, float]] = field(default_factory=list)

    @cached_property
    def closure(self) -> Closure:
        return self.close()


def separable(prefix: list[Rule], candidates: list[Rule]) -> bool:
    """Whether what candidates add to the prefix is what each adds alone: no candidate reads facts, and no prefix rule joins two of them."""
    return not any(c.reads() for c in candidates) and all(len(premises(r)) <= 1 for r in prefix)


def _admit_separable(cat: Catalog, candidates: list[Rule], order: list[int], truth: DataFrame, labels: DataFrame, rules: list[Rule], base: Closure, epsilon: float, policy: str,
                     size: int, docs: DataFrame | None) -> Admission | None:
    """Strict admission where candidates are separable: each is closed once on the prefix, and what one adds after others is what they lack of it.
    None if a closure did not end."""
    mine = lambda df: df if docs is None else df.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    t = mine(truth.select(*CELL).distinct())
    now = confusion(mine(base.facts.where("sign > 0").select(*CELL)), t, labels).select("label", "tp", "fp", "fn")
    counts = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in now.collect()}  # labels
    score = lambda c: sum(2.0 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0 for tp, fp, fn in c.values()) / len(c) if c else 0.0
    macro, taken, trace, runs = score(counts), [], [], 0
    covered: DataFrame | None = None  # cells that taken candidates of earlier blocks add
    for at in range(0, len(order), min(size, 62)):
        block = order[at : at + min(size, 62)]
        b = close_batch(cat, rules, [candidates[i] for i in block], base, policy)
        runs += 1
        status = {r["run"]: r["status"] for r in b.status.collect()}  # a row a candidate
        if "max_rounds" in status.values():
            return None
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("run").cast("int"))
        own = b.own if covered is None else b.own.unionByName(covered.withColumn("run", F.lit(62).cast("long")))
        # A row a cell: the candidates that affirm it and those that deny it, as bits.
        cells = own.withColumn("bit", bit).groupBy(*CELL).agg(F.bit_or(F.when(F.col("sign") > 0, F.col("bit")).otherwise(0)).alias("pos"), F.bit_or(F.when(F.col("sign") < 0, F.col("bit")).otherwise(0)).alias("neg"))
        seen = mine(cells.select(*CELL)).join(labels.select("label"), "label", "left_semi").withColumn("seen", F.lit(True))
        cells = cells.join(seen, CELL, "left").join(t.withColumn("t", F.lit(True)), CELL, "left")
        tally = written(cells.groupBy("label", "pos", "neg", "seen", "t").agg(F.count(F.lit(1)).alias("n")), "tally")
        inside, stale, new = 1 << 62 if covered is not None else 0, True, {}
        for k, i in enumerate(block):
            if stale:  # all candidates left, against those taken so far
                new, stale = _additions(tally, len(block), inside), False
            good = False
            if status[k] == "fixpoint" and not new.get((k, None)):
                then = {x: (tp + (d := new.get((k, x), (0, 0)))[0], fp + d[1], fn - d[0]) for x, (tp, fp, fn) in counts.items()}
                good = score(then) - macro > epsilon
            if good:
                counts, macro, stale = then, score(then), True
                inside |= 1 << k
                taken.append(i)
            trace.append((i, good, macro))
        if any(inside >> k & 1 for k in range(len(block))):
            covered = written(own.where(F.col("run").isin([k for k in range(63) if inside >> k & 1])).select(*FACT).distinct(), "covered")
    return Admission(taken, macro, runs, lambda: close_program(cat, [*rules, *[candidates[i] for i in taken]], policy), trace)


def _additions(tally: DataFrame, n: int, inside: int) -> dict:
    """(run, label): true and false cells that a run affirms and those inside (bits) do not. (run, None): whether it clashes with them."""
    one = tally.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("run"))
    has = lambda c: F.call_function("shiftright", F.col(c), F.col("run")).bitwiseAND(F.lit(1)) == 1
    old = lambda c: F.col(c).bitwiseAND(F.lit(inside)) != 0
    adds = has("pos") & ~old("pos") & F.coalesce(F.col("seen"), F.lit(False))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    rows = one.where(has("pos") | has("neg")).groupBy("run", "label").agg(total(adds & F.col("t").isNotNull()).alias("a"), total(adds & F.col("t").isNull()).alias("b"), total((has("pos") & old("neg")) | (has("neg") & old("pos"))).alias("clash"))
    out: dict = {}
    for r in rows.collect():  # candidates of a block times labels
        out[r["run"], r["label"]] = (r["a"], r["b"])
        if r["clash"]:
            out[r["run"], None] = True
    return out


def admit(cat: Catalog, candidates: list[Rule], order: list[int], truth: DataFrame, labels: DataFrame, prefix: list[Rule] | None = None, epsilon: float = 0.0,
          policy: str = "halt", size: int = 32, mode: str = "strict", docs: DataFrame | None = None) -> Admission:
    """Take candidates in the given order: one is taken if the closure with it is a fixpoint and macro F1 rises by more than epsilon.

    strict: the same as trying one after the other. The next `size` candidates are tried at once on the program so far; up
    to the first that qualifies the verdicts are final, as the program did not change; after it the rest is tried again.
    So there is a batch for each rule taken, and one for each `size` candidates; where candidates are separable, only the latter.
    prefilter: an approximation. What fails against the program at the start of its batch is not tried again; the others
    are committed in order, and tried again alone if the program changed since.
    """
    if mode not in ("strict", "prefilter"):
        raise ValueError(f"unknown mode {mode}")
    taken: list[int] = []
    rules = list(prefix or [])
    now = close_program(cat, rules, policy)
    if now.status != "fixpoint":
        raise ValueError("the prefix has no fixpoint")
    if mode == "strict" and separable(rules, candidates):
        got = _admit_separable(cat, candidates, order, truth, labels, rules, now, epsilon, policy, size, docs)
        if got is not None:
            return got
    runs, at, macro = 0, 0, None
    trace: list[tuple[int, bool, float]] = []

    def tried(block: list[int]) -> dict[int, tuple[float, float]]:
        nonlocal runs, macro
        runs += 1
        scores = batch_scores(close_batch(cat, rules, [candidates[i] for i in block], now, policy), truth, labels, docs).collect()  # a row a candidate
        if macro is None and scores:
            macro = next((r["macro_f1"] - r["gain"] for r in scores if r["gain"] is not None), None)
        return {block[r["run"]]: (r["gain"], r["macro_f1"]) for r in scores if r["gain"] is not None and r["gain"] > epsilon}

    def take(i: int, score: float) -> None:
        nonlocal now, macro
        now = extend(cat, rules, now, candidates[i], policy)
        rules.append(candidates[i])
        taken.append(i)
        macro = score

    while at < len(order):
        block = order[at : at + size]
        good = tried(block)
        if mode == "strict":
            first = next((k for k, i in enumerate(block) if i in good), None)
            trace += [(i, False, macro or 0.0) for i in block[:first]]
            if first is not None:
                take(block[first], good[block[first]][1])
                trace.append((block[first], True, macro))
            at += len(block) if first is None else first + 1
            continue
        fresh = True
        for i in (i for i in block if i in good):
            again = good if fresh else tried([i])
            if i in again:
                take(i, again[i][1])
                fresh = False
        at += len(block)
    return Admission(taken, macro or 0.0, runs, lambda: now, trace)
