"""Staged discovery: changes of a program are proposed by kind and accepted on two splits at once, whole steps in one batch of closures.

A change adds rules and removes others. It is accepted if macro F1 falls on neither split and micro F1 on neither by more than a
tolerance below the start, by the mean gain of .8 macro + .2 micro on the two, plus a little for each family of
rules that comes to have facts of its own. All changes of a step, and the families of those that pass, are closed as one batch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.batch import Batch, Firings, batch_scores, close_programs
from marlstone.operators.closure import Closure, close_program
from marlstone.operators.metrics import confusion
from marlstone.plans.compile import Catalog
from marlstone.plans.rules import ML, Label, Predicate, Rule, Text, family
from marlstone.plans.store import written

KINDS = ("union", "replace", "rescue", "partition")
CELL = ["doc_id", "label"]


@dataclass(frozen=True)
class Change:
    """kind: union adds, replace swaps for a rule of the same head, rescue adds for documents nothing predicts, partition splits a rule by a guard."""

    kind: str
    add: tuple[Rule, ...]
    remove: tuple[Rule, ...] = ()

    def apply(self, program: list[Rule]) -> list[Rule] | None:
        """The changed program, or None if it has not what the change removes or has what it adds."""
        if any(r not in program for r in self.remove) or any(r in program for r in self.add):
            return None
        return [*[r for r in program if r not in self.remove], *self.add]


@dataclass
class Accepted:
    """program, and for each step the change, its value, and macro F1 on the two splits after it."""

    program: list[Rule]
    trace: list[tuple[Change, float, float, float]] = field(default_factory=list)


def proposals(program: list[Rule], candidates: list[Rule], guards: list[Predicate], kinds: tuple[str, ...] = KINDS) -> list[Change]:
    """Changes by kind: every candidate alone (union; rescue, if its body has a guard), in place of each rule of its head and family (replace), and each
    rule with a model cut as two, with the guard and with its complement, of which one keeps its cut and the other has any of the candidates' for the model (partition)."""
    out: list[Change] = []
    fresh = [c for c in dict.fromkeys(candidates) if c not in program]
    guarded = lambda r: any(isinstance(a, Text) for a in r.body)
    out += [Change("union", (c,)) for c in fresh if not guarded(c) and "union" in kinds]
    out += [Change("rescue", (c,)) for c in fresh if guarded(c) and "rescue" in kinds]
    if "replace" in kinds:
        out += [Change("replace", (c,), (r,)) for r in program for c in fresh if c.head == r.head and family(c) == family(r)]
    if "partition" in kinds:
        for r in program:
            cuts = [a for a in r.body if isinstance(a, ML)]
            if len(cuts) != 1 or guarded(r):
                continue
            own = cuts[0]
            other = sorted({a.eta for c in fresh if c.head == r.head for a in c.body if isinstance(a, ML) and (a.alias, a.label) == (own.alias, own.label)} | {own.eta})
            for g in (g for g in guards if g.type == "match"):
                with_it, without = Text(own.var, g), Text(own.var, Predicate(**{**g.__dict__, "negate": not g.negate}))
                for eta in other:
                    moved = tuple(ML(own.var, own.alias, own.label, eta, own.dynamic) if a == own else a for a in r.body)
                    out += [Change("partition", (Rule((*r.body, a), r.head), Rule((*moved, b), r.head)), (r,)) for a, b in ((with_it, without), (without, with_it))]
    return list(dict.fromkeys(out))


def objective(macro: float, micro: float) -> float:
    return 0.8 * macro + 0.2 * micro


def _own_families(cat: Catalog, programs: dict[int, list[Rule]], split: DataFrame, policy: str, fired: Firings) -> dict[int, set[str]]:
    """For each program its families whose absence loses a fact of the split's documents; one batch."""
    asked: list[tuple[int, str | None, list[Rule]]] = []
    for i, p in programs.items():
        asked.append((i, None, p))
        asked += [(i, f, [r for r in p if family(r) != f]) for f in sorted({family(r) for r in p})]
    b = close_programs(cat, [p for *_, p in asked], policy, fired=fired)
    number = cat.docs.sparkSession.createDataFrame([(k, i, f) for k, (i, f, _) in enumerate(asked)], "run long, program int, family string")
    own = b.own.join(split.select("doc_id").distinct(), "doc_id", "left_semi").join(F.broadcast(number), "run").drop("run")  # a row a run
    families = number.where("family is not null").select("program", "family").join(b.status.join(number, "run").where("family is null and status = 'fixpoint'").select("program"), "program")
    whole = own.where("family is null").drop("family").join(families, "program")
    lost = whole.join(own.where("family is not null"), ["program", "family", *CELL, "sign"], "left_anti").select("program", "family").distinct()
    out: dict[int, set[str]] = {i: set() for i in programs}
    for r in lost.collect():  # programs times families
        out[r["program"]].add(r["family"])
    return out


class _Tally:
    """Programs of rules without label premises, which need no closure of their own: a table of how many cells each set of rules concludes.

    What a program adds to the roots is what its rules conclude, so its scores and clashes are sums over the sets that share a rule with it. The table is
    made once for all rules that are tried; documents are not read again.
    """

    def __init__(self, cat: Catalog, rules: list[Rule], base: Closure, truth: DataFrame, labels: DataFrame, splits: list[DataFrame], policy: str, fired: Firings):
        self.spark, self.n = cat.docs.sparkSession, len(splits)
        shared = base.facts.select(*CELL, "sign").distinct()
        made = fired.of(cat, rules, shared)
        self.numbers = fired.numbers
        side = lambda s: F.array_sort(F.collect_set(F.when(F.col("sign") == s, F.col("rule"))))
        roots = shared.groupBy(*CELL).agg(F.max(F.col("sign") > 0).alias("sp"), F.max(F.col("sign") < 0).alias("sn"))
        x = made.groupBy(*CELL).agg(side(1).alias("pos"), side(-1).alias("neg")).join(base.unknown, CELL, "left_anti").join(roots, CELL, "left").na.fill(False, ["sp", "sn"])
        kept = lambda name, known: F.when(known, F.array().cast("array<int>")).otherwise(F.col(name)).alias(name)
        guarded = F.lit(policy == "protect")
        x = x.select(*CELL, kept("pos", F.col("sp") | (guarded & F.col("sn"))), kept("neg", F.col("sn") | (guarded & F.col("sp"))), "sp", "sn")
        flag = lambda df, on, name: x.join(df.select(*on).distinct().withColumn(name, F.lit(True)), on, "left").na.fill(False, [name])
        x = flag(truth, CELL, "t")
        x = flag(labels, ["label"], "seen")
        for k, split in enumerate(splits):
            x = flag(split, ["doc_id"], f"s{k}")
        self.table = written(x.groupBy("label", "pos", "neg", "sp", "sn", "t", "seen", *[f"s{k}" for k in range(self.n)]).agg(F.count(F.lit(1)).alias("n")), "tally")
        self.counts = []
        for split in splits:
            mine = lambda df, split=split: df.join(split.select("doc_id").distinct(), "doc_id", "left_semi")
            now = confusion(mine(shared.where("sign > 0").select(*CELL)), mine(truth.select(*CELL).distinct()), labels)
            self.counts.append({r["label"]: (r["tp"], r["fp"], r["fn"]) for r in now.collect()})  # labels

    def _of(self, programs: list[tuple[list[Rule], list[Rule]]]) -> DataFrame:
        """run, the table's columns, y and d (whether the run's program affirms and denies), z and w (the same of the program beside it)."""
        rows = self.spark.createDataFrame([(i, *[[self.numbers[r] for r in p] for p in two]) for i, two in enumerate(programs)], "run int, rules array<int>, other array<int>")
        has = lambda a, b: F.coalesce(F.arrays_overlap(a, b), F.lit(False))
        return self.table.crossJoin(F.broadcast(rows)).withColumns({"y": has("pos", "rules"), "d": has("neg", "rules"), "z": has("pos", "other"), "w": has("neg", "other")})  # programs of a step

    def scores(self, programs: list[list[Rule]]) -> tuple[list[dict[int, tuple[float, float]]], set[int]]:
        """For each split (macro, micro) by program without a clash, and the programs that predict on the splits what the first does."""
        y, d, t, n = F.col("y"), F.col("d"), F.col("t"), F.col("n")
        total = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0))
        inside = F.lit(False)
        sums = []
        for k in range(self.n):
            inside = inside | F.col(f"s{k}")
            sums += [total(y & F.col("seen") & F.col(f"s{k}") & t).alias(f"a{k}"), total(y & F.col("seen") & F.col(f"s{k}") & ~t).alias(f"b{k}")]
        rows = self._of([(p, programs[0]) for p in programs]).groupBy("run", "label").agg(*sums, total((y & (F.col("sn") | d)) | (d & F.col("sp"))).alias("clash"), total(inside & (y != F.col("z"))).alias("moved")).collect()  # programs times labels
        clash, moved = ({r["run"] for r in rows if r[c]} for c in ("clash", "moved"))
        f = lambda tp, fp, fn: 2.0 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else 0.0
        out = []
        for k, counts in enumerate(self.counts):
            add = {(r["run"], r["label"]): (r[f"a{k}"], r[f"b{k}"]) for r in rows}
            one = {}
            for i in (i for i in range(len(programs)) if i not in clash):
                c = [(tp + a, fp + b, fn - a) for x, (tp, fp, fn) in counts.items() for a, b in [add.get((i, x), (0, 0))]]
                one[i] = (sum(f(*x) for x in c) / len(c), f(*map(sum, zip(*c, strict=True))))
            out.append(one)
        return out, set(range(len(programs))) - moved

    def families(self, programs: dict[int, list[Rule]], split: int) -> dict[int, set[str]]:
        """As _own_families."""
        asked = [(i, f, p, [r for r in p if family(r) != f]) for i, p in programs.items() for f in sorted({family(r) for r in p})]
        out: dict[int, set[str]] = {i: set() for i in programs}
        if asked:
            rows = self._of([(p, less) for *_, p, less in asked]).where(F.col(f"s{split}") & ((F.col("y") & ~F.col("z")) | (F.col("d") & ~F.col("w")))).select("run").distinct()
            for r in rows.collect():  # programs times families
                out[asked[r["run"]][0]].add(asked[r["run"]][1])
        return out


def _tally(cat: Catalog, rules: list[Rule], truth: DataFrame, labels: DataFrame, splits: list[DataFrame], policy: str, fired: Firings) -> _Tally | None:
    """The tally of these rules; None if some read labels, or the roots have no fixpoint."""
    rules = list(dict.fromkeys(rules))
    if not rules or any(r.reads() or not isinstance(r.head, Label) for r in rules):
        return None
    base = close_program(cat, [], policy)
    return _Tally(cat, rules, base, truth, labels, splits, policy, fired) if base.status == "fixpoint" else None


def accept(cat: Catalog, program: list[Rule], changes: list[Change], truth: DataFrame, labels: DataFrame, grow: DataFrame, prune: DataFrame, policy: str = "halt",
           diverse: bool = True, micro_tolerance: float = 0.002, novelty: float = 0.00025, most: int = 50, fired: Firings | None = None) -> Accepted:
    """Take the change of largest value, again and again, until none has one above 0. grow, prune: the documents (doc_id) of the two splits.

    Ties: macro F1 on prune, on grow, fewer rules, the changes' order. A change that alters no prediction is not taken.
    """
    out, left, near = Accepted(list(program)), list(changes), 1e-12
    fired = fired or Firings()

    def scores(b: Batch, split: DataFrame) -> dict[int, tuple[float, float]]:
        return {r["run"]: (r["macro_f1"], r["micro_f1"]) for r in batch_scores(b, truth, labels, split).where("status = 'fixpoint'").collect()}  # a row a change

    def closed(programs: list[list[Rule]]) -> tuple[dict, dict, set[int]]:
        """Scores on both splits, and the programs that predict on them what the first does, by a batch of closures."""
        b = close_programs(cat, programs, policy, fired=fired)
        b.own = written(b.own, "own")
        g, v = scores(b, grow), scores(b, prune)
        split = grow.select("doc_id").unionByName(prune.select("doc_id")).distinct()
        base = b.own.where("run = 0").drop("run")
        scoped = b.own.where("run > 0 and sign > 0").join(split, "doc_id", "left_semi")
        runs = b.status.select("run").where("run > 0")
        size = base.where("sign > 0").join(split, "doc_id", "left_semi").count()
        shared = scoped.join(base, [*CELL, "sign"], "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("k"))
        total = scoped.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
        alike = {r["run"] for r in runs.join(total, "run", "left").join(shared, "run", "left").na.fill(0).where((F.col("n") == size) & (F.col("k") == size)).collect()}
        return g, v, alike

    tally = _tally(cat, [*program, *[r for c in changes for r in c.add]], truth, labels, [grow, prune], policy, fired)
    start = None
    while left and len(out.trace) < most:
        made = [(c, p) for c in left if (p := c.apply(out.program)) is not None]
        if tally is not None:
            (g, v), alike = tally.scores([out.program, *[p for _, p in made]])
        else:
            g, v, alike = closed([out.program, *[p for _, p in made]])
        if 0 not in g:
            raise ValueError("the program has no fixpoint")
        start = start or (g[0][1], v[0][1])
        passing = {}
        for k in range(1, len(made) + 1):
            if k not in g or k not in v or k in alike:
                continue
            (gm, gu), (vm, vu) = g[k], v[k]
            if gm < g[0][0] - near or vm < v[0][0] - near or gu < start[0] - micro_tolerance - near or vu < start[1] - micro_tolerance - near:
                continue
            gain = 0.5 * (objective(gm, gu) - objective(*g[0]) + objective(vm, vu) - objective(*v[0]))
            if gain >= -near:
                passing[k] = gain
        if diverse and passing:
            tried = {0: out.program} | {k: made[k - 1][1] for k in passing}
            families = tally.families(tried, 1) if tally is not None else _own_families(cat, tried, prune, policy, fired)
            passing = {k: x + novelty * len(families[k] - families[0]) for k, x in passing.items()}
        good = {k: x for k, x in passing.items() if x > near}
        if not good:
            break
        k = max(good, key=lambda k: (round(good[k], 12), round(v[k][0], 12), round(g[k][0], 12), -len(made[k - 1][1]), -k))
        change, out.program = made[k - 1]
        out.trace.append((change, good[k], g[k][0], v[k][0]))
        left.remove(change)
    return out


def discover(cat: Catalog, candidates: list[Rule], guards: list[Predicate], truth: DataFrame, labels: DataFrame, grow: DataFrame, prune: DataFrame, program: list[Rule] | None = None,
             policy: str = "halt", stages: tuple[tuple[str, ...], ...] = (("union",), ("rescue",), ("replace", "partition")), diverse: bool = True) -> Accepted:
    """The stages one after the other, each proposing changes of its kinds to the program so far; at the end rules that nothing loses go, last first.

    The result is closed once more on its own, and must be what the batches said.
    """
    out, fired = Accepted(list(program or [])), Firings()
    for kinds in stages:
        step = accept(cat, out.program, proposals(out.program, candidates, guards, kinds), truth, labels, grow, prune, policy, diverse, fired=fired)
        out.program, out.trace = step.program, out.trace + step.trace
    out.program = prune_program(cat, out.program, truth, labels, prune, policy, fired)
    last = close_programs(cat, [out.program], policy)
    again = close_program(cat, out.program, policy)
    fact = [*CELL, "sign"]
    if again.status != "fixpoint" or not last.facts(0).exceptAll(again.facts.select(*fact)).isEmpty() or not again.facts.select(*fact).exceptAll(last.facts(0)).isEmpty():
        raise RuntimeError("the batch and the closure of the program differ")
    return out


def prune_program(cat: Catalog, program: list[Rule], truth: DataFrame, labels: DataFrame, split: DataFrame, policy: str = "halt", fired: Firings | None = None) -> list[Rule]:
    """The program without rules whose absence lowers neither F1 on the split: the last such rule goes, then all are tried again; a batch for each that goes."""
    kept, near, fired = list(program), 1e-12, fired or Firings()
    tally = _tally(cat, kept, truth, labels, [split], policy, fired)
    while kept:
        tried = [kept, *[[x for x in kept if x is not r] for r in reversed(kept)]]
        if tally is not None:
            s = tally.scores(tried)[0][0]
        else:
            s = {r["run"]: (r["macro_f1"], r["micro_f1"]) for r in batch_scores(close_programs(cat, tried, policy, fired=fired), truth, labels, split).where("status = 'fixpoint'").collect()}  # a row a rule
        k = next((k for k in range(1, len(tried)) if k in s and s[k][0] >= s[0][0] - near and s[k][1] >= s[0][1] - near), None)
        if k is None:
            return kept
        kept = tried[k]
    return kept
