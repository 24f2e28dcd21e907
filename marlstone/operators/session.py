"""Closures kept by what they were computed from, prefix reuse, rules that cannot fire, and dependencies of rules."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.closure import Closure, advance, close_program
from marlstone.plans.compile import Catalog, fire
from marlstone.plans.rules import Label, LabelCompare, Rule, rule_to
from marlstone.plans.store import dropped, written


def rule_key(rule: Rule) -> str:
    """SHA-256 of the rule's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(rule_to(rule), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def distinct_rules(rules: list[Rule]) -> list[Rule]:
    """The rules in order, each once."""
    first: dict[str, Rule] = {}
    for r in rules:
        first.setdefault(rule_key(r), r)
    return [*first.values()]


def table_key(df: DataFrame | None) -> str:
    """Count and two sums of row hashes: the same for the same rows in any order."""
    if df is None:
        return "-"
    h = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    g = F.xxhash64(*sorted(df.columns), F.lit(1)).cast("decimal(38,0)")
    return "/".join(str(x) for x in df.agg(F.count(F.lit(1)), F.sum(h), F.sum(g)).first())


class Session:
    """Closures over one catalog. A program that was run is not run again; one that extends it, all heads positive, starts from its facts."""

    def __init__(self, cat: Catalog, policy: str = "halt"):
        self.cat, self.policy = cat, policy
        self.kept: dict[tuple, Closure] = {}
        self.runs = 0

    def _key(self, rules: list[Rule]) -> tuple:
        return tuple(rule_key(r) for r in rules)

    def close(self, rules: list[Rule]) -> Closure:
        key = self._key(rules)
        if key in self.kept:
            return self.kept[key]
        monotone = self.cat.relations is None and all(isinstance(r.head, Label) and r.head.sign > 0 and not any(isinstance(a, LabelCompare) for a in r.body) for r in rules)
        start = max((k for k in self.kept if key[: len(k)] == k and self.kept[k].status == "fixpoint"), key=len, default=()) if monotone else ()
        self.runs += 1
        if start:
            base = self.kept[start]
            c = close_program(self.cat, rules, self.policy, roots=base.facts, first=set(range(len(start), len(rules))))
            # The prefix's firings and blocked facts are part of the closure; its rounds came first.
            c.firings = base.firings.unionByName(c.firings.withColumn("round", F.col("round") + base.rounds))
            c.blocked, c.rounds = base.blocked.unionByName(c.blocked).distinct(), base.rounds + c.rounds
        else:
            c = close_program(self.cat, rules, self.policy)
        self.kept[key] = c
        return c


@dataclass
class Fork:
    """A change that is closed but not in the log. status: fixpoint, conflict or max_rounds."""

    parent: int
    origin: str
    status: str
    rounds: int
    docs: DataFrame | None
    roots: DataFrame
    added: DataFrame


class FactLog:
    """A closed program's facts in versions, each holding what it added: documents, roots and what followed from them.

    A fork closes a change on top of a version by deltas and leaves the log as it is; commit appends it, rollback removes its
    tables. revert goes back to an older version. Policies are halt and protect, without label-set relations.
    """

    def __init__(self, cat: Catalog, rules: list[Rule], policy: str = "halt"):
        first = close_program(cat, rules, policy)
        if first.status != "fixpoint" or first.relation is not None or policy not in ("halt", "protect"):
            raise ValueError(f"a log starts at a fixpoint without label-set relations, under halt or protect; this is {first.status}")
        self.cat, self.rules, self.policy = cat, rules, policy
        roots = cat.gamma.select("doc_id", "label", F.col("sign").cast("int").alias("sign")).distinct()
        self.log = [Fork(-1, "start", "fixpoint", first.rounds, None, roots, written(first.facts.select("doc_id", "label", "sign"), "version"))]

    @property
    def head(self) -> int:
        return len(self.log) - 1

    def _until(self, version: int | None) -> list[Fork]:
        return self.log[: (self.head if version is None else version) + 1]

    def catalog(self, version: int | None = None) -> Catalog:
        """The documents and validated facts of a version."""
        past = self._until(version)[1:]
        docs = reduce(DataFrame.unionByName, [f.docs for f in past if f.docs is not None], self.cat.docs)
        return replace(self.cat, docs=docs, gamma=reduce(DataFrame.unionByName, [f.roots for f in self._until(version)]).distinct())

    def facts(self, version: int | None = None) -> DataFrame:
        """doc_id, label, sign, version in which the fact came, and that version's origin."""
        return reduce(DataFrame.unionByName, [f.added.select("doc_id", "label", "sign", F.lit(i).alias("version"), F.lit(f.origin).alias("origin")) for i, f in enumerate(self._until(version))])

    def fork(self, roots: DataFrame | None = None, docs: DataFrame | None = None, origin: str = "", model_prob: DataFrame | None = None) -> Fork:
        """Close further validated facts and documents, with their model probabilities, on the head."""
        now = self.catalog()
        fact = ["doc_id", "label", "sign"]
        new = now.gamma.where("false") if roots is None else roots.select("doc_id", "label", F.col("sign").cast("int").alias("sign")).distinct()
        new = written(new.join(now.gamma, fact, "left_anti"), "roots")
        docs = None if docs is None else written(docs, "docs")
        grown = replace(now, docs=now.docs if docs is None else now.docs.unionByName(docs), gamma=now.gamma.unionByName(new))
        if model_prob is not None:
            grown = replace(grown, model_prob=model_prob if now.model_prob is None else now.model_prob.unionByName(model_prob))
        step = advance(grown, self.rules, self.facts().select(*fact), docs, new, self.policy)
        return Fork(self.head, origin, step.status, step.rounds, docs, new, written(step.added, "version"))

    def commit(self, fork: Fork) -> int:
        """The fork as the next version. A fork that is no fixpoint, or was made on another version than the head, is not taken."""
        if fork.status != "fixpoint":
            raise ValueError(f"a {fork.status} is not committed")
        if fork.parent != self.head:
            raise ValueError(f"the fork is of version {fork.parent}, the head is {self.head}")
        self.log.append(fork)
        return self.head

    def rollback(self, fork: Fork) -> None:
        """Remove what a fork has written. The log never held it."""
        if any(f is fork for f in self.log):
            raise ValueError("the fork was committed; revert goes back")
        dropped(*[t for t in (fork.docs, fork.roots, fork.added) if t is not None])

    def revert(self, version: int) -> None:
        """Go back to an older version; later ones are removed."""
        late, self.log = self.log[version + 1 :], self.log[: version + 1]
        for f in late:
            dropped(*[t for t in (f.docs, f.roots, f.added) if t is not None])


def never_fires(cat: Catalog, rules: list[Rule]) -> list[int]:
    """Rules whose body, without its label premises and relations, no documents satisfy: whatever is derived, they add nothing."""
    out = []
    for i, r in enumerate(rules):
        if not isinstance(r.head, Label):
            continue
        static = Rule(tuple(a for a in r.body if not isinstance(a, Label | LabelCompare)), r.head)
        if fire(static, cat, cat.gamma).limit(1).isEmpty():
            out.append(i)
    return out


def dependencies(rules: list[Rule]) -> list[tuple[int, int]]:
    """(i, j): rule j reads a label (or the relation) that rule i concludes."""
    makes = [{r.head.label} if isinstance(r.head, Label) else {"="} for r in rules]
    return [(i, j) for i, m in enumerate(makes) for j, r in enumerate(rules) if m & r.reads()]


def affected(rules: list[Rule], changed: set[int]) -> set[int]:
    """The changed rules and all that depend on them, directly or not."""
    edges, seen, front = dependencies(rules), set(changed), set(changed)
    while front:
        front = {j for i, j in edges if i in front} - seen
        seen |= front
    return seen


def prove(cat: Catalog, rules: list[Rule], kept: Closure, policy: str = "halt") -> dict:
    """Run the chosen program once more from its roots and compare: facts that only one of the two runs has."""
    from marlstone.operators.quality import same_facts

    again = close_program(cat, rules, policy)
    r = same_facts(kept.facts, again.facts).first()
    return {"status": again.status, "only_kept": r["only_a"], "only_again": r["only_b"], "same": r["both"], "equal": r["only_a"] == r["only_b"] == 0 and again.status == kept.status}
