"""Rule search by a tree-structured density over configurations, conditioned on fit witnesses; trials are scored in batches of closures.

A configuration is drawn along a tree: head, then model and guard given the head, then the cut given head and model. At each
node the density of good trials starts from the witnesses (what F1 the fit documents give each choice) and that of the
others from the uniform one; both add the trials so far. The draw of largest ratio is proposed. One proposal in `broad` is
uniform, so no configuration is ruled out. The densities live on the driver: they have a number for each choice, never one for a row.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from marlstone.operators.batch import batch_scores, close_batch
from marlstone.operators.closure import Closure
from marlstone.operators.space import Space
from marlstone.plans.compile import Catalog
from marlstone.plans.rules import Rule

Config = tuple[str, tuple[str, str], str | None, float]  # head, model, guard, cut


def as_rule(space: Space, c: Config) -> Rule:
    head, model, guard, cut = c
    return space.instantiate({"head": head, "cuts": {model: cut}, "guards": {} if guard is None else {guard: {}}})


def prior_of(found: DataFrame) -> dict[Config, float]:
    """F1 by configuration from space.witnesses: a row a head, model, guard and cut."""
    return {(r["head"], (r["alias"], r["label"]), r["guard"], r["cut"]): r["f1"] for r in found.collect()}


@dataclass
class TreeSampler:
    """weight: what the prior counts against trials. good: the share of best trials. draws: candidates a proposal."""

    space: Space
    prior: dict[Config, float]
    seed: int = 0
    good: float = 0.25
    draws: int = 32
    broad: int = 4
    weight: float = 4.0
    history: list[tuple[Config, float]] = field(default_factory=list)

    def choices(self, head: str | None = None, model: tuple[str, str] | None = None) -> list:
        """Of the tree's next node: heads, (model, guard) of a head, or cuts of a head and model."""
        if head is None:
            return sorted(self.space.labels)
        if model is None:
            return [(m, g) for m in sorted(self.space.models) for g in (None, *sorted(self.space.guards))]
        return sorted(self.space.cuts)

    def density(self, trials: list[Config], informed: bool, head: str | None = None, model: tuple[str, str] | None = None) -> dict:
        """Probability of each choice at a node: the prior's share times its weight, and a count for each trial that went there."""
        def at(c: Config):
            return c[0] if head is None else (c[1], c[2]) if model is None else c[3]

        here = lambda c: (head is None or c[0] == head) and (model is None or c[1] == model)
        options = self.choices(head, model)
        mass = dict.fromkeys(options, 1e-3)
        for c, f in self.prior.items():
            if informed and here(c) and at(c) in mass:
                mass[at(c)] = max(mass[at(c)], f)
        if not informed:
            mass = dict.fromkeys(options, 1.0)
        whole = sum(mass.values())
        count = {o: self.weight * m / whole for o, m in mass.items()}
        for c in trials:
            if here(c) and at(c) in count:
                count[at(c)] += 1
        whole = sum(count.values())
        return {o: n / whole for o, n in count.items()}

    def propose(self, size: int = 1) -> list[Config]:
        """The next configurations, none tried or proposed before; fewer, if there are no others."""
        rnd = random.Random(self.seed * 1_000_003 + len(self.history))
        ranked = sorted(self.history, key=lambda t: -t[1])
        k = max(1, math.ceil(self.good * len(ranked))) if ranked else 0
        best, rest = [c for c, _ in ranked[:k]], [c for c, _ in ranked[k:]]
        seen, out = {c for c, _ in self.history}, []
        total = len(self.space.labels) * len(self.space.models) * (1 + len(self.space.guards)) * len(self.space.cuts)
        while len(out) < size and len(seen) < total:
            wide = (len(self.history) + len(out)) % self.broad == self.broad - 1
            drawn: dict[Config, float] = {}
            for _ in range(self.draws):
                ratio, path = 0.0, []
                for _ in range(3):
                    g = self.density(best, True, *path[:1], *([path[1][0]] if len(path) > 1 else []))
                    r = self.density(rest, False, *path[:1], *([path[1][0]] if len(path) > 1 else []))
                    pick = rnd.choice([*g]) if wide else rnd.choices([*g], [*g.values()])[0]
                    ratio += math.log(g[pick] / r[pick])
                    path.append(pick)
                c = (path[0], path[1][0], path[1][1], path[2])
                if c not in seen:
                    drawn[c] = 0.0 if wide else ratio
            if drawn:
                pick = next(iter(drawn)) if wide else max(drawn, key=lambda c: (drawn[c], str(c)))
            else:  # what draws do not reach any more
                pick = rnd.choice([c for c in self.everything() if c not in seen])
            seen.add(pick)
            out.append(pick)
        return out

    def everything(self) -> list[Config]:
        return [(h, m, g, c) for h in self.choices() for m, g in self.choices(h) for c in self.choices(h, m)]

    def tell(self, trials: list[tuple[Config, float]]) -> None:
        self.history += trials


def search(cat: Catalog, space: Space, sampler: TreeSampler, program: list[Rule], base: Closure, truth: DataFrame, labels: DataFrame, trials: int, size: int = 16, policy: str = "halt", docs: DataFrame | None = None) -> list[tuple[Config, float]]:
    """`trials` configurations on top of a program, by gain of macro F1, best first; each batch of `size` is one fixpoint. A conflict scores -1."""
    while len(sampler.history) < trials:
        asked = sampler.propose(min(size, trials - len(sampler.history)))
        if not asked:
            break
        b = close_batch(cat, program, [as_rule(space, c) for c in asked], base, policy)
        gain = {r["run"]: r["gain"] for r in batch_scores(b, truth, labels, docs).collect()}  # a row a trial
        sampler.tell([(c, gain[i] if gain.get(i) is not None else -1.0) for i, c in enumerate(asked)])
    return sorted(sampler.history, key=lambda t: (-t[1], str(t[0])))
