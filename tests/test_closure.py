"""Closures against a plain evaluator of the rules' meaning, on random gardens, and what one can say about single cases.

A garden has plants (documents): what a visitor wrote about one (cnt), its tag (ttl) and its bed (mtd.bed).
"""

import itertools
import random
from dataclasses import replace

import pytest

from marlstone.operators import relations
from marlstone.operators.closure import close_program, extend, insert_roots, local_check, withdraw
from marlstone.operators.proof import certificate, holds, proof_rows
from marlstone.operators.session import Session, affected, dependencies, distinct_rules, never_fires, prove
from marlstone.plans.compile import Catalog
from marlstone.plans.rules import ML, AttrEqual, Doc, Label, LabelCompare, Pattern, Predicate, Rule, Text

GAMMA = "doc_id long, label string, sign int"
POLICIES = ("halt", "protect", "quarantine", "retain", "retain_protect")
STATES = ("wilts", "blooms", "fruits", "sleeps")


class Garden:
    """plants: (cnt, bed). seen: signed facts {(plant, state): sign}. guess: {(plant, model, state, static): p}."""

    def __init__(self, plants, seen=None, guess=None, order=None):
        self.plants, self.seen, self.guess, self.order = plants, seen or {}, guess or {}, order

    def catalog(self, spark, **more):
        docs = spark.createDataFrame([(i, c, f"tag{i}", "", b) for i, (c, b) in enumerate(self.plants)], "doc_id long, cnt string, ttl string, mtd string, mtd_bed string")
        gamma = spark.createDataFrame([(i, s, x) for (i, s), x in self.seen.items()], GAMMA)
        prob = spark.createDataFrame([(i, m, s, p, fixed) for (i, m, s, fixed), p in self.guess.items()], "doc_id long, alias string, label string, p double, is_static boolean")
        edges = None if self.order is None else spark.createDataFrame(self.order, "src long, dst long, strict boolean")
        return Catalog(docs, gamma, prob, edges, **more)

    def true(self, atom, at, facts):
        if isinstance(atom, Doc):
            return True
        if isinstance(atom, Label):
            return (at[atom.var], atom.label, atom.sign) in facts
        if isinstance(atom, ML):
            p = self.guess.get((at[atom.var], atom.alias, atom.label, not atom.dynamic))
            return p is not None and p >= atom.eta and (atom.upper is None or p < atom.upper)
        if isinstance(atom, AttrEqual):
            a, b = self.plants[at[atom.left_var]][1], self.plants[at[atom.right_var]][1]
            return bool(a) and a == b
        text = self.plants[at[atom.var]][0]
        return bool(text) and (atom.predicate.pattern.raw in text) != atom.predicate.negate

    def conclusions(self, rules, facts):
        out = set()
        for r in rules:
            for values in itertools.product(range(len(self.plants)), repeat=len(r.bound)):
                at = dict(zip(r.bound, values, strict=True))
                if all(self.true(a, at, facts) for a in r.body):
                    out.add((at[r.head.var], r.head.label, r.head.sign))
        return out

    def run(self, rules, policy):
        """status, facts, unknown cells, by synchronous rounds."""
        roots = {(i, s, x) for (i, s), x in self.seen.items()}
        unknown = set()
        while True:
            facts, status = {f for f in roots if f[:2] not in unknown}, None
            while status is None:
                new = {f for f in self.conclusions(rules, facts) if f[:2] not in unknown} - facts
                if policy in ("protect", "retain_protect"):
                    new = {f for f in new if (*f[:2], -f[2]) not in roots}
                if not new:
                    status = "fixpoint"
                facts |= new
                clash = {f[:2] for f in facts if (*f[:2], -f[2]) in facts}
                if clash and policy.startswith("retain"):
                    unknown |= clash
                    facts = {f for f in facts if f[:2] not in unknown}
                elif clash:
                    status = "conflict"
            if policy != "quarantine" or status == "fixpoint":
                return status, facts, unknown
            unknown |= clash


def said(word, negate=False, var="x"):
    return Text(var, Predicate("match", "cnt", Pattern(word), negate=negate))


def facts(c):
    return {(r.doc_id, r.label, r.sign) for r in c.facts.collect()}


def cells(df):
    return {(r.doc_id, r.label) for r in df.collect()}


def random_garden(rnd, plants=7):
    words = ["dry leaf", "green bud", "red berry", "dry berry", "", None]
    g = Garden([(rnd.choice(words), rnd.choice(["north", "south", "", None])) for _ in range(plants)])
    g.seen = {(rnd.randrange(plants), rnd.choice(STATES)): rnd.choice((1, 1, -1)) for _ in range(3)}
    g.guess = {(i, "eye", s, fixed): rnd.choice((0.2, 0.5, 0.8)) for i in range(plants) for s in STATES[:2] for fixed in (True, False) if rnd.random() < 0.7}
    return g


def random_rules(rnd, n=5, signs=("pos", "pos", "neg")):
    out = []
    for _ in range(n):
        head = Label("x", rnd.choice(STATES), rnd.choice(signs))
        kind = rnd.randrange(4)
        if kind == 0:
            body = (Doc("x"), said(rnd.choice(("dry", "bud", "berry")), rnd.random() < 0.3))
        elif kind == 1:
            body = (Doc("x"), ML("x", "eye", rnd.choice(STATES[:2]), rnd.choice((0.4, 0.7)), rnd.random() < 0.5))
        elif kind == 2:
            body = (Doc("x"), Label("x", rnd.choice(STATES), rnd.choice(("pos", "pos", "neg"))), *([said("e")] if rnd.random() < 0.5 else []))
        else:
            body = (Doc("x"), Doc("y"), AttrEqual("x", "mtd.bed", "y", "mtd.bed"), Label("y", rnd.choice(STATES)), *([said("dry")] if rnd.random() < 0.4 else []))
        out.append(Rule(body, head))
    return out


@pytest.mark.parametrize("seed, policy", [(s, p) for s, p in zip(range(10), POLICIES * 2, strict=True)])
def test_random_gardens(spark, seed, policy):
    rnd = random.Random(100 + seed)
    g, rules = random_garden(rnd), random_rules(rnd)
    status, want, unknown = g.run(rules, policy)
    got = close_program(g.catalog(spark), rules, policy)
    assert got.status == status
    if status == "fixpoint":
        assert facts(got) == want and cells(got.unknown) == unknown


def test_rule_order_changes_nothing(spark):
    rnd = random.Random(7)
    g, rules = random_garden(rnd), random_rules(rnd, 6)
    for policy in ("quarantine", "retain"):
        a, b = (close_program(g.catalog(spark), r, policy) for r in (rules, rules[::-1]))
        assert facts(a) == facts(b) and cells(a.unknown) == cells(b.unknown)


def test_blocked_conclusions_are_counted_by_cell(spark):
    g = Garden([("dry leaf", "north"), ("dry berry", "north"), ("green bud", "south")], {(0, "blooms"): 1, (1, "blooms"): 1})
    rules = [Rule((Doc("x"), said("dry")), Label("x", "blooms", "neg")), Rule((Doc("x"), said("leaf")), Label("x", "blooms", "neg")), Rule((Doc("x"), said("bud")), Label("x", "blooms", "neg"))]
    c = close_program(g.catalog(spark), rules, "protect")
    assert cells(c.blocked) == {(0, "blooms"), (1, "blooms")} and facts(c) == {(0, "blooms", 1), (1, "blooms", 1), (2, "blooms", -1)}


def test_label_sets(spark):
    """x is within y: y gets x's states. Sets that happen to be nested are no relation, and every plant is within itself."""
    g = Garden([("a", "")] * 3, {(0, "fruits"): 1, (1, "fruits"): 1, (1, "sleeps"): 1}, order=[(0, 2, False)])
    r = Rule((Doc("x"), Doc("y"), LabelCompare("x", "subset", "y"), Label("x", "fruits")), Label("y", "wilts"))
    assert facts(close_program(g.catalog(spark), [r])) == {(0, "fruits", 1), (1, "fruits", 1), (1, "sleeps", 1), (2, "fruits", 1), (0, "wilts", 1), (1, "wilts", 1), (2, "wilts", 1)}


def test_beds_that_are_equal(spark):
    g = Garden([("bud", "north"), ("bud", "north"), ("bud", "south"), ("dry", "south")], {(0, "blooms"): 1, (3, "wilts"): 1})
    r = Rule((Doc("x"), Doc("y"), AttrEqual("x", "mtd.bed", "y", "mtd.bed"), said("bud"), said("bud", var="y")), LabelCompare("x", "eq", "y"))
    c = close_program(g.catalog(spark), [r])
    assert facts(c) == {(0, "blooms", 1), (1, "blooms", 1), (3, "wilts", 1)}
    assert {(e.src, e.dst) for e in c.edges.collect() if e.src != e.dst} == {(0, 1), (1, 0)}


def test_strict_inclusion_needs_a_witness(spark):
    full = Garden([("a", "")] * 2, {(0, s): 1 for s in STATES}, order=[(0, 1, True)])
    assert close_program(full.catalog(spark), []).status == "fixpoint"  # the axis is not declared
    assert close_program(full.catalog(spark, labels=STATES), []).status == "conflict"
    # Each edge has a witness of its own, but the two cannot be had together: 0 < 1 < 2 with one state left open.
    tight = Garden([("a", "")] * 3, {(0, s): 1 for s in STATES[:3]}, order=[(0, 1, True), (1, 2, True)])
    assert close_program(tight.catalog(spark, labels=STATES), []).status == "conflict"
    loose = Garden([("a", "")] * 3, {(0, s): 1 for s in STATES[:2]}, order=[(0, 1, True), (1, 2, True)])
    assert close_program(loose.catalog(spark, labels=STATES), []).status == "fixpoint"


def test_relations(spark):
    e = spark.createDataFrame([(1, 2, False), (2, 3, True), (3, 4, False)], "src long, dst long, strict boolean")
    assert {(r.src, r.dst, r.strict) for r in relations.close(e).collect()} == {(1, 2, False), (2, 3, True), (3, 4, False), (1, 3, True), (2, 4, True), (1, 4, True)}
    with pytest.raises(RuntimeError):
        relations.close(e, rounds=1)


# --- changes --------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_changes_are_what_a_new_run_gives(spark, seed):
    rnd = random.Random(40 + seed)
    g = random_garden(rnd)
    g.seen = {k: 1 for k in g.seen}
    rules = random_rules(rnd, 5, ("pos",))
    old = g.catalog(spark)
    before = close_program(old, rules)
    # Other probabilities: what rested on them goes, unless it can be derived otherwise.
    h = Garden(g.plants, g.seen, {k: rnd.choice((0.2, 0.5, 0.8)) for k in g.guess})
    assert facts(withdraw(old, h.catalog(spark), rules, before)) == h.run(rules, "halt")[1]
    # One more rule, and one more root.
    more = random_rules(rnd, 1, ("pos",))[0]
    assert facts(extend(old, rules, before, more)) == g.run([*rules, more], "halt")[1]
    added = {(2, "sleeps"): 1}
    assert facts(insert_roots(old, rules, before, Garden(g.plants, added).catalog(spark).gamma)) == Garden(g.plants, g.seen | added, g.guess).run(rules, "halt")[1]


@pytest.mark.parametrize("seed", range(2))
def test_proofs(spark, seed):
    rnd = random.Random(60 + seed)
    g = random_garden(rnd)
    rules = random_rules(rnd, 5, ("pos",))
    cat = g.catalog(spark)
    c = close_program(cat, rules, "retain")
    rows = proof_rows(cat, rules, c).collect()
    by = {(r.doc_id, r.label, r.sign): r for r in rows}
    assert facts(c) <= set(by) and len(by) == len(rows)
    for r in rows:
        if r.rule_id < 0:
            assert g.seen[r.doc_id, r.label] == r.sign and not r.premises
            continue
        premises = {(p.doc_id, p.label, p.sign) for p in r.premises}
        assert all(by[p].round < r.round for p in premises)  # proofs end in roots
        assert len(premises) <= sum(isinstance(a, Label) for a in rules[r.rule_id].body)
        assert (r.doc_id, r.label, r.sign) in g.conclusions([rules[r.rule_id]], premises)  # the premises alone suffice


def test_certificate_and_validity(spark):
    g = Garden([("dry", "")])
    rules = [Rule((Doc("x"), said("dry")), Label("x", "wilts")), Rule((Doc("x"), Label("x", "wilts")), Label("x", "sleeps")), Rule((Doc("x"), Label("x", "sleeps")), Label("x", "blooms", "neg")), Rule((Doc("x"), said("dry")), Label("x", "blooms")), Rule((Doc("x"), said("dry")), Label("x", "fruits"))]
    cat = g.catalog(spark)
    c = close_program(cat, rules)
    assert c.status == "conflict"
    rows = proof_rows(cat, rules, c)
    got = certificate(rows, spark.createDataFrame([(0, "blooms")], "doc_id long, label string"))
    assert {(r.label, r.sign) for r in got.collect()} == {("blooms", 1), ("blooms", -1), ("sleeps", 1), ("wilts", 1)}
    less = c.facts.where("label <> 'wilts'")
    assert {r.label for r in holds(rows, less).where("not valid").collect()} == {"sleeps"}


def test_session(spark):
    g = Garden([("dry", "north"), ("bud", "north")])
    a, b = Rule((Doc("x"), said("dry")), Label("x", "wilts")), Rule((Doc("x"), Doc("y"), AttrEqual("x", "mtd.bed", "y", "mtd.bed"), Label("y", "wilts")), Label("x", "wilts"))
    s = Session(g.catalog(spark))
    first = s.close([a])
    assert s.close([a]) is first and s.runs == 1
    assert facts(s.close([a, b])) == {(0, "wilts", 1), (1, "wilts", 1)} and s.runs == 2
    assert prove(s.cat, [a, b], s.close([a, b]))["equal"]
    assert not prove(s.cat, [a, b], first)["equal"]
    dead = Rule((Doc("x"), said("cactus"), Label("x", "wilts")), Label("x", "sleeps"))
    assert never_fires(s.cat, [a, b, dead]) == [2]
    assert dependencies([a, b, dead]) == [(0, 1), (0, 2), (1, 1), (1, 2)] and affected([dead, a, b], {1}) == {0, 1, 2}
    assert distinct_rules([a, b, a]) == [a, b]


def test_local_check(spark):
    g = Garden([("dry", "north"), ("bud", "north"), ("dry", "south")])
    r = Rule((Doc("x"), said("dry")), Label("x", "wilts"))
    link = Rule((Doc("x"), Doc("y"), AttrEqual("x", "mtd.bed", "y", "mtd.bed"), Label("y", "wilts")), Label("x", "sleeps"))
    near = local_check(g.catalog(spark), [r, link], spark.createDataFrame([(1,)], "doc_id long"))
    assert facts(near) == {(0, "wilts", 1), (0, "sleeps", 1), (1, "sleeps", 1)}


def test_catalog_is_kept(spark):
    cat = Garden([("dry", "")]).catalog(spark, labels=STATES)
    assert replace(cat, gamma=cat.gamma).labels == STATES
