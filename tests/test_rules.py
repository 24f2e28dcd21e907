"""The rule language: forms, JSON, ablations and counts."""

import json

import pytest

from marlstone.plans import rules as R
from marlstone.plans.rules import ML, AttrEqual, Doc, Label, LabelCompare, Pattern, Predicate, Rule, Text

RIPE = Label("p", "ripe")
SWEET = Text("p", Predicate("match", "cnt", Pattern(r"sw(ee|ea)t", 2)))
SCAN = ML("p", "scanner", "ripe", 0.35)
SHADE = Text("p", Predicate("freq", "ttl", Pattern("shade"), op="!=", eta=3))
NEXT = (Doc("p"), Doc("q"), AttrEqual("p", "mtd.row", "q", "mtd.row"))

PROGRAM = {
    "by scan": Rule((Doc("p"), SCAN), RIPE),
    "by band": Rule((Doc("p"), ML("p", "scanner", "ripe", 0.2, upper=0.4), ML("p", "nose", "ripe", 0.9, False)), Label("p", "ripe", "neg")),
    "by words": Rule((Doc("p"), SWEET, SHADE), RIPE),
    "words and scan": Rule((Doc("p"), SCAN, SWEET), RIPE),
    "from state": Rule((Doc("p"), Label("p", "picked", "neg")), RIPE),
    "from row": Rule((*NEXT, Label("q", "ripe")), RIPE),
    "same row": Rule((*NEXT, SWEET), LabelCompare("p", "strict_subset", "q")),
    "order of words": Rule((Doc("p"), Text("p", Predicate("before", "mtd", Pattern("bud"), Pattern("fruit"))), Text("p", Predicate("cooccur", "cnt", Pattern("a"), Pattern("b")))), RIPE),
}


@pytest.mark.parametrize("name", PROGRAM)
def test_json_and_back(name):
    one = PROGRAM[name]
    assert R.rule_from(json.loads(json.dumps(R.rule_to(one)))) == one


def test_program_file():
    labels, rules = R.read_program(R.write_program(["ripe", "picked"], [*PROGRAM.values()]))
    assert labels == ["ripe", "picked"] and rules == [*PROGRAM.values()]


@pytest.mark.parametrize("make", [
    lambda: Rule((Doc("p"), Label("q", "ripe")), RIPE),  # q is not bound
    lambda: Rule((Doc("p"), Doc("p")), RIPE),  # bound twice
    lambda: Rule((Doc("p"),), SCAN),  # a model cannot be concluded
    lambda: Predicate("match", "body", Pattern("x")),  # no such attribute
    lambda: Predicate("before", "cnt", Pattern("x")),  # needs two patterns
    lambda: Predicate("freq", "cnt", Pattern("x"), op="~"),
    lambda: Predicate("freq", "cnt", Pattern("x"), negate=True),  # only a match is negated
    lambda: R.atom_from({"type": "LabelCompare", "left_var": "p", "op": "disjoint", "right_var": "q"}),
    lambda: R.rule_from({"schema": "none", "body": [], "head": R.atom_to(RIPE)}),
    lambda: R.rule_from({"body": [R.atom_to(Doc("p")), {"type": "Text", "var": "p", "predicate": {"type": "MatchPredicate", "attr": "cnt", "r": {"raw": "x"}, "sim": True}}], "head": R.atom_to(RIPE)}),
])
def test_what_is_not_a_rule(make):
    with pytest.raises(ValueError):
        make()


def test_forms():
    assert R.form_errors(PROGRAM["from row"]) == [] == R.form_errors(PROGRAM["same row"])
    assert len(R.form_errors(Rule((*NEXT, SWEET), RIPE))) == 1  # links plants but knows none of their states
    assert len(R.form_errors(Rule((Doc("p"), Doc("q"), SWEET, Label("q", "ripe")), RIPE))) == 1  # p and q have nothing to do with each other
    assert len(R.form_errors(PROGRAM["by scan"])) == 1 and R.form_errors(PROGRAM["words and scan"]) == []  # a model beside no text


def test_ablations_keep_what_they_say():
    left = lambda variant: {n for n, r in PROGRAM.items() if R.transform([r], variant)}
    assert left("full") == set(PROGRAM)
    assert left("pure_ml") == {"by scan", "by band"}
    assert left("no_text") == {"by scan", "by band", "from state", "from row"}
    assert left("no_label") == set(PROGRAM) - {"from state", "from row"}  # a relation that is concluded is no premise
    assert left("no_ground") == set(PROGRAM) and R.transform([PROGRAM["words and scan"]], "no_ground") == [PROGRAM["by scan"]]
    with pytest.raises(ValueError):
        R.transform([], "half")


def test_families_and_counts():
    assert {n: R.family(r) for n, r in PROGRAM.items()} == {
        "by scan": "single_model", "by band": "multi_model", "by words": "text", "words and scan": "model_text", "from state": "label_propagation",
        "from row": "cross_document", "same row": "cross_document", "order of words": "text"}
    free = Rule((Doc("p"), ML("p", "scanner", "ripe", 0.0), SWEET), RIPE)
    assert R.statistics([PROGRAM["by band"], free])[0]["ml"] == 2 and R.statistics([free])[0]["free"] == 1


def test_patterns_for_java():
    assert Pattern("x", 2 | 32).java() == "(?iU)x" and Pattern("x").java() == "(?U)x"
