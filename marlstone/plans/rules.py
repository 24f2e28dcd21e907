"""Typed rules: conjunctive bodies over documents, text, models, attributes, labels and label-set relations.

A rule is a logical plan; plans.compile turns it into a DataFrame. The JSON form is read and written here.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

# Fixed values of the rule format.
SCHEMA = "paper36_explicit_variable_rdl_v1"
OPS = ("==", "!=", "<", "<=", ">", ">=")
RELATIONS = ("eq", "subset", "strict_subset")
TEXT_ATTRS = ("cnt", "ttl", "mtd")
PREDICATES = {"match": "MatchPredicate", "freq": "FreqPredicate", "cooccur": "CooccurPredicate", "before": "BeforePredicate"}
FLAG_BITS = {re.IGNORECASE.value: "i", re.MULTILINE.value: "m", re.DOTALL.value: "s"}
#: A word as it stands, or between bounds as in (^|[^a-z])word([^a-z]|$) and \bword\b.
LITERAL = re.compile(r"(?:\(\^\|\[\^[A-Za-z0-9_-]+\]\)|\\b)?([A-Za-z0-9_]+)(?:\(\[\^[A-Za-z0-9_-]+\]\|\$\)|\\b)?")
#: A word between the ends of the text or characters outside two classes.
WORD = re.compile(r"\(\^\|\[\^([A-Za-z0-9_-]+)\]\)([A-Za-z0-9_]+)\(\[\^([A-Za-z0-9_-]+)\]\|\$\)")
NAMED = re.compile(r"mtd\.[A-Za-z_][A-Za-z_0-9]*")


@dataclass(frozen=True)
class Pattern:
    raw: str
    flags: int = re.UNICODE.value

    def java(self) -> str:
        """The pattern for Java: Unicode classes as in Python, and the flags inline."""
        return "(?" + "".join(c for bit, c in FLAG_BITS.items() if self.flags & bit) + "U)" + self.raw

    def literal(self) -> str | None:
        """A string that every match holds: that of a plain word, with or without bounds. None if case is ignored, and for all other patterns."""
        found = LITERAL.fullmatch(self.raw)
        return found[1] if found and not self.flags & re.IGNORECASE.value else None

    def word(self) -> str | None:
        """A pattern for Java that matches in the same texts, but begins with the word's letters; None if this is not a word that is bounded by classes of characters."""
        found = WORD.fullmatch(self.raw)
        if not found or self.flags & re.IGNORECASE.value:
            return None
        left, text, right = found.groups()
        return f"{text}(?<![{left}]{text})(?![{right}])"


@dataclass(frozen=True)
class Predicate:
    """type: match, freq, cooccur or before; `other` is the second pattern of the last two."""

    type: str
    attr: str
    pattern: Pattern
    other: Pattern | None = None
    op: str = ">="
    eta: float = 1.0
    negate: bool = False

    def __post_init__(self):
        if self.type not in ("match", "freq", "cooccur", "before") or self.attr not in TEXT_ATTRS:
            raise ValueError(f"unknown predicate {self.type} on {self.attr}")
        if (self.type in ("cooccur", "before")) != (self.other is not None) or self.op not in OPS or (self.negate and self.type != "match"):
            raise ValueError(f"bad {self.type} predicate")


@dataclass(frozen=True)
class Doc:
    var: str


@dataclass(frozen=True)
class Label:
    var: str
    label: str
    polarity: str = "pos"

    @property
    def sign(self) -> int:
        return 1 if self.polarity == "pos" else -1


@dataclass(frozen=True)
class Text:
    var: str
    predicate: Predicate


@dataclass(frozen=True)
class ML:
    var: str
    alias: str
    label: str
    eta: float = 0.5
    dynamic: bool = True
    upper: float | None = None  # half-open band [eta, upper)


@dataclass(frozen=True)
class AttrEqual:
    left_var: str
    left_attr: str
    right_var: str
    right_attr: str


@dataclass(frozen=True)
class LabelCompare:
    left_var: str
    op: str
    right_var: str


Atom = Doc | Label | Text | ML | AttrEqual | LabelCompare


def variables(atom: Atom) -> tuple[str, ...]:
    return (atom.left_var, atom.right_var) if isinstance(atom, AttrEqual | LabelCompare) else (atom.var,)


@dataclass(frozen=True)
class Rule:
    body: tuple[Atom, ...]
    head: Label | LabelCompare
    bound: tuple[str, ...] = field(init=False)

    def __post_init__(self):
        docs = [a.var for a in self.body if isinstance(a, Doc)]
        used = {v for a in (*self.body, self.head) for v in variables(a)}
        if len(set(docs)) != len(docs) or used - set(docs):
            raise ValueError(f"variables {sorted(used)} are not each bound once by Doc: {docs}")
        if not isinstance(self.head, Label | LabelCompare):
            raise ValueError("the head is a Label or a LabelCompare")
        object.__setattr__(self, "bound", tuple(docs))

    def reads(self) -> set[str]:
        """What this rule depends on: labels, and `=` for the relation."""
        return {a.label for a in self.body if isinstance(a, Label)} | {"=" for a in self.body if isinstance(a, LabelCompare)}


def _predicate_from(d: dict) -> Predicate:
    if d.get("sim"):
        raise ValueError("similarity text predicates are not allowed in rules")
    p = lambda k: Pattern(d[k]["raw"], int(d[k].get("flags", 32))) if isinstance(d.get(k), dict) else Pattern(d[k]) if d.get(k) else None
    first = p("r") or p("r1")
    kinds = {v: k for k, v in PREDICATES.items()}
    return Predicate(kinds.get(d["type"], d["type"]), d["attr"], first, p("r2"), d.get("op", ">="), float(d.get("eta", 1)), bool(d.get("negate", False)))


def _predicate_to(p: Predicate) -> dict:
    pat = lambda x: {"raw": x.raw, "flags": x.flags}
    out: dict = {"type": PREDICATES[p.type], "attr": p.attr}
    out |= {"r1": pat(p.pattern), "r2": pat(p.other)} if p.other else {"r": pat(p.pattern)}
    if p.type == "freq":
        out |= {"op": p.op, "eta": p.eta}
    return out | ({"negate": p.negate} if p.type == "match" else {})


_KINDS = {c.__name__: c for c in (Doc, Label, Text, ML, AttrEqual, LabelCompare)}


def atom_from(d: dict) -> Atom:
    d = dict(d)
    kind = _KINDS[d.pop("type")]
    if kind is Text:
        return Text(d["var"], _predicate_from(d["predicate"]))
    if kind is LabelCompare and d["op"] not in RELATIONS:
        raise ValueError(f"unknown relation {d['op']}")
    return kind(**d)


def atom_to(a: Atom) -> dict:
    if isinstance(a, Text):
        return {"type": "Text", "var": a.var, "predicate": _predicate_to(a.predicate)}
    return {"type": type(a).__name__} | {k: v for k, v in a.__dict__.items() if not (k == "upper" and v is None)}


def rule_from(d: dict) -> Rule:
    if d.get("schema", SCHEMA) != SCHEMA:
        raise ValueError(f"unknown rule schema {d['schema']}")
    return Rule(tuple(atom_from(a) for a in d["body"]), atom_from(d["head"]))


def rule_to(r: Rule) -> dict:
    return {"schema": SCHEMA, "body": [atom_to(a) for a in r.body], "head": atom_to(r.head)}


def read_program(text: str) -> tuple[list[str], list[Rule]]:
    """Labels and rules of a program's JSON text."""
    d = json.loads(text)
    return d["labels"], [rule_from(r) for r in d["rules"]]


def write_program(labels: list[str], rules: list[Rule]) -> str:
    return json.dumps({"labels": labels, "rules": [rule_to(r) for r in rules]}, ensure_ascii=False)


def form_errors(rule: Rule) -> list[str]:
    """Author's forms: a cross-document body with a label head has a Label premise; used variables are connected."""
    out = []
    cross = [a for a in rule.body if isinstance(a, AttrEqual | LabelCompare) and a.left_var != a.right_var]
    if cross and isinstance(rule.head, Label) and not any(isinstance(a, Label) for a in rule.body):
        out.append("a cross-document rule with a label head needs a label premise")
    group = {v: v for v in rule.bound}

    def find(v: str) -> str:
        while group[v] != v:
            v = group[v]
        return v

    for a in cross:
        group[find(a.left_var)] = find(a.right_var)
    used = {v for a in (*rule.body, rule.head) if not isinstance(a, Doc) for v in variables(a)}
    if len({find(v) for v in used}) > 1:
        out.append("its variables are not connected by AttrEqual or LabelCompare")
    for a in rule.body:
        if isinstance(a, ML) and not any(a.var in variables(b) for b in rule.body if isinstance(b, Text | AttrEqual)):
            out.append("an ML atom shares no variable with a text or attribute atom")
            break
    return out


def transform(rules: list[Rule], variant: str) -> list[Rule]:
    """full, pure_ml, no_text, no_label drop whole rules; no_ground strips Text and AttrEqual from rules with ML."""
    has = lambda r, *k: any(isinstance(a, k) for a in r.body)
    if variant == "full":
        return list(rules)
    if variant == "pure_ml":
        return [r for r in rules if has(r, ML) and not has(r, Text, Label, AttrEqual, LabelCompare)]
    if variant == "no_text":
        return [r for r in rules if not has(r, Text)]
    if variant == "no_label":
        return [r for r in rules if not has(r, Label, LabelCompare)]
    if variant == "no_ground":
        return [Rule(tuple(a for a in r.body if not isinstance(a, Text | AttrEqual)), r.head) if has(r, ML) else r for r in rules]
    raise ValueError(f"unknown variant {variant}")


def family(rule: Rule) -> str:
    """single_model, multi_model, text, model_text, label_propagation or cross_document."""
    if len(rule.bound) > 1:
        return "cross_document"
    kinds = [type(a) for a in rule.body]
    if Label in kinds:
        return "label_propagation"
    if ML in kinds and Text in kinds:
        return "model_text"
    if Text in kinds:
        return "text"
    return "multi_model" if kinds.count(ML) > 1 else "single_model"


def statistics(rules: list[Rule]) -> list[dict]:
    """Counts of atoms a rule, and of atoms that restrict nothing (ml >= 0, freq >= 0)."""
    out = []
    for i, r in enumerate(rules):
        row = {"rule_id": i, "family": family(r)} | {k.lower(): sum(isinstance(a, c) for a in r.body) for k, c in _KINDS.items()}
        row["free"] = sum((isinstance(a, ML) and a.eta <= 0) or (isinstance(a, Text) and a.predicate.type == "freq" and a.predicate.op == ">=" and a.predicate.eta <= 0) for a in r.body)
        out.append(row)
    return out
