"""From a rule to a DataFrame of the facts that it concludes."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import predicate
from marlstone.plans.relation import COMPS, EDGES, Relation, close
from marlstone.plans.rules import ML, AttrEqual, Label, LabelCompare, Rule, Text, variables
from marlstone.plans.store import written

FACTS = "doc_id bigint, label string, sign int"


@dataclass
class Catalog:
    """The tables a program runs over.

    docs: doc_id, cnt, ttl, mtd and one column `mtd_<key>` for each named attribute; an optional boolean
    column `<attribute>__present` certifies presence. model_prob: doc_id, alias, label, p, is_static.
    gamma: doc_id, label, sign. relations: src, dst, strict (roots of the label-set relation). labels: the whole
    label axis, if it is declared; without it a strict inclusion is never known to lack a witness.
    """

    docs: DataFrame
    gamma: DataFrame
    model_prob: DataFrame | None = None
    relations: DataFrame | None = None
    labels: tuple[str, ...] | None = None
    keys: DataFrame | None = None

    def with_keys(self, rules: list[Rule]) -> Catalog:
        """With the attributes that the rules compare as a written table (keys: doc_id and these), so that rounds of a closure do not read the texts again."""
        names = {column(x) for r in rules for a in r.body if isinstance(a, AttrEqual) for x in (a.left_attr, a.right_attr)}
        names |= {n for x in names if (n := f"{x}__present") in self.docs.columns}
        return replace(self, keys=written(self.docs.select("doc_id", *sorted(names)), "keys")) if names else self


def column(attr: str) -> str:
    return attr.replace(".", "_")


def _there(docs: DataFrame, attr: str):
    name = column(attr)
    if f"{name}__present" in docs.columns:
        return F.col(name).isNotNull() & F.col(f"{name}__present")
    return F.col(name).isNotNull() & (F.col(name) != "")


def as_relation(cat: Catalog, edges: Relation | DataFrame | None) -> Relation:
    """Closed pairs (src, dst, strict) as a relation in which every document is a component."""
    if isinstance(edges, Relation):
        return edges
    spark = cat.docs.sparkSession
    return Relation(spark.createDataFrame([], COMPS), edges if edges is not None else spark.createDataFrame([], EDGES), settled=False)


def fire(rule: Rule, cat: Catalog, facts: DataFrame | None, edges: Relation | DataFrame | None = None, sources: dict[int, DataFrame] | None = None, memo: dict | None = None,
         ranges: dict[str, DataFrame] | None = None) -> DataFrame:
    """The distinct head facts of all valuations, without a test against known ones; for a head on label sets, the pairs.

    Filters of each variable come first; label and model premises are semi-joins; a variable that only has to
    exist is reduced into its neighbour by a semi-join, so copies inside a group never become pairs.
    sources: the facts that a label premise reads, by its place in the body, in place of `facts`. If some have a
    column `run`, they are the facts of several runs at once: a valuation takes them from one run, which is a column of the result.
    memo: keeps the documents that pass the text filters of a variable as a table, for rules that fire again.
    ranges: the documents that a variable ranges over, in place of all.
    """
    body = _Body(rule, cat, facts, edges, sources, memo, ranges)
    out = body.joined()
    run = body.run_of(out)
    more = [F.col(run).alias("run")] if run else []
    if isinstance(rule.head, Label):
        return out.select(*more, F.col(f"{rule.head.var}__doc_id").alias("doc_id"), F.lit(rule.head.label).alias("label"), F.lit(rule.head.sign).alias("sign")).distinct()
    a, b = F.col(f"{rule.head.left_var}__doc_id"), F.col(f"{rule.head.right_var}__doc_id")
    one = out.select(a.alias("src"), b.alias("dst"), F.lit(rule.head.op == "strict_subset").alias("strict"))
    if rule.head.op == "eq":
        one = one.unionByName(out.select(b.alias("src"), a.alias("dst"), F.lit(False).alias("strict")))
    return one.distinct()


def fire_blocks(rule: Rule, cat: Catalog, facts: DataFrame, edges: Relation | DataFrame | None = None) -> tuple[DataFrame, DataFrame] | None:
    """The two sides of a relation head as rows (doc_id, value): every left document of a value is related to every right one.

    None if the head's variables are bound otherwise than by equal attributes; then pairs are needed. Variables
    that nothing links have one value in common, so all pairs of them are one block.
    """
    u, v = rule.head.left_var, rule.head.right_var
    body = _Body(rule, cat, facts, edges, None)
    body.reduce()
    if set(body.live) - {u, v} - set(body.alone()) or u == v:
        return None
    between = [a for a in body.links if {a.left_var, a.right_var} == {u, v}]
    if any(isinstance(a, LabelCompare) for a in between):
        return None
    sides = []
    for w in (u, v):
        keys = [F.col(f"{w}__{column(a.left_attr if a.left_var == w else a.right_attr)}") for a in between]
        value = F.to_json(F.array(*[k.cast("string") for k in keys])) if keys else F.lit("all")
        df = body.frames[w]
        for x in body.alone():
            df = body.exists(df, x)
        sides.append(df.select(F.col(f"{w}__doc_id").alias("doc_id"), value.alias("value")).distinct())
    return sides[0], sides[1]


class _Body:
    """The variables of a body as frames, and how they are joined."""

    def __init__(self, rule: Rule, cat: Catalog, facts: DataFrame | None, edges: Relation | DataFrame | None, sources: dict[int, DataFrame] | None, memo: dict | None = None, ranges: dict[str, DataFrame] | None = None):
        self.rule, self.cat = rule, cat
        self.links = [a for a in rule.body if isinstance(a, AttrEqual | LabelCompare) and a.left_var != a.right_var]
        compared = {w for a in rule.body if isinstance(a, LabelCompare) for w in variables(a)}
        self.relation = as_relation(cat, edges) if compared else None
        self.frames: dict[str, DataFrame] = {}
        needs: dict[str, set[str]] = {v: set() for v in rule.bound}
        for a in self.links:
            if isinstance(a, AttrEqual):
                needs[a.left_var].add(a.left_attr)
                needs[a.right_var].add(a.right_attr)
        for v in rule.bound:
            own = [a for a in rule.body if isinstance(a, AttrEqual) and a.left_var == a.right_var == v]
            reads = {*needs[v], *(x for a in own for x in (a.left_attr, a.right_attr)), *(a.predicate.attr for a in rule.body if isinstance(a, Text) and a.var == v)}
            df = (ranges or {}).get(v, cat.keys if cat.keys is not None and {column(x) for x in reads} <= set(cat.keys.columns) else cat.docs)
            for a in rule.body:
                if isinstance(a, Text) and a.var == v:
                    df = df.where(predicate(a.predicate, F.col(column(a.predicate.attr)), _there(cat.docs, a.predicate.attr)))
                elif isinstance(a, AttrEqual) and a.left_var == a.right_var == v:
                    df = df.where(_there(cat.docs, a.left_attr) & _there(cat.docs, a.right_attr) & (F.col(column(a.left_attr)) == F.col(column(a.right_attr))))
            for attr in needs[v]:
                df = df.where(_there(cat.docs, attr))
            df = df.select("doc_id", *[column(x) for x in sorted(needs[v])])
            if memo is not None and any(isinstance(a, Text) and a.var == v for a in rule.body):
                if (rule, v) not in memo:
                    memo[rule, v] = written(df, "passed")
                df = memo[rule, v]
            for i, a in enumerate(rule.body):
                if isinstance(a, Label) and a.var == v:
                    source = (sources or {}).get(i, facts)
                    held = source.where((F.col("label") == a.label) & (F.col("sign") == a.sign))
                    if "run" not in source.columns:
                        df = df.join(held.select("doc_id"), "doc_id", "left_semi")
                    elif "run" in df.columns:
                        df = df.join(held.select("doc_id", "run"), ["doc_id", "run"], "left_semi")
                    else:
                        df = df.join(held.select("doc_id", "run").distinct(), "doc_id")
                elif isinstance(a, ML) and a.var == v:
                    p = F.col("p").cast("double")
                    held = (F.col("alias") == a.alias) & (F.col("label") == a.label) & (F.col("is_static") == (not a.dynamic)) & (p >= a.eta)
                    held = held & (p < a.upper) if a.upper is not None else held
                    df = df.join(cat.model_prob.where(held).select("doc_id"), "doc_id", "left_semi")
            if v in compared:
                df = self.relation.comp_of(df, "doc_id", "comp__")
                if any(isinstance(a, LabelCompare) and a.left_var == a.right_var == v and a.op == "strict_subset" for a in rule.body):
                    df = df.join(self.relation.links.where("strict and src = dst").select(F.col("src").alias("comp__")), "comp__", "left_semi")
            self.frames[v] = df.select(*[F.col(c).alias(f"{v}__{c}") for c in df.columns])
        self.live = set(rule.bound)

    def run_of(self, df: DataFrame) -> str | None:
        return next((c for c in df.columns if c.endswith("__run")), None)

    def near(self, v: str) -> set[str]:
        return {w for a in self.links for w in (a.left_var, a.right_var) if v in (a.left_var, a.right_var) and w != v and w in self.live}

    def toward(self, y: DataFrame, v: str, a: LabelCompare, name: str) -> DataFrame:
        """y with the components that the comparison allows its other variable."""
        own = F.col(f"{v}__comp__")
        same = y.withColumn(name, own)
        links = self.relation.links if self.relation.closed else written(close(self.relation.links), "links")
        if a.op == "eq":
            if self.relation.settled:
                return same
            back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
            links = links.select("src", "dst").distinct().join(back, ["src", "dst"], "left_semi").where("src <> dst")
        elif a.op == "strict_subset":
            links = links.where("strict").select("src", "dst").distinct()
        else:
            links = links.where("src <> dst").select("src", "dst").distinct()
        mine, other = ("src", "dst") if a.left_var == v else ("dst", "src")
        moved = y.join(links.select(F.col(mine).alias(f"{v}__comp__"), F.col(other).alias(name)), f"{v}__comp__").select(*same.columns)
        return moved if a.op == "strict_subset" else same.unionByName(moved)

    def join(self, x: DataFrame, u: str, y: DataFrame, v: str, how: str) -> DataFrame:
        """x, which has variable u, with y, which is variable v; left_semi keeps x's columns, and y's run if x has none."""
        between = [a for a in self.links if {a.left_var, a.right_var} == {u, v}]
        on, keys = [], []
        for i, a in enumerate(between):
            if isinstance(a, AttrEqual):
                mine, other = (a.left_attr, a.right_attr) if a.left_var == v else (a.right_attr, a.left_attr)
                keys.append(f"{v}__{column(mine)}")
                on.append(F.col(f"{u}__{column(other)}") == F.col(keys[-1]))
            else:
                y = self.toward(y, v, a, f"{v}__via{i}")
                keys.append(f"{v}__via{i}")
                on.append(F.col(f"{u}__comp__") == F.col(keys[-1]))
        run_x, run_y = self.run_of(x), self.run_of(y)
        if how == "left_semi":
            y = y.select(*dict.fromkeys([*keys, *([run_y] if run_y else [])])).distinct()
        if run_x and run_y:
            on.append(F.col(run_x) == F.col(run_y))
        cond = on[0]
        for c in on[1:]:
            cond = cond & c
        extra = how == "left_semi" and run_y and not run_x
        out = x.join(y, cond, "inner" if extra else how)
        if how == "left_semi" and not extra:
            return out
        gone = [c for c in y.columns if "__via" in c or (extra and c != run_y)] + ([run_y] if run_x and run_y else [])
        return out.drop(*gone)

    def exists(self, x: DataFrame, v: str) -> DataFrame:
        """x, if the frame of v has any row; of x's run, if runs are told apart."""
        y = self.frames[v]
        run_x, run_y = self.run_of(x), self.run_of(y)
        if run_y and run_x:
            return x.join(y.select(F.col(run_y).alias("run__any")).distinct(), F.col(run_x) == F.col("run__any"), "left_semi")
        if run_y:  # the runs of a batch
            return x.crossJoin(F.broadcast(y.select(run_y).distinct()))
        return x.crossJoin(F.broadcast(y.limit(1).select(F.lit(1).alias(f"{v}__any"))))

    def reduce(self) -> None:
        """Leaves: a variable that is not in the head and has one neighbour only has to exist."""
        heads = set(variables(self.rule.head))
        while True:
            leaf = next((v for v in self.rule.bound if v in self.live - heads and len(self.near(v)) == 1), None)
            if leaf is None:
                return
            u = self.near(leaf).pop()
            self.frames[u] = self.join(self.frames[u], u, self.frames[leaf], leaf, "left_semi")
            self.live.discard(leaf)

    def alone(self) -> list[str]:
        heads = set(variables(self.rule.head))
        return [v for v in self.rule.bound if v in self.live - heads and not self.near(v)]

    def joined(self) -> DataFrame:
        self.reduce()
        alone = self.alone()
        out, done = None, []
        order = [v for v in self.rule.bound if v in self.live and v not in alone]
        while order:
            v = next((v for v in order if done and any(w in self.near(v) for w in done)), order[0])
            order.remove(v)
            if out is None:
                out = self.frames[v]
            else:
                near = [u for u in done if u in self.near(v)]
                if not near:  # the head's two variables are not linked: all pairs are meant
                    out = out.crossJoin(self.frames[v])
                else:
                    out = self.join(out, near[0], self.frames[v], v, "inner")
                    for u in near[1:]:
                        out = self.also(out, u, v)
            done.append(v)
        for v in alone:
            out = self.exists(out, v)
        return out

    def also(self, out: DataFrame, u: str, v: str) -> DataFrame:
        """out, which has both variables, where their links hold."""
        for a in self.links:
            if {a.left_var, a.right_var} == {u, v}:
                if isinstance(a, AttrEqual):
                    out = out.where(F.col(f"{a.left_var}__{column(a.left_attr)}") == F.col(f"{a.right_var}__{column(a.right_attr)}"))
                else:
                    pair = self.toward(out.select(f"{v}__comp__").distinct(), v, a, "other").select(F.col(f"{v}__comp__"), F.col("other").alias(f"{u}__comp__")).distinct()
                    out = out.join(pair, [f"{v}__comp__", f"{u}__comp__"], "left_semi")
        return out


def premises(rule: Rule) -> list[int]:
    """The places of the body's label premises."""
    return [i for i, a in enumerate(rule.body) if isinstance(a, Label)]


def fire_new(rule: Rule, cat: Catalog, old: DataFrame, delta: DataFrame, changed: set[str], edges: Relation | DataFrame | None = None, memo: dict | None = None) -> list[DataFrame]:
    """Conclusions that need a new fact: for each label premise whose label has new facts one plan, in which this premise reads
    the new facts, earlier ones the old facts, and later ones both. What the plans read of the new side follows the delta."""
    at, out = premises(rule), []
    both = old.select(*delta.columns).unionByName(delta)
    for k, i in enumerate(at):
        if rule.body[i].label in changed:
            sources = {j: old if n < k else delta if n == k else both for n, j in enumerate(at)}
            out.append(fire(rule, cat, None, edges, sources, memo))
    return out
