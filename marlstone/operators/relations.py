"""Label-set relations: edges (src, dst, strict) meaning src's labels are in dst's, reflexive edges implied."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.plans.relation import close, components  # noqa: F401  close is part of this module's functions
from marlstone.plans.store import written


def copy_labels(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """Positive labels go along closed edges; negatives do not go back."""
    moved = facts.where("sign > 0").join(edges.select(F.col("src").alias("doc_id"), "dst").distinct(), "doc_id").select(F.col("dst").alias("doc_id"), "label", "sign")
    return facts.select("doc_id", "label", "sign").unionByName(moved).distinct()


def carry(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """As copy_labels over the closure of edges (src, dst), which is never made: a row a document and label.

    If every document has one way in at most, each takes the labels of the document that stands 1, 2, 4, ... steps before it;
    else new labels go one step on in each round.
    """
    e = written(edges.where("src <> dst").select("src", "dst").distinct(), "edges")
    have = written(facts.where("sign > 0").select("doc_id", "label").distinct(), "have")
    if e.groupBy("dst").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        at, n = e.select(F.col("dst").alias("doc_id"), F.col("src").alias("up")), have.count()
        while True:
            moved = at.join(have.withColumnRenamed("doc_id", "up"), "up").select("doc_id", "label")
            have, before = written(have.unionByName(moved).distinct(), "have"), n
            n = have.count()
            if n == before:
                break
            at = written(at.join(at.select(F.col("doc_id").alias("up"), F.col("up").alias("next")), "up").select("doc_id", F.col("next").alias("up")), "up")
    else:
        new, parts = have, [have]
        while True:
            found = e.join(new.withColumnRenamed("doc_id", "src"), "src").select(F.col("dst").alias("doc_id"), "label").distinct()
            new = written(found.join(reduce(DataFrame.unionByName, parts), ["doc_id", "label"], "left_anti"), "new")
            if new.isEmpty():
                break
            parts = [*parts, new] if len(parts) < 8 else [written(reduce(DataFrame.unionByName, [*parts, new]), "have")]
        have = reduce(DataFrame.unionByName, parts)
    return facts.select("doc_id", "label", "sign").unionByName(have.withColumn("sign", F.lit(1))).distinct()


def violations(edges: DataFrame, facts: DataFrame, n_labels: int | None = None) -> DataFrame:
    """src, dst, reason: strict edges with a way back, and strict edges that no label can make strict (if n_labels is given)."""
    strict = edges.where("strict").select("src", "dst").distinct()
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    out = strict.where("src = dst").unionByName(strict.where("src <> dst").join(back, ["src", "dst"], "left_semi")).distinct().withColumn("reason", F.lit("cycle"))
    if n_labels is not None:
        out = out.unionByName(no_witness(edges, facts, n_labels).withColumn("reason", F.lit("no_witness")))
    return out


def no_witness(edges: DataFrame, facts: DataFrame, n_labels: int) -> DataFrame:
    """Strict edges for which every label is in the source or denied to the target."""
    strict = edges.where("strict").select("src", "dst").distinct()
    held = strict.join(facts.where("sign > 0").select(F.col("doc_id").alias("src"), "label"), "src")
    denied = strict.join(facts.where("sign < 0").select(F.col("doc_id").alias("dst"), "label"), "dst").select("src", "dst", "label")
    used = held.select("src", "dst", "label").unionByName(denied).groupBy("src", "dst").agg(F.count_distinct("label").alias("n"))
    return used.where(F.col("n") >= n_labels).select("src", "dst")


@dataclass(frozen=True)
class Feasibility:
    """holds: whether a completion exists. witness: for each strict edge a label that makes it strict, if so; else reason and the edges or cell it rests on."""

    holds: bool
    witness: dict[tuple[int, int], str] | None = None
    reason: str | None = None
    rests_on: tuple = ()


def complete(pos: set[tuple[int, str]], neg: set[tuple[int, str]], edges: list[tuple[int, int, bool]], labels: list[str], most: int = 200_000) -> Feasibility:
    """Whether some completion has src's labels within dst's for all edges, and fewer for strict ones.

    A label can make several strict edges strict at once unless the target of one lies within the source of another (or is it):
    it would have to be there and not there. All else that a label can or cannot do, the facts fix edge by edge. So strict edges
    are to be given labels from lists, and edges in line with each other different ones. Labels are given by unit propagation,
    then by branching over an edge with the shortest list; labels on whose lists no edge differs are tried once. Lines longer
    than all their lists together prove that there is no completion (the certificate `line`); `most` branches are an error.
    """
    nodes = {d for d, _ in pos | neg} | {x for s, t, _ in edges for x in (s, t)}
    up: dict[int, set[int]] = {}
    above: dict[int, list[int]] = {}
    for s, t, _ in edges:
        above.setdefault(s, []).append(t)
    for d in nodes:
        seen, todo = {d}, [d]
        while todo:
            for t in above.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        up[d] = seen
    have = {(t, x) for d, x in pos for t in up[d]}
    if have & neg:
        return Feasibility(False, reason="denied", rests_on=(min(have & neg),))
    barred = {x: {d for d in nodes if any((t, x) in neg for t in up[d])} for x in labels}
    strict = sorted({(s, t) for s, t, k in edges if k})
    for e in strict:
        if e[0] in up[e[1]]:
            return Feasibility(False, reason="cycle", rests_on=(e,))
    lists = {e: {x for x in labels if (e[0], x) not in have and e[1] not in barred[x]} for e in strict}
    line = {e: {f for f in strict if f[0] in up[e[1]]} for e in strict}  # f is further up
    apart = {e: line[e] | {f for f in strict if e in line[f]} for e in strict}
    alike: dict[frozenset, list[str]] = {}
    for x in labels:
        alike.setdefault(frozenset(e for e in strict if x in lists[e]), []).append(x)
    branches = 0

    def longest(left: dict) -> list[tuple[int, int]]:
        """A longest line among the edges that have no label yet."""
        best: dict[tuple[int, int], list] = {}
        for e in sorted(left, key=lambda e: len(line[e])):
            best[e] = [e, *max((best[f] for f in line[e] if f in left and f in best), key=len, default=[])]
        return max(best.values(), key=len, default=[])

    def finish(given: dict, last: list) -> dict:
        given = dict(given)
        for e, options in reversed(last):
            given[e] = min(options - {given[f] for f in apart[e] if f in given})
        return given

    def search(left: dict[tuple[int, int], set[str]], given: dict[tuple[int, int], str]) -> Feasibility:
        nonlocal branches
        left, given = {e: set(x) for e, x in left.items()}, dict(given)
        while True:
            empty = next((e for e, x in left.items() if not x), None)
            if empty is not None:
                return Feasibility(False, reason="no_label", rests_on=(empty,))
            unit = next((e for e, x in left.items() if len(x) == 1), None)
            if unit is None:
                break
            x = given[unit] = left.pop(unit).pop()
            for f in apart[unit]:
                if f in left:
                    left[f].discard(x)
        # An edge with more labels on its list than edges that it must differ from is given one of them at the end.
        last = []
        while (easy := next((e for e in left if len(left[e]) > len(apart[e] & left.keys())), None)) is not None:
            last.append((easy, left.pop(easy)))
        if not left:
            return Feasibility(True, witness=finish(given, last))
        row = longest(left)
        if len(row) > len(set().union(*(left[e] for e in row))):
            return Feasibility(False, reason="line", rests_on=tuple(row))
        e = min(left, key=lambda e: (len(left[e]), -len(apart[e] & left.keys()), e))
        result, tried = None, set()
        for x in sorted(left[e]):
            kind = next(i for i, names in enumerate(alike.values()) if x in names)
            fresh = x not in given.values()
            if fresh and kind in tried:
                continue  # a label like one that was tried, and used by no edge as that one was
            tried |= {kind} if fresh else set()
            branches += 1
            if branches > most:
                raise RuntimeError(f"undecided after {most} branches")
            result = search({f: ({x} if f == e else left[f]) for f in left}, given)
            if result.holds:
                return Feasibility(True, witness=finish(result.witness, last))
        return Feasibility(False, reason="search", rests_on=tuple(sorted(left))) if result is None or len(left[e]) > 1 else result

    return search(lists, {})


def feasible(pos: set[tuple[int, str]], neg: set[tuple[int, str]], edges: list[tuple[int, int, bool]], labels: list[str]) -> bool:
    return complete(pos, neg, edges, labels).holds


def long_lines(edges: DataFrame, n: int) -> DataFrame:
    """doc_id: documents that a path of more than n strict edges leads to, round a cycle too. n labels cannot part such a line."""
    e = edges.select("src", "dst", "strict").distinct()
    strict, loose = e.where("strict"), e.where("not strict and src <> dst")
    mixed = not loose.isEmpty()
    at = strict.select(F.col("dst").alias("doc_id")).distinct()
    for _ in range(n):
        at = written(at, "line")
        front = at
        while mixed and not front.isEmpty():
            step = loose.join(front.withColumnRenamed("doc_id", "src"), "src").select(F.col("dst").alias("doc_id")).distinct()
            front = written(step.join(at, "doc_id", "left_anti"), "front")
            at = written(at.unionByName(front), "line")
        if at.isEmpty():
            break
        at = strict.join(at.withColumnRenamed("doc_id", "src"), "src").select(F.col("dst").alias("doc_id")).distinct()
    return written(at, "line")


def infeasible(edges: DataFrame, facts: DataFrame, labels: tuple[str, ...], most_edges: int = 10_000) -> DataFrame:
    """v, reason: the documents of groups of linked documents, with a strict edge, whose strict inclusions no completion of the facts can meet.

    A line of more strict edges than labels decides its group, of any size, by joins (reason `line`). Each other group is one row of
    its edges and facts and is decided where it is (see complete); one of more than `most_edges` edges is an error.
    """
    import pandas as pd

    spark = edges.sparkSession
    e = written(edges.select("src", "dst", "strict").distinct(), "edges")
    group = written(components(e.select(F.col("src").alias("a"), F.col("dst").alias("b"))), "group").select(F.col("node").alias("id"), F.col("comp").alias("group"))
    alone = e.where("src = dst").select(F.col("src").alias("id")).distinct().join(group, "id", "left_anti")
    group = group.unionByName(alone.select("id", F.col("id").alias("group")))
    lines = long_lines(e, len(labels)).join(group.withColumnRenamed("id", "doc_id"), "doc_id").select("group").distinct()
    lines = written(lines, "lines")
    told = group.join(lines, "group", "left_semi").select(F.col("id").alias("v"), F.lit("line").alias("reason"))
    group = group.join(lines, "group", "left_anti")
    of = e.join(group.select(F.col("id").alias("src"), "group"), "src")
    bad = of.groupBy("group").agg(F.max("strict").alias("s"), F.count(F.lit(1)).alias("n")).where("s")
    if not bad.where(F.col("n") > most_edges).isEmpty():
        raise ValueError(f"a group of strict inclusions has more than {most_edges} edges")
    rows = of.join(bad.select("group"), "group").select("group", F.struct("src", "dst", "strict").alias("edge"), F.lit(None).cast("struct<doc_id:bigint,label:string,sign:int>").alias("fact"))
    own = facts.join(group.join(bad.select("group"), "group").select(F.col("id").alias("doc_id"), "group"), "doc_id").select("group", F.lit(None).cast("struct<src:bigint,dst:bigint,strict:boolean>").alias("edge"), F.struct("doc_id", "label", F.col("sign").cast("int").alias("sign")).alias("fact"))

    def check(part: pd.DataFrame) -> pd.DataFrame:
        got = [(x["src"], x["dst"], x["strict"]) for x in part["edge"] if x is not None]
        have = [x for x in part["fact"] if x is not None]
        pos, neg = ({(x["doc_id"], x["label"]) for x in have if x["sign"] == s} for s in (1, -1))
        found = complete(pos, neg, got, list(labels))
        docs = [] if found.holds else sorted({v for a, b, _ in got for v in (a, b)})
        return pd.DataFrame({"v": pd.Series(docs, dtype="int64"), "reason": pd.Series([found.reason] * len(docs), dtype="object")})

    kind = "v long, reason string"
    return told.unionByName(rows.unionByName(own).groupBy("group").applyInPandas(check, kind)) if labels else spark.createDataFrame([], kind)
