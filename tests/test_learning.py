"""Selection, quality, the labeling loop, models and the command line against plain versions."""

import itertools
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from marlstone import cli
from marlstone.functions import text as T
from marlstone.models import Registry
from marlstone.operators import joins, learning, loop, quality, review, selection, splits
from marlstone.operators.patterns import contingency, mutual_information
from marlstone.plans.compile import Catalog
from marlstone.plans.rules import ML, Doc, Label, Rule, rule_to, write_program


@pytest.fixture(scope="module")
def world(spark):
    """Forty documents, patterns and labels at random, as sets and as tables."""
    rnd = random.Random(5)
    hits = {p: {i for i in range(40) if rnd.random() < q} for p, q in (("p0", 0.5), ("p1", 0.3), ("p2", 0.2), ("p3", 0.1), ("p4", 0.4))}
    hits["p5"] = set(hits["p2"])  # the same mask under a later name
    truth = {"x": {i for i in range(40) if rnd.random() < 0.4 or i in hits["p1"]}, "y": hits["p2"] ^ {0, 1, 2}}
    h = spark.createDataFrame([(i, p) for p, s in hits.items() for i in s], "doc_id long, pattern string").cache()
    t = spark.createDataFrame([(i, x) for x, s in truth.items() for i in s], "doc_id long, label string").cache()
    docs = spark.range(40).select(F.col("id").alias("doc_id")).cache()
    axis = spark.createDataFrame([("x",), ("y",)], "label string")
    return hits, truth, h, t, docs, axis


def f1(pred, true):
    return 2 * len(pred & true) / (len(pred) + len(true)) if pred or true else 0.0


def test_greedy(world):
    hits, truth, h, t, docs, axis = world
    have, want = {"x": set(), "y": set()}, []
    for _ in range(3):
        now = {k: f1(have[k], truth[k]) for k in truth}
        best = min(((-round(f1(have[k] | hits[p], truth[k]) - now[k], 12), p, k) for p, k in itertools.product(hits, truth)), default=None)
        if best is None or best[0] >= 0:
            break
        _, p, k = best
        have[k] |= hits[p]
        want.append((p, k, sum(f1(have[k], truth[k]) for k in truth) / 2))
    got = selection.greedy_patterns(h, t, docs, axis, 3)
    assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want, strict=True))
    assert selection.greedy_patterns(h, t, docs, axis, 2, prefilter=100) == got[:2]


def mcc(s, pos, tp, n=40):
    d = s * (n - s) * pos * (n - pos)
    return (n * tp - s * pos) / math.sqrt(d) if d > 0 else 0.0


def test_balanced_greedy(world):
    """What the contract says of each pick, looked up in sets."""
    hits, truth, h, t, docs, _ = world
    names = sorted(set(hits) - {"p5"})  # p5 has p2's mask
    corr = {(p, k): round(mcc(len(hits[p]), len(truth[k]), len(hits[p] & truth[k])), 12) for p in names for k in truth}
    for quota in (1, 4, 5):
        got = selection.balanced_greedy(h, t, docs, quota)
        assert len(got) == len({p for p, _ in got}) == quota
        shared = math.ceil(0.75 * quota)
        assert [k for _, k in got] == ["xy"[i % 2] for i in range(shared)] + [None] * (quota - shared)
        for i, (p, k) in enumerate(got):
            before = got[:i]
            free = [q for q in names if q not in {b[0] for b in before}]
            if k is None:
                gone = {d for q, _ in before for d in hits[q]}
                worth = {q: (len(hits[q] - gone), max(abs(corr[q, x]) for x in truth), len(hits[q])) for q in free}
            else:
                gone = {s: {d for q, x in before if x == k and (corr[q, k] >= 0) == s for d in hits[q]} for s in (True, False)}
                worth = {q: (round(abs(corr[q, k]) * math.sqrt(len(hits[q] - gone[corr[q, k] >= 0]) / len(hits[q])), 12), abs(corr[q, k]), len(hits[q])) for q in free}
            assert worth[p] == max(worth.values()) and p == min(q for q in free if worth[q] == worth[p])


def test_capped_information(world, spark):
    _, _, h, t, docs, _ = world
    family = {f"p{i}": "even" if i % 2 == 0 else "odd" for i in range(6)}
    table = lambda f: spark.createDataFrame([*f.items()], "pattern string, family string")
    rows = selection.capped_information(h, table(family), t, docs, 4).orderBy("place").collect()
    got = [r.pattern for r in rows]
    assert [r.place for r in rows] == [1, 2, 3, 4] and len(set(got)) == 4 and "p5" not in got  # p5 has p2's mask
    assert sum(family[p] == "even" for p in got) == 2  # half of the budget
    mi = {(r.pattern, r.label): r.mi for r in mutual_information(contingency(h, t, docs)).collect()}
    best = lambda k: sorted((p for p in family if p != "p5"), key=lambda p: -mi[p, k])[:2]
    assert [r.pattern for r in rows if r.label == "x"] == best("x")
    assert {r.pattern for r in rows if r.label == "y"} <= set(best("y"))
    one = selection.capped_information(h, table(dict.fromkeys(family, "one")), t, docs, 4, share=0.25).collect()
    assert len(one) == 1 and one[0].label == "x" and one[0].pattern == best("x")[0]
    assert selection.capped_information(h, table(dict.fromkeys(family, "one")), t, docs, 20, share=1.0).count() == 5



def test_signed_groups(spark, world):
    _, truth, _, t, _, axis = world
    base = t.where("doc_id % 2 = 0").unionByName(spark.createDataFrame([(5000, "x")], "doc_id long, label string"))
    groups = {
        "good": t.where("doc_id % 2 = 1").withColumn("sign", F.lit(1)),
        "deny": spark.createDataFrame([(5000, "x", -1)], "doc_id long, label string, sign int"),
        "torn": t.withColumn("sign", F.lit(1)).unionByName(t.withColumn("sign", F.lit(-1))),
        "bad": spark.createDataFrame([(7000, "y", 1)], "doc_id long, label string, sign int"),
    }
    got = selection.signed_groups(base, groups, t, axis)
    assert [g for g, _ in got] == ["good", "deny"] and got[-1][1] == pytest.approx(1.0)


def test_best_subsets(spark):
    u = [(d, a, v) for d, vs in enumerate([(0.9, 0.1, 0.2), (0.1, 0.8, 0.2), (0.2, 0.1, 0.3)]) for a, v in zip("abc", vs, strict=True)]
    rows = spark.createDataFrame(u, "doc_id long, alias string, u double")
    clusters = spark.createDataFrame([(0, "k"), (1, "k"), (2, "l")], "doc_id long, cluster string")
    got = {r.cluster: r.models for r in selection.best_subsets(rows, clusters, 2).collect()}
    assert got == {"k": ["a", "b"], "l": ["a", "c"]}
    with pytest.raises(ValueError):
        selection.best_subsets(rows, clusters, 2, most=1)


def test_ridge(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x, u = rng.standard_normal((30, 2)), rng.standard_normal(30)
    util = spark.createDataFrame([(i, "m", float(v)) for i, v in enumerate(u)], "doc_id long, alias string, u double")
    feats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, x array<double>")
    got = {r.doc_id: r.q for r in quality.ridge_quality(util, feats, util.where("doc_id < 20"), 0.5).collect()}
    a = np.concatenate([np.ones((30, 1)), x], axis=1)
    w = np.linalg.solve(a[:20].T @ a[:20] + 0.5 * np.diag([0, 1, 1]), a[:20].T @ u[:20])
    assert np.allclose([got[i] for i in range(30)], a @ w)


def test_evenly_spaced(spark):
    rows = spark.range(1000, 1097).select(F.col("id").alias("doc_id"))
    for share in (0.0, 0.1, 0.5, 0.77, 1.0):
        count = math.ceil(97 * share)
        want = [1000 + i * 97 // count for i in range(count)]
        assert sorted(r.doc_id for r in loop.evenly_spaced(rows, share).collect()) == want


def test_row_budget(spark):
    batch = spark.createDataFrame([(i, "x") for i in range(20)], "doc_id long, label string")
    fresh = batch.where("doc_id < 4")
    got = {r.doc_id for r in loop.limit_rows(batch, fresh, 9).collect()}
    assert len(got) == 9 and {0, 1, 2, 3} <= got
    with pytest.raises(ValueError):
        loop.limit_rows(batch, fresh, 3)


def test_residual_rules_run(spark):
    """Cells that were absent and are probable come in, present and improbable ones are denied, all others are as before."""
    docs = spark.createDataFrame([(i, "t", "", "") for i in range(4)], "doc_id long, cnt string, ttl string, mtd string")
    before = spark.createDataFrame([(0, "x"), (1, "x")], "doc_id long, label string")
    p = spark.createDataFrame([(0, "x", 0.9), (1, "x", 0.1), (2, "x", 0.8), (3, "x", 0.4)], "doc_id long, label string, p double")
    axis = spark.createDataFrame([("x",)], "label string")
    rules = loop.residual_rules([], {"x": (0.7, 0.2)}, "aux")
    cat = Catalog(docs, spark.createDataFrame([], "doc_id long, label string, sign int"), loop.auxiliary_tables(before, p, docs, axis, "aux"))
    from marlstone.operators.closure import close_program

    assert {(r.doc_id, r.sign) for r in close_program(cat, rules).facts.collect()} == {(1, -1), (2, 1)}
    with pytest.raises(ValueError):
        loop.residual_rules([], {"x": (0.3, 0.4)}, "aux")
    with pytest.raises(ValueError):
        loop.auxiliary_rules([], {"x": 0.35}, "aux", {"x": [(0.1, 0.3)]}, gap=0.1)
    assert len(loop.auxiliary_rules([], {"x": 0.45}, "aux", {"x": [(0.1, 0.3)]}, gap=0.1)) == 1


def test_gates():
    base = dict(aux_macro=0.5, aux_micro=0.5, macro=0.6, micro=0.6, fn=10, completeness=0.9)
    assert not loop.joint_gate(base, base)
    assert loop.joint_gate(base, base | {"macro": 0.61})
    assert not loop.joint_gate(base, base | {"macro": 0.61, "aux_micro": 0.49})
    assert not loop.joint_gate(base, base | {"macro": 0.61, "fn": 11}) and loop.joint_gate(base, base | {"macro": 0.61, "fn": 11}, fn_share=0.1)
    assert not review.gate({"macro": 0.5, "micro": 0.5}, {"macro": 0.6, "micro": 0.4})


def test_routes(spark):
    docs = spark.createDataFrame([(1, "k"), (2, "k")], "doc_id long, key string")
    d = spark.createDataFrame([(i, "x", a, a != "c") for i in (1, 2) for a in "abc"], "doc_id long, label string, alias string, vote boolean")
    ok = spark.createDataFrame([("k", "c0", "a"), ("k", "c0", "c"), ("k", "c0", "b")], "key string, cluster string, alias string")
    assert {(r.doc_id, r.vote) for r in loop.routed_votes(docs, ok, d).collect()} == {(1, True), (2, True)}
    with pytest.raises(ValueError, match="several clusters"):
        loop.routed_votes(docs, ok.unionByName(spark.createDataFrame([("k", "c1", "a")], ok.schema)), d)


def test_loop(spark):
    """Every round asks for at most a batch; answers end the loop, a small budget ends it sooner."""
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("t").alias("cnt"), F.lit("").alias("ttl"), F.lit("").alias("mtd"))
    gamma = spark.createDataFrame([], "doc_id long, label string, sign int")
    axis = spark.createDataFrame([("x",)], "label string")
    probs = docs.select("doc_id", F.lit("m").alias("alias"), F.lit("x").alias("label"), (F.col("doc_id") / 50).alias("p"), F.lit(False).alias("is_static"))
    rule = Rule((Doc("d"), ML("d", "m", "x", 0.8)), Label("d", "x"))
    answer = lambda asked: asked.select("doc_id", F.lit("x").alias("label"), F.when(F.col("doc_id") % 2 == 0, 1).otherwise(-1).alias("sign"))
    cat = Catalog(docs, gamma)
    out = loop.label_loop(cat, [rule], axis, probs, answer, budget=60, batch=32)
    assert out.status == "all_documents_resolved" and [r.asked for r in out.rounds] == [32, 8, 0] and out.rounds[-1].pending == 0
    assert {r.doc_id for r in out.closure.predictions().collect()} == {i for i in range(40) if i % 2 == 0} | set(range(40, 50))
    short = loop.label_loop(cat, [rule], axis, probs, answer, budget=20, batch=32)
    assert short.status == "label_budget_exhausted" and sum(r.asked for r in short.rounds) == 20


def test_registry(spark):
    docs = spark.createDataFrame([(1, "aa"), (2, "aa"), (3, "b"), (4, None)], "doc_id long, cnt string")
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("map<string,double>")
    def scorer(c):
        seen.add(len(c))
        return c.map(lambda t: {"x": len(t) / 10})

    r = Registry()
    r.register("len", scorer, ("x",))
    assert {(p.doc_id, p.p) for p in r.probabilities(docs).collect()} == {(1, 0.2), (2, 0.2), (3, 0.1), (4, 0.0)}
    assert seen.value == 3  # equal texts once
    assert {v.doc_id for v in r.decisions(docs, {"len": 0.15}).where("vote").collect()} == {1, 2}
    for bad in (lambda: r.register("len", scorer, ("x",)), lambda: r.register("two", scorer, ("x", "x")), lambda: r.probabilities(docs, ["none"])):
        with pytest.raises(ValueError):
            bad()


def test_similar_sentences_and_scopes(spark):
    s = joins.unit_vectors(spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "id long, v array<double>"), "id", "v")
    s = s.select(F.lit(7).cast("long").alias("doc_id"), F.col("id").alias("place"), "v")
    p = spark.createDataFrame([("east", [1.0, 0.0]), ("north", [0.0, 1.0])], "pattern string, v array<double>")
    h = joins.sentence_hits(s, p, 0.0001)
    assert {(r.pattern, r.n, r.first) for r in h.collect()} == {("east", 1, 0), ("north", 1, 1)}
    assert joins.similar_before(h, "east", "north").count() == 1 and joins.similar_before(h, "north", "east").count() == 0
    e = spark.createDataFrame([(1, 2), (1, 3), (4, 3)], "x long, y long")
    facts = spark.createDataFrame([(2, "L", 1), (3, "L", 1)], "doc_id long, label string, sign int")
    root = facts.where("doc_id = 2")
    got = lambda policy, **k: {r.doc_id: r.sources for r in joins.neighbour_sources(e, facts, root, policy, **k).collect()}
    assert got("validated") == {1: 1} and got("recursive") == {1: 2, 4: 1} and got("anchored_recursive") == {1: 2} and got("recursive", least=2) == {1: 2}


def test_term_offsets(spark):
    for text in ("The red Fox-hunt, ran a mile", "", "x", "Éa two\n two"):
        got = spark.createDataFrame([(text,)], "t string").select(F.explode(T.term_offsets(F.col("t"))).alias("x")).select("x.*").collect()
        import re

        one = [(m.group().lower(), m.start(), m.end()) for m in re.finditer("[A-Za-z]{2,}", text)]
        assert [tuple(r) for r in got] == one + [(f"{a[0]} {b[0]}", a[1], b[2]) for a, b in zip(one, one[1:])]


def test_command_line(spark, tmp_path, capsys):
    d = lambda n: str(tmp_path / n)
    spark.range(6).select(F.col("id").alias("doc_id"), F.lit("t").alias("cnt"), F.lit("").alias("ttl"), F.lit("").alias("mtd")).write.parquet(d("docs"))
    spark.createDataFrame([], "doc_id long, label string, sign int").write.parquet(d("gamma"))
    spark.range(6).select(F.col("id").alias("doc_id"), F.lit("m").alias("alias"), F.lit("x").alias("label"), (F.col("id") / 6).alias("p"), F.lit(False).alias("is_static")).write.parquet(d("probs"))
    spark.createDataFrame([(i, "x") for i in (3, 4, 5)], "doc_id long, label string").write.parquet(d("truth"))
    rules = [Rule((Doc("q"), ML("q", "m", "x", c)), Label("q", "x")) for c in (0.5, 0.9)]
    (tmp_path / "rules.json").write_text(write_program(["x"], rules))
    base = ["--docs", d("docs"), "--gamma", d("gamma"), "--probs", d("probs"), "--rules", d("rules.json"), "--truth", d("truth")]
    assert cli.main(["close", *base, "--out", d("facts")], spark) == {"status": "fixpoint", "rounds": 2, "facts": 3}
    assert cli.main(["evaluate", *base], spark)["macro_f1"] == 1.0
    assert cli.main(["discover", *base, "--out", d("chosen")], spark) == {"candidates": 2, "taken": [0]}
    got = cli.main(["label", *base, "--budget", "6", "--out", d("answers")], spark)
    assert got["status"] == "all_documents_resolved" and got["macro_f1"] == 1.0
    got = cli.main(["learn", *base, "--budget", "6", "--batch", "2", "--out", d("learned")], spark)
    assert got["status"] == "all_documents_resolved" and got["events"][0]["kind"] == "start"
    assert cli.main(["patterns", *base, "--least", "0.5", "--out", d("patterns")], spark)["patterns"]["match accepted"] == 1
    assert cli.main(["starts", *base, "--count", "2", "--out", d("starts")], spark) == {"starts": 1}
    assert spark.read.parquet(d("starts")).first().f1 == 1.0
    assert cli.main(["stage", *base, "--out", d("staged")], spark) == {"steps": ["union"], "rules": 1}
    pool = [(json.dumps(rule_to(r)), 1.0 - i, i) for i, r in enumerate((*rules, rules[0]))]
    spark.createDataFrame(pool, "rule string, score double, trial long").write.parquet(d("pool"))
    assert cli.main(["refilter", *base, "--pool", d("pool")], spark) == {"taken": 1, "reasons": {"admitted": 1, "no_gain": 1, "repeated": 1}}
    assert cli.main(["prove", *base, "--out", d("proof")], spark) == {"status": "fixpoint", "proofs": 3}
    assert cli.main(["influence", *base, "--out", d("influence")], spark) == {"status": "fixpoint", "pending": 3, "most": [0, 1, 2]}
    for bad in (["evaluate", *base[:-2]], ["stage", *base[:-2]], ["refilter", *base], ["starts", *base[:4], *base[6:]]):
        with pytest.raises(SystemExit):
            cli.main(bad, spark)


# --- the loop that learns -----------------------------------------------------------------------------------------------


def test_arbitration_of_several_models(spark):
    unknown = spark.createDataFrame([(1, "x"), (2, "x")], "doc_id long, label string")
    cuts = spark.createDataFrame([(a, "x", 0.5) for a in "ab"], "alias string, label string, cut double")
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, alias string, label string, p double")
    both = [(1, "a", "x", 0.5), (1, "b", "x", 0.9), (2, "a", "x", 0.1), (2, "b", "x", 0.4)]
    assert {tuple(r) for r in learning.arbitrate_models(unknown, rows(*both), ("a", "b"), cuts).collect()} == {(1, "x", 1), (2, "x", -1)}
    for bad in (both[:3], [*both[:3], (2, "b", "x", 0.6)]):  # a model is missing; models differ
        with pytest.raises(ValueError, match="cell 2"):
            learning.arbitrate_models(unknown, rows(*bad), ("a", "b"), cuts)


def test_prior_shift(spark):
    probs = spark.createDataFrame([(1, "m", "x", 0.2, False), (2, "m", "x", 0.4, False), (3, "m", "y", 0.3, False), (4, "m", "x", 1.0, False)], "doc_id long, alias string, label string, p double, is_static boolean")
    cells = spark.createDataFrame([(1, "x", 1, 1.0), (2, "x", 1, 0.5)], "doc_id long, label string, target int, weight double")
    got = {r.doc_id: r.p for r in learning.prior_shift(cells, probs).collect()}
    b = math.log(2.5 / 1.4) - math.log(1.0 / (1 + 0.8 + 0.3))
    move = lambda p: 1 / (1 + math.exp(-(math.log(p / (1 - p)) + b)))
    assert got[1] == pytest.approx(move(0.2)) and got[2] == pytest.approx(move(0.4)) and got[3] == 0.3 and got[4] == 1.0


def _taught(spark, shift):
    """Ninety documents; x holds from 0.5 of a hidden value on, the model's odds are off by `shift`; the last thirty calibrate."""
    rnd = random.Random(11)
    hidden = [rnd.random() * 0.98 + 0.01 for _ in range(90)]
    p = [1 / (1 + math.exp(-(math.log(h / (1 - h)) - shift))) for h in hidden]
    docs = spark.createDataFrame([(i, "t", "", "") for i in range(90)], "doc_id long, cnt string, ttl string, mtd string")
    probs = spark.createDataFrame([(i, "m", "x", p[i], False) for i in range(90)], "doc_id long, alias string, label string, p double, is_static boolean")
    signed = spark.createDataFrame([(i, "x", 1 if h >= 0.5 else -1) for i, h in enumerate(hidden)], "doc_id long, label string, sign int")
    return hidden, docs, probs, signed


def test_learning_loop(spark):
    """Answers teach the model what it underrates; refinement that helps on the calibration documents is kept, and the budget holds."""
    hidden, docs, probs, signed = _taught(spark, 1.2)
    axis, gamma = spark.createDataFrame([("x",)], "label string"), spark.createDataFrame([], "doc_id long, label string, sign int")
    rule = Rule((Doc("d"), ML("d", "m", "x", 0.5)), Label("d", "x"))
    asked: list[int] = []

    def answer(batch):
        asked.extend(r.doc_id for r in batch.collect())
        return signed.join(batch, "doc_id", "left_semi")

    out = learning.learning_loop(Catalog(docs, gamma), [rule], axis, probs, answer, 24, signed.where("doc_id >= 60"), how=learning.Settings(batch=12, sure=2.0))
    assert out.status == "label_budget_exhausted" and len(asked) == len(set(asked)) == 24 and max(asked) < 60
    kinds = [e.kind for e in out.events]
    assert kinds[0] == "start" and kinds.count("ask") == 2 and any(e.kind == "refine" and e.kept for e in out.events)
    assert out.events[-1].macro > out.events[0].macro + 0.05
    scores = [e.macro for e in out.events if e.kept]
    assert all(b >= a - 1e-12 for a, b in itertools.pairwise(scores))  # on documents that are never asked
    right = {i for i, h in enumerate(hidden) if h >= 0.5}
    got = {r.doc_id for r in out.outcome.predictions.collect()}
    assert {i for i in asked if i in right} <= got and not got & {i for i in asked if i not in right}


def test_learning_loop_without_work(spark):
    """A model that is right needs no answers; without a budget nothing is asked; a trainer that does harm is not followed."""
    hidden, docs, probs, signed = _taught(spark, 0.0)
    axis = spark.createDataFrame([("x",)], "label string")
    rule = Rule((Doc("d"), ML("d", "m", "x", 0.5)), Label("d", "x"))
    gamma = signed.where("doc_id < 60")
    out = learning.learning_loop(Catalog(docs, gamma), [rule], axis, probs, lambda b: signed, 10, signed.where("doc_id >= 60"), how=learning.Settings(sure=2.0))
    assert out.status == "all_documents_resolved" and [e.kind for e in out.events] == ["start"]
    harm = lambda cells, old: old.withColumn("p", F.lit(0.0))
    less = Catalog(docs, signed.where("doc_id < 10"))
    out = learning.learning_loop(less, [rule, Rule((Doc("d"), ML("d", "m", "x", 0.4)), Label("d", "x"))], axis, probs, lambda b: signed, 0, signed.where("doc_id >= 60"), retrain=harm, how=learning.Settings(sure=2.0))
    assert out.status == "label_budget_exhausted"
    assert [(e.kind, e.kept) for e in out.events] == [("start", True), ("refine", False)] and out.probs.where("p > 0").count() == 90


def test_learning_loop_residual_and_kappa(spark):
    """Cuts fitted on the answers correct the rest, once, if the calibration documents agree."""
    _, docs, probs, signed = _taught(spark, 1.2)
    axis, gamma = spark.createDataFrame([("x",)], "label string"), spark.createDataFrame([], "doc_id long, label string, sign int")
    rule = Rule((Doc("d"), ML("d", "m", "x", 0.5)), Label("d", "x"))
    keep = lambda cells, old: old
    how = learning.Settings(batch=20, sure=2.0, residual=True, calibrate_kappa=True)
    out = learning.learning_loop(Catalog(docs, gamma), [rule], axis, probs, lambda b: signed.join(b, "doc_id", "left_semi"), 40, signed.where("doc_id >= 60"), train=docs, retrain=keep, how=how)
    taken = [e for e in out.events if e.kind == "residual" and e.kept]
    assert len(taken) <= 1 and len(out.rules) >= 1 + len(taken)
    assert out.events[-1].macro >= out.events[0].macro


def test_session_keeps_firings(spark):
    from test_closure import Garden, said

    from marlstone.operators.proof import proof_rows
    from marlstone.operators.session import Session

    g = Garden([("dry", "north"), ("bud", "north")])
    one, two = Rule((Doc("x"), said("dry")), Label("x", "wilts")), Rule((Doc("x"), Label("x", "wilts")), Label("x", "sleeps"))
    s = Session(g.catalog(spark))
    s.close([one])
    c = s.close([one, two])
    rows = {(r.doc_id, r.label): (r.rule_id, r.round) for r in proof_rows(s.cat, [one, two], c).collect()}
    assert s.runs == 2 and rows == {(0, "wilts"): (0, 1), (0, "sleeps"): (1, 1 + s.close([one]).rounds)}


def test_smallest_by_hash(spark):
    import hashlib

    rows = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("h"))
    order = sorted(range(500), key=lambda i: hashlib.sha256(f"t|{i}".encode()).hexdigest())
    for n in (0, 1, 37, 500, 600):
        assert {r.doc_id for r in splits.smallest(rows, "doc_id", n, "t|").collect()} == set(order[:n])
    assert splits.random_sample(rows, "doc_id", 7).count() == 7


def test_reliability(spark, tmp_path):
    """Copies of training texts do not count; a changed program is counted where it changed; a table of other answers is refused."""
    from test_closure import Garden, said

    from marlstone.operators import reliability
    from marlstone.operators.closure import close_program
    from marlstone.operators.session import rule_key

    g = Garden([("dry leaf", ""), ("Dry  LEAF", ""), ("dry bud", ""), ("dry", ""), ("bud", "")])
    cat = g.catalog(spark)
    one, two = Rule((Doc("x"), said("dry")), Label("x", "wilts")), Rule((Doc("x"), Label("x", "wilts")), Label("x", "sleeps", "neg"))
    answers = spark.createDataFrame([(i, "wilts", s) for i, s in ((0, 1), (1, 1), (2, 1), (3, -1), (4, -1))] + [(2, "sleeps", -1)], "doc_id long, label string, sign int")
    training = spark.createDataFrame([(0,)], "doc_id long")
    table = reliability.estimate(cat, [one, two], close_program(cat, [one, two]), answers, training)
    got = {r.rule_key: r for r in table.collect()}
    assert (got[rule_key(one)].support, got[rule_key(one)].correct, got[rule_key(one)].rows) == (2, 1, 3)  # 2 and 3; 0 trains, 1 is its copy
    assert got[rule_key(one)].q == 0.5 and (got[rule_key(two)].support, got[rule_key(two)].correct) == (1, 1)
    reliability.save(table, str(tmp_path / "r"))
    old = reliability.load(spark, str(tmp_path / "r"))
    three = Rule((Doc("x"), said("bud")), Label("x", "wilts"))
    new = reliability.refresh(old, cat, [one, three], close_program(cat, [one, three]), answers, training)
    assert {r.rule_key: (r.support, r.correct) for r in new.collect()} == {rule_key(one): (2, 1), rule_key(three): (2, 1)}
    with pytest.raises(ValueError):
        reliability.load(spark, str(tmp_path / "r"), "other")
    more = reliability.refresh(old, cat, [one], close_program(cat, [one]), answers.where("doc_id <> 3"), training).collect()
    assert [(r.support, r.correct) for r in more] == [(1, 1)]


def test_denial_cuts(spark):
    rnd = random.Random(21)
    rows = [(c, x, round(rnd.random(), 2), int(rnd.random() < q)) for c, x, q in (("a", "x", 0.2), ("a", "y", 0.9), ("b", "x", 0.4)) for _ in range(40)]
    grid = [0.1, 0.3, 0.5, 0.7, 0.9]
    df = spark.createDataFrame(rows, "context string, label string, p double, target int")
    for low, precision, support, gain in ((0.5, 0.7, 5, 1), (0.95, 0.6, 3, 2), (0.5, 0.99, 5, 1)):
        want = set()
        for key in {r[:2] for r in rows}:
            mine = [r for r in rows if r[:2] == key]
            if sum(r[3] for r in mine) / len(mine) < low:
                fits = []
                for cut in grid:
                    n = [r for r in mine if r[2] <= cut]
                    false = sum(1 - r[3] for r in n)
                    if len(n) >= support and false >= precision * len(n) and false - (len(n) - false) >= gain:
                        fits.append((*key, cut, len(n), false))
                want |= {max(fits, key=lambda f: f[2])} if fits else set()
        assert {tuple(r) for r in loop.denial_cuts(df, grid, low, precision, support, gain).collect()} == want
