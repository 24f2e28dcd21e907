"""Command line over parquet and JSON files: `python -m marlstone.cli <command> --docs ... --gamma ... --rules ...`; prints one JSON line.

close, evaluate    the program's closure; with --truth its quality
discover, refilter, stage   ordered admission of the file's rules; of a pool of tried rules (--pool); staged changes on two halves of the truth
patterns, starts   all patterns of --attr from a share --least of the documents on; rules of the best fit witnesses
prove, influence   one derivation of each fact; how far each pending row's labels would reach
label, learn       the loop with the truth as answers; with a model that is trained on the way, a fifth of the answered documents calibrating
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import enumeration, space, staged
from marlstone.operators.batch import influence_rank
from marlstone.operators.closure import close_program
from marlstone.operators.discovery import admit, refilter, score_rules
from marlstone.operators.learning import Settings, learning_loop
from marlstone.operators.loop import label_loop
from marlstone.operators.metrics import completeness, confusion, macro_micro
from marlstone.operators.proof import proof_rows
from marlstone.plans.compile import Catalog
from marlstone.plans.rules import Text, read_program, write_program
from marlstone.plans.store import written


def _text_of(spark: SparkSession, path: str) -> str:
    return spark.read.option("wholetext", True).text(path).first()["value"]


def _catalog(spark: SparkSession, a: argparse.Namespace, labels: list[str]) -> Catalog:
    read = spark.read.parquet
    return Catalog(read(a.docs), read(a.gamma), read(a.probs) if a.probs else None, read(a.relations) if a.relations else None, tuple(labels))


def _quality(spark: SparkSession, pred: DataFrame, truth: DataFrame, labels: list[str]) -> dict:
    axis = spark.createDataFrame([(x,) for x in labels], "label string")
    r = macro_micro(confusion(pred, truth, axis)).first().asDict()
    return {k: round(v, 9) if isinstance(v, float) else v for k, v in r.items()} | {"completeness": completeness(pred, truth).first()["completeness"]}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    p = argparse.ArgumentParser(prog="marlstone")
    p.add_argument("command", choices=("close", "evaluate", "discover", "refilter", "stage", "patterns", "starts", "prove", "influence", "label", "learn"))
    for name, need in (("docs", True), ("gamma", True), ("rules", True), ("probs", False), ("relations", False), ("truth", False), ("out", False)):
        p.add_argument(f"--{name}", required=need)
    p.add_argument("--policy", default="halt")
    p.add_argument("--budget", type=int, default=100)
    p.add_argument("--batch", type=int, default=None)
    p.add_argument("--pool")
    p.add_argument("--attr", default="cnt")
    p.add_argument("--least", type=float, default=0.01)
    p.add_argument("--count", type=int, default=30)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    labels, rules = read_program(_text_of(spark, a.rules))
    cat = _catalog(spark, a, labels)
    truth = spark.read.parquet(a.truth) if a.truth else None
    axis = spark.createDataFrame([(x,) for x in labels], "label string")
    save = lambda df: df.write.mode("overwrite").parquet(a.out) if a.out else None
    if a.command in ("discover", "refilter", "stage", "patterns", "starts", "label", "learn") and truth is None:
        p.error(f"{a.command} needs --truth")
    if a.command in ("starts", "label", "learn") and cat.model_prob is None:
        p.error(f"{a.command} needs --probs")
    if a.command == "refilter":
        if not a.pool:
            p.error("refilter needs --pool")
        taken, report = refilter(cat, spark.read.parquet(a.pool), truth, axis, policy=a.policy)
        save(report)
        out = {"taken": len(taken), "reasons": {r["reason"]: r["count"] for r in report.groupBy("reason").count().collect()}}
    elif a.command == "stage":
        half = cat.docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2).alias("h"))
        guards = [x.predicate for r in rules for x in r.body if isinstance(x, Text)]
        got = staged.discover(cat, rules, guards, truth, axis, half.where("h = 0"), half.where("h = 1"), policy=a.policy)
        out = {"steps": [c.kind for c, *_ in got.trace], "rules": len(got.program)}
        if a.out:
            spark.createDataFrame([(write_program(labels, got.program),)], "value string").coalesce(1).write.mode("overwrite").text(a.out)
    elif a.command == "patterns":
        occ = enumeration.occurrences(cat.docs, a.attr, a.least, cat.docs)
        found = written(enumeration.enumerate_patterns(occ, cat.docs, a.attr, truth, cat.docs, axis, a.least), "patterns")
        save(found)
        out = {"patterns": {f"{r['family']} {r['reason']}": r["count"] for r in found.groupBy("family", "reason").count().collect()}}
    elif a.command == "starts":
        models = [(r["alias"], r["label"]) for r in cat.model_prob.select("alias", "label").distinct().orderBy("alias", "label").collect()]  # models and labels
        guards = {f"guard{i}": x.predicate for i, x in enumerate(dict.fromkeys(x for r in rules for x in r.body if isinstance(x, Text)))}
        found = space.starts(space.witnesses(cat, space.Space(tuple(labels), tuple(models), guards), truth, cat.docs), a.count)
        save(found)
        out = {"starts": found.count()}
    elif a.command == "prove":
        c = close_program(cat, rules, a.policy)
        rows = proof_rows(cat, rules, c)
        save(rows)
        out = {"status": c.status, "proofs": rows.count()}
    elif a.command == "influence":
        c = close_program(cat, rules, a.policy)
        open_ = cat.docs.select("doc_id").join(c.predictions().select("doc_id"), "doc_id", "left_anti")
        found = written(influence_rank(cat, rules, c, open_, axis, a.policy), "influence")
        save(found)
        out = {"status": c.status, "pending": found.count(), "most": [r["doc_id"] for r in found.orderBy(F.desc("influence"), "doc_id").limit(5).collect()]}
    elif a.command == "discover":
        scored = {r["rule_id"]: r["f1"] for r in score_rules(cat, rules, truth, axis).groupBy("rule_id").agg(F.max("f1").alias("f1")).collect()}
        taken = admit(cat, rules, [scored.get(i, 0.0) for i in range(len(rules))], truth, axis, policy=a.policy)
        out = {"candidates": len(rules), "taken": taken}
        if a.out:
            text = write_program(labels, [rules[i] for i in taken])
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(a.out)
    elif a.command in ("label", "learn"):
        answers = truth.select("doc_id", "label").withColumn("sign", F.lit(1))

        def answer(asked: DataFrame) -> DataFrame:
            cells = asked.crossJoin(F.broadcast(axis))  # a bounded axis
            return cells.join(answers, ["doc_id", "label"], "left").select("doc_id", "label", F.coalesce("sign", F.lit(-1)).alias("sign"))

        policy = a.policy if a.policy != "halt" else "retain_protect"
        if a.command == "learn":
            held = cat.docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).select("doc_id")
            got = learning_loop(cat, rules, axis, cat.model_prob, answer, a.budget, answer(held), how=Settings(policy=policy, batch=a.batch))
            out = {"status": got.status, "events": [e.__dict__ for e in got.events]} | _quality(spark, got.outcome.predictions, truth, labels)
            save(got.gamma)
            print(json.dumps(out))
            return out
        loop = label_loop(cat, rules, axis, cat.model_prob, answer, a.budget, a.batch, policy=policy)
        out = {"status": loop.status, "rounds": [r.__dict__ for r in loop.rounds]} | _quality(spark, loop.closure.predictions(), truth, labels)
        if a.out:
            loop.gamma.write.mode("overwrite").parquet(a.out)
    else:
        c = close_program(cat, rules, a.policy)
        out = {"status": c.status, "rounds": c.rounds}
        if a.command == "evaluate":
            if truth is None:
                p.error("evaluate needs --truth")
            out |= _quality(spark, c.predictions(), truth, labels)
        else:
            out["facts"] = c.facts.count()
        if a.out:
            c.facts.write.mode("overwrite").parquet(a.out)
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
