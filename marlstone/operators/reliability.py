"""How reliable rules are, counted on documents whose text training has not seen, kept as a table that names what it was counted on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.operators.closure import Closure
from marlstone.operators.quality import independent_rows
from marlstone.operators.review import rule_precision
from marlstone.operators.session import rule_key, table_key
from marlstone.plans.compile import Catalog, fire
from marlstone.plans.rules import Label, Rule
from marlstone.plans.store import written

CELL = ["doc_id", "label"]
COLUMNS = "rule_key string, support long, correct long, q double, rows long, answers_key string"


def independent_answers(cat: Catalog, answers: DataFrame, training: DataFrame, text: str = "cnt") -> tuple[DataFrame, int, str]:
    """The signed cells that count, of how many documents, and their identity.

    answers: doc_id, label, sign of the calibration documents. Those whose text (white space collapsed, in lower case) a document of
    training (doc_id) has too do not count, so copies across the split give no credit.
    """
    asked = answers.select("doc_id").distinct().join(training.select("doc_id"), "doc_id", "left_anti")
    seen = cat.docs.join(training.select("doc_id"), "doc_id", "left_semi")
    alone = written(independent_rows(cat.docs.join(asked, "doc_id", "left_semi"), seen, text).select("doc_id"), "independent")
    said = written(answers.join(alone, "doc_id", "left_semi").select(*CELL, F.col("sign").cast("int").alias("sign")), "answers")
    return said, alone.count(), table_key(said)


def estimate(cat: Catalog, rules: list[Rule], closure: Closure, answers: DataFrame, training: DataFrame, text: str = "cnt") -> DataFrame:
    """rule_key, support, correct, q, rows, answers_key of rules with a label head, from their conclusions over the closure on independent answers.

    q = (correct + 1) / (support + 2); rows: documents that count; answers_key: what they were counted on (see session.table_key).
    """
    return _count(cat, rules, closure, *independent_answers(cat, answers, training, text))


def _count(cat: Catalog, rules: list[Rule], closure: Closure, said: DataFrame, n: int, identity: str) -> DataFrame:
    spark = cat.docs.sparkSession
    heads = [(i, r) for i, r in enumerate(rules) if isinstance(r.head, Label)]
    if not heads:
        return spark.createDataFrame([], COLUMNS)
    keys = spark.createDataFrame([(i, rule_key(r)) for i, r in heads], "rule_id int, rule_key string")
    made = reduce(DataFrame.unionByName, [fire(r, cat, closure.facts, closure.relation).select(F.lit(i).alias("rule_id"), *CELL, "sign") for i, r in heads])
    out = keys.join(rule_precision(made, said), "rule_id", "left")
    counted = out.select("rule_key", F.coalesce("support", F.lit(0)).cast("long").alias("support"), F.coalesce("correct", F.lit(0)).cast("long").alias("correct"))
    return counted.withColumns({"q": (F.col("correct") + 1) / (F.col("support") + 2), "rows": F.lit(n).cast("long"), "answers_key": F.lit(identity)})


def save(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def load(spark, path: str, answers_key: str | None = None) -> DataFrame:
    """A saved table; an error if it was not counted on the answers of that key, or on several sets of answers."""
    table = spark.read.schema(COLUMNS).parquet(path)
    found = [r["answers_key"] for r in table.select("answers_key").distinct().collect()]
    if len(found) > 1 or (answers_key is not None and found and found != [answers_key]):
        raise ValueError(f"the table was counted on {found}")
    return table


def refresh(old: DataFrame, cat: Catalog, rules: list[Rule], closure: Closure, answers: DataFrame, training: DataFrame, text: str = "cnt") -> DataFrame:
    """The table for a changed program: rules without label premises that it has keep their counts if the answers are the same; all others are counted."""
    said, n, identity = independent_answers(cat, answers, training, text)
    known = {r["rule_key"] for r in old.where(F.col("answers_key") == identity).select("rule_key").collect()}  # a row a rule
    kept = [rule_key(r) for r in rules if not r.reads() and rule_key(r) in known]
    fresh = [r for r in rules if rule_key(r) not in kept]
    return old.where(F.col("rule_key").isin(kept)).unionByName(_count(cat, fresh, closure, said, n, identity))
