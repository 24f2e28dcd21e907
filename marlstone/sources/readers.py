"""Readers and writers of the engine's tables; all paths may be in any file system that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import xml_field
from marlstone.plans.rules import Rule, read_program, write_program
from marlstone.plans.store import written

DOCUMENT_JSON = "row_id string, text string, metadata map<string,string>, source string"
ANSWER_JSON = "row_id string, labels array<string>, targets array<int>, provider string, provenance string"


def csv_documents(spark: SparkSession, path: str, text: str, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents, truth) of a CSV file with a text column and 0/1 columns, one a label. Documents are numbered as they are read; equal texts are different documents."""
    schema = ", ".join([f"`{text}` string", *(f"`{x}` int" for x in labels)])
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)
    raw = written(raw.withColumn("doc_id", F.monotonically_increasing_id()), "csv")  # read once: both tables have the same numbers
    stack = F.explode(F.filter(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"`{x}`").alias("y")) for x in labels]), lambda s: s["y"] == 1)).alias("s")
    return raw.select("doc_id", F.col(f"`{text}`").alias("cnt")), raw.select("doc_id", stack).select("doc_id", "s.label")


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, row_id, cnt, ttl, mtd (JSON of the non-blank metadata, by key) and the metadata map."""
    raw = spark.read.schema(DOCUMENT_JSON).json(path)
    meta = F.map_filter("metadata", lambda k, v: v.isNotNull() & (F.trim(v) != ""))
    ordered = F.map_from_entries(F.array_sort(F.map_entries(meta)))
    return raw.select(F.xxhash64("row_id").alias("doc_id"), "row_id", F.coalesce("text", F.lit("")).alias("cnt"), F.coalesce(F.element_at("metadata", "title"), F.lit("")).alias("ttl"), F.to_json(ordered).alias("mtd"), "metadata", "source")


def xml_documents(spark: SparkSession, path: str, fields: list[str], record: str) -> DataFrame:
    """One row a <record> with one column a field; files are read whole and cut at the record's end."""
    whole = spark.read.option("lineSep", f"</{record}>").text(path)
    return whole.where(F.col("value").contains(f"<{record}")).select(*[xml_field(F.col("value"), f).alias(f) for f in fields])


def parquet_documents(spark: SparkSession, path: str, id_col: str, text: str, title: str | None = None, attributes: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, cnt, ttl (the column, else the text's first line), mtd, and mtd_<attribute> columns."""
    raw = spark.read.parquet(path)
    return documents(raw, id_col, text, title, attributes)


def documents(raw: DataFrame, id_col: str, text: str, title: str | None = None, attributes: tuple[str, ...] = ()) -> DataFrame:
    ttl = F.col(title) if title else F.substring_index(F.col(text), "\n", 1)
    return raw.select(F.col(id_col).alias("doc_id"), F.coalesce(text, F.lit("")).alias("cnt"), F.coalesce(ttl, F.lit("")).alias("ttl"), F.lit("").alias("mtd"), *[F.col(a).cast("string").alias(f"mtd_{a}") for a in attributes])


def answers(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """row_id, label, sign of a folder of answer files; malformed ones fail the read. Labels must be declared, targets are 0, 1 or null (unknown)."""
    raw = spark.read.schema(ANSWER_JSON).option("multiLine", True).option("mode", "FAILFAST").json(path)
    bad = (F.size("labels") != F.size("targets")) | (F.size(F.array_except("labels", F.array(*map(F.lit, labels)))) > 0) | (F.size(F.array_distinct("labels")) != F.size("labels")) | F.exists("targets", lambda t: ~F.coalesce(t.isin(0, 1), F.lit(True)))
    checked = raw.withColumn("labels", F.when(bad | F.col("row_id").isNull(), F.raise_error(F.concat(F.lit("bad answer for "), F.coalesce("row_id", F.lit("?"))))).otherwise(F.col("labels")))
    cells = checked.select("row_id", F.explode(F.arrays_zip("labels", "targets")).alias("c")).where("c.targets is not null")
    return cells.select("row_id", F.col("c.labels").alias("label"), F.when(F.col("c.targets") == 1, 1).otherwise(-1).alias("sign"))


def oracle_answers(truth: DataFrame, queries: DataFrame, labels: list[str] | None = None, budget: int | None = None, spent: int = 0) -> DataFrame:
    """The requested rows of a truth table and no others. truth: doc_id, label (positives) or with sign.

    With labels every cell of a requested row is answered, - where the truth has none. More requested rows than what is
    left of the budget are an error, and none is answered.
    """
    asked = queries.select("doc_id").distinct()
    if budget is not None and (n := asked.count()) > budget - spent:
        raise ValueError(f"{n} rows are asked for; {budget - spent} are left")
    known = truth.join(asked, "doc_id", "left_semi")
    if labels is None:
        return known
    axis = F.explode(F.array(*map(F.lit, labels))).alias("label")
    signed = known if "sign" in known.columns else known.withColumn("sign", F.lit(1))
    return asked.select("doc_id", axis).join(signed.select("doc_id", "label", "sign"), ["doc_id", "label"], "left").select("doc_id", "label", F.coalesce("sign", F.lit(-1)).alias("sign"))


def write_truth(answers: DataFrame, docs: DataFrame, labels: list[str], path: str) -> None:
    """A truth table as long rows doc_id, label, target, observed: every cell of the axis, unobserved ones with target false."""
    axis = F.explode(F.array(*map(F.lit, labels))).alias("label")
    cells = docs.select("doc_id").distinct().select("doc_id", axis).join(answers.select("doc_id", "label", "sign").distinct(), ["doc_id", "label"], "left")
    cells.select("doc_id", "label", F.coalesce(F.col("sign") > 0, F.lit(False)).alias("target"), F.col("sign").isNotNull().alias("observed")).write.mode("overwrite").parquet(path)


def read_truth(spark: SparkSession, path: str, labels: list[str]) -> DataFrame:
    """doc_id, label, sign of the observed cells; an undeclared label, or a target that is not observed, fails the read."""
    raw = spark.read.parquet(path)
    bad = ~F.col("label").isin(*labels) | (F.col("target") & ~F.col("observed"))
    ok = F.when(bad, F.raise_error(F.concat(F.lit("bad truth cell "), F.col("label"))).cast("boolean")).otherwise(F.col("observed"))
    return raw.where(ok).select("doc_id", "label", F.when(F.col("target"), 1).otherwise(-1).alias("sign"))


def materialise(rows: DataFrame, truth: DataFrame, labels: list[str], path: str) -> DataFrame:
    """Write rows (doc_id, cnt, role) and their truth by role under path; returns the quality report of the roles.

    A repeated id, an empty text or an undeclared label is an error before anything is written.
    """
    empty = F.coalesce(F.trim("cnt"), F.lit("")) == ""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("ids"), F.count_if(empty).alias("empty")).first()
    if r["n"] != r["ids"] or r["empty"]:
        raise ValueError(f"{r['n'] - r['ids']} repeated ids, {r['empty']} empty texts")
    odd = truth.where(~F.col("label").isin(*labels)).select("label").first()
    if odd:
        raise ValueError(f"undeclared label {odd['label']!r}")
    write_roles(rows, f"{path}/documents")
    write_roles(truth.join(rows.select("doc_id", "role"), "doc_id"), f"{path}/truth")
    return quality_report(rows)


def export_closure(closure, path: str, proof: DataFrame | None = None) -> None:
    """Facts as parquet, and the proof rows (operators.proof), if given, as compressed JSON."""
    closure.facts.write.mode("overwrite").parquet(f"{path}/facts")
    if proof is not None:
        proof.write.mode("overwrite").option("compression", "gzip").json(f"{path}/proof")


def read_rules(spark: SparkSession, path: str) -> tuple[list[str], list[Rule]]:
    return read_program(spark.read.option("wholetext", True).text(path).first()["value"])


def write_rules(spark: SparkSession, path: str, labels: list[str], rules: list[Rule]) -> None:
    spark.createDataFrame([(write_program(labels, rules),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_roles(rows: DataFrame, path: str) -> None:
    """One folder a role."""
    rows.write.mode("overwrite").partitionBy("role").parquet(path)


def quality_report(rows: DataFrame) -> DataFrame:
    """role, rows, empty, repeated_text (rows beyond the first of each text)."""
    return rows.groupBy("role").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce(F.trim("cnt"), F.lit("")) == "").alias("empty"), (F.count(F.lit(1)) - F.count_distinct(F.sha2(F.coalesce("cnt", F.lit("")), 256))).alias("repeated_text"))


def model_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """Checked on read: p is in [0, 1] and not NaN."""
    raw = spark.read.parquet(path)
    p = F.col("p").cast("double")
    return raw.withColumn("p", F.when(p.between(0, 1) & ~F.isnan(p), p).otherwise(F.raise_error(F.lit("a probability is outside [0, 1]")).cast("double")))


def append_event(spark: SparkSession, path: str, kind: str, body: str) -> None:
    spark.createDataFrame([(kind, body)], "kind string, body string").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").option("compression", "gzip").json(path)
