"""Exact deduplication by content sort, in DataFrame operations only.

Rows are dealt by sampled splitters over a bounded sort key (the text's first characters and its 64-bit
hash), sorted on disk inside each range so that equal texts stand next to each other, and compared in
full with their neighbour. Texts that a count of hashes shows to be very frequent are first split into
salted runs; only the leaders of those runs are sorted once more, so no group of copies meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import text_of, written


def _runs(rows: DataFrame, key: list[str], sizes: Column) -> DataFrame:
    """Sort rows by key and text and find runs of equal neighbours: adds keep_id, group_size and first."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *[F.col(k) for k in key])
    near = Window.partitionBy(*key).orderBy("text", F.col("doc_id").desc_nulls_last())
    fresh = F.when(F.lag("text").over(near) == F.col("text"), 0).otherwise(1)
    numbered = dealt.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(near.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*key, "run")
    return numbered.withColumns({"keep_id": F.max("doc_id").over(run), "group_size": F.sum(sizes).over(run), "first": F.col("fresh") == 1})


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_least: int = 100, hot_share: float = 1e-4) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are (a null text counts as empty); the row with the largest id of a
    group stays. Null ids sort last and stay only where a group has no other; of rows that repeat the
    same id and text one stays. An empty table gives an empty result; other columns are ignored.
    A text is hot when it has more than hot_least copies and more than hot_share of all rows: at most
    1 / hot_share texts are, which bounds what is broadcast.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    base = base.withColumn("h", F.xxhash64("text"))
    counts = base.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    # Not more than 1 / hot_share rows, each of 16 bytes.
    often = F.col("n") > F.greatest(F.lit(hot_least).cast("double"), F.col("total") * hot_share)
    hot = written(counts.join(F.broadcast(total), often).select("h", F.ceil(F.col("n") / hot_least).alias("salts")), "hot")
    salted = base.join(F.broadcast(hot), "h", "left").withColumns({
        "head": F.substring("text", 1, 24),
        "salt": F.when(F.col("salts").isNotNull(), 1 + F.pmod(F.xxhash64("doc_id"), F.col("salts"))).otherwise(0),
    }).drop("salts")
    runs = _runs(salted, ["head", "h", "salt"], F.lit(1)).withColumn("text_sha256", F.sha2("text", 256))
    settled = runs.where("salt = 0").select("doc_id", "keep_id", "group_size", F.col("first").alias("kept"), "text_sha256")
    # Hot texts again, by the leaders of their runs; at most hot_share's worth of texts times their salts.
    leaders = runs.where("salt > 0 and first").select("head", "h", "salt", "run", "text", F.col("keep_id").alias("doc_id"), "group_size")
    merged = _runs(leaders.withColumnRenamed("group_size", "part").withColumnRenamed("run", "part_run"), ["head", "h"], F.col("part"))
    merged = merged.select("h", "salt", F.col("part_run").alias("run"), F.col("keep_id").alias("all_id"), F.col("group_size").alias("all_size"), F.col("first").alias("leads"))
    members = runs.where("salt > 0").select("h", "salt", "run", "doc_id", "first", "text_sha256")
    spread = members.join(merged, ["h", "salt", "run"]).select(
        "doc_id", F.col("all_id").alias("keep_id"), F.col("all_size").alias("group_size"), (F.col("first") & F.col("leads")).alias("kept"), "text_sha256")
    return settled.unionByName(spread)


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
