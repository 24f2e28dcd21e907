"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import drop_path, free_shuffles, new_path, written


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges (a, b) -> (v, component), component being the smallest vertex reachable; for vertices of edges with a <> b. The result is a written table.

    Each half-round is one aggregation by vertex and one join back, which adaptive execution can split where
    a vertex has very many edges; each round is written to the shared folder. Nothing is collected but two
    numbers that tell whether a round changed the edges. Running out of rounds is an error.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    before, last = None, None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(now.select(F.col("b").alias("v"), F.col("a").alias("u")))
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # Small star: the edges point to the smaller vertex already.
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a")
        after = small.select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(smallest.select("a", F.col("m").alias("b"))).distinct()
        path = new_path(spark, "edges")
        after.write.parquet(path)
        now = spark.read.schema(after.schema).parquet(path)
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if last:
            drop_path(spark, last)
        last = path
        free_shuffles(spark)
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components are not complete after {rounds} rounds")
    roots = now.select(F.col("b").alias("v")).distinct()
    out = written(now.select(F.col("a").alias("v"), F.col("b").alias("component")).unionByName(roots.select("v", F.col("v").alias("component"))), "components")
    drop_path(spark, last)
    return out
