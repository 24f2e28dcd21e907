"""Streaming surface of our own: documents arrive in micro-batches, events are counted in windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from marlstone.operators.closure import advance
from marlstone.plans.compile import FACTS, Catalog
from marlstone.plans.rules import Rule
from marlstone.plans.store import dropped, written


def label_stream(docs: DataFrame, gamma: DataFrame, rules: list[Rule], out: str, checkpoint: str, policy: str = "protect") -> StreamingQuery:
    """Close the program as documents arrive, each micro-batch by deltas on what was there before (see closure.advance).

    out/documents and out/facts hold what each batch added, by its number; a batch that is run again starts from the
    batches before it and overwrites its own. A batch that ends in a conflict writes nothing and fails the stream.
    Policies are halt and protect, for rules without label-set relations.
    """
    schema = docs.schema
    fact = ["doc_id", "label", "sign"]

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession

        def before(name: str, like: str | StructType) -> DataFrame:
            if not number:
                return spark.createDataFrame([], like)
            kinds = like if isinstance(like, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in like.fields)
            return spark.read.schema(kinds + ", batch int").parquet(f"{out}/{name}").where(F.col("batch") < number).drop("batch")

        own = written(batch, "batch")
        roots = written(gamma.select("doc_id", "label", F.col("sign").cast("int").alias("sign")).join(own.select("doc_id"), "doc_id", "left_semi"), "roots")
        all_ = before("documents", schema).unionByName(own)
        known = gamma.join(all_.select("doc_id"), "doc_id", "left_semi")
        step = advance(Catalog(all_, known), rules, before("facts", FACTS), own, roots, policy)
        if step.status != "fixpoint":
            raise RuntimeError(f"batch {number} ends as {step.status} and is not written")
        own.write.mode("overwrite").parquet(f"{out}/documents/batch={number}")
        step.added.select(*fact).write.mode("overwrite").parquet(f"{out}/facts/batch={number}")
        dropped(own, roots)

    return docs.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window start, event_type, events, value: tumbling windows; works on a stream (with a watermark) and on a table."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 6).alias("value")).select(F.col("w.start").alias("start"), "event_type", "events", "value")
