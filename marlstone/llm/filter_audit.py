"""Audit of how document filters overlap, for every order in which they could be applied.

Each document fails some subset of the five filters, its mask. The documents are aggregated once, into 32 signed
parity sums for each part and label: the sum over a part's documents of (-1) to the number of filters that both
the mask and the sum's own set hold. These are the Walsh-Hadamard transform of the counts by mask, so the transform
back, divided by 32, gives every count exactly. All else is read off the 32 counts of a part: what a filter removes
after some others, what they removed before it, and its Shapley value, as a document with f failures is removed by
each of the failing filters in 120 / f of the 120 orders.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, slices, text_of, trimmed, words, written

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
MARKS = "[#$%&*|]"
#: Labels by which documents are counted; each is a set of its own.
KINDS = ("all", "good", "toxic")


def failures(texts: pa.Array) -> np.ndarray:
    """The first four filters' bits: A few words, B few distinct words, C many capitals, D a mark."""
    texts = pc.fill_null(texts, "")
    coded, vocabulary, counts = words(texts, lower=False)
    owner = np.repeat(np.arange(len(counts)), counts)
    distinct = np.bincount(np.unique(owner * max(1, len(vocabulary)) + coded) // max(1, len(vocabulary)), minlength=len(counts)).astype(np.int64)
    code_points = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    capitals = pc.count_substring_regex(texts, "[A-Z]").to_numpy(zero_copy_only=False).astype(np.int64)
    marked = pc.match_substring_regex(texts, MARKS).to_numpy(zero_copy_only=False)
    return (counts < 100) + 2 * (100 * distinct < 80 * counts) + 4 * (100 * capitals > 10 * code_points) + 8 * marked


def _masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, most=1 << 20):
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), b.column("same"), pa.array(failures(b.column("text")).astype(np.int32))], ["doc_id", "part", "same", "mask"])


def masks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, part, mask, n: rows that agree in all of them counted together. Equal texts are told by their SHA-256.

    Filter E fails all but the smallest id of a text. No group of copies meets in one task: they are counted by text and id,
    the smallest id of a text is a partial aggregate, and it is looked up by text and id together.
    """
    bounded_batches(docs.sparkSession)
    text = text_of(docs, text_col)
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[lang_col].cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("same"), text.alias("text"))
    rows = rows.mapInArrow(trimmed(_masks), "doc_id long, part string, same binary, mask int").groupBy("same", "doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    rows = written(rows, "masks")
    first = rows.groupBy("same").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    later = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["same", "doc_id"], "left").select("doc_id", "part", (F.col("mask") + F.when(later, 16).otherwise(0)).alias("mask"), "n")


def sign(a: Column, b: Column) -> Column:
    """(-1) to the number of bits that both have."""
    return (1 - 2 * (F.bit_count(a.bitwiseAND(b)) % 2)).cast("long")


def parity_sums(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, kind, sums: 32 signed parity sums of the rows (doc_id, part, mask, n) for all documents, good ones and toxic ones."""
    says = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    kinds = F.filter(F.array(F.lit("all"), F.when(F.col("good") == 1, F.lit("good")), F.when(F.col("toxic") == 1, F.lit("toxic"))), lambda k: k.isNotNull())
    each = rows.join(says, "doc_id", "left").select("part", F.explode(kinds).alias("kind"), "mask", "n")
    sums = each.groupBy("part", "kind").agg(*[F.sum(F.col("n") * sign(F.col("mask"), F.lit(s))).alias(f"s{s}") for s in range(MASKS)])
    return sums.select("part", "kind", F.array(*[f"s{s}" for s in range(MASKS)]).alias("sums"))


def cells(sums: DataFrame) -> DataFrame:
    """part and, for each kind, an array of the counts of documents by mask: the transform back, exact in longs."""
    numbers = F.array(*[F.lit(m) for m in range(MASKS)])
    whole = lambda m: F.aggregate(F.arrays_zip(F.col("sums").alias("v"), numbers.alias("s")), F.lit(0).cast("long"), lambda a, t: a + t["v"] * sign(t["s"], m))
    back = sums.select("part", "kind", F.transform(numbers, lambda m: F.shiftright(whole(m), len(FILTERS))).alias("counts"))
    none = F.array_repeat(F.lit(0).cast("long"), MASKS)
    return back.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("kind") == k, F.col("counts"))), none).alias(k) for k in KINDS])


def orders(parts: DataFrame) -> DataFrame:
    """Each row 600 times, with filter_order, step, and the filters before the step (before) and at it (own) as masks."""
    letters = F.array(*[F.lit(c) for c in FILTERS])
    out = parts.withColumn("filter_order", F.lit(""))
    for _ in FILTERS:
        left = F.filter(letters, lambda c: ~F.contains(F.col("filter_order"), c))
        out = out.withColumn("next", F.explode(left)).withColumn("filter_order", F.concat("filter_order", "next")).drop("next")
    bits = lambda upto: sum((F.when(F.contains(upto, F.lit(c)), 1 << i).otherwise(0) for i, c in enumerate(FILTERS)), F.lit(0))
    out = out.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    out = out.withColumn("before", bits(F.substring(F.col("filter_order"), F.lit(1), F.col("step") - 1)))
    return out.withColumn("own", bits(F.substring(F.col("filter_order"), F.col("step"), F.lit(1))))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """600 rows a part (each value of lang; null is the empty string): filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    A null text is empty. A row without an id has no place in the order of ids: it never fails E, nor makes others fail; of
    rows that share the smallest id of a text none fails E. A document is good or toxic if any row of `labels` with its id
    says so; labels of unknown ids count for nothing. An empty table gives an empty result; other columns are ignored.
    """
    parts = cells(parity_sums(masks(docs, id_col, text_col, lang_col), labels))
    numbers = F.array(*[F.lit(m) for m in range(MASKS)])

    def count(kind: str, holds) -> Column:
        return F.aggregate(F.arrays_zip(F.col(kind).alias("n"), numbers.alias("m")), F.lit(0).cast("long"), lambda a, t: a + F.when(holds(t["m"]), t["n"]).otherwise(0))

    own, before = F.col("own"), F.col("before")
    fails = lambda m: m.bitwiseAND(own) != 0
    gone = lambda m: m.bitwiseAND(before) != 0
    removed = lambda m: fails(m) & ~gone(m)
    share = F.aggregate(F.arrays_zip(F.col("all").alias("n"), numbers.alias("m")), F.lit(0).cast("long"),
                        lambda a, t: a + F.when(fails(t["m"]), t["n"] * (F.lit(120) / F.greatest(F.bit_count(t["m"]), F.lit(1))).cast("long")).otherwise(0))
    return orders(parts).select(
        "part", "filter_order", "step",
        count("all", lambda m: ~fails(m) & ~gone(m)).alias("kept"), count("all", removed).alias("removed"), count("all", lambda m: fails(m) & gone(m)).alias("redundant"),
        count("all", lambda m: m == own).alias("unique_fails"), count("good", removed).alias("good_lost"), count("toxic", removed).alias("toxic_lost"), share.alias("shapley"))


#: Counts by brute force over the documents of each part and order.
ORACLE = r"""
WITH base AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
split AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM base),
failed AS (
  SELECT doc_id, part, len(w) < 100 AS a, 100 * len(list_distinct(w)) < 80 * len(w) AS b,
         100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d, e FROM split),
marked AS (
  SELECT part, CASE WHEN a THEN 'A' ELSE '' END || CASE WHEN b THEN 'B' ELSE '' END || CASE WHEN c THEN 'C' ELSE '' END
               || CASE WHEN d THEN 'D' ELSE '' END || CASE WHEN e THEN 'E' ELSE '' END AS m,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL), false) AS good,
         coalesce(doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL), false) AS toxic FROM failed),
groups AS (
  SELECT part, m, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x FROM marked GROUP BY part, m),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (
  SELECT l1.c || l2.c || l3.c || l4.c || l5.c AS filter_order FROM l l1, l l2, l l3, l l4, l l5
  WHERE len(list_distinct([l1.c, l2.c, l3.c, l4.c, l5.c])) = 5),
s AS (SELECT filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own, CASE WHEN step = 1 THEN '' ELSE filter_order[1:step - 1] END AS before FROM o, range(1, 6) r(step)),
flags AS (
  SELECT part, filter_order, step, own, n, g, x, m, contains(m, own) AS fails,
         before <> '' AND regexp_matches(m, '[' || CASE WHEN before = '' THEN '-' ELSE before END || ']') AS gone FROM groups, s),
steps AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (WHERE NOT fails AND NOT gone), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE fails AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (WHERE fails AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE m = own), 0) AS unique_fails, coalesce(sum(g) FILTER (WHERE fails AND NOT gone), 0) AS good_lost,
         coalesce(sum(x) FILTER (WHERE fails AND NOT gone), 0) AS toxic_lost FROM flags GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM steps
"""
