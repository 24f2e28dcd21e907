"""Complete enumeration of text patterns over an anchor vocabulary, screened by coverage and label entropy.

Anchors are the words of an attribute from some document frequency on; none is left out by a cap. For every anchor there are
match and, for each of six comparisons and each threshold from 0 to its largest count and one more, frequency patterns;
for every pair of anchors there are cooccur and both orders of before. Pairs are a level above: a pair holds where both anchors
do, so anchors below the least support have no pair that could pass, and pairs below it have no order that could.

Everything is counted from one table of occurrences (document, anchor, count, first place): frequencies by running sums over
the histogram of counts, pairs by ands of bitmaps, orders by a join for the pairs that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.bitmaps import both, pack, size
from marlstone.plans.rules import OPS, Pattern, Predicate
from marlstone.plans.store import written

WORD = r"[\p{L}\p{N}_]+"


def occurrences(docs: DataFrame, attr: str, least: float, fit: DataFrame) -> DataFrame:
    """doc_id, anchor, n, first: words (case does not count) that at least a share `least` of the documents of fit holds; first is the word's place."""
    words = docs.select("doc_id", F.posexplode(F.regexp_extract_all(F.lower(F.coalesce(F.col(attr), F.lit(""))), F.lit(WORD), F.lit(0))).alias("at", "anchor"))
    own = words.join(fit.select("doc_id").distinct(), "doc_id", "left_semi").groupBy("doc_id", "anchor").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    own = written(own, "words")
    total = fit.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("rows"))
    often = own.groupBy("anchor").agg(F.count(F.lit(1)).alias("s")).crossJoin(F.broadcast(total)).where(F.col("s") >= F.col("rows") * least)  # one row
    return written(own.join(often.select("anchor"), "anchor").select("doc_id", "anchor", "n", "first"), "occurrences")


def regex_occurrences(docs: DataFrame, attr: str, patterns: dict[str, Pattern]) -> DataFrame:
    """The same for given regular expressions, all in one scan; first is the character's place."""
    text = F.coalesce(F.col(attr), F.lit(""))
    made = F.array(*[F.struct(F.lit(k).alias("anchor"), F.regexp_count(text, F.lit(p.java())).cast("long").alias("n"), F.regexp_instr(text, F.lit(p.java())).alias("first")) for k, p in patterns.items()])
    return docs.select("doc_id", F.explode(F.filter(made, lambda x: x["n"] > 0)).alias("m")).select("doc_id", "m.*")


def _screen(rows: DataFrame, n: Column, low: float, high: float, most: float) -> DataFrame:
    """Coverage, entropy and reason of rows with support and hist (counts of labels, none 0)."""
    total = F.aggregate("hist", F.lit(0).cast("long"), lambda a, x: a + x)
    terms = F.aggregate("hist", F.lit(0.0), lambda a, x: a - (x / total) * F.log(x / total))
    entropy = F.when(total > 0, terms).otherwise(0.0)
    out = rows.withColumn("coverage", F.col("support") / n).withColumn("entropy", entropy)
    reason = F.when(F.col("coverage") < low, "below_min_coverage").when(F.col("coverage") > high, "above_max_coverage").when(F.col("entropy") >= most, "entropy").otherwise("accepted")
    return out.withColumn("reason", reason).drop("hist")


def frequencies(occ: DataFrame, truth: DataFrame, present: DataFrame, labels: DataFrame) -> DataFrame:
    """anchor, op, eta, support, hist: all comparisons and thresholds, over present documents (doc_id), by running sums.

    present: the documents that have the attribute. A comparison that zero satisfies holds for those without the anchor too.
    """
    slots = F.lit("*")
    seen = occ.join(present, "doc_id", "left_semi")
    with_label = seen.join(truth, "doc_id").select("anchor", F.concat(F.lit("="), "label").alias("slot"), "n")
    counts = seen.select("anchor", slots.alias("slot"), "n").unionByName(with_label).groupBy("anchor", "slot", "n").agg(F.count(F.lit(1)).alias("k"))
    sizes = present.select(slots.alias("slot")).unionByName(truth.join(present, "doc_id", "left_semi").select(F.concat(F.lit("="), "label").alias("slot"))).groupBy("slot").agg(F.count(F.lit(1)).alias("total"))
    all_slots = labels.select(F.concat(F.lit("="), "label").alias("slot")).unionByName(labels.limit(1).select(slots.alias("slot"))).distinct().join(sizes, "slot", "left").na.fill(0, ["total"])
    high = seen.groupBy("anchor").agg(F.max("n").alias("high"))
    grid = high.select("anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("high") + 1)).alias("n")).crossJoin(F.broadcast(all_slots))  # labels and one
    k = grid.join(counts, ["anchor", "slot", "n"], "left").na.fill(0, ["k"])
    own = Window.partitionBy("anchor", "slot")
    # Documents without the anchor are those of threshold 0.
    k = k.withColumn("k", F.when(F.col("n") == 0, F.col("total") - F.sum("k").over(own)).otherwise(F.col("k")))
    le = F.sum("k").over(own.orderBy("n"))
    k = k.withColumn("le", le).withColumn("lt", F.col("le") - F.col("k"))
    value = {"==": F.col("k"), "!=": F.col("total") - F.col("k"), "<": F.col("lt"), "<=": F.col("le"), ">": F.col("total") - F.col("le"), ">=": F.col("total") - F.col("lt")}
    each = k.select("anchor", "slot", F.col("n").alias("eta"), F.explode(F.array(*[F.struct(F.lit(op).alias("op"), value[op].alias("v")) for op in OPS])).alias("o"))
    hist = F.collect_list(F.when((F.col("slot") != "*") & (F.col("o.v") > 0), F.col("o.v")))  # a number a label
    return each.groupBy("anchor", "o.op", "eta").agg(F.max(F.when(F.col("slot") == "*", F.col("o.v"))).alias("support"), hist.alias("hist"))


def pairs(occ: DataFrame, truth: DataFrame, minimum: Column, n: DataFrame) -> DataFrame:
    """family (cooccur, before), anchor, other, support, hist of pairs of anchors whose common support reaches the minimum (a column over n)."""
    enough = n.select(minimum.alias("least"))
    strong = occ.groupBy("anchor").agg(F.count(F.lit(1)).alias("s")).crossJoin(F.broadcast(enough)).where("s >= least").select("anchor")  # one row
    own = occ.join(strong, "anchor")
    bits = written(pack(own, "anchor"), "bits")
    met = bits.withColumnsRenamed({"anchor": "a", "bits": "x"}).join(bits.withColumnsRenamed({"anchor": "b", "bits": "y"}), "block").where(F.col("a") < F.col("b"))
    common = met.groupBy("a", "b").agg(F.sum(size(both(F.col("x"), F.col("y")))).alias("support"))
    common = written(common.crossJoin(F.broadcast(enough)).where(F.col("support") >= F.col("least")).select("a", "b", "support"), "pairs")  # one row
    sides = own.select("doc_id", F.col("anchor").alias("a"), F.col("first").alias("fa")).join(common.select("a", "b"), "a")
    placed = sides.join(own.select("doc_id", F.col("anchor").alias("b"), F.col("first").alias("fb")), ["doc_id", "b"])
    kinds = F.array(F.struct(F.lit("cooccur").alias("family"), F.col("a").alias("anchor"), F.col("b").alias("other")),
                    F.when(F.col("fa") < F.col("fb"), F.struct(F.lit("before").alias("family"), F.col("a").alias("anchor"), F.col("b").alias("other"))),
                    F.when(F.col("fb") < F.col("fa"), F.struct(F.lit("before").alias("family"), F.col("b").alias("anchor"), F.col("a").alias("other"))))
    rows = placed.select("doc_id", F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("p")).select("doc_id", "p.*")
    by_doc = truth.groupBy("doc_id").agg(F.collect_set("label").alias("labels"))
    slot = F.explode(F.concat(F.array(F.lit("*")), F.coalesce(F.transform("labels", lambda x: F.concat(F.lit("="), x)), F.array().cast("array<string>"))))
    counts = rows.join(by_doc, "doc_id", "left").select("family", "anchor", "other", slot.alias("slot")).groupBy("family", "anchor", "other", "slot").agg(F.count(F.lit(1)).alias("k"))
    return counts.groupBy("family", "anchor", "other").agg(F.max(F.when(F.col("slot") == "*", F.col("k"))).alias("support"), F.collect_list(F.when(F.col("slot") != "*", F.col("k"))).alias("hist"))


def enumerate_patterns(occ: DataFrame, docs: DataFrame, attr: str, truth: DataFrame, fit: DataFrame, labels: DataFrame, low: float, high: float = 1.0, most_entropy: float = float("inf")) -> DataFrame:
    """family (match, freq, cooccur, before), anchor, other, op, eta, support, coverage, entropy, reason: the whole universe of patterns over the
    anchors of occ, but for pairs that a support below `low` rules out.

    Counted over the documents of fit (doc_id), coverage being a share of all of them, with the attribute or without. entropy: in nats,
    of the labels of the pattern's documents, 0 if they have none. reason: accepted, below_min_coverage, above_max_coverage or entropy.
    """
    fit = fit.select("doc_id").distinct()
    occ = occ.join(fit, "doc_id", "left_semi")
    truth = truth.select("doc_id", "label").distinct().join(fit, "doc_id", "left_semi").join(labels.select("label"), "label", "left_semi")
    there = docs.where(F.col(attr).isNotNull() & (F.col(attr) != "")).select("doc_id").distinct().join(fit, "doc_id", "left_semi")
    n = written(fit.agg(F.count(F.lit(1)).alias("rows")), "rows")
    freq = written(frequencies(occ, truth, there, labels), "frequencies")
    none = F.lit(None).cast("string")
    match = freq.where("op = '>=' and eta = 1").select(F.lit("match").alias("family"), "anchor", none.alias("other"), none.alias("op"), F.lit(None).cast("long").alias("eta"), "support", "hist")
    every = freq.select(F.lit("freq").alias("family"), "anchor", none.alias("other"), "op", "eta", "support", "hist")
    least = F.ceil(F.col("rows") * low - 1e-9)
    two = pairs(occ, truth, least, n).select("family", "anchor", "other", none.alias("op"), F.lit(None).cast("long").alias("eta"), "support", "hist")
    rows = match.unionByName(every).unionByName(two).crossJoin(F.broadcast(n))  # one row
    return _screen(rows, F.col("rows"), low, high, most_entropy).drop("rows")


def predicates(accepted: DataFrame, attr: str, pattern_of) -> list[Predicate]:
    """Predicates of a chosen, bounded set of rows of enumerate_patterns. pattern_of: from an anchor to its Pattern."""
    out = []
    for r in accepted.orderBy("family", "anchor", "other", "op", "eta").collect():
        two = {"other": pattern_of(r["other"])} if r["other"] is not None else {}
        count = {"op": r["op"], "eta": float(r["eta"])} if r["family"] == "freq" else {}
        out.append(Predicate(r["family"], attr, pattern_of(r["anchor"]), **two, **count))
    return out


def literal(anchor: str) -> Pattern:
    """The pattern of a word anchor: the whole word, in any case."""
    import re

    return Pattern(r"(?<![\p{L}\p{N}_])" + re.escape(anchor) + r"(?![\p{L}\p{N}_])", re.IGNORECASE.value | re.UNICODE.value)
