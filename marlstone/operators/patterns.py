"""Mining and screening of text patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.store import written


def masks(docs: DataFrame, text: str, patterns: dict[str, Column]) -> DataFrame:
    """doc_id, pattern, n (count or 0/1) in one scan, a row for each document and pattern with n > 0. patterns: name -> column.

    Rows come from a stack: an exploded array would be tested for emptiness first, and every pattern matched again.
    """
    made = [c for k, v in patterns.items() for c in (F.lit(k), v.cast("long"))]
    return docs.select("doc_id", F.stack(F.lit(len(patterns)), *made).alias("pattern", "n")).where("n > 0")


def contingency(hits: DataFrame, truth: DataFrame, docs: DataFrame) -> DataFrame:
    """pattern, label, n, s (support), pos, tp, over the documents of docs. hits: doc_id, pattern; truth: doc_id, label."""
    n = docs.select("doc_id").distinct()
    h = written(hits.select("doc_id", "pattern").distinct().join(n, "doc_id", "left_semi"), "hits")  # two counts, one scan of the texts
    t = truth.select("doc_id", "label").distinct().join(n, "doc_id", "left_semi")
    s, pos = h.groupBy("pattern").agg(F.count(F.lit(1)).alias("s")), t.groupBy("label").agg(F.count(F.lit(1)).alias("pos"))
    tp = h.join(t, "doc_id").groupBy("pattern", "label").agg(F.count(F.lit(1)).alias("tp"))
    grid = s.crossJoin(F.broadcast(pos)).crossJoin(F.broadcast(n.agg(F.count(F.lit(1)).alias("n"))))  # labels and one row
    return grid.join(tp, ["pattern", "label"], "left").na.fill(0, ["tp"])


def mcc(c: DataFrame) -> DataFrame:
    x = c.withColumn("d", (F.col("s") * (F.col("n") - F.col("s"))).cast("double") * (F.col("pos") * (F.col("n") - F.col("pos"))).cast("double"))
    return x.withColumn("mcc", F.when(F.col("d") <= 0, 0.0).otherwise((F.col("n") * F.col("tp") - F.col("s") * F.col("pos")) / F.sqrt("d"))).drop("d")


def mutual_information(c: DataFrame) -> DataFrame:
    """In nats, of pattern and label as binary variables."""
    n = F.col("n").cast("double")

    def cell(joint: Column, a: Column, b: Column) -> Column:
        return F.when(joint <= 0, 0.0).otherwise(joint / n * F.log(joint * n / (a * b)))

    s, pos, tp = F.col("s"), F.col("pos"), F.col("tp")
    total = cell(tp, s, pos) + cell(s - tp, s, F.col("n") - pos) + cell(pos - tp, F.col("n") - s, pos) + cell(F.col("n") - s - pos + tp, F.col("n") - s, F.col("n") - pos)
    return c.withColumn("mi", F.greatest(total, F.lit(0.0)))


def label_entropy(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """pattern, entropy: -sum of P ln P over labels, P the share of the pattern's documents with the label (not normalised over labels)."""
    s = written(hits.select("doc_id", "pattern").distinct(), "hits")  # two counts, one scan of the texts
    n = s.groupBy("pattern").agg(F.count(F.lit(1)).alias("s"))
    tp = s.join(truth.select("doc_id", "label").distinct(), "doc_id").groupBy("pattern", "label").agg(F.count(F.lit(1)).alias("tp"))
    p = F.col("tp") / F.col("s")
    return n.join(tp, "pattern", "left").groupBy("pattern").agg(F.coalesce(F.sum(-p * F.log(p)), F.lit(0.0)).alias("entropy"), F.max("s").alias("support"))


def histogram_entropy(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """pattern, entropy of the normalised histogram of its documents' labels."""
    tp = hits.select("doc_id", "pattern").distinct().join(truth.select("doc_id", "label").distinct(), "doc_id").groupBy("pattern", "label").agg(F.count(F.lit(1)).alias("tp"))
    p = F.col("tp") / F.sum("tp").over(Window.partitionBy("pattern"))
    return tp.withColumn("p", p).groupBy("pattern").agg(F.sum(-F.col("p") * F.log("p")).alias("entropy"))


def support_screen(hits: DataFrame, n: int, low: float, high: float = 1.0) -> DataFrame:
    return hits.groupBy("pattern").agg(F.count_distinct("doc_id").alias("support")).where((F.col("support") / n >= low) & (F.col("support") / n <= high))


def frequency_partitions(counts: DataFrame) -> DataFrame:
    """pattern, op, eta, support for all distinct splits of the documents by count op eta, op in >=, <=, ==, !=. counts: doc_id, pattern, n (0 too)."""
    by = counts.groupBy("pattern", "n").agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("pattern").orderBy("n")
    x = by.withColumn("le", F.sum("c").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("c").over(Window.partitionBy("pattern")))
    made = F.array(*[F.struct(F.lit(op).alias("op"), s.alias("support")) for op, s in ((">=", F.col("all") - F.col("le") + F.col("c")), ("<=", F.col("le")), ("==", F.col("c")), ("!=", F.col("all") - F.col("c")))])
    return x.select("pattern", F.col("n").alias("eta"), F.explode(made).alias("m")).select("pattern", "m.op", "eta", "m.support").where("support > 0")


def implications(truth: DataFrame, least: float = 0.98) -> DataFrame:
    """i, j, share: how often documents with label i have j, from `least` on."""
    t = truth.select("doc_id", "label").distinct()
    n = t.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    both = t.alias("a").join(t.alias("b"), F.col("a.doc_id") == F.col("b.doc_id")).where("a.label <> b.label").groupBy(F.col("a.label").alias("i"), F.col("b.label").alias("j")).agg(F.count(F.lit(1)).alias("c"))
    return both.join(n.withColumnRenamed("label", "i"), "i").select("i", "j", (F.col("c") / F.col("n")).alias("share")).where(F.col("share") >= least)


def attribute_statistics(docs: DataFrame, keys: list[str]) -> DataFrame:
    """attribute, groups, pairs (sum of squared sizes), mean_partners, in_groups (share of documents in a group of two or more)."""
    made = F.explode(F.array(*[F.struct(F.lit(k).alias("attribute"), F.col(k).alias("value")) for k in keys])).alias("m")
    g = docs.select(made).select("m.*").where("value is not null and value <> ''").groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("attribute").agg(F.count(F.lit(1)).alias("groups"), F.sum(F.col("n") * F.col("n")).alias("pairs"), (F.sum(F.col("n") * (F.col("n") - 1)) / F.sum("n")).alias("mean_partners"), (F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)) / F.sum("n")).alias("in_groups"))


def duplicate_masks(hits: DataFrame) -> DataFrame:
    """pattern, first: patterns that hold on the same documents, with the first of them by name. Masks are compared by size and two sums of hashes."""
    h = hits.select("doc_id", "pattern").distinct()
    key = h.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("a"), F.sum(F.xxhash64("doc_id", F.lit(1)).cast("decimal(38,0)")).alias("b"))
    return key.withColumn("first", F.min("pattern").over(Window.partitionBy("n", "a", "b"))).select("pattern", "first")


def top_by(scored: DataFrame, group: str, order: list[Column], quota: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(*order)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= quota)


def frequent_picks(scored: DataFrame, group: str, name: str, order: list[Column], k: int) -> DataFrame:
    """name, picks: the k names that are most often among a group's k best; ties by name."""
    return top_by(scored, group, order, k).groupBy(name).agg(F.count(F.lit(1)).alias("picks")).orderBy(F.desc("picks"), name).limit(k)


def shortlist(scored: DataFrame, limit: int) -> DataFrame:
    """Union of the top `limit` by gain and the top half by tp / sqrt(tp + fp) of each label."""
    a = Window.partitionBy("label").orderBy(F.desc("gain"), "pattern")
    b = Window.partitionBy("label").orderBy(F.desc("strength"), "pattern")
    x = scored.withColumn("strength", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / F.sqrt(F.col("tp") + F.col("fp"))).otherwise(0.0))
    return x.withColumns({"ra": F.row_number().over(a), "rb": F.row_number().over(b)}).where((F.col("ra") <= limit) | (F.col("rb") <= limit // 2)).drop("ra", "rb")


def residual_gain(hits: DataFrame, pred: DataFrame, truth: DataFrame, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """pattern, label, tp, fp, gain: change of .8 macro + .2 micro F1 if the pattern's documents get the label too."""
    from marlstone.operators.metrics import confusion, f1

    key = ["doc_id", "label"]
    open_cells = hits.select("doc_id", "pattern").distinct().crossJoin(F.broadcast(labels.select("label"))).join(pred.select(*key).distinct(), key, "left_anti")
    add = open_cells.join(truth.select(*key).distinct().withColumn("t", F.lit(1)), key, "left").groupBy("pattern", "label").agg(F.count("t").alias("tp"), F.count_if(F.col("t").isNull()).alias("fp"))
    now = confusion(pred, truth, labels)
    total = now.agg(F.sum("tp").alias("tp0"), F.sum("fp").alias("fp0"), F.sum("fn").alias("fn0"), F.count(F.lit(1)).alias("k"))
    x = add.join(now.select("label", F.col("tp").alias("ltp"), F.col("fp").alias("lfp"), F.col("fn").alias("lfn"), F.col("f1").alias("lf1")), "label").crossJoin(F.broadcast(total))
    macro = (f1(F.col("ltp") + F.col("tp"), F.col("lfp") + F.col("fp"), F.col("lfn") - F.col("tp")) - F.col("lf1")) / F.col("k")
    micro = f1(F.col("tp0") + F.col("tp"), F.col("fp0") + F.col("fp"), F.col("fn0") - F.col("tp")) - f1(F.col("tp0"), F.col("fp0"), F.col("fn0"))
    return x.select("pattern", "label", "tp", "fp", (0.8 * macro + 0.2 * micro).alias("gain"))


def tfidf_top(docs: DataFrame, cluster: str, text: str, top: int) -> DataFrame:
    """cluster, token, score: mean TF-IDF of ASCII word tokens a cluster, the `top` best, ties by token."""
    # A document counts a token once for df and as often as it has it for tf: both come from one aggregation by (cluster, token).
    one = F.regexp_extract_all(F.lower(text), F.lit("[a-z]{2,}"), 0)
    tf = docs.select(F.col(cluster).alias("cluster"), F.explode(one).alias("token")).groupBy("cluster", "token").agg(F.count(F.lit(1)).alias("tf"))
    by = docs.select(F.col(cluster).alias("cluster"), F.explode(F.array_distinct(one)).alias("token")).groupBy("cluster", "token").agg(F.count(F.lit(1)).alias("d"))
    both = tf.join(by, ["cluster", "token"]).withColumn("df", F.sum("d").over(Window.partitionBy("token")))  # a row a cluster and token
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    size = docs.groupBy(F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    score = F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1) / F.col("size")
    s = both.crossJoin(F.broadcast(n)).join(size, "cluster").select("cluster", "token", F.round(score, 6).alias("score"))
    return top_by(s, "cluster", [F.desc("score"), F.col("token")], top)


def mask_bits(hits: DataFrame) -> DataFrame:
    """pattern, bucket, bits: the documents of a pattern as bitmaps of 32,768 ids each; the union of rows is bitmap_or_agg, their number bitmap_count."""
    h = hits.select("pattern", "doc_id").distinct()
    return h.groupBy("pattern", F.bitmap_bucket_number("doc_id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias("bits"))
