"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Each document of size c in source s gets the rate min(cap, exp(l_s * c / mean_s)): of all rates that give
the source its target of words, these are the ones closest to 1 in relative entropy. The multipliers l_s
solve the convex dual, one equation a source, by safeguarded Newton steps. A rate depends on source and
size only, so the steps run on the histogram of (source, size), aggregated once, never on the documents.
Rates are then rounded to whole copies by carrying each source's error from the large sizes to the small
ones, which leaves an error of about the source's smallest documents. Which of the documents of one size
get the extra copy is decided by a hash of the id, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import text_of, written


def word_count(text: Column) -> Column:
    """Number of words, as runs of anything but ASCII blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def targets_of(sources: DataFrame, cap: float, share: float) -> DataFrame:
    """Add target: share of all words dealt by weight, none above cap times its source, the excess dealt again.

    sources: one row a source with key, weight, source_size. In order of cap * size / weight a source is at
    its cap if what is left after all earlier ones are at theirs would still exceed it.
    """
    total = sources.agg((F.sum("source_size") * share).alias("all_words"), F.sum("weight").cast("double").alias("all_weight"))
    before = Window.orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, -1)
    s = sources.withColumn("most", F.col("source_size") * cap).withColumn("ratio", F.col("most") / F.col("weight")).crossJoin(F.broadcast(total))
    left = F.col("all_words") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weights = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("level", left / weights).withColumn("full", F.col("level") >= F.col("ratio"))
    # The first source below its cap has the level of all that are below theirs.
    level = s.where(~F.col("full")).agg(F.min_by("level", F.struct("ratio", "key")).alias("final"))
    return s.crossJoin(F.broadcast(level)).select("key", "weight", "source_size", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def multipliers(cells: DataFrame, sources: DataFrame, cap: float, steps: int = 40, close: float = 1e-7) -> DataFrame:
    """Solve the dual for each source: add rate_log, the l of exp(l * size / mean), to sources.

    Newton on the logarithm of the words that a multiplier gives, kept inside a bracket by bisection. Each
    round is one join and one aggregation of the histogram by source, which carries the source's own values
    along, so that a plan is as long as its rounds; three rounds go into a written table.
    """
    span = 60.0
    mean = cells.groupBy("key").agg((F.sum("words") / F.sum("n")).alias("mean"))
    now = sources.join(mean, "key").select("key", "target", "source_size", "mean", F.lit(-span * 20).alias("low"), F.lit(span * 20).alias("high"), F.lit(0.0).alias("l"))
    solvable = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap * (1 - 1e-12))
    now = now.where(solvable)
    for k in range(steps):
        x = F.col("l") * F.col("size") / F.col("mean")
        rate = F.least(F.lit(cap), F.exp(F.least(x, F.lit(700.0))))
        free = F.when(F.exp(F.least(x, F.lit(700.0))) < cap, rate * F.col("size") / F.col("mean")).otherwise(0.0)
        own = [F.first(c).alias(c) for c in now.columns if c != "key"]  # one value a source
        s = cells.select("key", "size", "words").join(now, "key").groupBy("key").agg(*own, F.sum(F.col("words") * rate).alias("g"), F.sum(F.col("words") * free).alias("slope"))
        above = F.col("g") > F.col("target")
        low, high = F.when(above, F.col("low")).otherwise(F.col("l")), F.when(above, F.col("l")).otherwise(F.col("high"))
        s = s.withColumn("low", low).withColumn("high", high)
        step = F.col("l") - F.ln(F.greatest(F.col("g"), F.lit(1e-300)) / F.col("target")) * F.col("g") / F.col("slope")
        good = (F.col("slope") > 0) & (step > F.col("low")) & (step < F.col("high"))
        s = s.withColumn("done", F.abs(F.col("g") - F.col("target")) <= close * F.col("target"))
        s = s.withColumn("l", F.when(F.col("done"), F.col("l")).when(good, step).otherwise((F.col("low") + F.col("high")) / 2))
        now = s.select(*now.columns, "done") if k % 3 == 2 else s.select(*now.columns)
        if k % 3 == 2:
            now = written(now, "dual")
            if now.where(~F.col("done")).isEmpty():
                break
            now = now.drop("done")
    return sources.join(now.select("key", F.col("l").alias("rate_log"), "mean"), "key", "left")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3),
        share: float = 1.0, cap: int = 3, group: int = 2000) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, rate, copies, taken.

    Sources in code-point order, null last (null is a source of its own), weigh as `weights` says, over
    and over. A null or empty text has size 0, rate 1 and takes no words; a source of size 0 has target 0.
    A row that repeats another counts as a further document. An empty table gives an empty result; other
    columns are ignored. Of `group` documents or more of one source and size each `group` or so are ranked apart.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("z"))  # 's...' < 'z': null last
    base = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), word_count(text_of(docs, text_col)).alias("size")), "sizes")
    cells = written(base.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")).withColumn("words", F.col("n") * F.col("size")), "cells")
    place = F.row_number().over(Window.orderBy("key")) - 1
    sources = cells.groupBy("key").agg(F.sum("words").alias("source_size"))
    sources = sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    targets = written(targets_of(sources, cap, share), "targets")
    solved = written(multipliers(cells, targets, cap), "sources")
    x = F.least(F.col("rate_log") * F.col("size") / F.col("mean"), F.lit(700.0))
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(F.col("rate_log").isNull(), float(cap)).otherwise(F.least(F.lit(float(cap)), F.exp(x)))
    rated = cells.join(solved, "key").withColumn("rate", rate)
    # Whole copies for each (source, size): the words still owed go from large sizes to small ones.
    cell = F.struct("size", "n", "rate")
    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<size:bigint,n:bigint,rate:double,copies:bigint>>").alias("out"))

    def carry(acc: Column, c: Column) -> Column:
        wanted = acc.owed + c.n * c.rate * c.size
        whole = F.when(c.size == 0, c.n).otherwise(F.least(F.ceil(c.rate) * c.n, F.greatest(F.floor(c.rate) * c.n, F.round(wanted / F.greatest(c.size, F.lit(1))))).cast("long"))
        return F.struct((wanted - whole * c.size).alias("owed"), F.concat(acc.out, F.array(F.struct(c.size.alias("size"), c.n.alias("n"), c.rate.alias("rate"), whole.alias("copies")))).alias("out"))

    # Sizes of a source in bands of 1024: the carry runs along one band's sizes, then along the bands' remainders.
    bands = rated.withColumn("band", F.floor(F.col("size") / 1024)).groupBy("key", "band").agg(F.reverse(F.array_sort(F.collect_list(cell))).alias("cells"))
    dealt = bands.select("key", F.aggregate("cells", start, carry).alias("a")).select("key", F.explode("a.out").alias("c")).select("key", "c.*")
    # What the bands leave owed in all is settled by whole documents of fitting size.
    owed = dealt.groupBy("key").agg(F.sum((F.col("rate") * F.col("n") - F.col("copies")) * F.col("size")).alias("owed"))
    dealt = written(dealt.join(owed, "key"), "copies")
    room = F.when(F.col("owed") > 0, F.least(F.col("n") * cap - F.col("copies"), F.lit(1))).otherwise(F.least(F.col("copies"), F.lit(1)))
    fits = (F.col("size") > 0) & (F.col("size") <= F.abs("owed")) & (room > 0)
    last = Window.partitionBy("key", F.floor(F.log2(F.col("size")) * 8)).orderBy("size")
    few = dealt.where(fits).withColumn("place", F.row_number().over(last)).where("place = 1")  # a few sizes of each magnitude
    pay = F.aggregate(F.reverse(F.array_sort(F.collect_list("size"))), F.struct(F.abs(F.max("owed")).alias("left"), F.array().cast("array<bigint>").alias("sizes")),
                      lambda a, s: F.when(s <= a.left + 0.5, F.struct((a.left - s).alias("left"), F.concat(a.sizes, F.array(s)).alias("sizes"))).otherwise(a))
    paid = few.groupBy("key").agg(pay.alias("p"), F.signum(F.max("owed")).cast("long").alias("by")).select("key", "by", F.explode("p.sizes").alias("size"))
    final = dealt.join(paid, ["key", "size"], "left").select("key", "size", "n", "rate", (F.col("copies") + F.coalesce("by", F.lit(0))).alias("copies"))
    final = final.withColumns({"each": F.floor(F.col("copies") / F.col("n")), "more": F.col("copies") % F.col("n"), "parts": F.ceil(F.col("n") / group)})
    # Which documents get one more: the first by hash; large cells are cut into parts that are ranked apart.
    mixed = base.join(final.join(solved.select("key", "source_size", "target"), "key"), ["key", "size"])
    mixed = mixed.withColumn("h", F.xxhash64("doc_id", F.lit("mix"))).withColumn("part", F.pmod(F.col("h"), F.col("parts")))
    held = mixed.where("parts > 1 and more > 0").groupBy("key", "size", "part").agg(F.count(F.lit(1)).alias("in_part"))
    upto = Window.partitionBy("key", "size").orderBy("part")
    held = held.withColumn("to", F.sum("in_part").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    mixed = mixed.join(held, ["key", "size", "part"], "left")
    share_to = lambda c: F.floor(F.col("more") * c / F.col("n"))
    extra = F.when(F.col("to").isNull(), F.col("more")).otherwise(share_to(F.col("to")) - share_to(F.col("to") - F.col("in_part")))
    rank = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy("h"))
    mixed = mixed.withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.col("each") + F.when(rank <= extra, 1).otherwise(0)).cast("long"))
    return mixed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, all columns, each as often as the mix takes it. Rows that share an id (or have none) are taken equally often."""
    copies = mix(docs, id_col=id_col, **how).groupBy(F.col("doc_id").alias("mixed_id_")).agg(F.max("copies").alias("copies_")).where("copies_ > 0")
    taken = docs.join(copies, F.col(id_col).cast("long").eqNullSafe(F.col("mixed_id_")))
    return taken.withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_")))).select(*docs.columns)
