"""Splits, samples, versions and groups of rows, all by SHA-256 so that they do not depend on row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.store import written


def rank_key(tag: str, domain: str, seed: int, key: Column) -> Column:
    """SHA-256 of a JSON list of tag, domain, seed and key."""
    j = lambda c: F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.sha2(F.concat(F.lit(f'["{tag}","{domain}",{seed},'), j(key.cast("string")), F.lit("]")), 256)


def hash_split(rows: DataFrame, unit: str, fractions: tuple[float, float, float], tag: str = "split", domain: str = "rows", seed: int = 0) -> DataFrame:
    """rows with role: units (rows or groups) in hash order, the first floor(n f) train, the next dev, at least one each, the rest test.

    Ranks come from two levels: a count by hash prefix and a rank inside each prefix, so no task sorts all units.
    """
    units = rows.select(F.col(unit).alias("u")).distinct().withColumn("h", rank_key(tag, domain, seed, F.col("u"))).withColumn("b", F.substring("h", 1, 3))
    sizes = units.groupBy("b").agg(F.count(F.lit(1)).alias("c"))  # 4096 rows at most
    base = sizes.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum("c").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ranked = units.join(F.broadcast(base), "b").withColumn("place", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("h", "u")))
    train, dev = F.greatest(F.floor(F.col("n") * fractions[0]), F.lit(1)), F.greatest(F.floor(F.col("n") * fractions[1]), F.lit(1))
    role = F.when(F.col("place") <= train, "train").when(F.col("place") <= train + dev, "dev").otherwise("test")
    return rows.join(ranked.select(F.col("u").alias(unit), role.alias("role")), unit)


def text_role(text: Column, seed: str, train: float, dev: float) -> Column:
    """Role by the first 64 bits of SHA-256 of seed, NUL and the text's group, as a share of 2^64: train below `train`, dev below train + dev, else test.

    The group is the SHA-256 of the text in lower case with white space collapsed, so equal texts share a role.
    """
    group = F.sha2(F.regexp_replace(F.lower(F.trim(text)), r"\s+", " "), 256)
    u = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + "\0"), group), 256), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)
    return F.when(u < train, "train").when(u < train + dev, "dev").otherwise("test")


def smallest(rows: DataFrame, key: str, n: int, tag: str) -> DataFrame:
    """The n rows of smallest SHA-256 of tag and key, however large n is: the prefix of the n-th hash comes from counts by prefix, and only rows of
    that prefix are ranked. Rows of one key share a hash; which of them are taken where n cuts between them is not defined."""
    h = rows.withColumn("h_", F.sha2(F.concat(F.lit(tag), F.col(key).cast("string")), 256)).withColumn("b_", F.substring("h_", 1, 4))
    sizes = h.groupBy("b_").agg(F.count(F.lit(1)).alias("c"))  # 65,536 rows at most
    before = sizes.select("b_", "c", F.coalesce(F.sum("c").over(Window.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_")).where(F.col("before_") < n)
    within = h.join(F.broadcast(before), "b_")
    whole = within.where(F.col("before_") + F.col("c") <= n)
    last = within.where(F.col("before_") + F.col("c") > n).withColumn("r_", F.row_number().over(Window.partitionBy("b_").orderBy("h_"))).where(F.col("before_") + F.col("r_") <= n)
    return whole.select(*rows.columns).unionByName(last.select(*rows.columns))


def stable_cap(rows: DataFrame, key: str, cap: int, namespace: str = "cap") -> DataFrame:
    return smallest(rows, key, cap, namespace + "|")


def known_rows(rows: DataFrame, key: str, num: int, den: int, dataset: str = "d", seed: int = 0) -> DataFrame:
    """The ceil(n num / den) rows of smallest hash."""
    n = rows.count()
    return smallest(rows, key, -(-n * num // den), f"select|{dataset}|known|{seed}|")


def group_folds(rows: DataFrame, group: str, folds: int, seed: int = 0) -> DataFrame:
    """rows with fold: groups in hash order, dealt in turn; ranks come from counts by hash prefix and a rank inside each prefix."""
    g = rows.select(F.col(group).alias("g")).distinct().withColumn("h", F.sha2(F.concat(F.lit(f"{seed}|"), F.col("g").cast("string")), 256)).withColumn("b", F.substring("h", 1, 3))
    sizes = g.groupBy("b").agg(F.count(F.lit(1)).alias("c"))  # 4096 rows at most
    before = sizes.select("b", F.coalesce(F.sum("c").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("h", "g")) - 1
    dealt = g.join(F.broadcast(before), "b").withColumn("fold", (place % folds).cast("int"))
    return rows.join(dealt.select(F.col("g").alias(group), "fold"), group)


def latest(rows: DataFrame, key: str, order: list[str], payload: str) -> DataFrame:
    """The row of the largest order of each key, and ties: how many different payloads stand there (more than one is an error)."""
    top = rows.groupBy(key).agg(F.max(F.struct(*order)).alias("top"))
    at = rows.withColumn("here", F.struct(*order)).join(top, key).where("here = top")
    return at.groupBy(key).agg(F.min(payload).alias(payload), F.max("top").alias("top"), F.count_distinct(payload).alias("ties")).select(key, payload, *[F.col(f"top.{c}").alias(c) for c in order], "ties")


def connected_groups(rows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """id, group: rows joined if they share a value of any key, transitively; the group is the smallest id. Min labels by hash-to-min over key stars."""
    made = F.explode(F.array(*[F.when(F.col(k).isNotNull() & (F.col(k) != ""), F.concat(F.lit(f"{i}|"), F.col(k).cast("string"))) for i, k in enumerate(keys)])).alias("key")
    member = written(rows.select(F.col(id_col).alias("id"), made).where("key is not null").distinct(), "members")
    now = rows.select(F.col(id_col).alias("id"), F.col(id_col).alias("group"))
    while True:
        by_key = member.join(now, "id").groupBy("key").agg(F.min("group").alias("m"))
        pulled = member.join(by_key, "key").groupBy("id").agg(F.min("m").alias("m"))
        hop = now.join(pulled, "id", "left").select("id", F.col("group").alias("old"), F.coalesce(F.least("group", "m"), F.col("group")).alias("g"))
        jump = hop.join(now.select(F.col("id").alias("g"), F.col("group").alias("gg")), "g", "left").select("id", "old", F.least("g", F.coalesce("gg", "g")).alias("group"))
        after = written(jump, "groups")
        if after.where("`group` <> old").isEmpty():
            return after.select("id", "group")
        now = after.select("id", "group")


def holdout_audit(parts: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """missing, unknown, repeated: counts that are 0 if parts (key, part) is a partition of rows."""
    p = parts.groupBy(key).agg(F.count_distinct("part").alias("n"))
    x = rows.select(key).distinct().withColumn("r", F.lit(1)).join(p, key, "full")
    return x.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("r").isNull()).alias("unknown"), F.count_if(F.col("n") > 1).alias("repeated"))


def random_sample(rows: DataFrame, key: str, n: int, seed: str = "sample") -> DataFrame:
    """n rows by hash."""
    return stable_cap(rows, key, n, seed)


def dominant_sample(probs: DataFrame, n: int, seed: str = "dominant") -> DataFrame:
    """doc_id, label of n documents or so, as many of each dominant (most probable) label as its share, at least one, by hash."""
    best = probs.groupBy("doc_id").agg(F.max_by("label", F.struct(F.col("p").cast("double"), F.col("label"))).alias("label"))
    sizes = best.groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    total = best.count()
    h = F.sha2(F.concat(F.lit(seed + "|"), F.col("doc_id").cast("string")), 256)
    x = best.join(F.broadcast(sizes), "label").withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(h)))  # labels
    return x.where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.lit(n) * F.col("c") / max(total, 1)))).select("doc_id", "label")


def coverage_sample(truth: DataFrame, n: int, batch: int | None = None) -> DataFrame:
    """doc_id of a greedy sample of n documents that evens out label counts: each batch takes the documents of the largest total label deficit, ties by id."""
    size = batch or max(8, min(128, -(-n // 50)))
    t = truth.select("doc_id", "label").distinct()
    labels = t.select("label").distinct()
    target = max(1, n // max(1, labels.count()))
    taken = written(t.select("doc_id").where("false"), "taken")
    count = 0
    while count < n:
        have = t.join(taken, "doc_id", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("c"))
        need = labels.join(have, "label", "left").select("label", F.greatest(F.lit(target) - F.coalesce("c", F.lit(0)), F.lit(0)).alias("need"))
        best = t.join(taken, "doc_id", "left_anti").join(F.broadcast(need), "label").groupBy("doc_id").agg(F.sum("need").alias("s")).orderBy(F.desc("s"), "doc_id").limit(min(size, n - count)).select("doc_id")
        taken = written(taken.unionByName(best), "taken")
        now = taken.count()
        if now == count:
            break
        count = now
    return taken


def stratified_folds(truth: DataFrame, rows: DataFrame, folds: int, seed: int = 0) -> DataFrame:
    """doc_id, fold: multilabel folds. Documents are put in order of their rarest label (none last), their label set and a hash, and dealt in turn.

    So fold sizes differ by one at most, as do the folds' shares of each rarest label and of each label set. Ranks come from counts by hash
    prefix and a rank inside each; no task orders all documents.
    """
    count = truth.select("doc_id", "label").distinct().groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    per = truth.select("doc_id", "label").distinct().join(count, "label").groupBy("doc_id").agg(F.min(F.struct("c", "label")).alias("rare"), F.array_join(F.array_sort(F.collect_set("label")), "|").alias("all"))
    x = rows.select("doc_id").distinct().join(per, "doc_id", "left").select("doc_id", F.coalesce("rare.c", F.lit(1 << 62)).alias("n"), F.coalesce("rare.label", F.lit("")).alias("rare"), F.coalesce("all", F.lit("")).alias("all"))
    h = F.sha2(F.concat(F.lit(f"{seed}|"), F.col("doc_id").cast("string")), 256)
    x = x.withColumn("h", h).withColumn("b", F.substring("h", 1, 2))
    sizes = x.groupBy("n", "rare", "all", "b").agg(F.count(F.lit(1)).alias("c"))
    labels = sizes.groupBy("n", "rare").agg(F.sum("c").alias("c"))  # a row a label
    start = labels.select("rare", F.coalesce(F.sum("c").over(Window.orderBy("n", "rare").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    inside = Window.partitionBy("rare").orderBy("all", "b").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("inside", F.coalesce(F.sum("c").over(inside), F.lit(0))).join(F.broadcast(start), "rare").select("rare", "all", "b", (F.col("inside") + F.col("start")).alias("before"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("rare", "all", "b").orderBy("h", "doc_id")) - 1
    return x.join(before, ["rare", "all", "b"]).select("doc_id", (place % folds).cast("int").alias("fold"))
