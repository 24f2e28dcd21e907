"""Joins of documents: attribute groups, similarity with a quorum, top-k neighbours, set-valued groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.plans.relation import components
from marlstone.plans.store import written


def attribute_pairs(docs: DataFrame, keys: list[tuple[str, str]], most: int = 4096) -> DataFrame:
    """x, y for all pairs (self pairs too) with left attribute = right attribute for every key pair; missing never matches.

    The left documents of a group of more than `most` are cut into parts of about as many by a hash of the id, and each part meets all right
    ones in a task of its own: the pairs of a large group are made by many tasks, and none holds more of it than a part.
    """
    ok = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    names = [f"k{i}" for i in range(len(keys))]

    def side(n: int, name: str) -> DataFrame:
        rows = docs
        for pair in keys:
            rows = rows.where(ok(pair[n]))
        rows = rows.select(F.col("doc_id").alias(name), *[F.col(pair[n]).alias(k) for pair, k in zip(keys, names, strict=True)])
        return rows.withColumn("group", F.xxhash64(*names))  # groups that share a hash share their number of parts, nothing else

    left, right = side(0, "x"), side(1, "y")
    large = left.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("group", F.ceil(F.col("n") / most).alias("parts"))
    large = F.broadcast(large)  # a row for each `most` documents at most
    parts = F.coalesce("parts", F.lit(1))
    left = left.join(large, "group", "left").select("x", *names, F.pmod(F.xxhash64("x"), parts).alias("part"))
    right = right.join(large, "group", "left").select("y", *names, F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("part"))
    spark = docs.sparkSession
    # Few rows make many pairs, so the number of tasks does not go by bytes.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
    dealt = lambda rows: rows.repartition(tasks, *names, "part")
    return dealt(right).join(dealt(left), [*names, "part"]).select("x", "y")


def group_reach(docs: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """Documents whose group has an active one: group keys first, so no pair is made."""
    keys = docs.join(active.select("doc_id"), "doc_id", "left_semi").where(F.col(key) != "").select(key).distinct()
    return docs.join(keys, key, "left_semi").select("doc_id")


def set_groups(members: DataFrame, sources: DataFrame, least: int = 1) -> DataFrame:
    """doc_id, sources: documents that share a member with at least `least` distinct source documents. members: doc_id, member."""
    m = members.where(F.col("member").isNotNull() & (F.col("member") != "")).distinct()
    pairs = m.alias("a").join(m.join(sources.select("doc_id"), "doc_id", "left_semi").alias("b"), F.col("a.member") == F.col("b.member"))
    return pairs.groupBy(F.col("a.doc_id").alias("doc_id")).agg(F.count_distinct("b.doc_id").alias("sources")).where(F.col("sources") >= least)


def unit_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v scaled to length 1; zero vectors stay zero."""
    v = vectors.select(F.col(id_col).alias("id"), F.transform(F.col(vec_col), lambda x: x.cast("double")).alias("v"))
    v = v.select("id", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))  # a column, or it would be taken again for each component
    return v.select("id", F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.col("v")).alias("v"))


def _similarities(vectors: DataFrame, queries: DataFrame, least: float, k: int | None, block: int = 4096):
    """Cosines of a stated set of query vectors against all vectors, a block of queries at a time, by Arrow batches.

    Each block of at most `block` queries is broadcast: its size is bounded whatever the tables hold. With k,
    each task keeps a query's k best, which loses none of the k best overall. Vectors with a scope meet those of their own.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    n = queries.count()
    parts = max(1, -(-n // block))
    scope = [F.xxhash64("scope").alias("scope")] if "scope" in vectors.columns else []
    tagged = queries.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
    out = None
    for p in range(parts):
        rows = tagged.where(F.col("part") == p).select("id", "v", *scope).orderBy("id").toArrow()
        if not rows.num_rows:
            continue
        ids, q = rows.column("id").to_numpy(), np.stack(rows.column("v").to_pylist())
        shared = spark.sparkContext.broadcast((ids, q, rows.column("scope").to_numpy() if scope else None))

        def run(batches, shared=shared):
            ids, q, scopes = shared.value
            step = max(1, 500_000 // len(ids))  # rows at a time, so that a matrix has about half a million cells
            best_j, best_id, best_sim = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            worst = np.full(len(ids), least)  # a query's k-th best so far

            def batch(j, own, sim):
                return pa.RecordBatch.from_arrays([pa.array(ids[j]), pa.array(own), pa.array(sim)], ["x", "y", "sim"])

            for b in batches:
                for at in range(0, b.num_rows, step):
                    part = b.slice(at, step)
                    own, v = part.column("id").to_numpy(), part.column("v")
                    if v.null_count:
                        raise ValueError("a vector is null")
                    sims = np.round(v.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) @ q.T, 9)
                    sims[own[:, None] == ids[None, :]] = -2.0
                    if scopes is not None:
                        sims[part.column("scope").to_numpy()[:, None] != scopes[None, :]] = -2.0
                    i, j = np.nonzero(sims >= worst)
                    if k is None:
                        yield batch(j, own[i], sims[i, j])
                        continue
                    if not len(i):
                        continue
                    js, ys, ss = np.concatenate([best_j, j]), np.concatenate([best_id, own[i]]), np.concatenate([best_sim, sims[i, j]])
                    order = np.lexsort((ys, -ss, js))
                    js, ys, ss = js[order], ys[order], ss[order]
                    rank = np.arange(len(js)) - np.searchsorted(js, js)
                    best_j, best_id, best_sim = js[rank < k], ys[rank < k], ss[rank < k]
                    worst[js[rank == k - 1]] = ss[rank == k - 1]
            if k is not None and len(best_j):
                yield batch(best_j, best_id, best_sim)

        found = vectors.select("id", "v", *scope).mapInArrow(run, "x long, y long, sim double")
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], "x long, y long, sim double")


def similarity_quorum(vectors: DataFrame, queries: DataFrame, threshold: float, quorum: int = 1) -> DataFrame:
    """x, sources: query vectors with at least `quorum` others at a cosine of `threshold` or more."""
    return _similarities(vectors, queries, threshold, None).groupBy("x").agg(F.count_distinct("y").alias("sources")).where(F.col("sources") >= quorum)


def _all_nearest(vectors: DataFrame, least: float, k: int, most: int = 32768) -> DataFrame:
    """x, y, sim, nine (sim to nine digits, which ranks): the k best of all others (of its scope, if vectors have one) for each vector, from each
    block that it meets; the k best of all are among them.

    Vectors are dealt into blocks of about `most` at most by a hash of the id, and each pair of blocks is one group: a task holds two blocks, whatever
    the table holds, and their cosines are taken once for both sides.
    """
    import numpy as np
    import pyarrow as pa

    spark = vectors.sparkSession
    if "scope" in vectors.columns:
        v = vectors.where("scope is not null").select("id", "v", F.col("scope").cast("string"))
        sizes = v.groupBy("scope").agg(F.count(F.lit(1)).alias("n"))
        cells = sizes.agg(F.sum(F.col("n").cast("double") * F.col("n"))).first()[0] or 0.0
        v = v.join(sizes, "scope")
    else:
        n = vectors.count()
        cells = n * n
        v = vectors.select("id", "v", F.lit("").alias("scope"), F.lit(n).alias("n"))
    # About as many groups as four a core, unless blocks would be too large or too small for it.
    cores = spark.sparkContext.defaultParallelism
    size = int(min(most, max(512, (cells / (8 * cores)) ** 0.5)))
    parts = F.ceil(F.col("n") / size)
    own = v.select("id", "v", "scope", parts.alias("parts"), F.pmod(F.xxhash64("id"), parts).alias("own"))
    met = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    pairs = met.select("scope", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("second"), "id", "v")

    def better(best, at, ids, sims, turned=False):
        """Puts the k best of ids, which come in rising order from call to call, into the rows `at` of best. turned: sims has a column for each of them."""
        worst, have, best_id, best_sim, best_nine = (x[at] for x in best)  # views
        bound = worst
        if not have.any() and len(ids) >= k:
            sims, turned = (np.ascontiguousarray(sims.T), False) if turned else (sims, False)
            bound = np.maximum(worst, np.partition(sims, len(ids) - k, axis=1)[:, len(ids) - k] - 1e-9)
        cells = np.flatnonzero(sims > (bound[None, :] if turned else bound[:, None]))
        s = sims.ravel()[cells]
        nine = np.round(s, 9)
        i, j = np.divmod(cells, sims.shape[1])
        i, j = (j, i) if turned else (i, j)
        good = (nine >= least) & (nine > np.where(have[i] == k, best_nine[i, k - 1], -3.0))  # of equal ones the smaller id is there already
        if not good.any():
            return
        i, j, s, nine = i[good], j[good], s[good], nine[good]
        rows = np.unique(i)
        kept = np.arange(k) < have[rows, None]
        r, y = np.concatenate([np.repeat(rows, have[rows]), i]), np.concatenate([best_id[rows][kept], ids[j]])
        s, nine = np.concatenate([best_sim[rows][kept], s]), np.concatenate([best_nine[rows][kept], nine])
        order = np.lexsort((y, -nine, r))
        r = r[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        order, r, rank = order[rank < k], r[rank < k], rank[rank < k]
        best_id[r, rank], best_sim[r, rank], best_nine[r, rank] = y[order], s[order], nine[order]
        have[r] = rank + 1  # a row's last rank stays
        last = rank == k - 1
        worst[r[last]] = nine[order][last] + 4e-10  # what is rounded to more is above this

    def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        v = group.column("v")
        if v.null_count:
            raise ValueError("a vector is null")
        ids, second = group.column("id").to_numpy(), group.column("second").to_numpy()
        v = v.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        odd = not np.isfinite(v).all()
        sides = []
        for side in (False, True):
            at = np.flatnonzero(second == side)
            at = at[np.argsort(ids[at], kind="stable")]
            best = np.full(len(at), least - 1e-9), np.zeros(len(at), np.int64), np.zeros((len(at), k), np.int64), np.zeros((len(at), k)), np.zeros((len(at), k))
            sides.append((ids[at], v[at], best))
        (x, vx, best_x), (y, vy, best_y) = sides
        alone = key[1] == key[2]  # a block with itself
        if alone:
            y, vy = x, vx
        for a in range(0, len(x), 2048):  # parts of half a million cells
            for b in range(0, len(y), 256):
                rows, cols = slice(a, a + 2048), slice(b, b + 256)
                sims = vx[rows] @ vy[cols].T
                if odd:
                    sims[~np.isfinite(sims)] = -2.0
                if alone:
                    sims[x[rows, None] == y[None, cols]] = -2.0
                else:
                    better(best_y, cols, x[rows], sims, turned=True)
                better(best_x, rows, y[cols], sims)
        out = [(np.repeat(i, have), *(c[np.arange(k) < have[:, None]] for c in best)) for i, _, (_, have, *best) in sides]
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["x", "y", "sim", "nine"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * cores)  # few rows make much work, so the number does not go by bytes
    return pairs.repartition(tasks, "scope", "a", "b").groupBy("scope", "a", "b").applyInArrow(run, "x long, y long, sim double, nine double")


def top_k(vectors: DataFrame, queries: DataFrame | None, k: int, mode: str = "directed", least: float = -1.0) -> DataFrame:
    """x, y, sim: the k nearest of each query, ties to the smaller id. mode: directed, mutual (x is among y's k nearest too) or symmetric_union.

    Without queries all vectors are queries, and sim is not rounded. A column `scope` in both tables keeps neighbours to the query's own scope.
    """
    w = Window.partitionBy("x").orderBy(F.desc("sim"), "y")
    if queries is None:
        found, w = _all_nearest(vectors, least, k), Window.partitionBy("x").orderBy(F.desc("nine"), "y")
    else:
        found = _similarities(vectors, queries, least, k)
    near = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("x", "y", "sim")
    if mode == "directed":
        return near
    if mode == "mutual":
        other = written(near, "near")
        if queries is None:
            theirs = other
        else:
            theirs = _similarities(vectors, vectors.join(other.select(F.col("y").alias("id")).distinct(), "id", "left_semi"), least, k).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        return other.join(theirs.select(F.col("y").alias("x"), F.col("x").alias("y")), ["x", "y"], "left_semi")
    if mode == "symmetric_union":
        if queries is None:
            near = written(near, "near")  # read twice
        back = near.select(F.col("y").alias("x"), F.col("x").alias("y"), "sim")
        return near.unionByName(back).groupBy("x", "y").agg(F.max("sim").alias("sim"))
    raise ValueError(f"unknown mode {mode}")


def neighbour_sources(edges: DataFrame, facts: DataFrame, gamma: DataFrame, policy: str = "validated", least: int = 1, validated: int = 1) -> DataFrame:
    """doc_id, label, sources: documents with `least` neighbours that have the label, by edges x -> y.

    policy: validated (only roots of gamma count), recursive (any positive fact) or anchored_recursive (any, of which
    `validated` are roots).
    """
    if policy not in ("validated", "recursive", "anchored_recursive"):
        raise ValueError(f"unknown source policy {policy}")
    roots = gamma.where("sign > 0").select("doc_id", "label").distinct().withColumn("root", F.lit(1))
    have = roots if policy == "validated" else facts.where("sign > 0").select("doc_id", "label").distinct().join(roots, ["doc_id", "label"], "left")
    e = edges.select("x", "y").distinct().join(have.withColumnRenamed("doc_id", "y"), "y")
    n = e.groupBy(F.col("x").alias("doc_id"), "label").agg(F.count(F.lit(1)).alias("sources"), F.count("root").alias("roots")).where(F.col("sources") >= least)
    return (n.where(F.col("roots") >= validated) if policy == "anchored_recursive" else n).drop("roots")


def sentence_hits(sentences: DataFrame, patterns: DataFrame, threshold: float) -> DataFrame:
    """doc_id, pattern, n, first: how many of a document's sentences (doc_id, place, v) are as near to a pattern (pattern, v) as `threshold`, and the first of them.

    Vectors are of length 1 (or 0, which is near to nothing). patterns are a program's and are broadcast.
    """
    dot = F.aggregate(F.zip_with("v", "pv", lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda s, x: s + x)
    near = sentences.crossJoin(F.broadcast(patterns.select("pattern", F.col("v").alias("pv")))).where(F.round(dot, 9) >= threshold)
    return near.groupBy("doc_id", "pattern").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))


def similar_before(hits: DataFrame, a: str, b: str) -> DataFrame:
    """Documents in which a sentence like pattern a comes before the first like pattern b; similar_cooccur without the order."""
    both = hits.where(F.col("pattern") == a).select("doc_id", F.col("first").alias("fa")).join(hits.where(F.col("pattern") == b).select("doc_id", F.col("first").alias("fb")), "doc_id")
    return both.where("fa < fb").select("doc_id")


def similar_cooccur(hits: DataFrame, a: str, b: str) -> DataFrame:
    """Documents with a sentence like pattern a and one like pattern b."""
    return hits.where(F.col("pattern") == a).select("doc_id").join(hits.where(F.col("pattern") == b).select("doc_id"), "doc_id", "left_semi")


def complements(masks: DataFrame, docs: DataFrame, a: str, b: str) -> bool:
    """Whether patterns a and b hold on disjoint sets that make up all documents: a missing attribute, on which neither holds, prevents it."""
    m = masks.where(F.col("pattern").isin(a, b)).select("doc_id", "pattern").distinct().groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    r = docs.select("doc_id").distinct().join(m, "doc_id", "left").agg(F.count_if(F.col("n") == 1).alias("one"), F.count(F.lit(1)).alias("all")).first()
    return r["one"] == r["all"]


def equal_components(edges: DataFrame) -> DataFrame:
    """doc_id, component of documents that are equal by edges (src, dst), directly or not; the component is the smallest document.

    An equality closure of n documents has n squared edges; this has n rows, and copy_equal works on it.
    """
    pairs = written(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), "equal")
    found = components(pairs).select(F.col("node").alias("doc_id"), F.col("comp").alias("component"))
    alone = pairs.where("a = b").select(F.col("a").alias("doc_id")).distinct().join(found, "doc_id", "left_anti")
    return found.unionByName(alone.select("doc_id", F.col("doc_id").alias("component")))


def copy_equal(facts: DataFrame, components: DataFrame) -> DataFrame:
    """Positive labels go to all documents of a component: distinct (component, label) first, so no pair of documents is made."""
    own = facts.where("sign > 0").join(components, "doc_id").select("component", "label", "sign").distinct()
    moved = own.join(components, "component").select("doc_id", "label", "sign")
    return facts.select("doc_id", "label", "sign").unionByName(moved).distinct()
