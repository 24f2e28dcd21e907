"""MinHash near-deduplication by a signature-coordinate inverted join.

Each distinct shingle set is posted under its (coordinate, value) pairs. Pairs of sets that agree in at
least `matches` of `coords` coordinates must share one of the coords - matches + 1 rarest values of either,
so only those, and of them only values that some other set has, are posted: values of a passage that many
documents share are common and stay out. Sets that meet in a posting form candidate groups; inside a group
collisions are counted per pair, pairs below `matches` are skipped, and the others are confirmed on the full
sets unless both are already known to be in one component. Large groups are cut into bands of set size and
parts, and compared part against part, so no group meets in one task and no list of all pairs is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, done, hashes, mix, slices, text_of, trimmed, words, written
from marlstone.llm.graph import components

_MASKS = np.random.default_rng(20).integers(1, 2**63, size=(256, 2), dtype=np.uint64) | np.uint64(1)


def shingles(texts: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; one of the whole sequence if it has fewer words, none if no word."""
    ids, dictionary, counts = words(texts)
    h = hashes(dictionary)[ids]
    with np.errstate(over="ignore"):
        total = h * np.uint64(width)
        run = np.zeros(max(0, len(h) - width + 1), np.uint64)
        for k in range(width if len(run) else 0):
            run = mix(run + h[k:len(h) - width + 1 + k] * _MASKS[k, 0])
        out, at = [], 0
        for n in counts:
            if n >= width:
                out.append(np.unique(run[at:at + n - width + 1]))
            elif n:
                one = np.zeros(1, np.uint64)
                for x in h[at:at + n]:
                    one = mix(one + x * _MASKS[100, 0])
                out.append(mix(one + np.uint64(n)))
            else:
                out.append(total[:0])
            at += n
    return out


def signature(sets: list[np.ndarray], coords: int) -> np.ndarray:
    """(sets, coords) minima of the hashed sets; empty sets are not allowed."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])[:-1]
    out = np.empty((len(sets), coords), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(coords):
            out[:, k] = np.minimum.reduceat((flat ^ _MASKS[k, 0]) * _MASKS[k, 1], starts)
    return out


def _sign(width: int, coords: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=2 << 20):
            sets = shingles(b.column("text"), width)
            full = [s for s in sets if len(s)]
            sig = iter(signature(full, coords).view(np.int64) if full else ())
            sigs = [next(sig) if len(s) else None for s in sets]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("th"), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.list_(pa.int64()))],
                ["doc_id", "th", "n_shingles", "set_key", "sig"])

    return run


def linked(texts: pa.Array, ids: np.ndarray, side: np.ndarray, width: int, coords: int, matches: int, percent: int) -> Iterator[tuple[int, int]]:
    """A spanning forest of the links among the texts; only pairs of different sides if there are two."""
    sets = shingles(texts, width)
    sig = signature(sets, coords)
    n = np.array([len(s) for s in sets])
    two = side.min() != side.max()
    root = list(range(len(sets)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(sets) - 1):
        rest = slice(i + 1, None)
        near = (100 * np.minimum(n[i], n[rest]) >= percent * np.maximum(n[i], n[rest])) & ((sig[rest] == sig[i]).sum(axis=1) >= matches)
        if two:
            near &= side[rest] != side[i]
        for j in np.flatnonzero(near) + i + 1:
            a, c = find(i), find(int(j))
            if a != c:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    root[max(a, c)] = min(a, c)
                    yield int(ids[i]), int(ids[j])


def _verify(width: int, coords: int, matches: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle() -> pa.RecordBatch | None:
            t = pa.Table.from_batches(held).combine_chunks()
            found = [*linked(t.column("text").combine_chunks(), t.column("rep").to_numpy(), t.column("side").to_numpy(), width, coords, matches, percent)] if t.num_rows > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], ["a", "b"])

        task = None
        for b in batches:  # sorted by task
            names = b.column("task").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            for at, to in zip(cuts, cuts[1:], strict=False):
                if at == to:
                    continue
                if held and names[at] != task:
                    yield settle()
                    held = []
                task = names[at]
                held.append(b.slice(at, to - at))
        if held:
            yield settle()

    return run


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, coords: int = 48, matches: int = 24, block: int = 256, few: int = 32 << 20) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard index of their word-shingle sets is at least percent / 100; a
    component's smallest id stays. A null or empty text, or one of blanks, has no shingle and no link. Rows
    that share an id are one vertex; a null id is a component of its own and stays. An empty table gives an
    empty result; other columns are ignored. With coords 48 and matches 24 a linked pair is a candidate but
    for a chance below 1e-6. A candidate list of up to `sure` rows of 32 bytes is broadcast, a longer one is
    joined by shuffle.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    signed = written(base.mapInArrow(trimmed(_sign(width, coords)), "doc_id long, th long, n_shingles long, set_key binary, sig array<bigint>"), "signed")
    sets = signed.where("set_key is not null and doc_id is not null")
    # One row for each distinct set; copies need no comparison. The representative is the smallest id.
    classes = written(sets.groupBy("set_key").agg(F.min(F.struct("doc_id", "th", "n_shingles")).alias("r"), F.count(F.lit(1)).alias("n")).select("set_key", F.col("r.doc_id").alias("rep"), "r.th", "r.n_shingles", "n"), "classes")
    own = sets.join(classes.select("set_key", "rep", F.col("th").alias("rep_th")), "set_key").where("doc_id = rep and th = rep_th").dropDuplicates(["rep", "th", "set_key"])
    tokens = written(own.select("rep", "th", "n_shingles", F.explode("sig").alias("tok")), "tokens")
    common = tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    mine = tokens.join(common, "tok").groupBy("rep", "th", "n_shingles").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("toks")).where(F.size("toks") >= matches)
    posted = written(mine.select("rep", "th", "n_shingles", F.explode(F.slice("toks", F.lit(1), F.size("toks") - (matches - 1))).alias("t")).select("rep", "th", "n_shingles", F.col("t.tok").alias("tok")), "posted")
    done(tokens)
    leaders = posted.groupBy("tok").agg(F.min("rep").alias("lead"))
    groups = components(posted.join(leaders, "tok").select(F.col("rep").alias("a"), F.col("lead").alias("b")).where("a <> b").distinct())
    # Bands of set size: linked sets differ in size by a factor of 100 / percent at most, so by one band at most.
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100.0 / percent * 1.0001))).cast("int")
    members = posted.select("rep", "th", "n_shingles").distinct().join(groups.select(F.col("v").alias("rep"), F.col("component").alias("g")), "rep").withColumn("band", band)
    per_band = members.groupBy("g", "band").agg(F.count(F.lit(1)).alias("n"))
    per_group = per_band.groupBy("g").agg(F.sum("n").alias("all"))
    parts = per_band.withColumn("parts", F.ceil(F.col("n") / block).cast("int")).select("g", "band", "parts")
    nxt, prv = parts.select("g", (F.col("band") - 1).alias("band"), F.col("parts").alias("up")), parts.select("g", (F.col("band") + 1).alias("band"), F.col("parts").alias("down"))
    plan = written(parts.join(nxt, ["g", "band"], "left").join(prv, ["g", "band"], "left").join(per_group, "g"), "plan")
    part = F.pmod(F.xxhash64("rep", "th"), F.col("parts").cast("long")).cast("int")
    chosen = written(members.join(plan, ["g", "band"]).select("rep", "th", "g", "band", part.alias("part"), "parts", "up", "down", "all"), "chosen")
    done(posted, groups, plan)
    # Rows of fixed size: at most `few` bytes of them are broadcast, more are joined by shuffle.
    small = chosen.count() * 64 <= few
    with_text = base if small else base.dropDuplicates(["doc_id", "th"])
    texts = with_text.join(F.broadcast(chosen) if small else chosen, (with_text["doc_id"] == chosen["rep"]) & (with_text["th"] == chosen["th"])).drop(with_text["th"], with_text["doc_id"])
    # A set of a large group meets its own band's parts and those of the bands beside it.
    name = lambda b1, p1, b2, p2: F.concat_ws("/", F.col("g"), b1, p1, b2, p2)
    p, b = F.col("part"), F.col("band")
    span = lambda n: F.when(n.isNotNull(), F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    same = F.transform(span(F.col("parts")), lambda q: F.struct(name(b, F.least(p, q), b, F.greatest(p, q)).alias("task"), F.when(q < p, 1).otherwise(0).alias("side")))
    above = F.transform(span(F.col("up")), lambda q: F.struct(name(b, p, b + 1, q).alias("task"), F.lit(0).alias("side")))
    below = F.transform(span(F.col("down")), lambda q: F.struct(name(b - 1, q, b, p).alias("task"), F.lit(1).alias("side")))
    whole = F.array(F.struct(F.concat_ws("/", F.col("g")).alias("task"), F.lit(0).alias("side")))
    tasks = F.when(F.col("all") <= block, whole).otherwise(F.concat(same, above, below))
    texts = texts.select("rep", "text", F.explode(tasks).alias("x")).select("rep", "text", "x.task", "x.side")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links = written(texts.repartition(n, "task").sortWithinPartitions("task").mapInArrow(trimmed(_verify(width, coords, matches, percent)), "a long, b long"), "links")
    # An id that has several sets links their classes.
    several = sets.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).where("lo <> hi").select("doc_id")
    of_id = sets.join(several, "doc_id", "left_semi").join(classes, "set_key").select("doc_id", "rep")
    same_id = of_id.join(of_id.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").select("a", F.col("rep").alias("b"))
    parts_of = components(links.unionByName(same_id))
    joined = written(classes.join(parts_of, classes["rep"] == parts_of["v"], "left").select("set_key", F.coalesce("component", "rep").alias("component_id")), "components")
    done(classes, chosen, links, parts_of)
    out = signed.select("doc_id", "n_shingles", "set_key").join(joined, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, all columns, that stay: one of each component. Of rows that repeat an id one stays, by a hash of all columns; rows with a null id all stay."""
    id_ = "near_dedup_id_"
    kept = near_dedup(docs, id_col, text_col, **how).where("kept and doc_id is not null").select(F.col("doc_id").alias(id_)).distinct()
    named = docs.withColumn("near_dedup_row_", F.xxhash64(*docs.columns)).withColumn(id_, F.col(id_col).cast("long")).join(kept, id_, "left_semi")
    first = F.row_number().over(Window.partitionBy(id_).orderBy("near_dedup_row_"))
    return named.withColumn("near_dedup_first_", first).where("near_dedup_first_ = 1").select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))
