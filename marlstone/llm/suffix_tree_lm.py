"""Language-model scores by a probabilistic suffix tree over words.

Every word is a symbol. Contexts of up to three words that the training texts have at least `least_context` times
are candidates; one is kept as a state if its next words diverge from those of its longest kept suffix. A state
has its own probabilities, less a discount, for next words seen at least `least_next` times after it and leaves the
others to its suffix. A token is scored in the longest state that its predecessors in the text end with. Both
limits are fixed counts, so the tree grows with the corpus.

The tree is never held as a whole: runs of one to four words are rows of written tables, named by 64-bit hashes that
NumPy and Spark's xxhash64 compute alike. Texts are cut into words once and written as slices of word hashes.
What many tasks ask of one table (how often is this run, what does it add to a score) travels as packed hashes, dealt
out by hash: a run that is very frequent is one entry of each task that has it, so no key is hot. A text's score is a
sum over its runs (see `Tree.adds`), added up where the table is, one length of runs at a time. Bitmaps of hashes
leave out runs that cannot be in a table, which saves traffic on small corpora and changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, done, free_shuffles, hashes, slices, text_of, trimmed, words, written

END = np.uint64(0x5EED)
DEPTH, BITS, PAGE = 3, 26, 14
#: A task's runs are packed in so many passes.
PASSES = 8
#: Of xxHash64, as Spark computes it for longs.
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
SLICES = "slice long, ids binary, nulls binary, held binary, counts binary, words binary, at binary"


def _xx(value: np.ndarray, seed) -> np.ndarray:
    with np.errstate(over="ignore"):
        k = value * P2
        h = (seed + P5 + np.uint64(8)) ^ ((k << np.uint64(31) | k >> np.uint64(33)) * P1)
        h = (h << np.uint64(27) | h >> np.uint64(37)) * P1 + P4
        h ^= h >> np.uint64(33)
        h *= P2
        h ^= h >> np.uint64(29)
        h *= P3
        return h ^ h >> np.uint64(32)


def follow(run: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of runs with one more word at their end; F.xxhash64(run, word) is the same."""
    return _xx(word.view(np.uint64), _xx(run.view(np.uint64), np.uint64(42))).view(np.int64)


def _slice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, held_out, text) -> slices of a few MB of text each: the documents, their counts of tokens, the distinct words' hashes and each token's place among them."""
    task = TaskContext.get().partitionId()
    for k, b in enumerate(slices(batches)):
        at, dictionary, counts = words(b.column("text"))
        token = np.full(len(at) + len(counts), len(dictionary), np.int32)  # the end of a text, unless a word is put there
        inner = np.ones(len(token), bool)
        inner[np.cumsum(counts + 1) - 1] = False
        token[inner] = at
        ids = b.column("doc_id")
        cols = (ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), b.column("held_out").to_numpy(zero_copy_only=False), counts + 1, np.append(hashes(dictionary), END), token)
        yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in cols)], ["slice", "ids", "nulls", "held", "counts", "words", "at"])


def sliced(docs: DataFrame) -> DataFrame:
    """The written slices of docs (doc_id long, held_out boolean, text)."""
    return written(docs.mapInArrow(trimmed(_slice), SLICES), "slices")


@dataclass
class Slice:
    number: int
    ids: np.ndarray
    nulls: np.ndarray
    held: np.ndarray
    counts: np.ndarray  # of tokens of each document
    words: np.ndarray  # distinct hashes
    at: np.ndarray  # of each token in words

    @property
    def tokens(self) -> np.ndarray:
        return self.words[self.at]

    def training(self) -> tuple[np.ndarray, np.ndarray]:
        """Tokens, and their number in each document, of the training documents."""
        return self.tokens[np.repeat(~self.held, self.counts)], self.counts[~self.held]


def _slices_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Slice]]:
    kinds = (("ids", np.int64), ("nulls", bool), ("held", bool), ("counts", np.int64), ("words", np.int64), ("at", np.int32))
    for b in batches:
        for i in range(b.num_rows):
            yield b, i, Slice(b.column("slice")[i].as_py(), *(np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in kinds))


def _sums(keys: np.ndarray, counts: np.ndarray, *first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, their counts added up, and what else goes with a key."""
    order = np.argsort(keys)
    keys = keys[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], np.add.reduceat(counts[order], at) if len(at) else counts[:0], *(x[order[at]] for x in first)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, _, s in _slices_of(batches):
        n = np.bincount(s.at[np.repeat(~s.held, s.counts)], minlength=len(s.words))
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(s.words[own]), pa.array(n[own].astype(np.int64))], ["key", "c"])


def runs(h: np.ndarray, counts: np.ndarray, longest: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By length, the places at which a run of that length within one text ends, and the runs' hashes at all places."""
    place = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts)
    out = [(np.arange(len(h)), h)]
    for size in range(2, longest + 1):
        key = h.copy()
        key[1:] = follow(out[-1][1][:-1], h[1:])
        out.append((np.flatnonzero(place >= size - 1), key))
    return out


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(20)).astype(np.int64) % buckets


def _dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that brings the keys of a bucket together, and (bucket, from, to) of those that have any."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    n = np.bincount(bucket, minlength=1)
    to = np.cumsum(n)
    return order, [(i, int(to[i] - n[i]), int(to[i])) for i in np.flatnonzero(n).tolist()]


def _dealt_rows(df: DataFrame, buckets: int, order: str = "bucket") -> DataFrame:
    """Rows of packed hashes by bucket, sorted; so that a task holds one bucket at a time."""
    return df.repartitionById(min(buckets, 20_000), F.col("bucket") % min(buckets, 20_000)).sortWithinPartitions(*order.split())

def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits set at the keys' lowest bits: a key whose bit is not set is not in the table."""
    slot = F.col("key").bitwiseAND(F.lit((1 << BITS) - 1))
    words_ = keys.select(F.shiftright(slot, 6).alias("i"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("b")).groupBy("i").agg(F.bit_or("b").alias("b"))
    pages = words_.repartition(F.shiftright("i", PAGE)).mapInArrow(_pages, "page long, bits binary")
    out = np.zeros(1 << (BITS - 6), np.uint64)
    for r in pages.toLocalIterator():
        at = r["page"] << PAGE
        out[at:at + (1 << PAGE)] = np.frombuffer(r["bits"], np.uint64)
    return out


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bitmap's words as pages, so that the driver gets bytes and not rows."""
    pages: dict[int, np.ndarray] = {}
    for b in batches:
        i, bits = (b.column(c).to_numpy() for c in ("i", "b"))
        for page in np.unique(i >> PAGE).tolist():
            mine = i >> PAGE == page
            pages.setdefault(page, np.zeros(1 << PAGE, np.int64))[i[mine] & ((1 << PAGE) - 1)] = bits[mine]
    if pages:
        yield pa.RecordBatch.from_arrays([pa.array(list(pages), pa.int64()), pa.array([v.tobytes() for v in pages.values()], pa.binary())], ["page", "bits"])


def maybe(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    slot = keys & ((1 << BITS) - 1)
    return bits[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1) == 1


@dataclass
class Tree:
    """Written tables: words (key, c), and by length of the context its next words and its states.

    steps: key and up (the hashes of context and word, and of the same without the context's first word), x (the
    context), c, lp (log10 of the word's probability after the context), add. states: x, beta, c.
    """

    words: DataFrame
    rate: float  # log10 of 1 / (N + V + 1)
    steps: list[DataFrame]
    states: list[DataFrame]
    buckets: int = 1

    def adds(self) -> DataFrame:
        """(key, known, base, add): what a run in a text adds to its scores beyond `rate` a word.

        A word adds what it has at the root. A context that is a state adds its beta, as if the next word were
        none of its own. A word after it that is one of its own takes beta back and adds its log10
        probability less that in the suffix, which the shorter run has added.
        """
        lp = F.log10((F.col("c") + 1).cast("double"))
        zero, none = F.lit(0.0), F.lit(0)
        out = self.words.select("key", F.lit(1).alias("known"), lp.alias("base"), lp.alias("add"))
        parts = [t.where("add != 0").select("key", none, zero, "add") for t in self.steps]
        parts += [t.select(F.col("x").alias("key"), none, zero, F.col("beta").alias("add")) for t in self.states]
        for part in parts:
            out = out.union(part)
        return out.groupBy("key").agg(F.max("known").alias("known"), F.sum("base").alias("base"), F.sum("add").alias("add"))

    # What follows collects the tree, which only a small one allows.
    @cached_property
    def _small(self) -> tuple[np.ndarray, dict[int, float], dict[int, int], dict[int, float], list[int]]:
        w = self.words.orderBy("key").toPandas()
        lp, up, beta = {}, {}, {}
        for steps, states in zip(self.steps, self.states, strict=True):
            beta |= {r["x"]: r["beta"] for r in states.collect()}
            for r in steps.collect():
                up[r["key"]] = r["up"]
                if r["x"] in beta:
                    lp[r["key"]] = r["lp"]
        return w, lp, up, beta, sorted(beta)

    @cached_property
    def root(self) -> np.ndarray:
        """log10 probability of all unknown words together, then of each known word."""
        return np.log10(np.concatenate([[1.0], self._small[0]["c"].to_numpy() + 1.0])) + self.rate

    @cached_property
    def parent(self) -> np.ndarray:
        """The state of the longest kept suffix of each state, -1 for the root."""
        _, _, up, beta, order = self._small
        number = {x: i for i, x in enumerate(order)}
        out = []
        for x in order:
            x = up.get(x)
            while x is not None and x not in beta:
                x = up.get(x)
            out.append(-1 if x is None else number[x])
        return np.array(out, np.int64)

    def log10(self, state: np.ndarray, sym: np.ndarray) -> np.ndarray:
        w, lp, _, beta, order = self._small
        keys, out = w["key"].to_numpy(np.int64), np.zeros(len(sym))
        for i, (s, y) in enumerate(zip(state.tolist(), sym.tolist(), strict=True)):
            while s >= 0:
                key = int(follow(np.array([order[s]]), keys[y - 1:y])[0]) if y else None
                if key in lp:
                    out[i] += lp[key]
                    break
                out[i] += beta[order[s]]
                s = self.parent[s]
            else:
                out[i] += self.root[y]
        return out


def _count_runs(shared, size: int, buckets: int, most: int = 3_000_000):
    """Packed (context, next word, count) of the training texts' runs of `size` words, by bucket of the run."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            # A few buckets at a time, so that what is sorted and copied stays small beside what is held.
            group = [(bucket_of(v[0], buckets) % PASSES).astype(np.uint8) for v in held]
            for g in range(min(PASSES, buckets)):
                own = [np.flatnonzero(x == g) for x in group]
                key, c, x, w = _sums(*(np.concatenate([v[k][i] for v, i in zip(held, own, strict=True)]) for k in (0, 3, 1, 2)))
                c = c.astype(np.int32)
                order, parts = _dealt(key, buckets)
                for bucket, at, to in parts:
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([v[order[at:to]].tobytes()], pa.binary()) for v in (x, w, c))], ["bucket", "x", "w", "c"])

        for _, _, s in _slices_of(batches):
            h, counts = s.training()
            got = runs(h, counts, size)
            at, key = got[-1]
            x = got[-2][1]
            if shared is not None:
                at = at[maybe(shared.value, x[at - 1])]
            own, first, c = np.unique(key[at], return_index=True, return_counts=True)
            at = at[first]
            held.append((own, x[at - 1], h[at], c.astype(np.int32)))
            if sum(len(v[0]) for v in held) > most:
                yield from packed()
                held = []
        if held:
            yield from packed()

    return run


def _often(least: int):
    """The runs of each bucket that are as frequent as `least` in all: key, x, w, c."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_bucket(batches, ("x", np.int64), ("w", np.int64), ("c", np.int32)):
            x, w, c = (np.concatenate(v) for v in rows)
            key, c, x, w = _sums(follow(x, w), c.astype(np.int64), x, w)
            own = c >= least
            yield pa.RecordBatch.from_arrays([pa.array(v[own]) for v in (key, x, w, c)], ["key", "x", "w", "c"])

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], *kinds: tuple[str, type]) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """The packed columns of each bucket; batches are sorted by bucket."""
    now, held = None, [[] for _ in kinds]
    for b in batches:
        for i, bucket in enumerate(b.column("bucket").to_pylist()):
            if bucket != now:
                if now is not None:
                    yield now, held
                now, held = bucket, [[] for _ in kinds]
            for out, (c, t) in zip(held, kinds, strict=True):
                out.append(np.frombuffer(b.column(c)[i].as_buffer(), t))
    if now is not None:
        yield now, held


def train(cut: DataFrame, least_context: int = 4, least_next: int = 2, gain: float = 0.01, discount: float = 0.75, per_bucket: int = 3_000_000) -> tuple[Tree, DataFrame, int]:
    """Learn from the training documents of slices. Returns the tree, the table of counts (key, c) of all words and the number of tokens."""
    spark = cut.sparkSession
    counts = written(cut.mapInArrow(trimmed(_count_words), "key long, c long").groupBy("key").agg(F.sum("c").alias("c")), "words")
    free_shuffles(spark)
    r = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = r["n"], r["v"]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // per_bucket))
    # One more for each known word, and one for all unknown words together.
    tree = Tree(counts, float(-np.log10(float(n) + v + 1)), [], [], buckets)
    before = counts.select("key", "c", F.lit(0).cast("long").alias("up"), (F.log10((F.col("c") + 1).cast("double")) + tree.rate).alias("lp"))
    for depth in range(1, DEPTH + 1):
        contexts = before.where((F.col("c") >= least_context) & (F.col("key") != int(END.view(np.int64)))).select(F.col("key").alias("x"), F.col("c").alias("total"), F.col("up").alias("x_up"))
        if contexts.isEmpty():
            break
        # Nearly every word is a context; of longer runs few are.
        shared = spark.sparkContext.broadcast(bitmap(contexts.select(F.col("x").alias("key")))) if depth > 1 else None
        packed = cut.mapInArrow(trimmed(_count_runs(shared, depth + 1, buckets)), "bucket int, x binary, w binary, c binary")
        found = written(_dealt_rows(packed, buckets).mapInArrow(trimmed(_often(least_next)), "key long, x long, w long, c long"), "runs")
        if shared is not None:
            shared.destroy()
        del packed
        free_shuffles(spark, 2.0)
        # A run's context and its suffix are at least as frequent as it is, so both are in the table before.
        up = F.col("w") if depth == 1 else F.xxhash64("x_up", "w")
        rows = found.join(contexts, "x").withColumn("up", up).join(before.select(F.col("key").alias("up"), F.col("lp").alias("q")), "up")
        rows = written(rows.select("key", "up", "x", "c", "total", "q", F.log10((F.col("c") - discount) / F.col("total")).alias("p")), "rows")
        done(found)
        p, q = F.pow(F.lit(10.0), "p"), F.pow(F.lit(10.0), "q")
        rest_p, rest_q = F.greatest(F.col("rest_p"), F.lit(1e-12)), F.greatest(F.col("rest_q"), F.lit(1e-12))
        states = rows.groupBy("x").agg(F.max("total").alias("c"), F.count(F.lit(1)).alias("m"), (1 - F.sum(p)).alias("rest_p"), (1 - F.sum(q)).alias("rest_q"), F.sum(p * (F.col("p") - F.col("q")) * float(np.log(10))).alias("kl"))
        kl = F.col("kl") + F.col("rest_p") * F.log(rest_p / rest_q)
        states = written(states.where(kl - F.col("m") / (2 * F.col("c")) > gain).select("x", F.log10(rest_p / rest_q).alias("beta"), "c"), "states")
        own = F.col("beta").isNotNull()
        steps = rows.join(states.select("x", "beta"), "x", "left").select("key", "up", "x", "c", F.when(own, F.col("p")).otherwise(F.col("q")).alias("lp"), F.when(own, F.col("p") - F.col("q") - F.col("beta")).otherwise(0.0).alias("add"))
        before = written(steps, "steps")
        done(rows)
        tree.steps.append(before)
        tree.states.append(states)
    return tree, counts, n


def _small(x: np.ndarray, most: int) -> bytes:
    """x as 16-bit numbers if they fit, else as 32-bit ones; which of the two, tells the length."""
    return x.astype(np.uint16 if most < 1 << 16 else np.uint32).tobytes()


def _wide(b: bytes, n: int) -> np.ndarray:
    return np.frombuffer(b, np.uint16 if len(b) == 2 * n else np.uint32)


ASK = ["bucket", "kind", "slice", "n", "keys", "each", "docs", "counts", "known", "base", "add"]
ASK_DDL = "bucket int, kind int, slice long, n int, keys binary, each binary, docs binary, counts binary, known binary, base binary, add binary"


def _ask(shared, size: int, buckets: int):
    """Each slice's runs of `size` words that may be in the table, by bucket: the hashes, and in which documents of the slice each is and how often."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, s in _slices_of(batches):
            at, key = runs(s.tokens, s.counts, size)[-1]
            if size > 1:
                at = at[maybe(shared.value, key[at])]
            doc = np.repeat(np.arange(len(s.counts)), s.counts)[at]
            key = key[at]
            order = np.argsort(key, kind="stable")  # documents stay in order within a key
            order = order[np.argsort(bucket_of(key[order], buckets), kind="stable")]
            key, doc = key[order], doc[order]
            if not len(key):
                continue
            new = np.concatenate([[True], key[1:] != key[:-1]])
            pair = np.flatnonzero(new | np.concatenate([[True], doc[1:] != doc[:-1]]))
            count = np.diff(np.append(pair, len(key)))
            first = np.flatnonzero(new[pair])  # of each key among the pairs
            each = np.diff(np.append(first, len(pair)))
            key, doc = key[pair[first]], doc[pair]
            bucket = bucket_of(key, buckets)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            ends = np.append(cut[1:], len(key))
            begin = np.append(first, len(pair))
            rows = [(int(bucket[c]), 1, s.number, len(s.counts), key[c:e].tobytes(), *(_small(x, int(x.max())) for x in (each[c:e], doc[begin[c]:begin[e]], count[begin[c]:begin[e]])), None, None, None) for c, e in zip(cut.tolist(), ends.tolist(), strict=True)]
            for k in range(0, len(rows), 64):
                yield _rows(rows[k:k + 64])

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ASK)


def _table(buckets: int, most: int = 500_000):
    """Rows (key, known, base, add) packed by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def packed() -> Iterator[pa.RecordBatch]:
            cols = [np.concatenate(v) for v in zip(*held, strict=True)]
            order, parts = _dealt(cols[0], buckets)
            cols = [c[order] for c in cols]
            for bucket, a, b in parts:
                key, known, base, add = (c[a:b].tobytes() for c in cols)
                yield _rows([(bucket, 0, 0, 0, key, None, None, None, known, base, add)])

        for b in batches:
            held.append((b.column("key").to_numpy(), b.column("known").to_numpy().astype(np.uint8), b.column("base").to_numpy(), b.column("add").to_numpy()))
            if sum(len(v[0]) for v in held) > most:
                yield from packed()
                held = []
        if held:
            yield from packed()

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each slice's question what the bucket's table adds to each of its documents: known words, base and add. Sorted by bucket and kind: the table comes first."""
    now, parts, table = None, [], None
    kinds = (("keys", np.int64), ("known", np.uint8), ("base", np.float64), ("add", np.float64))
    for b in batches:
        for i, (bucket, kind, size) in enumerate(zip(b.column("bucket").to_pylist(), b.column("kind").to_pylist(), b.column("n").to_pylist(), strict=True)):
            if bucket != now:
                now, parts, table = bucket, [], None
            if kind == 0:
                parts.append([np.frombuffer(b.column(c)[i].as_buffer(), t) for c, t in kinds])
                continue
            if table is None:
                table = [np.concatenate(v) for v in zip(*parts, strict=True)] if parts else [np.zeros(0, t) for _, t in kinds]
                order = np.argsort(table[0])
                table, parts = [v[order] for v in table], []
            if not len(table[0]):
                continue
            keys = np.frombuffer(b.column("keys")[i].as_buffer(), np.int64)
            at = np.searchsorted(table[0], keys)
            at[at == len(table[0])] = 0
            each = _wide(b.column("each")[i].as_py(), len(keys)).astype(np.int64)
            own = np.repeat(table[0][at] == keys, each)
            if not own.any():
                continue
            at = np.repeat(at, each)[own]
            pairs = int(each.sum())
            doc, count = (_wide(b.column(c)[i].as_py(), pairs)[own] for c in ("docs", "counts"))
            sums = [np.bincount(doc, v[at] * count, size).tobytes() for v in (table[1], table[2], table[3])]
            yield pa.RecordBatch.from_arrays([b.column("slice").slice(i, 1), *(pa.array([x], pa.binary()) for x in sums)], ["slice", "known", "base", "add"])


SUMS_DDL = "slice long, known binary, base binary, add binary"


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a slice from rows sorted by slice: the sums of its documents."""
    now, sums = None, None
    cols = ("known", "base", "add")
    row = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in sums)], ["slice", *cols])
    for b in batches:
        for i, number in enumerate(b.column("slice").to_pylist()):
            own = [np.frombuffer(b.column(c)[i].as_buffer(), np.float64) for c in cols]
            if number != now:
                if now is not None:
                    yield row()
                now, sums = number, own
            else:
                sums = [x + y for x, y in zip(sums, own, strict=True)]
    if now is not None:
        yield row()


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each slice with their sums."""
    for b in batches:
        for i in range(b.num_rows):
            of = lambda c, t: np.frombuffer(b.column(c)[i].as_buffer(), t)  # noqa: E731, B023
            ids, counts = of("ids", np.int64), of("counts", np.int64)
            known, base, add = (of(c, np.float64) if b.column(c)[i].is_valid else np.zeros(len(ids)) for c in ("known", "base", "add"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=of("nulls", bool)), pa.array(of("held", bool)), pa.array(counts), pa.array(np.rint(known).astype(np.int64)), pa.array(base), pa.array(add)],
                ["doc_id", "held_out", "n_tokens", "n_known", "base", "add"])


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 2, folds: int = 7, **how) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, gain.

    Learns from rows whose crc32(id as text) mod folds is not `fold`; a null id is held out. A null or empty
    text has one token, its end. With no row to learn from all words are unknown, N and V are 0 and both
    scores are 0. gain is what the tree adds to a token's log10 probability on average: texts that the corpus
    repeats have a high one. Rows that repeat an id and a text have the same result. An empty table gives an
    empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)  # a slice is a row of some MB
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(crc % folds == fold, F.lit(True)).alias("held_out"), text_of(docs, text_col).alias("text"))
    cut = sliced(base)
    tree, counts, n = train(cut, **how)
    buckets = tree.buckets
    table = written(tree.adds(), "adds")
    done(counts, *tree.steps, *tree.states)
    shared = spark.sparkContext.broadcast(bitmap(table.where("known = 0")))
    sums = None
    for size in range(1, DEPTH + 2):
        questions = cut.mapInArrow(trimmed(_ask(shared, size, buckets)), ASK_DDL).unionByName(table.where("known = 1" if size == 1 else "known = 0").mapInArrow(trimmed(_table(buckets)), ASK_DDL))
        answers = _dealt_rows(questions, buckets, "bucket kind").mapInArrow(trimmed(_answer), SUMS_DDL)
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        one = written(answers.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(_add_up, SUMS_DDL), "sums")
        sums = one if sums is None else sums.unionByName(one)
        del questions, answers
        free_shuffles(spark, 2.0)  # one length's questions are the most that lies on disk
    shared.destroy()
    done(table)
    total = sums.repartition(parts, "slice").sortWithinPartitions("slice").mapInArrow(_add_up, SUMS_DDL)
    out = cut.select("slice", "ids", "nulls", "held", "counts").join(total, "slice", "left").mapInArrow(_score, "doc_id long, held_out boolean, n_tokens long, n_known long, base double, add double")
    rate = F.col("n_tokens") * tree.rate
    return out.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (rate + F.col("base")).alias("base_score"),
        (rate + F.col("add")).alias("score"), ((F.col("add") - F.col("base")) / F.col("n_tokens")).alias("gain"))
