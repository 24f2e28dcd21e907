"""Removing repeated byte strings with suffix arrays built by two-stage sorting.

A string of `span` bytes that starts in two places holds, at the same offset in both, the `gram` bytes with
the smallest hash of the string (winnowing), so places are first brought together by those anchors:
1. anchors of every text are counted; those that occur once cannot lie in a repeated string;
2. around each other anchor the text is cut out: every string of `span` bytes that has it as its own anchor;
3. cut-outs of one anchor that are equal as a whole are repeated throughout; one of each kind goes on;
4. kinds of one anchor are joined into one text; its suffix array (only suffixes smaller than their
   successors are sorted, the others are induced by scans of the buckets) and the common prefixes of
   neighbours tell which strings of `span` bytes occur twice. Anchors with very many kinds are dealt
   by the strings themselves instead, one row a string, counted with partial sums;
5. repeated starts become removed ranges of each text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import done, free_shuffles, mix, slices, text_of, written

_BASE = np.uint64(0x9E3779B97F4A7C15)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array of an array of small non-negative integers by two-stage sorting.

    Suffixes smaller than their successors are sorted directly, by doubling of ranks from seven characters on; all
    others follow from them in one scan of the buckets, from the smallest suffix on. A bucket's scan takes what
    stands in it at once, then what that has put into the same bucket, then its directly sorted suffixes.
    """
    n = len(text)
    if n < 2:
        return np.arange(n)
    t = text.astype(np.int64)
    # smaller[i]: suffix i < suffix i + 1. Runs of equal characters take the answer of the run's end; the end of the text is smallest.
    change = np.flatnonzero(np.concatenate([t[:-1] != t[1:], [True]]))
    rises = np.concatenate([t[change[:-1]] < t[change[:-1] + 1], [False]])
    smaller = np.repeat(rises, np.diff(np.concatenate([[-1], change])))
    direct = np.flatnonzero(smaller)
    width = 7 if t.max() < 511 else 1
    padded = np.concatenate([t + 1, np.zeros(width, np.int64)])
    rank = padded[:n].copy()
    for k in range(1, width):
        rank = rank << 9 | padded[k:n + k]
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64) + 1
    while len(direct):
        second = np.zeros(n, np.int64)
        second[:-width or None] = rank[width:] if width < n else 0
        key = rank * (rank.max() + 1) + second
        own = np.sort(key[direct])
        if width >= n or (own[1:] != own[:-1]).all():
            direct = direct[np.argsort(key[direct], kind="stable")]
            break
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64) + 1
        width *= 2
    # Buckets by first character: the induced suffixes stand before the direct ones.
    count, own = np.bincount(t), np.bincount(t[direct], minlength=int(t.max()) + 1)
    start = np.cumsum(count) - count
    head, middle = start.copy(), start + count - own
    sa = np.full(n, -1, np.int64)
    first = t[direct]
    sa[middle[first] + np.arange(len(direct)) - (np.cumsum(own) - own)[first]] = direct
    # The last suffix is smaller than all that begin with its character.
    sa[head[t[-1]]] = n - 1
    head[t[-1]] += 1
    small = t.astype(np.int16) if t.max() < 1 << 15 else t

    def induce(from_: np.ndarray) -> None:
        j = from_ - 1
        j = j[(j >= 0) & ~smaller[j]]
        if len(j):
            j = j[np.argsort(small[j], kind="stable")]
            c = t[j]
            begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
            many = np.diff(np.append(begin, len(c)))
            sa[np.repeat(head[c[begin]] - begin, many) + np.arange(len(c))] = j
            head[c[begin]] += many

    for c in np.flatnonzero(count).tolist():
        at = start[c]
        while at < head[c]:
            at, wave = head[c], sa[at:head[c]]
            induce(wave)
        induce(sa[middle[c]:start[c] + count[c]])
    return sa


def common_prefixes(text: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Length, up to `most`, of the common prefix of each suffix and the next in the array, by doubling of equal blocks."""
    n = len(sa)
    out = np.zeros(max(0, n - 1), np.int64)
    padded = np.concatenate([text.astype(np.int64), np.full(most + 1, -1)])
    left = np.arange(n - 1)
    a, b = sa[:-1], sa[1:]
    step = 16
    for at in range(0, most, step):
        w = min(step, most - at)
        same = np.ones((len(left), w), bool)
        for k in range(w):
            x, y = padded[a[left] + at + k], padded[b[left] + at + k]
            same[:, k] = (x == y) & (x >= 0)
        run = np.where(same.all(axis=1), w, np.argmin(same, axis=1))
        out[left] += run
        left = left[run == w]
        if not len(left):
            break
    return out


def _grams(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the `gram` bytes from each place on, by doubling."""
    h = mix(data.astype(np.uint64) + np.uint64(1))
    width = 1
    with np.errstate(over="ignore"):
        while width < gram:
            step = min(width, gram - width)
            h = mix(h[: len(h) - step] * _BASE + h[step:])
            width += step
    return h


def anchors(data: np.ndarray, gram: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and place of each anchor of the bytes, and the first and last start of the strings of `span` bytes that have it as theirs."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    if len(data) < span:
        return none
    h = _grams(data, gram)
    w = span - gram + 1
    # Place of the (leftmost) minimum of each w consecutive hashes: minima of power-of-two windows, two of which overlap.
    best, width = np.arange(len(h)), 1
    while width * 2 <= w:
        a, b = best[: len(best) - width], best[width:]
        best = np.where(h[b] < h[a], b, a)
        width *= 2
    n = len(h) - w + 1
    a, b = best[:n], best[w - width:w - width + n]
    best = np.where((h[b] < h[a]) | ((h[b] == h[a]) & (b < a)), b, a)
    cut = np.flatnonzero(np.concatenate([[True], best[1:] != best[:-1]]))
    return h[best[cut]], best[cut], cut, np.append(cut[1:], n) - 1


def _each(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    for i, x in enumerate(batch.column("text").cast(pa.binary())):
        yield i, np.frombuffer(x.as_buffer(), np.uint8)


def _count_anchors(gram: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hs, rows, places, sizes, kinds = [], [], [], [], []
            for i, data in _each(b):
                h, at, first, last = anchors(data, gram, span)
                raw = data.tobytes()
                hs.append(h.view(np.int64))
                rows.append(np.full(len(h), i))
                places.append(first)
                sizes.append(last + span - first)
                kinds += [int.from_bytes(hashlib.blake2b(raw[s:e + span] + (int(p - s)).to_bytes(2, "little"), digest_size=8).digest(), "little", signed=True) for s, e, p in zip(first.tolist(), last.tolist(), at.tolist(), strict=True)]
            row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            k = b.column("k").to_numpy()[row.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hs) if hs else [], pa.int64()), pa.array(kinds, pa.int64()), pa.array(k, pa.int64()), *(pa.array(np.concatenate(x) if x else [], pa.int32()) for x in (places, sizes))], ["h", "kind", "k", "place", "size"])

    return run


def _cut_out(gram: int, span: int):
    """For each wanted (place, kind number) of a text the bytes and the offset of the anchor in them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hs, kinds, cuts = [], [], []
            wanted = b.column("wanted").to_pylist()
            for i, data in _each(b):
                h, at, first, last = anchors(data, gram, span)
                by = {int(s): j for j, s in enumerate(first)}
                raw = data.tobytes()
                for x in wanted[i]:
                    j = by[x["place"]]
                    hs.append(int(h[j].view(np.int64)))
                    kinds.append(x["kind"])
                    cuts.append(raw[int(first[j]):int(last[j]) + span])
            yield pa.RecordBatch.from_arrays([pa.array(hs, pa.int64()), pa.array(kinds, pa.int64()), pa.array(cuts, pa.binary())], ["h", "kind", "cut"])

    return run


def repeated_starts(cuts: list[bytes], groups: np.ndarray, span: int) -> list[np.ndarray]:
    """For each byte string the starts in it of strings of `span` bytes that also occur in another of its group (or twice in it)."""
    # Each cut ends in a character of its own group that orders before all bytes, so no string runs over an end.
    parts, base = [], []
    at = 0
    for c in cuts:
        base.append(at)
        parts += [np.frombuffer(c, np.uint8).astype(np.int64) + 1, np.zeros(1, np.int64)]
        at += len(c) + 1
    text = np.concatenate(parts)
    sa = suffix_array(text)
    owner = np.repeat(np.arange(len(cuts)), [len(c) + 1 for c in cuts])
    fits = text[np.minimum(sa, len(text) - 1)] > 0
    left = np.repeat(np.array([b + len(c) for b, c in zip(base, cuts, strict=True)]), [len(c) + 1 for c in cuts])[sa] - sa
    sa = sa[fits & (left >= span)]
    same = common_prefixes(np.where(text > 0, text, -1), sa, span) >= span
    # Runs of equal strings; a string is repeated if its run has another of the same group.
    run = np.cumsum(np.concatenate([[True], ~same])) - 1 if len(sa) else np.zeros(0, np.int64)
    key = run * (int(groups.max()) + 1 if len(groups) else 1) + groups[owner[sa]]
    _, back, n = np.unique(key, return_inverse=True, return_counts=True)
    hit = sa[n[back] > 1] if len(sa) else sa
    out: list[np.ndarray] = []
    of = owner[hit]
    order = np.lexsort((hit, of))
    hit, of = hit[order], of[order]
    edges = np.searchsorted(of, np.arange(len(cuts) + 1))
    for i in range(len(cuts)):
        out.append(hit[edges[i]:edges[i + 1]] - base[i])
    return out


def _ranges(starts: np.ndarray, span: int) -> list[tuple[int, int]]:
    """Maximal ranges covered by strings of `span` bytes at the sorted starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > span)
    return [*zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + span).tolist(), strict=True)]


def _sort_groups(span: int, most: int):
    """Rows (h, kind, cut) sorted by h -> h, kind, ranges relative to the cut."""
    def settle(hs: list[int], kinds: list[int], cuts: list[bytes]) -> pa.RecordBatch:
        _, groups = np.unique(np.array(hs), return_inverse=True)
        found = [_ranges(s, span) for s in repeated_starts(cuts, groups, span)]
        keep = [i for i, f in enumerate(found) if f]
        return pa.RecordBatch.from_arrays([pa.array([hs[i] for i in keep], pa.int64()), pa.array([kinds[i] for i in keep], pa.int64()), pa.array([[{"s": s, "e": e} for s, e in found[i]] for i in keep], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], ["h", "kind", "ranges"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs: list[int] = []
        kinds: list[int] = []
        cuts: list[bytes] = []
        size = 0
        for b in batches:
            for h, kind, cut in zip(b.column("h").to_pylist(), b.column("kind").to_pylist(), b.column("cut").to_pylist(), strict=True):
                if size > most and h != hs[-1]:
                    yield settle(hs, kinds, cuts)
                    hs, kinds, cuts, size = [], [], [], 0
                hs.append(h)
                kinds.append(kind)
                cuts.append(cut)
                size += len(cut)
        if hs:
            yield settle(hs, kinds, cuts)

    return run


def _strings(span: int):
    """Every string of `span` bytes of a cut-out, by a 128-bit digest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for h, kind, cut in zip(b.column("h").to_pylist(), b.column("kind").to_pylist(), b.column("cut").to_pylist(), strict=True):
                n = len(cut) - span + 1
                yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.int64()), pa.array([kind] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([hashlib.blake2b(cut[i:i + span], digest_size=16).digest() for i in range(n)], pa.binary())], ["h", "kind", "s", "d"])

    return run


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        n_bytes, removed, spans, digests = [], [], [], []
        found = b.column("ranges").to_pylist()
        for i, data in _each(b):
            cover = np.zeros(len(data) + 1, np.int64)
            for r in found[i] or ():
                cover[r["s"]] += 1
                cover[r["e"]] -= 1
            gone = np.cumsum(cover)[:-1] > 0
            n_bytes.append(len(data))
            removed.append(int(gone.sum()))
            spans.append(int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()))
            digests.append(hashlib.sha256(data[~gone].tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, spans)), pa.array(digests, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = 200, gram: int = 64, batch: int = 500_000, hot: int = 400, share: int = 5000) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte covered by a string of `span` UTF-8 bytes that also starts elsewhere, in the same or another
    text, is removed, all occurrences alike. A null text is empty; texts shorter than `span` keep all; a row
    that repeats another repeats its whole text. An empty table gives an empty result; other columns are
    ignored. Kinds are told apart by 64-bit digests together with their anchor; anchors of more than `hot`
    kinds take the counted way, on 128-bit digests, which no group size slows down.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text")).withColumn("k", F.xxhash64("doc_id", "text"))
    found = base.select("k", "text").mapInArrow(_count_anchors(gram, span), "h long, kind long, k long, place int, size int")
    # Counts by kind, then by anchor, with partial sums; single anchors end here.
    found = written(found, "anchors")
    free_shuffles(spark)
    each = written(found.groupBy("h", "kind").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k", "place")).alias("one")), "each")
    free_shuffles(spark)
    per = each.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("all")).where("all > 1").select("h", "kinds")
    kinds = written(each.join(per, "h").select("h", "kind", "n", "one", "kinds"), "kinds")
    done(each)
    # One text of each kind of those anchors that have several gives the bytes.
    wanted = kinds.where("kinds > 1").groupBy(F.col("one.k").alias("k")).agg(F.collect_list(F.struct(F.col("one.place").alias("place"), "kind")).alias("wanted"))
    texts = base.select("k", "text").join(wanted, "k").select("k", "text", "wanted")
    cuts = written(texts.mapInArrow(_cut_out(gram, span), "h long, kind long, cut binary").join(kinds.select("h", "kind", "kinds"), ["h", "kind"]).dropDuplicates(["h", "kind"]), "cuts")
    free_shuffles(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ddl = "h long, kind long, ranges array<struct<s:int,e:int>>"
    usual = cuts.where(F.col("kinds") <= hot).select("h", "kind", "cut").repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_sort_groups(span, batch), ddl)
    strings = cuts.where(F.col("kinds") > hot).select("h", "kind", "cut").mapInArrow(_strings(span), "h long, kind long, s int, d binary")
    twice = strings.groupBy("h", "d").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    many = strings.join(twice.select("h", "d"), ["h", "d"]).groupBy("h", "kind").agg(F.collect_list(F.struct("s", (F.col("s") + span).alias("e"))).alias("ranges"))
    ranges = written(usual.unionByName(many), "ranges")
    done(cuts)
    # Back to the places: kinds that occur twice are covered as a whole, the others where their strings repeat.
    marked = written(kinds.join(ranges, ["h", "kind"], "left").where("n > 1 or ranges is not null").select("h", "kind", "n", "ranges"), "marked")
    done(kinds, ranges)
    # Kinds of more than a `share`-th of all places are few (fewer than `share`), so they are broadcast; the others are joined by shuffle.
    least = max(1000, found.count() // share)
    hot_kinds = marked.where(F.col("n") > least)
    rest = found
    if not hot_kinds.isEmpty():
        rest = found.join(F.broadcast(hot_kinds.select("h", "kind")), ["h", "kind"], "left_anti")
    last = rest.join(marked.where(F.col("n") <= least), ["h", "kind"]).unionByName(found.join(F.broadcast(hot_kinds), ["h", "kind"]))
    whole = F.array(F.struct(F.col("place").alias("s"), (F.col("place") + F.col("size")).alias("e")))
    shifted = F.transform("ranges", lambda r: F.struct((r["s"] + F.col("place")).cast("int").alias("s"), (r["e"] + F.col("place")).cast("int").alias("e")))
    by_text = written(last.select("k", F.explode(F.when(F.col("n") > 1, whole).otherwise(shifted)).alias("r")).groupBy("k").agg(F.collect_set("r").alias("ranges")), "by_text")
    done(found, marked)
    return base.join(by_text, "k", "left").select("doc_id", "text", "ranges").mapInArrow(_remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
