"""Benchmark decontamination by latent semantic retrieval.

1. Document frequencies of hashed words over all documents.
2. A distributed randomised SVD of the TF-IDF of all benchmark passages, in blocks of `block`, each with a space of its
   own. Products with the sparse passages run on the executors; the driver holds only matrices of (terms of these
   passages) x (rank + 10). What a space would lose of a passage (more than 1 - `energy` of its squared length) is
   added to it, so a space holds its passages whole. The products of step 3 are then those of the whole TF-IDF vectors,
   whatever the documents are: what is orthogonal to all passages adds nothing to any, so no sample of documents is fitted.
3. Every window of every document is projected and compared with every benchmark passage, by cosine.
4. Pairs from `cosine` on, and windows with as great a share of the passage's squared length, however little
   that is of the window's own, are checked: the longest common subsequence of words of the passage and the
   region around the window must cover `lcs` of the passage, or `lcs_answer` of it and its whole answer
   (its last sentence) in order, which finds paraphrases.
Nothing is shuffled but counts and matrix rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, hashes, slices, text_of, trimmed, words, written

BITS = 18
DIM = 1 << BITS
CHUNK = 16  # words; a window is two chunks


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Term, 64-bit hash of each word, and number of words of each text; case and ASCII punctuation do not count."""
    plain = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[!-/:-@\[-`{-~]+", " ")
    ids, dictionary, counts = words(plain, lower=False)
    h = hashes(dictionary)
    return (h >> np.uint64(64 - BITS)).astype(np.int64)[ids], h.view(np.int64)[ids], counts


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(DIM, np.int64)
    docs = 0
    for b in slices(batches, most=1 << 20):
        terms, _, counts = _terms(b.column("text"))
        owner = np.repeat(np.arange(len(counts)), counts)
        total += np.bincount(np.unique(owner << BITS | terms) & (DIM - 1), minlength=DIM)
        docs += len(counts)
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], docs), pa.int64())], ["term", "n"])


def _project_back(shared):
    """A' (A X) over the rows of a partition, as rows (term number, vector)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, weight, x = shared.value
        out = np.zeros_like(x)
        for b in batches:
            for terms in b.column("terms").to_pylist():
                u, c = np.unique(number[np.array(terms, np.int64)], return_counts=True)
                c, u = c[u >= 0], u[u >= 0]
                v = weight[u] * c
                norm = np.sqrt((v * v).sum())
                if norm > 0:
                    v = v / norm
                    out[u] += v[:, None] * (v @ x[u])[None, :]
        used = np.flatnonzero(np.abs(out).sum(axis=1))
        for at in range(0, len(used), 5000):
            part = used[at:at + 5000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([r.astype(np.float32).tobytes() for r in out[part]], pa.binary())], ["term", "vec"])

    return run


def _add_up(key: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for t, v in zip(b.column(key).to_pylist(), b.column("vec").to_pylist(), strict=True):
                x = np.frombuffer(v, np.float32)
                sums[t] = sums[t] + x if t in sums else x.copy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array([*sums], pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], [key, "vec"])

    return run


@dataclass
class Index:
    """The latent space of a block of benchmark passages, and the passages in it."""

    number: np.ndarray  # row of basis of each term, or -1, which is the last
    idf: np.ndarray  # of each term
    basis: np.ndarray  # (terms of the fit, rank), each row times the term's idf, and a row of zeros
    latent: np.ndarray  # (passages, rank), of length 1
    length: np.ndarray  # of each passage's TF-IDF vector
    item: list[int]
    item_words: list[np.ndarray]  # word hashes of each passage
    answer: list[np.ndarray]
    places: list[dict[int, int]]  # of each passage's words, as lcs needs them


def _places(a: np.ndarray) -> dict[int, int]:
    """The places of each word of a, as bits."""
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | 1 << i
    return places


def _lcs(places: dict[int, int], size: int, words: list[int], least: float = 0.0) -> int:
    """Length of the longest common subsequence of a passage of `size` words and these words, bit-parallel in the passage; 0 if not even
    the words that both have, in any order, make up `least` of the passage."""
    met = [m for m in map(places.get, words) if m]
    both = 0
    for m in met:
        both |= m
    if both.bit_count() / size < least:
        return 0
    v = full = (1 << size) - 1
    for m in met:
        u = v & m
        v = ((v + u) | (v - u)) & full
    return size - v.bit_count()


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    return _lcs(_places(a), len(a), b.tolist()) if len(a) else 0


def build_index(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", rank: int = 224, passage: int = 64, seed: int = 7, block: int = 200, energy: float = 1 - 1e-9) -> list[Index]:
    """docs: (text). Benchmark items of more than `passage` words are cut into passages that overlap by half. One index for each `block` passages."""
    spark = docs.sparkSession
    bounded_batches(spark)
    freq = written(docs.select("text").mapInArrow(trimmed(_frequencies), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "df").toPandas()
    df = np.zeros(DIM)
    at = freq["term"].to_numpy(np.int64)
    n_docs = int(freq["n"][at == -1].sum())
    df[at[at >= 0]] = freq["n"][at >= 0]
    idf = np.log((n_docs + 1) / (df + 1)) + 1  # never 0: an item that many documents have consists of frequent words
    item, terms, word_hash, answer = [], [], [], []
    for r in benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("t")).orderBy("i", "t").toLocalIterator():
        t, h, _ = _terms(pa.array([r["t"]]))
        last = len(_terms(pa.array([r["t"].rstrip(" .!?\n\t").replace("!", ".").replace("?", ".").rpartition(".")[2]]))[0])
        for s in range(0, max(1, len(h) - passage // 2), passage // 2):
            e = len(h) if len(h) <= passage else min(s + passage, len(h))
            if e > s:
                item.append(r["i"])
                terms.append(t[s:e])
                word_hash.append(h[s:e])
                answer.append(h[-last:] if last and e == len(h) and 4 <= last < len(h) else h[:0])
            if e == len(h):
                break
    if not item:
        return []
    idf32 = idf.astype(np.float32)
    out = []
    for at in range(0, len(item), block):
        part = slice(at, at + block)
        basis, number = _space(spark, terms[part], idf, rank, seed)
        out.append(_index(basis, number, idf, idf32, energy, terms[part], item[part], word_hash[part], answer[part]))
    return out


def _space(spark: SparkSession, terms: list[np.ndarray], idf: np.ndarray, rank: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Leading right singular vectors of the passages in terms, no more than there are passages, and the row of each term in them."""
    rows = written(spark.createDataFrame([(t.tolist(),) for t in terms], "terms array<bigint>"), "block")
    known = np.unique(np.concatenate(terms))
    number = np.full(DIM, -1, np.int32)
    number[known] = np.arange(len(known))
    weight = idf[known]
    width = max(1, min(rank + 10, len(known)))
    x = np.random.default_rng(seed).standard_normal((len(known), width))
    for step in range(3):  # range finder and two power steps
        shared = spark.sparkContext.broadcast((number, weight, x))
        part = rows.repartition(4).mapInArrow(trimmed(_project_back(shared)), "term long, vec binary")
        got = part.repartition(4, "term").mapInArrow(_add_up("term", width), "term long, vec binary").toArrow()
        y = np.zeros_like(x)
        if got.num_rows:
            y[got.column("term").to_numpy()] = np.frombuffer(b"".join(got.column("vec").to_pylist()), np.float32).reshape(-1, width)
        shared.unpersist()
        # Once the basis is orthonormal, turn it so that its leading columns come first, then take the next one.
        if step:
            y = y @ np.linalg.eigh(x.T @ y)[1][:, ::-1]
        x = np.linalg.qr(y)[0]
    return x[:, :min(rank, len(terms))], number


def _index(basis: np.ndarray, number: np.ndarray, idf: np.ndarray, idf32: np.ndarray, energy: float, terms: list[np.ndarray], item: list[int], word_hash: list[np.ndarray], answer: list[np.ndarray]) -> Index:
    """The passages in the space, to which that of each is added which the space keeps less than `energy` of."""
    weight = np.zeros(len(basis))
    weight[number[number >= 0]] = idf[number >= 0]
    rows = np.zeros((len(terms), len(basis)))
    for k, t in enumerate(terms):
        u, c = np.unique(number[t], return_counts=True)
        rows[k, u] = weight[u] * c
    latent, length = rows @ basis, np.sqrt((rows * rows).sum(axis=1))
    poor = (latent * latent).sum(axis=1) < energy * length**2
    if poor.any():
        rest = rows[poor] - latent[poor] @ basis.T
        rest /= np.sqrt((rest * rest).sum(axis=1, keepdims=True))
        more, sizes, _ = np.linalg.svd(rest.T, full_matrices=False)
        basis = np.concatenate([basis, more[:, sizes > 1e-6]], axis=1)
        latent = rows @ basis
    norm = np.sqrt((latent * latent).sum(axis=1, keepdims=True))
    latent = np.where(norm > 0, latent / np.maximum(norm, 1e-12), 0.0)
    scaled = np.concatenate([weight[:, None] * basis, np.zeros((1, basis.shape[1]))]).astype(np.float32)
    return Index(number, idf32, scaled, latent.astype(np.float32), length.astype(np.float32), item, word_hash, answer, [_places(w) for w in word_hash])


def windows(terms: np.ndarray, counts: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Latent vectors (rows by chunk pair), the length of all words' vector, the text and the first word of each window."""
    chunks = -(-counts // CHUNK)
    first = np.cumsum(chunks) - chunks
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(terms)) - np.repeat(np.cumsum(counts) - counts, counts)
    chunk = first[owner] + place // CHUNK
    n = int(chunks.sum())
    weight = index.idf[terms]
    energy = np.bincount(chunk, weight.astype(np.float64) ** 2, n)
    row = np.full((n, CHUNK), -1, np.int64)
    row[chunk, place % CHUNK] = index.number[terms]
    sums = np.zeros((n, index.basis.shape[1]), np.float32)
    for at in range(0, n, 256):  # sums of 256 chunks stay in the processor's cache
        part = sums[at:at + 256]
        for k in range(CHUNK):
            part += index.basis[row[at:at + 256, k]]
    text = np.repeat(np.arange(len(counts)), chunks)
    start = (np.arange(n) - first[text]) * CHUNK
    joined = np.zeros(n, bool)
    joined[:-1] = text[1:] == text[:-1]
    at = np.flatnonzero(joined)
    pair, power = sums[at] + sums[at + 1], energy[at] + energy[at + 1]
    alone = np.flatnonzero(chunks[text] == 1)
    vec = np.concatenate([pair, sums[alone]])
    power = np.concatenate([power, energy[alone]])
    at = np.concatenate([at, alone])
    return vec, np.sqrt(np.maximum(power, 1e-9)).astype(np.float32), text[at], start[at]


def _find(texts: pa.Array, indexes: list[Index], cosine: float, share: float, share_answer: float) -> dict[tuple[int, int], tuple[float, float, bool]]:
    """(row, item) -> best (lcs share, cosine, answer) of those found."""
    terms, h, counts = _terms(texts)
    found: dict[tuple[int, int], tuple[float, float, bool]] = {}
    if len(terms):
        for index in indexes:
            _find_block(terms, h, counts, index, cosine, share, share_answer, found)
    return found


def _find_block(terms: np.ndarray, h: np.ndarray, counts: np.ndarray, index: Index, cosine: float, share: float, share_answer: float, found: dict[tuple[int, int], tuple[float, float, bool]]) -> None:
    """Adds to found."""
    begin = np.cumsum(counts) - counts
    vec, power, text, start = windows(terms, counts, index)
    tried: set[tuple[int, int, int]] = set()
    for at in range(0, len(vec), 8192):
        dots = vec[at:at + 8192] @ index.latent.T
        # A passage of frequent words among rare ones has a low cosine: what the window has of the passage counts too.
        least = cosine * np.minimum(power[at:at + 8192, None], index.length[None, :])
        for i, j in zip(*np.nonzero(dots >= least), strict=True):
            row, s, own = int(text[at + i]), int(start[at + i]), index.item_words[j]
            block = s // (2 * CHUNK)
            size = len(own)
            lo, hi = max(0, s - size), min(int(counts[row]), s + 2 * CHUNK + size)
            if (row, int(j), block) in tried:
                continue
            tried.add((row, int(j), block))
            lo, hi = max(0, block * 2 * CHUNK - size), min(int(counts[row]), (block + 2) * 2 * CHUNK + size)
            region = h[begin[row] + lo:begin[row] + hi].tolist()
            ans = index.answer[j]
            part = _lcs(index.places[j], size, region, min(share, share_answer) if len(ans) else share) / size
            answered = bool(len(ans)) and part >= share_answer and _lcs(_places(ans), len(ans), region, 1.0) == len(ans)
            if part >= share or answered:
                key, new = (row, index.item[j]), (part, float(dots[i, j] / power[at + i]), answered)
                if key not in found or new > found[key]:
                    found[key] = new


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cosine: float = 0.25, share: float = 0.6, share_answer: float = 0.45, index: list[Index] | None = None, **how) -> DataFrame:
    """One row for each document and benchmark item found in it: doc_id, item_id, lcs, cosine, answer.

    lcs is the share of the item's passage that the document has in order; answer tells whether its last
    sentence is there. Null or empty texts and items have nothing to find; repeated rows are reported each
    for itself, a repeated item once a document; an empty table on either side gives an empty result; other
    columns are ignored.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(build_index(base, benchmark, **how) if index is None else index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 20):
            found = _find(b.column("text"), shared.value, cosine, share, share_answer)
            ids = b.column("doc_id").to_pylist()
            rows = [(ids[r], i, *x) for (r, i), x in sorted(found.items())]
            cols = [*zip(*rows, strict=True)] or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "lcs", "cosine", "answer"])

    return base.mapInArrow(trimmed(run), "doc_id long, item_id long, lcs double, cosine double, answer boolean")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", cosine: float = 0.25, share: float = 0.6, share_answer: float = 0.45, **how) -> DataFrame:
    """The rows of docs, all columns, that have no benchmark item in them; no shuffle."""
    index = build_index(docs.select(text_of(docs, text_col).alias("text")), benchmark, **how)
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text_col, 1 << 20):
            found = _find(pc.fill_null(b.column(text_col), ""), shared.value, cosine, share, share_answer)
            bad = np.zeros(b.num_rows, bool)
            bad[[r for r, _ in found]] = True
            yield b.filter(pa.array(~bad))

    return docs.mapInArrow(trimmed(run), docs.schema)
