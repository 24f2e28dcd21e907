"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed byte n-grams (orders 1 to 3) of the text with A-Z lower-cased and digits, ASCII
punctuation and blanks folded to one space; a text's value of an n-gram is its share of the text's n-grams
times the n-gram's inverse document frequency. Training is FTRL-proximal with L1 and L2 penalties on a
bounded sample of labelled rows, then one temperature is fitted on a held-back part of the sample. Scoring
runs over whole texts in pieces of bounded size; the model is a fixed-size table and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import bounded_batches, slices, trimmed

DIM = 1 << 16

_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = _FOLD[65:91] = np.arange(97, 123)


def folded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' folded bytes, one text after the other, and each text's end; runs of blanks count as one."""
    a = texts.cast(pa.large_binary())
    ends = np.cumsum(pc.binary_length(a).to_numpy(zero_copy_only=False).astype(np.int64))
    start = np.frombuffer(a.buffers()[1], dtype=np.int64)[a.offset]
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return np.zeros(0, np.uint8), np.zeros(len(ends), np.int64)
    c = _FOLD[np.frombuffer(a.buffers()[2], dtype=np.uint8)[start:start + total]]
    keep = c != 32
    keep[1:] |= c[:-1] != 32
    keep[0] = True
    begins = np.concatenate([[0], ends[:-1]])
    keep[begins[begins < total]] = True
    place = np.cumsum(keep)
    return c[keep], np.where(ends > 0, place[np.maximum(ends, 1) - 1], 0)


def ngrams(texts: pa.Array, most: int = 1 << 18) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Hashed n-grams of the texts in pieces of `most` places, so that a long text takes no more memory than short ones.

    Each piece: the number of its first text, the n-grams, and how many of them each text from that one on has.
    No n-gram crosses two texts; a blank alone is none.
    """
    c, ends = folded(texts)
    scale = lambda h, seed: ((h * np.uint32(2654435761) + np.uint32(seed)) >> np.uint32(16)).astype(np.int64)
    for s in range(0, len(c), most):
        n = min(most, len(c) - s)
        x = np.zeros(n + 2, np.uint32)
        x[:len(c[s:s + n + 2])] = c[s:s + n + 2]
        at = np.arange(s, s + n)
        owner = np.searchsorted(ends, at, side="right")
        two = x[:-1] << np.uint32(8) | x[1:]
        three = two[:-1] << np.uint32(8) | x[2:]
        ids = np.stack([scale(x[:n], 0x9E3779B9), scale(two[:n], 0x7F4A7C15), scale(three[:n], 0x85EBCA6B)], axis=1)
        inside = np.stack([x[:n] != 32, at + 1 < ends[owner], at + 2 < ends[owner]], axis=1)
        yield int(owner[0]), ids[inside], np.bincount(owner - owner[0], inside.sum(axis=1)).astype(np.int64)


@dataclass
class Model:
    """langs, weights times idf (DIM, classes + 1; the last column is 1 for n-grams that the sample has), class biases, temperature."""

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text by language, and the share of its n-grams that the sample has."""
        out, total = np.zeros((len(texts), len(self.langs) + 1)), np.zeros(len(texts), np.int64)
        for first, ids, counts in ngrams(texts, max(1 << 14, (1 << 20) // max(1, len(self.langs)))):
            own = np.flatnonzero(counts)
            if len(own):
                out[first + own] += np.add.reduceat(self.weights[ids], (np.cumsum(counts) - counts)[own], axis=0, dtype=np.float64)
            total[first:first + len(counts)] += counts
        out /= np.maximum(total, 1)[:, None]
        return out[:, :-1] + self.bias, out[:, -1]

    def best(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Language, calibrated probability and share of known n-grams of each text; `und` and 0 for a text without a letter."""
        lettered = pc.match_substring_regex(texts, r"\pL").to_numpy(zero_copy_only=False)
        if not self.langs:
            return np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
        logits, known = self.logits(texts)
        p = self.probabilities(logits)
        best = p.argmax(axis=1)
        return np.where(lettered, np.array(self.langs, object)[best], "und"), np.where(lettered, p[np.arange(len(best)), best], 0.0), known

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        z = logits / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct n-grams of each text with their shares: at most DIM a text."""
    for b in slices(batches):
        for i in range(b.num_rows):
            one = b.slice(i, 1)
            total = np.zeros(DIM, np.int64)
            for _, ids, _ in ngrams(one.column("text")):
                total += np.bincount(ids, minlength=DIM)
            at = np.flatnonzero(total)
            share = (total[at] / max(1, total.sum())).astype(np.float32)
            yield pa.RecordBatch.from_arrays([one.column("h"), one.column("lang"), pa.array([at.astype(np.int32).tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary())], ["h", "lang", "ids", "tf"])


def _learn(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights, biases and temperature from (n-grams, shares, class) rows."""
    df = np.zeros(DIM)
    for ids, _, _ in rows:
        df[ids] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    held, train = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows
    bias_at, scale = DIM, 100.0  # shares are small; this puts features near 1
    z, n = np.zeros((DIM + 1, k)), np.zeros((DIM + 1, k))

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(train)):
            ids, tf, y = train[i]
            at, x = np.append(ids, bias_at), np.append(tf.astype(np.float64) * idf[ids] * scale, 1.0)
            w = weights(z[at], n[at])
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(z, n)
    model = Model([""] * k, np.concatenate([w[:DIM] * idf[:, None] * scale, (df > 0)[:, None]], axis=1).astype(np.float32), w[DIM], 1.0)
    if held and k > 1:
        logits = np.array([tf.astype(np.float64) @ model.weights[ids, :-1].astype(np.float64) for ids, tf, _ in held]) + model.bias
        y = np.array([r[2] for r in held])
        loss = {}
        for t in np.geomspace(0.05, 20, 61):
            model.temperature = float(t)
            loss[float(t)] = -np.log(np.clip(model.probabilities(logits)[np.arange(len(y)), y], 1e-12, 1)).mean()
        model.temperature = min(loss, key=lambda t: (round(loss[t], 9), abs(np.log(t))))
    return model.weights, model.bias, model.temperature


def fit(labelled: DataFrame, most_rows: int = 3000, most_langs: int = 1000, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-4, epochs: int = 4) -> Model:
    """Learn from most_rows rows (text, lang, h) of the labelled ones or so, those of smallest h, equally many of each language if there are.

    The bounded sample is learnt from in one task; the driver gets the model alone. More than most_langs
    languages are an error.
    """
    bounded_batches(labelled.sparkSession)
    kinds = sorted((r["lang"], r["count"]) for r in labelled.groupBy("lang").count().limit(most_langs + 1).collect())
    langs = [k for k, _ in kinds]
    if len(langs) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    if not langs:
        return Model([], np.zeros((DIM, 1), np.float32), np.zeros(0), 1.0)
    each = most_rows / len(langs)
    # h is uniform over 32 bits; a share of it is a sample of rows that does not depend on their order.
    part = F.element_at(F.create_map(*[F.lit(x) for k, n in kinds for x in (k, min(1.0, each / n) * 2.0**32)]), F.col("lang"))
    number = {k: i for i, k in enumerate(langs)}

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = [r for b in batches for r in b.to_pylist() if r["ids"]]
        taken.sort(key=lambda r: (r["h"], r["lang"], r["ids"]))
        rows = [(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["tf"], np.float32), number[r["lang"]]) for r in taken]
        table, bias, t = _learn(rows, len(number), alpha, beta, l1, l2, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([bias.tobytes()], pa.binary()), pa.array([t])], ["weights", "bias", "t"])

    taken = labelled.where(F.col("h") < part).select("h", "lang", "text").mapInArrow(trimmed(_counts), "h long, lang string, ids binary, tf binary")
    got = taken.repartition(1).mapInArrow(learn, "weights binary, bias binary, t double").first()
    k = len(langs)
    return Model(langs, np.frombuffer(got["weights"], np.float32).reshape(DIM, k + 1), np.frombuffer(got["bias"], np.float64), got["t"])


def predict(docs: DataFrame, model: Model, text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """docs' carry columns, lang_pred and score, by the whole text. `und`, with score 0, if the text is null or has no letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name in carry]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, "text_", 1 << 20):
            names, score, _ = m.best(pc.fill_null(b.column("text_"), ""))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), pa.array(names, pa.string()), pa.array(score, pa.float64())], [*(f.name for f in kept), "lang_pred", "score"])

    return docs.select(*carry, F.col(text_col).cast("string").alias("text_")).mapInArrow(trimmed(run), schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 2, folds: int = 4, carry: tuple[str, ...] = (), **how) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (and carry).

    Learns from the text and the non-null lang of rows whose crc32(id as text) mod folds is not `fold`. A
    null id is held out. With no row to learn from all are `und`. Repeated rows are treated alike; an empty
    table gives an empty result; other columns are ignored.
    """
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    base = docs.withColumn("held_out", F.coalesce(crc % folds == fold, F.lit(True)))
    text = F.col(text_col).cast("string")
    labelled = base.where(~F.col("held_out") & F.col(lang_col).isNotNull() & text.isNotNull()).select(
        text.alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(2**32)).alias("h"))
    model = fit(labelled, **how)
    out = predict(base.withColumn("doc_id", F.col(id_col).cast("long")), model, text_col, ("doc_id", "held_out", *(c for c in carry if c not in ("doc_id", "held_out"))))
    return out


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = 0.6, known: float = 0.5, fold: int = 2, folds: int = 4, **how) -> DataFrame:
    """The rows of docs, all columns, whose language is identified; no shuffle.

    The model is fitted as in identify() and scores every whole text. A text stays if its best language has a
    calibrated probability of `least` or more and the sample has a share of `known` of its n-grams or more.
    Null texts and texts without a letter are `und` and go, and so does every text if there is no row to learn
    from. Rows that repeat an id or a text are treated alike; an empty table gives an empty result.
    """
    crc = F.crc32(F.col(id_col).cast("string").cast("binary"))
    text = F.col(text_col).cast("string")
    labelled = docs.where((crc % folds != fold) & F.col(lang_col).isNotNull() & text.isNotNull()).select(
        text.alias("text"), F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.col(id_col)), F.lit(2**32)).alias("h"))
    shared = docs.sparkSession.sparkContext.broadcast(fit(labelled, **how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in slices(batches, text_col, 1 << 20):
            names, score, seen = m.best(pc.fill_null(b.column(text_col), ""))
            yield b.filter(pa.array((names != "und") & (score >= least) & (seen >= known)))

    return docs.mapInArrow(trimmed(run), docs.schema)
