"""Decontamination where the benchmark is much of the documents, or large."""

import random

import pytest

from marlstone.llm import decontaminate


def _words(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))


@pytest.mark.parametrize("n,bad", [(3, 1), (13, 4), (120, 40), (120, 110)])
def test_items_in_many_documents(spark, n, bad):
    rnd = random.Random(n + bad)
    items = [_words(rnd, k) for k in (18, 34, 60)]
    docs = spark.createDataFrame([(i, f"{_words(rnd, 37)} {items[i % 3] if i < bad else ''} {_words(rnd, 41)}") for i in range(n)], "doc_id long, text string")
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    got = {(g.doc_id, g.item_id) for g in decontaminate.contaminated(docs, bench).collect()}
    assert got == {(i, i % 3) for i in range(bad)}
    assert decontaminate.without_contaminated(docs, bench).count() == n - bad


def test_large_benchmark(spark):
    rnd = random.Random(8)
    vocab = [_words(rnd, 1) for _ in range(6000)]
    make = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [make(rnd.randint(17, 60)) for _ in range(2400)]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    rows = [(i, f"{make(37)} {items[i]} {make(45)}") for i in range(0, 2400, 4)]
    for i in range(1, 2400, 8):  # paraphrases that keep three quarters
        w = items[i].split()
        rows.append((i, f"{make(37)} {' '.join(x for k, x in enumerate(w) if k % 4)} {make(45)}"))
    docs = spark.createDataFrame(rows + [(10_000 + i, make(120)) for i in range(600)], "doc_id long, text string").repartition(4)
    indexes = decontaminate.build_index(docs, bench)
    for x in indexes:
        kept = ((x.latent @ x.latent.T).diagonal(), [float(n) for n in x.length])
        assert abs(kept[0] - 1).max() < 1e-3 and min(kept[1]) > 0
    got = {(g.doc_id, g.item_id) for g in decontaminate.contaminated(docs, bench, index=indexes).collect()}
    # Brute force: the longest common subsequence of each item and each document that shares six words with it.
    bags, want = [(d, t.split(), set(t.split())) for d, t in docs.collect()], set()
    places = {}
    for i, t in enumerate(items):
        for x in set(t.split()):
            places.setdefault(x, []).append(i)
    for d, w, bag in bags:
        hits = {}
        for x in bag:
            for i in places.get(x, ()):
                hits[i] = hits.get(i, 0) + 1
        for i, n in hits.items():
            own = items[i].split()
            if n >= 6:
                ids = {x: k for k, x in enumerate(dict.fromkeys(own + w))}
                if decontaminate.lcs(decontaminate.np.array([ids[x] for x in own]), decontaminate.np.array([ids[x] for x in w])) >= 0.6 * len(own):
                    want.add((d, i))
    assert len(want) >= 900 and got == want, (len(want), len(want - got), len(got - want))


def test_spaces_hold_their_passages_whole(spark):
    """Products in the space are those of the whole TF-IDF vectors, whatever the documents are; a sample of them once took a part of the space."""
    rnd, np = random.Random(12), decontaminate.np
    vocab = [_words(rnd, 1) for _ in range(900)]
    make = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [make(rnd.randint(17, 60)) for _ in range(190)]
    items += [f"{t} {vocab[0]}" for t in items[:20]]  # passages that differ in a word
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    docs = spark.createDataFrame([(i, make(200)) for i in range(300)], "doc_id long, text string")
    windows = [decontaminate._terms(decontaminate.pa.array([make(16) + " " + items[i][:60]]))[0] for i in range(50)]
    indexes = decontaminate.build_index(docs, bench)
    assert len(indexes) == 2
    for x in indexes:
        passages = [decontaminate._terms(decontaminate.pa.array([items[i]]))[0] for i in x.item]
        dense = lambda t, x=x: np.bincount(t, minlength=decontaminate.DIM) * x.idf
        space = lambda t, x=x: x.basis[x.number[t]].sum(axis=0)
        whole = np.array([[dense(w) @ dense(p) / np.linalg.norm(dense(p)) for p in passages] for w in windows])
        assert np.abs(np.array([space(w) for w in windows]) @ x.latent.T - whole).max() < 1e-2 * whole.max() / 100
        assert all(abs(np.linalg.norm(space(p)) / n - 1) < 1e-4 for p, n in zip(passages, x.length, strict=True))


def test_passages_are_ruled_out_by_their_words():
    """The subsequence is only sought where the words in common could make up the share that is asked for, which loses nothing."""
    rnd, np = random.Random(5), decontaminate.np
    for _ in range(400):
        a, b = ([rnd.randrange(12) for _ in range(rnd.randint(1, 20))] for _ in range(2))
        places, whole = decontaminate._places(np.array(a)), decontaminate.lcs(np.array(a), np.array(b))
        for least in (0.0, 0.45, 0.6, 1.0):
            part = decontaminate._lcs(places, len(a), b, least)
            assert part == whole if sum(x in b for x in a) / len(a) >= least else part == 0 and whole / len(a) < least


def test_windows_add_up_their_words():
    rnd, np = np_random(3), decontaminate.np
    number = np.full(decontaminate.DIM, -1, np.int32)
    number[:50] = np.arange(50)
    basis = np.concatenate([rnd.standard_normal((50, 7)), np.zeros((1, 7))]).astype(np.float32)
    index = decontaminate.Index(number, rnd.random(decontaminate.DIM).astype(np.float32), basis, basis[:1], basis[0, :1], [0], [], [], [])
    counts = np.array([40, 0, 5, 16, 9000, 33])
    terms = rnd.integers(0, 80, counts.sum())
    vec, _, text, start = decontaminate.windows(terms, counts, index)
    begin = np.cumsum(counts) - counts
    for v, t, s in zip(vec, text, start, strict=True):
        own = terms[begin[t] + s : begin[t] + min(counts[t], s + 32)]
        assert np.abs(v - basis[own[own < 50]].sum(axis=0)).max() < 1e-4
    assert sorted(set(text.tolist())) == [0, 2, 3, 4, 5] and len(vec) == 2 + 1 + 1 + 562 + 2


def np_random(seed):
    return decontaminate.np.random.default_rng(seed)
