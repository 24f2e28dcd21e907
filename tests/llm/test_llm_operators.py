"""Each operator against a brute-force version, on a small table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, exact_dedup, language_id, license_scan, mixing, near_dedup, suffix_dedup, suffix_tree_lm, token_store, url_filter
from marlstone.llm.registry import TOKENIZER

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, k long, size long, key string, th long"


def words(text):
    return WORD.findall((text or "").encode())


def lower(b):
    return b.lower()  # bytes.lower is ASCII only


@pytest.fixture(scope="session")
def rows():
    rnd = random.Random(3)
    vocab = ["the", "of", "was", "haus", "straße", "niño", "été", "Tree", "river", "stone", "cloud", "lamp", "x", "under", "mit"] + [f"w{i}" for i in range(120)]
    make = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    base = [make(rnd.randint(5, 120)) for _ in range(60)]
    texts = base + base[:8] + [base[0]] * 6
    for t in base[10:18]:  # near copies
        w = t.split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [None, None, "", " \t\n ", "one", "one two three", "ONE two three", make(6000), "a" * 900, "ab" * 300, "é" * 150, "b" * 199, "b" * 200, "12 34 !!", "Under the MIT-License. cc-by-nc; Apache License, Version 2.0", "tail  two blanks", "nbsp\u00a0\u00a0x", "<|endoftext|> text"]
    out = [(i, t, ["en", "de", None][i % 3], [None, "s1", "s2", "é", ""][i % 5], 1, i, 2, 3, "k", 4) for i, t in enumerate(texts)]
    return [*out, out[3], (None, "no id here", "en", "s1", 0, 0, 0, 0, "", 0), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


def test_exact_dedup(docs, rows, empty):
    for least in (100, 2):  # also with hot groups
        got = exact_dedup.exact_dedup(docs, hot_least=least, hot_share=0.0).collect()
        assert len(got) == len(rows)
        best, size = {}, Counter((r[1] or "") for r in rows)
        for r in rows:
            t = r[1] or ""
            best[t] = max([x for x in (best.get(t), r[0]) if x is not None], default=None)
        want = Counter((r[0], best[r[1] or ""], size[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in rows)
        assert Counter((g.doc_id, g.keep_id, g.group_size, g.text_sha256) for g in got) == want
        assert sum(g.kept for g in got) == len(size)
        assert all(g.doc_id == g.keep_id for g in got if g.kept)
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs, group=5).collect()
    again = mixing.mix(docs, group=5).collect()
    key = lambda g: (str(g.doc_id), g.size, g.taken)
    assert sorted(map(key, got)) == sorted(map(key, again)) and len(got) == len(rows)
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(size.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * size[s]}
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 3.0 * size[s]
            left -= target[s]
        open_ -= full
    taken = Counter()
    source = {r[0]: r[3] for r in rows if r[0] is not None}
    for g in got:
        assert 0 <= g.taken <= 3 * g.size
        if g.doc_id is not None:
            taken[source[g.doc_id]] += g.taken
            assert math.isclose(g.target, target[source[g.doc_id]], rel_tol=1e-9)
            assert g.source_size == size[source[g.doc_id]]
    for s in order:
        if s not in ("s1", None):  # their rows without id are not in taken
            assert abs(taken[s] - target[s]) <= max(60, 0.02 * target[s])
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).columns == docs.columns


def test_mixing_plans_are_short(docs, monkeypatch):
    """A plan has each of its rounds once, not one copy more for each round after it."""
    joins = {}

    def written(df, name):
        joins[name] = df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        return real(df, name)

    real = mixing.written
    monkeypatch.setattr(mixing, "written", written)
    mixing.mix(docs)
    assert joins["dual"] <= 5 and joins["sources"] <= 5


def test_runs_are_packed_a_few_buckets_at_a_time(monkeypatch):
    """What is sorted and copied at once is a part of the runs that a task holds; the counts are those of all its slices."""
    rng, most, real, buckets = np.random.default_rng(3), 0, suffix_tree_lm._sums, 40
    tokens = [rng.integers(1, 400, 20_000) for _ in range(6)]

    def sums(keys, *more):
        nonlocal most
        most = max(most, len(keys))
        return real(keys, *more)

    def part(k, t):
        own, at = np.unique(t, return_inverse=True)
        cols = (np.array([k]), np.array([False]), np.array([False]), np.array([len(t)]), own, at.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], ["slice", "ids", "nulls", "held", "counts", "words", "at"])

    monkeypatch.setattr(suffix_tree_lm, "_sums", sums)
    got = Counter()
    for b in suffix_tree_lm._count_runs(None, 2, buckets)(iter([part(k, t) for k, t in enumerate(tokens)])):
        x, w, c = (np.frombuffer(b.column(n)[0].as_buffer(), d) for n, d in (("x", np.int64), ("w", np.int64), ("c", np.int32)))
        assert set(suffix_tree_lm.bucket_of(suffix_tree_lm.follow(x, w), buckets).tolist()) == {b.column("bucket")[0].as_py()}
        for k in zip(x.tolist(), w.tolist(), c.tolist(), strict=True):
            got[k[:2]] += k[2]
    assert got == Counter(p for t in tokens for p in zip(t[:-1].tolist(), t[1:].tolist(), strict=True))
    held = sum(len(set(zip(t[:-1].tolist(), t[1:].tolist(), strict=True))) for t in tokens)
    assert most < held / 4


def sliced(docs):
    return suffix_tree_lm.sliced(docs.select("doc_id", F.lit(False).alias("held_out"), "text"))


def brute_scores(train, texts, least_context=2, least=2, gain=0.01, discount=0.75, depth=3):
    """The tree and the scores by dictionaries of word tuples."""
    tokens = lambda t: [*map(lower, words(t)), b"<end>"]
    c = Counter()
    for t in train:
        w = tokens(t)
        c.update(tuple(w[i:i + k]) for k in range(1, depth + 2) for i in range(len(w) - k + 1))
    n, v = sum(x for k, x in c.items() if len(k) == 1), sum(len(k) == 1 for k in c)
    root = lambda w: math.log10((c[(w,)] + 1) / (n + v + 1))
    lp, beta, own = {k: root(k[0]) for k in c if len(k) == 1}, {}, {}
    for d in range(1, depth + 1):
        nexts = {}
        for k, x in c.items():
            if len(k) == d + 1 and x >= least and c[k[:-1]] >= least_context:
                nexts.setdefault(k[:-1], []).append(k)
        for x, ks in nexts.items():
            p, q = {k: (c[k] - discount) / c[x] for k in ks}, {k: 10 ** lp[k[1:]] for k in ks}
            rp, rq = max(1 - sum(p.values()), 1e-12), max(1 - sum(q.values()), 1e-12)
            kl = sum(p[k] * math.log(p[k] / q[k]) for k in ks) + rp * math.log(rp / rq)
            if kl - len(ks) / (2 * c[x]) > gain:
                beta[x], own[x] = math.log10(rp / rq), set(ks)
            lp |= {k: math.log10(p[k] if x in beta else q[k]) for k in ks}
    out = []
    for t in texts:
        w, total = tokens(t), 0.0
        for i in range(len(w)):
            add = 0.0
            for d in range(min(depth, i), 0, -1):
                x = tuple(w[i - d:i])
                if x in beta:
                    if (*x, w[i]) in own[x]:
                        add += lp[(*x, w[i])]
                        break
                    add += beta[x]
            else:
                add += root(w[i])
            total += add
        out.append(total)
    return out


@pytest.mark.parametrize("least", [2, 4])
def test_suffix_tree_against_brute_force(spark, docs, rows, least):
    rnd = random.Random(12)
    more = [(2000 + i, " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 60)))) for i in range(80)]
    more += [(3000, "twice seen words in this order only here"), (3001, "twice seen words in this order only here"), (3002, "only here in this order seen words twice")]
    texts = [(r[0], r[1]) for r in rows] + more
    got = suffix_tree_lm.score(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), per_bucket=500, least_context=least).collect()
    train = [t for i, t in texts if i is not None and zlib.crc32(str(i).encode()) % 7 != 2]
    want = {(i, t): s for (i, t), s in zip(texts, brute_scores(train, [t for _, t in texts], least), strict=True)}
    assert Counter((g.doc_id, round(g.score, 6)) for g in got) == Counter((i, round(s, 6)) for (i, t) in texts for s in [want[i, t]])
    by = {g.doc_id: g.gain for g in got}
    assert least > 2 or by[3000] > by[3002] + 0.5


def test_run_hashes_are_sparks(spark):
    x, w = np.array([0, -5, 2**62, 123456789]), np.array([7, -1, 3, 2**40])
    got = spark.createDataFrame([*zip(x.tolist(), w.tolist(), strict=True)], "x long, w long").select(F.xxhash64("x", "w").alias("h")).collect()
    assert [r.h for r in got] == suffix_tree_lm.follow(x, w).tolist()


def test_suffix_tree(docs, rows, empty):
    got = suffix_tree_lm.score(docs).collect()
    train = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2]
    c = Counter(x for r in train for x in [*map(lower, words(r[1])), None])
    n, v = sum(c.values()), len(c)
    want = []
    for r in rows:
        t = [*map(lower, words(r[1])), None]
        want.append((str(r[0]), r not in train, len(t), sum(c[x] > 0 for x in t), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t), 6)))
    assert Counter((str(g.doc_id), g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got) == Counter(want)
    assert all(g.score <= 0 for g in got) and suffix_tree_lm.score(empty).count() == 0
    tree, _, _ = suffix_tree_lm.train(sliced(docs))
    for s in range(-1, len(tree.parent)):  # every state's next-symbol probabilities add up
        assert abs((10 ** tree.log10(np.full(len(tree.root), s), np.arange(len(tree.root)))).sum() - 1) < 1e-9


def test_suffix_tree_prefers_seen_order(spark):
    text = "alpha beta gamma delta " * 40
    docs = spark.createDataFrame([(i, text) for i in range(20)] + [(100 + i, "delta gamma beta alpha " * 40) for i in range(1)], "doc_id long, text string")
    got = {g.doc_id: g for g in suffix_tree_lm.score(docs).collect()}
    assert got[0].score > got[0].base_score and got[0].score / got[0].n_tokens > got[100].score / got[100].n_tokens


def test_urls(spark):
    urls = [None, "", "no scheme", "http://example.com/en/1", "https://WWW.Example.com/en/x?y=1", "http://a.net/es/1", "http://net/fr/", "http://xnet/es/", "http://a.com", "http://a.com?x=/es/", "http://b.org/en/1#/p", "http://example.com/fr/1", "x://y://z/com/"] * 3
    got = url_filter.judge(spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")).collect()
    assert len(got) == len(urls)
    for g in got:
        u = urls[g.page_id] or ""
        rest = u.partition("://")[2]
        host = re.split(r"[/?#]", rest)[0].lower()
        path = re.split(r"[?#]", rest[len(host):])[0]
        fits = [(len(r), r, v) for v, r in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
        assert (g.host, g.path) == (host, path)
        assert g.rule == (max(fits)[1] if fits else None)
        assert g.verdict == max(fits)[2] if fits else g.verdict in ("allow", "block")
        assert 0 <= g.score <= 1
    nothing = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(nothing).count() == 0


def test_url_trees_learn(spark):
    rows = [(i, f"http://{'shop' if i % 2 else 'a-b-c-d'}{i}.{'com' if i % 2 else 'net'}/{'en' if i % 2 else 'es'}/{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    got = url_filter.judge(pages).collect()
    by_shuffle = {g.page_id: g.score for g in url_filter.judge(pages, few=0).collect()}
    assert all(abs(g.score - by_shuffle[g.page_id]) < 1e-9 for g in got)
    assert sum((g.score >= 0.5) == (g.verdict == "block") for g in got) >= 396


def test_language(spark, empty):
    rnd = random.Random(1)
    kinds = {"en": "the of and river stone with that", "de": "der und straße nicht für über haus", "fr": "le été où naïve être garçon dans"}
    make = lambda x: " ".join(rnd.choice(kinds[x].split()) for _ in range(40))
    rows = [(i, make(x), x if i % 5 else None, "s") for i in range(300) for x in [list(kinds)[i % 3]]]
    rows += [(1000, None, "en", "s"), (1001, "12 !!", "de", "s"), (1002, "", "fr", "s"), (None, make("en"), "en", "s"), rows[4], (1003, make("de") * 200, "de", "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    got = language_id.identify(docs, most_rows=150).collect()
    assert len(got) == len(rows)
    held = [g for g in got if g.held_out and g.doc_id is not None and g.doc_id < 300]
    assert all(g.held_out == (g.doc_id is None or zlib.crc32(str(g.doc_id).encode()) % 4 == 2) for g in got)
    assert sum(g.lang_pred == list(kinds)[g.doc_id % 3] for g in held) >= 0.97 * len(held)
    by = {g.doc_id: g for g in got}
    assert [by[i].lang_pred for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"] and by[1000].score == 0
    assert all(0 <= g.score <= 1 for g in got)
    assert language_id.keep_identified(docs).count() == len(rows) - 3
    assert language_id.identify(empty).count() == 0


def grams(texts, most=1 << 20):
    ids, n = [[] for _ in texts], [0] * len(texts)
    for first, got, counts in language_id.ngrams(pa.array(texts), most):
        at = 0
        for i, c in enumerate(counts.tolist()):
            ids[first + i] += got[at:at + c].tolist()
            n[first + i] += c
            at += c
    assert [len(x) for x in ids] == n
    return [sorted(x) for x in ids]


def test_ngrams_do_not_cross_texts():
    texts = ["ab", "", "a b", "é", "!!", "one  two", "x" * 50]
    assert grams(texts) == [grams([t])[0] for t in texts] == grams(texts, 3)


def test_language_stage_scores_every_text(spark):
    rnd = random.Random(2)
    kinds = {"en": "the of and river stone with that", "de": "der und straße nicht für über haus"}
    make = lambda x: " ".join(rnd.choice(kinds[x].split()) for _ in range(40))
    rows = [(i, make(x), x) for i in range(200) for x in [list(kinds)[i % 2]]]
    rows += [(500, "это совсем другой язык " * 20, None), (501, "日本語の文章です " * 20, None), (502, "12 34", "en"), (503, None, None), (504, make("de") * 40, None)]
    left = {r.doc_id for r in language_id.keep_identified(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert left == {*range(200), 504}  # 500 and 501 have letters, but no language that was learnt


def test_long_text_in_pieces():
    """A text of 50 MB is scored in bounded pieces, as its parts are."""
    import resource

    part = "the river and the stone " * 1000
    model = language_id.Model(["a", "b"], np.random.default_rng(0).standard_normal((language_id.DIM, 3)).astype(np.float32), np.zeros(2), 1.0)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    long = model.logits(pa.array([part * 2100], pa.large_string()))[0]
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_200_000  # kB
    assert np.allclose(long, model.logits(pa.array([part * 20]))[0], atol=1e-3)



def test_license(docs, rows, empty):
    assert len(license_scan.rules()) > 200
    got = license_scan.license_scan(docs).collect()
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def want(t):
        w = token.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        at = [(i, x) for p, x in license_scan.BASE.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
        return len(w), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))

    assert Counter((str(g.doc_id), g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels) for g in got) == Counter((str(r[0]), *want(r[1])) for r in rows)
    assert all(set(filter(None, g.base_labels.split(","))) <= set(filter(None, g.labels.split(","))) and 0 <= g.score <= 1 for g in got)
    assert license_scan.license_scan(empty).count() == 0


@pytest.mark.parametrize("text,label", [
    ("Licensed under the Apache License, Version 2.0 (the License)", "apache-2"), ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3"),
    ("distributed under the terms of the GNU General Public License version 3 or later", "gpl-3"), ("GNU Lesser General Public License, version 2.1", "lgpl-2.1"),
    ("released under CC BY-NC-SA 4.0", "cc-by-nc-sa"), ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit")])
def test_license_signatures(text, label):
    assert label in license_scan.scan_text(text.lower())[4].split(",")


def test_license_containment():
    kept = license_scan.detect(" released under cc by nc sa 4 0 license ")
    assert {r.label for _, _, r in kept} == {"cc-by-nc-sa"}
    assert license_scan.detect(" a tree by the river ") == []


def test_license_gate_misses_nothing():
    for r in license_scan.rules():
        sample = re.sub(r"\(\?:|\)\??|\[sc\]|\?|\|.*", lambda m: "s" if m[0] == "[sc]" else "", r.pattern)
        hit = license_scan.detect(f" {sample} ")
        assert not hit or license_scan.FIRST.search(sample), (r, sample)


def test_token_store(spark, docs, rows, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    path = token_store.write_store(docs, TOKENIZER, mean_bits=4, least=4, most=64)
    got = sorted(token_store.read_digests(spark, path).collect(), key=lambda g: g.start)
    want = {}
    for r in rows:
        ids = np.array(t.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        want.setdefault(r[0], []).append((zlib.crc32(ids.tobytes()), len(ids), ids.tolist()))
    start, order = 0, []
    for g in got:
        assert g.verified and g.start == start
        start += g.n_tokens
        order.append(g.doc_id)
    assert order == sorted(order, key=lambda i: -1 if i is None else i)
    assert Counter((g.doc_id, g.ids_crc32, g.n_tokens) for g in got) == Counter((i, c, n) for i, x in want.items() for c, n, _ in x)
    back = token_store.read_documents(spark, path).collect()
    assert Counter((b.doc_id, tuple(b.ids)) for b in back) == Counter((i, tuple(ids)) for i, x in want.items() for _, _, ids in x)
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("key").distinct().count()
    none = token_store.write_store(empty, TOKENIZER)
    assert token_store.read_digests(spark, none).count() == 0


def test_crc_join():
    parts = [b"abcd" * 5, b"", b"x" * 4000, b"yz12"]
    assert token_store.crc_join([zlib.crc32(p) for p in parts], [len(p) for p in parts]) == zlib.crc32(b"".join(parts))


def test_store_is_verified(spark, docs):
    path = token_store.write_store(docs.where("doc_id < 5"), TOKENIZER)
    spark.read.parquet(f"{path}/recipes").withColumn("root", F.lit("0" * 64)).write.parquet(f"{path}/other")
    token_store.drop_path(spark, f"{path}/recipes")
    spark.read.parquet(f"{path}/other").write.parquet(f"{path}/recipes")
    with pytest.raises(ValueError):
        token_store.read_digests(spark, path)


def test_suffix_array():
    rnd = random.Random(5)
    for _ in range(200):
        t = np.array([rnd.randint(0, rnd.choice([0, 1, 3])) for _ in range(rnd.randint(1, 40))])
        sa = suffix_dedup.suffix_array(t)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())
        lcp = suffix_dedup.common_prefixes(t, sa, 40)
        for k, x in enumerate(lcp.tolist()):
            a, b = t[sa[k]:].tolist(), t[sa[k + 1]:].tolist()
            assert x == next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))


@pytest.mark.parametrize("hot", [400, 0])
def test_repeats(docs, rows, empty, hot):
    count = Counter()
    for r in rows:
        b = (r[1] or "").encode()
        count.update(b[i:i + 200] for i in range(len(b) - 199))

    def want(t):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 199):
            if count[b[i:i + 200]] > 1:
                gone[i:i + 200] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        return len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()

    got = suffix_dedup.remove_repeats(docs, hot=hot).collect()
    assert Counter((str(g.doc_id), g.n_bytes, g.n_removed, g.n_spans, g.kept_sha256) for g in got) == Counter((str(r[0]), *want(r[1])) for r in rows)
    assert suffix_dedup.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("width,block", [(4, 256), (5, 2)])
def test_near(docs, rows, empty, width, block):
    sets = {}
    for r in rows:
        w = [*map(lower, words(r[1]))]
        sets.setdefault(r[0], set()).add(frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1))) if w else frozenset())
    ids = [i for i in sets if i is not None]
    comp = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for i in ids:
            for j in ids:
                if comp[i] != comp[j] and any(a and b and 100 * len(a & b) >= 80 * len(a | b) for a in sets[i] for b in sets[j]):
                    comp[i] = comp[j] = min(comp[i], comp[j])
                    moved = True
    got = near_dedup.near_dedup(docs, width=width, block=block).collect()
    assert len(got) == len(rows)
    for g in got:
        if g.doc_id is None:
            assert g.component_id is None and g.kept
        else:
            assert g.component_id == comp[g.doc_id] and g.kept == (g.doc_id == comp[g.doc_id])
            assert g.n_shingles in {len(s) for s in sets[g.doc_id]}
    assert near_dedup.near_dedup(empty).count() == 0
    kept = near_dedup.keep_one(docs, width=width)
    assert kept.columns == docs.columns and kept.where("doc_id is not null").count() == sum(comp[i] == i for i in ids)


def test_near_rows_of_one_id_are_one_vertex(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a, 1), (5, a, 2), (5, b, 3), (7, b, 4), (9, "else entirely " * 9, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id long")
    got = near_dedup.near_dedup(docs).collect()
    assert sorted((g.doc_id, g.component_id, g.kept) for g in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (9, 9, True)]
    left = near_dedup.keep_one(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [3, 9]
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs, few=0).collect()) == [3, 9]


def test_decontaminate(spark, docs, empty):
    rnd = random.Random(9)
    item = lambda: " ".join("q" + "".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(30)) + ". the answer is here now"
    items = [item() for _ in range(12)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)] + [(50, None, 1), (51, "", 1)], "item_id long, text string, doc_id long")
    filler = [r.text for r in docs.where("length(text) > 100").limit(12).collect()]
    w = items[2].split()
    para = " ".join(x for i, x in enumerate(w) if i % 4 or i > 28)
    bad = [(1000 + i, f"{filler[i]} {t.upper() if i == 1 else t} {filler[i]}") for i, t in enumerate(items)] + [(2000, f"{filler[0]} {para} {filler[1]}")]
    extra = spark.createDataFrame(bad, "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(extra)
    got = {(g.doc_id, g.item_id) for g in decontaminate.contaminated(both, bench).collect()}
    assert got == {(1000 + i, i) for i in range(12)} | {(2000, 2)}
    whole = docs.unionByName(extra, allowMissingColumns=True)
    assert decontaminate.without_contaminated(whole, bench).count() == docs.count()
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("false")).count() == 0


def test_lcs():
    rnd = random.Random(2)
    for _ in range(100):
        a, b = ([rnd.randint(0, 4) for _ in range(rnd.randint(1, 70))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontaminate.lcs(np.array(a), np.array(b)) == t[-1][-1]


def test_suffix_tree_grows_with_the_corpus(spark):
    """Rare words are contexts however large the corpus is, and no state is lost to the share of the corpus."""
    rnd = random.Random(8)
    often = [(i, " ".join(rnd.choice("abcdefgh") for _ in range(400))) for i in range(400)]  # 160,000 tokens
    rare = [(1000 + i, f"rareone raretwo rare{i}") for i in range(6)]  # 6 of them: below 5e-5 of all
    docs = spark.createDataFrame(often + rare + [(2000, "rareone raretwo"), (2001, "raretwo rareone")], "doc_id long, text string")
    got = {g.doc_id: g for g in suffix_tree_lm.score(docs, fold=7).collect()}
    assert got[2000].base_score == pytest.approx(got[2001].base_score, abs=1)
    assert got[2000].score > got[2001].score + 1


def generated(pattern, rnd):
    """A string that the pattern matches, alternatives and repeats by chance."""
    from re import _parser

    def of(items):
        out = ""
        for op, arg in items:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "ANY":
                out += "n"
            elif name == "IN":
                k, v = rnd.choice(arg)
                out += chr(v if str(k) == "LITERAL" else rnd.randint(*v)) if str(k) != "CATEGORY" else "1"
            elif name == "BRANCH":
                out += of(rnd.choice(arg[1]))
            elif name == "SUBPATTERN":
                out += of(arg[3])
            else:
                out += "".join(of(arg[2]) for _ in range(rnd.randint(arg[0], min(int(arg[1]), arg[0] + 1))))
        return out

    return of(_parser.parse(pattern))


def test_license_gates_pass_generated_strings():
    """Whole strings of each frame and name pass both gates, also with underscores between words."""
    rnd = random.Random(5)
    for r in license_scan.rules():
        for _ in range(12):
            sample = generated(r.pattern, rnd)
            assert re.fullmatch(r.pattern, sample), (r, sample)
            assert license_scan.FIRST.search(sample) and license_scan.FIRST.search(f"_{sample.replace(' ', '_')}_"), (r, sample)
            assert license_scan.detect(f" {sample} "), (r, sample)


@pytest.mark.parametrize("text,label", [("Released under the MIT", "mit"), ("distributed under the terms of the ISC", "isc"), ("provided under the Boost Software", "bsl-1"), ("available under Elastic 2", "elastic-2"), ("shared under Vim", "vim"), ("x cc_by_nc x", "cc-by-nc")])
def test_license_frames_without_the_word(spark, text, label):
    got = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert label in got.labels.split(",") and got.score > 0
