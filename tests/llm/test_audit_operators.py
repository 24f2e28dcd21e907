"""Centroids, filter audit and quality rules against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import os
import random
import re
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from marlstone.llm import centroids, filter_audit, quality_rules, registry

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


# ---------------------------------------------------------------- centroids


def lloyd(rows, k=16, rounds=3, dim=64, scale=64):
    """rows: (id, components). The whole result in Python integers."""
    kept = []
    for i, x in rows:
        if x is not None and len(x) == dim and all(c is not None and math.isfinite(c) for c in x):
            kept.append((i, [math.floor(Fraction(c) * scale) for c in x], x))
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2])
    cents = [r[1] for r in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        groups = {}
        for _, v, _ in kept:
            groups.setdefault(near(v)[1], []).append(v)
        cents = [[sum(c) // len(groups[j]) for c in zip(*groups[j], strict=True)] if j in groups else cents[j] for j in range(len(cents))]
    found = [(i, *near(v)) for i, v, _ in kept]
    each = {}
    for _, d, j in found:
        each[j] = each.get(j, 0) + d
    long = lambda n: n if n < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, j, long(d), long(each[j]), long(sum(each.values())), sha[j]) for i, d, j in found), key=str)


def run_clusters(spark, rows, kind="float", **how):
    df = spark.createDataFrame([(i, x, 1, 2, "c") for i, x in rows], f"vec_id long, embedding array<{kind}>, label int, x long, cluster string").repartition(3)
    got = centroids.cluster(df, **how).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()
    return sorted((tuple(r) for r in got), key=str)


@pytest.fixture(scope="module")
def vectors():
    rnd = random.Random(5)
    f32 = lambda v: [Fraction(c).limit_denominator(1 << 12).__float__() // (1 / 4096) / 4096 for c in v]  # noqa: E731  floats of few bits
    rows = [(i, f32([rnd.gauss(0, 0.3) + (i % 7) / 4 for _ in range(64)])) for i in range(150)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # one vector many times
    rows += [rows[5], (None, rows[9][1]), (None, rows[9][1])]
    rows += [(300, None), (301, []), (302, [0.5] * 63), (303, [0.5] * 65), (304, [0.5] * 63 + [None]), (305, [float("nan")] * 64), (306, [0.5] * 63 + [float("inf")])]
    return rows


def test_centroids(spark, vectors):
    assert run_clusters(spark, vectors) == lloyd(vectors)
    assert run_clusters(spark, vectors, "double", k=5, rounds=1) == lloyd(vectors, k=5, rounds=1)


def test_centroids_few_and_none(spark, vectors):
    assert run_clusters(spark, vectors[:4]) == lloyd(vectors[:4])  # fewer vectors than centroids
    same = [(i, [0.25] * 64) for i in range(20)]  # ties everywhere; empty centroids stay
    assert run_clusters(spark, same) == lloyd(same)
    assert run_clusters(spark, vectors[-7:]) == []
    assert run_clusters(spark, []) == []


def test_centroids_beyond_float64(spark, vectors):
    """Components whose squares no float64 holds, and some whose 64-fold is no float64 at all."""
    big = [(i, [c * 2.0**s for c in x]) for (i, x), s in zip(vectors[:40], itertools.cycle([0, 24, 40, 60]), strict=False)]
    assert run_clusters(spark, big, "double") == lloyd(big)
    big.append((900, [1.7e308] * 64))
    assert run_clusters(spark, big, "double") == lloyd(big)


def test_centroids_at_the_guard(spark):
    """Magnitudes on both sides of the bound below which products are exact."""
    rnd = random.Random(2)
    rows = [(i, [float(rnd.randint(-(2**17), 2**17)) * 2 ** (i % 3 - 1) for _ in range(64)]) for i in range(60)]
    assert run_clusters(spark, rows, "double") == lloyd(rows)


# ---------------------------------------------------------------- filter audit


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(8)
    vocab = [f"w{i}" for i in range(400)] + ["The", "ALL", "a&b", "é", "ÀB"]
    make = lambda n, v=400: " ".join(rnd.choice(vocab[:v]) for _ in range(n))
    out = [make(rnd.choice([5, 40, 99, 100, 101, 150]), rnd.choice([20, 120, 405])) for _ in range(80)]
    out += [t.upper() for t in out[:10]] + out[5:25] + [out[0]] * 40 + [None, None, "", "  \n", "x" * 5000, make(20_000), "A" * 10 + "b" * 90, "A" * 11 + "b" * 89]
    langs = ["en", "de", None, ""]
    rows = [(i * 3 % 211, t, langs[i % 4], "s", i, i, "x") for i, t in enumerate(out)]
    rnd.shuffle(rows)
    return [*rows, rows[0], (None, out[0], "en", "s", 0, 0, ""), (None, "only here", None, None, None, None, None)]


LABELS = [(i, i % 2, 1 if i % 5 == 0 else 0) for i in range(0, 150)] + [(4, 1, None), (9, None, 1), (None, 1, 1), (7, 1, 1)]


def audit_brute(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    docs = {}
    for i, t, lang, *_ in rows:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.setdefault(lang or "", []).append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = []
    for part, have in docs.items():
        table = {}
        for order in map("".join, itertools.permutations("ABCDE")):
            left = have
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                n_fail = sum(f in d[0] for d in have)
                left = [d for d in left if f not in d[0]]
                table[order, step] = (f, len(left), len(gone), n_fail - len(gone), sum(d[0] == {f} for d in have), sum(d[1] for d in gone), sum(d[2] for d in gone))
        shapley = {f: sum(v[2] for v in table.values() if v[0] == f) for f in "ABCDE"}
        out += [(part, o, s, *v[1:], shapley[v[0]]) for (o, s), v in table.items()]
    return sorted(out)


AUDIT = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
DOCS = "doc_id long, text string, lang string, source string, n long, mask long, kind string"


def test_audit(spark, texts):
    labels = spark.createDataFrame([(*r, "k") for r in LABELS], "doc_id long, quality int, toxic int, kind string")
    docs = spark.createDataFrame(texts, DOCS).repartition(4)
    got = sorted(tuple(r) for r in filter_audit.audit(docs, labels).select(*AUDIT).collect())
    assert got == audit_brute(texts, LABELS)
    assert filter_audit.audit(docs.where("false"), labels).collect() == []
    few = filter_audit.audit(docs, labels.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost"), F.count(F.lit(1))).first()
    assert tuple(few) == (0, 0, 600 * 3)


def test_parity_sums_invert(spark):
    """The transform back gives any counts exactly, large ones too."""
    rnd = random.Random(1)
    counts = [rnd.choice([0, 1, 7, 10**15 + 1]) for _ in range(32)]
    rows = spark.createDataFrame([(None, "p", m, n) for m, n in enumerate(counts) if n], "doc_id long, part string, mask int, n long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    r = filter_audit.cells(filter_audit.parity_sums(rows, labels)).first()
    assert list(r["all"]) == counts and set(r["good"]) == set(r["toxic"]) == {0}


# ---------------------------------------------------------------- quality rules


def base_of(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    where = {}
    for i in range(len(w) - 2):
        where.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p for at in where.values() if len(at) > 1 for i in at for p in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def verdict(t):
    """The default rules once more, in Python."""
    t = t or ""
    n, chars, symbols, dups, repeat = base_of(t)
    base = n < 50 or 100 * repeat > 50 * n
    lines = len([x for x in t.split("\n") if WORD.search(x)])
    upper, letters = sum(c.isupper() for c in t), sum(c.isalpha() for c in t)
    bad = (10 * symbols > n or chars > 12 * n or 2 * chars < 5 * n or (lines >= 4 and 2 * dups > lines) or 100 * repeat > 40 * n or 10 * upper > 4 * chars
           or 10 * letters < 6 * chars or 10 * len(re.findall("[!?]", t)) > 2 * n or (lines >= 4 and 10 * sum(x.endswith(("...", "…")) for x in t.split("\n")) > 3 * lines))
    return base, not base and not bad


def quality_texts():
    rnd = random.Random(4)
    vocab = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    make = lambda n, v=300: " ".join(rnd.choice(vocab[:v]) for _ in range(n))
    out = [make(rnd.choice([0, 3, 49, 50, 51, 80, 300]), rnd.choice([3, 8, 30, 300])) for _ in range(60)]
    prose = make(120)
    out += [prose, prose.upper(), prose.replace(" ", " | "), prose.replace(" ", "! "), prose.replace("word", "w0rd 12345 "), "\n".join([make(20)] * 3 + [make(20)]), prose + " " + prose]
    out += ["\n".join(make(15) + "..." for _ in range(5)), "x" * 4000, " ".join("x" for _ in range(90)), "\t".join("mmmmmmmmmmmmmmmm" + str(i) for i in range(60)), "é à ü" * 60, "a b c d e f a b c d", "a a a", "a a a a", None, "", " \n\t\n ", "nbsp x " * 30, make(30_000)]
    return out + [out[3]]


def test_quality_rules(spark):
    texts = quality_texts()
    rows = [(i if i else None, t, "s", 1, 2, i) for i, t in enumerate(texts)] + [(5, texts[5], "s", 1, 2, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, s string, p long, n_words long, w long").repartition(3)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    result = quality_rules.judge(docs)
    got = sorted((tuple(r) for r in result.select(*cols).collect()), key=str)
    assert got == sorted(((r[0], *base_of(r[1]), *verdict(r[1])) for r in rows), key=str)
    assert {r[-1] for r in got} == {True, False}
    assert result.where("kept and n_repeat_words >= 0").count() == sum(verdict(r[1])[1] for r in rows)  # filters on the result do no harm
    assert quality_rules.judge(docs.where("false")).collect() == []


def test_cascade_order():
    """By rejection per cost among what is left."""
    sets = {0b001: 50, 0b011: 30, 0b100: 10, 0: 10}
    assert [i for i, _ in quality_rules.order_rules([1.0, 1.0, 1.0], sets)] == [0, 2, 1]
    assert [i for i, _ in quality_rules.order_rules([100.0, 1.0, 1.0], sets)] == [1, 2, 0]
    assert quality_rules.order_rules([1.0, 2.0], {}) == [(0, 0.0), (1, 0.0)]
    assert [round(s, 3) for _, s in quality_rules.order_rules([1.0, 1.0, 1.0], sets)] == [0.8, 0.5, 0.0]


def test_cascade_stops_early(spark):
    """A rule that raises is never evaluated for rows that an earlier rule rejects; the verdict does not depend on the order."""
    rows = quality_rules.measured(spark.createDataFrame([(1, "short"), (2, "long " * 60)], "doc_id long, text string"))
    first = quality_rules.Rule("few", F.col("n_words") < 50)
    raises = quality_rules.Rule("raises", F.when(F.col("n_words") < 50, F.raise_error(F.lit("not reached")).cast("boolean")).otherwise(False))
    got = rows.select("doc_id", quality_rules.cascade([first, raises]).alias("r")).collect()
    assert sorted(map(tuple, got)) == [(1, "few"), (2, None)]
    rules = quality_rules.default_rules()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(quality_texts())], "doc_id long, text string")
    m = quality_rules.measured(docs)
    kept = [sorted(r[0] for r in m.where(quality_rules.cascade(rs).isNull()).select("doc_id").collect()) for rs in (rules, rules[::-1])]
    assert kept[0] == kept[1]


def test_quality_spares_good_documents(spark):
    """Of documents labelled good that pass the base rules hardly any goes; of labelled junk most does."""
    got = quality_rules.judge(spark.read.parquet(f"{DATA}/documents.parquet")).where("not base_failed").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id")
    n = {(r[0], r[1]): r[2] for r in got.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True]
    assert n.get((0, True), 0) <= 0.2 * (n.get((0, False), 0) + 1)


# ---------------------------------------------------------------- the queries


@pytest.mark.parametrize("name", ["op11_centroids", "op12_filter_audit", "op13_quality_rules"])
def test_query_against_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "labels", "embeddings"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = duck.sql(registry.ORACLE_SQL[name]).df()
    got = registry.QUERIES[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    plain = lambda df: sorted(map(str, df[cols].itertuples(index=False, name=None)))
    assert plain(got) == plain(want)
