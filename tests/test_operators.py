"""Operators without SQL: splits, proposals, discovery, review ranking, readers, streaming."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from marlstone.operators import discovery, review, splits
from marlstone.plans.compile import Catalog
from marlstone.plans.rules import AttrEqual, Doc, Label, Pattern, Predicate, Rule, Text
from marlstone.sources import readers
from marlstone.streaming import ingest


def test_split_counts_and_groups(spark):
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.floor(F.col("id") / 5).alias("g"))
    a = {r.doc_id: r.role for r in splits.hash_split(rows, "doc_id", (0.1, 0.1, 0.8)).collect()}
    b = {r.doc_id: r.role for r in splits.hash_split(rows.orderBy(F.desc("doc_id")), "doc_id", (0.1, 0.1, 0.8)).collect()}
    assert a == b and sorted(map([*a.values()].count, ("train", "dev", "test"))) == [10, 10, 80]
    key = lambda i: hashlib.sha256(f'["split","rows",0,"{i}"]'.encode()).hexdigest()
    assert {i for i, r in a.items() if r == "train"} == set(sorted(range(100), key=key)[:10])
    g = splits.hash_split(rows, "g", (0.1, 0.1, 0.8)).groupBy("g").agg(F.count_distinct("role").alias("n"))
    assert g.where("n > 1").count() == 0


def test_folds(spark):
    truth = spark.createDataFrame([(i, x) for i in range(40) for x in (("a",) if i % 2 else ("a", "b"))] + [(100, "rare"), (101, "rare")], "doc_id long, label string")
    rows = truth.select("doc_id").distinct().unionByName(spark.range(200, 205).select(F.col("id").alias("doc_id")))
    f = {r.doc_id: r.fold for r in splits.stratified_folds(truth, rows, 2).collect()}
    assert len(f) == 47 and f[100] != f[101]
    assert [sum(f[i] == k for i in range(40) if i % 2 == 0) for k in (0, 1)] == [10, 10]
    g = splits.group_folds(spark.range(30).select(F.col("id").alias("doc_id"), (F.col("id") % 10).alias("g")), "g", 3)
    assert g.groupBy("g").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert sorted(r.n for r in g.groupBy("fold").agg(F.count_distinct("g").alias("n")).collect()) == [3, 3, 4]


def test_samples(spark):
    t = spark.createDataFrame([(i, "a") for i in range(30)] + [(100, "b"), (101, "b")], "doc_id long, label string")
    got = {r.doc_id for r in splits.coverage_sample(t, 12, batch=4).collect()}
    assert {100, 101} <= got and len(got) == 12
    p = t.withColumn("p", F.lit(0.5))
    by = splits.dominant_sample(p, 16).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in by} == {"a": 15, "b": 1}


def test_proposals_follow_good_vectors():
    h = [((1, 0, 1), 1.0)] * 5 + [((0, 1, 0), 0.0)] * 15
    assert discovery.propose(h, 3) == (1, 0, 1)
    assert discovery.propose(h, 3) == discovery.propose(h, 3)


def rule(w, label):
    return Rule((Doc("x"), Text("x", Predicate("match", "cnt", Pattern(w)))), Label("x", label))


def test_admission_and_pruning(spark):
    docs = spark.createDataFrame([(i, "good" if i < 4 else "bad", "", "") for i in range(8)], "doc_id long, cnt string, ttl string, mtd string")
    cat = Catalog(docs, spark.createDataFrame([], "doc_id long, label string, sign int"))
    truth = docs.where("cnt = 'good'").select("doc_id", F.lit("L").alias("label"))
    labels = spark.createDataFrame([("L",)], "label string")
    rules = [rule("bad", "L"), rule("good", "L"), rule("goo", "L")]
    assert discovery.admit(cat, rules, [0.1, 0.9, 0.8], truth, labels) == [1]
    assert discovery.prune(cat, rules[:2], truth, labels) == [rules[1]]
    assert discovery.effective(cat, rules[:2], {"bad": [0], "good": [1]}) == {"bad": 4, "good": 4}


def test_review_ranking(spark):
    s = spark.createDataFrame([(i, float(i % 5)) for i in range(20)], "doc_id long, score double")
    got = review.rank_review(s, s.select("doc_id"), 10, audit=0.2).collect()
    assert len(got) == 10 and sum(r.reason == "audit" for r in got) == 2
    few = review.rank_review(s.limit(3), s.select("doc_id"), 10, audit=0.2).collect()
    assert len(few) == 10 and any(r.reason == "refill" for r in few)
    assert review.batch_size(10_000, 500, 90) == 90


def test_answers(spark, tmp_path):
    ok = {"row_id": "1", "labels": ["a", "b"], "targets": [1, None], "provider": "p", "provenance": "q"}
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "1.json").write_text(json.dumps(ok))
    assert [(r.row_id, r.label, r.sign) for r in readers.answers(spark, str(tmp_path / "ok"), ["a", "b"]).collect()] == [("1", "a", 1)]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "1.json").write_text(json.dumps(ok | {"labels": ["a", "z"]}))
    with pytest.raises(Exception, match="bad answer"):
        readers.answers(spark, str(tmp_path / "bad"), ["a", "b"]).collect()


def test_csv_json_and_xml(spark, tmp_path):
    (tmp_path / "a.csv").write_text('abstract,x,y\n"one, ""two""",1,0\nthree,1,1\n')
    docs, truth = readers.csv_documents(spark, str(tmp_path / "a.csv"), "abstract", ["x", "y"])
    assert {r.cnt for r in docs.collect()} == {'one, "two"', "three"} and truth.count() == 3
    (tmp_path / "same.csv").write_text("abstract,x\nsame,1\nsame,0\n")
    docs, truth = readers.csv_documents(spark, str(tmp_path / "same.csv"), "abstract", ["x"])
    assert docs.select("doc_id").distinct().count() == 2 and truth.count() == 1
    (tmp_path / "d.json").write_text(json.dumps({"row_id": "r", "text": "t", "metadata": {"title": "T", "b": " ", "a": "1"}, "source": "s"}))
    r = readers.json_documents(spark, str(tmp_path / "d.json")).first()
    assert (r.cnt, r.ttl, r.mtd) == ("t", "T", '{"a":"1","title":"T"}')
    (tmp_path / "b.xml").write_text("<books><book><title>A &amp; B</title></book><book><title>C</title></book></books>")
    assert [r.title for r in readers.xml_documents(spark, str(tmp_path / "b.xml"), ["title"], "book").collect()] == ["A & B", "C"]


def test_rules_file(spark, tmp_path):
    readers.write_rules(spark, str(tmp_path / "r"), ["L"], [rule("a", "L")])
    assert readers.read_rules(spark, str(tmp_path / "r")) == (["L"], [rule("a", "L")])


def test_stream(spark, tmp_path):
    """Rules that link documents fire across batches."""
    docs = spark.createDataFrame([(i, "good" if i == 1 else "bad", f"t{i % 2}", "") for i in range(6)], "doc_id long, cnt string, ttl string, mtd string")
    link = Rule((Doc("x"), Doc("y"), AttrEqual("x", "ttl", "y", "ttl"), Label("y", "L")), Label("x", "L"))
    gamma = spark.createDataFrame([], "doc_id long, label string, sign int")
    for part in ("doc_id < 3", "doc_id >= 3"):
        docs.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
        ingest.label_stream(stream, gamma, [rule("good", "L"), link], str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "out" / "facts")).collect()
    assert sorted((r.batch, r.doc_id) for r in rows) == [(0, 1), (1, 3), (1, 5)]


def test_materialise_and_truth(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "train"), (2, "b", "test"), (3, "b", "test")], "doc_id long, cnt string, role string")
    truth = spark.createDataFrame([(1, "L", 1), (2, "L", -1)], "doc_id long, label string, sign int")
    report = {r.role: (r.rows, r.repeated_text) for r in readers.materialise(rows, truth, ["L"], str(tmp_path / "m")).collect()}
    assert report == {"train": (1, 0), "test": (2, 1)} and spark.read.parquet(str(tmp_path / "m" / "truth")).where("role = 'test'").count() == 1
    for bad, t in ((rows.unionByName(rows), truth), (rows.withColumn("cnt", F.lit(" ")), truth), (rows, truth.withColumn("label", F.lit("other")))):
        with pytest.raises(ValueError):
            readers.materialise(bad, t, ["L"], str(tmp_path / "no"))
    readers.write_truth(truth, rows, ["L", "M"], str(tmp_path / "t"))
    assert {(r.doc_id, r.label, r.sign) for r in readers.read_truth(spark, str(tmp_path / "t"), ["L", "M"]).collect()} == {(1, "L", 1), (2, "L", -1)}
    with pytest.raises(Exception, match="bad truth cell"):
        readers.read_truth(spark, str(tmp_path / "t"), ["L"]).collect()
    got = readers.oracle_answers(truth, rows.where("doc_id < 3"), ["L", "M"], budget=5, spent=3)
    assert {(r.doc_id, r.label, r.sign) for r in got.collect()} == {(1, "L", 1), (1, "M", -1), (2, "L", -1), (2, "M", -1)}
    with pytest.raises(ValueError):
        readers.oracle_answers(truth, rows, ["L"], budget=5, spent=3)


def test_masks_match_each_pattern_once(spark):
    """Also where the text has the word only inside others, or not at all: the search before the match changes nothing."""
    import re

    from marlstone.functions.text import predicate
    from marlstone.operators.patterns import masks
    from marlstone.plans.rules import Pattern, Predicate
    from marlstone.registry import word

    raws = {"bounded": word("the"), "plain": Pattern("the"), "edges": Pattern(r"\bthe\b"), "case": Pattern("the", re.IGNORECASE), "other": Pattern("t.e"), "digit": Pattern(r"\d")}
    texts = ["the", "other", "a the b", "The end", "", None, "breathe the", "t1e", "_the", "the\n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, cnt string")
    m = masks(docs, "cnt", {k: predicate(Predicate("match", "cnt", p), F.col("cnt")) for k, p in raws.items()})
    want = {(i, k, 1) for i, t in enumerate(texts) if t for k, p in raws.items() if re.search(p.raw, t, re.I if k == "case" else 0)}
    assert {tuple(r) for r in m.collect()} == want
    assert m._jdf.queryExecution().optimizedPlan().toString().count("RLIKE") == len(raws)


def test_words_are_found_from_their_letters(spark):
    """A bounded word is matched from its first letter on, in the same texts as the pattern itself, whatever its classes."""
    import itertools
    import re

    from marlstone.functions.text import predicate
    from marlstone.operators.patterns import masks
    from marlstone.plans.rules import Pattern, Predicate
    from marlstone.registry import word

    raws = {"one": word("aa"), "two": Pattern("(^|[^a])aa([^b-]|$)"), "lines": Pattern("(^|[^A-Za-z0-9_])aa([^A-Za-z0-9_]|$)", re.MULTILINE), "left": Pattern("(^|[^b])aa"), "case": Pattern("(^|[^a])aa([^b]|$)", re.IGNORECASE)}
    texts = ["".join(x) for n in range(6) for x in itertools.product("ab-\n", repeat=n)] + ["aa", "\U0001f600aa", "aa\U0001f600", "\u00e9aa\u00e9", "aa\r\n", "aaa aa", "AA"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, cnt string")
    m = masks(docs, "cnt", {k: predicate(Predicate("match", "cnt", p), F.col("cnt")) for k, p in raws.items()})
    assert {tuple(r) for r in m.collect()} == {(i, k, 1) for i, t in enumerate(texts) if t for k, p in raws.items() if re.search(p.raw, t, p.flags)}
    assert "aa(?<!" in str(predicate(Predicate("match", "cnt", raws["one"]), F.col("cnt"))) and raws["left"].word() is None and raws["case"].word() is None


def test_pairs_of_a_large_group_are_made_by_many_tasks(spark):
    from marlstone.operators.joins import attribute_pairs

    ids = [*range(600), 7, 7, None]
    docs = spark.createDataFrame([(i, "same", "") for i in ids] + [(1000, "a", "same"), (1001, "b", "a"), (1002, None, "b"), (1003, "", "")], "doc_id long, ttl string, cnt string")
    pairs = lambda df: sorted(map(str, df.collect()))
    ok = [r for r in docs.collect() if r.ttl]
    got = attribute_pairs(docs, [("ttl", "ttl")], most=50)
    assert pairs(got.select("x", "y")) == sorted(f"Row(x={a.doc_id}, y={b.doc_id})" for a in ok for b in ok if a.ttl == b.ttl)
    each = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(each) > 5 and max(each) < sum(each) / 3
    want = sorted(f"Row(x={a.doc_id}, y={b.doc_id})" for a in ok for b in docs.collect() if b.cnt and a.ttl == b.cnt)
    assert len(want) == 605 and pairs(attribute_pairs(docs, [("ttl", "cnt")], most=50)) == want


def test_labels_are_carried_without_pairs(spark, monkeypatch):
    """Along a chain of 100, where several ways lead in, and round a cycle; the closure, which has the pairs, is never made."""
    from marlstone.operators import relations

    want = relations.copy_labels
    graphs = {"chain": [(i, i + 1) for i in range(100)], "ways": [(1, 3), (2, 3), (3, 4), (4, 5), (9, 5), (5, 5)], "cycle": [(1, 2), (2, 3), (3, 1), (3, 4)]}
    facts = spark.createDataFrame([(1, "a", 1), (2, "b", 1), (9, "a", 1), (3, "b", -1), (77, "c", 1)], "doc_id long, label string, sign int")
    frames = {k: spark.createDataFrame([(*e, False) for e in g], "src long, dst long, strict boolean") for k, g in graphs.items()}
    closed = {k: {tuple(r) for r in want(facts, relations.close(e)).collect()} for k, e in frames.items()}
    monkeypatch.setattr(relations, "close", None)
    for k, e in frames.items():
        got = [tuple(r) for r in relations.carry(facts, e).collect()]
        assert len(got) == len(set(got)) and set(got) == closed[k]


def test_empty_and_null_texts_are_not_copies(spark, tmp_path):
    from marlstone import registry_learning  # noqa: F401  it registers the query
    from marlstone.operators import joins
    from marlstone.registry import QUERIES

    spark.createDataFrame([(1, "x"), (2, "x"), (3, ""), (4, ""), (5, None), (6, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id for r in QUERIES["equal_component_copy"](spark, str(tmp_path)).collect() if r.label == "quality"}
    assert got == {1, 2, 3, 5}
    edges = spark.createDataFrame([(4, 3), (3, 9), (7, 8), (5, 5)], "src long, dst long")
    assert {tuple(r) for r in joins.equal_components(edges).collect()} == {(3, 3), (4, 3), (9, 3), (7, 7), (8, 7), (5, 5)}


def test_neighbours_over_many_slices(spark):
    """1,000 queries and vectors with many ties: a task goes through its rows some 500 at a time and keeps the k best across them."""
    import numpy as np

    from marlstone.operators import joins

    v = np.random.default_rng(0).integers(-2, 3, (1000, 4)).astype(float)
    df = spark.createDataFrame([(i, x.tolist(), str(i % 3)) for i, x in enumerate(v)], "id long, e array<double>, scope string")
    unit = joins.unit_vectors(df, "id", "e").join(df.select("id", "scope"), "id").repartition(2)
    n = np.linalg.norm(v, axis=1, keepdims=True)
    u = v / np.where(n > 0, n, 1)
    sims = np.round(u @ u.T, 9)
    sims[np.arange(1000)[:, None] % 3 != np.arange(1000) % 3] = -2
    np.fill_diagonal(sims, -2)
    want = {(i, int(j)) for i in range(1000) for j in np.lexsort((np.arange(1000), -sims[i]))[:4]}
    assert {(r.x, r.y) for r in joins.top_k(unit, unit, 4).collect()} == want
    assert {(r.x, r.sources) for r in joins.similarity_quorum(unit, unit, 0.9, 2).collect()} == {(i, int(c)) for i, c in enumerate((sims >= 0.9).sum(1)) if c >= 2}


def test_nearest_of_all_vectors(spark):
    """Without queries every vector is one, in blocks that meet in pairs: copies (ties to the smaller id), a zero vector, and scopes."""
    import numpy as np

    from marlstone.operators import joins

    rnd, n = np.random.default_rng(4), 400
    v = rnd.standard_normal((n, 8)).astype(np.float32)
    v[::4], v[7] = v[0], 0
    rows = spark.createDataFrame([(int(i) * 3 - 50, v[i].tolist(), str(i % 3)) for i in rnd.permutation(n)], "id long, e array<float>, scope string")
    unit = joins.unit_vectors(rows, "id", "e")
    w = v.astype(float) / np.maximum(np.sqrt((v.astype(float) ** 2).sum(1, keepdims=True)), 1e-30)
    sims = w @ w.T
    np.fill_diagonal(sims, -2)

    def best(sims):
        return {(i * 3 - 50, int(j) * 3 - 50) for i in range(n) for j in np.lexsort((np.arange(n), -np.round(sims[i], 9)))[:5]}

    want = best(sims)
    for most in (30, 5000):
        found = [(r.x, r.y) for r in joins._all_nearest(unit, -1.0, 5, most).collect()]
        assert len(found) == len(set(found)) and want <= set(found)
    near = joins.top_k(unit, None, 5).collect()
    assert {(r.x, r.y) for r in near} == want and len(near) == len(want)
    assert max(abs(r.sim - sims[(r.x + 50) // 3, (r.y + 50) // 3]) for r in near) < 1e-12
    assert {(r.x, r.y) for r in joins.top_k(unit, None, 5, "mutual").collect()} == {(x, y) for x, y in want if (y, x) in want}
    assert {(r.x, r.y) for r in joins.top_k(unit, None, 5, "symmetric_union").collect()} == want | {(y, x) for x, y in want}
    sims[np.arange(n)[:, None] % 3 != np.arange(n) % 3] = -2
    assert {(r.x, r.y) for r in joins.top_k(unit.join(rows.select("id", "scope"), "id"), None, 5).collect()} == best(sims)
    assert joins.top_k(unit.where("false"), None, 5).count() == 0


def test_knn_mutual_reads_all_vectors(spark):
    """A pair is mutual from either side, so it is there from both."""
    from marlstone import registry

    got = {(r.x, r.y) for r in registry.QUERIES["knn_mutual"](spark, "/root/testdata/sf0.001").collect()}
    assert got and got == {(y, x) for x, y in got}


def test_knn_sources_reads_all_vectors(spark):
    """Documents that are not divisible by 100 have neighbours with labels too."""
    from marlstone import registry, registry_learning  # noqa: F401  registers the query

    ids = {r.doc_id for r in registry.QUERIES["knn_sources"](spark, "/root/testdata/sf0.001").collect()}
    assert any(i % 100 for i in ids)


def test_knn_union_reads_all_vectors(spark):
    """Every vector has its own nearest among the links, in both directions."""
    from marlstone import registry

    d = "/root/testdata/sf0.001"
    got = {(r.x, r.y) for r in registry.QUERIES["knn_union"](spark, d).collect()}
    ids = {r.vec_id for r in registry.read(spark, d, "embeddings").collect()}
    assert got == {(y, x) for x, y in got} and all(sum(x == i for x, _ in got) >= 5 for i in ids)


def test_long_chains_are_infeasible_whatever_their_size(spark):
    """A chain of more edges than a group may have is told by its length; short ones and a loose chain are decided as before."""
    from marlstone.operators import relations

    edges = [(i, i + 1, True) for i in range(60)] + [(100, 101, True), (101, 102, True)] + [(200, 201, True), (201, 202, False), (202, 203, True), (203, 204, True)]
    edges += [(300, 301, True), (301, 300, False)] + [(400, 400, True), (500, 501, False)]
    e = spark.createDataFrame(edges, "src long, dst long, strict boolean")
    none = spark.createDataFrame([], "doc_id long, label string, sign int")
    got = {r.v for r in relations.infeasible(e, none, ("a", "b"), most_edges=10).collect()}
    assert got == {*range(61), *range(200, 205), 300, 301, 400}
    assert {r.v for r in relations.infeasible(e.where("src >= 100 and src < 300"), none, ("a", "b", "c")).collect()} == set()


def test_given_conflict_is_found_without_the_closure(spark, monkeypatch):
    from marlstone.operators import closure
    from marlstone.plans import relation

    monkeypatch.setattr(relation, "close", None)
    docs = spark.createDataFrame([(i, "x", "x", "") for i in range(4)], "doc_id long, cnt string, ttl string, mtd string")
    gamma = spark.createDataFrame([(0, "a", 1), (1, "a", -1)], "doc_id long, label string, sign int")
    chain = spark.createDataFrame([(0, 1, True), (1, 2, True), (2, 3, True)], "src long, dst long, strict boolean")
    assert closure.close_program(Catalog(docs, gamma, None, chain, ("a", "b")), []).status == "conflict"
