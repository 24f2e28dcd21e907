"""More queries with their SQL: incremental closures and proofs, discovery, the labeling loop, models and joins with options."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.models import Registry
from marlstone.operators import joins, loop, metrics, patterns, proof, quality, relations, selection
from marlstone.operators.closure import close_program, extend, withdraw
from marlstone.operators.session import Session, prove
from marlstone.plans.rules import ML, AttrEqual, Doc, Label, Rule, Text
from marlstone.registry import GRID, LABELS, axis_of, catalog, docs_of, gamma_of, has, pred_of, prob_of, query, read, scores_of, truth_of
from marlstone.registry import _copies, _hits, _next, _pn

# --- closures that change -----------------------------------------------------------------------------------------

_copy_ttl = Rule((Doc("x"), Doc("y"), AttrEqual("x", "ttl", "y", "ttl"), Label("y", "good")), Label("x", "good"))
_by_model = Rule((Doc("x"), ML("x", "m1", "quality", 0.7)), Label("x", "good"))
_good = "r AS (SELECT doc_id FROM ({0}) UNION SELECT a.doc_id FROM r JOIN docs b ON b.doc_id = r.doc_id JOIN docs a ON a.ttl = b.ttl AND a.ttl <> '')"
_q = "SELECT doc_id FROM prob WHERE label = 'quality' AND alias = '{0}' AND p >= 0.7"


def _no_roots(spark, d):
    return catalog(spark, d, gamma_of(spark, d).where("false"))


def _as_model(cat, alias):
    """The catalog with the probabilities of another model under the name m1."""
    return replace(cat, model_prob=cat.model_prob.where(F.col("alias") == alias).withColumn("alias", F.lit("m1")))


@query("delta_withdraw", "SELECT doc_id, 'good' AS label, 1 AS sign FROM r", recursive=_good.format(_q.format("m2")))
def delta_withdraw(spark, d):
    cat, rules = _no_roots(spark, d), [_by_model, _copy_ttl]
    before = close_program(_as_model(cat, "m1"), rules)
    return withdraw(_as_model(cat, "m1"), _as_model(cat, "m2"), rules, before).facts


@query("candidate_extension", "SELECT doc_id, 'good' AS label, 1 AS sign FROM r", recursive=_good.format(_q.format("m1") + f" UNION SELECT doc_id FROM docs WHERE {_pn[1]}"))
def candidate_extension(spark, d):
    cat, rules = _no_roots(spark, d), [_by_model, _copy_ttl]
    return extend(cat, rules, close_program(cat, rules), Rule((Doc("x"), Text("x", has("worthless"))), Label("x", "good"))).facts


@query("prefix_reuse", "SELECT doc_id, 'good' AS label, 1 AS sign FROM r UNION ALL SELECT doc_id, 'best', 1 FROM r", recursive=_good.format(_q.format("m1")))
def prefix_reuse(spark, d):
    session = Session(_no_roots(spark, d))
    session.close([_by_model, _copy_ttl])
    return session.close([_by_model, _copy_ttl, Rule((Doc("x"), Label("x", "good")), Label("x", "best"))]).facts


@query("proof_rows", f"WITH m AS ({_q.format('m1')}) SELECT doc_id, 'good' AS label, 1 AS sign, 0 AS rule_id, 0::BIGINT AS premises, true AS holds FROM m UNION ALL SELECT doc_id, 'good', 1, 1, 1, true FROM docs WHERE ttl <> '' AND doc_id NOT IN (SELECT doc_id FROM m) AND ttl IN (SELECT ttl FROM docs JOIN m USING (doc_id))")
def proof_rows(spark, d):
    cat, rules = _no_roots(spark, d), [_by_model, _copy_ttl]
    c = close_program(cat, rules)
    rows = proof.holds(proof.proof_rows(cat, rules, c), c.facts)
    return rows.select("doc_id", "label", "sign", "rule_id", F.size("premises").cast("long").alias("premises"), F.col("valid").alias("holds"))


@query("conflict_certificate", f"WITH c AS (SELECT doc_id FROM docs WHERE {_pn[0]} AND {_pn[1]}) SELECT doc_id, 'quality' AS label, -1 AS sign, 1 AS rule_id, 0::BIGINT AS premises FROM c UNION ALL SELECT doc_id, 'quality', 1, 2, 1 FROM c UNION ALL SELECT doc_id, 'start', 1, 0, 0 FROM c")
def conflict_certificate(spark, d):
    rules = [Rule((Doc("x"), Text("x", has("the"))), Label("x", "start")), Rule((Doc("x"), Text("x", has("worthless"))), Label("x", "quality", "neg")), Rule((Doc("x"), Label("x", "start")), Label("x", "quality"))]
    cat = _no_roots(spark, d)
    c = close_program(cat, rules, "retain")
    # The retaining policy drops both signs of a clash from the facts; what fired is still recorded.
    rows = proof.certificate(proof.proof_rows(cat, rules, c), c.unknown)
    return rows.select("doc_id", "label", "sign", "rule_id", F.size("premises").cast("long").alias("premises"))


@query("no_witness", "SELECT src, dst FROM (SELECT s_suppkey AS src, s_suppkey + 1 AS dst FROM supplier) e WHERE (SELECT count(DISTINCT label) FROM gamma g WHERE (g.doc_id = e.src AND g.sign = 1) OR (g.doc_id = e.dst AND g.sign = -1)) >= 2")
def no_witness(spark, d):
    k = F.col("s_suppkey").cast("long")
    edges = read(spark, d, "supplier").select(k.alias("src"), (k + 1).alias("dst"), F.lit(True).alias("strict"))
    return relations.no_witness(edges, gamma_of(spark, d), len(LABELS))


@query("strict_closure_status", f"SELECT count(*) > 0 AS conflict FROM ({_next}) e WHERE (SELECT count(DISTINCT label) FROM gamma g WHERE (g.doc_id = e.src AND g.sign = 1) OR (g.doc_id = e.dst AND g.sign = -1)) >= 2 OR EXISTS (SELECT 1 FROM gamma a JOIN gamma b ON a.label = b.label AND a.sign = 1 AND b.sign = -1 WHERE a.doc_id = e.src AND b.doc_id = e.dst)")
def strict_closure_status(spark, d):
    cat = replace(catalog(spark, d), relations=_copies(spark, d, True), labels=LABELS)
    return spark.createDataFrame([(close_program(cat, []).status == "conflict",)], "conflict boolean")


@query("equal_component_copy", "SELECT DISTINCT b.doc_id, g.label, 1 AS sign FROM truth g JOIN docs a ON a.doc_id = g.doc_id JOIN docs b ON b.cnt = a.cnt AND a.cnt <> '' UNION SELECT doc_id, label, sign FROM gamma")
def equal_component_copy(spark, d):
    texts = read(spark, d, "documents").where("text <> ''").select("doc_id", F.sha2("text", 256).alias("h"))
    first = texts.groupBy("h").agg(F.min("doc_id").alias("src"))
    equal = texts.join(first, "h").select("src", F.col("doc_id").alias("dst")).where("src <> dst")
    return joins.copy_equal(gamma_of(spark, d), joins.equal_components(equal))


@query("final_proof", "SELECT 'fixpoint' AS status, 0::BIGINT AS only_kept, 0::BIGINT AS only_again, (SELECT count(*) FROM r) AS same, true AS equal", recursive=_good.format(_q.format("m1")))
def final_proof(spark, d):
    cat, rules = _no_roots(spark, d), [_by_model, _copy_ttl]
    r = prove(cat, rules, close_program(cat, rules))
    return spark.createDataFrame([tuple(r.values())], "status string, only_kept long, only_again long, same long, equal boolean")


# --- quality ------------------------------------------------------------------------------------------------------


@query("precision_recall", "SELECT label, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp)::DOUBLE END, 9)::DOUBLE AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn)::DOUBLE END, 9)::DOUBLE AS recall FROM per_label")
def precision_recall(spark, d):
    c = metrics.confusion(pred_of(spark, d), truth_of(spark, d), axis_of(spark))
    return quality.precision_recall(c).select("label", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


_obs = "o AS (SELECT g.doc_id, g.label, g.sign, p.p >= 0.5 AS yes FROM gamma g JOIN prob p ON p.doc_id = g.doc_id AND p.label = g.label AND p.alias = 'm2')"


@query("observed_quality", f"WITH {_obs}, n AS (SELECT label, count(*) FILTER (WHERE yes AND sign = 1) AS tp, count(*) FILTER (WHERE yes AND sign = -1) AS fp, count(*) FILTER (WHERE NOT yes AND sign = 1) AS fn FROM o GROUP BY 1) SELECT round(avg(2.0 * tp / (2 * tp + fp + fn)), 9)::DOUBLE AS macro_f1, round(2.0 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9)::DOUBLE AS micro_f1, (SELECT count(*) FROM gamma) AS cells, (SELECT round(avg(c), 9)::DOUBLE FROM (SELECT avg(yes::INT) AS c FROM o WHERE sign = 1 GROUP BY doc_id HAVING count(*) > 1)) AS completeness FROM n")
def observed_quality(spark, d):
    pred = prob_of(spark, d).where("alias = 'm2' and p >= 0.5").select("doc_id", "label")
    q = quality.observed_quality(pred, gamma_of(spark, d), axis_of(spark))
    return q.select(F.round("macro_f1", 9).alias("macro_f1"), F.round("micro_f1", 9).alias("micro_f1"), "cells", F.round("completeness", 9).alias("completeness"))


@query("label_cardinality", "SELECT count(*) AS rows, round(avg(quality + toxic), 9)::DOUBLE AS cardinality FROM labels")
def label_cardinality(spark, d):
    return quality.label_cardinality(gamma_of(spark, d), axis_of(spark), read(spark, d, "documents")).withColumn("cardinality", F.round("cardinality", 9))


@query("fit_precision_gate", "SELECT pattern, count(*) FILTER (WHERE g.sign = 1) AS agreements, count(*) FILTER (WHERE g.sign = -1) AS blocked, count(g.sign) = 0 OR count(*) FILTER (WHERE g.sign = 1) >= 0.2 * count(g.sign) AS passes FROM hits h LEFT JOIN gamma g ON g.doc_id = h.doc_id AND g.label = 'toxic' GROUP BY 1")
def fit_precision_gate(spark, d):
    c = _hits(spark, d).select(F.col("pattern").alias("rule_id"), "doc_id", F.lit("toxic").alias("label"), F.lit(1).alias("sign"))
    return quality.precision_gate(c, gamma_of(spark, d), 0.2).withColumnRenamed("rule_id", "pattern")


_u = "u AS (SELECT doc_id, alias, 1 - avg(e) AS u FROM (SELECT p.doc_id, p.alias, g.sign, avg(power(p.p - (g.sign = 1)::INT, 2)) AS e FROM prob p JOIN gamma g ON g.doc_id = p.doc_id AND g.label = p.label GROUP BY 1, 2, 3) GROUP BY 1, 2)"


def _utility(spark, d):
    target = gamma_of(spark, d).select("doc_id", "label", (F.col("sign") == 1).cast("int").alias("target"))
    return quality.balanced_utility(prob_of(spark, d).join(target, ["doc_id", "label"]))


def _clusters(spark, d):
    return docs_of(spark, d).select("doc_id", F.col("mtd_lang").alias("cluster"))


@query("model_utility", f"WITH {_u} SELECT doc_id, alias, round(u, 9) AS u FROM u")
def model_utility(spark, d):
    return _utility(spark, d).withColumn("u", F.round("u", 9))


@query("relative_utility", f"WITH {_u} SELECT doc_id, alias, round(u - avg(u) OVER (PARTITION BY doc_id), 9) + 0 AS u FROM u")
def relative_utility(spark, d):
    return quality.relative_utility(_utility(spark, d)).withColumn("u", F.round("u", 9) + 0)


@query("candidate_votes", f"WITH {_u}, v AS (SELECT lang AS cluster, alias, count(*) AS votes FROM (SELECT doc_id, alias, row_number() OVER (PARTITION BY doc_id ORDER BY round(u, 9) DESC, alias) AS r FROM u) JOIN documents USING (doc_id) WHERE r <= 2 GROUP BY 1, 2) SELECT cluster, alias, votes, place FROM (SELECT c.lang AS cluster, a.alias, coalesce(votes, 0) AS votes, row_number() OVER (PARTITION BY c.lang ORDER BY coalesce(votes, 0) DESC, a.alias)::INT AS place FROM (SELECT DISTINCT lang FROM documents) c CROSS JOIN (SELECT DISTINCT alias FROM prob) a LEFT JOIN v ON v.cluster = c.lang AND v.alias = a.alias) WHERE place <= 2")
def candidate_votes(spark, d):
    return selection.candidate_votes(_utility(spark, d).withColumn("u", F.round("u", 9)), _clusters(spark, d), 2)


@query("static_quality", f"WITH {_u} SELECT d.doc_id, m.alias, round(m.q, 9) AS q FROM documents d JOIN (SELECT lang, alias, avg(u) AS q FROM u JOIN documents USING (doc_id) GROUP BY 1, 2) m ON m.lang = d.lang")
def static_quality(spark, d):
    return quality.static_quality(_utility(spark, d), _clusters(spark, d), read(spark, d, "labels")).withColumn("q", F.round("q", 9))


@query("vote_oracle", "WITH v AS (SELECT p.doc_id, p.label, p.alias, p.p >= 0.5 AS yes, t.doc_id IS NOT NULL AS t FROM prob p LEFT JOIN truth t ON t.doc_id = p.doc_id AND t.label = p.label), s AS (SELECT a.doc_id, a.alias || ',' || b.alias AS models, sum(((a.yes AND b.yes) = a.t)::INT) AS correct FROM v a JOIN v b ON a.doc_id = b.doc_id AND a.label = b.label AND a.alias < b.alias GROUP BY 1, 2) SELECT doc_id, models, correct::BIGINT AS correct FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY correct DESC, models) AS r FROM s) WHERE r = 1")
def vote_oracle(spark, d):
    votes = prob_of(spark, d).withColumn("vote", F.col("p") >= 0.5)
    return selection.vote_oracle(votes, truth_of(spark, d), 2).withColumn("models", F.array_join("models", ","))


@query("pseudo_labels", "SELECT doc_id, label, (p >= 0.9)::INT AS target, round(CASE WHEN p >= 0.9 THEN p ELSE 1 - p END, 9) AS weight FROM prob WHERE alias = 'm1' AND (p >= 0.9 OR p <= 0.1)")
def pseudo_labels(spark, d):
    return quality.pseudo_labels(prob_of(spark, d).where("alias = 'm1'"), 0.1, 0.9).withColumn("weight", F.round("weight", 9))


@query("weighted_bce", "SELECT label, round(-avg(CASE WHEN target = 1 THEN ln(greatest(p, 1e-7)) ELSE ln(1 - least(p, 1 - 1e-7)) END), 6) AS loss FROM scores GROUP BY 1")
def weighted_bce(spark, d):
    return quality.weighted_bce(scores_of(spark, d).withColumn("weight", F.lit(1.0))).withColumn("loss", F.round("loss", 6))


@query("repeat_statistics", "SELECT event_type AS variant, 'value' AS metric, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1")
def repeat_statistics(spark, d):
    m = read(spark, d, "events").select(F.col("event_type").alias("variant"), F.col("event_id").alias("run"), F.lit("value").alias("metric"), "value")
    return quality.repeats(m).withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query("independent_rows", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') NOT IN (SELECT regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))")
def independent_rows(spark, d):
    docs, l = read(spark, d, "documents").select("doc_id", "text"), read(spark, d, "labels").select("doc_id")
    return quality.independent_rows(docs.join(l, "doc_id", "left_semi"), docs.join(l, "doc_id", "left_anti")).select("doc_id")


# --- discovery ----------------------------------------------------------------------------------------------------


@query("fit_label_assignment", "WITH o AS (SELECT h.pattern, a.label, count(t.doc_id) AS a, count(*) - count(t.doc_id) AS b FROM hits h JOIN labels l USING (doc_id) CROSS JOIN axis a LEFT JOIN pred p ON p.doc_id = h.doc_id AND p.label = a.label LEFT JOIN truth t ON t.doc_id = h.doc_id AND t.label = a.label WHERE p.doc_id IS NULL GROUP BY 1, 2) SELECT pattern, o.label, round(2.0 * (tp + a) / (2 * tp + fp + fn + a + b) - 2.0 * tp / (2 * tp + fp + fn), 9)::DOUBLE AS gain FROM o JOIN per_label l ON l.label = o.label WHERE 2.0 * (tp + a) / (2 * tp + fp + fn + a + b) - 2.0 * tp / (2 * tp + fp + fn) > 1e-12")
def fit_label_assignment(spark, d):
    return selection.assign_labels(_hits(spark, d), pred_of(spark, d), truth_of(spark, d), read(spark, d, "labels"), axis_of(spark), 1e-12).withColumn("gain", F.round("gain", 9))


@query("instance_expansion", "SELECT pattern, op, eta::INT AS eta FROM (SELECT pattern, unnest(range(n + 2)) AS eta FROM (SELECT 'the' AS pattern, max(len(regexp_extract_all(text, 'the'))) AS n FROM documents UNION ALL SELECT 'and', max(len(regexp_extract_all(text, 'and'))) FROM documents)) CROSS JOIN (SELECT unnest(['==', '!=', '<', '<=', '>', '>=']) AS op)")
def instance_expansion(spark, d):
    ps = {w: F.regexp_count("cnt", F.lit(w)) for w in ("the", "and")}
    return selection.expand(patterns.masks(docs_of(spark, d), "cnt", ps))


@query("greedy_patterns")
def greedy_patterns(spark, d):
    got = selection.greedy_patterns(_hits(spark, d), truth_of(spark, d), read(spark, d, "labels"), axis_of(spark), 3)
    return spark.createDataFrame([(i, *g) for i, g in enumerate(got)], "step int, pattern string, label string, macro_f1 double")


@query("balanced_greedy")
def balanced_greedy(spark, d):
    got = selection.balanced_greedy(_hits(spark, d), truth_of(spark, d), read(spark, d, "labels"), 4)
    return spark.createDataFrame([(i, *g) for i, g in enumerate(got)], "step int, pattern string, label string")


_mi_cells = " + ".join(
    f"CASE WHEN {j} <= 0 THEN 0 ELSE {j}::DOUBLE / n * ln({j}::DOUBLE * n / (({x})::DOUBLE * ({y}))) END"
    for j, x, y in (("tp", "s", "pos"), ("(s - tp)", "s", "n - pos"), ("(pos - tp)", "n - s", "pos"), ("(n - s - pos + tp)", "n - s", "n - pos")))


@query("capped_information", f"WITH i AS (SELECT pattern, label, s, round(greatest({_mi_cells}, 0.0), 12) AS mi FROM cont), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY mi DESC, s DESC, pattern) AS r FROM i), w AS (SELECT pattern, label, r, mi FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY label, r) AS k FROM r WHERE mi > 0 AND r <= 2) WHERE k = 1), b AS (SELECT pattern, mi, s FROM (SELECT *, row_number() OVER (PARTITION BY pattern ORDER BY mi DESC, s DESC) AS k FROM i) WHERE k = 1), l AS (SELECT b.pattern, CASE WHEN length(b.pattern) > 4 THEN 'long' ELSE 'short' END AS family, w.label, coalesce(w.mi, b.mi) AS mi, row_number() OVER (ORDER BY w.label IS NULL, w.label, w.r, b.mi DESC, b.s DESC, b.pattern) AS k FROM b LEFT JOIN w ON w.pattern = b.pattern), f AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY k) AS c FROM l) SELECT CAST(row_number() OVER (ORDER BY k) AS INTEGER) AS place, pattern, label, round(mi, 9) AS mi FROM (SELECT * FROM f WHERE c <= 2 ORDER BY k LIMIT 4)")
def capped_information(spark, d):
    hits = _hits(spark, d)
    families = hits.select("pattern").distinct().withColumn("family", F.when(F.length("pattern") > 4, "long").otherwise("short"))
    got = selection.capped_information(hits, families, truth_of(spark, d), read(spark, d, "labels"), 4)
    return got.select("place", "pattern", "label", F.round("mi", 9).alias("mi"))


_f8 = "(0.8 * avg(CASE WHEN 2 * {0}tp + {0}fp + {0}fn = 0 THEN 0 ELSE 2.0 * {0}tp / (2 * {0}tp + {0}fp + {0}fn) END) + 0.2 * 2.0 * sum({0}tp) / (2 * sum({0}tp) + sum({0}fp) + sum({0}fn)))"


@query("fold_gain", "WITH c AS (SELECT g.doc_id % 3 AS fold, g.label, g.sign = 1 AS t, p1.p >= 0.5 AS b, p2.p >= 0.5 AS a FROM gamma g JOIN prob p1 ON p1.doc_id = g.doc_id AND p1.label = g.label AND p1.alias = 'm1' JOIN prob p2 ON p2.doc_id = g.doc_id AND p2.label = g.label AND p2.alias = 'm2'), n AS (SELECT fold, label, count(*) FILTER (WHERE a AND t) AS atp, count(*) FILTER (WHERE a AND NOT t) AS afp, count(*) FILTER (WHERE NOT a AND t) AS afn, count(*) FILTER (WHERE b AND t) AS btp, count(*) FILTER (WHERE b AND NOT t) AS bfp, count(*) FILTER (WHERE NOT b AND t) AS bfn FROM c GROUP BY 1, 2), w AS (SELECT label, sum(atp) AS atp, sum(afp) AS afp, sum(afn) AS afn, sum(btp) AS btp, sum(bfp) AS bfp, sum(bfn) AS bfn FROM n GROUP BY 1), f AS (SELECT fold, " + _f8.format("a") + " - " + _f8.format("b") + " AS d FROM n GROUP BY 1), o AS (SELECT " + _f8.format("a") + " - " + _f8.format("b") + " AS gain FROM w) SELECT round(gain, 9)::DOUBLE AS gain, round(avg(d), 9)::DOUBLE AS mean, round(stddev_pop(d), 9)::DOUBLE AS std, round(gain + 0.25 * (avg(d) - 0.25 * stddev_pop(d)), 9)::DOUBLE AS objective FROM f CROSS JOIN o GROUP BY gain")
def fold_gain(spark, d):
    l = read(spark, d, "labels")
    after = prob_of(spark, d).where("alias = 'm2' and p >= 0.5").join(l.select("doc_id"), "doc_id", "left_semi").select("doc_id", "label")
    g = selection.fold_gain(pred_of(spark, d), after, truth_of(spark, d), axis_of(spark), l.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("fold")))
    return g.select(*[F.round(c, 9).alias(c) for c in g.columns])


@query("mask_bits", "SELECT pattern, count(DISTINCT doc_id)::BIGINT AS bits FROM hits GROUP BY 1")
def mask_bits(spark, d):
    return patterns.mask_bits(_hits(spark, d)).groupBy("pattern").agg(F.sum(F.bitmap_count("bits")).alias("bits"))


@query("literal_counts", "SELECT doc_id, len([x FOR x IN regexp_extract_all(cnt, '[A-Za-z0-9_]+') IF x IN ('the', 'and')])::BIGINT AS n FROM docs")
def literal_counts(spark, d):
    return docs_of(spark, d).select("doc_id", T.literal_count(F.col("cnt"), ("the", "and")).alias("n"))


@query("term_offsets")
def term_offsets(spark, d):
    return docs_of(spark, d).select("doc_id", F.explode(T.term_offsets(F.col("ttl"))).alias("t")).select("doc_id", "t.*")


# --- joins with options -------------------------------------------------------------------------------------------

_c9 = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9)"


def _scoped(spark, d):
    e = read(spark, d, "embeddings")
    v = joins.unit_vectors(e, "vec_id", "embedding").join(e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("scope")), "id")
    return v, v.where("id % 100 = 0")


_scope_sql = f"SELECT x, y FROM (SELECT a.vec_id AS x, b.vec_id AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_c9} DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label = b.label WHERE a.vec_id % 100 = 0) WHERE r <= 5"


@query("knn_scope", _scope_sql)
def knn_scope(spark, d):
    return joins.top_k(*_scoped(spark, d), 5).select("x", "y")


_all_scope_sql = _scope_sql.replace(" WHERE a.vec_id % 100 = 0", "")  # of every vector


@query("knn_sources", f"SELECT x AS doc_id, label, count(*) AS sources FROM ({_all_scope_sql}) e JOIN (SELECT doc_id, label FROM truth) g ON g.doc_id = e.y GROUP BY 1, 2")
def knn_sources(spark, d):
    v, _ = _scoped(spark, d)
    edges = joins.top_k(v, None, 5)
    return joins.neighbour_sources(edges, gamma_of(spark, d), gamma_of(spark, d), "anchored_recursive", 1, 1)


def _sentences(spark, d):
    """Each ten vectors are the sentences of one document; the first vectors of two documents are the patterns."""
    v = joins.unit_vectors(read(spark, d, "embeddings"), "vec_id", "embedding")
    s = v.select(F.floor(F.col("id") / 10).alias("doc_id"), (F.col("id") % 10).alias("place"), "v")
    return s, v.where("id in (0, 11)").select(F.when(F.col("id") == 0, "a").otherwise("b").alias("pattern"), "v")


_sim = "WITH s AS (SELECT b.vec_id // 10 AS doc_id, CASE a.vec_id WHEN 0 THEN 'a' ELSE 'b' END AS pattern, count(*) AS n, min(b.vec_id % 10) AS first FROM embeddings a JOIN embeddings b ON round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) >= 0.1 WHERE a.vec_id IN (0, 11) GROUP BY 1, 2)"


@query("sim_frequency", _sim + " SELECT doc_id, pattern, n, first FROM s WHERE n >= 2")
def sim_frequency(spark, d):
    return joins.sentence_hits(*_sentences(spark, d), 0.1).where("n >= 2")


@query("sim_before", _sim + " SELECT a.doc_id FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.pattern = 'a' AND b.pattern = 'b' AND a.first < b.first")
def sim_before(spark, d):
    return joins.similar_before(joins.sentence_hits(*_sentences(spark, d), 0.1), "a", "b")


@query("sim_cooccur", _sim + " SELECT a.doc_id FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.pattern = 'a' AND b.pattern = 'b'")
def sim_cooccur(spark, d):
    return joins.similar_cooccur(joins.sentence_hits(*_sentences(spark, d), 0.1), "a", "b")


@query("frequency_complement", "SELECT count(*) FILTER (WHERE cnt = '') = 0 AS complete FROM docs")
def frequency_complement(spark, d):
    docs = docs_of(spark, d)
    many, few = (F.when(F.col("cnt") != "", f(F.regexp_count("cnt", F.lit("the")))) for f in (lambda n: n >= 2, lambda n: n < 2))
    m = patterns.masks(docs, "cnt", {"many": many.cast("int"), "few": few.cast("int")})
    return spark.createDataFrame([(joins.complements(m, docs, "many", "few"),)], "complete boolean")


@query("scope_anti_join", "SELECT 0 AS rule_id, a.doc_id AS x, b.doc_id AS y FROM docs a JOIN docs b ON a.cnt = b.cnt AND a.cnt <> '' WHERE NOT (a.doc_id = b.doc_id AND a.doc_id IN (SELECT doc_id FROM labels))")
def scope_anti_join(spark, d):
    v = joins.attribute_pairs(docs_of(spark, d), [("cnt", "cnt")]).withColumn("rule_id", F.lit(0))
    off = read(spark, d, "labels").select(F.lit(0).alias("rule_id"), F.col("doc_id").alias("x"), F.col("doc_id").alias("y"))
    return loop.in_scope(v, off).select("rule_id", "x", "y")


@query("routed_votes", "SELECT p.doc_id, p.label, count(*) FILTER (WHERE p.p >= 0.5) * 2 > count(*) AS vote FROM prob p JOIN documents d USING (doc_id) WHERE (d.lang = 'en' AND p.alias IN ('m1', 'm2', 'm3')) OR (d.lang <> 'en' AND p.alias = 'm2') GROUP BY 1, 2")
def routed_votes(spark, d):
    docs = docs_of(spark, d).select("doc_id", F.col("mtd_lang").alias("key"))
    keys = docs.select("key").distinct()
    routes = keys.select("key", F.when(F.col("key") == "en", "c0").otherwise("c1").alias("cluster"), F.explode(F.when(F.col("key") == "en", F.array(*map(F.lit, ("m1", "m2", "m3")))).otherwise(F.array(F.lit("m2")))).alias("alias"))
    return loop.routed_votes(docs, routes, prob_of(spark, d).withColumn("vote", F.col("p") >= 0.5))


# --- the loop -----------------------------------------------------------------------------------------------------


@query("verified_ledger", "SELECT doc_id, max(c) AS complete FROM (SELECT doc_id, true AS c FROM labels WHERE quality = 1 UNION ALL SELECT doc_id, false FROM labels WHERE toxic = 1) GROUP BY 1")
def verified_ledger(spark, d):
    l = read(spark, d, "labels")
    return loop.ledger(gamma_of(spark, d), axis_of(spark), read(spark, d, "documents"), l.where("quality = 1"), l.where("toxic = 1"))


@query("incremental_batch", """WITH old AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p, count(*) OVER () AS n FROM labels WHERE toxic = 0), k AS (SELECT doc_id FROM old WHERE p IN (SELECT (i * (SELECT max(n) FROM old)) // ceil((SELECT max(n) FROM old) * 0.25)::BIGINT FROM (SELECT unnest(range(ceil((SELECT max(n) FROM old) * 0.25)::BIGINT)) AS i))),
    t AS (SELECT g.doc_id, g.label, (g.sign = 1)::INT AS target, 1.0::DOUBLE AS weight, CASE WHEN l.toxic = 1 THEN 'fresh' ELSE 'replay' END AS origin FROM gamma g JOIN labels l USING (doc_id) WHERE l.toxic = 1 OR doc_id IN (SELECT doc_id FROM k)),
    w AS (SELECT doc_id, label, (p >= 0.5)::INT AS target, p AS weight FROM prob WHERE alias = 'm1'), v AS (SELECT doc_id, label, (p >= 0.5)::INT AS target FROM prob WHERE alias = 'm2')
    SELECT * FROM t UNION ALL SELECT w.doc_id, w.label, w.target, w.weight, 'weak' FROM w WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.doc_id = w.doc_id AND v.label = w.label AND v.target = w.target) AND NOT EXISTS (SELECT 1 FROM t WHERE t.doc_id = w.doc_id AND t.label = w.label)""")
def incremental_batch(spark, d):
    cell = lambda a: prob_of(spark, d).where(F.col("alias") == a).select("doc_id", "label", (F.col("p") >= 0.5).cast("int").alias("target"), F.col("p").alias("weight"))
    return loop.incremental_batch(cell("m1"), cell("m2"), gamma_of(spark, d), read(spark, d, "documents"), read(spark, d, "labels").where("toxic = 1"), 0.25)


@query("correction_cuts", "WITH n AS (SELECT label, cut, count(*) AS n, sum(target)::BIGINT AS hits FROM scores CROSS JOIN grid WHERE p >= cut GROUP BY 1, 2) SELECT label, min(cut) AS cut, first(n ORDER BY cut) AS n, first(hits ORDER BY cut) AS hits FROM n WHERE n >= 5 AND hits >= 1 AND hits >= 0.3 * n GROUP BY 1")
def correction_cuts(spark, d):
    return loop.correction_cuts(scores_of(spark, d), GRID, 0.3)


@query("residual_cuts", """WITH c AS (SELECT s.label, s.p, s.target = 1 AS t, q.p >= 0.5 AS old FROM scores s JOIN prob q ON q.doc_id = s.doc_id AND q.label = s.label AND q.alias = 'm2'), b AS (SELECT label, count(*) FILTER (WHERE old AND t) AS tp, count(*) FILTER (WHERE old AND NOT t) AS fp, count(*) FILTER (WHERE NOT old AND t) AS fn FROM c GROUP BY 1),
    a AS (SELECT b.label, g.cut AS pos_cut, count(*) FILTER (WHERE NOT old AND t AND p >= g.cut) AS xt, count(*) FILTER (WHERE NOT old AND NOT t AND p >= g.cut) AS xf FROM b JOIN c ON c.label = b.label CROSS JOIN grid g GROUP BY 1, 2),
    r AS (SELECT b.label, g.cut AS neg_cut, count(*) FILTER (WHERE old AND t AND p <= g.cut) AS rt, count(*) FILTER (WHERE old AND NOT t AND p <= g.cut) AS rf FROM b JOIN c ON c.label = b.label CROSS JOIN grid g GROUP BY 1, 2),
    x AS (SELECT r.* FROM r JOIN b USING (label) WHERE rt + rf >= 5 AND tp + fn > 0 AND rt <= 0.1 * (tp + fn) UNION ALL SELECT label, NULL, 0, 0 FROM b),
    f AS (SELECT b.label, pos_cut, neg_cut, 2.0 * (tp + xt - rt) / (2 * (tp + xt - rt) + fp + xf - rf + fn - xt + rt) - 2.0 * tp / (2 * tp + fp + fn) AS gain FROM b JOIN a USING (label) JOIN x USING (label) WHERE neg_cut IS NULL OR neg_cut < pos_cut)
    SELECT label, round(gain, 9)::DOUBLE AS gain, pos_cut, neg_cut FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(gain, 12) DESC, pos_cut DESC, coalesce(neg_cut, -1)) AS k FROM f WHERE gain > 1e-12) WHERE k = 1""")
def residual_cuts(spark, d):
    old = prob_of(spark, d).where("alias = 'm2'").select("doc_id", "label", (F.col("p") >= 0.5).alias("old"))
    cells = scores_of(spark, d).join(old, ["doc_id", "label"]).withColumn("target", F.col("target") == 1)
    return loop.residual_cuts(cells, GRID, GRID).withColumn("gain", F.round("gain", 9))


@query("label_loop")
def label_loop(spark, d):
    """Rounds of the loop: probabilities as models, the answers of `labels` for the documents that it covers."""
    cat, answers = catalog(spark, d, gamma_of(spark, d).where("doc_id % 2 = 0")), gamma_of(spark, d)
    rule = Rule((Doc("x"), ML("x", "m1", "quality", 0.6)), Label("x", "quality"))
    done = loop.label_loop(cat, [rule], axis_of(spark), prob_of(spark, d).where("alias = 'm1'"), lambda asked: answers.join(asked, "doc_id", "left_semi"), 64, 32, train=read(spark, d, "labels"))
    return spark.createDataFrame([(r.number, r.asked, r.pending, r.facts, done.status) for r in done.rounds], "round int, asked int, pending int, facts int, status string")


# --- models -------------------------------------------------------------------------------------------------------


@query("model_registry", "SELECT doc_id, 'length' AS alias, label, CASE label WHEN 'long' THEN (length(text) % 1000) / 1000.0::DOUBLE ELSE 1 - (length(text) % 1000) / 1000.0::DOUBLE END AS p FROM documents CROSS JOIN (SELECT unnest(['long', 'short']) AS label)")
def model_registry(spark, d):
    models = Registry()

    def scorer(c):
        p = (F.length(c) % 1000) / 1000.0
        return F.create_map(F.lit("long"), p, F.lit("short"), 1 - p)

    models.register("length", scorer, ("long", "short"))
    return models.probabilities(docs_of(spark, d)).select("doc_id", "alias", "label", "p")
