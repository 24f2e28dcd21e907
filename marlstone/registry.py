"""Queries over the driver's tables, one or more for each operator family, with equivalent DuckDB SQL.

Mapping: documents.text is cnt, its first line ttl, source and lang are named attributes; labels.quality and
labels.toxic are complete signed roots of the documents they cover; model probabilities are the exact
arithmetic p = ((doc_id * a + b) % 1000) / 1000 of each alias and label.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import text as T
from marlstone.operators import joins, metrics, patterns, relations, review, splits
from marlstone.operators.closure import clashes, close_program, influence
from marlstone.plans.compile import Catalog
from marlstone.plans.rules import ML, AttrEqual, Doc, Label, Pattern, Predicate, Rule, Text
from marlstone.plans.store import written
from marlstone.sources.readers import documents
from marlstone.streaming.ingest import windowed_counts

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
MODELS = (("m1", "quality", 37, 11), ("m1", "toxic", 53, 29), ("m2", "quality", 71, 5), ("m2", "toxic", 13, 7), ("m3", "quality", 91, 17), ("m3", "toxic", 29, 3))
LABELS = ("quality", "toxic")
GRID = [k / 20 for k in range(1, 20)]

#: Common table expressions that stand before the SQL of a query.
SQL = {
    "docs": "SELECT doc_id, text AS cnt, split_part(text, chr(10), 1) AS ttl, source AS mtd_source, lang AS mtd_lang FROM documents",
    "gamma": "SELECT doc_id, 'quality' AS label, CASE WHEN quality = 1 THEN 1 ELSE -1 END AS sign FROM labels UNION ALL SELECT doc_id, 'toxic', CASE WHEN toxic = 1 THEN 1 ELSE -1 END FROM labels",
    "truth": "SELECT doc_id, label FROM gamma WHERE sign = 1",
    "prob": " UNION ALL ".join(f"SELECT doc_id, '{a}' AS alias, '{x}' AS label, ((doc_id * {m} + {b}) % 1000) / 1000.0::DOUBLE AS p FROM documents" for a, x, m, b in MODELS),
    "scores": "SELECT p.label, p.p, CASE WHEN g.sign = 1 THEN 1 ELSE 0 END AS target, p.doc_id FROM prob p JOIN gamma g ON p.doc_id = g.doc_id AND p.label = g.label WHERE p.alias = 'm1'",
    "pred": "SELECT doc_id, label FROM prob WHERE alias = 'm1' AND p >= 0.5 AND doc_id IN (SELECT doc_id FROM labels)",
    "axis": "SELECT 'quality' AS label UNION ALL SELECT 'toxic'",
    "per_label": """SELECT a.label, count(p.doc_id) FILTER (WHERE t.doc_id IS NOT NULL) AS tp, count(p.doc_id) FILTER (WHERE t.doc_id IS NULL) AS fp,
        (SELECT count(*) FROM truth x WHERE x.label = a.label) - count(p.doc_id) FILTER (WHERE t.doc_id IS NOT NULL) AS fn
        FROM axis a LEFT JOIN pred p ON p.label = a.label LEFT JOIN truth t ON t.doc_id = p.doc_id AND t.label = p.label GROUP BY a.label""",
    "hits": " UNION ALL ".join(f"SELECT doc_id, '{w}' AS pattern FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_]){w}([^A-Za-z0-9_]|$)')" for w in ("worthless", "idiot", "scum", "trash", "the", "and")),
    "n_docs": "SELECT count(*) AS n FROM labels",
    "cont": """SELECT h.pattern, a.label, (SELECT n FROM n_docs) AS n, h.s, coalesce(p.pos, 0) AS pos, coalesce(c.tp, 0) AS tp
        FROM (SELECT pattern, count(*) AS s FROM hits WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY pattern) h CROSS JOIN axis a
        LEFT JOIN (SELECT label, count(*) AS pos FROM truth GROUP BY label) p ON p.label = a.label
        LEFT JOIN (SELECT h.pattern, t.label, count(*) AS tp FROM hits h JOIN truth t ON t.doc_id = h.doc_id GROUP BY 1, 2) c ON c.pattern = h.pattern AND c.label = a.label""",
    "grid": "SELECT unnest(range(1, 20)) / 20.0::DOUBLE AS cut",
    "gcount": """SELECT s.label, g.cut, count(*) FILTER (WHERE p >= cut AND target = 1) AS tp, count(*) FILTER (WHERE p >= cut AND target = 0) AS fp,
        count(*) FILTER (WHERE p < cut AND target = 1) AS fn, sum(target) AS support FROM scores s CROSS JOIN grid g GROUP BY 1, 2""",
    "gf1": "SELECT *, CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END::DOUBLE AS f1 FROM gcount",
}
_ORDER = [*SQL]


def with_sql(body: str, *names: str, recursive: str = "") -> str:
    """The named expressions and those that they use, in order, before the body. recursive: further expressions of the WITH."""
    import re

    need = set(names)
    while True:
        more = {n for n in SQL for m in (*need, "") if re.search(rf"\b{n}\b", SQL[m] if m else body + recursive)} | need
        if more == need:
            break
        need = more
    parts = [f"{n} AS ({SQL[n]})" for n in _ORDER if n in need] + ([recursive] if recursive else [])
    if parts and body.startswith("WITH "):
        return f"WITH {', '.join(parts)}, {body.removeprefix('WITH ')}"
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}" if parts else body


def query(name: str, sql: str | None = None, recursive: str = ""):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = with_sql(sql, recursive=recursive)
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return documents(read(spark, d, "documents"), "doc_id", "text", None, ("source", "lang"))


def gamma_of(spark: SparkSession, d: str) -> DataFrame:
    made = F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.when(F.col(x) == 1, 1).otherwise(-1).alias("sign")) for x in LABELS])).alias("s")
    return read(spark, d, "labels").select("doc_id", made).select("doc_id", "s.label", "s.sign")


def truth_of(spark: SparkSession, d: str) -> DataFrame:
    return gamma_of(spark, d).where("sign = 1").select("doc_id", "label")


def prob_of(spark: SparkSession, d: str) -> DataFrame:
    p = lambda m, b: ((F.col("doc_id") * m + b) % 1000) / F.lit(1000.0)
    made = F.explode(F.array(*[F.struct(F.lit(a).alias("alias"), F.lit(x).alias("label"), p(m, b).alias("p")) for a, x, m, b in MODELS])).alias("s")
    return read(spark, d, "documents").select("doc_id", made).select("doc_id", "s.*").withColumn("is_static", F.lit(False))


def scores_of(spark: SparkSession, d: str) -> DataFrame:
    g = gamma_of(spark, d).select("doc_id", "label", (F.col("sign") == 1).cast("int").alias("target"))
    return prob_of(spark, d).where("alias = 'm1'").join(g, ["doc_id", "label"]).select("label", "p", "target", "doc_id")


def pred_of(spark: SparkSession, d: str) -> DataFrame:
    return prob_of(spark, d).where("alias = 'm1' and p >= 0.5").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("doc_id", "label")


def axis_of(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in LABELS], "label string")


def word(w: str) -> Pattern:
    return Pattern(rf"(^|[^A-Za-z0-9_]){w}([^A-Za-z0-9_]|$)")


def has(w: str, attr: str = "cnt", **how) -> Predicate:
    return Predicate("match", attr, word(w), **how)


def catalog(spark: SparkSession, d: str, gamma: DataFrame | None = None) -> Catalog:
    return Catalog(docs_of(spark, d), gamma_of(spark, d) if gamma is None else gamma, prob_of(spark, d))


_W = "(^|[^A-Za-z0-9_]){}([^A-Za-z0-9_]|$)"


def _text(name: str, p: Predicate, where: str) -> None:
    @query(name, f"SELECT doc_id FROM docs WHERE {where}")
    def run(spark: SparkSession, d: str, p=p) -> DataFrame:
        return docs_of(spark, d).where(T.predicate(p, F.col(p.attr))).select("doc_id")


_count = "len(regexp_extract_all(cnt, 'the'))"
_text("text_match", has("worthless"), f"regexp_matches(cnt, '{_W.format('worthless')}')")
_text("text_match_negate", has("the", negate=True), f"cnt <> '' AND NOT regexp_matches(cnt, '{_W.format('the')}')")
for _name, _op in (("eq", "=="), ("ne", "!="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    _text(f"text_freq_{_name}", Predicate("freq", "cnt", Pattern("the"), op=_op, eta=12), f"cnt <> '' AND {_count} {'=' if _op == '==' else _op} 12")
_text("text_cooccur", Predicate("cooccur", "cnt", word("worthless"), word("and")), f"regexp_matches(cnt, '{_W.format('worthless')}') AND regexp_matches(cnt, '{_W.format('and')}')")
_text("text_before", Predicate("before", "cnt", Pattern("worthless"), Pattern("idiot")), "strpos(cnt, 'worthless') > 0 AND strpos(cnt, 'idiot') > 0 AND strpos(cnt, 'worthless') < strpos(cnt, 'idiot')")
_text("text_missing_guard", Predicate("freq", "ttl", Pattern("the"), op="<=", eta=0), "ttl <> '' AND len(regexp_extract_all(ttl, 'the')) <= 0")


@query("ml_threshold", "SELECT doc_id, alias, label FROM prob WHERE p >= 0.8")
def ml_threshold(spark, d):
    return prob_of(spark, d).where("p >= 0.8").select("doc_id", "alias", "label")


@query("ml_score_band", "SELECT doc_id, alias, label FROM prob WHERE p >= 0.4 AND p < 0.6")
def ml_score_band(spark, d):
    return prob_of(spark, d).where("p >= 0.4 and p < 0.6").select("doc_id", "alias", "label")


@query("ml_argmax", "SELECT doc_id, alias, first(label ORDER BY p DESC, label) AS label FROM prob GROUP BY 1, 2")
def ml_argmax(spark, d):
    order = F.struct(-F.col("p"), F.col("label"))
    return prob_of(spark, d).groupBy("doc_id", "alias").agg(F.min_by("label", order).alias("label"))


@query("ml_majority", "SELECT doc_id, label, count(*) FILTER (WHERE p >= 0.5) AS yes, count(*) AS models, count(*) FILTER (WHERE p >= 0.5) * 2 > count(*) AS vote FROM prob GROUP BY 1, 2")
def ml_majority(spark, d):
    return metrics.majority(prob_of(spark, d).withColumn("vote", F.col("p") >= 0.5))


_lg = "ln(greatest(least({0}, 0.999999), 0.000001) / (1 - greatest(least({0}, 0.999999), 0.000001)))"


@query("ml_ensemble_margin", f"SELECT doc_id, label, round(1 / (1 + exp(-avg({_lg.format('p')} - {_lg.format('0.4')}))), 6) AS p FROM prob GROUP BY 1, 2")
def ml_ensemble_margin(spark, d):
    return metrics.margin_ensemble(prob_of(spark, d).withColumn("cut", F.lit(0.4))).withColumn("p", F.round("p", 6))


@query("rule_firing_model_text", f"SELECT d.doc_id, 'quality' AS label, 1 AS sign FROM docs d JOIN prob p ON p.doc_id = d.doc_id AND p.alias = 'm1' AND p.label = 'quality' AND p.p >= 0.5 WHERE regexp_matches(cnt, '{_W.format('the')}')")
def rule_firing_model_text(spark, d):
    from marlstone.plans.compile import fire

    r = Rule((Doc("x"), Text("x", has("the")), ML("x", "m1", "quality", 0.5)), Label("x", "quality"))
    return fire(r, catalog(spark, d), gamma_of(spark, d))


@query("attr_equal_join", "SELECT a.doc_id AS x, b.doc_id AS y FROM docs a JOIN docs b ON a.ttl = b.ttl AND a.ttl <> ''")
def attr_equal_join(spark, d):
    return joins.attribute_pairs(docs_of(spark, d), [("ttl", "ttl")])


@query("attr_equal_multi", "SELECT a.doc_id AS x, b.doc_id AS y FROM docs a JOIN docs b ON a.ttl = b.ttl AND a.mtd_lang = b.mtd_lang AND a.mtd_source = b.mtd_source AND a.ttl <> ''")
def attr_equal_multi(spark, d):
    return joins.attribute_pairs(docs_of(spark, d), [("ttl", "ttl"), ("mtd_lang", "mtd_lang"), ("mtd_source", "mtd_source")])


@query("attr_equal_cross_attr", "SELECT a.doc_id AS x, b.doc_id AS y FROM docs a JOIN docs b ON a.ttl = b.cnt AND a.ttl <> ''")
def attr_equal_cross_attr(spark, d):
    return joins.attribute_pairs(docs_of(spark, d), [("ttl", "cnt")])


@query("group_semi_join", "SELECT doc_id FROM docs WHERE mtd_source IN (SELECT mtd_source FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))")
def group_semi_join(spark, d):
    return joins.group_reach(docs_of(spark, d), read(spark, d, "labels").where("toxic = 1"), "mtd_source")


@query("set_group_join", "SELECT a.o_custkey AS doc_id, count(DISTINCT b.o_custkey) AS sources FROM (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) a JOIN (SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) b USING (l_partkey) JOIN customer c ON c.c_custkey = b.o_custkey AND c.c_mktsegment = 'BUILDING' GROUP BY 1 HAVING count(DISTINCT b.o_custkey) >= 2")
def set_group_join(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    m = o.select(F.col("o_custkey").alias("doc_id"), F.col("l_partkey").cast("string").alias("member"))
    return joins.set_groups(m, read(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("doc_id")), 2)


def _vec(spark, d):
    v = joins.unit_vectors(read(spark, d, "embeddings"), "vec_id", "embedding")
    return v, v.where(F.col("id") % 100 == 0)


_cos = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_near = f"SELECT x, y, sim FROM (SELECT a.vec_id AS x, b.vec_id AS y, {_cos} AS sim, row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) DESC, b.vec_id) AS r FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) WHERE r <= 5"


@query("knn_directed", _near)
def knn_directed(spark, d):
    return joins.top_k(*_vec(spark, d), 5).withColumn("sim", F.round("sim", 6))


_all_near = _near.replace(" WHERE a.vec_id % 100 = 0", "")  # of every vector


@query("knn_mutual", f"SELECT n.x, n.y, n.sim FROM ({_all_near}) n JOIN ({_all_near}) m ON n.x = m.y AND n.y = m.x")
def knn_mutual(spark, d):
    v, _ = _vec(spark, d)
    return joins.top_k(v, None, 5, "mutual").withColumn("sim", F.round("sim", 6))


@query("knn_union", f"SELECT x, y, max(sim) AS sim FROM (SELECT x, y, sim FROM ({_all_near}) UNION ALL SELECT y, x, sim FROM ({_all_near})) GROUP BY 1, 2")
def knn_union(spark, d):
    v, _ = _vec(spark, d)
    return joins.top_k(v, None, 5, "symmetric_union").withColumn("sim", F.round("sim", 6))


@query("sim_threshold_quorum", "SELECT a.vec_id AS x, count(*) AS sources FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0 AND round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) >= 0.2 GROUP BY 1 HAVING count(*) >= 2")
def sim_threshold_quorum(spark, d):
    v, q = _vec(spark, d)
    return joins.similarity_quorum(v, q, 0.2, 2)


def _copy(label: str, *more, attr: str = "mtd.source") -> Rule:
    return Rule((Doc("x"), Doc("y"), AttrEqual("x", attr, "y", attr), Label("y", label), *more), Label("x", label))


@query("closure_label_copy", f"SELECT doc_id, label, sign FROM r", recursive=f"r AS (SELECT doc_id, 'toxic' AS label, 1 AS sign FROM labels WHERE toxic = 1 UNION SELECT a.doc_id, 'toxic', 1 FROM r JOIN docs b ON b.doc_id = r.doc_id JOIN docs a ON a.mtd_source = b.mtd_source AND regexp_matches(a.cnt, '{_W.format('the')}'))")
def closure_label_copy(spark, d):
    g = gamma_of(spark, d).where("label = 'toxic' and sign = 1")
    return close_program(catalog(spark, d, g), [_copy("toxic", Text("x", has("the")))]).facts


@query("closure_label_chain", f"SELECT doc_id, label, sign FROM r", recursive=f"r AS (SELECT doc_id, 'a' AS label, 1 AS sign FROM docs WHERE regexp_matches(cnt, '{_W.format('worthless')}') UNION SELECT doc_id, CASE label WHEN 'a' THEN 'b' ELSE 'c' END, 1 FROM r WHERE label IN ('a', 'b'))")
def closure_label_chain(spark, d):
    one = lambda a, b: Rule((Doc("x"), Label("x", a)), Label("x", b))
    start = Rule((Doc("x"), Text("x", has("worthless"))), Label("x", "a"))
    none = gamma_of(spark, d).where("false")
    return close_program(catalog(spark, d, none), [one("b", "c"), one("a", "b"), start]).facts


@query("closure_two_rule_mutual", f"SELECT doc_id, label, sign FROM r", recursive="r AS (SELECT doc_id, 'toxic' AS label, 1 AS sign FROM labels WHERE toxic = 1 UNION SELECT a.doc_id, CASE r.label WHEN 'toxic' THEN 'flag' ELSE 'toxic' END, 1 FROM r JOIN docs b ON b.doc_id = r.doc_id JOIN docs a ON (r.label = 'toxic' AND a.ttl = b.ttl AND a.ttl <> '') OR (r.label = 'flag' AND a.cnt = b.cnt))")
def closure_two_rule_mutual(spark, d):
    g = gamma_of(spark, d).where("label = 'toxic' and sign = 1")
    up = Rule((Doc("x"), Doc("y"), AttrEqual("x", "ttl", "y", "ttl"), Label("y", "toxic")), Label("x", "flag"))
    back = Rule((Doc("x"), Doc("y"), AttrEqual("x", "cnt", "y", "cnt"), Label("y", "flag")), Label("x", "toxic"))
    return close_program(catalog(spark, d, g), [up, back]).facts


@query("closure_gamma_protected", "SELECT doc_id, label, sign FROM r", recursive="r AS (SELECT doc_id, label, sign FROM gamma UNION SELECT a.doc_id, 'toxic', 1 FROM r JOIN docs b ON b.doc_id = r.doc_id AND r.label = 'toxic' AND r.sign = 1 JOIN docs a ON a.mtd_source = b.mtd_source AND a.mtd_lang = b.mtd_lang WHERE NOT EXISTS (SELECT 1 FROM labels g WHERE g.doc_id = a.doc_id AND g.toxic = 0))")
def closure_gamma_protected(spark, d):
    r = Rule((Doc("x"), Doc("y"), AttrEqual("x", "mtd.source", "y", "mtd.source"), AttrEqual("x", "mtd.lang", "y", "mtd.lang"), Label("y", "toxic")), Label("x", "toxic"))
    return close_program(catalog(spark, d), [r], "protect").facts


def _conflicting(spark, d):
    pos = Rule((Doc("x"), Text("x", has("the"))), Label("x", "quality"))
    neg = Rule((Doc("x"), Text("x", has("worthless"))), Label("x", "quality", "neg"))
    after = Rule((Doc("x"), Label("x", "quality")), Label("x", "good"))
    return catalog(spark, d, gamma_of(spark, d).where("false")), [pos, neg, after]


_pn = f"regexp_matches(cnt, '{_W.format('the')}')", f"regexp_matches(cnt, '{_W.format('worthless')}')"


@query("conflict_cells", f"SELECT doc_id, 'quality' AS label FROM docs WHERE {_pn[0]} AND {_pn[1]}")
def conflict_cells(spark, d):
    cat, rules = _conflicting(spark, d)
    return clashes(close_program(cat, rules, "halt").facts)


@query("quarantine_facts", f"SELECT doc_id, 'quality' AS label, 1 AS sign FROM docs WHERE {_pn[0]} AND NOT {_pn[1]} UNION ALL SELECT doc_id, 'good', 1 FROM docs WHERE {_pn[0]} AND NOT {_pn[1]} UNION ALL SELECT doc_id, 'quality', -1 FROM docs WHERE {_pn[1]} AND NOT {_pn[0]}")
def quarantine_facts(spark, d):
    cat, rules = _conflicting(spark, d)
    return close_program(cat, rules, "quarantine").facts


@query("quarantine_unknown", f"SELECT doc_id, 'quality' AS label FROM docs WHERE {_pn[0]} AND {_pn[1]}")
def quarantine_unknown(spark, d):
    cat, rules = _conflicting(spark, d)
    return close_program(cat, rules, "quarantine").unknown


_unk = f"SELECT doc_id, 'quality' AS label FROM docs WHERE {_pn[0]} AND {_pn[1]}"


@query("arbitration", f"SELECT u.doc_id, u.label, CASE WHEN p.p >= 0.6 THEN 1 ELSE -1 END AS sign FROM ({_unk}) u JOIN prob p ON p.doc_id = u.doc_id AND p.label = u.label AND p.alias = 'm1'")
def arbitration(spark, d):
    u = docs_of(spark, d).where(T.predicate(has("the"), F.col("cnt")) & T.predicate(has("worthless"), F.col("cnt"))).select("doc_id", F.lit("quality").alias("label"))
    return review.arbitrate(u, prob_of(spark, d).where("alias = 'm1'"), 0.6)


@query("fallback_fill", "SELECT p.doc_id, p.label FROM prob p WHERE p.alias = 'm1' AND p.p >= CASE p.label WHEN 'quality' THEN 0.7 ELSE 0.9 END AND NOT EXISTS (SELECT 1 FROM gamma g WHERE g.doc_id = p.doc_id AND g.label = p.label)")
def fallback_fill(spark, d):
    cuts = spark.createDataFrame([("quality", 0.7), ("toxic", 0.9)], "label string, cut double")
    cells = review.undecided(docs_of(spark, d), axis_of(spark), gamma_of(spark, d))
    return review.fallback(cells, prob_of(spark, d).where("alias = 'm1'"), cuts)


@query("pending_rows", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM truth)")
def pending_rows(spark, d):
    none = truth_of(spark, d).where("false")
    return review.pending(docs_of(spark, d), truth_of(spark, d), none)


@query("available_predictions", "SELECT doc_id, label FROM truth UNION SELECT doc_id, label FROM prob WHERE alias = 'm2' AND p >= 0.95")
def available_predictions(spark, d):
    return review.available(gamma_of(spark, d), gamma_of(spark, d).where("false"), prob_of(spark, d).where("alias = 'm2' and p >= 0.95"))


_edges = "SELECT c_custkey AS src, 10000000 + c_nationkey AS dst FROM customer UNION SELECT 10000000 + n_nationkey, 20000000 + n_regionkey FROM nation UNION SELECT 30000000 + s_suppkey, 10000000 + s_nationkey FROM supplier"


def _edge_frame(spark, d):
    edge = lambda df, a, b: df.select(a.cast("long").alias("src"), b.cast("long").alias("dst"), F.lit(False).alias("strict"))
    c = edge(read(spark, d, "customer"), F.col("c_custkey"), 10000000 + F.col("c_nationkey"))
    n = edge(read(spark, d, "nation"), 10000000 + F.col("n_nationkey"), 20000000 + F.col("n_regionkey"))
    return c.unionByName(n).unionByName(edge(read(spark, d, "supplier"), 30000000 + F.col("s_suppkey"), 10000000 + F.col("s_nationkey"))).distinct()


@query("subset_transitive_closure", "SELECT src, dst FROM r", recursive=f"r AS (SELECT src, dst FROM ({_edges}) UNION SELECT r.src, e.dst FROM r JOIN ({_edges}) e ON r.dst = e.src)")
def subset_transitive_closure(spark, d):
    return relations.close(_edge_frame(spark, d)).select("src", "dst")


_next = "SELECT * FROM (SELECT doc_id AS src, lead(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS dst FROM documents) WHERE dst IS NOT NULL"


def _copies(spark, d, strict: bool = False):
    from pyspark.sql import Window

    nxt = F.lead("doc_id").over(Window.partitionBy("h").orderBy("doc_id"))
    return read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")).select(F.col("doc_id").alias("src"), nxt.alias("dst"), F.lit(strict).alias("strict")).where("dst is not null")


@query("subset_label_copy", "SELECT DISTINCT r.dst AS doc_id, g.label, 1 AS sign FROM r JOIN truth g ON g.doc_id = r.src UNION SELECT doc_id, label, sign FROM gamma", recursive=f"r AS (SELECT src, dst FROM ({_next}) UNION SELECT r.src, e.dst FROM r JOIN ({_next}) e ON r.dst = e.src)")
def subset_label_copy(spark, d):
    return relations.carry(gamma_of(spark, d), _copies(spark, d))


_cyc = "SELECT DISTINCT n_nationkey AS src, n_regionkey AS dst FROM nation"


@query("strict_cycle_check", "SELECT DISTINCT a.src, a.dst FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src UNION SELECT src, dst FROM r WHERE src = dst", recursive=f"r AS (SELECT src, dst FROM ({_cyc}) UNION SELECT r.src, e.dst FROM r JOIN ({_cyc}) e ON r.dst = e.src)")
def strict_cycle_check(spark, d):
    e = read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"), F.lit(True).alias("strict")).distinct()
    return relations.violations(relations.close(e), gamma_of(spark, d)).select("src", "dst")


_F1 = "CASE WHEN 2 * {0}tp{1} + {0}fp{1} + {0}fn{1} = 0 THEN 0.0 ELSE 2.0 * {0}tp{1} / (2 * {0}tp{1} + {0}fp{1} + {0}fn{1}) END::DOUBLE"


@query("f1_per_label", f"SELECT label, tp, fp, fn, round({_F1.format('', '')}, 9) AS f1 FROM per_label")
def f1_per_label(spark, d):
    return metrics.confusion(pred_of(spark, d), truth_of(spark, d), axis_of(spark)).withColumn("f1", F.round("f1", 9))


@query("f1_macro_micro", f"SELECT round(avg({_F1.format('', '')}), 9) AS macro_f1, round({_F1.format('sum(', ')')}, 9) AS micro_f1, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn FROM per_label")
def f1_macro_micro(spark, d):
    return metrics.macro_micro(metrics.confusion(pred_of(spark, d), truth_of(spark, d), axis_of(spark))).withColumns({"macro_f1": F.round("macro_f1", 9), "micro_f1": F.round("micro_f1", 9)})


@query("completeness", "SELECT round(avg(k * 1.0 / n), 9)::DOUBLE AS completeness, count(*) AS documents FROM (SELECT t.doc_id, count(*) AS n, count(p.doc_id) AS k FROM truth t LEFT JOIN pred p ON p.doc_id = t.doc_id AND p.label = t.label GROUP BY 1) WHERE n > 1")
def completeness(spark, d):
    return metrics.completeness(pred_of(spark, d), truth_of(spark, d)).withColumn("completeness", F.round("completeness", 9))


@query("coverage", "SELECT (SELECT count(DISTINCT doc_id) FROM pred) AS covered, count(*) AS documents, round((SELECT count(DISTINCT doc_id) FROM pred) * 1.0 / count(*), 9)::DOUBLE AS coverage FROM documents")
def coverage(spark, d):
    return metrics.coverage(pred_of(spark, d), docs_of(spark, d)).withColumn("coverage", F.round("coverage", 9))


@query("subset_accuracy", "SELECT count(*) FILTER (WHERE doc_id NOT IN (SELECT doc_id FROM ((SELECT * FROM pred EXCEPT SELECT * FROM truth) UNION ALL (SELECT * FROM truth EXCEPT SELECT * FROM pred)))) AS exact, count(*) AS documents FROM labels")
def subset_accuracy(spark, d):
    return metrics.subset_accuracy(pred_of(spark, d), truth_of(spark, d), read(spark, d, "labels"))


@query("cell_changes", "SELECT label, count(*) FILTER (WHERE a AND NOT b AND t) AS recovered_fn, count(*) FILTER (WHERE a AND NOT b AND NOT t) AS added_fp, count(*) FILTER (WHERE b AND NOT a AND t) AS lost_tp, count(*) FILTER (WHERE b AND NOT a AND NOT t) AS removed_fp FROM (SELECT g.label, g.sign = 1 AS t, p1.p >= 0.5 AS b, p2.p >= 0.5 AS a FROM gamma g JOIN prob p1 ON p1.doc_id = g.doc_id AND p1.label = g.label AND p1.alias = 'm1' JOIN prob p2 ON p2.doc_id = g.doc_id AND p2.label = g.label AND p2.alias = 'm2') GROUP BY 1")
def cell_changes(spark, d):
    after = prob_of(spark, d).where("alias = 'm2' and p >= 0.5").join(read(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")
    return metrics.cell_changes(pred_of(spark, d), after, truth_of(spark, d))


@query("avg_precision", "SELECT label, round(sum(y * cy * 1.0 / cn) / max(total), 9)::DOUBLE AS ap FROM (SELECT label, y, sum(y) OVER w AS cy, sum(n) OVER w AS cn, sum(y) OVER (PARTITION BY label) AS total FROM (SELECT label, p, sum(target) AS y, count(*) AS n FROM scores GROUP BY 1, 2) WINDOW w AS (PARTITION BY label ORDER BY p DESC)) GROUP BY 1")
def avg_precision(spark, d):
    return metrics.average_precision(scores_of(spark, d)).withColumn("ap", F.round("ap", 9))


@query("calibrate_threshold_grid", "SELECT label, cut, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(f1, 9) AS f1 FROM gf1")
def calibrate_threshold_grid(spark, d):
    return metrics.grid_counts(scores_of(spark, d), GRID).select("label", "cut", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


@query("calibrate_best_cut", "SELECT label, first(cut ORDER BY f1 DESC, abs(cut - 0.5), cut) AS cut, round(max(f1), 9) AS f1 FROM gf1 GROUP BY 1")
def calibrate_best_cut(spark, d):
    return metrics.best_cut(metrics.grid_counts(scores_of(spark, d), GRID)).withColumn("f1", F.round("f1", 9))


@query("fallback_threshold", "SELECT label, first(cut ORDER BY f1 DESC, cut DESC) AS cut FROM gf1 GROUP BY 1")
def fallback_threshold(spark, d):
    return metrics.pooled_cuts(scores_of(spark, d), GRID)


@query("kappa_calibration", "SELECT label, CASE WHEN max(acc) > max(acc) FILTER (WHERE cut = 0.5) THEN first(cut ORDER BY acc DESC, cut DESC) ELSE 0.5 END AS cut FROM (SELECT label, cut, count(*) FILTER (WHERE (p >= cut) = (target = 1)) AS acc FROM scores CROSS JOIN grid GROUP BY 1, 2) GROUP BY 1")
def kappa_calibration(spark, d):
    return metrics.kappa(scores_of(spark, d).withColumn("weight", F.lit(1.0)), GRID)


PATTERNS = ("worthless", "idiot", "scum", "trash", "the", "and")


def _hits(spark, d):
    return patterns.masks(docs_of(spark, d), "cnt", {w: T.predicate(has(w), F.col("cnt")) for w in PATTERNS})


def _cont(spark, d):
    return patterns.contingency(_hits(spark, d), truth_of(spark, d), read(spark, d, "labels"))


@query("pattern_masks", "SELECT doc_id, pattern, 1::BIGINT AS n FROM hits")
def pattern_masks(spark, d):
    return _hits(spark, d)


@query("mcc_rank", "SELECT pattern, label, round(CASE WHEN s * (n - s) * pos * (n - pos) <= 0 THEN 0.0 ELSE (n * tp - s * pos) / sqrt((s * (n - s))::DOUBLE * (pos * (n - pos))::DOUBLE) END, 9) AS mcc FROM cont")
def mcc_rank(spark, d):
    return patterns.mcc(_cont(spark, d)).select("pattern", "label", F.round("mcc", 9).alias("mcc"))


_mi = "CASE WHEN {0} <= 0 THEN 0.0 ELSE {0} / n::DOUBLE * ln({0} * n::DOUBLE / (({1}) * ({2}))::DOUBLE) END"


@query("mutual_information", "SELECT pattern, label, round(greatest(" + " + ".join(_mi.format(*x) for x in (("tp", "s", "pos"), ("(s - tp)", "s", "n - pos"), ("(pos - tp)", "n - s", "pos"), ("(n - s - pos + tp)", "n - s", "n - pos"))) + ", 0.0), 9) AS mi FROM cont")
def mutual_information(spark, d):
    return patterns.mutual_information(_cont(spark, d)).select("pattern", "label", F.round("mi", 9).alias("mi"))


@query("label_entropy", "SELECT h.pattern, round(coalesce(sum(-(tp::DOUBLE / s) * ln(tp::DOUBLE / s)), 0), 9) AS entropy, max(s) AS support FROM (SELECT pattern, count(*) AS s FROM hits GROUP BY 1) h LEFT JOIN (SELECT h.pattern, t.label, count(*) AS tp FROM hits h JOIN truth t USING (doc_id) GROUP BY 1, 2) c ON c.pattern = h.pattern GROUP BY 1")
def label_entropy(spark, d):
    return patterns.label_entropy(_hits(spark, d), truth_of(spark, d)).withColumn("entropy", F.round("entropy", 9))


@query("histogram_entropy", "SELECT pattern, round(sum(-(tp::DOUBLE / total) * ln(tp::DOUBLE / total)), 9) AS entropy FROM (SELECT pattern, tp, sum(tp) OVER (PARTITION BY pattern) AS total FROM (SELECT h.pattern, t.label, count(*) AS tp FROM hits h JOIN truth t USING (doc_id) GROUP BY 1, 2)) GROUP BY 1")
def histogram_entropy(spark, d):
    return patterns.histogram_entropy(_hits(spark, d), truth_of(spark, d)).withColumn("entropy", F.round("entropy", 9))


@query("support_screen", "SELECT pattern, count(*) AS support FROM hits GROUP BY 1 HAVING count(*) * 1.0 / (SELECT count(*) FROM documents) BETWEEN 0.01 AND 0.9")
def support_screen(spark, d):
    return patterns.support_screen(_hits(spark, d), read(spark, d, "documents").count(), 0.01, 0.9)


@query("freq_partitions", "WITH c AS (SELECT 'the' AS pattern, len(regexp_extract_all(text, 'the'))::BIGINT AS n, count(*) AS k FROM documents GROUP BY 1, 2), w AS (SELECT *, sum(k) OVER (ORDER BY n) AS le, sum(k) OVER () AS total FROM c), x AS (SELECT pattern, '>=' AS op, n AS eta, total - le + k AS support FROM w UNION ALL SELECT pattern, '<=', n, le FROM w UNION ALL SELECT pattern, '==', n, k FROM w UNION ALL SELECT pattern, '!=', n, total - k FROM w) SELECT pattern, op, eta, support::BIGINT AS support FROM x WHERE support > 0")
def freq_partitions(spark, d):
    c = docs_of(spark, d).select("doc_id", F.lit("the").alias("pattern"), F.regexp_count("cnt", F.lit("the")).cast("long").alias("n"))
    return patterns.frequency_partitions(c)


@query("label_implication", "SELECT a.label AS i, b.label AS j, round(count(*) * 1.0 / max(n), 9)::DOUBLE AS share FROM truth a JOIN truth b ON a.doc_id = b.doc_id AND a.label <> b.label JOIN (SELECT label, count(*) AS n FROM truth GROUP BY 1) c ON c.label = a.label GROUP BY 1, 2 HAVING count(*) * 1.0 / max(n) >= 0.1")
def label_implication(spark, d):
    return patterns.implications(truth_of(spark, d), 0.1).withColumn("share", F.round("share", 9))


@query("attribute_screening", "SELECT attribute, count(*) AS groups, sum(n * n)::BIGINT AS pairs, round(sum(n * (n - 1)) / sum(n), 9)::DOUBLE AS mean_partners, round(sum(CASE WHEN n > 1 THEN n ELSE 0 END) / sum(n), 9)::DOUBLE AS in_groups FROM (SELECT 'mtd_source' AS attribute, mtd_source AS v, count(*) AS n FROM docs GROUP BY 2 UNION ALL SELECT 'ttl', ttl, count(*) FROM docs WHERE ttl <> '' GROUP BY 2) GROUP BY 1")
def attribute_screening(spark, d):
    return patterns.attribute_statistics(docs_of(spark, d), ["mtd_source", "ttl"]).withColumns({"mean_partners": F.round("mean_partners", 9), "in_groups": F.round("in_groups", 9)})


@query("duplicate_mask_groups", "WITH h AS (SELECT doc_id, w AS pattern FROM documents, (SELECT unnest(['idiot', 'idio', 'worthless', 'worthles', 'scum']) AS w) WHERE strpos(text, w) > 0), k AS (SELECT pattern, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS m FROM h GROUP BY 1) SELECT pattern, min(pattern) OVER (PARTITION BY m) AS first FROM k")
def duplicate_mask_groups(spark, d):
    ps = {w: F.contains("cnt", F.lit(w)) for w in ("idiot", "idio", "worthless", "worthles", "scum")}
    return patterns.duplicate_masks(patterns.masks(docs_of(spark, d), "cnt", ps))


@query("entropy_topk", "SELECT pattern, label FROM (SELECT pattern, label, row_number() OVER (PARTITION BY label ORDER BY tp DESC, pattern) AS r FROM cont) WHERE r <= 3")
def entropy_topk(spark, d):
    return patterns.top_by(_cont(spark, d), "label", [F.desc("tp"), F.col("pattern")], 3).select("pattern", "label")


@query("selection_frequency_topk", "SELECT alias, count(*) AS picks FROM (SELECT doc_id, label, alias, row_number() OVER (PARTITION BY doc_id, label ORDER BY p DESC, alias) AS r FROM prob) WHERE r <= 2 GROUP BY 1 ORDER BY picks DESC, alias LIMIT 2")
def selection_frequency_topk(spark, d):
    cells = prob_of(spark, d).withColumn("cell", F.struct("doc_id", "label"))
    return patterns.frequent_picks(cells, "cell", "alias", [F.desc("p"), F.col("alias")], 2)


_f = "CASE WHEN 2 * ({0}) + ({1}) + ({2}) = 0 THEN 0.0 ELSE 2.0 * ({0}) / (2 * ({0}) + ({1}) + ({2})) END::DOUBLE"


@query("residual_shortlist", f"WITH o AS (SELECT h.pattern, a.label, count(t.doc_id) AS tp, count(*) - count(t.doc_id) AS fp FROM hits h CROSS JOIN axis a LEFT JOIN pred p ON p.doc_id = h.doc_id AND p.label = a.label LEFT JOIN truth t ON t.doc_id = h.doc_id AND t.label = a.label WHERE p.doc_id IS NULL GROUP BY 1, 2), s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, count(*) AS k FROM per_label), g AS (SELECT o.pattern, o.label, o.tp, o.fp, round(0.8 * ({_f.format('l.tp + o.tp', 'l.fp + o.fp', 'l.fn - o.tp')} - {_f.format('l.tp', 'l.fp', 'l.fn')}) / s.k + 0.2 * ({_f.format('s.tp + o.tp', 's.fp + o.fp', 's.fn - o.tp')} - {_f.format('s.tp', 's.fp', 's.fn')}), 9)::DOUBLE AS gain, round(CASE WHEN o.tp + o.fp > 0 THEN o.tp / sqrt((o.tp + o.fp)::DOUBLE) ELSE 0 END, 9)::DOUBLE AS strength FROM o JOIN per_label l ON l.label = o.label CROSS JOIN s) SELECT pattern, label, tp, fp, gain, strength FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY gain DESC, pattern) AS ra, row_number() OVER (PARTITION BY label ORDER BY strength DESC, pattern) AS rb FROM g) WHERE ra <= 4 OR rb <= 2")
def residual_shortlist(spark, d):
    gains = patterns.residual_gain(_hits(spark, d), pred_of(spark, d), truth_of(spark, d), docs_of(spark, d), axis_of(spark)).withColumn("gain", F.round("gain", 9))
    return patterns.shortlist(gains, 4).withColumn("strength", F.round("strength", 9))


@query("rule_precision_laplace", "SELECT pattern, count(*) AS support, count(*) FILTER (WHERE g.sign = 1) AS correct, round((count(*) FILTER (WHERE g.sign = 1) + 1) * 1.0 / (count(*) + 2), 9)::DOUBLE AS q FROM hits h JOIN gamma g ON g.doc_id = h.doc_id AND g.label = 'toxic' GROUP BY 1")
def rule_precision_laplace(spark, d):
    c = _hits(spark, d).select(F.col("pattern").alias("rule_id"), "doc_id", F.lit("toxic").alias("label"), F.lit(1).alias("sign"))
    return review.rule_precision(c, gamma_of(spark, d)).withColumnRenamed("rule_id", "pattern").withColumn("q", F.round("q", 9))


@query("direct_rule_weight", "WITH q AS (SELECT pattern, (count(*) FILTER (WHERE toxic = 1) + 1) * 1.0 / (count(*) + 2) AS q FROM hits h JOIN labels l USING (doc_id) GROUP BY 1) SELECT doc_id, label, sign, round(weight, 9)::DOUBLE AS weight FROM (SELECT doc_id, 'toxic' AS label, 1 AS sign, max(q) AS weight FROM hits JOIN q USING (pattern) WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY 1 UNION ALL SELECT doc_id, label, sign, 1.0 FROM gamma)")
def direct_rule_weight(spark, d):
    hits = written(_hits(spark, d), "hits")  # for the precision and the facts
    c = hits.select(F.col("pattern").alias("rule_id"), "doc_id", F.lit("toxic").alias("label"), F.lit(1).alias("sign"))
    g = gamma_of(spark, d)
    return review.direct_weights(c, review.rule_precision(c, g), g).withColumn("weight", F.round("weight", 9))


@query("lineage_maxmin", f"SELECT doc_id, label, 1 AS sign, max(rho) AS rho FROM (SELECT doc_id, 'a' AS label, 0.9::DOUBLE AS rho FROM docs WHERE {_pn[1]} UNION ALL SELECT doc_id, 'a', 0.6 FROM docs WHERE {_pn[0]} UNION ALL SELECT doc_id, 'b', least(rho, 0.8) FROM (SELECT doc_id, 0.9 AS rho FROM docs WHERE {_pn[1]} UNION ALL SELECT doc_id, 0.6 FROM docs WHERE {_pn[0]})) GROUP BY 1, 2")
def lineage_maxmin(spark, d):
    rules = [Rule((Doc("x"), Text("x", has("worthless"))), Label("x", "a")), Rule((Doc("x"), Text("x", has("the"))), Label("x", "a")), Rule((Doc("x"), Label("x", "a")), Label("x", "b"))]
    return review.lineage(catalog(spark, d, gamma_of(spark, d).where("false")), rules, {0: 0.9, 1: 0.6, 2: 0.8})


@query("uncertainty_rank", "SELECT doc_id, round(avg(1 - abs(2 * p - 1)), 9) AS uncertainty FROM prob GROUP BY 1")
def uncertainty_rank(spark, d):
    return review.uncertainty(prob_of(spark, d))


def _cells(spark, d):
    g = gamma_of(spark, d).select("doc_id", "label", "sign")
    p = prob_of(spark, d).where("alias = 'm1'").join(g, ["doc_id", "label"], "left")
    pos = F.coalesce(F.col("sign") == 1, F.lit(False))
    return p.select("doc_id", "label", pos.alias("pos"), F.col("sign").isNull().alias("unknown"), F.coalesce(F.col("sign") == -1, F.lit(False)).alias("trusted"), (F.col("sign").isNotNull() & (pos != (F.col("p") >= 0.5))).alias("disagrees"), "p", F.lit(0.5).alias("cut"))


_cells_sql = "SELECT p.doc_id, p.label, p.p, coalesce(g.sign = 1, false) AS pos, g.sign IS NULL AS unk, coalesce(g.sign = -1, false) AS trusted, g.sign IS NOT NULL AND (coalesce(g.sign = 1, false) <> (p.p >= 0.5)) AS dis FROM prob p LEFT JOIN gamma g ON g.doc_id = p.doc_id AND g.label = p.label WHERE p.alias = 'm1'"


@query("review_evidence_scores", f"SELECT doc_id, round(2.0 * u + dis + (card < 1.5 AND near > 0)::INT + (card = 0)::INT + 0.05 * greatest(1.5 - card, 0) / 1.5, 9)::DOUBLE AS score FROM (SELECT doc_id, count(*) FILTER (WHERE pos) AS card, count(*) FILTER (WHERE unk) AS u, count(*) FILTER (WHERE dis) AS dis, count(*) FILTER (WHERE NOT pos AND NOT trusted AND p >= 0.8 * 0.5 AND p < 0.5) AS near FROM ({_cells_sql}) GROUP BY 1) WHERE card = 0 OR u > 0 OR dis > 0 OR (card < 1.5 AND near > 0)")
def review_evidence_scores(spark, d):
    return review.evidence_scores(docs_of(spark, d), _cells(spark, d), 1.5)


@query("review_legacy_scores", f"SELECT doc_id, round(2 * (u > 0)::INT + u / 1.5 + dis / 1.5 + greatest(1.05 - card, 0) / 1.05 + 0.1 * close, 9)::DOUBLE AS score FROM (SELECT doc_id, count(*) FILTER (WHERE pos) AS card, count(*) FILTER (WHERE unk) AS u, count(*) FILTER (WHERE dis) AS dis, avg(1 - abs(p - 0.5)) AS close FROM ({_cells_sql}) GROUP BY 1)")
def review_legacy_scores(spark, d):
    return review.legacy_scores(_cells(spark, d), 1.5)


@query("influence_one_hop", "SELECT l.doc_id, 'toxic' AS label, coalesce(c.n, 0) AS reached FROM labels l JOIN docs x USING (doc_id) LEFT JOIN (SELECT mtd_source, count(*) AS n FROM docs WHERE doc_id NOT IN (SELECT doc_id FROM truth) GROUP BY 1) c ON c.mtd_source = x.mtd_source WHERE l.toxic = 0")
def influence_one_hop(spark, d):
    cat = catalog(spark, d)
    c = close_program(cat, [])
    return influence(cat, [_copy("toxic")], c, read(spark, d, "labels").where("toxic = 0").select("doc_id", F.lit("toxic").alias("label")))


@query("feedback_weak_cells", "SELECT doc_id, label, 1 AS target, p, round(p * (1 - 0.5 * abs(p - 1)), 9) AS weight FROM (SELECT DISTINCT p.doc_id, p.label, p.p FROM hits h JOIN prob p ON p.doc_id = h.doc_id AND p.label = 'toxic' AND p.alias = 'm1' WHERE h.pattern = 'worthless' AND p.p < 0.5 AND p.doc_id NOT IN (SELECT doc_id FROM labels))")
def feedback_weak_cells(spark, d):
    logic = _hits(spark, d).where("pattern = 'worthless'").select("doc_id", F.lit("toxic").alias("label"), F.lit(1).alias("sign"))
    cuts = spark.createDataFrame([("toxic", 0.5)], "label string, cut double")
    w = review.weak_cells(logic, prob_of(spark, d).where("alias = 'm1'"), cuts, gamma_of(spark, d), docs_of(spark, d))
    return review.weighted(w, "confidence", discount=0.5).withColumn("weight", F.round("weight", 9))


@query("split_text_hash", "SELECT doc_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS role FROM (SELECT doc_id, ('0x' || substr(sha256('s' || chr(0) || sha256(regexp_replace(lower(trim(text)), '\\s+', ' ', 'g'))), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS u FROM documents)")
def split_text_hash(spark, d):
    return read(spark, d, "documents").select("doc_id", splits.text_role(F.col("text"), "s", 0.8, 0.1).alias("role"))


@query("split_group_hash", "WITH u AS (SELECT DISTINCT doc_id % 100 AS g FROM documents), r AS (SELECT g, row_number() OVER (ORDER BY sha256('[\"split\",\"rows\",0,\"' || g || '\"]')) AS k, count(*) OVER () AS n FROM u) SELECT doc_id, doc_id % 100 AS g, CASE WHEN k <= greatest(floor(n * 0.7), 1) THEN 'train' WHEN k <= greatest(floor(n * 0.7), 1) + greatest(floor(n * 0.1), 1) THEN 'dev' ELSE 'test' END AS role FROM documents JOIN r ON r.g = doc_id % 100")
def split_group_hash(spark, d):
    rows = read(spark, d, "documents").select("doc_id", (F.col("doc_id") % 100).alias("g"))
    return splits.hash_split(rows, "g", (0.7, 0.1, 0.2)).select("doc_id", "g", "role")


@query("latest_version", "SELECT user_id, min(event_type) AS event_type, max(m) AS ts, count(DISTINCT event_type) AS ties FROM (SELECT user_id, event_type, ts, max(ts) OVER (PARTITION BY user_id) AS m FROM events) WHERE ts = m GROUP BY 1")
def latest_version(spark, d):
    return splits.latest(read(spark, d, "events"), "user_id", ["ts"], "event_type")


@query("stable_cap", "SELECT doc_id FROM documents ORDER BY sha256('cap|' || doc_id) LIMIT 50")
def stable_cap(spark, d):
    return splits.stable_cap(read(spark, d, "documents").select("doc_id"), "doc_id", 50)


@query("known_rows", "SELECT doc_id FROM documents ORDER BY sha256('select|d|known|0|' || doc_id) LIMIT (SELECT ceil(count(*) / 10.0)::BIGINT FROM documents)")
def known_rows(spark, d):
    return splits.known_rows(read(spark, d, "documents").select("doc_id"), "doc_id", 1, 10)


@query("dedup_text_groups", "SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY sha256(text)")
def dedup_text_groups(spark, d):
    return read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies")).drop("h")


@query("union_find_components", "SELECT id, min(other) AS \"group\" FROM r GROUP BY 1", recursive="r AS (SELECT doc_id AS id, doc_id AS other FROM docs UNION SELECT r.id, b.doc_id FROM r JOIN docs a ON a.doc_id = r.other JOIN docs b ON (b.ttl = a.ttl AND a.ttl <> '') OR (b.cnt = a.cnt AND a.cnt <> ''))")
def union_find_components(spark, d):
    return splits.connected_groups(docs_of(spark, d).select(F.col("doc_id").alias("id"), "ttl", "cnt"), ["ttl", "cnt"], "id")


@query("holdout_audit", "SELECT count(*) FILTER (WHERE n IS NULL) AS missing, count(*) FILTER (WHERE r IS NULL) AS unknown, count(*) FILTER (WHERE n > 1) AS repeated FROM (SELECT doc_id, 1 AS r FROM documents) a FULL JOIN (SELECT doc_id, count(DISTINCT part) AS n FROM (SELECT doc_id, 'a' AS part FROM labels UNION ALL SELECT vec_id, 'b' FROM embeddings) GROUP BY 1) b ON a.doc_id = b.doc_id")
def holdout_audit(spark, d):
    parts = read(spark, d, "labels").select("doc_id", F.lit("a").alias("part")).unionByName(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit("b").alias("part")))
    return splits.holdout_audit(parts, read(spark, d, "documents"), "doc_id")


@query("sentence_split", "SELECT doc_id, count(*) AS sentences FROM (SELECT doc_id, unnest(regexp_split_to_array(regexp_replace(trim(cnt), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS s FROM docs) WHERE s <> '' GROUP BY 1")
def sentence_split(spark, d):
    return docs_of(spark, d).select("doc_id", F.size(T.sentences(F.col("cnt"))).cast("long").alias("sentences")).where("sentences > 0")


@query("number_spans", "SELECT doc_id, n AS place, s[n] AS span FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS n FROM (SELECT doc_id, regexp_extract_all(cnt, '\\b[0-9]+(?:[.,:/-][0-9]+)*(?:%|[A-Za-z]{1,3})?\\b') AS s FROM docs))")
def number_spans(spark, d):
    return docs_of(spark, d).select("doc_id", F.posexplode(T.number_spans(F.col("cnt"))).alias("place", "span")).select("doc_id", (F.col("place") + 1).cast("long").alias("place"), "span")


_title = r"WITH t AS (SELECT doc_id, list_slice(string_split(regexp_replace(ttl, '(\p{L}+)', chr(1) || '\1' || chr(2), 'g'), chr(1)), 2, 100000) AS p FROM docs), u AS (SELECT doc_id, unnest(p) AS x, unnest(range(len(p))) AS i FROM t), w AS (SELECT doc_id, i, lower(split_part(x, chr(2), 1)) AS a, regexp_full_match(split_part(x, chr(2), 2), '\s+') AS g FROM u), l AS (SELECT *, lead(a) OVER v AS a2, lead(g) OVER v AS g2, lead(a, 2) OVER v AS a3 FROM w WINDOW v AS (PARTITION BY doc_id ORDER BY i)), s AS (SELECT * FROM l WHERE length(a) >= 2 AND a NOT IN ('the', 'and'))"


@query("title_ngrams", _title + " SELECT doc_id, ngram, count(*) AS n FROM (SELECT doc_id, a AS ngram FROM s UNION ALL SELECT doc_id, a || ' ' || a2 FROM s WHERE a2 IS NOT NULL AND g UNION ALL SELECT doc_id, a || ' ' || a2 || ' ' || a3 FROM s WHERE a3 IS NOT NULL AND g AND g2) GROUP BY 1, 2")
def title_ngrams(spark, d):
    return docs_of(spark, d).select("doc_id", F.explode(T.title_terms(F.col("ttl"), ("the", "and"))).alias("ngram")).groupBy("doc_id", "ngram").agg(F.count(F.lit(1)).alias("n"))


@query("title_pairs", _title + ", n AS (SELECT doc_id, a, lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM s) SELECT DISTINCT doc_id, family, CASE WHEN family = 'Cooccur' THEN least(a, b) ELSE a END AS a, CASE WHEN family = 'Cooccur' THEN greatest(a, b) ELSE b END AS b FROM n CROSS JOIN (SELECT unnest(['Cooccur', 'Before']) AS family) WHERE b IS NOT NULL AND a <> b")
def title_pairs(spark, d):
    return docs_of(spark, d).select("doc_id", F.explode(T.title_pairs(F.col("ttl"), ("the", "and"))).alias("p")).select("doc_id", "p.*")


@query("tfidf_top_terms", "WITH t AS (SELECT doc_id, lang AS cluster, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS token FROM documents), tf AS (SELECT doc_id, cluster, token, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), s AS (SELECT tf.cluster, token, round(sum(tf * (ln(((SELECT count(*) FROM documents) + 1) / (df + 1)) + 1)) / max(z.n), 6) AS score FROM tf JOIN df USING (token) JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY 1) z ON z.lang = tf.cluster GROUP BY 1, 2) SELECT cluster, token, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY score DESC, token) AS r FROM s) WHERE r <= 10")
def tfidf_top_terms(spark, d):
    raw = read(spark, d, "documents")
    return patterns.tfidf_top(raw, "lang", "text", 10).select("cluster", "token", F.round("score", 4).alias("score"))


@query("xml_field_extract", "SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '(?s)<title>(.*?)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&apos;', ''''), '&amp;', '&') AS title FROM pages")
def xml_field_extract(spark, d):
    return read(spark, d, "pages").select("page_id", T.xml_field(F.col("html"), "title").alias("title"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 6) AS value FROM events GROUP BY 1, 2")
def event_windows(spark, d):
    return windowed_counts(read(spark, d, "events"))


@query("candidate_scores", "SELECT row_number() OVER (ORDER BY list_position(['worthless', 'idiot', 'scum', 'trash', 'the', 'and'], pattern))::INT - 1 AS rule_id, 'toxic' AS label, tp, fp, round(2.0 * tp / (tp + fp + pos), 9)::DOUBLE AS f1 FROM (SELECT pattern, count(*) FILTER (WHERE t.doc_id IS NOT NULL) AS tp, count(*) FILTER (WHERE t.doc_id IS NULL) AS fp, (SELECT count(*) FROM truth WHERE label = 'toxic') AS pos FROM hits h LEFT JOIN truth t ON t.doc_id = h.doc_id AND t.label = 'toxic' GROUP BY 1)")
def candidate_scores(spark, d):
    from marlstone.operators.discovery import score_rules

    rules = [Rule((Doc("x"), Text("x", has(w))), Label("x", "toxic")) for w in PATTERNS]
    return score_rules(catalog(spark, d), rules, truth_of(spark, d), axis_of(spark)).withColumn("f1", F.round("f1", 9))