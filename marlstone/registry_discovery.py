"""Queries with their SQL: deltas, batches of candidates, relations by components, enumeration, witnesses, staged discovery, sessions."""

from __future__ import annotations

import json
from itertools import combinations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.text import predicate
from marlstone.operators import analytic, batch, discovery, enumeration, learning, relations, reliability, space, staged
from marlstone.operators.closure import close_program, hide
from marlstone.operators.loop import denial_cuts as loop_denials
from marlstone.operators.loop import joint_cuts, residual_cuts
from marlstone.operators.proof import support_counts
from marlstone.operators.session import FactLog, rule_key
from marlstone.plans.rules import ML, AttrEqual, Doc, Label, LabelCompare, Rule, Text, rule_to
from marlstone.registry import GRID, axis_of, catalog, docs_of, gamma_of, has, query, read, scores_of, truth_of

WORDS = ("worthless", "idiot", "scum", "trash", "the", "and")


def _copy(label: str, attr: str, head: str | None = None) -> Rule:
    return Rule((Doc("x"), Doc("y"), AttrEqual("x", attr, "y", attr), Label("y", label)), Label("x", head or label))


def _model(alias: str, label: str, cut: float, head: str) -> Rule:
    return Rule((Doc("x"), ML("x", alias, label, cut)), Label("x", head))


def _empty(spark, d):
    """The catalog without validated facts."""
    return catalog(spark, d, gamma_of(spark, d).where("false"))


# --- deltas ---------------------------------------------------------------------------------------------------------

_g = "SELECT doc_id FROM prob WHERE alias = 'm1' AND label = 'quality' AND p >= 0.7"
_f = "SELECT doc_id FROM prob WHERE alias = 'm2' AND label = 'toxic' AND p >= 0.7"
_b = f"SELECT a.doc_id FROM docs a WHERE a.doc_id IN ({_g}) AND a.ttl <> '' AND a.ttl IN (SELECT ttl FROM docs WHERE doc_id IN ({_f}))"


@query("delta_two_premises", f"SELECT doc_id, 'good' AS label, 1 AS sign FROM ({_g}) UNION ALL SELECT doc_id, 'flag', 1 FROM ({_f}) UNION ALL SELECT doc_id, 'both', 1 FROM ({_b}) UNION ALL SELECT doc_id, 'top', 1 FROM docs WHERE doc_id IN ({_f}) AND mtd_source IN (SELECT mtd_source FROM docs WHERE doc_id IN ({_b})) AND mtd_lang IN (SELECT mtd_lang FROM docs WHERE doc_id IN ({_g}))")
def delta_two_premises(spark, d):
    two = Rule((Doc("x"), Doc("y"), AttrEqual("x", "ttl", "y", "ttl"), Label("x", "good"), Label("y", "flag")), Label("x", "both"))
    three = Rule((Doc("x"), Doc("y"), Doc("z"), AttrEqual("x", "mtd.source", "y", "mtd.source"), AttrEqual("x", "mtd.lang", "z", "mtd.lang"), Label("x", "flag"), Label("y", "both"), Label("z", "good")), Label("x", "top"))
    return close_program(_empty(spark, d), [_model("m1", "quality", 0.7, "good"), _model("m2", "toxic", 0.7, "flag"), two, three]).facts


_step = """SELECT a.doc_id, r.label, 1 FROM r JOIN docs b ON b.doc_id = r.doc_id JOIN docs a ON
  (a.mtd_source = b.mtd_source AND a.mtd_lang = b.mtd_lang AND regexp_matches(a.cnt, '{0}') AND regexp_matches(b.cnt, '{0}'))
  OR (a.mtd_lang = b.mtd_lang AND regexp_matches(b.cnt, '{1}') AND regexp_matches(a.cnt, '{2}'))""".format(*(rf"(^|[^A-Za-z0-9_]){w}([^A-Za-z0-9_]|$)" for w in ("the", "worthless", "and")))


@query("equal_block_closure", "SELECT doc_id, label, sign FROM r", recursive=f"r AS (SELECT doc_id, label, 1 AS sign FROM gamma WHERE sign = 1 UNION {_step})")
def equal_block_closure(spark, d):
    """Documents of one source and language with a common word are equal; those with one word are within those with another."""
    equal = Rule((Doc("x"), Doc("y"), AttrEqual("x", "mtd.source", "y", "mtd.source"), AttrEqual("x", "mtd.lang", "y", "mtd.lang"), Text("x", has("the")), Text("y", has("the"))), LabelCompare("x", "eq", "y"))
    within = Rule((Doc("x"), Doc("y"), AttrEqual("x", "mtd.lang", "y", "mtd.lang"), Text("x", has("worthless")), Text("y", has("and"))), LabelCompare("x", "subset", "y"))
    return close_program(catalog(spark, d, gamma_of(spark, d).where("sign = 1")), [equal, within]).facts


# --- batches of candidates ------------------------------------------------------------------------------------------

_seed = "SELECT doc_id FROM prob WHERE alias = 'm1' AND label = 'toxic' AND p >= 0.95"
_closed = "SELECT {k} AS k, doc_id FROM ({s}) UNION SELECT {k}, a.doc_id FROM docs a WHERE a.ttl <> '' AND a.ttl IN (SELECT ttl FROM docs WHERE doc_id IN ({s}))"
_sets = " UNION ALL ".join([_closed.format(k=-1, s=_seed), *[_closed.format(k=i, s=f"SELECT doc_id FROM hits WHERE pattern = '{w}'") for i, w in enumerate(WORDS)]])
#: Label quality is never predicted, so macro F1 is half of toxic's F1.
_macro = "2.0 * count(DISTINCT t.doc_id) / (count(DISTINCT s.doc_id) + (SELECT count(*) FROM truth WHERE label = 'toxic')) / 2"
_masks = f"sets AS ({_sets}), masks AS (SELECT unnest(range(0, 64)) AS m), scored AS (SELECT m.m, {_macro} AS macro FROM masks m LEFT JOIN sets s ON (s.k = -1 OR (m.m >> s.k) & 1 = 1) AND s.doc_id IN (SELECT doc_id FROM labels) LEFT JOIN truth t ON t.doc_id = s.doc_id AND t.label = 'toxic' GROUP BY m.m)"
_prefix = [_model("m1", "toxic", 0.95, "toxic"), _copy("toxic", "ttl")]


def _word_rules():
    return [Rule((Doc("x"), Text("x", has(w))), Label("x", "toxic")) for w in WORDS]


@query("batch_candidates", f"WITH {_masks} SELECT i.k AS run, 'fixpoint' AS status, round(a.macro, 9)::DOUBLE AS macro_f1, round(a.macro - b.macro, 9)::DOUBLE AS gain FROM (SELECT unnest(range(0, 6)) AS k) i JOIN scored a ON a.m = 1 << i.k JOIN scored b ON b.m = 0")
def batch_candidates(spark, d):
    cat = _empty(spark, d).with_keys(_prefix)
    b = batch.close_batch(cat, _prefix, _word_rules(), close_program(cat, _prefix))
    s = batch.batch_scores(b, truth_of(spark, d), axis_of(spark), read(spark, d, "labels"))
    return s.select("run", "status", F.round("macro_f1", 9).alias("macro_f1"), F.round("gain", 9).alias("gain"))


@query("batch_admission", f"SELECT k AS candidate, taken, round(macro, 9)::DOUBLE AS macro_f1 FROM (SELECT r.k - 1 AS k, r.taken, s.macro FROM r JOIN scored s ON s.m = r.m WHERE r.k > 0)",
       recursive=f"{_masks}, r AS (SELECT 0 AS k, 0::BIGINT AS m, false AS taken UNION ALL SELECT r.k + 1, CASE WHEN n.macro > o.macro THEN n.m ELSE r.m END, n.macro > o.macro FROM r JOIN scored o ON o.m = r.m JOIN scored n ON n.m = r.m | (1::BIGINT << r.k) WHERE r.k < 6)")
def batch_admission(spark, d):
    """Which candidates are admitted in their order, and macro F1 after each."""
    cat, rules = _empty(spark, d).with_keys(_prefix), _word_rules()
    got = batch.admit(cat, rules, list(range(len(rules))), truth_of(spark, d), axis_of(spark), prefix=_prefix, docs=read(spark, d, "labels"))
    return spark.createDataFrame(got.trace, "candidate int, taken boolean, macro_f1 double").withColumn("macro_f1", F.round("macro_f1", 9))


@query("standalone_scores", "SELECT i.k::INTEGER AS rule_id, 'fixpoint' AS status, round(2.0 * count(DISTINCT t.doc_id) / (count(DISTINCT s.doc_id) + (SELECT count(*) FROM truth WHERE label = 'toxic')) / 2, 9)::DOUBLE AS score FROM (SELECT unnest(range(0, 6)) AS k, unnest(['worthless', 'idiot', 'scum', 'trash', 'the', 'and']) AS w) i LEFT JOIN hits s ON s.pattern = i.w AND s.doc_id IN (SELECT doc_id FROM labels) LEFT JOIN truth t ON t.doc_id = s.doc_id AND t.label = 'toxic' GROUP BY i.k")
def standalone_scores(spark, d):
    return batch.standalone(_empty(spark, d), _word_rules(), truth_of(spark, d), axis_of(spark), read(spark, d, "labels")).select("rule_id", "status", F.round("score", 9).alias("score"))


_pairs = [*combinations(range(len(WORDS)), 2)]
_an = " UNION ALL ".join(f"SELECT {i} AS program, '{WORDS[a]}' AS pattern, 'toxic' AS label UNION ALL SELECT {i}, '{WORDS[b]}', 'quality'" for i, (a, b) in enumerate(_pairs))
_anf = "CASE WHEN coalesce(p.n, 0) + t.n = 0 THEN 0 ELSE 2.0 * coalesce(p.tp, 0) / (coalesce(p.n, 0) + t.n) END"


@query("analytic_programs", f"WITH pr AS ({_an}), p AS (SELECT pr.program, pr.label, count(DISTINCT h.doc_id) AS n, count(DISTINCT g.doc_id) AS tp FROM pr JOIN hits h ON h.pattern = pr.pattern AND h.doc_id IN (SELECT doc_id FROM labels) LEFT JOIN truth g ON g.doc_id = h.doc_id AND g.label = pr.label GROUP BY 1, 2), t AS (SELECT a.label, count(g.doc_id) AS n FROM axis a LEFT JOIN truth g ON g.label = a.label GROUP BY 1), f AS (SELECT pr.program, count(DISTINCT (h.doc_id, pr.label)) AS facts FROM pr LEFT JOIN hits h ON h.pattern = pr.pattern GROUP BY 1) SELECT i.program, 'fixpoint' AS status, round(avg({_anf}), 9)::DOUBLE AS macro_f1, max(f.facts) AS facts FROM (SELECT DISTINCT program FROM pr) i CROSS JOIN t LEFT JOIN p ON p.program = i.program AND p.label = t.label JOIN f ON f.program = i.program GROUP BY 1")
def analytic_programs(spark, d):
    """All programs of one word for toxic and another for quality, by bitmaps."""
    rules = [Rule((Doc("x"), Text("x", has(w))), Label("x", x)) for w in WORDS for x in ("toxic", "quality")]
    programs = spark.createDataFrame([(i, r) for i, (a, b) in enumerate(_pairs) for r in (2 * a, 2 * b + 1)], "program int, rule int")
    cat = _empty(spark, d)
    got = analytic.evaluate(analytic.rule_bits(cat, rules), programs, cat.gamma, truth_of(spark, d), axis_of(spark), read(spark, d, "labels"))
    return got.select("program", "status", F.round("macro_f1", 9).alias("macro_f1"), "facts")


# --- enumeration ----------------------------------------------------------------------------------------------------

_fitn = "(SELECT count(*) FROM labels)"
_hist = "SELECT {k}, o.label, count(*) AS c FROM {src} JOIN truth o ON o.doc_id = s.doc_id GROUP BY {g}, o.label"
_enum = f"""WITH words AS (SELECT doc_id, unnest(w) AS anchor, unnest(range(0, len(w))) AS place FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))),
occ0 AS (SELECT doc_id, anchor, count(*) AS n, min(place) AS first FROM words GROUP BY 1, 2),
occ AS (SELECT * FROM occ0 WHERE anchor IN (SELECT anchor FROM occ0 GROUP BY 1 HAVING count(*) >= {_fitn} * 0.2)),
there AS (SELECT doc_id FROM documents WHERE text <> '' AND doc_id IN (SELECT doc_id FROM labels)),
etas AS (SELECT anchor, unnest(range(0, max(n) + 2)) AS eta FROM occ GROUP BY 1),
ops AS (SELECT unnest(['==', '!=', '<', '<=', '>', '>=']) AS op),
levels AS (SELECT s.anchor, s.n, count(*) AS c, count(*) FILTER (WHERE q.doc_id IS NOT NULL) AS q, count(*) FILTER (WHERE x.doc_id IS NOT NULL) AS x FROM (SELECT anchor, doc_id, n FROM occ UNION ALL SELECT a.anchor, t.doc_id, 0 FROM (SELECT DISTINCT anchor FROM occ) a CROSS JOIN there t WHERE NOT EXISTS (SELECT 1 FROM occ o WHERE o.anchor = a.anchor AND o.doc_id = t.doc_id)) s LEFT JOIN truth q ON q.doc_id = s.doc_id AND q.label = 'quality' LEFT JOIN truth x ON x.doc_id = s.doc_id AND x.label = 'toxic' GROUP BY 1, 2),
freq AS (SELECT e.anchor, o.op, e.eta, sum(l.c) AS support, sum(l.q) AS q, sum(l.x) AS x FROM etas e CROSS JOIN ops o LEFT JOIN levels l ON l.anchor = e.anchor AND CASE o.op WHEN '==' THEN l.n = e.eta WHEN '!=' THEN l.n <> e.eta WHEN '<' THEN l.n < e.eta WHEN '<=' THEN l.n <= e.eta WHEN '>' THEN l.n > e.eta ELSE l.n >= e.eta END GROUP BY 1, 2, 3),
strong AS (SELECT anchor FROM occ GROUP BY 1 HAVING count(*) >= ceil({_fitn} * 0.2 - 1e-9)),
met AS (SELECT a.doc_id, a.anchor, b.anchor AS other, a.first AS fa, b.first AS fb FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND a.anchor < b.anchor WHERE a.anchor IN (FROM strong) AND b.anchor IN (FROM strong)),
enough AS (SELECT anchor, other FROM met GROUP BY 1, 2 HAVING count(*) >= ceil({_fitn} * 0.2 - 1e-9)),
placed AS (SELECT m.* FROM met m JOIN enough USING (anchor, other)),
pairs AS (SELECT 'cooccur' AS family, anchor, other, doc_id FROM placed UNION ALL SELECT 'before', anchor, other, doc_id FROM placed WHERE fa < fb UNION ALL SELECT 'before', other, anchor, doc_id FROM placed WHERE fb < fa),
two AS (SELECT family, anchor, other, count(*) AS support, count(*) FILTER (WHERE q.doc_id IS NOT NULL) AS q, count(*) FILTER (WHERE x.doc_id IS NOT NULL) AS x FROM pairs s LEFT JOIN truth q ON q.doc_id = s.doc_id AND q.label = 'quality' LEFT JOIN truth x ON x.doc_id = s.doc_id AND x.label = 'toxic' GROUP BY 1, 2, 3),
rows AS (SELECT 'match' AS family, anchor, NULL AS other, NULL AS op, NULL::BIGINT AS eta, coalesce(support, 0) AS support, coalesce(q, 0) AS q, coalesce(x, 0) AS x FROM freq WHERE op = '>=' AND eta = 1
  UNION ALL SELECT 'freq', anchor, NULL, op, eta, coalesce(support, 0), coalesce(q, 0), coalesce(x, 0) FROM freq UNION ALL SELECT family, anchor, other, NULL, NULL, support, q, x FROM two),
e AS (SELECT *, CASE WHEN q + x = 0 THEN 0 ELSE CASE WHEN q > 0 THEN -(q / (q + x)) * ln(q / (q + x)) ELSE 0 END + CASE WHEN x > 0 THEN -(x / (q + x)) * ln(x / (q + x)) ELSE 0 END END AS h FROM (SELECT family, anchor, other, op, eta, support, q::DOUBLE AS q, x::DOUBLE AS x FROM rows))
SELECT family, anchor, other, op, coalesce(eta, -1)::BIGINT AS eta, support::BIGINT AS support, round(support / {_fitn}::DOUBLE, 9) AS coverage, round(h, 6) AS entropy,
  CASE WHEN support / {_fitn}::DOUBLE < 0.2 THEN 'below_min_coverage' WHEN support / {_fitn}::DOUBLE > 0.9 THEN 'above_max_coverage' WHEN round(h, 6) >= 0.4 THEN 'entropy' ELSE 'accepted' END AS reason FROM e"""


@query("pattern_enumeration", _enum)
def pattern_enumeration(spark, d):
    docs, fit = docs_of(spark, d), read(spark, d, "labels").select("doc_id")
    occ = enumeration.occurrences(docs, "cnt", 0.2, fit)
    rows = enumeration.enumerate_patterns(occ, docs, "cnt", truth_of(spark, d), fit, axis_of(spark), 0.2, 0.9, 0.4)
    # Entropies at the threshold are equal to six places only.
    reason = F.when(F.col("reason").isin("entropy", "accepted"), F.when(F.round("entropy", 6) >= 0.4, "entropy").otherwise("accepted")).otherwise(F.col("reason"))
    return rows.select("family", "anchor", "other", "op", F.coalesce("eta", F.lit(-1)).alias("eta"), "support", F.round("coverage", 9).alias("coverage"), F.round("entropy", 6).alias("entropy"), reason.alias("reason"))


# --- space, witnesses, staged discovery -----------------------------------------------------------------------------


def _space() -> space.Space:
    return space.Space(("quality", "toxic"), (("m1", "quality"), ("m1", "toxic"), ("m2", "toxic")), {w: has(w) for w in ("worthless", "the")}, ("ttl",), tuple(k / 10 for k in range(1, 10)))


_cuts10 = "SELECT unnest(range(1, 10)) / 10.0::DOUBLE AS cut"
_guards = "SELECT doc_id, NULL AS guard FROM docs UNION ALL SELECT doc_id, pattern FROM hits WHERE pattern IN ('worthless', 'the')"
_wit = f"""SELECT a.label AS head, p.alias, p.label, c.cut, g.guard, count(*) AS support, count(t.doc_id) AS tp, max(n.pos) AS pos FROM prob p JOIN ({_cuts10}) c ON p.p >= c.cut JOIN ({_guards}) g ON g.doc_id = p.doc_id
JOIN labels l ON l.doc_id = p.doc_id CROSS JOIN axis a LEFT JOIN truth t ON t.doc_id = p.doc_id AND t.label = a.label LEFT JOIN (SELECT label, count(*) AS pos FROM truth GROUP BY 1) n ON n.label = a.label
WHERE (p.alias, p.label) IN (('m1', 'quality'), ('m1', 'toxic'), ('m2', 'toxic')) GROUP BY 1, 2, 3, 4, 5"""
_witf = "CASE WHEN support + pos = 0 THEN 0 ELSE 2.0 * tp / (support + pos) END"


@query("fit_witnesses", f"SELECT head, alias, label, cut, guard, support, tp, coalesce(pos, 0) AS pos, round(tp / support::DOUBLE, 9) AS precision, round({_witf}, 9)::DOUBLE AS f1 FROM ({_wit})")
def fit_witnesses(spark, d):
    w = space.witnesses(_empty(spark, d), _space(), truth_of(spark, d), read(spark, d, "labels"))
    return w.select("head", "alias", "label", "cut", "guard", "support", "tp", "pos", F.round("precision", 9).alias("precision"), F.round("f1", 9).alias("f1"))


@query("fit_starts", f"WITH w AS (SELECT *, round({_witf}, 12) AS f, round(tp / support::DOUBLE, 12) AS pr FROM ({_wit}) WHERE tp >= 1), b AS (SELECT *, row_number() OVER (PARTITION BY head, alias, label, guard ORDER BY f DESC, pr DESC, cut DESC) AS r FROM w), t AS (SELECT *, row_number() OVER (PARTITION BY head ORDER BY f DESC, pr DESC, alias, label, guard NULLS FIRST) AS turn FROM b WHERE r = 1) SELECT row_number() OVER (ORDER BY turn, head)::INTEGER AS place, head, alias, label, guard, cut, round(f, 9)::DOUBLE AS f1 FROM t ORDER BY turn, head LIMIT 30")
def fit_starts(spark, d):
    w = space.witnesses(_empty(spark, d), _space(), truth_of(spark, d), read(spark, d, "labels"))
    return space.starts(w).select("place", "head", "alias", "label", "guard", "cut", F.round("f1", 9).alias("f1"))


@query("staged_discovery")
def staged_discovery(spark, d):
    """step, kind, value, macro F1 on the two splits: rules of the best starts and words, accepted on two halves of the labelled documents."""
    cat, truth = _empty(spark, d), truth_of(spark, d)
    fit = read(spark, d, "labels").select("doc_id", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2).alias("half"))
    found = space.start_rules(_space(), space.starts(space.witnesses(cat, _space(), truth, fit), 4))
    got = staged.discover(cat, [*found, *_word_rules()[:3]], [has("worthless")], truth, axis_of(spark), fit.where("half = 0"), fit.where("half = 1"))
    return spark.createDataFrame([(i, c.kind, v, g, p) for i, (c, v, g, p) in enumerate(got.trace)], "step int, kind string, value double, grow double, prune double")


@query("joint_cuts")
def joint_residual_cuts(spark, d):
    cells = scores_of(spark, d).select("doc_id", "label", "p", (F.col("target") == 1).alias("target")).withColumn("old", F.pmod(F.col("doc_id") * 7 + F.length("label"), F.lit(10)) >= 5)
    return joint_cuts(cells, residual_cuts(cells, GRID, GRID, 1, 0.5))


# --- sessions, hidden facts, supports, influence --------------------------------------------------------------------

_ttl = "SELECT doc_id FROM ({0}) UNION SELECT a.doc_id FROM docs a WHERE a.ttl <> '' AND a.ttl IN (SELECT ttl FROM docs WHERE doc_id IN ({0}))"
_v0, _tox = _ttl.format(_g), "SELECT doc_id FROM labels WHERE toxic = 1"


@query("fact_log", f"SELECT doc_id, 'good' AS label, 1 AS sign, 0 AS version, 'start' AS origin FROM ({_v0}) UNION ALL SELECT doc_id, 'good', 1, 1, 'toxic' FROM ({_ttl.format(_tox)}) WHERE doc_id NOT IN ({_v0})")
def fact_log(spark, d):
    """A committed fork, after a rejected one that contradicts the start and left nothing."""
    log = FactLog(_empty(spark, d), [_model("m1", "quality", 0.7, "good"), _copy("good", "ttl")])
    say = lambda label, sign: read(spark, d, "labels").where(f"{label} = 1").select("doc_id", F.lit("good").alias("label"), F.lit(sign).alias("sign"))
    bad = log.fork(say("quality", -1), origin="denied")
    log.rollback(bad)
    log.commit(log.fork(say("toxic", 1), origin="toxic"))
    return log.facts()


@query("hidden_cells", "SELECT doc_id, 'good' AS label, 1 AS sign FROM r", recursive=f"r AS (SELECT doc_id FROM ({_g}) WHERE doc_id NOT IN (SELECT doc_id FROM docs WHERE mtd_lang = 'en') UNION SELECT a.doc_id FROM r JOIN docs b ON b.doc_id = r.doc_id JOIN docs a ON a.ttl = b.ttl AND a.ttl <> '' AND a.mtd_lang IS DISTINCT FROM 'en')")
def hidden_cells(spark, d):
    """What is left of a closure if one language's cells are unknown."""
    cat, rules = _empty(spark, d), [_model("m1", "quality", 0.7, "good"), _copy("good", "ttl")]
    cells = docs_of(spark, d).where("mtd_lang = 'en'").select("doc_id", F.lit("good").alias("label"))
    return hide(cat, rules, close_program(cat, rules), cells).facts


@query("support_counts", f"WITH g AS ({_v0}) SELECT doc_id, 'good' AS label, 1 AS sign, 0 AS rule_id, 1::BIGINT AS ways FROM ({_g}) UNION ALL SELECT a.doc_id, 'good', 1, 1, count(*) FROM docs a JOIN docs b ON a.ttl = b.ttl AND a.ttl <> '' AND b.doc_id IN (SELECT doc_id FROM g) GROUP BY a.doc_id")
def fact_supports(spark, d):
    cat, rules = _empty(spark, d), [_model("m1", "quality", 0.7, "good"), _copy("good", "ttl")]
    return support_counts(cat, rules, close_program(cat, rules).facts).select("doc_id", "label", "sign", "rule_id", F.col("ways").cast("long").alias("ways"))


_reach = "SELECT h.doc_id AS h, a.doc_id FROM hyp h JOIN docs x ON x.doc_id = h.doc_id JOIN docs a ON a.doc_id = h.doc_id OR (a.ttl = x.ttl AND a.ttl <> '')"


@query("influence_hops", f"WITH hyp AS (SELECT doc_id FROM docs WHERE mtd_lang = 'fr' AND doc_id NOT IN (SELECT doc_id FROM labels)), t AS ({_reach}), u AS (SELECT h, doc_id FROM t UNION SELECT t.h, b.doc_id FROM t JOIN docs a ON a.doc_id = t.doc_id JOIN docs b ON a.cnt = b.cnt AND b.cnt <> ''), base AS (SELECT doc_id FROM truth), bt AS (SELECT doc_id FROM base WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION SELECT a.doc_id FROM docs a WHERE a.ttl <> '' AND a.ttl IN (SELECT ttl FROM docs WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1))), covered AS (SELECT doc_id FROM base UNION SELECT doc_id FROM bt UNION SELECT doc_id FROM docs WHERE cnt <> '' AND cnt IN (SELECT cnt FROM docs WHERE doc_id IN (SELECT doc_id FROM bt))) SELECT hyp.doc_id, 'toxic' AS label, 'fixpoint' AS status, count(DISTINCT u.doc_id) FILTER (WHERE u.doc_id NOT IN (SELECT doc_id FROM covered)) AS reached FROM hyp JOIN u ON u.h = hyp.doc_id GROUP BY 1")
def influence_hops(spark, d):
    """What labels of French documents without an answer would reach, over two hops."""
    cat, rules = catalog(spark, d, gamma_of(spark, d).where("sign = 1")), [_copy("toxic", "ttl"), _copy("toxic", "cnt", "flag")]
    asked = docs_of(spark, d).where("mtd_lang = 'fr'").join(read(spark, d, "labels"), "doc_id", "left_anti").select("doc_id", F.lit("toxic").alias("label"))
    return batch.influence(cat, rules, close_program(cat, rules), asked)


# --- feasibility ----------------------------------------------------------------------------------------------------

_chain = "SELECT doc_id, mtd_source AS g, row_number() OVER (PARTITION BY mtd_source ORDER BY doc_id) AS k, 0 AS part FROM docs WHERE regexp_matches(cnt, '(^|[^A-Za-z0-9_])worthless([^A-Za-z0-9_]|$)') AND mtd_source IS NOT NULL"
_link = f"c AS ({_chain}), e AS (SELECT a.g, a.part, a.k, a.doc_id AS s, b.doc_id AS t FROM c a JOIN c b ON a.g = b.g AND a.part = b.part AND b.k = a.k + 1)"
# A label can make the step from k strict if no document up to k has it, and none from k + 1 on is denied it.
_can = "NOT EXISTS (SELECT 1 FROM c x JOIN gamma y ON y.doc_id = x.doc_id AND y.label = '{0}' WHERE x.g = e.g AND x.part = e.part AND ((y.sign = 1 AND x.k <= e.k) OR (y.sign = -1 AND x.k > e.k)))"


@query("infeasible_chains", f"WITH {_link}, w AS (SELECT e.*, {_can.format('quality')} AS q, {_can.format('toxic')} AS x, (SELECT count(*) FROM e f WHERE f.g = e.g AND f.part = e.part) AS m FROM e), ok AS (SELECT g, part, max(m) AS m, bool_and(q OR x) AS each_, count(*) FILTER (WHERE q) AS nq, count(*) FILTER (WHERE x) AS nx FROM w GROUP BY 1, 2), d AS (SELECT x.g, x.part FROM c x JOIN gamma p ON p.doc_id = x.doc_id AND p.sign = 1 JOIN c y ON y.g = x.g AND y.part = x.part AND y.k >= x.k JOIN gamma n ON n.doc_id = y.doc_id AND n.label = p.label AND n.sign = -1) SELECT c.doc_id AS v FROM c JOIN ok ON ok.g = c.g AND ok.part = c.part WHERE (c.g, c.part) IN (SELECT (g, part) FROM d) OR m > 2 OR NOT each_ OR (m = 2 AND (nq = 0 OR nx = 0))")
def infeasible_chains(spark, d):
    """Strict chains of documents of a source with a word: what no completion of the answers can meet. A label can part a chain once, so two
    labels allow two steps."""
    w = Window.partitionBy("mtd_source").orderBy("doc_id")
    rows = docs_of(spark, d).where("mtd_source is not null").where(predicate(has("worthless"), F.col("cnt"))).select("doc_id", "mtd_source")
    edges = rows.withColumn("dst", F.lead("doc_id").over(w)).where("dst is not null").select(F.col("doc_id").alias("src"), "dst", F.lit(True).alias("strict"))
    return relations.infeasible(edges, gamma_of(spark, d), ("quality", "toxic")).select("v")


# --- the loop that learns -------------------------------------------------------------------------------------------


@query("learning_loop")
def learned(spark, d):
    """The rounds of the loop that learns: a fifth of the labelled documents calibrates, the answers of the others are asked for."""
    answers = gamma_of(spark, d)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    held, rest = answers.where(fold == 0), read(spark, d, "labels").where(fold != 0).select("doc_id")
    probs = catalog(spark, d).model_prob.where("alias = 'm1'")
    rule = Rule((Doc("x"), ML("x", "m1", "quality", 0.6)), Label("x", "quality"))
    got = learning.learning_loop(_empty(spark, d), [rule], axis_of(spark), probs, lambda asked: answers.join(asked, "doc_id", "left_semi"), 64, held, train=rest, how=learning.Settings(batch=32))
    return spark.createDataFrame([(i, e.kind, e.kept, e.n, e.pending, e.macro, got.status) for i, e in enumerate(got.events)], "step int, kind string, kept boolean, n int, pending int, macro_f1 double, status string")


# --- reliability, refiltering, denials ------------------------------------------------------------------------------

_dig = "regexp_replace(lower(trim(cnt)), '\\s+', ' ', 'g')"


@query("rule_reliability", f"WITH train AS (SELECT doc_id FROM docs WHERE mtd_lang = 'en'), ok AS (SELECT g.* FROM gamma g JOIN docs d ON d.doc_id = g.doc_id WHERE g.doc_id NOT IN (SELECT doc_id FROM train) AND {_dig} NOT IN (SELECT {_dig} FROM docs WHERE doc_id IN (SELECT doc_id FROM train) AND cnt IS NOT NULL)), i AS (SELECT unnest(['worthless', 'idiot', 'scum', 'trash', 'the', 'and']) AS pattern) SELECT i.pattern, count(g.doc_id) AS support, count(g.doc_id) FILTER (WHERE g.sign = 1) AS correct, round((count(g.doc_id) FILTER (WHERE g.sign = 1) + 1) / (count(g.doc_id) + 2)::DOUBLE, 9) AS q, (SELECT count(DISTINCT doc_id) FROM ok) AS rows FROM i LEFT JOIN hits h ON h.pattern = i.pattern LEFT JOIN ok g ON g.doc_id = h.doc_id AND g.label = 'toxic' GROUP BY i.pattern")
def rule_reliability(spark, d):
    """Word rules counted on labelled documents of other languages than the one trained on, and of other texts."""
    cat, rules = _empty(spark, d), _word_rules()
    got = reliability.estimate(cat, rules, close_program(cat, []), gamma_of(spark, d), docs_of(spark, d).where("mtd_lang = 'en'"))
    names = spark.createDataFrame([(rule_key(r), w) for r, w in zip(rules, WORDS, strict=True)], "rule_key string, pattern string")
    return got.join(names, "rule_key").select("pattern", "support", "correct", F.round("q", 9).alias("q"), "rows")


_den = "SELECT h.pattern AS context, g.label, p.p, (g.sign = 1)::INT AS t FROM hits h JOIN gamma g ON g.doc_id = h.doc_id JOIN prob p ON p.doc_id = g.doc_id AND p.label = g.label AND p.alias = 'm1'"


@query("denial_cuts", f"WITH c AS ({_den}), w AS (SELECT context, label FROM c GROUP BY 1, 2 HAVING avg(t) < 0.9), n AS (SELECT c.context, c.label, g.cut, count(*) AS n, count(*) FILTER (WHERE t = 0) AS f FROM c JOIN w ON w.context = c.context AND w.label = c.label JOIN grid g ON c.p <= g.cut GROUP BY 1, 2, 3) SELECT context, label, max(cut) AS cut, arg_max(n, cut) AS n, arg_max(f, cut) AS \"false\" FROM n WHERE n >= 3 AND f >= 0.15 * n AND f - (n - f) >= -500 GROUP BY 1, 2")
def denial_cuts(spark, d):
    """Where the words affirm too much: negative cuts of the model inside each word's documents (with loose floors, so that some hold)."""
    hits = spark.createDataFrame([], "doc_id long, pattern string")
    for w in WORDS:
        hits = hits.unionByName(docs_of(spark, d).where(F.col("cnt").rlike(has(w).pattern.java())).select("doc_id", F.lit(w).alias("pattern")))
    cells = scores_of(spark, d).join(hits, "doc_id").select(F.col("pattern").alias("context"), "label", "p", "target")
    return loop_denials(cells, GRID, 0.9, 0.15, 3, -500)


@query("refiltered_pool")
def refiltered_pool(spark, d):
    """A stored pool of word rules, each tried twice, and a row that is no rule, admitted anew."""
    pool = spark.createDataFrame([(json.dumps(rule_to(r)), k / 10, 2 * k + j) for k, r in enumerate(_word_rules()) for j in (0, 1)] + [("{}", 1.0, 99)], "rule string, score double, trial long")
    return discovery.refilter(_empty(spark, d), pool, truth_of(spark, d), axis_of(spark))[1]
