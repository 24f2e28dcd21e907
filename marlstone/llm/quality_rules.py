"""Quality rules as a short-circuit cascade, in DataFrame operations only.

Every rule is a column that is true where a document fails. What a rule costs (seconds) and rejects is estimated on a
sample; then rules are ordered greedily by what they reject of the documents that earlier rules left, per cost. The cascade
is one CASE expression in that order: Spark evaluates its branches one after the other and stops at the first that holds,
so an expensive rule sees only what cheap ones let pass. The order changes the time, never the verdict: a document
is kept if no rule holds.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import done, text_of, written

BLANKS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """fails: a column over the measured rows (see measured); null counts as not failing."""

    name: str
    fails: Column


@dataclass(frozen=True)
class Estimate:
    name: str
    cost: float
    rejects: float


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value being computed once, wherever filters and projections are moved."""
    return F.get(F.transform(F.array(value), body), 0)


def repeats(w: Column) -> Column:
    """Words of w (an array) in windows of three words that occur twice or more, the first occurrence included.

    The windows are sorted beside their places, equal neighbours are repeats, and their places, sorted, cover
    min(3, distance to the last one) new words each. Words are compared in full.
    """
    windows = F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.get(w, i).alias("a"), F.get(w, i + 1).alias("b"), F.get(w, i + 2).alias("c"), i.alias("i"))))
    same = lambda x, y: (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])
    places = lambda s: F.transform(s, lambda x, k: F.when(same(x, F.get(s, k - 1)) | same(x, F.get(s, k + 1)), x["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("covered"))
    add = lambda a, x: F.struct(x.alias("last"), (a["covered"] + F.least(F.lit(3), x - a["last"])).alias("covered"))
    covered = let(windows, lambda s: F.aggregate(F.sort_array(F.filter(places(s), lambda x: x.isNotNull())), start, add)["covered"])
    return F.when(F.size(w) >= 4, covered).otherwise(0).cast("long")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and what the base rules read: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.col("text")
    out = docs.select(docs[id_col].cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    by_word = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeats(w).alias("n_repeat_words"))
    by_line = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    out = out.select("doc_id", "text", let(F.array_remove(F.split(text, BLANKS), ""), by_word).alias("w"), chars(text, SYMBOLS).alias("n_symbols"),
                     let(F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), by_line).alias("x"))
    return out.select("doc_id", "text", "w.n_words", "w.word_chars", "n_symbols", "x.n_lines", "x.n_dup_lines", "w.n_repeat_words")


def chars(text: Column, kind: str) -> Column:
    """Characters of a class."""
    return (F.length(text) - F.length(F.regexp_replace(text, F.lit(kind + "+"), F.lit("")))).cast("long")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def default_rules() -> list[Rule]:
    """Rules on symbols, word lengths, repeated lines, capitals, letters, shouting and cut lines; all are wide of ordinary prose."""
    n, text = F.col("n_words"), F.col("text")
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("word_length", (F.col("word_chars") > 12 * n) | (2 * F.col("word_chars") < 5 * n)),
        Rule("repeated_lines", (F.col("n_lines") >= 4) & (2 * F.col("n_dup_lines") > F.col("n_lines"))),
        Rule("repeated_words", 100 * F.col("n_repeat_words") > 40 * n),
        Rule("capitals", 10 * chars(text, r"\p{Lu}") > 4 * F.col("word_chars")),
        Rule("letters", 10 * chars(text, r"\p{L}") < 6 * F.col("word_chars")),
        Rule("shouting", 10 * chars(text, "[!?]") > 2 * n),
        Rule("cut_lines", (F.col("n_lines") >= 4) & (10 * F.regexp_count(text, F.lit(r"(?:\.\.\.|…)(?=\n|\z)")) > 3 * F.col("n_lines"))),
    ]


def failing(rules: list[Rule]) -> list[Column]:
    return [F.coalesce(r.fails, F.lit(False)) for r in rules]


def estimate(sample: DataFrame, rules: list[Rule], runs: int = 2) -> tuple[list[float], dict[int, int]]:
    """Seconds of each rule over the sample beyond reading it (the least of some runs), and the sample's rows by the set of rules that reject them.

    There are at most as many sets as rows in the sample.
    """
    def seconds(what: Column) -> float:
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            sample.agg(F.count_if(what)).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    seconds(F.length("text") >= 0)  # what starts slowly starts here
    base = seconds(F.length("text") >= 0)
    costs = [max(1e-3, seconds(f) - base) for f in failing(rules)]
    mask = reduce(Column.bitwiseOR, [F.when(f, F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, f in enumerate(failing(rules))], F.lit(0).cast("long"))
    rows = sample.groupBy(mask.alias("mask")).agg(F.count(F.lit(1)).alias("n")).collect()
    return costs, {r["mask"]: r["n"] for r in rows}


def order_rules(costs: list[float], sets: dict[int, int]) -> list[tuple[int, float]]:
    """Rules by rejection per cost among what is left, with the share of it that they reject; ties by cost, then by place."""
    left, todo, out = dict(sets), set(range(len(costs))), []
    while todo:
        total = max(1, sum(left.values()))
        rejects = {i: sum(n for m, n in left.items() if m >> i & 1) for i in todo}
        best = min(todo, key=lambda i: (-rejects[i] / costs[i], costs[i], i))
        out.append((best, rejects[best] / total))
        todo.remove(best)
        left = {m: n for m, n in left.items() if not m >> best & 1}
    return out


def cascade(rules: list[Rule]) -> Column:
    """The name of the first rule that rejects the row, or null; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for r, f in reversed(list(zip(rules, failing(rules), strict=True))):
        out = F.when(f, F.lit(r.name)).otherwise(out)
    return out


def plan(docs: DataFrame, rules: list[Rule], sample: int = 4000, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[Rule], list[Estimate]]:
    """The rules in the order to be applied, with their estimates, from about `sample` rows of docs (twice as many at most) that pass the base rules."""
    total = docs.count()
    some = docs.sample(fraction=min(1.0, sample / max(1, total)), seed=seed).limit(2 * sample)
    few = written(measured(some, id_col, text_col), "sample")
    costs, sets = estimate(few.where(~base_failed()), rules)
    done(few)
    order = order_rules(costs, sets)
    return [rules[i] for i, _ in order], [Estimate(rules[i].name, costs[i], share) for i, share in order]


def judge(docs: DataFrame, rules: list[Rule] | None = None, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, kept.

    A null text has no words, and fails the base rules as all texts under 50 words do. Rows that share an id are judged each
    for itself; a null id stays null. An empty table gives an empty result; other columns are ignored, whatever their names. Words
    and windows of one text are held in its task (some 200 bytes a word).
    """
    rules = default_rules() if rules is None else rules
    rows = measured(docs, id_col, text_col)
    # Base failures are decided by columns that are there anyway: the cascade is planned for, and applied to, the others.
    ordered, _ = plan(docs, rules, sample, id_col=id_col, text_col=text_col)
    first = F.when(base_failed(), F.lit("base")).otherwise(cascade(ordered))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), first.isNull().alias("kept"))


#: The rules in SQL; windows are counted as rows.
ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (
  SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 4)),
twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, range(0, 3) o(k) GROUP BY r),
m AS (
  SELECT doc_id, t, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN covered ON w.r = covered.r),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         10 * n_symbols > n_words OR word_chars > 12 * n_words OR 2 * word_chars < 5 * n_words OR (n_lines >= 4 AND 2 * n_dup_lines > n_lines)
         OR 100 * n_repeat_words > 40 * n_words OR 10 * (length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g'))) > 4 * word_chars
         OR 10 * (length(t) - length(regexp_replace(t, '\p{L}', '', 'g'))) < 6 * word_chars OR 10 * (length(t) - length(regexp_replace(t, '[!?]', '', 'g'))) > 2 * n_words
         OR (n_lines >= 4 AND 10 * len(list_filter(string_split(t, chr(10)), lambda x: ends_with(x, '...') OR ends_with(x, '…'))) > 3 * n_lines) AS bad FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT bad AS kept FROM judged
"""
