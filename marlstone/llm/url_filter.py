"""URL filter: host and path rules first, gradient-boosted trees on lexical features for the rest.

DataFrame operations only. Trees are grown from histograms: the labelled rows are binned and counted once,
each level of each tree is one aggregation of that count table by node, feature and bin, and the driver
picks the splits from at most nodes * features * bins rows. The fitted trees are one column expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import ascii_lower, written

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls. A rule is `host/path`; it fits the host and its subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def features(url: Column, host: Column, path: Column, suffix_rate: Column, section_rate: Column) -> dict[str, Column]:
    """Lexical features as doubles; all are defined for the empty url."""
    url = F.coalesce(url, F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    chars = F.array_distinct(F.split(host, ""))
    share = lambda c: (F.length(host) - F.length(F.replace(host, c, F.lit("")))) / F.greatest(F.length(host), F.lit(1))
    entropy = F.aggregate(chars, F.lit(0.0), lambda a, c: a - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    out = {
        "url_length": F.length(url), "host_length": F.length(host), "host_depth": F.size(F.split(host, r"\.")),
        "path_depth": F.size(F.split(path, "/")), "digit_ratio": (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / n,
        "host_entropy": entropy, "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "hyphens": F.length(host) - F.length(F.translate(host, "-", "")), "longest_label": F.array_max(F.transform(F.split(host, r"\."), F.length)),
        "suffix_rate": suffix_rate, "section_rate": section_rate,
    }
    return {k: v.cast("double") for k, v in out.items()}


@dataclass
class Tree:
    """Splits by node number (children of n: 2n + 1, 2n + 2); leaves have values."""

    splits: dict[int, tuple[str, float]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def column(self, cols: dict[str, Column], leaf, at: int = 0) -> Column:
        if at not in self.splits:
            return leaf(at)
        name, cut = self.splits[at]
        return F.when(cols[name] <= cut, self.column(cols, leaf, 2 * at + 1)).otherwise(self.column(cols, leaf, 2 * at + 2))


def boost(rows: DataFrame, names: list[str], trees: int = 12, depth: int = 3, bins: int = 16, rate: float = 0.3, ridge: float = 1.0, least: float = 5.0) -> tuple[float, list[Tree]]:
    """Fit logistic gradient-boosted trees to rows of features and y (0 or 1). Returns the prior logit and the trees."""
    cuts = rows.agg(*[F.percentile_approx(n, [k / bins for k in range(1, bins)], 10_000).alias(n) for n in names], F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).first()
    n, y = cuts["n"], cuts["y"] or 0
    prior = log((y + 1) / (n - y + 1))
    if not y or y == n:
        return prior, []
    edges = {c: sorted(set(cuts[c])) for c in names}

    def bin_of(c: str) -> Column:
        """The smallest cut not below the value; infinity above all."""
        out = F.lit(float("inf"))
        for e in reversed(edges[c]):
            out = F.when(F.col(c) <= e, e).otherwise(out)
        return out

    binned = written(rows.select("y", *[bin_of(c).alias(c) for c in names]).groupBy(*names).agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")), "bins")
    cols = {c: F.col(c) for c in names}
    margin, grown = F.lit(prior), []
    for _ in range(trees):
        p = 1 / (1 + F.exp(-F.col("margin")))
        state = binned.withColumn("margin", margin).withColumns({"g": F.col("y") - F.col("n") * p, "h": F.col("n") * p * (1 - p)})
        tree, open_nodes = Tree(), {0}
        for _level in range(depth):
            at = tree.column(cols, F.lit)
            parts = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("cut")) for i, c in enumerate(names)]))
            found = state.select(at.alias("node"), "g", "h", "n", parts.alias("x")).where(F.col("node").isin([*open_nodes])).groupBy("node", "x.f", "x.cut").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")).collect()
            fresh = set()
            for node in sorted(open_nodes):
                best = (1e-6, None)
                for f, name in enumerate(names):
                    hist = sorted((r["cut"], r["g"], r["h"], r["n"]) for r in found if r["node"] == node and r["f"] == f)
                    g, h, m = (sum(r[k] for r in hist) for k in (1, 2, 3))
                    lg = lh = lm = 0.0
                    for cut, dg, dh, dm in hist[:-1]:
                        lg, lh, lm = lg + dg, lh + dh, lm + dm
                        if lm >= least and m - lm >= least:
                            gain = round(lg**2 / (lh + ridge) + (g - lg) ** 2 / (h - lh + ridge) - g**2 / (h + ridge), 6)
                            if gain > best[0]:
                                best = (gain, (name, cut, [(lg, lh), (g - lg, h - lh)]))
                if best[1]:
                    name, cut, sides = best[1]
                    tree.splits[node] = (name, cut)
                    for k, (sg, sh) in enumerate(sides):
                        tree.leaves[2 * node + 1 + k] = round(rate * sg / (sh + ridge), 9)
                        fresh.add(2 * node + 1 + k)
            open_nodes = fresh
            if not fresh:
                break
        if not tree.splits:
            break
        grown.append(tree)
        margin = margin + tree.column(cols, lambda k, t=tree: F.lit(t.leaves[k]))
    return prior, grown


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: tuple[tuple[str, str], ...] = RULES, fit_rows: int = 20_000, few: int = 8 << 20, threshold: float = 0.5, **how) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, score (probability of block).

    Urls that a rule fits are the labelled ones; the trees learn from fit_rows of them or so, taken by hash,
    and judge the others: block from `threshold` on. A null url, or one without `://`, has an empty host
    and path. With no labelled url, or one kind only, the prior decides. Repeated rows are judged alike; an
    empty table gives an empty result; other columns are ignored. Suffix statistics are kept for every last
    label of labelled hosts and every first section of their paths; up to `few` bytes of them are broadcast, more
    are joined by shuffle, whose large partitions adaptive execution splits. Values that no labelled url has get
    the overall rate, as a quarter of the rows to learn from do, so that the trees know the case.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).withColumns({"host": host, "path": path})
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "said": said, "suffix": F.substring_index("host", ".", -1), "section": F.element_at(F.split("path", "/"), F.least(F.size(F.split("path", "/")), F.lit(2)))})
    labelled = base.where("rule is not null")
    kinds = labelled.groupBy("suffix", "section").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("said") == "block").cast("long")).alias("y"))
    total = kinds.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("y")).first()
    overall = (total["y"] + 1) / (total["n"] + 2)
    names = [*features(F.col("url"), F.col("host"), F.col("path"), F.lit(0.0), F.lit(0.0))]

    def rates(by: str) -> DataFrame:
        """Broadcast if small: a row is a string and a number."""
        k = kinds.groupBy(by).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
        k = written(k.select(by, ((F.col("y") + 20 * overall) / (F.col("n") + 20)).alias(f"{by}_known")), by)
        size = k.agg(F.coalesce(F.sum(F.octet_length(by) + 32), F.lit(0))).first()[0]
        return F.broadcast(k) if size <= few else k

    tops = [rates("suffix"), rates("section")]

    def with_features(df: DataFrame, seen: Column | None = None) -> DataFrame:
        """seen: where false, the statistics are left out, as for a suffix that no labelled url has."""
        for by, top in zip(("suffix", "section"), tops, strict=True):
            df = df.join(top, by, "left")
        known = [F.coalesce(F.when(F.lit(True) if seen is None else seen, F.col(f"{by}_known")), F.lit(overall)) for by in ("suffix", "section")]
        return df.withColumns(features(F.col("url"), F.col("host"), F.col("path"), *known))

    part = min(1.0, fit_rows / max(1, total["n"]))
    fit = labelled.where(F.pmod(F.xxhash64("url"), F.lit(1_000_000)) < part * 1_000_000)
    seen = F.pmod(F.xxhash64("url", F.lit("seen")), F.lit(4)) > 0
    fit = written(with_features(fit, seen).select(*names, (F.col("said") == "block").cast("int").alias("y")), "labelled")
    prior, trees = boost(fit, names, **how)
    cols = {c: F.col(c) for c in names}
    margin = F.lit(prior)
    for tree in trees:
        margin = margin + tree.column(cols, lambda k, t=tree: F.lit(t.leaves[k]))
    judged = with_features(base).withColumn("score", 1 / (1 + F.exp(-margin)))
    verdict = F.coalesce("said", F.when(F.col("score") >= threshold, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")
