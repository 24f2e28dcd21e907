"""The label-set relation without its n^2 pairs: equality by components, heads as blocks of groups.

A relation of documents (src is within dst) is held as
  comps   node, comp: the component of every node that some equality or cycle binds to another; others are their own
  links   src, dst, strict between components, without reflexive ones
  blocks  the same, through group nodes: a rule that puts all of L below all of R for each value of an attribute adds
          L -> group -> R, which is linear in |L| + |R|
Nodes are documents (their ids) and groups (numbers below GROUPS, where no document's id may be). If nothing asks for order (no strict inclusion, no
premise on inclusion), links and blocks stay as they are and labels are copied hop by hop; else they are closed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.plans.store import written

EDGES = "src bigint, dst bigint, strict boolean"
COMPS = "node bigint, comp bigint"
GROUPS = -(1 << 62)


@dataclass
class Relation:
    """closed: links are transitively closed (and cover the blocks). settled: mutual inclusions are one component."""

    comps: DataFrame
    links: DataFrame
    closed: bool = True
    settled: bool = True

    @property
    def spark(self) -> SparkSession:
        return self.links.sparkSession

    def comp_of(self, df: DataFrame, col: str, name: str) -> DataFrame:
        """df with the component of its column `col`."""
        return df.join(self.comps.select(F.col("node").alias(col), F.col("comp").alias(name)), col, "left").withColumn(name, F.coalesce(name, col))

    def members(self, df: DataFrame, col: str, name: str) -> DataFrame:
        """df with each node of the component in its column `col` (documents only)."""
        bound = self.comps.where(F.col("node") >= GROUPS).select(F.col("comp").alias(col), F.col("node").alias(name))
        return df.join(bound, col, "left").withColumn(name, F.coalesce(name, col)).where(F.col(name) >= GROUPS)

    def pairs(self) -> DataFrame:
        """src, dst, strict of documents, closed, without reflexive pairs that are not strict. As many rows as there are pairs: for small relations."""
        links = self.links if self.closed else close(self.links)
        both = self.comps.where(F.col("node") >= GROUPS)
        same = both.select(F.col("node").alias("src"), "comp").join(both.select(F.col("node").alias("dst"), "comp"), "comp").where("src <> dst").select("src", "dst", F.lit(False).alias("strict"))
        wide = self.members(self.members(links.withColumnsRenamed({"src": "a", "dst": "b"}), "a", "src"), "b", "dst")
        return wide.select("src", "dst", "strict").unionByName(same).groupBy("src", "dst").agg(F.max("strict").alias("strict"))

    def copies(self, facts: DataFrame) -> DataFrame:
        """What one hop along links and to all of a component gives the positive ones of facts: doc_id, label, sign; nodes below GROUPS are groups."""
        held = self.comp_of(facts.where("sign > 0").select("doc_id", "label"), "doc_id", "comp").select("comp", "label").distinct()
        moved = held.join(self.links.select(F.col("src").alias("comp"), "dst").distinct(), "comp").select(F.col("dst").alias("comp"), "label")
        reached = held.unionByName(moved).distinct()
        bound = self.comps.select("comp", "node")
        out = reached.join(bound, "comp").select(F.col("node").alias("doc_id"), "label").unionByName(moved.select(F.col("comp").alias("doc_id"), "label"))
        return out.distinct().select("doc_id", "label", F.lit(1).alias("sign"))


def close(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """Transitive closure; a path is strict if one of its edges is. Path lengths double each round."""
    now = written(edges.where("src <> dst or strict").groupBy("src", "dst").agg(F.max("strict").alias("strict")), "closure")
    size = None
    for _ in range(rounds):
        a, b = now.alias("a"), now.alias("b")
        two = a.join(b, F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst", (F.col("a.strict") | F.col("b.strict")).alias("strict"))
        after = written(now.unionByName(two).where("src <> dst or strict").groupBy("src", "dst").agg(F.max("strict").alias("strict")), "closure")
        grown = after.agg(F.count(F.lit(1)), F.count_if("strict")).first()
        now = after
        if grown == size:
            return now
        size = grown
    raise RuntimeError(f"the relation is not closed after {rounds} rounds")


def components(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """node, comp (its smallest node) for the nodes of pairs (a, b): linear rows; large and small stars in turn."""
    now = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    before = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = written(small.unionByName(smallest.select("a", F.col("m").alias("b"))).distinct(), "stars")
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(roots.select("node", F.col("node").alias("comp")))
        before = state
    raise RuntimeError(f"components are not complete after {rounds} rounds")


def relate(spark: SparkSession, equal: DataFrame | None, edges: DataFrame, ordered: bool) -> Relation:
    """The relation of equalities (a, b) and inclusions (src, dst, strict), of documents and groups. ordered: something asks for order."""
    comps = written(components(equal), "comps") if equal is not None else spark.createDataFrame([], COMPS)
    first = Relation(comps, edges)
    links = first.comp_of(first.comp_of(edges.withColumnsRenamed({"src": "a", "dst": "b"}), "a", "src"), "b", "dst")
    links = written(links.where("src <> dst or strict").groupBy("src", "dst").agg(F.max("strict").alias("strict")), "links")
    if not ordered:
        return Relation(comps, links, closed=False, settled=False)
    links = close(links)
    back = links.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    mutual = links.where("src <> dst").join(back, ["src", "dst"], "left_semi")
    if mutual.isEmpty():
        return Relation(comps, links)
    # In a closed relation a node sees the whole of its cycle at once.
    cycle = mutual.groupBy("src").agg(F.least(F.min("dst"), F.min("src")).alias("root")).select(F.col("src").alias("comp"), "root")
    own = comps.join(cycle, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"))
    new = cycle.join(comps.select("comp").distinct(), "comp", "left_anti").select(F.col("comp").alias("node"), F.col("root").alias("comp"))
    comps = written(own.unionByName(new), "comps")
    named = cycle.select(F.col("comp"), "root")
    for end in ("src", "dst"):
        links = links.join(named.select(F.col("comp").alias(end), F.col("root").alias("r_")), end, "left").withColumn(end, F.coalesce("r_", end)).drop("r_")
    links = written(links.where("src <> dst or strict").groupBy("src", "dst").agg(F.max("strict").alias("strict")), "links")
    return Relation(comps, links)


def stars(left: DataFrame, right: DataFrame) -> DataFrame:
    """a, b: each document of a value that both sides have, and the smallest such document. left, right: doc_id, value."""
    values = left.select("value").distinct().join(right.select("value").distinct(), "value", "left_semi")
    members = left.unionByName(right).distinct().join(values, "value", "left_semi")
    return members.join(members.groupBy("value").agg(F.min("doc_id").alias("b")), "value").select(F.col("doc_id").alias("a"), "b")


def group_nodes(left: DataFrame, right: DataFrame, known: DataFrame, place: int) -> DataFrame:
    """known (value, node) and a node for each further value that both sides have. place: which numbering this is, up to 500."""
    values = left.select("value").distinct().join(right.select("value").distinct(), "value", "left_semi").join(known, "value", "left_anti")
    node = F.lit(GROUPS - 1 - (place << 53)) - F.monotonically_increasing_id()
    return written(known.unionByName(values.select("value", node.alias("node"))), "groups")


def block_edges(left: DataFrame, right: DataFrame, nodes: DataFrame, strict: bool) -> DataFrame:
    """src, dst, strict: left documents within their value's group, the group within the right ones."""
    into = left.join(nodes, "value").select(F.col("doc_id").alias("src"), F.col("node").alias("dst"), F.lit(False).alias("strict"))
    return into.unionByName(right.join(nodes, "value").select(F.col("node").alias("src"), F.col("doc_id").alias("dst"), F.lit(strict).alias("strict")))
