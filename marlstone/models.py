"""A registry of models: named scorers of texts, applied once to each distinct text, with their tables of probabilities."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.plans.store import written

#: From a text column to a map of label -> probability: built-in functions, or an Arrow UDF around a real model.
Scorer = Callable[[Column], Column]


@dataclass
class Registry:
    """alias -> scorer and label axis; what is not registered is an error, and so is a label outside its model's axis."""

    models: dict[str, tuple[Scorer, tuple[str, ...]]] = field(default_factory=dict)

    def register(self, alias: str, scorer: Scorer, labels: tuple[str, ...]) -> None:
        if alias in self.models:
            raise ValueError(f"model {alias} is registered already")
        if not labels or len(set(labels)) != len(labels):
            raise ValueError("a model needs distinct labels")
        self.models[alias] = (scorer, tuple(labels))

    def probabilities(self, docs: DataFrame, aliases: list[str] | None = None, text: str = "cnt") -> DataFrame:
        """doc_id, alias, label, p, is_static: every registered (or named) model on every document.

        Equal texts are scored once: the scorers run over the distinct texts, their scores are written, and documents get
        them by the text's SHA-256.
        """
        names = sorted(self.models) if aliases is None else aliases
        for a in names:
            if a not in self.models:
                raise ValueError(f"unknown model {a}")
        keyed = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t_")).withColumn("h_", F.sha2("t_", 256))
        distinct = keyed.groupBy("h_").agg(F.first("t_").alias("t_"))
        made = []
        for a in names:
            scorer, labels = self.models[a]
            m = scorer(F.col("t_"))
            made += [F.struct(F.lit(a).alias("alias"), F.lit(x).alias("label"), m[x].cast("double").alias("p")) for x in labels]
        scored = written(distinct.select("h_", F.array(*made).alias("s")), "scores")
        out = keyed.select("doc_id", "h_").join(scored, "h_").select("doc_id", F.explode("s").alias("s")).select("doc_id", "s.*")
        return out.withColumn("is_static", F.lit(False))

    def decisions(self, docs: DataFrame, cuts: dict[str, float], text: str = "cnt") -> DataFrame:
        """doc_id, label, alias, vote by each model's cut."""
        p = self.probabilities(docs, sorted(cuts), text)
        cut = F.create_map(*[F.lit(x) for a, c in cuts.items() for x in (a, c)])
        return p.select("doc_id", "label", "alias", (F.col("p") >= cut[F.col("alias")]).alias("vote"))
