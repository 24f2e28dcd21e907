"""The corpus pipeline: language ID, near-deduplication, decontamination, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next
one's docs. All but the last return the columns of documents.

In every stage an empty table gives an empty result, null or clashing values in columns that it does not read are
passed on, and texts are read whole whatever their length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import decontaminate, language_id, mixing, near_dedup, token_store
from marlstone.llm.common import written
from marlstone.llm.registry import TOKENIZER, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no identifiable language go: null and empty texts, texts without a letter, and those that the model does
    not know (see language_id.keep_identified). Rows that repeat an id or a text are decided alike; without labelled rows all go."""
    return language_id.keep_identified(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words at a similarity of 0.8 the smallest id stays. Texts without a word are
    linked with nothing and stay, rows without an id too; of rows that repeat an id one stays."""
    return near_dedup.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts and items hold nothing; every row is decided for itself."""
    return decontaminate.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out so that sources have their target weights. Null is a source of its own; texts without a
    word are kept once; rows that share an id are taken equally often."""
    return mixing.mixed(docs)


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in a content-addressed store, read back: doc_id, start, n_tokens, ids_crc32, verified. A null or empty text has the
    end id alone; rows that share an id follow each other."""
    return token_store.read_digests(spark, token_store.write_store(docs, TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix_sources),
    ("token_store", store_tokens),
]

#: Classifier, retrieval and mixing are not expressible in SQL; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
