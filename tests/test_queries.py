"""Every registered query with SQL against DuckDB on the smallest tables, and the others' basic properties."""

import os

import duckdb
import pytest

from marlstone import registry, registry_discovery, registry_learning  # noqa: F401  the others register more queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(str(round(v, 9)) if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, duck, name):
    assert rows(registry.QUERIES[name](spark, DATA).toPandas()) == rows(duck.sql(registry.ORACLE_SQL[name]).df())


def _ranked(df):
    """Numbered steps from the first, with scores that do not fall."""
    r = df.orderBy("step").collect()
    return [x.step for x in r] == list(range(len(r))) and r


def _greedy_patterns(df):
    r = _ranked(df)
    return r and [x.macro_f1 for x in r] == sorted(x.macro_f1 for x in r) and len({(x.pattern, x.label) for x in r}) == len(r) <= 3


def _balanced(df):
    r = _ranked(df)
    return r and len({x.pattern for x in r}) == len(r) == 4 and [x.label is None for x in r] == [False] * 3 + [True]


def _offsets(df):
    titles = {x.doc_id: x.text.split("\n")[0] for x in registry.read(df.sparkSession, DATA, "documents").where("text is not null").collect()}
    r = df.collect()
    return r and all(titles[x.doc_id][x.start : x.end].lower() == x.term for x in r if " " not in x.term)


def _loop(df):
    r = df.orderBy("round").collect()
    return [x.round for x in r] == list(range(len(r))) and sum(x.asked for x in r) <= 64 and {x.status for x in r} <= {"all_documents_resolved", "label_budget_exhausted", "no_eligible_uncovered_documents"}


def _staged(df):
    r = _ranked(df)
    return r and all(x.value > 0 for x in r) and [x.grow for x in r] == sorted(x.grow for x in r) and [x.prune for x in r] == sorted(x.prune for x in r)


def _joint(df):
    r = df.collect()
    return all(x.gain > 0 for x in r) and sorted(x.place for x in r) == list(range(len(r)))


def _learned(df):
    r = _ranked(df)
    return r and sum(x.n for x in r if x.kind == "ask") <= 64 and r[0].kind == "start" and len({x.status for x in r}) == 1


def _refiltered(df):
    r = df.collect()
    why = [x.reason for x in r]
    return len(r) == 13 and why.count("repeated") == 6 and why.count("unreadable") == 1 and why.count("admitted") >= 1


#: Queries without SQL, and what holds of their results.
PROPERTIES = {"greedy_patterns": _greedy_patterns, "balanced_greedy": _balanced, "term_offsets": _offsets, "label_loop": _loop, "staged_discovery": _staged, "joint_cuts": _joint, "learning_loop": _learned, "refiltered_pool": _refiltered}


def test_every_query_is_tested():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL) | set(PROPERTIES)


@pytest.mark.parametrize("name", sorted(PROPERTIES))
def test_property(spark, name):
    assert PROPERTIES[name](registry.QUERIES[name](spark, DATA))
