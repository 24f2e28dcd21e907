"""The pipeline's stages on a small table, each against what its operator says."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="session")
def small(spark, tmp_path_factory):
    rnd = random.Random(4)
    d = str(tmp_path_factory.mktemp("sf"))
    vocab = [f"word{i}" for i in range(400)]
    make = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    texts = [make(60) for _ in range(40)]
    bench = [make(30) for _ in range(5)]
    texts += [texts[0], texts[1] + " more", "12 34", None, f"{make(40)} {bench[0]} {make(40)}"]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([*enumerate(bench)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    cols, left = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, small), name)
        assert docs.columns == cols
        left[name] = sorted(r.doc_id for r in docs.collect())
    assert left["language_id"] == [i for i in range(45) if i not in (42, 43)]
    assert left["near_dedup"] == [i for i in left["language_id"] if i not in (40, 41)]
    assert left["decontaminate"] == [i for i in left["near_dedup"] if i != 44]
    assert set(left["mix_sources"]) <= set(left["decontaminate"])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, small).collect()
    assert sorted(r.doc_id for r in out) == left["mix_sources"] and all(r.verified for r in out)


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0
