"""The pipeline on the smallest tables, against what its operators say in plain Python."""

import pytest

import corpus_pipeline
from parchment.llm import decontamination as dc
from parchment.llm import secrets

from .conftest import make
from .test_similar import plain_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        out.append(docs.collect())
    return out


def ids(rows):
    return {r.doc_id for r in rows}


def test_stages(spark, stages):
    docs, good, single, clean, redacted, mixed = stages
    columns = set(docs[0].asDict())
    assert all(set(s[0].asDict()) == columns for s in stages[:5]) and set(mixed[0].asDict()) == columns | {"taken"}
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(bad & ids(docs) - ids(good)) <= 2
    least = plain_groups([(r.doc_id, r.text) for r in good])
    assert ids(single) == set(least.values())
    items = [(r.item_id, dc.normal(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    matcher = dc.Matcher(items)
    assert ids(clean) == {r.doc_id for r in single if not matcher.hits(r.text)}
    assert {(r.doc_id, r.text, r.n_chars) for r in redacted} == {(r.doc_id, secrets.redact(r.text), len(secrets.redact(r.text))) for r in clean}
    assert ids(mixed) <= ids(redacted) and all(r.taken > 0 for r in mixed)


def test_run(spark, stages):
    assert {(r.doc_id, r.taken) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, r.taken) for r in stages[-1]}


def test_empty(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_odd_rows(spark, odd, odd_rows):
    """Every stage takes nulls, empty and long texts, repeated rows and clashing names, and keeps the columns."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        assert docs.columns == odd.columns, name
    assert docs.count() > 0
    mixed = corpus_pipeline.mix_sources(spark, odd, SF)
    assert set(mixed.columns) == set(odd.columns) and {r.doc_id for r in mixed.collect()} <= {i for i, *_ in odd_rows}


def test_repeated_rows(spark):
    docs = make(spark, [(i % 5, f"one text of some words, number {i % 5}, that is here several times " * 9, "en", "a") for i in range(20)])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == sorted(set(plain_groups([(r.doc_id, r.text) for r in docs.collect()]).values()))
    assert corpus_pipeline.drop_benchmark(spark, docs, SF).count() == corpus_pipeline.redact_secrets(spark, docs, SF).count() == 20
    assert sorted(r.doc_id for r in corpus_pipeline.mix_sources(spark, docs, SF).collect()) == list(range(5))


def test_run_sweeps_behind_itself(spark):
    from parchment.llm import common

    before = common.written()
    corpus_pipeline.run(spark, SF).count()
    names = [p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in common._written[before:]]
    assert [n for n in names if not n.startswith("mix")] == ["pipeline-secrets"]
