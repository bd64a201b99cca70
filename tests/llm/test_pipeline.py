"""Registered corpus queries, and the pipeline against a brute-force version of its stages."""

import os

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from tacit.llm import quality
from tacit.llm import queries as corpus
from tests.llm.test_text_operators import brute_components
from tools.compare import compare

SF_DIR = "/root/testdata/sf0.001"


def test_every_operator_is_registered_once():
    names = [n for n in entry_module.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert "pipeline" in entry_module.queries()
    assert set(corpus.SQL) <= set(corpus.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", sorted(corpus.QUERIES))
def test_query_matches_sql(spark, name):
    ok, note = compare(spark, SF_DIR, name, corpus.QUERIES[name], corpus.SQL.get(name))
    assert ok, note


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language ID"](spark, docs, SF_DIR)
    assert known.columns == docs.columns
    passed = stages["quality rules"](spark, known, SF_DIR)
    rows = [(r.doc_id, r.text) for r in known.collect()]
    want = {i for i, t in rows if not any(r.rejects(quality.Text(t)) for r in quality.RULES)}
    assert {r.doc_id for r in passed.collect()} == want
    single = stages["near duplicates"](spark, passed, SF_DIR)
    rows = [(i, t) for i, t in rows if i in want]
    heads = {root for _, root in brute_components(rows, 5, 80).values()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(heads)
    pieces = stages["packing"](spark, single, SF_DIR).collect()
    assert {p.doc_id for p in pieces} == heads


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_pipeline_handles_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
