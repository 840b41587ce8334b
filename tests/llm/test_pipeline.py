"""The pipeline against its stages' rules, and the registered queries against DuckDB where SQL states them."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from oracle_check import compare, connect  # noqa: E402
from tallyferry.llm import queries  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    ok, _, note = compare(spark, connect(SF_DIR), SF_DIR, queries.QUERIES[name], queries.ORACLES[name])
    assert ok, note


def test_thirteen_operators():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    seen = [docs]
    for _, stage in corpus_pipeline.STAGES:
        seen.append(corpus_pipeline.stored(stage(spark, seen[-1], SF_DIR), "stage"))
        assert set(docs.columns) <= set(seen[-1].columns)
    rows = [[(r.doc_id, r.text) for r in x.select("doc_id", "text").collect()] for x in seen]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    clean = [i for i, _ in rows[0] if labels.get(i) == 0]
    assert len({i for i, _ in rows[1]} & set(clean)) >= 0.97 * len(clean)
    first = {}
    for i, text in sorted(rows[1]):
        first.setdefault(" ".join((text or "").split(" ")), i)
    assert {i for i, _ in rows[2]} <= {i for i, _ in rows[1]} and len(rows[2]) <= len(first)
    assert {i for i, _ in rows[3]} == {i for i, (_, c) in brute.jaccard(rows[2]).items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    assert {i for i, _ in rows[4]} == {i for i, d in brute.decontaminated(rows[3], items).items() if not d[4]}
    assert seen[5].where("NOT lossless").count() == 0 and len(rows[5]) == len(rows[4])
