"""The registered queries of the subpackage, and the pipeline, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from corvane.llm import decontaminate, jaccard, linededup
from corvane.llm.entry import ORACLE, QUERIES

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="no test tables")


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(f"{r[i]:.6f}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, str(SF))
    got = canon(df.collect(), df.columns)
    assert got
    if name in ORACLE:
        con = duckdb.connect()
        for p in SF.glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
        rel = con.sql(ORACLE[name])
        assert sorted(rel.columns) == sorted(df.columns) and canon(rel.fetchall(), rel.columns) == got


@pytest.mark.parametrize("size, least, false", [("sf0.01", 0.6, 0.01), ("sf0.1", 0.9, 0.015)])
def test_toxicity_held_out(spark, size, least, false):
    """Shares of held-out toxic documents caught and of others accused, with the defaults."""
    labels = spark.read.parquet(f"{SF.parent}/{size}/labels.parquet").select("doc_id", "toxic")
    found = QUERIES["op8_toxicity"](spark, f"{SF.parent}/{size}").where("held_out").join(labels, "doc_id").collect()
    said = {y: [r.predicted for r in found if r.toxic == y] for y in (0, 1)}
    assert sum(said[1]) / len(said[1]) >= least and sum(said[0]) / len(said[0]) <= false


def test_pipeline(spark):
    from test_text_ops import plain_clean, plain_components, plain_hits

    assert set(entry.queries()) >= {"pipeline", *QUERIES}
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, str(SF)).collect(), docs.schema)
        after = {r.doc_id: r for r in docs.collect()}
        ids = sorted(before)
        texts = [before[i].text for i in ids]
        assert set(after) <= set(before)
        if name == "line_dedup":
            for i, (left, n) in zip(ids, plain_clean(texts, linededup.MIN_WORDS)):
                assert after[i].text == left if left or not n else i not in after
        else:
            assert all(after[i].text == before[i].text for i in after)
        if name == "near_copies":
            rule = corpus_pipeline.NEAR_COPIES
            assert set(after) == {ids[i] for i, _, c in plain_components(texts, rule.width, rule.num, rule.den) if i == c}
        if name == "decontamination":
            assert set(after) == {i for i, t in zip(ids, texts) if not plain_hits(t, bench, 10)[4]}
    assert decontaminate and jaccard
