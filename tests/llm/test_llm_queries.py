import glob
import os

import duckdb
import pytest

import corpus_pipeline
from outlyr.llm import queries, shingles

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    got = sorted(repr([r[c] for c in order]) for r in df.collect())
    assert got
    if name in queries.ORACLES:
        con = duckdb.connect()
        for p in glob.glob(f"{DATA}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
        cursor = con.execute(queries.ORACLES[name])
        columns = [d[0] for d in cursor.description]
        assert sorted(columns) == order
        at = [columns.index(c) for c in order]
        assert got == sorted(repr([r[i] for i in at]) for r in cursor.fetchall())


def test_pipeline_stages(spark, tmp_path):
    """Each stage takes what the one before it kept; clean documents stay, copies and junk go."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    bad = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").filter("quality = 0").collect()}
    seen = {0: docs}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, seen[k], DATA)
        out.write.parquet(str(tmp_path / name))
        seen[k + 1] = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert seen[k + 1].columns == docs.columns
        before, after = ({r.doc_id for r in seen[i].select("doc_id").collect()} for i in (k, k + 1))
        assert after <= before and after
    kept = {r.doc_id for r in seen[1].select("doc_id").collect()}
    assert len(kept & bad) <= 0.2 * len(bad)
    texts = [r.text for r in seen[3].collect()]
    sets = [set(s.tolist()) for s in shingles.shingle_sets(texts, 5)]
    for i, a in enumerate(sets):
        assert all(len(a & b) < 0.8 * len(a | b) for b in sets[:i])
