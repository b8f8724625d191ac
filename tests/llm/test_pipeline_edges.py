"""Stages of the pipeline on nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import public_tokenizers  # noqa: F401
import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, edge, tmp_path_factory):
    """A folder with the edge documents, and one with empty tables."""
    path = tmp_path_factory.mktemp("tables")
    for name, keep in (("full", True), ("none", False)):
        rows = edge if keep else edge.limit(0)
        rows.write.parquet(str(path / name / "documents.parquet"))
        labels = spark.createDataFrame([(1, 0, 0), (4, 1, 0), (6, None, 0), (7, 0, 1)], "doc_id long, quality int, toxic int")
        (labels if keep else labels.limit(0)).write.parquet(str(path / name / "labels.parquet"))
    return path


@pytest.mark.parametrize("k", range(5))
def test_stage(spark, edge, empty, folder, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, edge, str(folder / "full"))
    rows = out.collect()
    ids = {r.doc_id for r in rows}
    assert ids <= {1, 2, 3, 4, 5, 6, 7, None}
    if name == "rules":
        assert ids == {4}
    if name == "near_duplicates":
        assert len(rows) == 8 and ids == {1, 2, 3, 4, 5, 6, 7, None}
    if name == "mixture":
        assert ids <= {1, 4, 6, 7, None} and 4 in ids
    if name == "tokens":
        assert len(rows) == 9 and {r.n_tokens for r in rows if r.doc_id in (2, 3)} == {0} and out.columns == ["doc_id", "source", "n_tokens", "ids", "decoded_sha256"]
    else:
        assert out.columns == edge.columns
    assert stage(spark, empty, str(folder / "none")).count() == 0


def test_run_on_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, str(folder / "none")).count() == 0
