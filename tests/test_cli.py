import json

from outlyr.__main__ import main


def test_train_and_detect(spark, tmp_path):
    (tmp_path / "c.yml").write_text(json.dumps({"features": {"f": {"v": "numeric"}}, "identifiers": ["id"], "cohorts": [{"name": "all", "features_config": "f", "model": {"type": "HalfSpaceTrees", "params": {"window_size": 50}}}]}))
    line = lambda i, v: json.dumps({"id": f"e{i}", "v": v, "t": f"2026-01-01T00:{i // 60:02}:{i % 60:02}Z"})
    (tmp_path / "train.json").write_text("\n".join(line(i, i % 5) for i in range(120)))
    (tmp_path / "score.json").write_text("\n".join([line(200, 2), line(201, 10_000), line(202, "x")]))
    main([str(tmp_path / "c.yml"), str(tmp_path / "train.json"), str(tmp_path / "score.json"), str(tmp_path / "out"), "--order", "t", "--explain"])
    found = {r.identifiers["id"]: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert found['e200'].composite_score < found['e201'].composite_score and found["e202"].error.startswith("v: expected int or float")
