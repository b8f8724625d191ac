"""Replays a folder of cases: OUTLYR_CASES/<suite>/<case>/ with config.yaml, input_NNN.json and output_NNN_ingest.json.

An input file is {"ingest": [...], "scores": [...]}; an output file is the list of responses to what is ingested, in order.
Skipped where the variable names no folder. Numbers agree to 1e-6. Embedding models differ, so the numbers that come of a
sentence encoder are compared by their count.
"""

import glob
import json
import os

import pytest
import yaml
from pyspark.sql import functions as F

from outlyr import config
from outlyr.plans.engine import Engine

ROOT = os.environ.get("OUTLYR_CASES", "")
CASES = sorted(os.path.dirname(p) for p in glob.glob(f"{ROOT}/*/*/config.y*ml")) if ROOT else []
#: Suites whose learned rows depend on no stream of random numbers.
EXACT = [c for c in CASES if c.split("/")[-2] in ("api", "extractor", "preprocessor") and os.path.exists(f"{c}/output_001_ingest.json")]


def read(path):
    with open(path) as f:
        return json.load(f)


@pytest.mark.skipif(not CASES, reason="OUTLYR_CASES names no folder of cases")
def test_every_configuration_is_read():
    for case in CASES:
        for path in glob.glob(f"{case}/config.y*ml"):
            with open(path) as f:
                made = config.parse(yaml.safe_load(f))
            assert made.cohorts and all(c.features in made.features for c in made.cohorts)


def same(got, want, loose=False):
    if isinstance(want, dict):
        assert set(got) == set(want), (got, want)
        for k in want:
            same(got[k], want[k], loose)
    elif isinstance(want, list) and want and isinstance(want[0], dict):
        key = lambda x: x.get("field", x.get("name"))
        assert len(got) == len(want), (got, want)
        for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
            same(a, b, loose)
    elif isinstance(want, list):
        assert len(got) == len(want) and (loose or got == pytest.approx(want, abs=1e-6)), (got, want)
    else:
        assert (float(got) == pytest.approx(want, abs=1e-6)) if isinstance(want, float) else got == want, (got, want)


def plain(row):
    """A response as a service writes it: values as JSON types, absent parts left out."""
    out = {"accepted": row.accepted}
    if row.error is not None:
        return out | {"cohorts": None, "error": row.error}
    if row.identifiers is not None:
        out["identifiers"] = {k: json.loads(v) if v and v[0] in '"[{' else v for k, v in row.identifiers.items()}
    features = lambda fs: [{"field": f.field, "value": f.value, "preprocessed": f.preprocessed} | ({"raw": f.raw} if f.raw else {}) for f in fs]
    return out | {"cohorts": [{"name": c.name, "features": features(c.features)} for c in row.cohorts]}


def texts(response):
    """Values as numbers or texts, as the columns of features hold them."""
    for c in response.get("cohorts") or ():
        for f in c["features"]:
            f["value"] = None if f["value"] is None else float(f["value"]) if isinstance(f["value"], (int, float)) else str(f["value"])
    return response


@pytest.mark.parametrize("case", EXACT or [None])
def test_learned_rows(spark, case):
    if case is None:
        pytest.skip("OUTLYR_CASES names no folder of cases")
    raw = yaml.safe_load(open(f"{case}/config.yaml"))
    loose = "SentenceTransformerEncoder" in json.dumps(raw)
    ingest, want = [], []
    for path in sorted(glob.glob(f"{case}/input_*.json")):
        ingest += read(path)["ingest"]
        want += read(path.replace("input_", "output_").replace(".json", "_ingest.json"))
    frame = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(ingest)], "seq long, json string").select("seq", F.parse_json("json").alias("payload"))
    try:
        got = [plain(r) for r in Engine(config.parse(raw)).learned(frame).orderBy("seq").collect()]
    except ValueError as refused:
        # What a service answers to each event, a plan answers once.
        got = [{"accepted": False, "cohorts": None, "error": str(refused)} for _ in ingest]
    assert len(got) == len(want)
    for a, b in zip(got, want):
        same(a, texts(b), loose)
