import numpy as np
import pytest
from pyspark.sql import functions as F

from outlyr import config
from outlyr.plans.engine import Engine


def encoded(spark, rows, encoder, block=None, kind="numeric", **params):
    """The encoded columns of rows(phase, seq, v) of one key, by name."""
    raw = {"features": {"f": {"v": {"type": kind, "preprocessor": {"type": encoder, **params}}}}, "cohorts": [{"name": "all", "features_config": "f", "model": "HalfSpaceTrees", "warmup_count": 3}]}
    cohort = config.parse(raw).cohorts[0]
    df = spark.createDataFrame([("k", i + 1, *r) for i, r in enumerate(rows)], f"key string, number int, phase int, seq long, x {'double' if kind == 'numeric' else 'string'}")
    out, numbers, _, _ = Engine(config.parse(raw), block)._encode(df, cohort, {"v": "x"})
    found = out.orderBy("phase", "seq").collect()
    return {name: [r[c] for r in found] for name, c, _ in numbers}


@pytest.mark.parametrize("block", [False, True])
@pytest.mark.parametrize("encoder", ["StandardScaler", "MinMaxScaler"])
def test_warm_up_rows_wait_with_and_without_blocks(spark, encoder, block):
    rows = [(0, 0, 2.0), (0, 1, 1.0), (0, 2, 3.0), (0, 3, 5.0), (1, 4, 4.0)]
    found = encoded(spark, rows, encoder, F.expr("seq div 2") if block else None)["v"]
    s, t = np.std([1, 2, 3]), np.std([1, 2, 3, 5])
    want = [0, -1 / s, 1 / s, 2.25 / t, 1.25 / t] if encoder == "StandardScaler" else [0.5, 0, 1, 1, 0.75]
    assert found == pytest.approx(want)
    assert encoded(spark, rows[:2], encoder, F.expr("seq div 2") if block else None)["v"] == [None, None]


def test_variables_of_templates_are_columns(spark):
    rows = [(0, 0, "Service nginx started on 10.0.0.1"), (0, 1, "Service redis started on 10.0.0.2"), (0, 2, "Service bob started on 10.0.0.1"), (1, 3, "Service redis started on 10.9.9.9"), (1, 4, " ")]
    found = encoded(spark, rows, "Drain3Encoder", kind="str_text", max_vars=2)
    assert list(found) == ["v__template", "v__var_0", "v__var_1"] and found["v__template"] == [1, 1, 1, 1, None]
    first, second = found["v__var_0"], found["v__var_1"]
    assert first[1] == first[3] and second[1] != second[3] and first[4] is None and first[2] != first[1]
    assert list(encoded(spark, rows, "Drain3Encoder", kind="str_text", max_vars=1)) == ["v__template", "v__var_0"]
    assert encoded(spark, rows, "Drain3Encoder", kind="str_text", sim_th=0.95)["v__template"][:3] == [1, 2, 3]


def test_a_new_variable_of_a_usual_template_raises_the_score(spark):
    raw = {"features": {"f": {"m": "str_text"}}, "cohorts": [{"name": "all", "features_config": "f", "model": {"type": "Autoencoder", "params": {"warmup_count": 40, "retrain_every": 20, "epochs_per_retrain": 20, "lr": 0.01, "seed": 1}}}]}
    frame = lambda texts, start: spark.createDataFrame([(start + i, f'{{"m": "{t}"}}') for i, t in enumerate(texts)], "seq long, j string").select("seq", F.parse_json("j").alias("payload"))
    out = Engine(config.parse(raw)).run(frame([f"login of {'ab'[i % 2]} ok" for i in range(200)], 0), frame(["login of a ok", "login of zz ok"], 200), explain=True).orderBy("seq").collect()
    assert out[1].composite_score > out[0].composite_score
    assert [f.field for f in out[1].scores[0].explanation.features] == ["m"]
