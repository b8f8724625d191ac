import pytest
from pyspark.sql import functions as F

from outlyr import config
from outlyr.config import Field
from outlyr.functions import extract, labels, paths


def run(spark, fields, *payloads):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate(payloads)], "seq long, json string").select("seq", F.parse_json("json").alias("payload"))
    return [(r.features.asDict(), r.error) for r in extract.extracted(rows, fields).orderBy("seq").collect()]


def test_timestamps(spark):
    good = [("2026-04-20T10:39:17Z", (10, 0, 0)), ("2026-04-25T10:00:00Z", (10, 5, 1)), ("2026-04-20T10:39:17+05:00", (10, 0, 0)), ("2026-04-20", (0, 0, 0))]
    for text, want in good:
        (found, error), = run(spark, {"ts": Field("timestamp")}, f'{{"ts": "{text}"}}')
        assert (found["ts.hour"], found["ts.dayofweek"], found["ts.is_weekend"]) == want and error is None
    errors = [e for _, e in run(spark, {"ts": Field("timestamp")}, '{"ts": null}', '{"ts": 12345}', '{"ts": "12345"}', '{"ts": "2026-02-30"}', '{"ts": "2026-01-01T25:00:00"}', "{}")]
    assert errors == ["ts: expected str, got NoneType", "ts: expected str, got int", "ts: cannot parse '12345' as datetime", "ts: cannot parse '2026-02-30' as datetime", "ts: cannot parse '2026-01-01T25:00:00' as datetime", None]


def test_sub_fields_can_be_ignored_or_handled_again(spark):
    (found, _), = run(spark, {"ts": Field("timestamp"), "ts.hour": Field("ignore")}, '{"ts": "2026-04-20T10:39:17Z"}')
    assert "ts.hour" not in found and found["ts.dayofweek"] == 0
    (found, _), = run(spark, {"ts": Field("timestamp"), "ts.hour": Field("str_categorical")}, '{"ts": "2026-04-20T10:39:17Z"}')
    assert found["ts.hour"] == "10.0" and found["ts.is_weekend"] == 0


def test_numbers_booleans_and_texts(spark):
    found = run(spark, {"n": Field("numeric"), "b": Field("boolean")}, '{"n": 1.5, "b": true}', '{"n": true}', '{"b": "true"}', '{"b": 1}', "{}")
    assert found[0] == ({"n": 1.5, "b": 1.0}, None)
    assert [e for _, e in found[1:]] == ["n: expected int or float, got bool", "b: expected bool, got str", "b: expected bool, got int", None]
    texts = run(spark, {"s": Field("str_text")}, '{"s": "x"}', '{"s": true}', '{"s": 1.0}', '{"s": 7}', '{"s": null}', "{}", '{"s": ""}')
    assert [f["s"] for f, _ in texts] == ["x", "True", "1.0", "7", "None", None, ""]


def test_addresses(spark):
    (four, _), = run(spark, {"ip": Field("ip_address")}, '{"ip": "192.168.1.1"}')
    assert [four[f"ip.{k}"] for k in ("is_private", "o1", "o2", "o3", "o4")] == [1, 192, 168, 1, 1]
    (six, _), = run(spark, {"ip": Field("ip_address")}, '{"ip": "2001:db8::1"}')
    assert six["ip.is_private"] == 1 and six["ip.subnet_hash"] == pytest.approx(0.719720471119443, abs=1e-12)
    (public, _), (_, error) = run(spark, {"ip": Field("ip_address")}, '{"ip": "8.8.8.8"}', '{"ip": "300.1.1.1"}')
    assert public["ip.is_private"] == 0 and error == "ip: cannot parse '300.1.1.1' as IP address"


def test_versions(spark):
    found = run(spark, {"v": Field("semver")}, '{"v": "1.18.2"}', '{"v": " 7-beta"}', '{"v": "x"}')
    assert [tuple(f.values()) for f, _ in found[:2]] == [(1, 18, 2), (7, None, None)] and found[2][1] == "v: cannot parse 'x' as semver"


def test_json_in_json(spark):
    import json

    inner = json.dumps({"a": {"b": 3}, "c": "x"})
    payload = json.dumps({"raw": json.dumps({"in": inner, "n": 1})})
    fields = {"raw": Field("json_expand"), "in": Field("json_expand", source="raw.in"), "deep": Field("numeric", source="in.a.b"), "n": Field("numeric", source="raw.n")}
    (found, error), = run(spark, fields, payload)
    assert (found["deep"], found["n"], error) == (3, 1, None)
    errors = [e for _, e in run(spark, {"raw": Field("json_expand")}, '{"raw": "no"}', '{"raw": "[1]"}', '{"raw": 1}')]
    assert errors == ["raw: cannot parse 'no' as JSON", "raw: expected JSON object, got list", "raw: expected str, got int"]


def test_paths(spark):
    row = spark.sql("""SELECT parse_json('{"a.b": null, "a": {"b": 1, "c": 2}}') AS p""").select(
        F.is_variant_null(paths.at(F.col("p"), "a.b")).alias("literal"), paths.nested(F.col("p"), "a.b", "int").alias("nested"), paths.at(F.col("p"), "a.c", "int").alias("step"), paths.at(F.col("p"), "x").isNull().alias("missing"))
    assert tuple(row.first()) == (True, 1, 2, True)


def test_labels(spark):
    rows = spark.createDataFrame([(None,), (0.0,), (29.99,), (30.0,), (50.0,), (70.0,), (85.0,)], "s double").select(labels.label(F.col("s"))).collect()
    assert [r[0] for r in rows] == ["INSUFFICIENT_DATA", "NORMAL", "NORMAL", "SLIGHTLY_ELEVATED", "ELEVATED", "ANOMALOUS", "HIGHLY_ANOMALOUS"]
    rows = spark.createDataFrame([(0.0,), (80.0,), (85.0,), (95.0,), (99.0,), (100.0,)], "p double").select(labels.scaled_percentile(F.col("p"))).collect()
    assert [r[0] for r in rows] == [0, 30, 40, 70, 85, 100]
    row = spark.sql("SELECT array(1D, 2D, 2D, 3D) AS b").select(labels.share_below(F.col("b"), F.lit(2.0)), labels.share_below(F.array().cast("array<double>"), F.lit(1.0))).first()
    assert tuple(row) == (25.0, None)


def test_configuration():
    c = config.parse({"features": {"f": {"a": "numeric", "b": {"type": "str_categorical", "preprocessor": {"type": "HashIndex", "n_features": 4}, "source": "x.b"}}}, "cohorts": [{"name": "all", "features_config": "f", "model": {"type": "Autoencoder", "params": {"buffer_size": 9}}}]})
    assert c.features["f"]["b"] == Field("str_categorical", "HashIndex", {"n_features": 4}, "x.b") and c.cohorts[0].params == {"buffer_size": 9}
    assert config.encoder_of(Field("str_text"), "Autoencoder") == "Drain3Encoder" and config.encoder_of(Field("ip_address"), "NoOp") == "PassThrough"
    with pytest.raises(ValueError, match="Unknown preprocessor: 'X'"):
        config.encoder_of(Field("numeric", "X"), "NoOp")
    with pytest.raises(ValueError, match="unknown features_config"):
        config.parse({"features": {}, "cohorts": [{"name": "c", "features_config": "no"}]})


def test_sources_name_what_expansions_made(spark):
    fields = {"raw": Field("json_expand"), "raw.v": Field("semver"), "minor": Field("numeric", source="raw.v.minor"), "raw.v.minor.x": Field("numeric", source="raw.v.minor")}
    row = extract.extracted(spark.createDataFrame([('{"raw": "{\\"v\\": \\"2.7.1\\"}"}',)], "json string").select(F.parse_json("json").alias("payload")), fields).first()
    assert row.accepted and row.features.minor == row.features["raw.v.minor.x"] == 7.0


def test_ipv6_golden_value(spark):
    frame = spark.createDataFrame([('{"ip": "2001:db8::1"}',)], "json string").select(F.parse_json("json").alias("payload"))
    row = extract.extracted(frame, {"ip": Field("ip_address")}).first().features
    assert row["ip.is_private"] == 1.0 and abs(row["ip.subnet_hash"] - 0.719720471119443) < 1e-12


def test_ipv6_groups_have_four_digits_at_most(spark):
    """What is no address has no network: extract_ipv6 makes such texts of user ids above 65,535."""
    import hashlib

    (good, none), (bad, error) = run(spark, {"ip": Field("ip_address")}, '{"ip": "2001:db8:ffff::1"}', '{"ip": "2001:db8:10000::1"}')
    assert none is None and good["ip.subnet_hash"] == int(hashlib.sha256(b"2001:db8:ffff::/48").hexdigest()[:8], 16) / 0xFFFFFFFF
    assert error == "ip: cannot parse '2001:db8:10000::1' as IP address" and bad["ip.subnet_hash"] is None and bad["ip.is_private"] is None


def nested(depth):
    """A payload of texts in texts, and the fields that read a number, a version and an alias of each level."""
    import json

    inner, fields, path = {"n": depth, "v": f"1.{depth}"}, {}, "raw"
    for k in range(depth - 1, 0, -1):
        inner = {"n": k, "v": f"1.{k}", "in": json.dumps(inner)}
    for k in range(1, depth + 1):
        fields |= {path: Field("json_expand"), f"{path}.n": Field("numeric"), f"{path}.v": Field("semver"), f"alias{k}": Field("numeric", source=f"{path}.v.minor")}
        path += ".in"
    return json.dumps({"raw": json.dumps(inner)}), fields


def test_texts_in_texts_six_levels_deep(spark):
    payload, fields = nested(6)
    (found, error), = run(spark, fields, payload)
    assert error is None and [found[f"alias{k}"] for k in range(1, 7)] == [1, 2, 3, 4, 5, 6] and found["raw.in.in.in.in.in.n"] == 6


def test_a_plan_grows_with_its_fields_and_not_with_their_depth(spark):
    """Each JSON text is parsed once for each row, whatever is read from it."""
    rows = spark.createDataFrame([(0, "{}")], "seq long, json string").select("seq", F.parse_json("json").alias("payload"))
    size = {}
    for depth in (2, 4, 8):
        plan = extract.extracted(rows, nested(depth)[1])._jdf.queryExecution().optimizedPlan().toString()
        size[depth] = len(plan)
        assert plan.count("parse_json") <= depth + 1
    assert size[8] - size[4] < 4 * (size[4] - size[2])


def test_an_object_inside_is_no_leaf(spark):
    fields = {"raw": Field("json_expand"), "raw.a": Field("str_text"), "raw.a.b": Field("numeric")}
    (found, error), = run(spark, fields, '{"raw": "{\\"a\\": {\\"b\\": 2}}"}')
    assert (found["raw.a"], found["raw.a.b"], error) == (None, 2, None)


def test_entries_are_sources_of_later_ones(spark):
    fields = {"flag": Field("boolean", source="x.flag"), "same": Field("boolean", source="flag"), "text": Field("str_text", source="flag")}
    (found, error), = run(spark, fields, '{"x": {"flag": true}}')
    assert (found["flag"], found["same"], found["text"], error) == (1, 1, "True", None)
