"""Queries cover every row and every line of their tables."""

from outlyr import queries


def test_templates_are_mined_from_every_line(spark, tmp_path):
    docs = [(1, "en", "user a1 logged in\nuser b2 logged in\n\ndisk full"), (2, "en", "disk full"), (3, "de", None)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.doc_id, r.line_no): r for r in queries.QUERIES["text_templates"](spark, str(tmp_path)).collect()}
    assert {at: r.template_id for at, r in found.items()} == {(1, 0): 1, (1, 1): 1, (1, 2): None, (1, 3): 2, (2, 0): 2, (3, None): None}
    assert found[1, 1].template == "user <*> logged in" and found[1, 1].variables == ["b2"]


def test_every_price_is_in_the_baseline(spark, tmp_path):
    prices = [(1, 10.0), (2, 5.0), (3, 2500.0), (1, 5.0), (2, 99.5)]
    spark.createDataFrame(prices, "l_linenumber int, l_extendedprice double").write.parquet(str(tmp_path / "lineitem.parquet"))
    found = {r.x: r.percentile for r in queries.QUERIES["percentile_score"](spark, str(tmp_path)).collect()}
    assert found == {5.0: 0.0, 10.0: 40.0, 99.5: 60.0, 2500.0: 80.0}


def test_users_of_the_autoencoder_are_not_folded_and_it_retrains_by_default(spark, tmp_path, monkeypatch):
    seen = {}
    monkeypatch.setattr(queries.autoencoder, "scored", lambda rows, keys, order, categories, numbers, learns, id_col, *options, **more: seen.update(rows=rows, options=options, more=more))
    spark.sql("SELECT id AS event_id, timestamp_seconds(id) AS ts, id AS user_id, 'a' AS event_type, 50.0D AS value FROM range(100)").write.parquet(str(tmp_path / "events.parquet"))
    queries.QUERIES["autoencoder_score"](spark, str(tmp_path))
    assert seen["rows"].select("u").distinct().count() > 90
    options = (*seen["options"], seen["more"].get("options", queries.autoencoder.Options()))[0]
    assert options == queries.autoencoder.Options() and seen["more"]["slots"] == {"u": 2000}
