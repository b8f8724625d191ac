"""Templates that are mined in parts against one miner for each key, message by message."""

import random

import pytest
from pyspark.sql import functions as F

from outlyr.operators import drain, sequential

SPACES = "\t\n\x0b\x0c\r\x1c\x1f \x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000"


def messages(n=600):
    rng = random.Random(5)
    words = ["user", "disk", "job-7", "\u0664\u0665", "<*>", "start", "end", "id=3", "ok", "\U0001d7d8x"]
    out = [(i, rng.choice(["a", "a", "a", None, "b"]), " ".join(rng.choices(words, k=rng.randint(1, 4))), i % 5 != 4) for i in range(n)]
    odd = [None, "", " ", SPACES, *[f"user{s}disk" for s in SPACES], "job-7", "word " * 3000]
    return [*out, *[(n + i, "a", text, True) for i, text in enumerate(odd)]]


def recount(rows, **params):
    miners, out = {}, set()
    for at, k, text, learns in rows:
        miner = miners.setdefault(k, drain.Miner(**params))
        found = None if not text or not text.strip() else (miner.learn(text), None) if learns else miner.match(text)
        shown = None if found is None else miner.clusters[found[0]]
        out.add((k, at, *((None, None, None) if found is None else (found[0], " ".join(shown), tuple(miner.variables(text, shown))))))
    return out


@pytest.mark.parametrize("params, keyed", [({}, True), ({"most": 40}, True), ({"most": 12}, True), ({"depth": 5, "similarity": 0.6}, True), ({}, False), ({"most": 30}, False)])
def test_parts_give_what_one_miner_gives(spark, params, keyed):
    """Bounds that no key, some keys and all keys reach; NULL keys, blank and long texts, digits and spaces of all scripts."""
    rows = messages() if keyed else [(at, "x", text, learns) for at, _, text, learns in messages()]
    df = spark.createDataFrame(rows, "at long, k string, v string, learns boolean")
    keys = ["k"] if keyed else []
    got = drain.templates_by_lead(df if keyed else df.drop("k"), keys, ["at"], "v", "at", learns="learns", **params)
    assert got.columns == [*keys, "at", "template_id", "template", "variables"]
    got = [(r.k if keyed else "x", r.at, r.template_id, r.template, r.variables and tuple(r.variables)) for r in got.collect()]
    norm = lambda found: {(*r[:4], r[4] or None) for r in found}
    assert len(got) == len(rows) and norm(got) == norm(recount(rows, **params))


@pytest.mark.parametrize("params, keyed", [({}, True), ({"most": 12}, True), ({"most": 30}, False)])
def test_stretches_of_the_order_give_what_one_task_gives(spark, monkeypatch, params, keyed):
    """No task meets all rows of a key: templates, their numbers and what is dropped go on from one stretch to the next."""
    rows = messages() if keyed else [(at, "x", text, learns) for at, _, text, learns in messages()]
    df = spark.createDataFrame(rows, "at long, k string, v string, learns boolean")
    followed, by_key = [], sequential.by_key
    monkeypatch.setattr(sequential, "BLOCK_BYTES", 10_000)
    monkeypatch.setattr(sequential, "by_key", lambda part, *more: followed.append(part.count()) or by_key(part, *more))
    got = drain.templates(df if keyed else df.drop("k"), ["k"] if keyed else [], ["at"], "v", "at", learns="learns", in_blocks=True, **params)
    assert len(followed) > 4 and max(followed) < len(rows) / 3 and sum(followed) == len(rows)
    got = [(r.k if keyed else "x", r.at, r.template_id, r.template, r.variables and tuple(r.variables)) for r in got.collect()]
    norm = lambda found: {(*r[:4], r[4] or None) for r in found}
    assert len(got) == len(rows) and norm(got) == norm(recount(rows, **params))


def test_bounds_of_leads_and_numbers_by_blocks(spark):
    """Each length and first token has a miner of its own; templates are numbered over the whole key by first appearance."""
    rows = messages()
    df = spark.createDataFrame(rows, "at long, k string, v string, learns boolean").drop("k")
    miners, ids, want = {}, {}, {}
    for at, _, text, learns in rows:
        if not text or not text.strip():
            want[at] = (None, None)
            continue
        lead = drain.Miner()._lead(text.split())
        miner = miners.setdefault(lead, drain.Miner(most=2))
        own = miner.learn(text) if learns else (miner.match(text) or [None])[0]
        want[at] = (None, None) if own is None else (ids.setdefault((lead, own), len(ids) + 1), " ".join(miner.clusters[own]))
    for block in (None, F.expr("at div 50")):
        got = drain.templates_by_lead(df, [], ["at"], "v", "at", learns="learns", block=block, bound_leads=True, most=2)
        assert {r.at: (r.template_id, r.template) for r in got.collect()} == want
    assert any(m.made > 2 for m in miners.values())


def test_text_templates_by_lead(spark, tmp_path):
    from outlyr import queries

    docs = [(1, "en", "user a1 logged in\nuser b2 logged in\n\ndisk full"), (1001, "de", "disk full\nuser c3 logged in"), (3, "de", None)]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.doc_id, r.line_no): (r.template_id, r.template) for r in queries.QUERIES["text_templates_by_lead"](spark, str(tmp_path)).collect()}
    user, disk, none = (1, "user <*> logged in"), (2, "disk full"), (None, None)
    assert found == {(1, 0): (1, "user a1 logged in"), (1, 1): user, (1, 2): none, (1, 3): disk, (1001, 0): disk, (1001, 1): user, (3, None): none}


def test_messages_of_one_key_are_dealt_to_many_tasks(spark):
    df = spark.createDataFrame(messages(), "at long, k string, v string, learns boolean")
    parts = df.select(drain.lead(F.col("v"), 4).alias("lead")).groupBy("lead").count().collect()
    tokens = {r.v: r.lead for r in df.select("v", drain.lead(F.col("v"), 4).alias("lead")).collect()}
    assert all((lead is None) == (not text or not text.strip()) for text, lead in tokens.items())
    for text, lead in tokens.items():
        if lead is not None:
            n, first = drain.Miner()._lead(text.split())
            assert lead == " ".join([str(n), *first])
    assert len(parts) > 20 and max(r["count"] for r in parts) < len(tokens)


def test_leads_are_found_in_one_pass(spark):
    """A text is split once for its lead, by what splits it in the miner, and not by patterns that each scan it."""
    plan = spark.createDataFrame([(1, "a b")], "at long, v string").select(drain.lead(F.col("v"), 4))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("look(") >= 1 and "split(" not in plan and "RLIKE" not in plan.upper()


def test_no_messages(spark):
    empty = spark.createDataFrame([], "at long, k string, v string")
    assert drain.templates_by_lead(empty, ["k"], ["at"], "v", "at").collect() == []
