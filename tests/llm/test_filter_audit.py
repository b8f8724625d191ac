import random
import re
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from outlyr.llm import filter_audit

FIELDS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def brute(docs, labels):
    """Every order applied to the rows one after another."""
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    good, toxic = ({d for d, *own in labels if own[k] == 1} for k in (0, 1))
    rows = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": i is not None and least[t] < i}
        rows.append((lang or "", {k for k, v in fails.items() if v}, i is not None and i in good, i is not None and i in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                gone, left = [r for r in left if letter in r[1]], [r for r in left if letter not in r[1]]
                redundant = sum(letter in r[1] and bool(r[1] & set(order[: step - 1])) for r in mine)
                out[part, order, step] = (len(left), len(gone), redundant, sum(r[1] == {letter} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, letter] += len(gone)
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(spark, docs, labels, parts=4):
    d = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(parts)
    rows = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return [(r.part, r.filter_order, r.step, *(r[f] for f in FIELDS), r.shapley) for r in rows]


def made(n, seed):
    rng = random.Random(seed)
    texts = ["", None, "short text", "A B C #"]
    for _ in range(25):
        w = [rng.choice([f"w{rng.randrange(400)}", f"W{rng.randrange(9)}", "the"]) for _ in range(rng.randint(60, 180))]
        texts.append(" ".join(w) + rng.choice(["", " #", "\n|"]))
    docs = [(rng.choice([i, i, i, None, i % 50]), rng.choice(texts), rng.choice(["en", "fr", "", None])) for i in range(n)]
    return docs, [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in [*range(0, n, 2), 4, 6]] + [(None, 1, 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_every_order_equals_brute_force(spark, seed):
    docs, labels = made(300, seed)
    got = found(spark, docs, labels)
    assert len(got) == 3 * 600 and set(got) == brute(docs, labels)


def test_a_run_over_many_tasks(spark):
    """One text holds two thirds of all rows, so that it is cut by doc_id over several tasks; its rows still repeat one."""
    docs = [(i, "one text of many" if i % 3 else f"text {i}", "en") for i in range(3000)]
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        verdicts = filter_audit.swept(spark.createDataFrame(docs, "doc_id long, text string, lang string")).cache()
        bounds = verdicts.filter("mask is null").collect()
        assert sum(r.whole and r.first == "one text of many" for r in bounds) >= 3
        repeats = {r.doc_id for r in filter_audit.masks(verdicts).filter(F.col("mask").bitwiseAND(filter_audit.bit("E")) > 0).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])
    assert repeats == {i for i in range(3000) if i % 3} - {1}


def test_bounds_are_handed_on(spark):
    """Runs that begin in one task, fill others and end inside a fourth; a null doc_id is no smallest one."""
    bounds = [(0, None, "a", "m", False), (1, 7, "m", "m", True), (3, 9, "m", "m", True), (4, 2, "m", "z", False), (5, 5, "z", "z", True), (6, 1, "q", "q", True)]
    df = spark.createDataFrame(bounds, "task long, least long, first string, last string, whole boolean")
    assert {r.task: r.carried for r in filter_audit.continued(df).collect()} == {3: 7, 4: 7, 5: 2}


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1)], "doc_id long, quality int, toxic int")
    docs = [(r.doc_id, r.text, r.lang) for r in edge.collect()]
    rows = filter_audit.audit(edge, labels).collect()
    assert {(r.part, r.filter_order, r.step, *(r[f] for f in FIELDS), r.shapley) for r in rows} == brute(docs, [(1, 1, 0), (1, 0, 1)])
    assert filter_audit.audit(empty, labels).count() == 0 and filter_audit.audit(edge, labels.limit(0)).count() == 4 * 600 - 600


def test_counters_of_parts_add_up(spark):
    counters = spark.createDataFrame([("en", 3, 5, 1, 2), ("en", 0, 4, 4, 0), ("en", 16, 1, 0, 1)], "part string, mask int, n long, good long, toxic long")
    whole = filter_audit.report(counters).collect()
    again = filter_audit.report(counters.unionByName(counters)).collect()
    key = lambda r: (r.filter_order, r.step)
    for a, b in zip(sorted(whole, key=key), sorted(again, key=key)):
        assert tuple(2 * a[f] for f in (*FIELDS, "shapley")) == tuple(b[f] for f in (*FIELDS, "shapley"))
