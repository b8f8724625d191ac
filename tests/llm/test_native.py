import hashlib
import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from outlyr.llm import chat, mixing, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def counts(text):
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = {g for g, n in Counter(grams).items() if n > 1}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len({p for i, g in enumerate(grams) if g in twice for p in (i, i + 1, i + 2)})


def test_rules_count_as_python_does(spark, edge, empty):
    texts = ["", "a", "a a a a", "x y z x y z q", "l1 a\nl1 a\n \n\nl1 a", "#*$ %&|<>", "one two three " * 40, "\x0b\x0cé 🦊", "a b c d a b c"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.count(df).collect()}
    assert got == {i: counts(t) for i, t in enumerate(texts)}
    judged = quality_rules.judge(quality_rules.count(edge)).collect()
    assert len(judged) == 9 and {r.doc_id for r in judged if r.kept} == {4}
    assert all(r.base_failed and "too_few_words" in r.failed for r in judged if r.doc_id != 4)
    assert quality_rules.count(empty).count() == 0
    kept = quality_rules.keep_good(edge)
    assert kept.columns == edge.columns and [r.doc_id for r in kept.collect()] == [4]


def test_rules_plan_has_no_python(edge):
    plan = quality_rules.judge(quality_rules.count(edge))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 50), "abcd"[min(i % 7, 3)]) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    placed, mixed = mixing.mix(df, block_words=64)
    out = mixing.taken_words(placed, mixed).collect()
    size, taken, target, own = Counter(), Counter(), {}, {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source], own[r.source] = r.target, r.source_size
    assert dict(size) == own and len(out) == 3000
    assert all(abs(taken[s] - target[s]) < 1 for s in target)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values())) and all(target[s] <= 2 * size[s] for s in size)
    # Any stretch of the schedule holds the sources near their shares.
    slots = Counter(r.no for r in mixed.filter("slot < 300").select("slot", "no").distinct().collect())
    total = sum(target.values())
    for no, s in enumerate(sorted(target), 1):
        assert abs(slots[no] - 300 * target[s] / total) < 10
    assert sorted(map(tuple, out)) == sorted(map(tuple, mixing.taken_words(*mixing.mix(df.repartition(7), block_words=64)).collect()))


@pytest.mark.parametrize("block", [16, 64, 4096])
def test_slots_are_distinct_and_without_gaps(spark, block):
    """Also where several sources end inside a block, so that blocks are left after the schedule's end."""
    rows = [(i, "w " * (1 + i % 50), f"s{i * i % 23 % 9}") for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sources = mixing.targets(mixing.sizes(df)).cache()
    slots = mixing.schedule(sources, block).collect()
    need = {r.no: -(-int(r.target) // block) for r in sources.collect()}
    assert sorted(r.slot for r in slots) == list(range(sum(need.values())))
    assert {no: sorted(r.block for r in slots if r.no == no) for no in need} == {no: list(range(n)) for no, n in need.items()}


def test_mix_edges(edge, empty):
    out = mixing.taken_words(*mixing.mix(edge)).collect()
    assert len(out) == 9 and all(r.taken <= 2 * r.size for r in out) and {r.source for r in out} == {"a", "b", "c", None}
    assert mixing.taken_words(*mixing.mix(empty)).count() == 0
    docs = mixing.mixed_documents(edge)
    assert docs.columns == edge.columns
    words = docs.agg(F.sum(F.size(F.expr("filter(split(text, '[ \\\\t\\\\n]+'), x -> x <> '')")))).first()[0]
    assert abs(words - sum(r.taken for r in out)) <= 2
    assert mixing.mixed_documents(empty).count() == 0


def test_mixed_documents_stand_in_the_order_of_the_schedule(spark):
    """Each row is taken as often and as far as the mix says, and any stretch of a partition holds the sources near their shares."""
    rows = [(i, f"d{i} " * (1 + i % 50), "abcd"[min(i % 7, 3)], -1) for i in range(3000)] + [(9, "d9 " * 10, "c", -1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    took = mixing.taken_words(*mixing.mix(df, block_words=64)).collect()
    want = Counter()
    for r in took:
        want[r.id] += r.taken
    docs = mixing.mixed_documents(df, block_words=64)
    parts = docs.select("doc_id", "source", "text", "n_chars", F.spark_partition_id().alias("p")).collect()
    got = Counter()
    for r in parts:
        got[r.doc_id] += len(r.text.split())
        assert r.n_chars in (-1, len(r.text)) and set(r.text.split()) == {f"d{r.doc_id}"}
    assert got == +want
    share = {s: sum(r.taken for r in took if r.source == s) / sum(want.values()) for s in "abcd"}
    for p in {r.p for r in parts}:
        mine = [r for r in parts if r.p == p][:400]
        n = sum(len(r.text.split()) for r in mine)
        if len(mine) == 400:
            assert all(abs(sum(len(r.text.split()) for r in mine if r.source == s) / n - share[s]) < 0.1 for s in "abcd")


def test_slots_of_a_real_table_hold_the_sources_near_their_shares(spark):
    if not os.path.isdir("/root/testdata/sf0.01"):
        pytest.skip("no test data")
    sources = mixing.targets(mixing.sizes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))).cache()
    target = {r.no: int(r.target) for r in sources.collect()}
    whole = sum(target.values())
    slots = [r.no for r in mixing.schedule(sources, 64).filter(f"slot < {whole // 64}").orderBy("slot").collect()]
    for upto in (200, 1000, 5000, len(slots)):
        seen = Counter(slots[:upto])
        assert all(abs(seen[no] - upto * t / whole) < 8 for no, t in target.items())


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_round_trip(spark):
    nasty = ["<|turn|>x<|says|>y<|end|>", "<", "|", "<|", "<~|", "<~~|end|>", "</s>[INST] ok [/INST]", "</s~>", "[INST~]", "[/INST~~]~", "", None, "~", "line\nline", "<s><s~>"]
    rows = [(c, t, ["user", "assistant", "sys<|tem"][(c + t) % 3], nasty[(c * 3 + t) % len(nasty)]) for c in range(12) for t in range(c + 1)]
    made = chat.examples(conversations(spark, rows))
    for e in made.collect():
        assert e.formatted.count("<|turn|>") == e.formatted.count("<|end|>") == e.formatted.count("<|says|>")
        assert "</s>" not in e.formatted and "[INST]" not in e.formatted
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    for c in range(12):
        mine = [(r, x or "") for k, _, r, x in rows if k == c]
        loss = "".join(x for r, x in mine if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(mine), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in mine).encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_chat_examples(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (1, 2, "user", "r"), (1, 3, "assistant", "b"), (1, 4, "user", "s")]
    made = chat.examples(conversations(spark, rows)).orderBy("example").collect()
    assert [e.formatted[e.loss_start : e.loss_start + e.loss_length] for e in made] == ["a", "b", ""]
    assert made[1].formatted.startswith(made[0].formatted) and made[2].formatted.endswith("<|turn|>user<|says|>s<|end|>")


def test_chat_edges(spark):
    rows = [(None, 0, None, None), (None, 0, None, None), (2, None, "user", "x"), (2, 1, "assistant", "y"), (3, 0, "user", "x" * 100_000)]
    got = {r.conv_id: r.n_turns for r in chat.read_back(chat.examples(conversations(spark, rows).withColumn("said", F.lit(1)))).collect()}
    assert got == {None: 2, 2: 2, 3: 1}
    assert chat.read_back(chat.examples(conversations(spark, []))).count() == 0
