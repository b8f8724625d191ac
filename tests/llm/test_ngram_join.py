import random

import pytest
from pyspark.sql import functions as F

from outlyr.llm import ngram_join


def brute(rows, size, percent):
    """Smallest id of each component, by all pairs of sets."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, text in rows:
        w = [x for x in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(low)) if x]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {(d, len(s), least[root(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))}


def corpus(n, seed, vocabulary=400, copies=0.5):
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(30)]
    rows, made = [], []
    for i in range(n):
        if made and rng.random() < copies:
            w = list(rng.choice(made))
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [f"x{rng.random()}"], [w[k], "y"]])
        else:
            w = [f"w{rng.randrange(vocabulary)}" for _ in range(rng.randint(1, 80))]
        if rng.random() < 0.3:
            w += passage
        made.append(w or ["z"])
        rows.append((i, " ".join(w).upper() if rng.random() < 0.3 else "\n".join(w)))
    return rows


@pytest.mark.parametrize(("size", "percent", "seed"), [(4, 85, 1), (4, 85, 2), (5, 80, 3), (1, 50, 4)])
def test_all_links_are_found(spark, size, percent, seed):
    rows = corpus(250, seed)
    found = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), size=size, percent=percent)
    assert {(r.id, r.n_shingles, r.component_id) for r in found.collect()} == brute(rows, size, percent)


def test_frequent_shingles_change_no_result(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FREQUENT_ABOVE", 2)
    rows = corpus(200, 9, copies=0.8)
    found = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.id, r.n_shingles, r.component_id) for r in found.collect()} == brute(rows, 4, 85)


def test_a_chain_of_near_copies_is_one_component(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(words[i:] + [f"t{k}" for k in range(i)])) for i in range(40)]
    found = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.component_id for r in found.collect()} == {0}


def test_exact_threshold(spark):
    # 17 shingles in common of 20 are 85 in 100; of 21 they are not.
    a, b, c = (" ".join([*map(str, range(20)), *more]) for more in ([], ["x", "y", "z"], ["x", "y", "z", "u"]))
    found = {r.id: r.component_id for r in ngram_join.similar(spark.createDataFrame([(1, a), (2, b), (3, c)], "doc_id long, text string"), size=4).collect()}
    assert found[1] == found[2] == 1 and found[3] == 1  # the third is linked with the second
    found = {r.id: r.component_id for r in ngram_join.similar(spark.createDataFrame([(1, a), (3, c)], "doc_id long, text string"), size=4).collect()}
    assert found == {1: 1, 3: 3}


def test_edges(edge, empty):
    found = [(r.id, r.n_shingles, r.component_id) for r in ngram_join.similar(edge).collect()]
    assert sorted(found, key=str) == sorted([(1, 6, 1), (1, 6, 1), (2, 0, 2), (3, 0, 3), (4, 59997, 4), (None, 1, None), (5, 0, 5), (6, 1, 6), (7, 1, 7)], key=str)
    assert ngram_join.similar(empty).count() == 0
    kept = ngram_join.deduplicated(edge)
    assert kept.columns == edge.columns and kept.count() == 8 and ngram_join.deduplicated(empty).count() == 0
    assert kept.filter(F.col("doc_id").isNull()).count() == 1


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        # A repeated id with unlike texts: each row is judged by its own text.
        ([(3, "A"), (7, "A"), (7, "B")], [(3, "A"), (7, "B")]),
        ([(3, "A"), (7, "A"), (7, "B"), (9, "B")], [(3, "A"), (7, "B")]),
        # A null id is larger than any, and stays where its component has no other.
        ([(3, "A"), (None, "A"), (None, "B"), (None, "C")], [(3, "A"), (None, "B"), (None, "C")]),
        ([(None, "A"), (None, "a")], [(None, None)]),
        # One id, one set, other letters or blanks: one row stays. Texts without words stay each, alike rows once.
        ([(5, "A"), (5, "a")], [(5, None)]),
        ([(5, ""), (5, ""), (6, ""), (None, None), (5, None), (5, " ")], [(None, None), (5, None), (5, ""), (5, " "), (6, "")]),
    ],
)
def test_which_rows_stay(spark, rows, want):
    texts = {"A": "one two three four five six seven", "a": "One  two three\nfour five six seven", "B": "eight nine ten eleven twelve thirteen", "C": "some other text of more than five words"}
    df = spark.createDataFrame([(i, texts.get(t, t), "x") for i, t in rows], "doc_id long, text string, id string")
    got = [(r.doc_id, {v: k for k, v in texts.items()}.get(r.text, r.text)) for r in ngram_join.deduplicated(df).collect()]
    if want == [(rows[0][0], None)] and len(got) == 1:
        got = [(got[0][0], None)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def labels_of(links):
    up = {}

    def root(x):
        while x in up:
            x = up[x]
        return x

    for a, b in links:
        low, high = sorted((root(a), root(b)))
        if low != high:
            up[high] = low
    return {x: root(x) for x in up}


@pytest.mark.parametrize(("a_task", "held"), [(1 << 15, 1 << 18), (40, 1 << 18), (15, 7)])
def test_components_of_any_links(spark, monkeypatch, a_task, held):
    """Paths, stars, pairs and random links, in one task, in several, and in tasks that hold a few nodes at once."""
    monkeypatch.setattr(ngram_join, "LINKS_A_TASK", a_task)
    monkeypatch.setattr(ngram_join, "FOREST", held)
    rng = random.Random(5)
    name = [rng.randbytes(16) for _ in range(700)]
    links = [(i, i + 1) for i in range(150)] + [(200, i) for i in range(201, 300)] + [(i, i + 1) for i in range(300, 400, 2)]
    links += [(rng.randrange(400, 700), rng.randrange(400, 700)) for _ in range(140)]
    links = [(name[a], name[b]) for a, b in links if a != b]
    rng.shuffle(links)
    links += links[:20]
    found = ngram_join.components(ngram_join.written(spark.createDataFrame(links, "a binary, b binary").repartition(9), "links"))
    got = [(bytes(r.fp), bytes(r.label)) for r in found.collect()]
    assert len(got) == len(dict(got)) and dict(got) == labels_of(links)
    assert ngram_join.components(ngram_join.written(spark.createDataFrame([], "a binary, b binary"), "links")).count() == 0


def tasks_of(spark, made):
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()
    counts = []
    for _ in range(2):
        bus.waitUntilEmpty(30_000)
        counts.append(sum(store.executorList(True).apply(i).totalTasks() for i in range(store.executorList(True).size())))
        made = made() if len(counts) == 1 else made
    return counts[1] - counts[0]


def test_few_links_cost_few_tasks(spark):
    """However many partitions shuffles have: a job for each of them, round after round, took most of the time."""
    links = ngram_join.written(spark.range(1, 300).selectExpr("unhex(lpad(hex(id), 32, '0')) a", "unhex(lpad(hex(id - 1), 32, '0')) b"), "links")
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "50")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert tasks_of(spark, lambda: ngram_join.components(links)) < 100
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
