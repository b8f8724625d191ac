"""The network against finite differences and a plain recount of its steps; rows scored together against rows scored alone."""

from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from outlyr.operators import autoencoder
from outlyr.operators.autoencoder import Network, Options, State


def batch(n=12, seed=3):
    rng = np.random.default_rng(seed)
    ids, x = rng.integers(0, 5, (n, 2)), rng.standard_normal((n, 2))
    x[::5, 0] = np.nan
    return ids, x


def test_gradients_are_those_of_the_loss(monkeypatch):
    monkeypatch.setattr(Network, "_move", lambda self: None)
    net, (ids, x) = Network([5, 5], 2, Options(headroom=2)), batch()
    net._learn(ids, x)
    rng = np.random.default_rng(0)
    for own, gradient in zip(net.p, net.g, strict=True):
        for at in [tuple(rng.integers(0, n) for n in own.shape) for _ in range(12)]:
            was, ends = own[at], []
            for step in (1e-6, -1e-6):
                own[at] = was + step
                ends.append(net.errors(ids, x).mean())
            own[at] = was
            assert (ends[0] - ends[1]) / 2e-6 == pytest.approx(gradient[at], abs=1e-6)


def test_steps_are_adams(monkeypatch):
    net, (ids, x) = Network([5, 5], 2, Options(headroom=2)), batch()
    taken, move = [], Network._move
    monkeypatch.setattr(Network, "_move", lambda self: (taken.append([g.copy() for g in self.g]), move(self)))
    want = [p.copy() for p in net.p]
    m, v = [0 * p for p in want], [0 * p for p in want]
    for t in range(1, 6):
        net._learn(ids, x)
        for i, g in enumerate(taken[-1]):
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
            want[i] = want[i] - 1e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    for got, expected in zip(net.p, want, strict=True):
        assert np.allclose(got, expected, rtol=1e-12, atol=1e-15)


def rows(n):
    return [SimpleNamespace(c=None if i % 7 == 0 else f"v{i % 5}", n=None if i % 11 == 0 else float(i % 3)) for i in range(n)]


def state(n, **options):
    made = State(["c"], ["n"], Options(warmup=40, every=10, buffer=60, **options), {})
    for row in rows(n):
        made.learn(row)
    return made


def test_rows_scored_together_and_alone():
    made = state(95, headroom=0)
    asked = [*rows(30), SimpleNamespace(c="unseen", n=1.0), *rows(3)]
    together = made.score(asked)
    assert together == [made.score([r])[0] for r in asked]
    # The vocabulary of five has no room for a sixth.
    assert together[30][:2] == (None, "category of 'c' is beyond its embedding table")
    score, error, parts = together[1]
    assert error is None and 0 <= score <= 100 and sum(p for _, p in parts) == pytest.approx(score, abs=1e-3)
    assert state(39).score(rows(2)) == [(None, None, [])] * 2 and made.score([]) == []


def test_baseline_is_the_share_of_smaller_errors():
    made = state(95)
    ids, x = made._matrix(made.rows)
    errors = made.net.errors(ids, x).mean(1).round(12)
    # The last retraining was at row 90; the baseline is of the buffer as it was then.
    assert len(made.baseline) == 60 and made.baseline == sorted(made.baseline)
    for row, (score, _, _) in zip(rows(20), made.score(rows(20)), strict=True):
        i, v, _ = made.encode(row, False)
        error = round(float(made.net.errors(*made._matrix([(i, v)])).mean()), 12)
        below = 100 * sum(b < error for b in made.baseline) / 60
        assert score == pytest.approx(np.interp(below, *zip(*autoencoder.SCALE, strict=True)))
    assert len(errors) == 60


def test_learned_and_scored_rows_in_turn(spark):
    """In one key, rows that learn and rows that are scored alternate; each is scored by what came before it."""
    given = [(i, r.c, r.n, i % 4 != 3) for i, r in enumerate(rows(200))]
    df = spark.createDataFrame(given, "at long, c string, n double, learns boolean").withColumn("k", F.lit("x"))
    options = Options(warmup=40, every=10, buffer=60)
    got = {r.at: (r.score, r.buffered, r.events_since_retrain) for r in autoencoder.scored(df, ["k"], ["at"], ["c"], ["n"], "learns", "at", options).collect()}
    made, want = State(["c"], ["n"], options, {}), {}
    for at, c, n, learns in given:
        row = SimpleNamespace(c=c, n=n)
        if learns:
            made.learn(row)
        else:
            want[at] = (made.score([row])[0][0], len(made.rows), (made.seen - 40) % 10 if made.seen >= 40 else None)
    assert got == want


def test_steps_touch_the_moments_of_looked_up_rows_as_a_dense_step_would():
    """Bit for bit, over enough steps that the divisors of the moments are 1, with rows that are looked up often, once and never."""
    o = Options(headroom=2, epochs=1, batch=12)
    net, (ids, x) = Network([30, 5], 2, o), batch()
    p, m, v = (net.flat[k].copy() for k in "pmv")
    rng = np.random.default_rng(9)
    for t in range(1, 401):
        now = ids + [[20 if t == 7 else 0, 0]]
        at = rng.permutation(len(x))[:8]
        net._learn(now[at], x[at])
        g = net.flat["g"]
        m *= 0.9
        m += g * 0.1
        v *= 0.999
        v += g * 0.001 * g
        p -= m / (1 - 0.9**t) * o.rate / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert (net.flat["p"] == p).all() and (net.flat["m"] == m).all() and (net.flat["v"] == v).all()


def test_marks_of_keys_take_no_step_for_each_row(spark, monkeypatch):
    """Keys are told apart column by column: a call for each row took more of a task than its network."""
    import pandas as pd

    from outlyr.operators import sequential

    seen, by_key = {}, sequential.by_key
    df = spark.createDataFrame([(i, None if i % 3 == 0 else f"k{i % 2}", i % 2) for i in range(60)], "at long, a string, b long")
    monkeypatch.setattr(type(df), "mapInPandas", lambda self, run, schema: seen.update(run=run))
    by_key(df, ["a", "b"], ["at"], list, lambda state, rows: rows[["a", "b"]].assign(n=range(len(state), len(state) + len(state.extend(rows["at"]) or rows))), "a string, b long, n long")
    monkeypatch.setattr(pd.DataFrame, "apply", lambda *_, **__: pytest.fail("a call for each row"))
    rows = df.toPandas().sort_values(["a", "b", "at"], na_position="first")
    got = pd.concat(seen["run"](iter([rows.iloc[:25], rows.iloc[25:]])))
    assert got["n"].tolist() == rows.groupby(["a", "b"], dropna=False).cumcount().tolist()
