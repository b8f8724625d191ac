"""An autoencoder for each key: numpy network, bounded buffer, retraining on a schedule, percentile scores.

Categories are looked up in embeddings that train with the rest (the loss reaches them through the input and through the
target); numbers stand beside an is-present flag. The share of the buffer's errors below an event's error is its percentile.
"""

import io
import json
from collections import deque
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from outlyr.functions.labels import SCALE
from outlyr.operators.sequential import by_key


@dataclass(frozen=True)
class Options:
    buffer: int = 500
    every: int = 50
    epochs: int = 2
    warmup: int = 100
    batch: int = 50
    embed: int = 8
    bottleneck: int | None = None
    headroom: int = 50
    rate: float = 1e-3
    seed: int = 42


class Network:
    """Embeddings and numbers to a wide rectified layer, a narrow tanh layer, and back."""

    def __init__(self, sizes: list[int], numbers: int, o: Options):
        rng = np.random.default_rng(o.seed)
        self.o, self.rng, self.numbers, self.step = o, rng, numbers, 0
        self.widths = [max(2, min(o.embed, v // 2 + 1)) for v in sizes]
        total = sum(self.widths) + 2 * numbers
        narrow = o.bottleneck or max(total // 2, 2)
        wide = max(2 * total, 16)
        layers = [(total, wide), (wide, narrow), (narrow, wide), (wide, total)]
        first = [rng.uniform(-1, 1, (a, b)) / np.sqrt(a) for a, b in layers] + [rng.uniform(-1, 1, b) / np.sqrt(a) for a, b in layers]
        first += [rng.standard_normal((v + o.headroom, w)) for v, w in zip(sizes, self.widths, strict=True)]
        # Numbers of one kind lie in one array, which a step moves at once; p, m, v and g are views of its parts. Embeddings come
        # last: a step has gradients for the rows that its batch looks up alone, held in looked.
        self.flat = {kind: np.zeros(sum(a.size for a in first)) for kind in "pmvgtu"}
        ends = np.cumsum([a.size for a in first])
        self.dense, self.looked = ends[7], np.zeros((0, len(sizes)), np.int64)
        self.p, self.m, self.v, self.g = ([self.flat[kind][e - a.size : e].reshape(a.shape) for a, e in zip(first, ends, strict=True)] for kind in "pmvg")
        for own, a in zip(self.p, first, strict=True):
            own[...] = a

    @staticmethod
    def _numbers(x: np.ndarray) -> np.ndarray:
        present = ~np.isnan(x)
        return np.stack([np.where(present, x, 0.0), present], 2).reshape(len(x), -1)

    def _input(self, ids: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return np.concatenate([*[self.p[8 + k][ids[:, k]] for k in range(len(self.widths))], numbers], 1)

    def _forward(self, x: np.ndarray):
        w, b = self.p[:4], self.p[4:8]
        h1 = x @ w[0]
        h1 += b[0]
        np.maximum(h1, 0, out=h1)
        h2 = h1 @ w[1]
        h2 += b[1]
        np.tanh(h2, out=h2)
        h3 = h2 @ w[2]
        h3 += b[2]
        np.maximum(h3, 0, out=h3)
        out = h3 @ w[3]
        out += b[3]
        return h1, h2, h3, out

    def errors(self, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Squared error of each input of each row."""
        z = self._input(ids, self._numbers(x))
        return (self._forward(z)[3] - z) ** 2

    def train(self, ids: np.ndarray, x: np.ndarray) -> None:
        # What is left of gradients long gone is too small to be seen, and slow to multiply.
        m = self.flat["m"]
        m[np.abs(m) < 1e-290] = 0
        numbers = self._numbers(x)
        for _ in range(self.o.epochs):
            order = self.rng.permutation(len(x))
            for at in range(0, len(order), self.o.batch):
                part = order[at : at + self.o.batch]
                self._learn(ids[part], x[part], numbers[part])

    def _learn(self, ids: np.ndarray, x: np.ndarray, numbers: np.ndarray | None = None) -> None:
        w, g = self.p[:4], self.g
        z = self._input(ids, self._numbers(x) if numbers is None else numbers)
        h1, h2, h3, out = self._forward(z)
        d = 2 * (out - z) / z.size
        d3 = d @ w[3].T
        d3 *= h3 > 0
        d2 = d3 @ w[2].T
        d2 *= 1 - h2**2
        d1 = d2 @ w[1].T
        d1 *= h1 > 0
        back = d1 @ w[0].T
        back -= d
        for k, (a, b) in enumerate(((z, d1), (h1, d2), (h2, d3), (h3, d))):
            np.matmul(a.T, b, out=g[k])
            np.add.reduce(b, 0, out=g[4 + k])
        at = 0
        for k, width in enumerate(self.widths):
            g[8 + k][self.looked[:, k]] = 0
            np.add.at(g[8 + k], ids[:, k], back[:, at : at + width])
            at += width
        self.looked = ids
        self._move()

    def _move(self) -> None:
        """A step of Adam along the gradient, in place; a gradient of 0 adds nothing to the moments, and is left out."""
        self.step += 1
        p, m, v, g, t, u = self.flat.values()
        m *= 0.9
        v *= 0.999
        g, part = g[: self.dense], t[: self.dense]
        np.multiply(g, 0.1, out=part)
        m[: self.dense] += part
        np.multiply(g, 0.001, out=part)
        part *= g
        v[: self.dense] += part
        for k in range(len(self.widths)):
            # A row that is looked up twice is written twice, with one value.
            rows, own = self.looked[:, k], self.g[8 + k][self.looked[:, k]]
            self.m[8 + k][rows] += own * 0.1
            self.v[8 + k][rows] += own * 0.001 * own
        # In the long run both divisors are 1.
        first, second = 1 - 0.9**self.step, 1 - 0.999**self.step
        np.sqrt(v if second == 1 else np.divide(v, second, out=t), out=t)
        t += 1e-8
        np.multiply(m if first == 1 else np.divide(m, first, out=u), self.o.rate, out=u)
        u /= t
        p -= u


class State:
    """What one key keeps: at most buffer events, category ids, the network and the buffer's sorted errors."""

    def __init__(self, categories: list[str], numbers: list[str], o: Options, slots: dict[str, int]):
        self.categories, self.numbers, self.o, self.slots = categories, numbers, o, slots
        self.used = list(range(len(categories)))
        self.rows: deque = deque(maxlen=o.buffer)
        self.ids: list[dict] = [{} for _ in categories]
        self.net: Network | None = None
        self.seen = 0
        self.baseline: list[float] = []

    def saved(self) -> bytes:
        """All of it as arrays and JSON; nothing is pickled."""
        ids, x = [list(c) for c in zip(*self.rows)] or [[], []]
        told = {"used": self.used, "seen": self.seen, "ids": [list(known.items()) for known in self.ids], "net": None}
        arrays = {"ids": np.array(ids, np.int64).reshape(len(ids), -1), "x": np.array(x, np.float64).reshape(len(x), -1), "baseline": np.array(self.baseline)}
        if self.net is not None:
            told["net"] = {"step": self.net.step, "rng": self.net.rng.bit_generator.state, "sizes": [len(p) - self.o.headroom for p in self.net.p[8:]]}
            arrays |= {f"{name}{i}": a for name in "pmv" for i, a in enumerate(getattr(self.net, name))}
        out = io.BytesIO()
        np.savez(out, told=np.frombuffer(json.dumps(told, default=lambda v: v.item()).encode(), np.uint8), **arrays)
        return out.getvalue()

    def restored(self, data: bytes) -> "State":
        """This state, which has learned nothing yet, with what a saved one held."""
        with np.load(io.BytesIO(data), allow_pickle=False) as held:
            told = json.loads(held["told"].tobytes())
            self.used, self.seen, self.baseline = told["used"], told["seen"], held["baseline"].tolist()
            self.ids = [dict(map(tuple, known)) for known in told["ids"]]
            self.rows.extend(zip(held["ids"].tolist(), held["x"].tolist(), strict=True))
            if told["net"]:
                self.net = Network(told["net"]["sizes"], len(self.numbers), self.o)
                self.net.step, self.net.rng.bit_generator.state = told["net"]["step"], told["net"]["rng"]
                for name in "pmv":
                    for i, own in enumerate(getattr(self.net, name)):
                        own[...] = held[f"{name}{i}"]
        return self

    def encode(self, row, learn: bool) -> tuple[list[int], list[float], str | None]:
        ids, error = [], None
        for known, name in zip(self.ids, self.categories, strict=True):
            v = getattr(row, name)
            if v is None or v != v:
                ids.append(0)
                continue
            if v not in known and learn:
                known[v] = len(known) + 1
            i = known.get(v, len(known) + 1)
            if self.net is not None and len(ids) in self.used and i >= len(self.net.p[8 + self.used.index(len(ids))]):
                error, i = f"category of '{name}' is beyond its embedding table", 0
            ids.append(i)
        return ids, [float("nan") if getattr(row, n) is None else float(getattr(row, n)) for n in self.numbers], error

    def _matrix(self, rows) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array([r[0] for r in rows], np.int64).reshape(len(rows), -1)
        return ids[:, self.used], np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)

    def learn(self, row) -> str | None:
        ids, x, error = self.encode(row, True)
        if error:
            return error
        self.rows.append((ids, x))
        self.seen += 1
        if self.seen >= self.o.warmup and (self.seen - self.o.warmup) % self.o.every == 0:
            if self.net is None:
                # A slot that no row of the buffer fills is no input.
                self.used = [k for k, c in enumerate(self.categories) if c not in self.slots or any(r[0][k] for r in self.rows)]
                self.net = Network([max(len(self.ids[k]), self.slots.get(self.categories[k], 0)) + 1 for k in self.used], len(self.numbers), self.o)
            i, v = self._matrix(self.rows)
            self.net.train(i, v)
            self.baseline = sorted(self.net.errors(i, v).mean(1).round(12).tolist())  # the last digits depend on the batch
        return None

    def score(self, rows: list) -> list[tuple[float | None, str | None, list[tuple[str, float]]]]:
        """Score, error, and each field's share of it, the largest first, of rows that nothing is learned between."""
        if self.net is None:
            return [(None, None, [])] * len(rows)
        coded = [self.encode(row, False) for row in rows]
        good = [(ids, x) for ids, x, error in coded if error is None]
        if not good:
            return [(None, error, []) for _, _, error in coded]
        each = self.net.errors(*self._matrix(good))
        found = 100 * np.searchsorted(self.baseline, each.mean(1).round(12), "left") / len(self.baseline)
        scores = np.interp(found, *zip(*SCALE, strict=True))
        names = [*[self.categories[k] for k in self.used], *self.numbers]
        starts = np.cumsum([0, *self.net.widths, *[2] * len(self.numbers)])[:-1]
        parts = np.add.reduceat(each, starts, 1) if names else np.zeros((len(each), 0))
        total = parts.sum(1)
        parts = (parts / np.where(total == 0, 1.0, total)[:, None] * scores[:, None]).round(4)
        at = np.argsort(-np.abs(parts), 1, kind="stable")
        made = iter([(score, None, [(names[k], p[k]) for k in order]) for score, p, order in zip(scores.tolist(), parts.tolist(), at.tolist(), strict=True)])
        return [next(made) if error is None else (None, error, []) for _, _, error in coded]


def scored(events: DataFrame, keys: list[str], order: list[str], categories: list[str], numbers: list[str], learns: str, id_col: str, options: Options = Options(), keep: list[str] = (), slots: dict[str, int] = {}, before: DataFrame | None = None, finish: bool = False) -> DataFrame:
    """keys, id_col, keep, score, error, buffered, events_since_retrain, top_field, parts of each row that does not learn.

    parts: each field's share of the score by its squared error, the largest first.
    Rows where learns is true are learned in order, the others are scored with the state of their moment. events needs
    all named columns; numbers are encoded already. slots: categories that may stay empty, with the number of values they may take.
    before: keys and state of models that have learned already; finish: states are handed on (see sequential.by_key).
    """

    def step(state: State, rows: pd.DataFrame) -> pd.DataFrame:
        out, shown = [], []
        each, learn = list(rows.itertuples(index=False)), rows[learns].to_numpy(bool)
        # Rows between two that learn meet one state, so they are scored together.
        edges = [*np.flatnonzero(np.diff(learn, prepend=not learn[0])).tolist(), len(each)]
        for start, end in zip(edges, edges[1:], strict=False):
            if learn[start]:
                for at in range(start, end):
                    error = state.learn(each[at])
                    if error is not None:
                        out.append((None, error, len(state.rows), None, None, None))
                        shown.append(at)
                continue
            since = (state.seen - options.warmup) % options.every if state.seen >= options.warmup else None
            for score, error, parts in state.score(each[start:end]):
                out.append((score, error, len(state.rows), since, parts[0][0] if parts else None, [{"field": n, "delta": d} for n, d in parts] if parts else None))
            shown.extend(range(start, end))
        shown = rows.index[shown]
        found = pd.DataFrame(out, columns=["score", "error", "buffered", "events_since_retrain", "top_field", "parts"], index=shown)
        found["score"] = found["score"].astype("float64")
        found["events_since_retrain"] = found["events_since_retrain"].astype("Int64")
        return pd.concat([rows.loc[shown, [*keys, id_col, *keep]], found], axis=1)

    def start() -> State:
        return State(categories, numbers, options, slots)

    kinds = ", ".join(f"{c} {events.schema[c].dataType.simpleString()}" for c in (*keys, id_col, *keep))
    used = events.select(*dict.fromkeys([*keys, *order, id_col, *keep, learns, *categories, *numbers]))
    return by_key(used, keys, order, start, step, f"{kinds}, score double, error string, buffered long, events_since_retrain long, top_field string, parts array<struct<field:string,delta:double>>", before, lambda data: start().restored(data), State.saved if finish else None)
