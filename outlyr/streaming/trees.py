"""Half-space trees over a stream: each key's counts of the current and of the last whole window in the state store.

Rows that learn are counted at the nodes of their paths; the others are scored with the last whole window of their moment,
as the batch operator scores with the last window of all. State is two arrays of trees * 2^(height + 1) numbers a key.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from outlyr.operators.trees import LITTLE, Forest


class Trees(StatefulProcessor):
    def __init__(self, forest: Forest, window: int, order: str, features: str, learns: str, event: str):
        self.window, self.height, self.trees = window, forest.height, forest.trees
        self.feature, self.threshold = np.array(forest.feature), np.array(forest.threshold)
        self.order, self.features, self.learns, self.event = order, features, learns, event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("trees", "seen long, current array<long>, reference array<long>")

    def _path(self, x: np.ndarray) -> np.ndarray:
        """[trees, height + 1]: the nodes of each tree."""
        tree, node = np.arange(self.trees), np.ones(self.trees, int)
        out = [node]
        for _ in range(self.height):
            node = 2 * node + (np.nan_to_num(x[self.feature[tree, node]], nan=-np.inf).round(9) >= self.threshold[tree, node])
            out.append(node)
        return np.stack(out, 1)

    def _score(self, path: np.ndarray, mass: np.ndarray) -> float:
        m = mass[np.arange(self.trees)[:, None], path]
        before = np.minimum.accumulate(m, 1)
        open_ = np.concatenate([np.ones((self.trees, 1), bool), before[:, :-1] >= LITTLE * self.window], 1)
        total = (np.where(open_, m, 0) * 2.0 ** np.arange(self.height + 1)).sum()
        return float(np.clip(100 * (1 - total / (self.trees * self.window * ((2 << self.height) - 1))), 0, 100))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        size = (self.trees, 2 << self.height)
        seen, current, reference = self.state.get() if self.state.exists() else (0, [], [])
        now = np.array(current, np.int64).reshape(size) if len(current) else np.zeros(size, np.int64)
        last = np.array(reference, np.int64).reshape(size) if len(reference) else None
        batch = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        out = []
        for event, x, learns in batch[[self.event, self.features, self.learns]].itertuples(index=False):
            path = self._path(np.array(x, float))
            if not learns:
                out.append((*key, event, None if last is None else self._score(path, last)))
                continue
            now[np.arange(self.trees)[:, None], path] += 1
            seen += 1
            if seen % self.window == 0:
                last, now = now, np.zeros(size, np.int64)
        self.state.update((seen, now.ravel().tolist(), [] if last is None else last.ravel().tolist()))
        yield pd.DataFrame(out, columns=["key", "event", "score"]).astype({"score": "float64"})

    def close(self) -> None:
        pass


def scored(stream: DataFrame, key: str, order: str, features: str, learns: str, event: str, forest: Forest, window: int) -> DataFrame:
    """key, event, score of each row that does not learn; a micro-batch's rows of a key are taken in their order."""
    kinds = f"key {stream.schema[key].dataType.simpleString()}, event {stream.schema[event].dataType.simpleString()}, score double"
    return stream.groupBy(key).transformWithStateInPandas(Trees(forest, window, order, features, learns, event), outputStructType=kinds, outputMode="Append", timeMode="None")
