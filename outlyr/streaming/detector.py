"""A streaming detector: running standardisation and frequency of each key, with keyed state in the state store.

What a row gets is what the batch encoders give it: z-scores over rows up to it, shares of the values before it. Rows of a
micro-batch are taken in their order; state is three numbers, two bounds and a count for each value of a key.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from outlyr.operators.encoders import CLIP

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Running(StatefulProcessor):
    def __init__(self, order: str, value: str, category: str):
        self.order, self.value, self.category = order, value, category

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.moments = handle.getValueState("moments", "n long, mean double, m2 double, low double, high double, seen long")
        self.counts = handle.getMapState("counts", "value string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, mean, m2, low, high, seen = self.moments.get() if self.moments.exists() else (0, 0.0, 0.0, None, None, 0)
        known: dict[str, int] = {}
        for batch in sorted(rows, key=lambda b: b[self.order].min() if len(b) else 0):
            batch = batch.sort_values(self.order, kind="stable")
            out = []
            for at, v, c in batch[[self.order, self.value, self.category]].itertuples(index=False):
                z = None
                if v is not None and v == v:
                    n += 1
                    step = v - mean
                    mean += step / n
                    m2 += step * (v - mean)
                    low, high = (v, v) if low is None else (min(low, v), max(high, v))
                    z = 0.0 if n < 2 or low == high else max(-CLIP, min(CLIP, (v - mean) / (m2 / n) ** 0.5))
                share = None
                if c is not None:
                    if c not in known:
                        known[c] = self.counts.getValue((c,))[0] if self.counts.containsKey((c,)) else 0
                    share = known[c] / seen if seen else 0.0
                    known[c] += 1
                    seen += 1
                out.append((*key, at, z, share))
            yield pd.DataFrame(out, columns=["key", "at", "z", "share"])
        for c, k in known.items():
            self.counts.updateValue((c,), (k,))
        self.moments.update((n, mean, m2, low, high, seen))

    def close(self) -> None:
        pass


def encoded(stream: DataFrame, key: str, order: str, value: str, category: str) -> DataFrame:
    """key, at, z, share of each row of a stream; the session's state store provider must be PROVIDER."""
    kinds = f"key {stream.schema[key].dataType.simpleString()}, at {stream.schema[order].dataType.simpleString()}, z double, share double"
    return stream.groupBy(key).transformWithStateInPandas(Running(order, value, category), outputStructType=kinds, outputMode="Append", timeMode="None")
