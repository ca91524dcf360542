"""Scene completeness as state per product: a value and a timer, no windows that cut a scene.

A scene starts with a product's first object and waits a fixed time for the rest of its layers. It comes out
once: complete with the object that completes it, or incomplete when its wait is over. Objects that arrive
after that, within the wait, belong to the scene that is out; the first one beyond it starts another.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

if TYPE_CHECKING:
    import pandas as pd

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "first long, objects long, layers array<string>, out boolean"
RESULT = "first long, last long, layers int, objects long, complete boolean"


class SceneProcessor(StatefulProcessor):
    """Rows ``keys, at`` (microseconds) ``, layer`` of one product, in any order within a batch."""

    def __init__(self, keys: Sequence[str], wanted: int, wait_us: int) -> None:
        self.keys, self.wanted, self.wait = tuple(keys), wanted, wait_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scene = handle.getValueState("scene", STATE)

    def result(self, key: tuple, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        if rows:
            yield pd.DataFrame([(*key, *r) for r in rows], columns=[*self.keys, "first", "last", "layers", "objects", "complete"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = sorted((int(at), layer) for frame in rows for at, layer in zip(frame["at"], frame["layer"], strict=True))
        first, objects, layers, out = self.scene.get() if self.scene.exists() else (None, 0, [], False)
        before, layers, done = first, set(layers), []
        for at, layer in found:
            if first is None or at > first + self.wait:
                if first is not None and not out:
                    done.append((first, first + self.wait, len(layers), objects, False))
                first, objects, layers, out = at, 0, set(), False
            if out:
                continue
            objects += 1
            if layer is not None:
                layers.add(layer)
            if len(layers) == self.wanted:
                done.append((first, at, len(layers), objects, True))
                out = True
        if first != before:
            if before is not None:
                self.handle.deleteTimer(self.expiry(before))
            self.handle.registerTimer(self.expiry(first))
        self.scene.update((first, objects, sorted(layers), out))
        yield from self.result(key, done)

    def expiry(self, first: int) -> int:
        """Milliseconds at which the wait of a scene is over, rounded up."""
        return -(-(first + self.wait) // 1000)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.scene.exists():
            first, objects, layers, out = self.scene.get()
            self.scene.clear()
            yield from self.result(key, [] if out else [(first, first + self.wait, len(layers), objects, False)])

    def close(self) -> None:
        pass


def scene_states(stream: DataFrame, at: str, keys: Sequence[str], layer: str, wanted: int, wait: str, delay: str) -> DataFrame:
    """``keys, first, last, layers, objects, complete``: one row per scene, when it is complete or its wait is over.

    ``last`` is the time of the object that completes a scene, or the end of its wait. State holds one
    product's open scene, its layer names bounded by ``wanted``, and ends with its timer. Objects without a
    layer count as objects only; rows without a time are left out.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    wait_us = spark.sql(f"SELECT CAST(unix_micros(TIMESTAMP'1970-01-01 00:00:00Z' + INTERVAL '{wait}') AS BIGINT)").first()[0]
    rows = stream.where(F.col(at).isNotNull()).withWatermark(at, delay)
    rows = rows.select(*keys, F.col(at).alias("_event"), F.unix_micros(at).alias("at"), F.col(layer).alias("layer"))
    schema = T.StructType([*(stream.schema[k] for k in keys), *T._parse_datatype_string(RESULT).fields])
    out = rows.groupBy(*keys).transformWithStateInPandas(statefulProcessor=SceneProcessor(keys, wanted, wait_us), outputStructType=schema, outputMode="append", timeMode="eventTime")
    return out.select(*keys, F.timestamp_micros("first").alias("first"), F.timestamp_micros("last").alias("last"), "layers", "objects", "complete")
