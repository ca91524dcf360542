"""What a stream's watermark dropped, batch by batch, as a table."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

from tarnscope.session import scratch_path

LATE = "query string, batch long, rows long, dropped long, watermark string"
KEPT = 200


class LateRows(StreamingQueryListener):
    """Gathers the progress of named queries; every ``KEPT`` batches go to a file, so a stream may run on."""

    def __init__(self, spark: SparkSession, names: tuple[str, ...]) -> None:
        self.spark, self.names, self.path = spark, names, scratch_path(spark, "late-rows")
        self.rows: list[tuple] = []
        self.files = 0
        self.running: set[str] = set()
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:
        if event.name in self.names:
            self.running.add(str(event.id))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        # Events come in order, so nothing of the query follows this one.
        if str(event.id) in self.running:
            self.ended.set()

    def onQueryProgress(self, event) -> None:
        self.add(json.loads(event.progress.json))

    def add(self, progress: dict) -> None:
        if progress.get("name") not in self.names:
            return
        dropped = sum(o.get("numRowsDroppedByWatermark", 0) for o in progress.get("stateOperators", ()))
        self.rows.append((progress["name"], progress["batchId"], progress.get("numInputRows", 0), dropped, progress.get("eventTime", {}).get("watermark")))
        if len(self.rows) >= KEPT:
            self.flush()

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        self.spark.createDataFrame(rows, LATE).coalesce(1).write.parquet(f"{self.path}/part={self.files}")
        self.files += 1

    def table(self) -> DataFrame:
        """``query, batch, rows, dropped, watermark``, one row per batch; a batch told twice counts once."""
        if self.rows or not self.files:
            self.flush()
        return self.spark.read.schema(LATE).parquet(*[f"{self.path}/part={i}" for i in range(self.files)]).dropDuplicates(["query", "batch"])


def run_with_late_rows(stream: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """Run a stream over what is available; the table it wrote, and what each of its batches dropped.

    A stateful operator tells the rows that reach it, so a stream counts raw rows only where nothing
    aggregates before it.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    listener = LateRows(spark, (name,))
    spark.streams.addListener(listener)
    try:
        query = (
            stream.writeStream.queryName(name).format("parquet").outputMode("append")
            .option("path", f"{base}/data").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        if not listener.ended.wait(timeout=120):
            raise TimeoutError(f"the end of stream {name} was not told")
    finally:
        spark.streams.removeListener(listener)
    return spark.read.schema(stream.schema).parquet(f"{base}/data"), listener.table()
