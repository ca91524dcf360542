"""Streams over landed files. Each has a batch twin that gives its expected result.

A stream function takes a streaming DataFrame and returns one; ``run_to_table`` drives it to the
end of the available data into a parquet table below the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnscope.session import scratch_path


def landed(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """Files landing below a path, read with an explicit schema."""
    reader = spark.readStream.schema(schema).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def schema_of(ddl: str) -> StructType:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(ddl)


def land_in_order(df: DataFrame, part: str, parts: Iterable, files: int) -> str:
    """Write the rows of each part as ``files`` files, part after part, and return their folder: a stream that
    takes as many files a trigger reads one part a batch."""
    path = scratch_path(df.sparkSession, "landed")
    for value in parts:
        df.where(F.col(part) == value).repartition(files, F.rand(7)).write.mode("append").parquet(path)
    return path


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Process what is available, then read the written table back."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("path", f"{base}/data").option("checkpointLocation", f"{base}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/data")


def first_seen(stream: DataFrame, keys: Sequence[str], at: str, delay: str) -> DataFrame:
    """Drop repeats of a product that arrive within the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(list(keys))


def arrivals(stream: DataFrame, at: str, keys: Sequence[str], width: str, slide: str | None, delay: str) -> DataFrame:
    """Arrivals per tumbling or sliding window."""
    span = F.window(at, width, slide) if slide else F.window(at, width)
    counted = stream.withWatermark(at, delay).groupBy(span, *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def latency_bins(stream: DataFrame, at: str, keys: Sequence[str], hours: Column, width: str, delay: str) -> DataFrame:
    """Counts per whole-hour bin and window. Exact percentiles need all rows and stay in batch."""
    binned = stream.withWatermark(at, delay).withColumn("hour", F.floor(hours).cast("bigint"))
    counted = binned.groupBy(F.window(at, width), *keys, "hour").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "hour", "n")


def pass_sessions(stream: DataFrame, at: str, keys: Sequence[str], gap: str, delay: str) -> DataFrame:
    """Datastrips of one pass as sessions closed by a gap."""
    counted = stream.withWatermark(at, delay).groupBy(F.session_window(at, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def scene_completeness(stream: DataFrame, at: str, keys: Sequence[str], layer: str, wanted: int, width: str, delay: str) -> DataFrame:
    """Scenes of a window with the layers they hold and whether they are complete. State is the
    set of layer names, bounded by their number."""
    grouped = stream.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(
        F.collect_set(layer).alias("_layers"), F.count(F.lit(1)).alias("objects")
    )
    return grouped.select(
        F.col("window.start").alias("start"), *keys, F.size("_layers").alias("layers"), "objects", (F.size("_layers") == wanted).alias("complete")
    )


def with_static(stream: DataFrame, static: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A stream joined to a table at rest."""
    return stream.join(static, list(keys), how)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def publish_to(path: str, keys: Sequence[str], at: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that appends only keys not yet published.

    Each batch owns one partition folder and overwrites it, so a batch that is run again after a
    failure writes the same rows to the same place.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        from tarnscope.operators.contract import publish

        spark = batch.sparkSession
        if path_exists(spark, path):
            earlier = spark.read.parquet(path).where(F.col("batch") != batch_id).select(*keys)
        else:
            earlier = batch.select(*keys).limit(0)
        fresh = publish(earlier, batch, keys, at)
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def publish_stream(stream: DataFrame, keys: Sequence[str], at: str, name: str) -> DataFrame:
    """Run an append publication over what is available and read the publications."""
    spark = stream.sparkSession
    base = scratch_path(spark, name)
    query = (
        stream.writeStream.foreachBatch(publish_to(f"{base}/data", keys, at))
        .option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(f"{base}/data").drop("batch")


def dropped_late(query) -> int:
    """Rows the watermark dropped, from the query's progress reports."""
    total = 0
    for progress in query.recentProgress:
        for operator in progress["stateOperators"]:
            total += operator.get("numRowsDroppedByWatermark", 0)
    return total
