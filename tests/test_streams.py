"""Streams over several landed files: late rows, repeats and publication retries."""

from __future__ import annotations

import os

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from tarnscope.streaming import streams as st

SCHEMA = StructType([StructField("product", StringType()), StructField("layer", StringType()), StructField("at", TimestampType())])


def land(path, name, rows):
    import json

    path.mkdir(exist_ok=True)
    lines = [json.dumps({"product": p, "layer": y, "at": t}) for p, y, t in rows]
    (path / name).write_text("\n".join(lines) + "\n")


def source(spark, path):
    return st.landed(spark, str(path), SCHEMA, "json", files_per_trigger=1)


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    # A batch judges lateness by the watermark the batch before it ended with, so the late row
    # comes two files after the row that closed its window.
    land(tmp_path / "in", "1.json", [("a", "B1", "2024-01-01T01:00:00Z"), ("b", "B1", "2024-01-05T00:00:00Z")])
    land(tmp_path / "in", "2.json", [("c", "B1", "2024-01-06T00:00:00Z")])
    land(tmp_path / "in", "3.json", [("late", "B1", "2024-01-01T02:00:00Z"), ("d", "B1", "2024-01-09T00:00:00Z")])
    for i in (1, 2, 3):
        os.utime(tmp_path / "in" / f"{i}.json", (i, i))
    counted = st.arrivals(source(spark, tmp_path / "in"), "at", [], "1 day", None, "1 day")
    query = (
        counted.writeStream.format("memory").queryName("late_rows").outputMode("append")
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    got = {str(r.start)[:10]: r.n for r in spark.table("late_rows").collect()}
    assert got == {"2024-01-01": 1, "2024-01-05": 1, "2024-01-06": 1}
    assert st.dropped_late(query) == 1


def test_repeats_over_files_are_dropped(spark, tmp_path):
    land(tmp_path / "in", "1.json", [("a", "B1", "2024-01-01T01:00:00Z")])
    land(tmp_path / "in", "2.json", [("a", "B2", "2024-01-02T01:00:00Z"), ("b", "B1", "2024-01-02T00:00:00Z")])
    out = st.run_to_table(st.first_seen(source(spark, tmp_path / "in"), ["product"], "at", "30 days"), "dedup")
    assert sorted(r.product for r in out.collect()) == ["a", "b"]


def test_scene_completeness_needs_every_layer(spark, tmp_path):
    rows = [("a", "B1", "2024-01-01T01:00:00Z"), ("a", "B2", "2024-01-01T02:00:00Z"), ("b", "B1", "2024-01-01T03:00:00Z"), ("b", "B1", "2024-01-01T04:00:00Z"), ("z", "B1", "2024-02-01T00:00:00Z")]
    land(tmp_path / "in", "1.json", rows)
    out = st.run_to_table(st.scene_completeness(source(spark, tmp_path / "in"), "at", ["product"], "layer", 2, "1 day", "1 hour"), "complete")
    assert {r.product: r.complete for r in out.collect()} == {"a": True, "b": False}


def test_publication_survives_a_retry(spark, tmp_path):
    schema = "product string, at timestamp"
    first = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-02"), ("b", "2024-01-03")], "product string, t string").select("product", F.to_timestamp("t").alias("at"))
    second = spark.createDataFrame([("a", "2024-02-01"), ("c", "2024-02-02")], "product string, t string").select("product", F.to_timestamp("t").alias("at"))
    write = st.publish_to(str(tmp_path / "pub"), ["product"], "at")
    write(first, 0)
    write(second, 1)
    write(second, 1)
    got = sorted((r.product, str(r.at)[:10]) for r in spark.read.schema(schema + ", batch int").parquet(str(tmp_path / "pub")).collect())
    assert got == [("a", "2024-01-01"), ("b", "2024-01-03"), ("c", "2024-02-02")]


def scenes_of(spark, tmp_path, files, delay="1 hour", wait="2 days"):
    from tarnscope.streaming.scenes import scene_states

    for i, rows in enumerate(files, 1):
        land(tmp_path / "in", f"{i}.json", rows)
        os.utime(tmp_path / "in" / f"{i}.json", (i, i))
    out = st.run_to_table(scene_states(source(spark, tmp_path / "in"), "at", ["product"], "layer", 3, wait, delay), "states")
    return sorted((r.product, str(r["first"]), str(r["last"]), r.layers, r.objects, r.complete) for r in out.collect())


def test_a_scene_over_midnight_comes_once_and_an_incomplete_one_after_its_wait(spark, tmp_path):
    files = [
        [("a", "B1", "2024-01-01T23:50:00Z"), ("b", "B1", "2024-01-01T10:00:00Z"), ("b", "B1", "2024-01-01T11:00:00Z")],
        [("a", "B2", "2024-01-02T00:10:00Z"), ("a", "B3", "2024-01-02T00:20:00Z"), ("a", "B3", "2024-01-02T00:30:00Z"), ("b", None, "2024-01-02T00:00:00Z")],
        [("z", "B1", "2024-02-01T00:00:00Z")],
        [("z", "B2", "2024-02-01T01:00:00Z")],
    ]
    assert scenes_of(spark, tmp_path, files) == [
        ("a", "2024-01-01 23:50:00", "2024-01-02 00:20:00", 3, 3, True),
        ("b", "2024-01-01 10:00:00", "2024-01-03 10:00:00", 1, 3, False),
    ]


def test_objects_beyond_the_wait_start_another_scene(spark, tmp_path):
    files = [
        [("a", "B1", "2024-01-01T00:00:00Z"), ("a", "B2", "2024-01-04T00:00:00Z")],
        [("a", "B1", "2024-01-04T01:00:00Z"), ("a", "B3", "2024-01-04T02:00:00Z")],
        [("z", "B1", "2024-02-01T00:00:00Z")],
        [("z", "B2", "2024-02-01T01:00:00Z")],
    ]
    assert scenes_of(spark, tmp_path, files) == [
        ("a", "2024-01-01 00:00:00", "2024-01-03 00:00:00", 1, 1, False),
        ("a", "2024-01-04 00:00:00", "2024-01-04 02:00:00", 3, 3, True),
    ]


def test_late_rows_come_as_a_table_by_batch(spark, tmp_path):
    from tarnscope.streaming.metrics import run_with_late_rows

    days = [["01", "05"], ["06"], ["01", "02", "09"], ["05"]]
    for i, found in enumerate(days, 1):
        land(tmp_path / "in", f"{i}.json", [(f"{i}{d}", "B1", f"2024-01-{d}T00:00:00Z") for d in found])
        os.utime(tmp_path / "in" / f"{i}.json", (i, i))
    kept, late = run_with_late_rows(st.first_seen(source(spark, tmp_path / "in"), ["product"], "at", "1 day"), "late_by_batch")
    told = {r["batch"]: (r["rows"], r["dropped"]) for r in late.where("rows > 0").collect()}
    assert told == {0: (2, 0), 1: (1, 0), 2: (3, 2), 3: (1, 1)}
    assert kept.count() == 4
