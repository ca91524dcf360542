"""Sources over real files, and saved results."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.errors import PySparkException

from tarnscope.sources import catalog as cat
from tarnscope.sources import files as fs


def test_catalog_listing_files(spark, tmp_path):
    feature = {
        "id": "S2B_10SGJ_20240105_0_L2A", "collection": "c1", "links": [],
        "properties": {"datetime": "2024-01-05T19:00:00Z", "grid:code": "MGRS-10SGJ", "eo:cloud_cover": 3, "processing:software": {"b": "2", "a": "1"}},
        "assets": {"red": {"href": "https://h.example/r.tif", "type": "image/tiff; profile=cloud-optimized", "raster:bands": [{"scale": 1, "offset": 0}]}},
    }
    (tmp_path / "a.json").write_text(json.dumps([feature, feature | {"id": "S2X_x"}]))
    rows = cat.normalize_primary(cat.read_features(spark, str(tmp_path / "a.json"))).collect()
    first = next(r for r in rows if r.id.startswith("S2B"))
    assert (first.platform, first.tile, first.cloud_cover, first.software) == ("b", "10SGJ", 3.0, '{"a":"1","b":"2"}')
    assert next(r for r in rows if r.id == "S2X_x").platform == "?"


def test_listing_pages_as_files(spark, tmp_path):
    page = (
        '<?xml version="1.0"?><ListBucketResult xmlns="http://s3.amazonaws.com/doc/2006-03-01/"><IsTruncated>false</IsTruncated>'
        "<Contents><Key>a/b.tif</Key><LastModified>2024-01-01T00:00:00.000Z</LastModified><ETag>&quot;e1&quot;</ETag><Size>7</Size></Contents>"
        "<Contents><Key>a/c.tif</Key></Contents></ListBucketResult>"
    )
    (tmp_path / "p.xml").write_text(page)
    rows = {r.key: r for r in fs.read_listing(spark, str(tmp_path / "p.xml")).collect()}
    assert (rows["a/b.tif"].size, rows["a/b.tif"].etag) == (7, "e1")
    assert (rows["a/c.tif"].size, rows["a/c.tif"].etag) == (0, "")


def test_settings_files(spark, tmp_path):
    (tmp_path / "s1.txt").write_text("# c\n\nlimit=1\n ; x\nlimit = 2\nname=a=b\nnothing\n")
    got = {r.key: r.value for r in fs.read_settings(spark, str(tmp_path)).collect()}
    assert got == {"limit": "2", "name": "a=b"}


def test_bodies_and_rings(spark, tmp_path):
    square = [[[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]]
    features = [
        {"type": "Feature", "properties": {"water_body_id": "n1", "region": "r1", "tier": "large"}, "bbox": [0, 0, 2, 2], "geometry": {"type": "Polygon", "coordinates": square}},
        {"type": "Feature", "properties": {"water_body_id": "n2", "region": "r2"}, "bbox": [0, 0, 2, 2], "geometry": {"type": "MultiPolygon", "coordinates": [square, square]}},
    ]
    (tmp_path / "m.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}))
    bodies = fs.read_bodies(spark, str(tmp_path / "m.geojson"))
    assert fs.wanted_bodies(bodies, regions=["r1"]).count() == 1
    assert fs.rings_of(bodies, ["water_body_id"]).count() == 3


def test_changed_response_is_refused(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "x.json").write_text("one")
    digest = hashlib.sha256(b"one").hexdigest()
    manifest = tmp_path / "manifest.jsonl"
    manifest.write_text(fs.to_manifest_json([{"name": "x.json", "sha256": digest}]))
    assert fs.load_run(spark, str(manifest), str(tmp_path / "r")).count() == 1
    (tmp_path / "r" / "x.json").write_text("two")
    with pytest.raises(PySparkException):
        fs.load_run(spark, str(manifest), str(tmp_path / "r")).collect()


def test_masks_are_read_by_partition(spark, tmp_path):
    rows = [("b", "T1", 10, 1, 2, 1), ("b", "T2", 10, 1, 2, 1), ("b", "T1", 20, 1, 2, 1)]
    df = spark.createDataFrame(rows, "body string, tile_id string, resolution_m int, row long, col long, pixel_class int")
    path = str(tmp_path / "masks")
    fs.save_masks(df, path)
    one = fs.load_masks(spark, path, "T1", 10)
    assert one.count() == 1
    assert "PartitionFilters: [isnotnull(tile_id" in one._jdf.queryExecution().executedPlan().toString()


def test_repeated_page_is_refused(spark):
    pages = spark.createDataFrame([("s", "d1", 1), ("s", "d1", 2)], "search string, digest string, page int")
    with pytest.raises(PySparkException):
        cat.pages_once(pages, "search", "digest", "page").collect()


def test_archive_records(spark, tmp_path):
    record = {"Name": "S2A_MSIL2A_x.SAFE", "PublicationDate": "2024-01-02T00:00:00Z", "ContentDate": {"Start": "2024-01-01T00:00:00Z"}}
    (tmp_path / "p.json").write_text(json.dumps([record]))
    row = cat.read_archive_products(spark, str(tmp_path / "p.json")).first()
    assert (row.product, row.esa_origin, row.sensing_start) == ("S2A_MSIL2A_x", None, "2024-01-01T00:00:00Z")
