"""Explicit schemas of the sources. Nothing is inferred: inference would flip a scale between
integer and float from file to file and drop fields that happen to be absent."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
)


def struct(**fields) -> StructType:
    return StructType([StructField(name, kind, True) for name, kind in fields.items()])


TEXT, REAL, WHOLE, BIG, FLAG = StringType(), DoubleType(), IntegerType(), LongType(), BooleanType()

RASTER_BAND = struct(data_type=TEXT, scale=REAL, offset=REAL, nodata=REAL, spatial_resolution=REAL)
ASSET = StructType(
    [
        StructField("href", TEXT),
        StructField("type", TEXT),
        StructField("proj:transform", ArrayType(REAL)),
        StructField("proj:shape", ArrayType(WHOLE)),
        StructField("raster:bands", ArrayType(RASTER_BAND)),
        StructField("file:size", BIG),
    ]
)
PROPERTIES = StructType(
    [
        StructField(name, TEXT)
        for name in (
            "datetime", "platform", "grid:code", "s2:processing_baseline", "processing:version", "s2:sequence", "s2:product_uri",
            "s2:generation_time", "s2:datatake_id", "s2:datastrip_id", "created", "updated", "proj:code",
        )
    ]
    + [
        StructField("processing:software", MapType(TEXT, TEXT)),
        StructField("earthsearch:boa_offset_applied", FLAG),
        StructField("eo:cloud_cover", REAL),
        StructField("s2:nodata_pixel_percentage", REAL),
        StructField("proj:epsg", WHOLE),
        StructField("storage:requester_pays", FLAG),
    ]
)
CATALOG_FEATURE = struct(id=TEXT, collection=TEXT, properties=PROPERTIES, assets=MapType(TEXT, ASSET))

# Coordinates stay JSON text: polygons and multipolygons nest to different depths.
GEOMETRY = struct(type=TEXT, coordinates=TEXT)
BODY_PROPERTIES = struct(
    water_body_id=TEXT, name=TEXT, region=TEXT, tier=TEXT, size_class_m=WHOLE, area_m2=REAL, width_m=REAL, why=TEXT
)
BODY_FEATURE = struct(properties=BODY_PROPERTIES, bbox=ArrayType(REAL), geometry=GEOMETRY)

LISTING_PAGE = StructType(
    [
        StructField("IsTruncated", TEXT),
        StructField("NextContinuationToken", TEXT),
        StructField(
            "Contents",
            ArrayType(struct(Key=TEXT, LastModified=TEXT, ETag=TEXT, Size=TEXT, StorageClass=TEXT)),
        ),
        StructField("CommonPrefixes", ArrayType(struct(Prefix=TEXT))),
    ]
)
LISTED_OBJECT = struct(Key=TEXT, LastModified=TEXT, ETag=TEXT, Size=TEXT, StorageClass=TEXT)
RASTER_HEADER = struct(
    item=TEXT, asset=TEXT, epsg=WHOLE, dtype=TEXT, nodata=REAL, scale=REAL, offset=REAL, rows=WHOLE, cols=WHOLE,
    transform=ArrayType(REAL), block_height=WHOLE, block_width=WHOLE, overviews=ArrayType(WHOLE),
)
ARCHIVE_PRODUCT = struct(
    Name=TEXT, OriginDate=TEXT, PublicationDate=TEXT, ModificationDate=TEXT, ContentDate=struct(Start=TEXT)
)
