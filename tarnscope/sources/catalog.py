"""Catalog listings and their assets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnscope.functions import names as nm
from tarnscope.schemas import ARCHIVE_PRODUCT, CATALOG_FEATURE

# Asset keys of the reflectance bands and quality layers, and the public host.
REFLECTANCE_KEYS = (
    "coastal", "blue", "green", "red", "rededge1", "rededge2", "rededge3", "nir", "nir08", "nir09", "swir16", "swir22",
)
QUALITY_KEYS = ("scl", "aot", "wvp", "cloud", "snow")
COG_TYPE = "cloud-optimized"
ITEM_FIELDS = (
    "id", "collection", "datetime", "platform", "tile", "baseline", "sequence", "software", "offset_applied", "cloud_cover", "nodata_pct",
    "product_uri", "generation_time", "created",
)


def read_features(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Features of saved listing files, each a JSON array of features or one per line."""
    return spark.read.schema(CATALOG_FEATURE).json(path, multiLine=True)


def read_archive_products(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Products of the reference archive with their clocks, from saved record files."""
    rows = spark.read.schema(ARCHIVE_PRODUCT).json(path, multiLine=True)
    return rows.select(
        nm.strip_safe(F.col("Name")).alias("product"), F.col("OriginDate").alias("esa_origin"), F.col("PublicationDate").alias("publication"),
        F.col("ContentDate.Start").alias("sensing_start"),
    )


def features_from_text(df: DataFrame, column: str, keep: Sequence[str]) -> DataFrame:
    parsed = df.select(*keep, F.from_json(column, CATALOG_FEATURE).alias("_f"))
    return parsed.select(*keep, "_f.*")


def prop(name: str) -> Column:
    return F.col(f"properties.`{name}`")


def _software() -> Column:
    """Software map as text with sorted keys, null when absent or empty."""
    entries = F.array_sort(F.map_entries(prop("processing:software")))
    return F.when(F.size(entries) > 0, F.to_json(F.map_from_entries(entries)))


def normalize_primary(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Fourteen fixed fields of a catalog row, absent ones null."""
    return features.select(
        *keep,
        "id",
        "collection",
        prop("datetime").alias("datetime"),
        nm.platform_letter(F.coalesce(prop("platform"), F.lit("")), F.col("id")).alias("platform"),
        nm.tile_code(prop("grid:code"), F.col("id")).alias("tile"),
        prop("s2:processing_baseline").alias("baseline"),
        prop("s2:sequence").alias("sequence"),
        _software().alias("software"),
        prop("earthsearch:boa_offset_applied").alias("offset_applied"),
        prop("eo:cloud_cover").alias("cloud_cover"),
        prop("s2:nodata_pixel_percentage").alias("nodata_pct"),
        prop("s2:product_uri").alias("product_uri"),
        prop("s2:generation_time").alias("generation_time"),
        prop("created").alias("created"),
    )


def normalize_reference(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """The same fields from the reference archive's catalog, which declares fewer of them."""
    short = features.select(
        *keep,
        "id",
        "collection",
        prop("datetime").alias("datetime"),
        nm.platform_letter(F.coalesce(prop("platform"), F.lit("")), F.col("id")).alias("platform"),
        nm.tile_code(prop("grid:code"), F.col("id")).alias("tile"),
        prop("processing:version").alias("baseline"),
        prop("eo:cloud_cover").alias("cloud_cover"),
        F.col("id").alias("product_uri"),
    )
    missing = {c: F.lit(None).cast("string") for c in ("sequence", "software", "generation_time", "created")}
    missing |= {"offset_applied": F.lit(None).cast("boolean"), "nodata_pct": F.lit(None).cast("double")}
    return short.withColumns(missing).select(*keep, *ITEM_FIELDS)


def is_cog(asset: Column, host: str) -> Column:
    """A cloud-optimized GeoTIFF on the public host."""
    kind = F.coalesce(asset["type"], F.lit(""))
    return kind.contains(COG_TYPE) & F.coalesce(F.try_parse_url(asset["href"], F.lit("HOST")) == host, F.lit(False))


def unreadable_reason(asset: Column) -> Column:
    """First reason an asset is not a readable HTTPS GeoTIFF, null when it is."""
    href = F.coalesce(asset["href"], F.lit(""))
    return (
        F.when(asset.isNull(), "asset missing")
        .when(~href.startswith("https://"), "not an https href")
        .when(~F.coalesce(asset["type"], F.lit("")).contains("image/tiff"), "not a GeoTIFF")
    )


def classify_assets(features: DataFrame, host: str, keep: Sequence[str]) -> DataFrame:
    """Which assets are GeoTIFF or JPEG 2000, whether the bands are complete, quality classes."""
    cog = F.map_keys(F.map_filter("assets", lambda _k, a: is_cog(a, host)))
    jp2 = F.map_keys(F.map_filter("assets", lambda _k, a: F.coalesce(a["type"], F.lit("")) == "image/jp2"))
    bands = F.array(*[F.lit(b) for b in REFLECTANCE_KEYS])
    base = features.select(*keep, "assets", F.array_sort(cog).alias("cog_assets"), F.array_sort(jp2).alias("jp2_assets"))
    quality = []
    for key in QUALITY_KEYS:
        asset = F.try_element_at("assets", F.lit(key))
        kind = F.when(asset.isNull(), F.lit(None).cast("string")).when(is_cog(asset, host), "cog")
        kind = kind.when(F.coalesce(asset["type"], F.lit("")).contains("jp2"), "jp2").otherwise("other")
        quality.append(kind.alias(f"quality_{key}"))
    return base.select(
        *keep, "cog_assets", "jp2_assets", F.size(F.array_intersect("cog_assets", bands)).alias("bands_cog"),
        (F.size(F.array_intersect("cog_assets", bands)) == len(REFLECTANCE_KEYS)).alias("bands_complete"), *quality,
    )


def asset_summary(features: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Every asset of an item as a row: host, type, resolution, data type, scale, offset."""
    band = F.try_element_at("asset.`raster:bands`", F.lit(1))
    rows = features.select(*keep, F.explode("assets").alias("key", "asset"))
    return rows.select(
        *keep, "key", F.try_parse_url("asset.href", F.lit("HOST")).alias("host"), F.col("asset.type").alias("type"),
        F.try_element_at("asset.`proj:transform`", F.lit(1)).cast("int").alias("resolution"), band["data_type"].alias("data_type"),
        F.coalesce(band["scale"], F.lit(1.0)).alias("scale"), F.coalesce(band["offset"], F.lit(0.0)).alias("offset"), band["nodata"].alias("nodata"),
    )


def resolve_assets(features: DataFrame, keys: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Wanted asset keys as usable or with the reason they are not."""
    wanted = features.select(*keep, "assets", F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
    reason = unreadable_reason(F.try_element_at("assets", F.col("key")))
    return wanted.select(*keep, "key", reason.alias("reason"), reason.isNull().alias("usable"))


def trim_item(features: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Provenance fields of an item with its sorted asset keys."""
    code = F.regexp_extract(prop("proj:code"), r"^EPSG:(\d+)$", 1).try_cast("int")
    return features.select(
        *keep, "id", "collection", prop("datetime").alias("datetime"), prop("platform").alias("platform"), prop("grid:code").alias("grid_code"),
        prop("s2:processing_baseline").alias("baseline"), prop("s2:product_uri").alias("product_uri"), prop("created").alias("created"),
        F.coalesce(prop("proj:epsg"), code).alias("epsg"), _software().alias("software"), prop("s2:sequence").alias("sequence"),
        F.coalesce(prop("storage:requester_pays"), F.lit(False)).alias("requester_pays"), F.array_sort(F.map_keys("assets")).alias("asset_keys"),
    )


def stand_in_item(features: DataFrame, products: DataFrame, on: str, layers: dict[str, str], endpoint: str) -> DataFrame:
    """Items whose assets are replaced by their paired product's own objects."""
    joined = features.join(products, on)
    pairs = []
    for key, layer in layers.items():
        found = F.element_at("layers", layer)
        pairs += [F.lit(key), F.struct(nm.object_url(F.lit(endpoint), found["key"]).alias("href"), found["size"].alias("size"), F.lit(layer).alias("layer"))]
    return joined.select(F.col("product").alias("id"), F.col(on).alias("paired_item"), nm.l1c_name(F.col("product")).alias("l1c_product"), F.create_map(*pairs).alias("assets"))


def pages_once(pages: DataFrame, search: str, digest: str, order: str) -> DataFrame:
    """Saved result pages in order. A page that repeats within a search is an error."""
    counted = pages.groupBy(search, digest).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias(order))
    fail = F.raise_error(F.concat(F.lit("repeated page in "), F.col(search).cast("string"))).cast("bigint")
    return counted.select(search, digest, F.when(F.col("_n") == 1, F.col(order)).otherwise(fail).alias(order))
