"""Product, object, tile and datastrip names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Name patterns and layer lists of the archived products.
KEY_PATTERN = (
    r"^(version_\d+)/T(\d{2}[C-X][A-Z]{2})/(S2[A-D])_MSIAQR_(\d{8}T\d{6})_N(\d{4})_"
    r"R(\d{3})_T(\d{2}[C-X][A-Z]{2})_(\d{8}T\d{6})_([A-Za-z0-9]+(?:_[A-Za-z0-9]+)*)\.(tif|txt)$"
)
PRODUCT_PATTERN = (
    r"^(S2[A-D])_MSI(L1C|L2A|AQR)_(\d{8}T\d{6})_N(\d{4})_R(\d{3})_"
    r"T(\d{2}[C-X][A-Z]{2})_(\d{8}T\d{6})(?:\.SAFE)?$"
)
DATASTRIP_PATTERN = r"_S(\d{8}T\d{6})_N\d{2}\.\d{2}$"
TILE_PATTERN = r"^(\d{1,2})([C-X])([A-Z]{2})$"
GRID_CODE_PATTERN = r"^(?:MGRS-)?(\d{1,2})([C-X])([A-Z]{2})$"
SCENE_SPEC_PATTERN = r"^(\d{2}[C-X][A-Z]{2}):(\d{4})-(\d{2})(?:-(\d{2}))?$"
LAYERS = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12", "NDWI", "l2_flags", "settings")
SEPARATOR = "\x01"
BANDS = ("B01", "B02", "B03", "B04", "B05", "B06", "B07", "B08", "B8A", "B11", "B12")


def groups(text: Column, pattern: str, count: int) -> Column:
    """All groups of a whole-text pattern as an array from one pass, null on no match.

    The replacement joins the groups with a separator no name contains. Select the array as a
    column of its own before taking fields from it, so that it is evaluated once per row.
    """
    joined = SEPARATOR.join(f"${i}" for i in range(1, count + 1)) + SEPARATOR
    parts = F.split(F.regexp_replace(text, pattern, joined), SEPARATOR)
    return F.when(text.rlike(pattern), parts)


def key_parts(key: Column) -> Column:
    return groups(key, KEY_PATTERN, 10)


def product_parts(name: Column) -> Column:
    return groups(name, PRODUCT_PATTERN, 7)


def first_group(text: Column, pattern: str, index: int = 1) -> Column:
    """A group of the first match anywhere in the text, null when there is none."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def compact_time(text: Column) -> Column:
    """``20251015T162149`` as ``2025-10-15T16:21:49Z``, null when it is not a time."""
    parsed = F.try_to_timestamp(text, F.lit("yyyyMMdd'T'HHmmss"))
    return F.date_format(parsed, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def baseline_label(digits: Column) -> Column:
    return F.concat(F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 2))


def parse_key(parts: Column) -> dict[str, Column]:
    """Twelve fields of an object name from ``key_parts``. All null for another form."""
    version, prefix_tile, platform, sensing, baseline, orbit, tile, generation, layer, ext = (
        parts[i] for i in range(10)
    )
    product = F.concat(
        platform, F.lit("_MSIAQR_"), sensing, F.lit("_N"), baseline, F.lit("_R"), orbit,
        F.lit("_T"), tile, F.lit("_"), generation,
    )
    return {
        "version": version,
        "prefix_tile": prefix_tile,
        "tile": tile,
        "platform": platform,
        "sensing": sensing,
        "sensing_time": compact_time(sensing),
        "baseline": baseline_label(baseline),
        "orbit": orbit.cast("bigint"),
        "generation_time": compact_time(generation),
        "layer": layer,
        "extension": ext,
        "product": product,
    }


def parse_product(parts: Column) -> dict[str, Column]:
    """Fields of a Level-1C, Level-2A or reflectance product name from ``product_parts``."""
    return {
        "platform": parts[0],
        "level": parts[1],
        "sensing": parts[2],
        "baseline": baseline_label(parts[3]),
        "orbit": parts[4].cast("bigint"),
        "tile": parts[5],
        "generation_time": compact_time(parts[6]),
    }


def product_fields(parts: Column) -> dict[str, Column]:
    """``parse_product`` with the sensing start as a time."""
    return {**parse_product(parts), "sensing_time": compact_time(parts[2])}


def pass_key(parts: Column) -> Column:
    """Tile, platform and sensing start of a product name, null when it does not parse."""
    return F.concat(parts[5], F.lit("/"), parts[0], F.lit("/"), parts[2])


def acquisition_key(platform: Column, sensing: Column) -> Column:
    """Sensing date and lower-case platform letter from compact sensing text."""
    day = F.concat_ws(
        "-", F.substring(sensing, 1, 4), F.substring(sensing, 5, 2), F.substring(sensing, 7, 2)
    )
    return F.concat(day, F.lit("/"), F.lower(F.right(platform, F.lit(1))))


def item_sensing_key(datetime_text: Column, letter: Column) -> Column:
    """The same key from a catalog row's ISO time and platform letter."""
    return F.concat(F.substring(datetime_text, 1, 10), F.lit("/"), letter)


def platform_letter(platform: Column, item_id: Column) -> Column:
    """a, b or c from the platform field, else from the item id, else ``?``."""

    def found(text: Column) -> Column:
        return F.coalesce(
            first_group(text, r"(?i)sentinel-?2([abc])"), first_group(text, r"^S2([ABC])")
        )

    return F.lower(F.coalesce(found(platform), found(item_id), F.lit("?")))


def tile_code(grid_code: Column, item_id: Column) -> Column:
    """Tile from the grid code without its prefix, else from the item id."""
    return F.coalesce(
        F.when(grid_code.startswith("MGRS-"), F.substr(grid_code, F.lit(6))),
        first_group(item_id, r"_T?(\d{1,2}[C-X][A-Z]{2})_"),
    )


def normalize_grid_code(code: Column) -> Column:
    """Tile code with a two-digit zone, null when malformed."""
    return F.when(
        code.rlike(GRID_CODE_PATTERN),
        F.concat(
            F.lpad(F.regexp_extract(code, GRID_CODE_PATTERN, 1), 2, "0"),
            F.regexp_extract(code, GRID_CODE_PATTERN, 2),
            F.regexp_extract(code, GRID_CODE_PATTERN, 3),
        ),
    )


def normalize_tile(code: Column) -> Column:
    """Strip the grid prefix and left-pad a four-character code."""
    bare = F.regexp_replace(code, "^MGRS-", "")
    return F.when(F.length(code) > 0, F.when(F.length(bare) == 4, F.lpad(bare, 5, "0")).otherwise(bare))


def datastrip_sensing(datastrip_id: Column) -> Column:
    return first_group(datastrip_id, DATASTRIP_PATTERN)


def platform_code(platform: Column) -> Column:
    """``sentinel-2b`` as ``S2B``, null for another platform."""
    letter = first_group(F.lower(platform), r"^sentinel-2([a-d])$")
    return F.concat(F.lit("S2"), F.upper(letter))


def l1c_name(product: Column) -> Column:
    """Level-1C input name of a reflectance product. Another name is an error."""
    return F.when(
        product.contains("_MSIAQR_"), F.regexp_replace(product, "_MSIAQR_", "_MSIL1C_")
    ).otherwise(F.raise_error(F.concat(F.lit("not a reflectance product name: "), product)))


def strip_safe(name: Column) -> Column:
    return F.regexp_replace(name, r"\.SAFE$", "")


def tile_prefix(tile: Column) -> Column:
    """``05VMG`` as ``5/V/MG``. A malformed tile is an error."""
    parts = [F.regexp_extract(tile, TILE_PATTERN, i) for i in (1, 2, 3)]
    return F.when(
        tile.rlike(TILE_PATTERN),
        F.concat_ws("/", parts[0].cast("int").cast("string"), parts[1], parts[2]),
    ).otherwise(F.raise_error(F.concat(F.lit("not a tile: "), tile)))


def month_prefix(base: Column, tile: Column, month_start: Column) -> Column:
    """Object prefix of one tile and month. Months are not zero-padded."""
    return F.concat(
        F.concat_ws(
            "/", base, tile_prefix(tile), F.year(month_start).cast("string"),
            F.month(month_start).cast("string"),
        ),
        F.lit("/"),
    )


def object_url(endpoint: Column, key: Column) -> Column:
    """URL of an object, each path segment percent-encoded and slashes kept."""
    encoded = F.regexp_replace(F.url_encode(key), r"\+", "%20")
    return F.concat(endpoint, F.lit("/"), F.regexp_replace(encoded, "%2F", "/"))


def parse_scene_spec(spec: Column) -> dict[str, Column]:
    """Tile, month and optional day of ``TILE:YYYY-MM[-DD]``. Another form is an error."""
    checked = F.when(spec.rlike(SCENE_SPEC_PATTERN), spec).otherwise(
        F.raise_error(F.concat(F.lit("not a scene spec: "), spec))
    )
    tile = F.regexp_extract(checked, SCENE_SPEC_PATTERN, 1)
    month = F.concat_ws(
        "-",
        F.regexp_extract(checked, SCENE_SPEC_PATTERN, 2),
        F.regexp_extract(checked, SCENE_SPEC_PATTERN, 3),
    )
    return {"tile": tile, "month": month, "day": first_group(checked, SCENE_SPEC_PATTERN, 4)}


def parse_month(text: Column) -> Column:
    """A ``YYYY-MM`` argument, or an error."""
    return F.when(text.rlike(r"^\d{4}-(0[1-9]|1[0-2])$"), text).otherwise(
        F.raise_error(F.concat(F.lit("not a month: "), text))
    )


def observation_identity(datatake: Column, tile: Column, datastrip: Column, item_id: Column) -> Column:
    """Datatake, tile and datastrip. The item id stands in for unknown parts, so that items
    of unknown datastrips never collapse into one."""
    return F.concat_ws(
        "|", F.coalesce(datatake, item_id), F.coalesce(tile, F.lit("")), F.coalesce(datastrip, item_id)
    )


def water_body_id(source_id: Column) -> Column:
    """Stable body id: braces trimmed, lower case."""
    return F.concat(F.lit("nhd-"), F.lower(F.regexp_replace(source_id, r"^[{}]+|[{}]+$", "")))


def scene_id(region: Column, item_id: Column) -> Column:
    return F.concat_ws("-", region, item_id)
