"""Masked pixel values from raster block tables.

Tables: ``blocks(item, band, br, bc, height, width, nodata, values)`` with row-major values and
``selections(lake, br, bc, n, positions, classes)`` with in-block positions. Keys are the block
keys, so a lake or item of any size is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnscope.functions.digests import set_digest
from tarnscope.functions.scalars import INTERIOR, NEAR_LAND, SHORELINE

STRATEGIES = ("per_body", "shared_blocks", "full_scan")


def pack_selection(pixels: DataFrame, keys: Sequence[str], position: str, pixel_class: str) -> DataFrame:
    """Pixels of one block as sorted position and class arrays, bounded by the block size."""
    packed = pixels.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), F.col(pixel_class).alias("c")))).alias("_s")
    )
    return packed.select(
        *keys, F.size("_s").alias("n"), F.col("_s.p").alias("positions"), F.col("_s.c").alias("classes")
    )


def unpack_selection(selections: DataFrame, keep: Sequence[str], values: str | None = None) -> DataFrame:
    """One row per selected pixel, with its value where a block's values stand in the row. A declared
    length that does not match is an error."""
    agrees = (F.size("positions") == F.col("n")) & (F.size("classes") == F.col("n"))
    checked = F.when(agrees, F.arrays_zip("positions", "classes")).otherwise(
        F.raise_error(F.lit("selection length differs from its declared count"))
    )

    def pixel(s: Column) -> Column:
        fields = [s["positions"].alias("pos"), s["classes"].alias("pixel_class")]
        return F.struct(*fields, *([] if values is None else [F.element_at(values, s["positions"] + 1).alias("value")]))

    return selections.select(*keep, F.inline(F.transform(checked, pixel)))


def extract(
    selections: DataFrame, blocks: DataFrame, block_keys: Sequence[str], item_keys: Sequence[str], strategy: str
) -> DataFrame:
    """Values under every selection: one row per lake, item, band and pixel.

    ``per_body`` joins packed selections to packed blocks, so a block travels once per
    selection that needs it. ``shared_blocks`` first gathers the selections of a block, so that it
    travels once for all of them. ``full_scan`` reads every block, also those without a selection.
    All open a block inside its row and give the same rows; no pixel is shuffled.
    """
    selection_keep = ["lake", *block_keys]
    kept = [*selection_keep, *item_keys, "width", "nodata"]
    if strategy == "per_body":
        joined = selections.join(blocks, list(block_keys))
    elif strategy in ("shared_blocks", "full_scan"):
        mine = F.struct("lake", "n", "positions", "classes")
        gathered = selections.groupBy(*block_keys).agg(F.collect_list(mine).alias("_mine"))
        joined = blocks.join(gathered, list(block_keys), "inner" if strategy == "shared_blocks" else "left")
        joined = joined.select(*block_keys, *item_keys, "width", "nodata", "values", F.inline("_mine"))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    return unpack_selection(joined, kept, "values").select(*kept, "pos", "pixel_class", "value")


def with_tile_position(pixels: DataFrame, height: Column, row_block: str = "br", col_block: str = "bc") -> DataFrame:
    """Row and column in the tile from block index and in-block position."""
    width = F.col("width")
    return pixels.withColumns(
        {
            "row": (F.col(row_block) * height + F.floor(F.col("pos") / width)).cast("bigint"),
            "col": (F.col(col_block) * width + F.pmod(F.col("pos"), width)).cast("bigint"),
        }
    )


def extracted_record(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, range and digests of the values extracted per key."""
    cls, value, nodata = F.col("pixel_class"), F.col("value"), F.col("nodata")
    wet = cls.isin(INTERIOR, SHORELINE)
    place = [F.col("row"), F.col("col")]
    return pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pixels_extracted"),
        F.count_if(value == nodata).alias("nodata_extracted"),
        F.min(F.when(value != nodata, value)).cast("bigint").alias("low"),
        F.max(F.when(value != nodata, value)).cast("bigint").alias("high"),
        F.count_if(cls == INTERIOR).alias("interior"),
        F.count_if(cls == SHORELINE).alias("shoreline"),
        F.count_if(cls == NEAR_LAND).alias("near_land"),
        set_digest(*place, value).alias("digest_all"),
        set_digest(*place, value, where=wet).alias("digest_wet"),
        set_digest(*place, cls).alias("digest_pixels"),
    )


def array_stats(blocks: DataFrame, keys: Sequence[str], block_keys: Sequence[str]) -> DataFrame:
    """Pixels, bytes, range, nodata count and digest of whole files, block by block.

    Every block is reduced inside its row by array functions, so no pixel is exploded.
    """
    data = F.filter("values", lambda v: v != F.col("nodata"))
    per_block = blocks.select(
        *keys,
        F.size("values").alias("_n"),
        (F.size("values") - F.size(data)).alias("_empty"),
        F.array_min(data).alias("_low"),
        F.array_max(data).alias("_high"),
        *block_keys,
        F.array_join("values", ",").alias("_text"),
    )
    return per_block.groupBy(*keys).agg(
        F.sum("_n").cast("bigint").alias("pixels"),
        (F.sum("_n") * 2).cast("bigint").alias("bytes"),
        F.min("_low").cast("bigint").alias("low"),
        F.max("_high").cast("bigint").alias("high"),
        F.sum("_empty").cast("bigint").alias("nodata"),
        F.count(F.lit(1)).alias("blocks"),
        set_digest(*[F.col(k) for k in block_keys], F.col("_text")).alias("digest"),
    )


def contributions(expected: DataFrame, actual: DataFrame, keys: Sequence[str], pixels: str, error: str) -> DataFrame:
    """Match extracted to expected records: measured, empty, missing, failed or unexpected.

    A repeated key on either side is reported as ``duplicate``. Both sides are counted per key
    before they are joined, so a repeat cannot multiply rows.
    """
    left = expected.groupBy(*keys).agg(F.count(F.lit(1)).alias("_want"))
    right = actual.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_have"), F.max(pixels).alias(pixels), F.max(error).alias(error)
    )
    status = (
        F.when(F.col("_want").isNull(), "unexpected")
        .when((F.col("_want") > 1) | (F.col("_have") > 1), "duplicate")
        .when(F.col("_have").isNull(), "missing")
        .when(F.col(error).isNotNull(), "failed")
        .when(F.col(pixels) == 0, "empty")
        .otherwise("measured")
    )
    return left.join(right, list(keys), "full_outer").select(
        *keys, status.alias("status"), F.coalesce(F.col(pixels), F.lit(0)).alias(pixels)
    )


def require_clean(records: DataFrame) -> DataFrame:
    """Raise on unexpected or duplicate contributions when the result is used."""
    ok = ~F.col("status").isin("unexpected", "duplicate")
    checked = F.when(ok, F.col("status")).otherwise(
        F.raise_error(F.concat(F.col("status"), F.lit(" contribution")))
    )
    return records.withColumn("status", checked)


def row_differences(first: DataFrame, second: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, with their surplus, that one side holds more often than the other.

    Equal to a two-way EXCEPT ALL, in one aggregation of a union.
    """
    signed = first.select(*columns, F.lit(1).alias("_s")).unionByName(second.select(*columns, F.lit(-1).alias("_s")))
    counted = signed.groupBy(*columns).agg(F.sum("_s").alias("_s")).where("_s <> 0")
    return counted.select(
        *columns,
        F.when(F.col("_s") > 0, "first").otherwise("second").alias("side"),
        F.abs("_s").alias("surplus"),
    )


def table_signature(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Row count and order-free digest per key."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), set_digest(*[F.col(c) for c in columns]).alias("signature")
    )


# ------------------------------------------------------------------ windows and blocks


def block_window(row: Column, col: Column, shape: tuple[int, int], block: tuple[int, int]) -> dict[str, Column]:
    """Pixel window of a block, clipped to the image."""
    top, left = row * block[0], col * block[1]
    return {
        "row_off": top,
        "col_off": left,
        "height": F.least(F.lit(block[0]), shape[0] - top),
        "width": F.least(F.lit(block[1]), shape[1] - left),
    }


def blocks_in_window(row: Column, col: Column, height: Column, width: Column, block: tuple[int, int]) -> Column:
    """How many internal blocks a window intersects, zero for an empty window."""
    rows = F.floor((row + height - 1) / block[0]) - F.floor(row / block[0]) + 1
    cols = F.floor((col + width - 1) / block[1]) - F.floor(col / block[1]) + 1
    return F.when((height <= 0) | (width <= 0), F.lit(0)).otherwise(rows * cols).cast("bigint")


def chunks_in_window(row: Column, col: Column, height: Column, width: Column, chunk: int, shared: bool) -> Column:
    """Chunks a window touches, counted from the tile origin or from its own corner."""
    if shared:
        return blocks_in_window(row, col, height, width, (chunk, chunk))
    own = F.ceil(height / chunk) * F.ceil(width / chunk)
    return F.when((height <= 0) | (width <= 0), F.lit(0)).otherwise(own).cast("bigint")


def block_cells(df: DataFrame, row: str, col: str, height: str, width: str, block: tuple[int, int]) -> DataFrame:
    """One row per internal block a window intersects."""

    def span(offset: str, length: str, size: int) -> Column:
        first = F.floor(F.col(offset) / size)
        return F.sequence(first, F.floor((F.col(offset) + F.col(length) - 1) / size))

    some = df.where((F.col(height) > 0) & (F.col(width) > 0))
    rows = some.withColumn("br", F.explode(span(row, height, block[0])))
    return rows.withColumn("bc", F.explode(span(col, width, block[1])))


def block_accounting(uses: DataFrame, keys: Sequence[str], block_keys: Sequence[str], full: DataFrame) -> DataFrame:
    """Logical, unique and full block counts and decoded bytes per key.

    A logical block counts once per lake that needs it, a unique block once.
    """
    per_block = uses.groupBy(*keys, *block_keys).agg(F.count(F.lit(1)).alias("_n"), F.max("bytes").alias("_b"))
    counted = per_block.groupBy(*keys).agg(
        F.sum("_n").alias("logical_blocks"),
        F.count(F.lit(1)).alias("unique_blocks"),
        F.sum(F.col("_n") * F.col("_b")).alias("logical_bytes"),
        F.sum("_b").alias("unique_bytes"),
    )
    whole = full.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("full_blocks"), F.sum("bytes").alias("full_bytes")
    )
    ratio = F.round(F.try_divide(F.col("logical_bytes"), F.col("unique_bytes")), 6)
    return counted.join(whole, list(keys)).withColumn("logical_to_unique", ratio)
