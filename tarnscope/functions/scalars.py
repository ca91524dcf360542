"""Dates, hours, bins, flags, shares and verdicts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the measured products and of the decision rules.
NODATA = -32768
FLAG_FACTOR = 10_000
UNIT = 10_000
SCL_NODATA = 0
SCL_WATER = 6
SCL_SHADOW = (3,)
SCL_CLOUD = (8, 9, 10)
MASKED_SHARE = 0.01
DISAGREE_UNITS = 50
AGREE_SHARE = 0.90
MIN_RECORD_PIXELS = 100
WIDEN_MARGIN = 0.05
CLOUD_BINS = ((0, 20), (20, 40), (40, 60), (60, 80), (80, 101))
INTERIOR, SHORELINE, NEAR_LAND = 1, 2, 3
CLASS_NAMES = {1: "interior", 2: "shoreline", 3: "near_land"}


def hours_between(start: Column, end: Column) -> Column:
    """Signed hours between two times, two decimals, null when either is missing."""
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return rounded(micros / F.lit(3.6e9), 2)


def epoch_seconds(text: Column, optional: bool = False) -> Column:
    """Epoch seconds of a zoned ISO time. Missing is minus infinity when optional, and a
    time without an offset is an error."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    seconds = F.unix_micros(F.to_timestamp(text)) / F.lit(1e6)
    value = F.when(zoned, seconds).otherwise(
        F.raise_error(F.concat(F.lit("time without an offset: "), text))
    )
    if optional:
        return F.when(text.isNull(), F.lit(float("-inf"))).otherwise(value)
    return F.when(text.isNull(), F.raise_error(F.lit("missing time"))).otherwise(value)


def month_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")


def month_list(start: Column, end: Column) -> Column:
    """Array of month starts from start to end, both included. Reversed is an error."""
    first, last = F.trunc(start, "MM"), F.trunc(end, "MM")
    months = F.sequence(first, last, F.expr("interval 1 month"))
    return F.when(first <= last, months).otherwise(F.raise_error(F.lit("months are reversed")))


def month_bounds(day: Column) -> tuple[Column, Column]:
    return F.trunc(day, "MM"), F.last_day(day)


def in_window(moment: Column, start: Column, end: Column) -> Column:
    """Date inside an inclusive window, false for a missing time."""
    return F.coalesce(F.to_date(moment).between(start, end), F.lit(False))


def cloud_bin(cover: Column) -> Column:
    """One of five labelled bins of a percent cover. Outside the range is an error."""
    label = F.when(cover.isNull(), F.lit(None).cast("string"))
    for low, high in CLOUD_BINS:
        label = label.when((cover >= low) & (cover < high), F.lit(f"{low}-{min(high, 100)}"))
    return label.otherwise(
        F.raise_error(F.concat(F.lit("cloud cover out of range: "), cover.cast("string")))
    )


def cloud_labels() -> list[str]:
    return [f"{low}-{min(high, 100)}" for low, high in CLOUD_BINS]


def decode_flags(flags: Column) -> dict[str, Column]:
    """Flag integer of exact multiples of the factor, and the two kinds that do not decode."""
    missing = flags == NODATA
    not_multiple = ~missing & (F.pmod(flags, F.lit(FLAG_FACTOR)) != 0)
    decoded = F.when(missing | not_multiple, F.lit(0)).otherwise(F.floor(flags / FLAG_FACTOR))
    return {
        "decoded": decoded.cast("bigint"),
        "flags_missing": missing,
        "not_multiple": not_multiple,
    }


def flag_exponents(settings: Column) -> Column:
    """Array of (bit, flag) from a settings map, sorted by bit. Non-integers are dropped."""
    wanted = F.map_filter(
        settings,
        lambda k, v: k.startswith("flag_exponent_") & v.try_cast("int").isNotNull(),
    )
    pairs = F.transform(
        F.map_entries(wanted),
        lambda e: F.struct(
            e["value"].try_cast("int").alias("bit"),
            F.regexp_replace(e["key"], "^flag_exponent_", "").alias("flag"),
        ),
    )
    return F.array_sort(pairs)


def rounded(value: Column, digits: int) -> Column:
    """Round half to even on the binary value. The built-in round works on the shortest decimal
    text of a double, which moves values such as 18.205 the other way."""
    scale = float(10**digits)
    return F.rint(value * scale) / scale


def rounded_away(value: Column, digits: int) -> Column:
    """Round half away from zero on the scaled binary value, not on the decimal text as the built-in round."""
    scale = F.lit(float(10**digits))
    return F.signum(value) * F.floor(F.abs(value * scale) + 0.5) / scale


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    """Rounded ratio, null for a missing part or an empty whole."""
    return rounded(F.try_divide(part, F.nullif(whole, F.lit(0))), digits)


def ndwi_agrees(green: Column, nir: Column, ndwi: Column) -> tuple[Column, Column]:
    """Comparable, and whether a stored index lies in the rounding interval of its bands."""
    g, n = green.cast("double"), nir.cast("double")
    comparable = (g + n - 1.0) > 0
    corners = [
        F.try_divide((g + dg) - (n + dn), (g + dg) + (n + dn))
        for dg in (-0.5, 0.5)
        for dn in (-0.5, 0.5)
    ]
    low = F.least(*corners) * UNIT - 0.5
    high = F.greatest(*corners) * UNIT + 0.5
    return comparable, comparable & ndwi.between(low, high)


def overlap_verdict(n: Column, disagree: Column) -> Column:
    return (
        F.when(n < MIN_RECORD_PIXELS, "too_few")
        .when(1 - disagree / n >= AGREE_SHARE, "agree")
        .otherwise("differs")
    )


def widening(first: Column, second: Column) -> Column:
    """Does the first option's disagreement exceed the second's by more than the margin."""
    return (
        F.when(first.isNull() | second.isNull(), F.lit(None).cast("string"))
        .when(first - second > WIDEN_MARGIN, "widens")
        .when(second - first > WIDEN_MARGIN, "narrows")
        .otherwise("similar")
    )


def relative_offset(n: Column, mean_difference: Column, level: Column) -> Column:
    """Mean difference over mean level, null for small or dark cells."""
    return F.when(
        (n >= MIN_RECORD_PIXELS) & (level > 50), rounded(F.try_divide(mean_difference, level), 4)
    )


def area_band(area_m2: Column, small: float = 100_000, large: float = 1_000_000) -> Column:
    return F.when(area_m2 < small, "small").when(area_m2 < large, "medium").otherwise("large")


def size_class(width: Column, classes: list[float]) -> Column:
    """Class of a width between geometric midpoints, the last class open."""
    label = None
    for low, high in zip(classes, classes[1:], strict=False):
        bound = F.sqrt(F.lit(float(low)) * F.lit(float(high)))
        test = width < bound
        label = F.when(test, F.lit(low)) if label is None else label.when(test, F.lit(low))
    return label.otherwise(F.lit(classes[-1]))


def size_label(tier: Column, size: Column) -> Column:
    """``anchor`` for the large tier, else the size class in metres."""
    return F.when(tier == "large", "anchor").otherwise(F.concat(size.cast("string"), F.lit(" m")))


def stable_key(value: Column, seed: str) -> Column:
    return F.sha2(F.concat(F.lit(seed), F.lit(":"), value), 256)


def feature_date(millis: Column) -> Column:
    return F.to_date(F.timestamp_millis(millis))


def rotated(items: Column, shift: Column) -> Column:
    """Rotate an array left by a shift of any size."""
    n = F.size(items)
    k = F.pmod(shift, n)
    return F.concat(F.slice(items, k + 1, n - k), F.slice(items, F.lit(1), k))


def utm_epsg(lon: Column, lat: Column) -> Column:
    """UTM zone code of a point."""
    zone = F.least(F.lit(60), F.greatest(F.lit(1), (F.floor((lon + 180) / 6) + 1).cast("int")))
    return F.when(lat >= 0, zone + 32600).otherwise(zone + 32700)


def reflectance(dn: Column, scale: Column, offset: Column, nodata: int = 0) -> Column:
    """Stored integer to reflectance, missing kept missing."""
    return F.nullif(dn, F.lit(nodata)) * scale + offset


def usable_class(scl: Column, nodata: Column) -> Column:
    """Scene class 4 to 7 and every band holding data."""
    return scl.isin(4, 5, 6, 7) & ~nodata


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b) clipped to -1..1, null where the sum is zero."""
    # least and greatest leave nulls out, so the null has to be kept apart.
    return F.when(a + b != 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(a - b, a + b))))
