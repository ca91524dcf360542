"""Request accounting from saved debug logs, and sleep intervals against attempts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Message forms of the logging library and of the power log.
DOWNLOAD = "VSICURL: Downloading "
FILE_SIZE = "VSICURL: GetFileSize("
OPEN_LINE = r"GDALOpen\(([^,]+),"
POWER_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d [+-]\d{4})\s+(\w+)"


def requests(lines: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """One row per log line with its request kind, href, range text and bytes asked for.

    The message has one fixed form, so plain string functions take it apart; a pattern per
    line costs several times as much.
    """
    line, low = F.col(text), F.lower(text)
    rest = F.when(line.contains(DOWNLOAD), F.substring_index(line, DOWNLOAD, -1))
    split = lines.select(
        *keep,
        F.when(rest.contains(" ("), F.substring_index(rest, " (", 1)).alias("_range"),
        F.substring_index(F.substring_index(rest, " (", -1), ")", 1).alias("_href"),
        line.contains(FILE_SIZE).alias("_size"),
        low.contains("retrying").alias("retry"),
        (low.contains("timeout") | low.contains("timed out") | low.contains("time out") | low.contains("timedout")).alias("timeout"),
    )
    download = F.coalesce(~F.col("_range").contains(" ") & (F.col("_range") != ""), F.lit(False))

    def span(part: Column) -> Column:
        start = F.substring_index(part, "-", 1).try_cast("bigint")
        end = F.substring_index(part, "-", -1).try_cast("bigint")
        return F.when(part.contains("-"), F.coalesce(end - start + 1, F.lit(0))).otherwise(F.lit(0))

    listed = F.aggregate(F.transform(F.split("_range", ","), span), F.lit(0).cast("bigint"), lambda a, b: a + b)
    total = F.when(F.col("_range").contains(","), listed).otherwise(span(F.col("_range")))
    return split.select(
        *keep, download.alias("download"), (~download & F.col("_size")).alias("size_probe"), F.when(download, F.col("_href")).alias("href"),
        F.when(download, F.col("_range")).alias("range"), F.coalesce(F.when(download, total), F.lit(0)).alias("bytes"), "retry", "timeout",
    )


def io_summary(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requests, bytes, probes, warnings and exactly repeated ranges per key.

    Lines are combined per (href, range) first; a repeat is an occurrence beyond the first.
    """
    per_range = parsed.groupBy(*keys, "href", "range").agg(
        F.count_if("download").alias("_n"), F.sum("bytes").alias("_b"), F.count_if("size_probe").alias("_s"),
        F.count_if("retry").alias("_r"), F.count_if("timeout").alias("_t"),
    )
    repeats = F.when(F.col("href").isNotNull(), F.greatest(F.col("_n") - 1, F.lit(0))).otherwise(0)
    return per_range.groupBy(*keys).agg(
        F.sum("_n").alias("range_requests"), F.sum("_b").alias("bytes_requested"), F.sum("_s").alias("size_requests"),
        F.sum("_r").alias("retry_messages"), F.sum("_t").alias("timeout_messages"), F.sum(repeats).alias("repeated_exact_ranges"),
        (F.sum("_n") + F.sum("_s")).alias("requests"),
    )


def repeated_ranges(parsed: DataFrame) -> DataFrame:
    counted = parsed.where("download").groupBy("href", "range").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > 1)


def observed_opens(lines: DataFrame, text: str, keys: Sequence[str]) -> DataFrame:
    """Dataset opens per key. In-memory datasets are not counted."""
    name = F.when(F.col(text).rlike(OPEN_LINE), F.regexp_extract(F.col(text), OPEN_LINE, 1))
    counted = F.count_if(F.coalesce(~name.startswith("MEM:"), F.lit(False)))
    return lines.groupBy(*keys).agg(counted.alias("opens"))


def split_by_bucket(parsed: DataFrame, mark: str) -> DataFrame:
    """Requests and bytes by whether the href holds a mark."""
    side = F.when(F.col("href").contains(mark), mark).otherwise("other").alias("bucket")
    return parsed.where("download").groupBy(side).agg(F.count(F.lit(1)).alias("requests"), F.sum("bytes").alias("bytes"))


def with_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], chunk: Column, columns: Sequence[str]) -> DataFrame:
    """The previous row's columns per key, for keys of any size.

    Rows are cut into time chunks. Inside a chunk the previous row is a window lag; the first
    row of a chunk takes the last row of the nearest earlier chunk, found among one summary row
    per chunk. No task sees more of a key than one chunk.
    """
    marked = df.withColumn("_chunk", chunk)
    inner = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    row = F.struct(*columns)
    lagged = marked.withColumns({"_prev": F.lag(row).over(inner), "_first": F.row_number().over(inner) == 1})
    last = marked.groupBy(*keys, "_chunk").agg(F.max_by(row, F.struct(*order)).alias("_last"))
    chain = Window.partitionBy(*keys).orderBy("_chunk")
    carried = last.select(*keys, "_chunk", F.lag("_last").over(chain).alias("_carry"))
    joined = lagged.join(carried, [*keys, "_chunk"])
    previous = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev"))
    out = joined.withColumn("_p", previous)
    return out.withColumns({f"previous_{c}": F.col(f"_p.{c}") for c in columns}).drop("_chunk", "_prev", "_first", "_carry", "_p")


def power_events(lines: DataFrame, text: str) -> DataFrame:
    """Sleep and wake lines of a power log with their times. Other lines are dropped."""
    line = F.col(text)
    kind = F.regexp_extract(line, POWER_LINE, 2)
    sleeping = (kind == "Sleep") & line.contains("Entering Sleep")
    waking = kind.isin("Wake", "DarkWake")
    moment = F.to_timestamp(F.regexp_extract(line, POWER_LINE, 1), "yyyy-MM-dd HH:mm:ss Z")
    kept = lines.where(line.rlike(POWER_LINE) & (sleeping | waking))
    return kept.select(*[c for c in lines.columns if c != text], moment.alias("at"), F.when(sleeping, "sleep").otherwise("wake").alias("state"))


def sleep_intervals(events: DataFrame, keys: Sequence[str], at: str, tie: str, chunk: Column) -> DataFrame:
    """Pair sleep with the next wake. Repeats of a state are dropped first, so that each sleep
    that starts an interval is followed by exactly one wake."""
    order = [at, tie]
    changes = with_previous(events, keys, order, chunk, ["state"])
    changes = changes.where(~F.col("state").eqNullSafe(F.col("previous_state"))).drop("previous_state")
    paired = with_previous(changes, keys, order, chunk, ["state", at])
    ended = paired.where((F.col("state") == "wake") & (F.col("previous_state") == "sleep"))
    return ended.select(*keys, F.col(f"previous_{at}").alias("start"), F.col(at).alias("end"))


def interval_overlap(attempts: DataFrame, intervals: DataFrame, keys: Sequence[str], slot_seconds: int) -> DataFrame:
    """How many intervals overlap each attempt and for how long.

    Both sides are cut into time slots and joined slot by slot. A piece counts in the slot of
    its start only, so no pair is counted twice and no slot meets all of a key.
    """

    def slots(df: DataFrame) -> DataFrame:
        first, last = (F.floor(F.unix_seconds(F.col(c)) / slot_seconds) for c in ("start", "end"))
        return df.withColumn("_slot", F.explode(F.sequence(first, last)))

    a = slots(attempts.select(*keys, "attempt", F.col("start"), F.col("end"))).withColumnsRenamed({"start": "a0", "end": "a1"})
    b = slots(intervals.select(*keys, "start", "end")).withColumnsRenamed({"start": "b0", "end": "b1"})
    pieces = a.join(b, [*keys, "_slot"]).where((F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1")))
    begin = F.greatest("a0", "b0")
    once = pieces.where(F.floor(F.unix_seconds(begin) / slot_seconds) == F.col("_slot"))
    seconds = (F.unix_micros(F.least("a1", "b1")) - F.unix_micros(begin)) / F.lit(1e6)
    counted = once.groupBy(*keys, "attempt").agg(F.count(F.lit(1)).alias("overlaps"), F.sum(seconds).alias("seconds"))
    return attempts.select(*keys, "attempt").join(counted, [*keys, "attempt"], "left").fillna({"overlaps": 0, "seconds": 0.0})
