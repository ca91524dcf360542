"""Log, interval, status and reuse queries over lineitems and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.operators import checks as ck
from tarnscope.operators import logs as lg
from tarnscope.plans.registry import load, query


def lines(spark, sf):
    """One debug-log line per lineitem: downloads with one or two ranges, probes, opens."""
    p, o, n = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")
    start, length = p * 100, F.col("l_quantity").cast("bigint") * 10
    one = F.concat(start.cast("string"), F.lit("-"), (start + length - 1).cast("string"))
    two = F.concat(one, F.lit(","), (start + 90000).cast("string"), F.lit("-"), (start + 90999).cast("string"))
    href = F.concat(F.lit("https://bucket"), (p % 3).cast("string"), F.lit(".example/"), (o % 40).cast("string"), F.lit(".tif"))
    text = (
        F.when(n <= 3, F.concat(F.lit("VSICURL: Downloading "), one, F.lit(" ("), href, F.lit(")...")))
        .when(n == 4, F.concat(F.lit("VSICURL: Downloading "), two, F.lit(" ("), href, F.lit(")...")))
        .when(n == 5, F.concat(F.lit("VSICURL: GetFileSize("), href, F.lit(")=123")))
        .when(n == 6, F.concat(F.lit("GDAL: GDALOpen("), F.when(p % 2 == 0, "MEM:::x").otherwise(href), F.lit(", this=0x1) succeeds")))
        .otherwise(F.when(p % 2 == 0, "Request timed out, Retrying").otherwise("done"))
    )
    return load(spark, sf, "lineitem").select((F.col("l_suppkey") % 25).alias("run"), text.alias("value"))


LINES = """WITH l AS (SELECT l_suppkey % 25 AS run, l_partkey AS p, l_orderkey AS o, l_linenumber AS n, l_partkey * 100 AS a, CAST(l_quantity AS BIGINT) * 10 AS len FROM lineitem),
d AS (SELECT *, n <= 4 AS download, CASE WHEN n <= 4 THEN 'https://bucket' || (p % 3) || '.example/' || (o % 40) || '.tif' END AS href,
  CASE WHEN n <= 3 THEN a || '-' || (a + len - 1) WHEN n = 4 THEN a || '-' || (a + len - 1) || ',' || (a + 90000) || '-' || (a + 90999) END AS range,
  CASE WHEN n <= 3 THEN len WHEN n = 4 THEN len + 1000 ELSE 0 END AS bytes FROM l)"""


def parsed(spark, sf):
    return lg.requests(lines(spark, sf), "value", ["run"])


@query("log_io_summary", "V13 V15", LINES + """, r AS (SELECT run, href, range, count(*) - 1 AS extra FROM d WHERE download GROUP BY ALL), x AS (SELECT run, sum(extra) AS e FROM r GROUP BY run)
SELECT run, count(*) FILTER (download) AS range_requests, CAST(sum(bytes) AS BIGINT) AS bytes_requested, count(*) FILTER (n = 5) AS size_requests,
  count(*) FILTER (n = 7 AND p % 2 = 0) AS retry_messages, count(*) FILTER (n = 7 AND p % 2 = 0) AS timeout_messages, CAST(max(e) AS BIGINT) AS repeated_exact_ranges,
  count(*) FILTER (n <= 5) AS requests FROM d JOIN x USING (run) GROUP BY run""")
def _(spark, sf):
    return lg.io_summary(parsed(spark, sf), ["run"])


@query("log_repeated_ranges", "V14 V15", LINES + " SELECT href, range, count(*) AS n FROM d WHERE download GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    return lg.repeated_ranges(parsed(spark, sf))


@query("log_opens", "V16", LINES + " SELECT run, count(*) FILTER (n = 6 AND p % 2 = 1) AS opens FROM d GROUP BY run")
def _(spark, sf):
    return lg.observed_opens(lines(spark, sf), "value", ["run"])


@query("log_split_by_bucket", "V17", LINES + """ SELECT CASE WHEN p % 3 = 1 THEN 'bucket1' ELSE 'other' END AS bucket, count(*) AS requests, CAST(sum(bytes) AS BIGINT) AS bytes
FROM d WHERE download GROUP BY ALL""")
def _(spark, sf):
    return lg.split_by_bucket(parsed(spark, sf), "bucket1")


# ------------------------------------------------------------------ sleep intervals

SLEEP = """WITH ev AS (SELECT user_id, date_trunc('second', ts) AS moment, event_id, CASE WHEN event_type IN ('error', 'signup') THEN 'sleep' ELSE 'wake' END AS state
  FROM events WHERE event_type <> 'view'),
c AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY moment, event_id) AS prev FROM ev),
ch AS (SELECT * FROM c WHERE prev IS NULL OR prev <> state),
nx AS (SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY moment, event_id) AS ps, lag(moment) OVER (PARTITION BY user_id ORDER BY moment, event_id) AS pa FROM ch),
iv AS (SELECT user_id, pa AS start, moment AS "end" FROM nx WHERE state = 'wake' AND ps = 'sleep')"""


def power_lines(spark, sf):
    """A power-log line per event, as text, with the event id to order equal seconds."""
    kind = F.when(F.col("event_type").isin("error", "signup"), "Sleep   Entering Sleep state").when(
        F.col("event_type") == "purchase", "DarkWake  DarkWake from Deep Idle"
    ).when(F.col("event_type") == "click", "Wake    Wake from Deep Idle").otherwise("Assertions  PID 1 created")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000 "), kind)
    return load(spark, sf, "events").select("user_id", "event_id", text.alias("value"))


def intervals(spark, sf):
    events = lg.power_events(power_lines(spark, sf), "value")
    return lg.sleep_intervals(events, ["user_id"], "at", "event_id", F.date_trunc("day", F.col("at")))


@query("sleep_intervals", "V18", SLEEP + """ SELECT user_id, epoch(start)::BIGINT AS start_s, epoch("end")::BIGINT AS end_s FROM iv""")
def _(spark, sf):
    return intervals(spark, sf).select("user_id", F.unix_seconds("start").alias("start_s"), F.unix_seconds("end").alias("end_s"))


@query("sleep_overlap_of_attempts", "D28 V19", SLEEP + """, att AS (SELECT user_id, event_id AS attempt, ts AS start, ts + to_minutes(event_id % 600) AS "end" FROM events WHERE event_type = 'view')
SELECT a.user_id, a.attempt, count(i.start) AS overlaps, round(coalesce(sum(CASE WHEN i.start IS NOT NULL THEN (epoch_us(least(a."end", i."end")) - epoch_us(greatest(a.start, i.start))) / 1e6 END), 0), 3) AS seconds
FROM att a LEFT JOIN iv i ON a.user_id = i.user_id AND a.start < i."end" AND i.start < a."end" GROUP BY ALL""")
def _(spark, sf):
    e = load(spark, sf, "events").where("event_type = 'view'")
    start = F.col("ts").cast("timestamp")
    attempts = e.select(
        "user_id", F.col("event_id").alias("attempt"), start.alias("start"),
        F.expr("cast(ts as timestamp) + make_dt_interval(0, 0, cast(event_id % 600 as int), 0)").alias("end"),
    )
    out = lg.interval_overlap(attempts, intervals(spark, sf), ["user_id"], 3600)
    return out.withColumn("seconds", F.round("seconds", 3))


# ------------------------------------------------------------------ run records


def runs(spark, sf):
    """A run record per order with one nested record per band, so the array is bounded by the
    number of bands and not by the rows of a run."""
    known = F.when(F.count_if(F.col("l_quantity") >= 49) == 0, F.sum("l_linenumber"))
    bands = load(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run"), "l_linenumber").agg(
        F.sum("l_tax").alias("open_seconds"), F.when(F.first("l_linenumber") != 2, F.sum("l_discount")).alias("read_seconds"), known.alias("blocks"),
        F.count_if(F.col("l_quantity") > 45).alias("errors"), F.sum(F.col("l_linenumber") % 7).alias("pixels"),
    )
    return bands.groupBy("run").agg(
        F.collect_list(F.struct("open_seconds", "read_seconds", "blocks")).alias("bands"), F.sum("errors").alias("errors"), F.sum("pixels").alias("pixels")
    )


@query("run_status_and_timers", "V03 V04 V05 V06 V07 V08 V09 V10 V29", """SELECT l_orderkey AS run, CASE WHEN l_orderkey % 17 = 0 THEN 'stopped_for_memory' WHEN l_orderkey % 13 = 0 THEN 'failed'
  WHEN sum(l_linenumber % 7) = 0 THEN 'no_pixel_in_tile' WHEN count(*) FILTER (l_quantity > 45) > 0 THEN 'band_errors' ELSE 'ok' END AS status,
  round(sum(l_tax + CASE WHEN l_linenumber <> 2 THEN l_discount ELSE 0 END), 3) AS read_seconds,
  CASE WHEN count(*) FILTER (l_quantity >= 49) = 0 THEN CAST(sum(l_linenumber) AS BIGINT) END AS blocks FROM lineitem GROUP BY l_orderkey""")
def _(spark, sf):
    error = F.when(F.col("run") % 13 == 0, F.lit("read failed"))
    status = ck.run_status(memory_stop=F.col("run") % 17 == 0, error=error, band_errors=F.col("errors"), pixels=F.col("pixels"))
    return runs(spark, sf).select(
        "run", status.alias("status"), ck.sum_timers(F.col("bands"), ["open_seconds", "read_seconds"]).alias("read_seconds"),
        ck.blocks_touched(F.col("bands"), "blocks").alias("blocks"),
    )


@query("medians_of_clean_runs", "F45", """WITH r AS (SELECT l_suppkey AS lake, l_linenumber AS repetition, count(*) AS requests, CAST(sum(l_partkey) AS BIGINT) AS bytes, count(*) FILTER (l_tax > 7e-2) AS bad FROM lineitem GROUP BY ALL)
SELECT lake, count(*) FILTER (bad = 0) AS runs, count(*) FILTER (bad > 0) AS excluded, median(requests) FILTER (bad = 0) AS requests, median(bytes) FILTER (bad = 0) AS bytes FROM r GROUP BY lake""")
def _(spark, sf):
    r = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("lake"), F.col("l_linenumber").alias("repetition")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("l_partkey").alias("bytes"), F.count_if(F.col("l_tax") > 0.07).alias("bad")
    )
    r = r.withColumn("status", F.when(F.col("bad") == 0, "ok").otherwise("band_errors"))
    return ck.medians_of_clean_runs(r, ["lake"], "status", ["requests", "bytes"])


@query("digest_equality_of_methods", "F48 F51 F75", """WITH r AS (SELECT l_suppkey AS lake, l_linestatus AS method, CASE WHEN l_suppkey % 7 = 0 THEN l_linestatus WHEN l_suppkey % 11 = 0 AND l_linestatus = 'F' THEN NULL ELSE 'd' || l_suppkey END AS digest FROM lineitem)
SELECT lake, count(DISTINCT method) AS methods, count(DISTINCT coalesce(digest, 'missing')) AS digests, count(DISTINCT coalesce(digest, 'missing')) = 1 AS equal FROM r GROUP BY lake""")
def _(spark, sf):
    s = F.col("l_suppkey")
    digest = F.when(s % 7 == 0, F.col("l_linestatus")).when((s % 11 == 0) & (F.col("l_linestatus") == "F"), F.lit(None)).otherwise(F.concat(F.lit("d"), s))
    r = load(spark, sf, "lineitem").select(s.alias("lake"), F.col("l_linestatus").alias("method"), digest.alias("digest"))
    return ck.equal_digests(r, ["lake"], "digest", "method")


@query("reuse_decisions", "V11 V12 V27 V28 V30 V31 V32 V33 A20 X19", """WITH w AS (SELECT o_orderkey AS unit, o_custkey % 5 AS polygon, o_orderkey % 4 AS version, 10 AS resolution FROM orders),
s AS (SELECT o_orderkey AS unit, CASE WHEN o_orderkey % 8 = 1 THEN 9 ELSE o_custkey % 5 END AS polygon, CASE WHEN o_orderkey % 9 = 2 THEN NULL ELSE o_orderkey % 4 END AS version, 10 AS resolution,
  CASE WHEN o_orderkey % 10 = 3 THEN 'x' END AS error FROM orders WHERE o_orderkey % 3 <> 0),
j AS (SELECT w.unit, CASE WHEN s.unit IS NULL THEN 'nothing saved' WHEN error IS NOT NULL THEN 'saved run has errors' WHEN s.polygon IS DISTINCT FROM w.polygon THEN 'polygon'
  WHEN s.version IS DISTINCT FROM w.version THEN 'version' END AS reason FROM w LEFT JOIN s ON w.unit = s.unit)
SELECT unit, reason, reason IS NULL AS reuse FROM j""")
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = load(spark, sf, "orders")
    w = o.select(k.alias("unit"), (c % 5).alias("polygon"), (k % 4).alias("version"), F.lit(10).alias("resolution"))
    s = o.where(k % 3 != 0).select(
        k.alias("unit"), F.when(k % 8 == 1, 9).otherwise(c % 5).alias("polygon"), F.when(k % 9 != 2, k % 4).alias("version"), F.lit(10).alias("resolution"),
        F.when(k % 10 == 3, "x").alias("error"),
    )
    return ck.reuse_decision(w, s, ["unit"], ["polygon", "version", "resolution"], "error")


@query("changed_artifacts", "A07 A15 A21 A22 V02 F91 F93", """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'gone' ELSE 'changed' END AS state FROM documents WHERE doc_id % 11 = 0 OR doc_id % 7 = 0""")
def _(spark, sf):
    d = load(spark, sf, "documents")
    manifest = d.select("doc_id", F.sha2("text", 256).alias("digest"))
    now = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))
    found = d.where(F.col("doc_id") % 11 != 0).select("doc_id", F.sha2(now, 256).alias("digest"))
    return ck.changed_digests(manifest, found, "doc_id", "digest")


def checked_claim():
    """Lines after the first are checks of claims that no draft makes."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return F.when(n == 1, k).otherwise(-10 * k - n)


@query("bound_claims", "D29 D31 D32 D33 D46", """WITH d AS (SELECT o_orderkey AS claim, o_orderpriority AS field FROM orders),
c AS (SELECT CASE WHEN l_linenumber = 1 THEN l_orderkey ELSE -10 * l_orderkey - l_linenumber END AS claim, count(*) AS n, min(CASE WHEN l_returnflag = 'A' THEN 'confirmed' WHEN l_returnflag = 'N' THEN 'corrected' ELSE 'refuted' END) AS verdict FROM lineitem GROUP BY ALL),
j AS (SELECT claim, field, verdict, CASE WHEN n IS NULL THEN 'not checked' WHEN n > 1 THEN 'checked twice' WHEN verdict = 'refuted' THEN 'refuted' END AS gap_reason FROM d LEFT JOIN c USING (claim))
SELECT *, gap_reason IS NULL AS bound FROM j""")
def _(spark, sf):
    d = load(spark, sf, "orders").select(F.col("o_orderkey").alias("claim"), F.col("o_orderpriority").alias("field"))
    v = F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "N", "corrected").otherwise("refuted")
    c = load(spark, sf, "lineitem").select(checked_claim().alias("claim"), v.alias("verdict"))
    return ck.bind_claims(d, c, "claim", "verdict")


@query("claim_gaps_by_field", "D29 F92", """WITH c AS (SELECT CASE WHEN l_linenumber = 1 THEN l_orderkey ELSE -10 * l_orderkey - l_linenumber END AS claim, count(*) AS n, min(CASE WHEN l_returnflag = 'A' THEN 'confirmed' WHEN l_returnflag = 'N' THEN 'corrected' ELSE 'refuted' END) AS verdict FROM lineitem GROUP BY ALL)
SELECT o_orderpriority AS field, count(*) FILTER (n = 1 AND verdict <> 'refuted') AS bound, count(*) FILTER (n IS NULL OR n > 1 OR verdict = 'refuted') AS gaps FROM orders LEFT JOIN c ON o_orderkey = claim GROUP BY ALL""")
def _(spark, sf):
    d = load(spark, sf, "orders").select(F.col("o_orderkey").alias("claim"), F.col("o_orderpriority").alias("field"))
    v = F.when(F.col("l_returnflag") == "A", "confirmed").when(F.col("l_returnflag") == "N", "corrected").otherwise("refuted")
    c = load(spark, sf, "lineitem").select(checked_claim().alias("claim"), v.alias("verdict"))
    bound = ck.bind_claims(d, c, "claim", "verdict")
    return bound.groupBy("field").agg(F.count_if("bound").alias("bound"), F.count_if(~F.col("bound")).alias("gaps"))


@query("repeated_keys", "D32 F94 V02", "SELECT l_orderkey AS k, l_linenumber AS n0, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(spark, sf):
    li = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n0"))
    return ck.uniqueness(li, ["k", "n0"])


@query("read_window_of_runs", "F80 D44", """SELECT l_suppkey AS tile, CAST(min(l_shipdate)::DATE AS VARCHAR) AS first, CAST(max(l_shipdate)::DATE AS VARCHAR) AS last, count(DISTINCT l_linenumber) AS windows FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    return load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("tile")).agg(
        F.date_format(F.min("l_shipdate"), "yyyy-MM-dd").alias("first"), F.date_format(F.max("l_shipdate"), "yyyy-MM-dd").alias("last"),
        F.count_distinct("l_linenumber").alias("windows"),
    )


@query("accepted_source_changes", "V34 V33", """SELECT o_orderkey AS unit, CASE WHEN o_orderkey % 7 = 0 THEN 'no reason given' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'already extracted' END AS refused,
  o_orderkey % 7 <> 0 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS accepted FROM orders""")
def _(spark, sf):
    k = F.col("o_orderkey")
    changes = load(spark, sf, "orders").select(k.alias("unit"), F.when(k % 7 == 0, " ").otherwise("moved").alias("reason"))
    attempts = load(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("unit"))
    return ck.accept_source_change(changes, attempts, "unit", "reason").select("unit", "refused", "accepted")
