"""Revision, accounting and stream queries: events are revisions of (user, type) scenes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.operators import contract as ct
from tarnscope.plans.registry import load, query
from tarnscope.streaming import metrics as mt
from tarnscope.streaming import scenes as sc
from tarnscope.streaming import streams as st

KEYS = ["user_id", "event_type"]


def revisions(spark, sf):
    e = load(spark, sf, "events")
    return e.select(
        "user_id", "event_type", F.col("ts").alias("available_at"), F.col("event_id").alias("revision"), F.floor(F.col("value") * 100).alias("dn"),
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
    )


def stamp(text):
    return F.lit(text).cast("timestamp_ntz")


@query("latest_revisions", "T05", """SELECT user_id, event_type, max((ts, event_id))[2] AS revision, CAST(floor(arg_max(value, (ts, event_id)) * 100) AS BIGINT) AS dn, count(*) AS revisions FROM events GROUP BY ALL""")
def _(spark, sf):
    return ct.latest_per_scene(revisions(spark, sf), KEYS, ["available_at", "revision"], ["dn"]).drop("available_at")


@query("as_of_revisions", "T04", """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS revision, CAST(floor(arg_max(value, (ts, event_id)) * 100) AS BIGINT) AS dn, count(*) AS revisions
FROM events WHERE ts <= TIMESTAMP '2024-01-15 12:00:00' GROUP BY ALL""")
def _(spark, sf):
    r = revisions(spark, sf)
    return ct.as_of(r, KEYS, ["available_at", "revision"], ["dn"], stamp("2024-01-15 12:00:00")).drop("available_at")


@query("exact_revision", "T06", "SELECT user_id, event_type, event_id AS revision, CAST(floor(value * 100) AS BIGINT) AS dn FROM events WHERE event_id = (SELECT max(event_id) FROM events WHERE event_type = 'purchase')")
def _(spark, sf):
    r = revisions(spark, sf)
    last = r.where("event_type = 'purchase'").select(F.max("revision")).scalar()
    return ct.exact_revision(r, "revision", last).select("user_id", "event_type", "revision", "dn")


@query("published_revisions", "T03", """WITH p AS (SELECT DISTINCT user_id, event_type, ts::DATE AS day FROM events WHERE event_id % 4 = 0)
SELECT user_id, event_type, CAST(ts::DATE AS VARCHAR) AS day, arg_min(event_id, ts) AS revision FROM events e
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.user_id = e.user_id AND p.event_type = e.event_type AND p.day = e.ts::DATE) GROUP BY ALL""")
def _(spark, sf):
    r = revisions(spark, sf)
    keys = [*KEYS, "day"]
    return ct.publish(r.where(F.col("revision") % 4 == 0).select(*keys), r, keys, "available_at").select(*keys, "revision")


@query("served_records", "T07 T04", """SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS revision, CAST(floor(arg_max(value, (ts, event_id)) * 100) AS BIGINT) AS dn, count(*) AS revisions
FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-25' AND event_type IN ('click', 'view') AND ts <= TIMESTAMP '2024-01-20'
  AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY ALL""")
def _(spark, sf):
    bodies = load(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    out = ct.serve(
        revisions(spark, sf), bodies, "user_id", period=(stamp("2024-01-05"), stamp("2024-01-26")), time="available_at", families=["click", "view"], family="event_type",
        keys=KEYS, order=["available_at", "revision"], values=["dn"], cutoff=stamp("2024-01-20"),
    )
    return out.drop("available_at")


def served_with_bands(spark, sf):
    events = load(spark, sf, "events")
    band = F.element_at(F.array(F.lit("red"), F.lit("nir"), F.lit("scl")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = events.select(
        "user_id", "event_type", F.col("ts").alias("available_at"), F.col("event_id").alias("revision"), F.floor(F.col("value") * 100).alias("dn"), band.alias("band"),
        F.when(F.col("event_id") % 3 == 2, 20).otherwise(10).alias("resolution"), F.concat(F.lit("item-"), F.col("event_id") % 97).alias("source"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("published"),
    )
    bodies = load(spark, sf, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')").select(F.col("c_custkey").alias("user_id"))
    return ct.serve_bands(
        rows, bodies, "user_id", period=(stamp("2024-01-03"), stamp("2024-01-28")), time="available_at", family="event_type", families=["click", "view"], band="band", bands=["red", "scl"],
        resolution="resolution", order=["available_at", "revision"], values=["dn"], provenance=["source", "published"], cutoff=stamp("2024-01-22"),
    )


SERVED = """WITH asked AS (SELECT c_custkey AS user_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')),
r AS (SELECT *, ['red', 'nir', 'scl'][CAST(event_id % 3 AS INT) + 1] AS band, CASE WHEN event_id % 3 = 2 THEN 20 ELSE 10 END AS resolution FROM events
  WHERE ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-28' AND ts <= TIMESTAMP '2024-01-22' AND event_type IN ('click', 'view') AND event_id % 3 <> 1 AND user_id IN (SELECT user_id FROM asked)),
last AS (SELECT user_id, event_type, band, resolution, max((ts, event_id))[2] AS revision, count(*) AS revisions FROM r GROUP BY ALL)"""


@query("served_bands", "T07 T04", SERVED + """ SELECT l.user_id, l.event_type, l.band, l.resolution, revision, CAST(floor(value * 100) AS BIGINT) AS dn, 'item-' || (event_id % 97) AS source, strftime(ts, '%Y-%m-%d %H:%M:%S') AS published, revisions
FROM last l JOIN events ON event_id = revision""")
def _(spark, sf):
    return served_with_bands(spark, sf)[0].drop("available_at")


@query("served_accounts", "T07 T08", SERVED + """, want AS (SELECT user_id, event_type, band FROM asked, (VALUES ('click'), ('view')) f(event_type), (VALUES ('red'), ('scl')) b(band))
SELECT user_id, event_type, count(*) AS expected, count(revision) AS present, count(*) - count(revision) AS missing, coalesce(string_agg(band, ',' ORDER BY band) FILTER (revision IS NULL), '') AS missing_bands
FROM want LEFT JOIN last USING (user_id, event_type, band) GROUP BY ALL""")
def _(spark, sf):
    return served_with_bands(spark, sf)[1].withColumn("missing_bands", F.array_join("missing_bands", ","))


SPINE = """WITH days AS (SELECT CAST(unnest(generate_series((SELECT min(ts)::DATE FROM events), (SELECT max(ts)::DATE FROM events), INTERVAL 1 DAY))::DATE AS VARCHAR) AS day), users AS (SELECT DISTINCT user_id FROM events),
want AS (SELECT user_id, day FROM users, days), have AS (SELECT DISTINCT user_id, CAST(ts::DATE AS VARCHAR) AS day FROM events WHERE event_type = 'purchase')"""


def day_spine(spark, sf):
    events = load(spark, sf, "events")
    bounds = events.select(F.struct(F.to_date(F.min("ts")).alias("low"), F.to_date(F.max("ts")).alias("high"))).scalar()
    users = events.select("user_id").distinct().withColumn("period", bounds)
    days = F.sequence(F.col("period.low"), F.col("period.high"))
    return users.select("user_id", F.explode(days).alias("d")).select("user_id", F.date_format("d", "yyyy-MM-dd").alias("day"))


@query("period_accounting", "T08", SPINE + """ SELECT w.user_id, count(*) AS expected, count(h.day) AS present, count(*) - count(h.day) AS missing, CAST(0 AS BIGINT) AS unexpected,
  min(CASE WHEN h.day IS NULL THEN CASE WHEN w.user_id % 3 = 0 THEN 'no_data' ELSE 'not_delivered' END END) AS first_reason,
  count(*) FILTER (h.day IS NULL AND w.user_id % 3 <> 0) AS not_delivered FROM want w LEFT JOIN have h USING (user_id, day) GROUP BY w.user_id""")
def _(spark, sf):
    present = revisions(spark, sf).where("event_type = 'purchase'").select("user_id", "day")
    reason = F.when(F.col("user_id") % 3 == 0, "no_data").otherwise("not_delivered")
    return ct.account(day_spine(spark, sf), present, ["user_id", "day"], ["user_id"], reason)


@query("missing_dates", "T02", SPINE + """ SELECT w.user_id, count(*) AS missing_dates, min(w.day) AS first, max(w.day) AS last FROM want w LEFT JOIN have h USING (user_id, day) WHERE h.day IS NULL GROUP BY ALL""")
def _(spark, sf):
    valid = revisions(spark, sf).where("event_type = 'purchase'")
    return ct.missing_dates(day_spine(spark, sf), valid, ["user_id"], "day")


@query("family_period_accounting", "T08", SPINE + """, fam AS (SELECT user_id, day, f.event_type, strftime(date_trunc('week', day::DATE), '%Y-%m-%d') AS period FROM want, (VALUES ('click'), ('purchase')) f(event_type)),
seen AS (SELECT DISTINCT user_id, event_type, CAST(ts::DATE AS VARCHAR) AS day FROM events)
SELECT w.user_id, w.event_type, w.period, count(*) AS expected, count(h.day) AS present, count(*) - count(h.day) AS missing, CAST(0 AS BIGINT) AS unexpected,
  min(CASE WHEN h.day IS NULL THEN CASE WHEN w.user_id % 3 = 0 THEN 'no_data' ELSE 'not_delivered' END END) AS first_reason, count(*) FILTER (h.day IS NULL AND w.user_id % 3 <> 0) AS not_delivered
FROM fam w LEFT JOIN seen h USING (user_id, event_type, day) GROUP BY ALL""")
def _(spark, sf):
    families = F.array(F.lit("click"), F.lit("purchase"))
    period = F.date_format(F.date_trunc("week", F.to_date("day")), "yyyy-MM-dd").alias("period")
    expected = day_spine(spark, sf).withColumn("event_type", F.explode(families)).select("user_id", "event_type", "day", period)
    present = revisions(spark, sf).where(F.col("event_type").isin("click", "purchase")).select("user_id", "event_type", "day", period)
    reason = F.when(F.col("user_id") % 3 == 0, "no_data").otherwise("not_delivered")
    return ct.account(expected, present, ["user_id", "event_type", "period", "day"], ["user_id", "event_type", "period"], reason)


@query("missing_dates_of_primary_tile", "T02", SPINE + """, own AS (SELECT DISTINCT user_id, CAST(ts::DATE AS VARCHAR) AS day FROM events WHERE event_type = 'purchase' AND event_id % 3 = user_id % 3)
SELECT w.user_id, count(*) AS missing_dates, min(w.day) AS first, max(w.day) AS last FROM want w LEFT JOIN own h USING (user_id, day) WHERE h.day IS NULL GROUP BY ALL""")
def _(spark, sf):
    valid = revisions(spark, sf).where("event_type = 'purchase'").withColumn("tile", F.col("revision") % 3)
    primary = load(spark, sf, "events").select("user_id", (F.col("user_id") % 3).alias("tile")).distinct()
    return ct.missing_dates(day_spine(spark, sf), ct.in_primary_tile(valid, primary, "user_id", "tile"), ["user_id"], "day")


@query("shared_month_rates", "K09 K08", """WITH a AS (SELECT o_custkey % 25 AS tile, strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS st, month(o_orderdate) AS m FROM orders),
spine AS (SELECT DISTINCT tile, month FROM a WHERE (tile + m) % 5 <> 0 AND (tile * 3 + m) % 7 <> 0),
n AS (SELECT tile, month, count(*) FILTER (st = 'O') AS a, count(*) FILTER (st = 'F') AS b FROM spine JOIN a USING (tile, month) GROUP BY ALL)
SELECT tile, count(*) AS months, CAST(sum(a) AS BIGINT) AS first, CAST(sum(b) AS BIGINT) AS second, round(sum(a) * 12 / count(*), 6) AS first_per_year, round(sum(b) * 12 / count(*), 6) AS second_per_year,
  round(max(a) / nullif(sum(a) / count(*), 0), 6) AS first_peak, round(max(b) / nullif(sum(b) / count(*), 0), 6) AS second_peak FROM n GROUP BY tile""")
def _(spark, sf):
    rows = load(spark, sf, "orders").select((F.col("o_custkey") % 25).alias("tile"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("st"), F.month("o_orderdate").alias("m"))
    listed = rows.where((F.col("tile") + F.col("m")) % 5 != 0), rows.where((F.col("tile") * 3 + F.col("m")) % 7 != 0)
    out = ct.shared_month_rates(rows.where("st = 'O'"), rows.where("st = 'F'"), *listed, "tile", "month")
    return out.select("tile", "months", "first", "second", *[F.round(c, 6).alias(c) for c in ("first_per_year", "second_per_year", "first_peak", "second_peak")])


@query("mask_reasons", "T10 T09", """WITH e AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN 0 ELSE event_id % 900 END AS dn, event_type <> 'error' AS delivered, user_id % 9 <> 0 AS in_tile, CASE WHEN event_id % 4 <> 0 THEN event_id % 5 <> 0 END AS j FROM events)
SELECT coalesce(CASE WHEN NOT delivered THEN 'not_delivered' WHEN NOT in_tile THEN 'outside_tile' WHEN dn = 0 AND coalesce(j, FALSE) THEN 'processor_masked' WHEN dn = 0 THEN 'no_data' END, 'value') AS reason,
  count(*) AS n, round(sum(CASE WHEN delivered AND in_tile AND dn <> 0 THEN dn * 1e-4 - 1e-1 END), 4) AS reflectance_sum FROM e GROUP BY ALL""")
def _(spark, sf):
    from tarnscope.functions.scalars import reflectance

    i = F.col("event_id")
    e = load(spark, sf, "events").select(
        F.when(i % 6 == 0, 0).otherwise(i % 900).alias("dn"), (F.col("event_type") != "error").alias("delivered"), (F.col("user_id") % 9 != 0).alias("in_tile"),
        F.when(i % 4 != 0, i % 5 != 0).alias("joined"),
    )
    reason = ct.mask_reason(F.col("dn"), delivered=F.col("delivered"), in_tile=F.col("in_tile"), nodata=F.lit(0), joined_has_data=F.col("joined"))
    value = F.when(F.col("delivered") & F.col("in_tile"), reflectance(F.col("dn"), F.lit(1e-4), F.lit(-0.1)))
    return e.groupBy(F.coalesce(reason, F.lit("value")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("reflectance_sum"))


@query("replay_windows", "T12", """SELECT d.days, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events, (VALUES (1), (30), (365)) d(days)
WHERE ts > (SELECT max(ts) FROM events) - to_days(d.days) GROUP BY ALL""")
def _(spark, sf):
    events = load(spark, sf, "events")
    e = events.withColumn("end", events.select(F.max("ts")).scalar())
    since = lambda d: F.col("ts") > F.col("end") - F.make_dt_interval(d)
    windows = F.filter(F.array(F.lit(1), F.lit(30), F.lit(365)), since)
    e = e.where(since(F.lit(365))).withColumn("days", F.explode(windows))
    return e.groupBy("days", "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"))


# ------------------------------------------------------------------ streams


def event_stream(spark, sf):
    schema = load(spark, sf, "events").schema
    s = st.landed(spark, f"{sf.rstrip('/')}/events*.parquet", schema)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def text(column):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


CLOSED = "(SELECT max(ts) FROM events)"


@query("stream_tumbling_arrivals", "S01 S04", f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= date_trunc('milliseconds', {CLOSED}) - INTERVAL 6 HOUR GROUP BY ALL""")
def _(spark, sf):
    out = st.run_to_table(st.arrivals(event_stream(spark, sf), "ts", ["event_type"], "1 day", None, "6 hours"), "tumbling")
    return out.select(text("start").alias("start"), "event_type", "n")


@query("stream_sliding_arrivals", "S04", f"""WITH w AS (SELECT event_type, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS start FROM events)
SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM w WHERE start + INTERVAL 7 DAY <= date_trunc('milliseconds', {CLOSED}) - INTERVAL 6 HOUR GROUP BY ALL""")
def _(spark, sf):
    out = st.run_to_table(st.arrivals(event_stream(spark, sf), "ts", ["event_type"], "7 days", "1 day", "6 hours"), "sliding")
    return out.select(text("start").alias("start"), "event_type", "n")


@query("stream_first_seen", "S02", "SELECT DISTINCT user_id, event_type, CAST(ts::DATE AS VARCHAR) AS day FROM events")
def _(spark, sf):
    s = event_stream(spark, sf).withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    out = st.run_to_table(st.first_seen(s, [*KEYS, "day"], "ts", "30 days"), "first-seen")
    return out.select(*KEYS, "day")


@query("stream_scene_completeness", "S03 C09", f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, user_id, count(DISTINCT event_type) AS layers, count(*) AS objects, count(DISTINCT event_type) = 5 AS complete
FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= date_trunc('milliseconds', {CLOSED}) - INTERVAL 6 HOUR GROUP BY ALL""")
def _(spark, sf):
    s = st.scene_completeness(event_stream(spark, sf), "ts", ["user_id"], "event_type", 5, "1 day", "6 hours")
    return st.run_to_table(s, "scenes").withColumn("start", text("start"))


@query("stream_scene_states", "S03", f"""WITH RECURSIVE s AS (SELECT user_id, min(ts) AS first FROM events GROUP BY 1
  UNION ALL SELECT s.user_id, min(e.ts) FROM s JOIN events e ON e.user_id = s.user_id AND e.ts > s.first + INTERVAL 3 DAY GROUP BY s.user_id),
n AS (SELECT *, lead(first) OVER (PARTITION BY user_id ORDER BY first) AS next FROM s),
r AS (SELECT n.user_id, n.first, n.next, e.event_type, e.ts FROM n JOIN events e ON e.user_id = n.user_id AND e.ts BETWEEN n.first AND n.first + INTERVAL 3 DAY),
c AS (SELECT user_id, first, CASE WHEN count(*) = 5 THEN max(seen) END AS done FROM (SELECT user_id, first, event_type, min(ts) AS seen FROM r GROUP BY ALL) GROUP BY ALL)
SELECT user_id, strftime(first, '%Y-%m-%d %H:%M:%S') AS first, strftime(coalesce(done, first + INTERVAL 3 DAY), '%Y-%m-%d %H:%M:%S') AS last, CAST(count(DISTINCT event_type) AS INTEGER) AS layers, count(*) AS objects, done IS NOT NULL AS complete
FROM r JOIN c USING (user_id, first) WHERE (done IS NULL OR ts <= done) AND (done IS NOT NULL OR next IS NOT NULL OR first + INTERVAL 3 DAY <= {CLOSED} - INTERVAL 6 HOUR) GROUP BY user_id, first, done""")
def _(spark, sf):
    s = sc.scene_states(event_stream(spark, sf), "ts", ["user_id"], "event_type", 5, "3 days", "6 hours")
    out = st.run_to_table(s, "scene-states")
    return out.select("user_id", text("first").alias("first"), text("last").alias("last"), "layers", "objects", "complete")


SLICES = 6


@query("stream_late_rows", "S07 F18", f"""WITH a AS (SELECT *, ts + to_days(CAST(CASE WHEN event_id % 19 = 0 THEN 45 ELSE 0 END AS INTEGER)) AS arrived FROM events),
e AS (SELECT ts, least(5, CAST(floor(6 * (epoch_us(arrived) - lo) / (hi - lo + 1)) AS BIGINT)) AS batch FROM a, (SELECT min(epoch_us(arrived)) AS lo, max(epoch_us(arrived)) AS hi FROM a)),
m AS (SELECT batch, max(ts) AS top FROM e GROUP BY 1),
w AS (SELECT b.batch, date_trunc('milliseconds', max(m.top)) - INTERVAL 3 DAY AS mark FROM m b LEFT JOIN m ON m.batch <= b.batch - 2 GROUP BY 1)
SELECT batch, count(*) AS rows, count(*) FILTER (ts <= mark) AS dropped, count(*) - count(*) FILTER (ts <= mark) AS kept FROM e JOIN w USING (batch) GROUP BY 1""")
def _(spark, sf):
    events = load(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    arrived = F.unix_micros(F.col("ts") + F.make_dt_interval(F.when(F.col("event_id") % 19 == 0, 45).otherwise(0)))
    low, high = events.agg(F.min(arrived), F.max(arrived)).first()
    batch = F.least(F.lit(SLICES - 1), F.floor(SLICES * (arrived - low) / (high - low + 1))).cast("long")
    path = st.land_in_order(events.select("event_id", "ts", batch.alias("slice")), "slice", range(SLICES), files=2)
    stream = st.landed(spark, path, st.schema_of("event_id long, ts timestamp, slice long"), files_per_trigger=2)
    # Every row is its own key, so the operator counts rows.
    kept, late = mt.run_with_late_rows(st.first_seen(stream, ["event_id"], "ts", "3 days"), "late_rows_by_batch")
    told = kept.groupBy(F.col("slice").alias("batch")).agg(F.count(F.lit(1)).alias("kept"))
    return late.where("rows > 0").join(told, "batch", "left").select("batch", "rows", "dropped", F.coalesce("kept", F.lit(0)).alias("kept"))


@query("stream_latency_bins", "S05 S07", f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, CAST(floor(value / 10) AS BIGINT) AS hour, count(*) AS n FROM events
WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= date_trunc('milliseconds', {CLOSED}) - INTERVAL 6 HOUR GROUP BY ALL""")
def _(spark, sf):
    s = st.latency_bins(event_stream(spark, sf), "ts", ["event_type"], F.col("value") / 10, "1 day", "6 hours")
    return st.run_to_table(s, "latency").withColumn("start", text("start"))


@query("stream_pass_sessions", "S06 B17", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, sid HAVING max(ts) + INTERVAL 30 MINUTE <= date_trunc('milliseconds', {CLOSED}) - INTERVAL 6 HOUR""")
def _(spark, sf):
    out = st.run_to_table(st.pass_sessions(event_stream(spark, sf), "ts", ["user_id"], "30 minutes", "6 hours"), "sessions")
    return out.select("user_id", text("start").alias("start"), "n")


@query("stream_publication", "S08 T03", "SELECT user_id, event_type, CAST(ts::DATE AS VARCHAR) AS day, arg_min(event_id, ts) AS revision FROM events GROUP BY ALL")
def _(spark, sf):
    s = event_stream(spark, sf).select(*KEYS, F.date_format("ts", "yyyy-MM-dd").alias("day"), "ts", F.col("event_id").alias("revision"))
    return st.publish_stream(s, [*KEYS, "day"], "ts", "publication").select(*KEYS, "day", "revision")


@query("stream_static_join", "S09 D08", """SELECT event_id, event_type, c_mktsegment FROM events JOIN customer ON user_id = c_custkey""")
def _(spark, sf):
    c = load(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    joined = st.with_static(event_stream(spark, sf), c, ["user_id"]).select("event_id", "event_type", "c_mktsegment")
    return st.run_to_table(joined, "static-join")
