"""Extraction queries: embeddings are 8 x 8 raster blocks, their ids the block places."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.operators import extraction as ex
from tarnscope.plans.registry import load, query

BLOCK_KEYS = ("br", "bc")
BANDS = ("red", "nir", "scl")


def blocks(spark, sf):
    """Three bands of every block, values scaled to integers with no-data where a pattern says."""
    e = load(spark, sf, "embeddings")
    index = F.sequence(F.lit(0), F.size("embedding") - 1)

    def value(band: int):
        def cell(p):
            v = F.floor(F.element_at("embedding", p + 1).cast("double") * 10000 + 0.5).cast("int") + 37 * band
            return F.when((F.col("vec_id") + p) % 11 == 0, F.lit(0)).otherwise(v)

        return F.transform(index, cell)

    rows = F.array(*[F.struct(F.lit(b).alias("band"), value(i).alias("values")) for i, b in enumerate(BANDS)])
    return e.select(
        F.floor(F.col("vec_id") / 32).alias("br"), (F.col("vec_id") % 32).alias("bc"), F.lit(8).alias("height"),
        F.lit(8).alias("width"), F.lit(0).alias("nodata"), F.col("label").alias("item"), F.inline(rows),
    )


def selections(spark, sf):
    """Every block belongs to one of seven lakes, which selects two fifths of its pixels."""
    e = load(spark, sf, "embeddings")
    positions = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda p: (p * 7 + F.col("vec_id")) % 5 < 2)
    s = e.select(
        F.concat(F.lit("lake"), F.col("vec_id") % 7).alias("lake"),
        F.floor(F.col("vec_id") / 32).alias("br"), (F.col("vec_id") % 32).alias("bc"), "vec_id", positions.alias("positions"),
    )
    return s.select(
        "lake", "br", "bc", F.size("positions").alias("n"), "positions",
        F.transform("positions", lambda p: ((p + F.col("vec_id")) % 3 + 1).cast("int")).alias("classes"),
    )


def pixels(spark, sf, strategy="per_body"):
    out = ex.extract(selections(spark, sf), blocks(spark, sf), BLOCK_KEYS, ["item", "band"], strategy)
    return ex.with_tile_position(out, F.lit(8))


PIX = """e AS (SELECT vec_id, label, unnest(embedding) AS f, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
raw AS (SELECT vec_id, label AS item, b.band, pos, CASE WHEN (vec_id + pos) % 11 = 0 THEN 0
    ELSE CAST(floor(CAST(f AS DOUBLE) * 10000 + 5e-1) AS BIGINT) + 37 * b.i END AS value
  FROM e, (VALUES ('red', 0), ('nir', 1), ('scl', 2)) b(band, i)),
pixels AS (SELECT 'lake' || (vec_id % 7) AS lake, item, band, vec_id // 32 AS br, vec_id % 32 AS bc, pos, value,
    (vec_id // 32) * 8 + pos // 8 AS "row", (vec_id % 32) * 8 + pos % 8 AS col, (pos + vec_id) % 3 + 1 AS pixel_class
  FROM raw WHERE (pos * 7 + vec_id) % 5 < 2)"""


def digest_sql(text: str, where: str = "TRUE") -> str:
    lane = "coalesce(sum(CAST(('0x' || substr(sha256({t}), {o}, 12)) AS BIGINT)) FILTER ({w}), 0)"
    return " || '-' || ".join(f"CAST({lane.format(t=text, o=o, w=where)} AS VARCHAR)" for o in (1, 13, 25))


RECORD = f"""count(*) AS pixels_extracted, count(*) FILTER (value = 0) AS nodata_extracted,
  min(value) FILTER (value <> 0) AS low, max(value) FILTER (value <> 0) AS high,
  count(*) FILTER (pixel_class = 1) AS interior, count(*) FILTER (pixel_class = 2) AS shoreline,
  count(*) FILTER (pixel_class = 3) AS near_land, {digest_sql("row || '|' || col || '|' || value")} AS digest_all,
  {digest_sql("row || '|' || col || '|' || value", "pixel_class IN (1, 2)")} AS digest_wet,
  {digest_sql("row || '|' || col || '|' || pixel_class")} AS digest_pixels"""
PIXEL_SQL = f'WITH {PIX} SELECT lake, item, band, "row", col, pixel_class, value FROM pixels'


def pixel_query(strategy):
    def run(spark, sf):
        return pixels(spark, sf, strategy).select(
            "lake", "item", "band", "row", "col", F.col("pixel_class").cast("bigint").alias("pixel_class"), F.col("value").cast("bigint").alias("value")
        )

    return run


query("pixels_per_body", "X01 X03 X04 X07 A17 A18 X20 X21", PIXEL_SQL)(pixel_query("per_body"))
query("pixels_shared_blocks", "X01 X07 X08 U03", PIXEL_SQL)(pixel_query("shared_blocks"))
query("pixels_full_scan", "X01 X05 X09", PIXEL_SQL)(pixel_query("full_scan"))


@query("extracted_records", "F71 F72 F73 X11 X16 X22 B56", f"WITH {PIX} SELECT lake, item, band, {RECORD} FROM pixels GROUP BY ALL")
def _(spark, sf):
    return ex.extracted_record(pixels(spark, sf), ["lake", "item", "band"])


@query("extracted_records_by_tile", "X17 T11", f"WITH {PIX} SELECT item, band, {RECORD} FROM pixels GROUP BY ALL")
def _(spark, sf):
    return ex.extracted_record(pixels(spark, sf, "shared_blocks"), ["item", "band"])


@query("whole_file_stats", "F74 X24", f"""WITH {PIX}, b AS (
  SELECT item, band, vec_id, count(*) AS n, count(*) FILTER (value = 0) AS empty, min(value) FILTER (value <> 0) AS lo,
    max(value) FILTER (value <> 0) AS hi, string_agg(CAST(value AS VARCHAR), ',' ORDER BY pos) AS t FROM raw GROUP BY ALL)
SELECT item, band, CAST(sum(n) AS BIGINT) AS pixels, CAST(sum(n) * 2 AS BIGINT) AS bytes, min(lo) AS low, max(hi) AS high,
  CAST(sum(empty) AS BIGINT) AS nodata, count(*) AS blocks,
  {digest_sql("(vec_id // 32) || '|' || (vec_id % 32) || '|' || t")} AS digest FROM b GROUP BY ALL""")
def _(spark, sf):
    return ex.array_stats(blocks(spark, sf), ["item", "band"], BLOCK_KEYS)


@query("packed_selections", "A17 E19 A08", """WITH p AS (SELECT vec_id % 7 AS lake, vec_id // 32 AS br, vec_id % 32 AS bc, vec_id,
  unnest(range(64)) AS pos FROM embeddings)
SELECT 'lake' || lake AS lake, br, bc, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions,
  string_agg(CAST((pos + vec_id) % 3 + 1 AS VARCHAR), ',' ORDER BY pos) AS classes
FROM p WHERE (pos * 7 + vec_id) % 5 < 2 GROUP BY ALL""")
def _(spark, sf):
    unpacked = ex.unpack_selection(selections(spark, sf), ["lake", "br", "bc"])
    packed = ex.pack_selection(unpacked, ["lake", "br", "bc"], "pos", "pixel_class")
    return packed.select(
        "lake", "br", "bc", F.col("n").cast("bigint").alias("n"), F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"),
        F.array_join(F.col("classes").cast("array<string>"), ",").alias("classes"),
    )


CONTRIBUTIONS = f"""WITH {PIX}, found AS (SELECT lake, item, band, count(*) AS n,
    max(CASE WHEN item = 3 AND band = 'nir' THEN 'read failed' END) AS error FROM pixels WHERE NOT (item = 2 AND band = 'red') GROUP BY ALL),
want AS (SELECT DISTINCT lake, item, band FROM pixels WHERE NOT (item = 7 AND band = 'scl'))"""


@query("contribution_status", "X10 X18 X23 F48 F53 W09", CONTRIBUTIONS + """
SELECT lake, item, band, CASE WHEN w.lake IS NULL THEN 'unexpected' WHEN f.lake IS NULL THEN 'missing' WHEN error IS NOT NULL THEN 'failed'
  ELSE 'measured' END AS status, coalesce(n, 0) AS pixels
FROM want w FULL JOIN found f USING (lake, item, band)""")
def _(spark, sf):
    p = pixels(spark, sf)
    keys = ["lake", "item", "band"]
    want = p.where(~((F.col("item") == 7) & (F.col("band") == "scl"))).select(*keys).distinct()
    failed = F.when((F.col("item") == 3) & (F.col("band") == "nir"), "read failed")
    found = p.where(~((F.col("item") == 2) & (F.col("band") == "red"))).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pixels"), F.max(failed).alias("error")
    )
    return ex.contributions(want, found, keys, "pixels", "error")


@query("strategy_differences", "F70 F55 F75", f"""WITH {PIX}, a AS (SELECT lake, item, band, "row", col, value FROM pixels),
b AS (SELECT lake, item, band, "row", col, CASE WHEN "row" % 17 = 3 AND col % 3 = 0 THEN value + 1 ELSE value END AS value FROM a)
SELECT *, 'first' AS side, CAST(1 AS BIGINT) AS surplus FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT *, 'second', CAST(1 AS BIGINT) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def _(spark, sf):
    columns = ["lake", "item", "band", "row", "col", "value"]
    a = pixels(spark, sf).select(*columns)
    changed = (F.col("row") % 17 == 3) & (F.col("col") % 3 == 0)
    b = pixels(spark, sf, "full_scan").select(*columns).withColumn(
        "value", F.when(changed, F.col("value") + 1).otherwise(F.col("value"))
    )
    out = ex.row_differences(a, b, columns)
    return out.select(*columns[:-1], F.col("value").cast("bigint").alias("value"), "side", "surplus")


@query("strategy_signatures", "F70 F75 F51", f"""WITH {PIX}, s AS (SELECT item, count(*) AS n,
  {digest_sql("lake || '|' || band || '|' || row || '|' || col || '|' || value")} AS signature FROM pixels GROUP BY ALL)
SELECT item, n AS rows, signature, CAST(3 AS BIGINT) AS strategies, TRUE AS equal FROM s""")
def _(spark, sf):
    columns = ["lake", "band", "row", "col", "value"]
    parts = None
    for name in ex.STRATEGIES:
        one = ex.table_signature(pixels(spark, sf, name), ["item"], columns).withColumn("strategy", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return parts.groupBy("item").agg(
        F.min("rows").alias("rows"), F.min("signature").alias("signature"), F.count_distinct("strategy").alias("strategies"),
        (F.count_distinct("rows", "signature") == 1).alias("equal"),
    )


@query("block_window_accounting", "E18 E20 E21 E22 X14 F54", """WITH w AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey % 5000 AS r, l_suppkey % 3000 AS c,
  CAST(l_quantity AS BIGINT) * 20 - 40 AS h, l_linenumber * 100 AS w, l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT k, n, p, s, CASE WHEN h <= 0 THEN 0 ELSE ((r + h - 1) // 512 - r // 512 + 1) * ((c + w - 1) // 512 - c // 512 + 1) END AS blocks,
  CASE WHEN h <= 0 THEN 0 ELSE ((r + h - 1) // 256 - r // 256 + 1) * ((c + w - 1) // 256 - c // 256 + 1) END AS shared_chunks,
  CASE WHEN h <= 0 THEN 0 ELSE ((h + 255) // 256) * ((w + 255) // 256) END AS own_chunks,
  least(512, 5490 - (r // 512) * 512) AS block_height, least(512, 5490 - (c // 512) * 512) AS block_width FROM w""")
def _(spark, sf):
    w = load(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 5000).alias("r"), (F.col("l_suppkey") % 3000).alias("c"),
        (F.col("l_quantity").cast("bigint") * 20 - 40).alias("h"), (F.col("l_linenumber") * 100).alias("w"),
        F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"),
    )
    window = [F.col(c) for c in "rchw"]
    own = ex.block_window(F.floor(F.col("r") / 512), F.floor(F.col("c") / 512), (5490, 5490), (512, 512))
    return w.select(
        "k", "n", "p", "s", ex.blocks_in_window(*window, (512, 512)).alias("blocks"),
        ex.chunks_in_window(*window, 256, shared=True).alias("shared_chunks"),
        ex.chunks_in_window(*window, 256, shared=False).alias("own_chunks"),
        own["height"].alias("block_height"), own["width"].alias("block_width"),
    )


@query("block_cells_of_windows", "E20", """WITH w AS (SELECT o_orderkey AS k, o_custkey % 5000 AS r, o_orderkey % 3000 AS c,
  (o_orderkey % 40) * 20 - 40 AS h, (o_custkey % 30) * 30 AS w FROM orders),
x AS (SELECT k, c, w, unnest(generate_series(r // 512, (r + h - 1) // 512)) AS br FROM w WHERE h > 0 AND w > 0)
SELECT k, br, unnest(generate_series(c // 512, (c + w - 1) // 512)) AS bc FROM x""")
def _(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    w = load(spark, sf, "orders").select(
        k.alias("k"), (c % 5000).alias("r"), (k % 3000).alias("c"), ((k % 40) * 20 - 40).alias("h"), ((c % 30) * 30).alias("w")
    )
    return ex.block_cells(w, "r", "c", "h", "w", (512, 512)).select("k", "br", "bc")


@query("block_byte_accounting", "F59 F60 F63", """WITH u AS (SELECT l_suppkey % 10 AS cohort, l_partkey % 64 AS br, l_orderkey % 64 AS bc, l_linenumber AS band FROM lineitem),
p AS (SELECT cohort, band, br, bc, count(*) AS n FROM u GROUP BY ALL),
c AS (SELECT cohort, band, CAST(sum(n) AS BIGINT) AS logical_blocks, count(*) AS unique_blocks,
  CAST(sum(n * (1000 + br * 64 + bc)) AS BIGINT) AS logical_bytes, CAST(sum(1000 + br * 64 + bc) AS BIGINT) AS unique_bytes FROM p GROUP BY ALL)
SELECT c.*, CAST(4096 AS BIGINT) AS full_blocks, CAST(4096 * 1000 + 4095 * 2048 AS BIGINT) AS full_bytes,
  round(logical_bytes / CAST(unique_bytes AS DOUBLE), 6) AS logical_to_unique FROM c""")
def _(spark, sf):
    u = load(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("cohort"), F.col("l_linenumber").alias("band"), (F.col("l_partkey") % 64).alias("br"), (F.col("l_orderkey") % 64).alias("bc")
    ).withColumn("bytes", 1000 + F.col("br") * 64 + F.col("bc"))
    cells = F.inline(F.transform(F.sequence(F.lit(0), F.lit(4095)), lambda i: F.struct(i.alias("cell"), (i + 1000).cast("bigint").alias("bytes"))))
    full = u.select("cohort", "band").distinct().select("cohort", "band", cells)
    return ex.block_accounting(u, ["cohort", "band"], BLOCK_KEYS, full)
