"""Work that grows out of small rows is dealt over tasks, and stays off the driver."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnscope.functions import scalars as sc
from tarnscope.llm import chat_repair
from tarnscope.operators import overlay as ov
from tarnscope.operators.geometry import spread
from tarnscope.plans import geometry as pg
from tarnscope.plans import overlay as po

SF = "/root/testdata/sf0.001"


def sent_to_all(df) -> list[str]:
    """What stands below every broadcast of the plan."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(line) - len(line.lstrip(" :|+-*(")) for line in lines]
    found = []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth[j] <= depth[i]), len(lines))
            found.append("\n".join(lines[i:end]))
    return found


def test_no_polygon_rows_are_broadcast_in_membership(spark):
    found = ov.membership(po.bays(spark, SF), pg.tiles(spark, SF), po.items(spark, SF).select("item", "tile"), po.footprints(spark, SF), cell=1000.0, spacing=20.0)
    assert not [s for s in sent_to_all(found) if "customer" in s or "c_custkey" in s]


def test_no_polygon_rows_are_broadcast_in_buffered_shares(spark):
    found = ov.buffered_shares(pg.lakes(spark, SF), pg.tiles(spark, SF), cell=1000.0, spacing=10.0)
    assert not [s for s in sent_to_all(found) if "customer" in s or "c_custkey" in s]


def test_rows_are_dealt_by_the_work_they_grow_to(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("n")).coalesce(1)
    assert spread(rows, ["id"], F.col("n"), 100).rdd.getNumPartitions() == 30
    assert spread(rows, ["id"], F.col("n"), 10**9).rdd.getNumPartitions() == 1
    assert spread(rows.limit(0), ["id"], F.col("n"), 100).count() == 0


def test_covered_area_counts_overlaps_once(spark):
    rows = [(1, 0, 0.0, 4.0), (1, 0, 1.0, 2.0), (1, 0, 3.0, 6.0), (1, 0, 8.0, 9.0), (1, 1, 0.0, 1.0), (2, 0, 0.0, 1.0), (2, 0, 0.0, 1.0)]
    spans = spark.createDataFrame(rows, "body long, line long, x0 double, x1 double")
    assert {r.body: r.area for r in ov.covered_area(spans, ["body"], 0.5).collect()} == {1: 4.0, 2: 0.5}


def test_difference_index_rounds_as_its_sql_and_keeps_an_empty_sum(spark):
    rows = spark.createDataFrame([(973, 307), (963, 317), (681, 599), (307, 973), (0, 0), (5, 0)], "g long, r long")
    found = rows.select(sc.rounded_away(sc.normalized_difference(F.col("g"), F.col("r")), 6).alias("d")).collect()
    assert [r.d for r in found] == [0.520312, 0.504687, 0.064062, -0.520312, None, 1.0]


def test_of_equal_rows_in_one_turn_the_first_is_kept(spark):
    rows = [(c, t, role, f"{role} {t}.", True) for c in range(300) for t, role in enumerate(("user", "assistant") * 8) for _ in range(2 + c % 2)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, there boolean").repartition(7)
    signed = chat_repair.signed_conversations(turns.select(F.col("conv_id").alias("conv"), "turn", "role", "text", F.md5("text").alias("digest"), F.col("there").alias("present")))
    assert "again#" in [s for s in signed._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Window" in s and "lag(" in s][0].split("digest#")[-1]
    found = chat_repair.repair_conversations(turns, present="there").collect()
    assert {r.audit for r in found if r.conv_id % 2 == 0} == {"KD" * 16} and {r.audit for r in found if r.conv_id % 2} == {"KDD" * 16}


def test_masks_deal_their_bodies_over_tasks(spark):
    from tarnscope.operators import masks as mk

    boxes = mk.spread_pixels(pg.gridded(spark, SF, 10).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(400)))), ["body", "copy"], 100.0)
    assert boxes.rdd.getNumPartitions() > 4


def test_closure_has_no_limit_of_rows(spark):
    from tarnscope.operators.claims import cited_closure

    refs = spark.range(600_000).select(F.concat(F.lit("c"), "id").alias("claim"), F.explode(F.array(F.concat(F.lit("s"), "id"), F.concat(F.lit("t"), "id"))).alias("cites"))
    assert cited_closure(refs, refs).count() == 1_200_000


def test_crossed_edges_are_dealt_by_polygon_and_meet_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ov, "PIECES", 500)
    rings = ov.spread_pieces(po.plots(spark, SF), ["body"], 0.0023)
    assert rings.rdd.getNumPartitions() > 4
    crossed = ov.crossed_edges(ov.projected_edges(rings, ["body"], "epsg", 1.0), ["body"], 250.0)
    plan = crossed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_pairs_of_one_cell_are_found_whatever_their_order(spark):
    star = [(0.0, 0.0), (40.0, 90.0), (80.0, 0.0), (0.0, 60.0), (80.0, 60.0), (0.0, 0.0)]
    rings = spark.createDataFrame([(1, 0, 0, star), (2, 0, 0, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 0.0)])], "body long, part int, ring int, pts array<struct<x:double,y:double>>")
    for cell in (7.0, 1000.0):
        found = ov.crossed_edges(ov.boundary_edges(rings, ["body"]), ["body"], cell).collect()
        assert [(r.body, r.crossings) for r in found] == [(1, 5)]


def test_support_pixels_are_dealt_by_lake_and_stay_there(spark, monkeypatch):
    from tarnscope.operators.contract import support_coverage

    monkeypatch.setattr(pg, "PIXELS", 500)
    pixels = pg.support_pixels(spark, SF)
    assert pixels.rdd.getNumPartitions() > 4
    plan = support_coverage(pixels, pg.tiles(spark, SF), cell=1000.0)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_records_of_a_stage_are_not_multiplied_before_their_shuffle(spark):
    from tarnscope.plans import collation as pc

    found = pc.equality(spark, SF)
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()


def test_repeated_records_change_nothing(spark):
    from tarnscope.operators.collation import method_equality

    kinds = "tile long, member long, band string, resolution int"
    rows = [(1, m, "red", 10, run, "naive" if run == 3 else "mask", d, w) for m, run, d, w in ((1, 0, "a", "w"), (1, 1, "a", "w"), (1, 3, "w", None), (2, 0, "a", "w"), (2, 1, None, "w"), (3, 0, None, None))]
    records = spark.createDataFrame(rows * 3, f"{kinds}, run long, method string, digest_all string, digest_wet string")
    expected = spark.createDataFrame([(1, m, "red", 10, True) for m in (1, 2, 3, 4)], f"{kinds}, resolved boolean")
    earlier = spark.createDataFrame([(1, 1, "red", 10, "w")], f"{kinds}, digest string")
    found = {r.member: (r.records, r.mask_methods_identical, r.naive_identical, r.naive_matches_wet, r.matches_earlier) for r in method_equality(records, expected, earlier, ["tile", "member", "band", "resolution"], 4, "naive").collect()}
    assert found == {1: (3, True, True, True, True), 2: (2, False, None, None, None), 3: (1, False, None, None, None), 4: (0, None, None, None, None)}


def test_groups_send_no_table_through_the_driver(spark, monkeypatch):
    from tarnscope.operators import covers

    joins, kept = [], covers.cut_lineage

    def watched(df):
        joins.extend(line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in line)
        return kept(df)

    monkeypatch.setattr(covers, "cut_lineage", watched)
    edges = spark.range(200).select(F.col("id").alias("node"), F.explode(F.array(F.floor(F.col("id") / 3), F.floor((F.col("id") + 1) / 3) + 1000)).alias("link"))
    assert {r.label for r in covers.connected_groups(edges, "node", "link").collect()} == {0}
    assert joins and all("strategy=merge" in line for line in joins)


def test_products_meet_their_item_without_a_join_and_are_not_one_group_without_it(spark):
    from tarnscope.operators.pairing import products_by_item

    rows = [(f"p{i}", f"g{i % 3}", "i1" if i < 6 else None, i != 5, "datastrip" if i < 6 else "no_c1_item") for i in range(40)]
    pairs = spark.createDataFrame(rows, "product string, generation string, c1_item string, whole boolean, pair_status string").repartition(4)
    found = products_by_item(pairs, product="product", generation="generation", complete=F.col("whole"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" in plan
    tasks = found.withColumn("task", F.spark_partition_id()).where("c1_item is null and status = 'no_c1_item'").select("task").distinct()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert tasks.count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    status = {r["product"]: (r.c1_item, r.status) for r in found.collect()}
    assert status["p2"] == ("i1", "datastrip") and status["p4"] == ("i1", "superseded_same_datastrip")
    assert status["p5"] == (None, "incomplete_layers") and status["p39"] == (None, "no_c1_item")
