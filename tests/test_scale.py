"""Plans and layouts that keep memory and disk in step with the input."""

import glob
import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from edgeline import session
from edgeline.operators import boundary as bd
from edgeline.operators import cells as cl
from edgeline.operators import footprints as fp
from edgeline.operators import samples as sm
from edgeline.plans import files
from edgeline.plans.registry import QUERIES
from edgeline.session import materialise
from edgeline.sources import tables as tb
from edgeline.sources.adapter import Views


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def squares(spark):
    """A few wide squares: little data that covers very many grid cells."""
    corners = [(0, 0), (0, 1), (1, 1), (1, 0), (0, 0)]
    # Written, as Spark knows the size of files only.
    return materialise(spark.createDataFrame(
        [(f, f"P{f}", 0, i, 200_000.0 * f + 100_000.0 * x, 100_000.0 * y)
         for f in range(3) for i, (x, y) in enumerate(corners)],
        "fid long, site_id string, ring int, vtx long, x double, y double"), "squares")


@pytest.mark.parametrize("own", [False, True])
def test_unfolded_border_content_is_not_broadcast(spark, squares, own):
    points = spark.createDataFrame(
        [(f, k, 200_000.0 * f + 1000.0 * k, 50_000.0) for f in range(3) for k in range(-5, 5)],
        "fid long, transect_id long, x double, y double")
    hits = bd.near_or_inside(points, ["fid", "transect_id"], squares, 2500.0, 2000.0, own=own)
    joins = [line for line in plan_of(hits).splitlines() if "Join" in line and "cx#" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)
    found = {(r.fid, r.transect_id, r.pid, r.inside) for r in hits.collect()}
    assert found == {(f, k, f, k >= 0) for f in range(3) for k in range(-2, 5)}


def test_stacked_csv_is_compressed_and_whole(spark, monkeypatch, tmp_path):
    rows = [("S1", t, p, y, None if t == 3 else t + p / 10.0) for t in range(4)
            for p in (-1, 0, 1) for y in (2001, 2020)]
    class Small(Views):
        def samples(self, **layout):
            return spark.createDataFrame(
                rows, "site_id string, transect_id long, pnt_pst int, year int, grad double")
    monkeypatch.setattr(files, "scratch_path", lambda session, name: f"{tmp_path}/{name}")
    got = {(r.year, r.n_rows, r.n_values) for r in QUERIES["a02_stack_folder"](
        Small(spark, "")).collect()}
    assert got == {(2001, 12, 9), (2020, 12, 9)}
    parts = glob.glob(f"{tmp_path}/stacked/*/part-*")
    assert parts and all(p.endswith(".csv.gz") for p in parts)


def test_partitioned_write_does_not_sort(spark, monkeypatch, tmp_path):
    name, seen, save = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.save
    monkeypatch.setattr(DataFrameWriter, "save", lambda writer, path: (
        seen.append(int(spark.conf.get(name))), save(writer, path)))
    before = spark.conf.get(name)
    df = spark.range(100).selectExpr("id", "cast(id % 20 as int) AS k")
    tb.write_table(df, f"{tmp_path}/by_k", "parquet", ["k"])
    assert seen[0] > 1 and spark.conf.get(name) == before
    back = tb.read_table(spark, f"{tmp_path}/by_k", df.schema, "parquet")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("ranges", [False, True])
def test_sample_partitions_follow_the_orders(spark, monkeypatch, ranges):
    monkeypatch.setattr(session, "TASK_ROWS", 5000)
    views = Views(spark, "/root/testdata/sf0.001")
    n = views.table("orders").count()
    assert views.samples(ranges=ranges).rdd.getNumPartitions() >= n * 100 // 5000 > 8


def test_ranges_hold_a_number_of_rows(spark, monkeypatch):
    raw = spark.range(1000).selectExpr("concat('S', id % 7) AS site_id", "id AS transect_id",
                                       "0 AS pnt_pst", "2020 AS year", "1.0D AS grad")
    slim = tb.slim_samples(raw, 40)
    assert slim.rdd.getNumPartitions() == 40 and slim.count() == 1000


def test_complete_transects_do_not_sort_the_samples(spark):
    views = Views(spark, "/root/testdata/sf0.001")
    plan = plan_of(sm.complete_transects(views.samples()))
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan


def test_masks_are_dealt_over_as_many_tasks_as_they_need(spark, squares, monkeypatch):
    cells = materialise(cl.rasterise(squares, 2000.0).select("cx", "cy"), "cells")
    monkeypatch.setattr(session, "TASK_ROWS", 200)
    assert cells.count() == 7500
    assert cl.rasterise(squares, 2000.0).rdd.getNumPartitions() > 16
    valued = cells.selectExpr("cx", "cy", "1L AS value")
    for df in (cl.distinct_cells(cells, 7500), cl.focal_sum(valued), cl.outline(cells),
               cl.shrink(cells, 3000.0, 2000.0)):
        assert "hashpartitioning" in plan_of(df) and df.rdd.getNumPartitions() > 30


def test_rings_double_over_runs_only(spark, squares, monkeypatch):
    cells = materialise(cl.rasterise(squares, 2000.0).select("cx", "cy").selectExpr(
        "cx", "cy", "floor(cx / 100) AS component"), "components")
    counts, checkpoint = [], type(cells).checkpoint
    def counted(df, *args):
        out = checkpoint(df, *args)
        counts.append(out.count())
        return out
    monkeypatch.setattr(type(cells), "checkpoint", counted)
    sides = cl.ring_sides(cells).collect()
    assert len(sides) == 3 * 200 and max(counts) == 3 * 4
    by_ring = {}
    for r in sides:
        by_ring.setdefault(r.ring, {})[r.pos] = r
    for ring in by_ring.values():
        assert sorted(ring) == list(range(200)) and all(r.n == 200 for r in ring.values())
        assert all((ring[i].x1, ring[i].y1) == (ring[(i + 1) % 200].x, ring[(i + 1) % 200].y)
                   for i in ring)


def test_runs_and_corners_are_not_broadcast(spark, squares, monkeypatch):
    cells = materialise(cl.rasterise(squares, 2000.0).select("cx", "cy").selectExpr(
        "cx", "cy", "floor(cx / 100) AS component"), "components")
    rounds, checkpoint = [], type(cells).checkpoint
    monkeypatch.setattr(type(cells), "checkpoint", lambda df, *args: (
        rounds.append(plan_of(df)), checkpoint(df, *args))[1])
    sides, vertices = cl.ring_sides(cells), fp.polygons(cells, 2000.0)
    for plan, key in [*((r, "nxt#") for r in rounds), (plan_of(sides), "[id#"),
                      (plan_of(vertices), "name#")]:
        joins = [line for line in plan.splitlines() if "Join" in line and key in line]
        assert all("SortMergeJoin" in line for line in joins)
        assert joins or "nxt#" in key
    assert sum("SortMergeJoin" in r for r in rounds) > 2
    assert sides.count() == 3 * 200 and vertices.count() == 3 * 5


def test_neighbour_steps_deal_little_more_than_the_mask(spark, squares, monkeypatch):
    cells = materialise(cl.rasterise(squares, 2000.0).select("cx", "cy").selectExpr(
        "cx", "cy", "floor(cx / 100) AS component", "1L AS value"), "cells")
    dealt, spread = [], cl._spread
    monkeypatch.setattr(cl, "_spread", lambda df, *by: (
        dealt.append(df.count()), spread(df, *by))[1])
    sums = cl.focal_sum(cells.select("cx", "cy", "value"))
    assert plan_of(sums).count("Exchange") == 1 and sums.count() == 48 * 152
    assert cl.ring_sides(cells).count() == 3 * 200
    assert len(dealt) == 2 and max(dealt) < 1.2 * 7500


def test_sums_labels_and_rings_across_squares(spark):
    draw = random.Random(5)
    mask = {(x, y): draw.randint(-3, 9) for x in range(-80, 20) for y in range(-70, -50)
            if draw.random() < 0.6}
    cells = materialise(spark.createDataFrame(
        [(*at, v) for at, v in mask.items()], "cx long, cy long, value long"), "cells")
    near = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    inner = [(x, y) for x in range(-79, 19) for y in range(-69, -51)]
    want = {(x, y): sum(mask.get((x + dx, y + dy), 0) for dx, dy in near) for x, y in inner
            if any((x + dx, y + dy) in mask for dx, dy in near)}
    assert {(r.cx, r.cy): r.value for r in cl.focal_sum(cells).collect()} == want
    labelled = materialise(cl.components(cells, 16), "components")
    names = {(r.cx, r.cy): r.component for r in labelled.collect()}
    first = {}
    for x, y in sorted(mask, key=lambda c: (c[1], c[0])):
        todo = [(x, y)]
        while todo:
            at = todo.pop()
            if at in mask and at not in first:
                first[at] = y * cl.KEY_SHIFT + x + cl.KEY_SHIFT // 2
                todo += [(at[0] + dx, at[1] + dy) for dx, dy in cl.STEPS]
    assert names == first
    rings = {}
    for r in cl.ring_sides(labelled).collect():
        rings.setdefault(r.ring, {})[r.pos] = r
    sides = sorted((r.component, r.x, r.y, r.x1, r.y1) for ring in rings.values()
                   for r in ring.values())
    assert sides == sorted(map(tuple, cl.outline(labelled, ["component"]).collect()))
    for name, ring in rings.items():
        assert sorted(ring) == list(range(len(ring))) and {r.n for r in ring.values()} == {len(ring)}
        low = min((r.x, r.y, r.x1, r.y1) for r in ring.values())
        assert low[:2] == (ring[0].x, ring[0].y)
        assert name == low[1] * cl.KEY_SHIFT + low[0] + cl.KEY_SHIFT // 2
        for i, r in ring.items():
            after = ring[(i + 1) % len(ring)]
            assert (r.x1, r.y1, r.component) == (after.x, after.y, after.component)
            assert r.turns == ((r.x1 - r.x, r.y1 - r.y) != (after.x1 - after.x, after.y1 - after.y))


def test_shrink_moves_little_more_than_the_mask(spark, monkeypatch):
    """Rows of a mask lie side by side in the exchange, and nothing moves after it."""
    cells = materialise(spark.range(3 * 60 * 60).selectExpr(
        "id div 3600 AS fid", "id div 3600 * 7 + id % 60 AS cx", "id div 60 % 60 - 30 AS cy"), "cells")
    dealt, spread = [], cl._spread
    monkeypatch.setattr(cl, "_spread", lambda df, *by: (
        dealt.append(df.count()), spread(df, *by))[1])
    left = cl.shrink(cells, 5500.0, 500.0, ["fid"])
    assert plan_of(left).count("Exchange") == 1
    assert {tuple(r) for r in left.collect()} == {
        (f, 7 * f + x, y - 30) for f in range(3) for x in range(11, 49) for y in range(11, 49)}
    assert len(dealt) == 1 and dealt[0] < 4 * 3 * 60 * 60


@pytest.mark.parametrize("radius", [300.0, 750.0, 5500.0])
def test_shrink_across_squares(spark, radius):
    """Cells that come twice count once; a NULL key is a key."""
    draw, n = random.Random(9), int(radius // 500) + 1
    mask = {(fid, x, y) for fid in (None, 1) for x in range(-150, -100) for y in range(-90, -40)
            if (x, y) != (-128, -64) and (draw.random() < 0.9995 or radius < 5500)}
    cells = spark.createDataFrame([*mask, *sorted(mask, key=str)[:700]], "fid long, cx long, cy long")
    gap = lambda d: max(abs(d) - 0.5, 0) * 500
    disc = [(i, j) for i in range(-n, n + 1) for j in range(-n, n + 1)
            if gap(i) ** 2 + gap(j) ** 2 < radius ** 2]
    want = {c for c in mask if all((c[0], c[1] + i, c[2] + j) in mask for i, j in disc)}
    got = [tuple(r) for r in cl.shrink(cells, radius, 500.0, ["fid"]).collect()]
    assert want and len(got) == len(want) and set(got) == want


def test_slim_samples_move_packed_by_transect(spark, monkeypatch):
    """Every sample goes to its range once, in one row for its transect; none is lost."""
    rows = [(None if s == 2 else f"S{s}", None if t == 5 else t, p, y, None if p else t / 7.0)
            for s in range(3) for t in range(8) for p in (1, 0, -1) for y in (2020, 2001, None)]
    schema = "site_id string, transect_id long, pnt_pst int, year int, grad double"
    raw = spark.createDataFrame(rows * 2, schema).withColumn("geom", F.lit("POINT"))
    laid_out = raw.repartition(4, "site_id", "transect_id")
    plan = plan_of(tb.slim_samples(laid_out, 3))
    assert plan.count("Exchange") == 2      # the layout and the ranges
    moved = plan[plan.index("rangepartitioning"):plan.index("hashpartitioning")]
    assert "collect_list" in moved
    monkeypatch.setattr(tb, "PACKED_BITS", 2)
    for frame in (raw, laid_out):
        slim = tb.slim_samples(frame, 3)
        assert slim.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
        got = [tuple(r) for r in slim.collect()]
        assert sorted(got, key=str) == sorted(rows * 2, key=str)
        # Spark sorts NULL first.
        order = [tuple((v is not None, v) for v in (r[0], r[1], r[3], r[2])) for r in got]
        assert order == sorted(order)
