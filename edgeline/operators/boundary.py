"""Sample points along borders, perpendicular transects, and their validity.

Spatial joins are equi-joins on grid cells. Border segments are cut into pieces
no longer than a cell before they are spread over cells, so one long segment
cannot flood a task, and the pairs that meet are only those in one cell.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.functions import geometry as geo
from edgeline.operators import cells as cl
from edgeline.operators import leaves
from edgeline.operators.ranking import number_rows, running_totals
from edgeline.operators.vertices import segments
from edgeline.session import materialise

SEGMENT_BLOCK = 65_536
POINT_BLOCK = 4096
ID_BLOCK = 65_536
TOUCH = 1e-9


def _whole_range(lo: Column, hi: Column, block: int) -> Column:
    """Blocks of whole numbers covering lo..hi, so no array grows with the range."""
    return F.sequence(F.floor(lo / block), F.floor(hi / block))


def spaced_points(vertices: DataFrame, spacing: float, ring_mode: str = "concat") -> DataFrame:
    """Equally spaced points along each feature's line.

    Output: (fid, transect_id, x, y, theta); theta is the direction back along
    the segment. The last point is dropped because the line closes; a line
    shorter than the spacing still has its first point. Each segment explodes
    the multiples of the spacing that fall on it. Lengths along the line are
    rounded to a micrometre so that block-wise and sequential sums agree.
    """
    seg = segments(vertices, ring_mode)
    seg = seg.withColumn("len", geo.planar_length(*[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
    run = running_totals(seg, ["fid"], F.floor(F.col("seg") / SEGMENT_BLOCK), F.col("seg"),
                         F.col("len"), "upto")
    c0, c1 = F.round(F.col("upto") - F.col("len"), 6), F.round(F.col("upto"), 6)
    n = F.greatest(F.lit(1.0), F.floor(F.round(F.col("upto_total"), 6) / spacing + 1e-10)
                   .cast("double"))
    run = run.withColumns({"c0": c0, "c1": c1}).withColumns({
        "k0": F.ceil(F.col("c0") / spacing),
        "k1": F.least(F.ceil(F.col("c1") / spacing) - 1, n.cast("long") - 1)})
    blocks = (run.filter("k0 <= k1 AND c0 < c1")
              .withColumn("kb", F.explode(_whole_range(F.col("k0"), F.col("k1"), POINT_BLOCK))))
    first = F.greatest("k0", F.col("kb") * POINT_BLOCK)
    last = F.least("k1", F.col("kb") * POINT_BLOCK + POINT_BLOCK - 1)
    rows = blocks.withColumn("k", F.explode(F.sequence(first, last)))
    f = (F.col("k") * spacing - F.col("c0")) / (F.col("c1") - F.col("c0"))
    return rows.select(
        "fid", (F.col("k") + 1).alias("transect_id"),
        (F.col("x0") + f * (F.col("x1") - F.col("x0"))).alias("x"),
        (F.col("y0") + f * (F.col("y1") - F.col("y0"))).alias("y"),
        F.atan2(F.col("y0") - F.col("y1"), F.col("x0") - F.col("x1")).alias("theta"))


def transects(points: DataFrame, unit: float | Column, n_side: int | Column) -> DataFrame:
    """Points perpendicular to the line, ``n_side`` on each side of the border point.

    Negative positions lie to the right of travel, which is inside a clockwise
    shell.
    """
    n = n_side if isinstance(n_side, Column) else F.lit(n_side)
    u = unit if isinstance(unit, Column) else F.lit(float(unit))
    across = F.col("theta") + F.pi() / 2
    rows = points.select("*", F.explode(F.sequence(-n, n)).alias("pnt_pst"))
    kept = [c for c in points.columns if c not in ("x", "y", "theta")]
    return rows.select(*kept, "pnt_pst",
                       (F.col("x") - F.col("pnt_pst") * u * F.cos(across)).alias("x"),
                       (F.col("y") - F.col("pnt_pst") * u * F.sin(across)).alias("y"))


def transects_by_length(points: DataFrame, lengths: Sequence[tuple[int, int, float]]) -> DataFrame:
    """All transect lengths in one pass; ``length_km`` tells them apart."""
    sets = F.array(*[F.struct(F.lit(n).alias("n_side"), F.lit(float(u)).alias("unit"),
                              F.lit(int(u * n * 2 / 1000)).alias("length_km"))
                     for _, n, u in lengths])
    rows = points.select("*", F.inline(sets))
    return transects(rows, F.col("unit"), F.col("n_side")).drop("unit", "n_side")


# ---- spatial joins ---------------------------------------------------------
def border_pieces(seg: DataFrame, grid: float, pad: float) -> DataFrame:
    """Border pieces no longer than a grid cell, one row per cell within ``pad``."""
    length = geo.planar_length(*[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    m = F.greatest(F.lit(1), F.ceil(length / grid))
    cut = (seg.withColumn("m", m)
           .withColumn("ib", F.explode(_whole_range(F.lit(0), F.col("m") - 1, POINT_BLOCK)))
           .withColumn("i", F.explode(F.sequence(
               F.col("ib") * POINT_BLOCK,
               F.least(F.col("m") - 1, F.col("ib") * POINT_BLOCK + POINT_BLOCK - 1)))))
    at = lambda a, b, i: F.col(a) + (F.col(b) - F.col(a)) * i / F.col("m")
    pieces = cut.select(
        "fid", at("x0", "x1", F.col("i")).alias("ax"), at("y0", "y1", F.col("i")).alias("ay"),
        at("x0", "x1", F.col("i") + 1).alias("bx"), at("y0", "y1", F.col("i") + 1).alias("by"))
    reach = lambda a, b: F.explode(F.sequence(
        F.floor((F.least(a, b) - pad) / grid), F.floor((F.greatest(a, b) + pad) / grid)))
    return (pieces.withColumn("cx", reach("ax", "bx")).withColumn("cy", reach("ay", "by")))


def near_or_inside(points: DataFrame, key: Sequence[str], vertices: DataFrame, dist: float,
                   grid: float, own: bool = False, pid: str = "pid",
                   leaf_pairs: int | None = None) -> DataFrame:
    """Points against polygons: (key, pid, dist, inside) for every polygon that
    contains the point or has its border within ``dist`` of it.

    Inside is decided in the point's cell: the parity of the cell centre, known
    from the mask, flips with every border piece between point and centre. With
    ``own`` a point meets only the polygon of its own ``fid``. With ``leaf_pairs``
    cells in which more pairs of a point and a piece would meet are split in quarters,
    again and again (``leaves.split``), so that no group of the join is larger.
    """
    key = list(key)
    seg = segments(vertices, "per_ring")
    # What a cell knows of a polygon: its border pieces, and a row without
    # coordinates when the cell's centre is inside.
    content = border_pieces(seg, grid, dist).unionByName(
        cl.fill(seg, grid), allowMissingColumns=True).withColumnRenamed("fid", pid)
    pts = points.select(*key, F.col("x").alias("px"), F.col("y").alias("py"),
                        geo.cell_of(F.col("x"), grid).alias("cx"),
                        geo.cell_of(F.col("y"), grid).alias("cy"),
                        *([F.col("fid").alias("own")] if own else []))
    cell, size = ["cx", "cy"], F.lit(grid)
    if leaf_pairs is not None:
        pts, content = leaves.split(pts, content, pid, grid, dist, leaf_pairs)
        cell, size = ["level", *cell], grid / F.pow(F.lit(2.0), F.col("level"))
    # Few polygon rows unfold into many cells, which Spark's size estimate does not see:
    # without the hint the whole content is taken for small and sent through the driver.
    if own:
        met = pts.join(content.withColumn("own", F.col(pid)).hint("merge"), ["own", *cell])
    else:
        met = pts.join(content.hint("merge"), cell)
    px, py = F.col("px"), F.col("py")
    ends = [F.col(c) for c in ("ax", "ay", "bx", "by")]
    centre = [(F.col(c) + 0.5) * size for c in ("cx", "cy")]
    is_centre = F.col("ax").isNull()
    flip = F.when(is_centre, 1).otherwise(
        geo.crosses_to_centre(px, py, *centre, *ends).cast("int"))
    gap = F.when(~is_centre, geo.segment_distance(px, py, *ends))
    found = met.groupBy(*key, pid).agg((F.sum(flip) % 2).alias("odd"), F.min(gap).alias("dist"))
    on_border = F.coalesce(F.col("dist") <= TOUCH, F.lit(False))
    out = found.select(*key, pid, "dist", ((F.col("odd") == 1) | on_border).alias("inside"))
    return out.filter(F.col("inside") | (F.col("dist") <= dist))


def within_distance(points: DataFrame, key: Sequence[str], polygons: DataFrame,
                    dist: float = 750.0, grid: float = 2000.0,
                    leaf_pairs: int | None = None) -> DataFrame:
    """Left join of points to the sites within ``dist``: (key, site_id or NULL).

    ``polygons`` is a vertex table with ``site_id``; a site may hold several
    features, and a point matches it once.
    """
    key = list(key)
    hits = near_or_inside(points, key, polygons, dist, grid, leaf_pairs=leaf_pairs)
    names = polygons.select(F.col("fid").alias("pid"), "site_id").distinct()
    sites = hits.join(names, "pid").select(*key, "site_id").distinct()
    return points.select(*key).join(sites, key, "left")


# ---- evaluation ------------------------------------------------------------
def inner_validity(points: DataFrame, footprints: DataFrame, buffer_dist: float,
                   size: float = cl.CELL, grid: float | None = None) -> DataFrame:
    """Validity of the inner points of each footprint's transects.

    ``inner_valid``: the point does not lie deeper than ``buffer_dist`` inside,
    and the footprint is deep enough to have such a place at all.
    ``boundary_valid``: the point lies in its own footprint.
    """
    key = ["fid", "transect_id", "pnt_pst"]
    inner = points.filter(F.col("pnt_pst") < 0)
    hits = near_or_inside(inner, key, footprints, buffer_dist, grid or buffer_dist, own=True)
    hits = hits.select(*key, "inside", "dist")
    mask = materialise(cl.rasterise(footprints.select("fid", "ring", "vtx", "x", "y"), size),
                       "footprint-mask")
    deep = (cl.shrink(mask, buffer_dist, size, ["fid"]).select("fid").distinct()
            .withColumn("has_core", F.lit(True)))
    joined = inner.select(*key).join(hits, key, "left").join(deep, "fid", "left")
    inside = F.coalesce("inside", F.lit(False))
    far = F.col("dist").isNull() | (F.col("dist") >= buffer_dist)
    core = F.coalesce("has_core", F.lit(False))
    return joined.select(*key, (core & ~(inside & far)).alias("inner_valid"),
                         (core & inside).alias("boundary_valid"))


def drop_bad_transects(points: DataFrame, validity: DataFrame) -> DataFrame:
    """Remove every transect with any invalid inner point."""
    bad = (validity.filter(~(F.col("inner_valid") & F.col("boundary_valid")))
           .select("fid", "transect_id").distinct())
    return points.join(bad, ["fid", "transect_id"], "left_anti")


def unique_matches(matches: DataFrame, key: Sequence[str]) -> DataFrame:
    """Points that matched exactly one site; ambiguous and unmatched ones drop out."""
    key = list(key)
    one = matches.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("site_id").alias("site_id"))
    return one.filter("n = 1 AND site_id IS NOT NULL").drop("n")


def ambiguous_removed(matches: DataFrame, key: Sequence[str]) -> DataFrame:
    """Drop all rows of points that matched more than one site."""
    one = matches.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max("site_id").alias("site_id"))
    return one.filter("n = 1").drop("n")


def unmatched_removed(matches: DataFrame) -> DataFrame:
    return matches.filter(F.col("site_id").isNotNull())


def renumber(matches: DataFrame) -> DataFrame:
    """Transect numbers 1.. inside each site, in order of footprint and transect."""
    return number_rows(matches, ["site_id"],
                       [[F.col("fid")], [F.floor(F.col("transect_id") / ID_BLOCK)]],
                       [F.col("fid"), F.col("transect_id")], "site_transect")


def annotate(points: DataFrame, kept: DataFrame, info: DataFrame) -> DataFrame:
    """All points of the kept border points, with site attributes."""
    return points.join(kept, ["fid", "transect_id"]).join(info, "site_id")
