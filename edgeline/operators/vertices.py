"""Vertex tables: snapping, reprojection, segments and lengths.

A vertex table holds (fid, ring, vtx, x, y); ``vtx`` counts through all rings
of a feature without gaps, and every ring is closed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeline.functions import geometry as geo
from edgeline.operators.ranking import number_rows

VERTEX_BLOCK = 65_536


def segments(vertices: DataFrame, ring_mode: str = "per_ring",
             carry: Sequence[str] = ()) -> DataFrame:
    """Consecutive vertices as segments (fid, seg, ring, x0, y0, x1, y1).

    Each vertex is sent to the segment it starts and the one it ends, so one
    grouping on (fid, seg) replaces a window over the whole feature. ``concat``
    keeps the jumps between rings, ``per_ring`` leaves them out.
    """
    role = F.explode(F.array(F.lit(0), F.lit(1)))
    ends = (vertices.select("fid", "ring", "vtx", "x", "y", *carry, role.alias("role"))
            .withColumn("seg", F.col("vtx") - F.col("role")))
    pick = lambda c, r: F.max(F.when(F.col("role") == r, F.col(c)))
    out = ends.groupBy("fid", "seg").agg(
        pick("ring", 0).alias("ring"), pick("ring", 1).alias("ring_end"),
        pick("x", 0).alias("x0"), pick("y", 0).alias("y0"),
        pick("x", 1).alias("x1"), pick("y", 1).alias("y1"),
        *[F.max(c).alias(c) for c in carry])
    out = out.filter(F.col("ring").isNotNull() & F.col("ring_end").isNotNull())
    if ring_mode == "per_ring":
        out = out.filter(F.col("ring") == F.col("ring_end"))
    elif ring_mode != "concat":
        raise ValueError(f"unknown ring mode {ring_mode!r}")
    return out.drop("ring_end")


def snap(vertices: DataFrame, precision: float = 1e5, grid: float | None = None) -> DataFrame:
    """Round coordinates, drop repeated vertices, and renumber.

    ``precision`` is the number of steps per unit; ``grid`` snaps to a coarser
    step first. A vertex is repeated when it equals its predecessor.
    """
    def rounded(c: str):
        v = F.col(c)
        if grid is not None:
            v = F.round(v / grid) * grid
        return F.round(v * precision) / precision

    role = F.explode(F.array(F.lit(0), F.lit(1)))
    # Role 1 hands a vertex to its successor as the previous position.
    sent = (vertices.withColumns({"x": rounded("x"), "y": rounded("y")})
            .select("fid", "ring", "x", "y", role.alias("role"), "vtx")
            .withColumn("vtx", F.col("vtx") + F.col("role")))
    pick = lambda c, r: F.max(F.when(F.col("role") == r, F.col(c)))
    pairs = sent.groupBy("fid", "ring", "vtx").agg(
        pick("x", 0).alias("x"), pick("y", 0).alias("y"),
        pick("x", 1).alias("px"), pick("y", 1).alias("py"))
    same = F.coalesce((F.col("x") == F.col("px")) & (F.col("y") == F.col("py")), F.lit(False))
    kept = pairs.filter(F.col("x").isNotNull() & ~same).drop("px", "py")
    numbered = number_rows(kept, ["fid"], [[F.floor(F.col("vtx") / VERTEX_BLOCK)]],
                           [F.col("vtx")], "row")
    return numbered.select("fid", "ring", (F.col("row") - 1).alias("vtx"), "x", "y")


def reproject(vertices: DataFrame, source: str, target: str) -> DataFrame:
    """Move x and y between ``lonlat``, ``cylinder`` and ``mollweide``."""
    x, y = F.col("x"), F.col("y")
    if source == "cylinder":
        x, y = geo.cylinder_to_lonlat(x, y)
    elif source == "mollweide":
        x, y = geo.mollweide_to_lonlat(x, y)
    elif source != "lonlat":
        raise ValueError(f"unknown projection {source!r}")
    out = vertices.withColumns({"x": x, "y": y})
    x, y = F.col("x"), F.col("y")
    if target == "cylinder":
        return out.withColumns(dict(zip("xy", geo.lonlat_to_cylinder(x, y))))
    if target == "mollweide":
        return out.withColumns(dict(zip("xy", geo.lonlat_to_mollweide(x, y))))
    if target != "lonlat":
        raise ValueError(f"unknown projection {target!r}")
    return out


def perimeters(vertices: DataFrame, geodesic: bool = True) -> DataFrame:
    """Perimeter per feature over all rings, in metres."""
    ends = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    length = geo.great_circle(*ends) if geodesic else geo.planar_length(*ends)
    return segments(vertices).groupBy("fid").agg(F.sum(length).alias("perimeter"))
