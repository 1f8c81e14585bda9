"""Snapping of vertices that lie within a tolerance of each other, also across features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeline.operators.cells import star_contract
from edgeline.operators.ranking import rank_rows

#: Grid cells this far apart can hold vertices within the tolerance; one of each pair of offsets.
_OFFSETS = [(dx, dy) for dx in range(-2, 3) for dy in range(-2, 3) if (dx, dy) > (0, 0)]


def snap_neighbours(vertices: DataFrame, tolerance: float) -> DataFrame:
    """Vertices moved onto one representative of all those they chain to.

    Two vertices within ``tolerance`` are linked, whatever their features; a chain of links
    meets in its first vertex by (x, y). Different positions are looked at once, however
    many features share them. The grid's cells are as wide as the tolerance over the root
    of two, so the positions of one cell are all linked, to its first; only neighbouring
    cells compare positions, and one link between two cells is enough. Run ``snap``
    afterwards to drop vertices that fell on their predecessor. Rings stay closed.
    """
    if not tolerance > 0:
        raise ValueError("the tolerance must be above 0")
    size = tolerance / math.sqrt(2)
    places = rank_rows(vertices.select("x", "y").distinct(), [F.col("x"), F.col("y")], "id")
    placed = places.select("id", "x", "y", F.floor(F.col("x") / size).alias("c"),
                           F.floor(F.col("y") / size).alias("d"))
    firsts = placed.groupBy("c", "d").agg(F.min("id").alias("b"))
    inside = placed.join(firsts, ["c", "d"]).select(F.col("id").alias("a"), "b")
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _OFFSETS])
    reach = placed.select(F.col("id").alias("a"), F.col("x").alias("ax"), F.col("y").alias("ay"),
                          F.col("c").alias("ac"), F.col("d").alias("ad"), F.inline(offsets))
    near = reach.join(placed.withColumnsRenamed({"id": "b", "x": "bx", "y": "by"}),
                      (F.col("c") == F.col("ac") + F.col("dx"))
                      & (F.col("d") == F.col("ad") + F.col("dy")))
    gx, gy = F.col("ax") - F.col("bx"), F.col("ay") - F.col("by")
    across = (near.filter(gx * gx + gy * gy <= tolerance * tolerance)
              .groupBy("ac", "ad", "dx", "dy").agg(F.min(F.struct("a", "b")).alias("link"))
              .select("link.a", "link.b"))
    roots = star_contract(inside.unionByName(across))
    at = placed.select(F.col("id").alias("root"), F.col("x").alias("to_x"), F.col("y").alias("to_y"))
    moved = (placed.select("id", "x", "y").join(roots, F.col("id") == F.col("node"))
             .join(at, "root").select("x", "y", "to_x", "to_y"))
    return (vertices.join(moved, ["x", "y"], "left")
            .withColumns({"x": F.coalesce("to_x", "x"), "y": F.coalesce("to_y", "y")})
            .select(*vertices.columns))
