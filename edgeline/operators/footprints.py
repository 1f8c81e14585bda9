"""Footprints: masks back to polygons, and how deep a cell lies inside its own.

A footprint is a 4-neighbour component of mask cells. Its outline becomes a vertex
table in metres, which every vertex operator reads; its cells get their distance to
the footprint's background, so that any inner buffer is a filter on one column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeline.operators.cells import CELL, ring_runs
from edgeline.operators.ranking import id_levels, number_rows
from edgeline.session import materialise, parts_for

VERTEX_BLOCK = 65_536
#: Cell rows of a footprint that one task holds for the row pass.
ROW_BLOCK = 64


# ---- polygons --------------------------------------------------------------
def rings(sides: DataFrame) -> DataFrame:
    """One row per ring (component, name, area2, hole, ring) of outline sides or straight runs.

    Sides run with the mask on their right, so the signed area (twice, in cells) is
    negative for a shell and positive for a hole. A component has one shell: diagonal
    neighbours are apart, and what touches inside at a corner is one hole. The shell is
    ring 0, holes follow by name.
    """
    each = sides.groupBy("component", F.col("ring").alias("name")).agg(
        F.sum(F.col("x") * F.col("y1") - F.col("x1") * F.col("y")).alias("area2"))
    each = each.withColumn("hole", F.col("area2") > 0)
    numbered = number_rows(each, ["component"], [[F.col("hole")], *id_levels(F.col("name"))],
                           [F.col("name")], "ring")
    return numbered.withColumn("ring", (F.col("ring") - 1).cast("int"))


def polygons(cells: DataFrame, size: float = CELL) -> DataFrame:
    """Vertex table (fid, ring, vtx, x, y) in metres of a mask with components.

    Sides that go on in one direction merge: only the end of a straight run is a vertex. Every ring starts at its lowest corner by x, then y, and is
    closed by it; ``vtx`` counts through all rings of a footprint, shell first.
    """
    runs = materialise(ring_runs(cells), "ring-runs")
    corners = runs.select(
        "component", F.col("ring").alias("name"), F.col("x1").alias("x"), F.col("y1").alias("y"),
        F.pmod(F.col("pos") + F.col("len"), F.col("n")).alias("at"), "n")
    at = F.when(F.col("at") == 0, F.array("at", "n")).otherwise(F.array("at"))
    corners = corners.select("component", "name", "x", "y", F.explode(at).alias("at"))
    # As in ``ring_runs``: the size of the files would have all corners broadcast.
    placed = corners.join(rings(runs).select("component", "name", "ring").hint("merge"),
                          ["component", "name"])
    numbered = number_rows(placed, ["component"],
                           [[F.col("ring")], [F.floor(F.col("at") / VERTEX_BLOCK)]],
                           [F.col("at")], "row")
    return numbered.select(F.col("component").alias("fid"), "ring", (F.col("row") - 1).alias("vtx"),
                           (F.col("x") * size).alias("x"), (F.col("y") * size).alias("y"))


# ---- depth -----------------------------------------------------------------
def _columns_first(cells: DataFrame) -> DataFrame:
    """Rows from each mask cell to the nearest background row of its own column.

    Within a column the cells of one unbroken run share ``cy`` minus their number; a
    window sees one column of one footprint, which the raster's height bounds.
    """
    column = Window.partitionBy("component", "cx")
    number = F.row_number().over(column.orderBy("cy"))
    runs = cells.select("component", "cx", "cy").withColumn("run", F.col("cy") - number)
    run = Window.partitionBy("component", "cx", "run")
    return runs.withColumn("up", F.least(
        F.col("cy") - F.min("cy").over(run), F.max("cy").over(run) - F.col("cy")) + 1)


def lower_envelope(sites: np.ndarray, heights: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least ``(x - s)^2 + h`` over the sites s with heights h, for ascending x in ``at``.

    The parabolas that are lowest somewhere are kept on a stack from left to right with
    the place where each takes over from the one before it.
    """
    kept: list[int] = []
    takes: list[float] = []
    for i in range(len(sites)):
        while kept:
            j = kept[-1]
            meet = ((heights[i] + sites[i] ** 2 - heights[j] - sites[j] ** 2)
                    / (2 * (sites[i] - sites[j])))
            if meet > takes[-1]:
                break
            kept.pop()
            takes.pop()
        takes.append(meet if kept else -np.inf)
        kept.append(i)
    which = np.array(kept)[np.searchsorted(np.array(takes), at, side="right") - 1]
    return (at - sites[which]) ** 2 + heights[which]


def _row_depth(cx: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Depths along one row of a footprint, its columns ascending.

    A background cell n columns away begins n - 1/2 from a cell's centre, on either
    side; one in the cell's own column has only its rows to count. So cells to the
    left are parabolas half a column further right, and the other way round.
    """
    x = cx.astype(np.float64)
    own = (up - 0.5) ** 2
    breaks = np.flatnonzero(np.diff(cx) > 1)
    # Background ends of every unbroken stretch count with height 0.
    rim = np.concatenate([[x[0] - 1], x[breaks] + 1, x[breaks + 1] - 1, [x[-1] + 1]])
    sites, first = np.unique(np.concatenate([rim, x]), return_index=True)
    heights = np.concatenate([np.zeros(len(rim)), own])[first]
    left = lower_envelope(sites + 0.5, heights, x)
    right = lower_envelope(sites - 0.5, heights, x)
    return np.sqrt(np.minimum(own, np.minimum(left, right)))


def depths(cells: DataFrame, size: float = CELL) -> DataFrame:
    """(component, cx, cy, depth): metres from a cell's centre to its footprint's background.

    Exact Euclidean distance to the nearest point of a background cell, in two passes:
    along columns with windows, then along rows by lower envelopes. A task gets
    ``ROW_BLOCK`` rows of one footprint.
    """
    parts = parts_for(cells.sparkSession, 2 * cells.count())
    up = _columns_first(cells.repartition(parts, "component", "cx"))

    def block(group: pa.Table) -> pa.Table:
        cx, cy, far = (group.column(c).to_numpy() for c in ("cx", "cy", "up"))
        order = np.lexsort((cx, cy))
        cx, cy, far = cx[order], cy[order], far[order].astype(np.float64)
        cuts = np.flatnonzero(np.diff(cy)) + 1
        depth = [_row_depth(a, b) for a, b in zip(np.split(cx, cuts), np.split(far, cuts))]
        return pa.table({"component": group.column("component"), "cx": cx, "cy": cy,
                         "depth": np.concatenate(depth) * size})

    # The block's own column is not handed to the function's result.
    rows = up.select("component", "cx", "cy", "up",
                     F.floor(F.col("cy") / ROW_BLOCK).alias("block"))
    return (rows.repartition(parts, "component", "block").groupBy("component", "block")
            .applyInArrow(block, "component long, cx long, cy long, depth double"))


def shrink(cells: DataFrame, radius: float, size: float = CELL) -> DataFrame:
    """Cells of every footprint no nearer than ``radius`` to its background.

    Other footprints are background too, so touching ones shrink apart.
    """
    return depths(cells, size).filter(F.col("depth") >= radius).select("component", "cx", "cy")


def survival(cells: DataFrame, radius: float, size: float = CELL) -> DataFrame:
    """Per footprint: n_cells, n_left after shrinking, its greatest depth, and whether it
    is left ``empty`` and so dropped."""
    inside = F.col("depth") >= radius
    return (depths(cells, size).groupBy("component")
            .agg(F.count(F.lit(1)).alias("n_cells"), F.count_if(inside).alias("n_left"),
                 F.max("depth").alias("deepest"))
            .withColumn("empty", F.col("n_left") == 0))
