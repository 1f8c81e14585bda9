"""Exact area of each grid cell that a polygon covers, and overlaps by area.

A border piece inside one cell sweeps a trapezoid to the cell's right edge, signed by the
piece's direction; every cell further right in its row gets the piece's height times the
cell width. Summed over the pieces of a clockwise shell and its counter-clockwise holes
that is the covered area, exact up to rounding.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from edgeline.operators.cells import CELL
from edgeline.operators.vertices import segments


def cell_pieces(vertices: DataFrame, size: float = CELL) -> DataFrame:
    """Border segments cut at all grid lines: (fid, cx, cy, xa, ya, xb, yb)."""
    seg = segments(vertices, "per_ring").filter("y0 <> y1")

    def cuts(a: str, b: str):
        low, high = F.least(a, b), F.greatest(a, b)
        first, last = F.floor(low / size) + 1, F.ceil(high / size) - 1
        lines = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<long>"))
        return F.transform(lines, lambda k: (k * size - F.col(a)) / (F.col(b) - F.col(a)))

    ends = F.array(F.lit(0.0), F.lit(1.0))
    at = F.array_sort(F.array_distinct(F.concat(ends, cuts("x0", "x1"), cuts("y0", "y1"))))
    cut = seg.select("fid", "x0", "y0", "x1", "y1", at.alias("t"))
    cut = cut.select("*", F.posexplode(F.slice("t", 1, F.size("t") - 1)).alias("i", "ta"))
    cut = cut.withColumn("tb", F.get("t", F.col("i") + 1))
    along = lambda a, b, t: F.col(a) + F.col(t) * (F.col(b) - F.col(a))
    out = cut.select("fid", along("x0", "x1", "ta").alias("xa"), along("y0", "y1", "ta").alias("ya"),
                     along("x0", "x1", "tb").alias("xb"), along("y0", "y1", "tb").alias("yb"))
    middle = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2 / size)
    return out.select("fid", middle("xa", "xb").alias("cx"), middle("ya", "yb").alias("cy"),
                      "xa", "ya", "xb", "yb")


def coverage(vertices: DataFrame, size: float = CELL) -> DataFrame:
    """(fid, cx, cy, area): square metres of every cell that a feature covers.

    Shells run clockwise. Cells with a border piece get their trapezoids and the heights
    to their left; the cells up to the next such cell of the row get the heights alone,
    which is all of a cell inside the feature and a part where a level side crosses the row.
    """
    rise = F.col("yb") - F.col("ya")
    own = rise * ((F.col("cx") + 1) * size - (F.col("xa") + F.col("xb")) / 2)
    cells = cell_pieces(vertices, size).groupBy("fid", "cx", "cy").agg(
        F.sum(own).alias("own"), F.sum(rise).alias("rise"))
    # A window sees the border cells of one row of one feature.
    row = Window.partitionBy("fid", "cy").orderBy("cx")
    cells = cells.withColumns({
        "left": F.coalesce(F.sum("rise").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "next": F.lead("cx").over(row)})
    border = F.struct(F.col("cx").alias("cx"), (F.col("own") + F.col("left") * size).alias("area"))
    height = F.col("left") + F.col("rise")
    between = F.when((height > 1e-9 * size) & (F.col("next") > F.col("cx") + 1), F.transform(
        F.sequence(F.col("cx") + 1, F.col("next") - 1),
        lambda c: F.struct(c.alias("cx"), (height * size).alias("area"))))
    rows = cells.select("fid", "cy", F.inline(F.concat(F.array(border), F.coalesce(
        between, F.array().cast("array<struct<cx:bigint,area:double>>")))))
    return rows.filter(F.col("area") > 1e-9 * size * size).select("fid", "cx", "cy", "area")


def largest_overlap(areas: DataFrame, zones: DataFrame, key: str = "fid", label: str = "label"
                    ) -> DataFrame:
    """Label of the zone that covers most of each feature: (key, label, overlap, total).

    ``areas`` are covered cells, ``zones`` one row per cell and label. Overlaps are compared
    in whole square millimetres; ties go to the smaller label. A feature in no zone keeps a
    NULL label.
    """
    parts = (areas.join(zones, ["cx", "cy"]).groupBy(key, label).agg(F.sum("area").alias("overlap")))
    best = parts.groupBy(key).agg(
        F.min_by(F.struct(label, "overlap"), F.struct(-F.round(F.col("overlap") * 1e6), F.col(label)))
        .alias("b")).select(key, f"b.{label}", "b.overlap")
    totals = areas.groupBy(key).agg(F.sum("area").alias("total"))
    return totals.join(best, key, "left").select(key, label, "overlap", "total")
