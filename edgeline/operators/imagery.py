"""Yearly composites, spectral gradients and raster sampling on cell tables.

Scenes are rows (sensor, date, cx, cy, bands). All years and sensors go through
one plan; nothing loops over years.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeline.functions.geometry import cell_of

N_BANDS = 7
TILE = 128


def land_points(points: DataFrame, water: DataFrame, key: Sequence[str], res: float = 30.0) -> DataFrame:
    """Points whose water pixel has never been water; no pixel means dropped.

    The pixel table is folded to one row per pixel before the join.
    """
    dry = (water.groupBy("px", "py").agg(F.max("max_extent").alias("max_extent"))
           .filter("max_extent = 0").select("px", "py"))
    at = points.withColumns({"px": cell_of(F.col("x"), res), "py": cell_of(F.col("y"), res)})
    return at.join(dry, ["px", "py"], "left_semi").drop("px", "py")


def select_scenes(scenes: DataFrame, first_year: int, last_year: int,
                  n_bands: int = N_BANDS) -> DataFrame:
    """Scenes of whole calendar years with the leading bands.

    The range is stated on the date itself so that it reaches the scan.
    """
    lo, hi = F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(
        F.lit(last_year + 1), F.lit(1), F.lit(1))
    return (scenes.filter((F.col("date") >= lo) & (F.col("date") < hi))
            .withColumn("year", F.year("date"))
            .withColumn("bands", F.slice("bands", 1, n_bands)))


def yearly_median(scenes: DataFrame, n_bands: int = N_BANDS) -> DataFrame:
    """Per-band median of each cell's scenes in a year: (sensor, year, cx, cy, bands).

    A cell has at most a few hundred scenes a year, so one grouped median serves every
    cell-year. One whose bands are all NULL keeps a row of NULL bands.
    """
    return scenes.groupBy("sensor", "year", "cx", "cy").agg(
        F.array(*[F.median(F.col("bands")[i]) for i in range(n_bands)]).alias("bands"))


def _tile_gradient(pdf: pd.DataFrame, radius: int, core: tuple[int, int, int]) -> pd.DataFrame:
    """Spectral gradient of one tile with its halo of neighbours.

    The neighbourhood member with the largest summed angle to all others is the
    dilation, the one with the smallest the erosion; the gradient is the angle
    between the two. Ties go to the cell first in (cy, cx).
    """
    tx, ty, tile = core
    spectra = np.stack(pdf["bands"].to_numpy()).astype(float)
    norm = np.sqrt((spectra * spectra).sum(axis=1))
    known = np.isfinite(norm) & (norm > 0)
    cx, cy = pdf["cx"].to_numpy(), pdf["cy"].to_numpy()
    own = known & (cx // tile == tx) & (cy // tile == ty)
    if not own.any():
        return pd.DataFrame({"cx": [], "cy": [], "gradient": []})
    # Arrays cover the tile's occupied part and its halo.
    left, bottom = cx[own].min(), cy[own].min()
    w, h = int(cx[own].max() - left) + 1, int(cy[own].max() - bottom) + 1
    col, row = cx - left + radius, cy - bottom + radius
    height, width = h + 2 * radius, w + 2 * radius
    known &= (col >= 0) & (col < width) & (row >= 0) & (row < height)
    unit = np.zeros((height, width, spectra.shape[1]))
    there = np.zeros((height, width), dtype=bool)
    unit[row[known], col[known]] = spectra[known] / norm[known, None]
    there[row[known], col[known]] = True

    def angle(a, b):
        dot = np.zeros(a.shape[:2])
        for k in range(a.shape[2]):
            dot += a[..., k] * b[..., k]
        return np.arccos(np.clip(dot, -1, 1))

    reach = range(-radius, radius + 1)
    offsets = [(dy, dx) for dy in reach for dx in reach]
    place = {o: i for i, o in enumerate(offsets)}

    def window(grid, o):
        return grid[radius + o[0]:radius + o[0] + h, radius + o[1]:radius + o[1] + w]

    # The angle between two cells depends on the pair only, so one map per
    # displacement serves all windows that contain such a pair.
    total = np.zeros((len(offsets), h, w))
    for dy in range(2 * radius + 1):
        for dx in range(-2 * radius, 2 * radius + 1):
            if dy == 0 and dx <= 0 or dy >= height or abs(dx) >= width:
                continue
            rows_a, rows_b = slice(0, height - dy), slice(dy, height)
            cols_a = slice(max(0, -dx), width - max(0, dx))
            cols_b = slice(max(0, dx), width + min(0, dx))
            gap = np.zeros((height, width))
            gap[rows_a, cols_a] = np.where(there[rows_a, cols_a] & there[rows_b, cols_b],
                                           angle(unit[rows_a, cols_a], unit[rows_b, cols_b]), 0.0)
            for o in offsets:
                other = place.get((o[0] + dy, o[1] + dx))
                if other is not None:
                    part = window(gap, o)
                    total[place[o]] += part
                    total[other] += part
    member = np.stack([window(there, o) for o in offsets])
    total = np.round(total, 9)
    top = np.argmax(np.where(member, total, -np.inf), axis=0)
    low = np.argmin(np.where(member, total, np.inf), axis=0)
    dys, dxs = np.array(offsets).T
    gy, gx = np.mgrid[radius:radius + h, radius:radius + w]
    grad = 100 * angle(unit[gy + dys[top], gx + dxs[top]], unit[gy + dys[low], gx + dxs[low]])
    yy, xx = np.nonzero(window(there, (0, 0)))
    inside = np.isin((yy + bottom) * (1 << 32) + xx + left,
                     cy[own].astype(np.int64) * (1 << 32) + cx[own])
    yy, xx = yy[inside], xx[inside]
    return pd.DataFrame({"cx": xx + left, "cy": yy + bottom, "gradient": grad[yy, xx]})


def spectral_gradient(composite: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Spectral-angle gradient times 100: (sensor, year, cx, cy, gradient).

    Cells are sent to their tile and, near a tile border, to the neighbouring
    tiles as halo. A tile holds one row per cell and year, so its size is fixed;
    the shuffle carries little more than the composite itself instead of a copy
    per neighbour.
    """
    def reach(c: str):
        return F.explode(F.sequence(F.floor((F.col(c) - radius) / tile),
                                    F.floor((F.col(c) + radius) / tile)))

    spread = (composite.withColumn("tx", reach("cx")).withColumn("ty", reach("cy")))
    n = composite.columns

    def run(key, pdf):
        sensor, year, tx, ty = key
        out = _tile_gradient(pdf, radius, (int(tx), int(ty), tile))
        return out.assign(sensor=sensor, year=year)[["sensor", "year", "cx", "cy", "gradient"]]

    return spread.select(*n, "tx", "ty").groupBy("sensor", "year", "tx", "ty").applyInPandas(
        run, "sensor string, year int, cx long, cy long, gradient double")


def sample_years(points: DataFrame, gradient: DataFrame, key: Sequence[str],
                 years: Sequence[int], res: dict[str, float]) -> DataFrame:
    """Gradient at every point per sensor of ``res`` and year, long: (key, sensor, year, grad).

    A point without a pixel gets NULL, also where the gradient table is empty. The
    years of a pixel travel together as one row, so a point meets its pixel once a
    sensor, and the year axis is unfolded after the join.
    """
    stacks = (gradient.filter(F.col("year").isin(list(years))).groupBy("sensor", "cx", "cy")
              .agg(F.map_from_entries(F.collect_list(F.struct("year", "gradient"))).alias("by_year")))
    pixels = F.array(*[F.struct(F.lit(sensor).alias("sensor"), cell_of(F.col("x"), size).alias("cx"),
                                cell_of(F.col("y"), size).alias("cy"))
                       for sensor, size in res.items()])
    met = (points.select(*key, F.inline(pixels)).join(stacks, ["sensor", "cx", "cy"], "left")
           .select(*key, "sensor", "by_year",
                   F.explode(F.array(*[F.lit(y) for y in years])).alias("year")))
    return met.select(*key, "sensor", "year",
                      F.try_element_at("by_year", F.col("year")).alias("grad"))


def clip_to_box(cells: DataFrame, box: tuple[float, float, float, float],
                res: dict[str, float], margin: int = 0) -> DataFrame:
    """Cells of each sensor whose centre lies in a box given in metres.

    ``margin`` grows the box by so many cells, for the neighbours of cells in it.
    """
    x0, y0, x1, y1 = box
    keep = F.lit(False)
    for sensor, size in res.items():
        x, y, more = (F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, margin * size
        keep = keep | ((F.col("sensor") == sensor) & x.between(x0 - more, x1 + more)
                       & y.between(y0 - more, y1 + more))
    return cells.filter(keep)
