"""Polygon masks as sparse grid-cell tables.

A cell (cx, cy) covers [cx, cx+1) x [cy, cy+1) times the cell size; background
cells are absent. Every job explodes a bounded number of offsets per cell and
groups by cell, so no step depends on a window over a whole mask.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from edgeline.functions.geometry import first_centre
from edgeline.operators.vertices import segments
from edgeline.session import checkpoint_dir, materialise, parts_for

CELL = 500.0
#: Cells that a task makes room for at every crossing of a border and a row.
SPAN_CELLS = 100
KEY_SHIFT = 1 << 32
#: Steps that look at neighbours deal cells by squares of two to this many cells a side.
SQUARE_BITS = 6
SQUARE = ["tx", "ty"]


def rasterise(vertices: DataFrame, size: float = CELL, carry: Sequence[str] = ()) -> DataFrame:
    """Cells of each feature whose centre lies inside it (even-odd rule)."""
    return fill(segments(vertices, "per_ring", carry), size, carry)


def fill(seg: DataFrame, size: float = CELL, carry: Sequence[str] = ()) -> DataFrame:
    """Scanline fill: every segment finds its own crossings with the rows of cell
    centres, crossings are paired per (feature, row), and each pair fills a span."""
    lo, hi = F.least("y0", "y1"), F.greatest("y0", "y1")
    r0, r1 = first_centre(lo, size), first_centre(hi, size) - 1
    hits = (seg.filter(r0 <= r1)
            .select("fid", *carry, "x0", "y0", "x1", "y1", F.explode(F.sequence(r0, r1)).alias("cy")))
    yc = (F.col("cy") + 0.5) * size
    x = (F.col("x0") + (yc - F.col("y0")) * (F.col("x1") - F.col("x0"))
         / (F.col("y1") - F.col("y0")))
    # Spans are few bytes but unfold into many cells: a partition count that follows
    # the crossings keeps the runtime from merging them into a few large tasks.
    crossings = seg.filter(r0 <= r1).agg(F.sum(r1 - r0 + 1)).first()[0]
    parts = parts_for(seg.sparkSession, (crossings or 0) * SPAN_CELLS)
    w = Window.partitionBy("fid", "cy").orderBy("x")
    spans = (hits.select("fid", *carry, "cy", x.alias("x")).repartition(parts, "fid", "cy")
             .withColumn("i", F.row_number().over(w)).withColumn("xe", F.lead("x").over(w))
             .filter(F.col("i") % 2 == 1))
    c0, c1 = first_centre(F.col("x"), size), first_centre(F.col("xe"), size) - 1
    return (spans.filter(c0 <= c1)
            .select("fid", *carry, F.explode(F.sequence(c0, c1)).alias("cx"), "cy"))


def first_value(cells: DataFrame, value: str, order: str = "fid") -> DataFrame:
    """One value per cell: that of the first feature covering it."""
    return cells.groupBy("cx", "cy").agg(F.min_by(value, order).alias("value"))


def owners(cells: DataFrame, priority: Sequence[str | Column], owner: str) -> DataFrame:
    """Erase overlaps: every cell goes to the feature first in priority."""
    rank = F.struct(*priority, F.col(owner))
    return cells.groupBy("cx", "cy").agg(F.min_by(owner, rank).alias(owner))


def _spread(df: DataFrame, rows: int, *by: str | Column) -> DataFrame:
    """Deals about so many rows by a key, over as many tasks as they need: what a
    grouping or window by this key holds then does not grow with the mask."""
    return df.repartition(parts_for(df.sparkSession, rows), *by)


def distinct_cells(cells: DataFrame, rows: int) -> DataFrame:
    """Distinct (cx, cy) of about so many cells."""
    return _spread(cells.select("cx", "cy"), rows, "cx", "cy").distinct()


def _square(place: Column, bits: int = SQUARE_BITS) -> Column:
    return F.shiftright(place, bits)


def _dealt(cells: DataFrame, rows: int, lo: int, hi: int, keys: Sequence[str] = (),
           bits: int = SQUARE_BITS) -> DataFrame:
    """Cells dealt by the squares in which the places ``lo`` to ``hi`` cells off lie, on
    both axes. A grouping of these places inside squares moves no row again, so little
    more than one copy of the mask is shuffled, not one for each place."""
    for square, axis in zip(SQUARE, ("cx", "cy")):
        reached = F.sequence(_square(F.col(axis) + lo, bits), _square(F.col(axis) + hi, bits))
        cells = cells.withColumn(square, F.explode(reached))
    return _spread(cells, rows, *keys, *SQUARE)


def focal_sum(cells: DataFrame, value: str = "value", size: int = 3) -> DataFrame:
    """Moving-window sum without padding.

    The outermost rows and columns of the frame have no full window and drop
    out, as do windows that see only background.
    """
    frame = cells.agg(F.min("cx").alias("x0"), F.max("cx").alias("x1"), F.min("cy").alias("y0"),
                      F.max("cy").alias("y1"), F.count(F.lit(1)).alias("n")).first()
    if frame.x0 is None or frame.y0 is None:
        return cells.groupBy("cx", "cy").agg(F.sum(value).alias("value")).limit(0)
    margin = size // 2
    # Along rows, then along columns.
    sums = _dealt(cells.select("cx", "cy", value), frame.n * size * size, -margin, margin)
    for square, axis in zip(SQUARE, ("cx", "cy")):
        seen = F.explode(F.array(*[F.col(axis) + d for d in range(-margin, margin + 1)]))
        sums = (sums.withColumn(axis, seen).filter(_square(F.col(axis)) == F.col(square))
                .groupBy(*SQUARE, "cx", "cy").agg(F.sum(value).alias(value)))
    sums = sums.select("cx", "cy", F.col(value).alias("value"))
    return sums.filter(F.col("cx").between(frame.x0 + margin, frame.x1 - margin)
                       & F.col("cy").between(frame.y0 + margin, frame.y1 - margin))


def reclassify_mask(cells: DataFrame, value: str = "value") -> DataFrame:
    """Positive values become 1, all others background."""
    return cells.filter(F.col(value) > 0).select("cx", "cy", F.lit(1).alias("value"))


def disc(radius_cells: float) -> list[int]:
    """Reach along a row, per row offset, of the cells whose nearest edge is closer
    than the radius to a cell centre."""
    n = math.ceil(radius_cells + 0.5) - 1
    gap = lambda d: max(abs(d) - 0.5, 0.0)
    near = lambda dx, dy: gap(dx) ** 2 + gap(dy) ** 2 < radius_cells ** 2
    return [max(dy for dy in range(n + 1) if near(dx, dy)) for dx in range(-n, n + 1)]


def shrink(cells: DataFrame, radius: float, size: float = CELL,
           keys: Sequence[str] = ()) -> DataFrame:
    """Remove the cells that lie within ``radius`` of background.

    A cell survives where, in each row of its disc, one unbroken run of mask cells holds
    the disc's whole width. So each run, made shorter by that width at both ends, covers
    one interval per row offset; interval ends are counted up and down along the row, and
    cells survive where intervals of all offsets are open. Cells are dealt once, by squares
    with a rim as wide as the disc, and nothing moves after that.
    """
    keys = list(keys)
    reach = disc(radius / size)
    n = len(reach) // 2
    # Squares of at least four times the disc's width: the rim stays thin.
    bits = max(SQUARE_BITS, (8 * n).bit_length())
    rim = 1 + 2 * n / (1 << bits)
    dealt = _dealt(cells.select(*keys, "cx", "cy"), math.ceil(cells.count() * rim * rim), -n, n,
                   keys, bits)
    row = [*keys, *SQUARE, "cy"]
    number = F.dense_rank().over(Window.partitionBy(*row).orderBy("cx"))
    runs = (dealt.withColumn("run", F.col("cx") - number).groupBy(*row, "run")
            .agg(F.min("cx").alias("c0"), F.max("cx").alias("c1")))
    out = F.element_at(F.lit(reach), F.col("dy") + n + 1)
    first = F.shiftleft("tx", bits)
    spans = (runs.withColumn("dy", F.explode(F.sequence(F.lit(-n), F.lit(n))))
             .select(*keys, *SQUARE, (F.col("cy") + F.col("dy")).alias("cy"),
                     F.greatest(F.col("c0") + out, first).alias("c0"),
                     F.least(F.col("c1") - out + 1, first + (1 << bits)).alias("c1"))
             .filter((F.col("c0") < F.col("c1")) & (_square(F.col("cy"), bits) == F.col("ty"))))
    ends = F.array(F.struct(F.col("c0").alias("cx"), F.lit(1).alias("step")),
                   F.struct(F.col("c1").alias("cx"), F.lit(-1).alias("step")))
    events = spans.select(*row, F.inline(ends)).groupBy(*row, "cx").agg(F.sum("step").alias("step"))
    w = Window.partitionBy(*row).orderBy("cx")
    covered = events.select(
        *row, "cx", F.lead("cx").over(w).alias("upto"),
        F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("open"))
    return (covered.filter(F.col("open") == 2 * n + 1)
            .select(*keys, F.explode(F.sequence(F.col("cx"), F.col("upto") - 1)).alias("cx"), "cy"))


def dissolve(cells: DataFrame, label: str) -> DataFrame:
    return cells.select(label, "cx", "cy").distinct()


def largest_overlap(cells: DataFrame, zones: DataFrame, key: str, label: str) -> DataFrame:
    """Label of the zone that covers most cells of each feature; NULL for none.

    Ties go to the smaller label.
    """
    counts = (cells.select(key, "cx", "cy").join(zones, ["cx", "cy"])
              .groupBy(key, label).agg(F.count(F.lit(1)).alias("n")))
    best = counts.groupBy(key).agg(
        F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label),
        F.max("n").alias("n_cells"))
    return cells.select(key).distinct().join(best, key, "left")


# ---- connected components --------------------------------------------------
def _cell_id(cx: Column, cy: Column) -> Column:
    return cy * F.lit(KEY_SHIFT) + cx + F.lit(KEY_SHIFT // 2)


def _label_tile(pdf: pd.DataFrame) -> pd.DataFrame:
    """4-neighbour labels inside one tile by min-label hooking and jumping of the unbroken
    runs of its rows, each named by its first cell."""
    pdf = pdf.sort_values(["cy", "cx"], ignore_index=True)
    x, y = pdf["cx"].to_numpy(), pdf["cy"].to_numpy()
    width = int(x.max() - x.min()) + 2
    code = (y - y.min()) * width + (x - x.min())
    first = np.flatnonzero(np.diff(code, prepend=code[0] - 2) > 1)
    cells = np.diff(first, append=len(code))
    begin, end = code[first], code[first + cells - 1]
    # Runs of the next row that touch a run are neighbours in the order of all runs.
    low = np.searchsorted(end, begin + width)
    n = np.searchsorted(begin, end + width, side="right") - low
    a = np.repeat(np.arange(len(first)), n)
    b = np.arange(len(a)) + np.repeat(low - (np.cumsum(n) - n), n)
    label = np.arange(len(first))
    while True:
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    ids = (y * KEY_SHIFT + x + KEY_SHIFT // 2)[first]
    return pd.DataFrame({"cx": x, "cy": y, "local": np.repeat(ids[label], cells)})


def star_contract(edges: DataFrame) -> DataFrame:
    """Connected components of an edge list (a, b) as (node, root).

    Alternating large-star and small-star steps; the rounds grow with the
    logarithm of the graph, so they always end. Each is checkpointed to cut the lineage.
    """
    checkpoint_dir(edges.sparkSession)
    current = edges.filter("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b")
    current = current.distinct().checkpoint()
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"),
                                                            F.col("m").alias("b")))
        large = large.filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = (joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b")))
                 .filter("a <> b").distinct())
        # Written tables keep the rounds apart; both counts read the checkpoint.
        small = small.checkpoint()
        same = (small.count() == current.count()
                and small.join(current, ["a", "b"], "left_anti").isEmpty())
        current = small
        if same:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(cells: DataFrame, tile: int = 1024) -> DataFrame:
    """4-neighbour component of every mask cell, named by its first cell.

    Cells are labelled inside tiles of bounded size; only the pairs that touch
    across tile borders enter the iterative search.
    """
    tagged = cells.select("cx", "cy", F.floor(F.col("cx") / tile).alias("tx"),
                          F.floor(F.col("cy") / tile).alias("ty"))
    local = _spread(tagged, cells.count(), "tx", "ty").groupBy("tx", "ty").applyInPandas(
        lambda pdf: _label_tile(pdf[["cx", "cy"]]), "cx long, cy long, local long")
    local = materialise(local, "tile-labels")
    pairs = []
    for axis, other in (("cx", "cy"), ("cy", "cx")):
        before = local.filter(F.pmod(axis, F.lit(tile)) == tile - 1).select(
            (F.col(axis) + 1).alias(axis), other, F.col("local").alias("a"))
        after = local.filter(F.pmod(axis, F.lit(tile)) == 0).select(
            axis, other, F.col("local").alias("b"))
        pairs.append(before.join(after, [axis, other]).select("a", "b"))
    roots = star_contract(pairs[0].unionByName(pairs[1]).distinct())
    return (local.join(roots, F.col("local") == F.col("node"), "left")
            .select("cx", "cy", F.coalesce("root", "local").alias("component")))


# ---- outlines --------------------------------------------------------------
def outline(cells: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Directed cell sides between mask and background, mask on the right.

    Every cell emits its four sides; a side shared by two mask cells appears
    twice and cancels, so one grouping finds the outline.
    """
    x, y = F.col("cx"), F.col("cy")
    corners = [(x, y), (x, y + 1), (x + 1, y + 1), (x + 1, y)]
    sides = []
    for i in range(4):
        (ax, ay), (bx, by) = corners[i], corners[(i + 1) % 4]
        sides.append(F.struct(ax.alias("x0"), ay.alias("y0"), bx.alias("x1"), by.alias("y1")))
    rows = cells.select(*carry, F.inline(F.array(*sides)))
    rows = rows.select("*", F.least("x0", "x1").alias("kx"), F.least("y0", "y1").alias("ky"),
                       (F.col("x0") == F.col("x1")).alias("vertical"))
    key = ["kx", "ky", "vertical"]
    once = _spread(rows, 4 * cells.count(), *key).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.max(c).alias(c) for c in (*carry, "x0", "y0", "x1", "y1")])
    return once.filter("n = 1").select(*carry, "x0", "y0", "x1", "y1")


# Directions (dx, dy) in the order of the points that they lead to: left, down, up, right.
STEPS = [(-1, 0), (0, -1), (0, 1), (1, 0)]
LEFT, DOWN, UP, RIGHT = range(4)
# The cells around a corner, as bits: left below, right below, left above, right above.
AROUND = [(-1, -1), (0, -1), (-1, 0), (0, 0)]
# Sides in direction d begin at a corner where one cell is mask and another is not, and
# end where the other two are so; the mask is on their right.
BEGINS = {UP: (8, 4), RIGHT: (2, 8), DOWN: (1, 2), LEFT: (4, 1)}
ENDS = {DOWN: (4, 8), LEFT: (8, 2), UP: (2, 1), RIGHT: (1, 4)}


def _corner_turns(around: int) -> list[tuple[int, int, bool]]:
    """Turns (direction come, direction gone, whether the cell is above) at a corner with
    these mask cells. Where two cells touch at the corner, each keeps its right turn."""
    held = lambda sides: [d for d, (mask, free) in sides.items()
                          if around & mask and not around & free]
    def turn(come: int, go: int) -> int:
        (ix, iy), (ox, oy) = STEPS[come], STEPS[go]
        return ix * oy - iy * ox        # -1 right, 0 on, 1 left
    out = []
    for come in held(ENDS):
        go = min(held(BEGINS), key=lambda d: turn(come, d))
        if turn(come, go):
            out.append((come, go, ENDS[come][0] > 2))
    return out


def _outline_turns(cells: DataFrame) -> DataFrame:
    """Corners (component, x, y, come, go) at which the outline of a component turns."""
    dealt = _dealt(cells.select("component", "cx", "cy"), 4 * cells.count(), 0, 1)
    corners = F.array(*[F.struct((F.col("cx") - dx).alias("x"), (F.col("cy") - dy).alias("y"),
                                 F.lit(1 << i).alias("bit")) for i, (dx, dy) in enumerate(AROUND)])
    met = dealt.select(*SQUARE, "component", F.inline(corners)).filter(
        (_square(F.col("x")) == F.col("tx")) & (_square(F.col("y")) == F.col("ty")))
    above = F.col("bit") > 2
    found = met.groupBy(*SQUARE, "x", "y").agg(
        F.bit_or("bit").alias("around"), F.max(F.when(~above, F.col("component"))).alias("below"),
        F.max(F.when(above, F.col("component"))).alias("above"))
    turns = {m: _corner_turns(m) for m in range(16)}
    table = F.create_map(*[part for m, rows in turns.items() if rows for part in (
        F.lit(m), F.array(*[F.struct(F.lit(come).alias("come"), F.lit(go).alias("go"),
                                     F.lit(up).alias("up")) for come, go, up in rows]))])
    found = found.filter(F.col("around").isin([m for m, rows in turns.items() if rows]))
    return found.select("below", "above", "x", "y", F.inline(table[F.col("around")])).select(
        F.when(F.col("up"), F.col("above")).otherwise(F.col("below")).alias("component"),
        "x", "y", "come", "go")


def _side_id(x: Column, y: Column, d: Column) -> Column:
    """A side as one number, in the order of its two ends by x, then y."""
    return (x * F.lit(KEY_SHIFT) + y + F.lit(KEY_SHIFT // 2)) * 4 + d


def ring_runs(cells: DataFrame) -> DataFrame:
    """Straight runs of outline sides in ring order:
    (component, ring, pos, x, y, x1, y1, d, len, n).

    ``cells`` carries a component. A run goes from one turn of the outline to the next on
    its line; where two components or two arms touch at a corner, the sharpest right turn
    stays with the cell. Ring name and position follow from pointer doubling over the
    runs: each round joins on the unique key of a run, so a ring of any length is ordered
    without gathering it anywhere, in as many rounds as its number of runs has binary
    digits. A window sees the turns on one line of one component. ``pos`` is the place of
    the run's first side among the ``n`` sides of its ring.
    """
    ends = F.struct(F.col("come").alias("d"), F.lit(False).alias("begins"), F.col("go").alias("to"))
    begins = F.struct(F.col("go").alias("d"), F.lit(True).alias("begins"), F.col("go").alias("to"))
    events = _outline_turns(cells).select("component", "x", "y", F.inline(F.array(ends, begins)))
    # Beginnings and ends take turns along a line; at one corner the end comes first.
    upright = F.col("d").isin(DOWN, UP)
    across = F.when(upright, F.col("x")).otherwise(F.col("y"))
    along = (F.when(upright, F.col("y")).otherwise(F.col("x"))
             * F.when(F.col("d").isin(UP, RIGHT), 1).otherwise(-1))
    line = (Window.partitionBy("component", "d", "across").orderBy("along", "begins"))
    runs = events.withColumns({"across": across, "along": along})
    runs = runs.withColumns({"x1": F.lead("x").over(line), "y1": F.lead("y").over(line),
                             "to": F.lead("to").over(line),
                             "len": F.lead("along").over(line) - F.col("along")})
    runs = materialise(runs.filter("begins").select(
        _side_id(F.col("x"), F.col("y"), F.col("d")).alias("id"),
        _side_id(F.col("x1"), F.col("y1"), F.col("to")).alias("nxt"),
        "component", "x", "y", "x1", "y1", "d", "len"), "runs")
    checkpoint_dir(cells.sparkSession)
    # Written runs are few bytes for their number of rows, and Spark takes the files' size for
    # theirs: without the hints a whole table of runs is sent through the driver.
    # ``span`` is the number of sides from a run to the one that it points to.
    state = runs.select("id", "nxt", F.col("len").alias("span"), "len", F.col("id").alias("low"),
                        F.lit(0).cast("long").alias("off")).checkpoint()
    while True:
        ahead = state.select(F.col("id").alias("nxt"), F.col("nxt").alias("nxt2"),
                             F.col("low").alias("low2"), F.col("off").alias("off2"),
                             F.col("span").alias("span2"))
        better = F.col("low2") < F.col("low")
        state = state.join(ahead.hint("merge"), "nxt").select(
            "id", F.col("nxt2").alias("nxt"), (F.col("span") + F.col("span2")).alias("span"), "len",
            F.least("low", "low2").alias("low"),
            F.when(better, F.col("off2") + F.col("span")).otherwise(F.col("off")).alias("off"),
            better.alias("moved")).checkpoint()
        if state.filter("moved").isEmpty():
            break
    # ``off`` is the distance to the ring's first side, which begins a run.
    size = state.groupBy("low").agg(F.sum("len").alias("n"))
    start = F.when(F.col("off") == 0, 0).otherwise(F.col("n") - F.col("off"))
    corner = F.shiftright("low", 2)
    x = F.shiftright(corner, 32)
    ring = _cell_id(x, corner - x * F.lit(KEY_SHIFT) - F.lit(KEY_SHIFT // 2))
    placed = state.join(size, "low").select("id", ring.alias("ring"), start.alias("pos"), "n")
    return runs.join(placed.hint("merge"), "id").select(
        "component", "ring", "pos", "x", "y", "x1", "y1", "d", "len", "n")


def ring_sides(cells: DataFrame) -> DataFrame:
    """Outline sides in ring order: (component, ring, pos, x, y, x1, y1, turns, n).

    ``turns`` tells that the side after it leaves in another direction.
    """
    sides = ring_runs(cells).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("len") - 1)))
    dx, dy = (F.element_at(F.lit([s[i] for s in STEPS]), F.col("d") + 1) for i in (0, 1))
    x, y = F.col("x") + F.col("at") * dx, F.col("y") + F.col("at") * dy
    return sides.select("component", "ring", (F.col("pos") + F.col("at")).alias("pos"),
                        x.alias("x"), y.alias("y"), (x + dx).alias("x1"), (y + dy).alias("y1"),
                        (F.col("at") == F.col("len") - 1).alias("turns"), "n")


def trace_rings(cells: DataFrame) -> DataFrame:
    """Outline as ordered rings (component, ring, pos, x, y, n), one row per side."""
    return ring_sides(cells).select("component", "ring", "pos", "x", "y", "n")
