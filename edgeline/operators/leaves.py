"""Grid cells split into quarters until what meets in one of them is bounded.

The join of points and border pieces works on cells of one size. Where a coast is dense
in vertices and in points, a cell is split and split again: the leaves of a quadtree,
named by (level, cx, cy), with cells of the first size halved ``level`` times.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from edgeline.session import materialise

#: Halvings at most. Points that coincide cannot be told apart by a split.
MAX_LEVEL = 12
CELL = ["cx", "cy"]


def _crossed(child: tuple[Column, Column], parent: tuple[Column, Column]) -> Column:
    """Whether a border piece lies between two cell centres.

    Both count as moved slightly right and, by a smaller amount, up, as everywhere
    else a centre is compared with a border.
    """
    (px, py), (cx, cy) = child, parent
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    dx, dy = bx - ax, by - ay

    def left_of_border(x: Column, y: Column) -> Column:
        at = dx * (y - ay) - dy * (x - ax)
        return F.when(at != 0, at > 0).when(dy != 0, dy < 0).otherwise(dx > 0)

    def left_of_way(x: Column, y: Column) -> Column:
        at = (cx - px) * (y - py) - (cy - py) * (x - px)
        return F.when(at != 0, at > 0).otherwise(cy > py)

    return ((left_of_border(px, py) != left_of_border(cx, cy))
            & (left_of_way(ax, ay) != left_of_way(bx, by)))


def _heavy(points: DataFrame, content: DataFrame, bound: int) -> DataFrame:
    """Cells in which more than ``bound`` pairs of a point and a piece would meet."""
    count = lambda df, name: df.groupBy(*CELL).agg(F.count(F.lit(1)).alias(name))
    met = count(points, "n").join(count(content, "m"), CELL)
    return met.filter(F.col("n") * F.col("m") > bound).select(*CELL)


def _quarter(content: DataFrame, pid: str, size: float, pad: float) -> DataFrame:
    """The content of split cells of ``size``, dealt over their quarters.

    A piece goes to the quarters within ``pad`` of it. The centre of a quarter is inside
    a polygon if the centre of the cell is, once for every piece between the two.
    """
    half = size / 2
    quarters = content.withColumns({"px": F.col("cx"), "py": F.col("cy")})
    for c in CELL:
        quarters = quarters.withColumn(c, F.explode(F.array(F.col(c) * 2, F.col(c) * 2 + 1)))
    is_centre = F.col("ax").isNull()
    child = tuple((F.col(c) + 0.5) * half for c in CELL)
    parent = tuple((F.col(c) + 0.5) * size for c in ("px", "py"))
    flip = F.when(is_centre, 1).otherwise(_crossed(child, parent).cast("int"))
    centres = (quarters.groupBy(pid, *CELL).agg((F.sum(flip) % 2).alias("odd"))
               .filter(F.col("odd") == 1).drop("odd"))
    near = F.lit(True)
    for c, a, b in (("cx", "ax", "bx"), ("cy", "ay", "by")):
        near &= ((F.floor((F.least(a, b) - pad) / half) <= F.col(c))
                 & (F.col(c) <= F.floor((F.greatest(a, b) + pad) / half)))
    return (quarters.filter(~is_centre & near).drop("px", "py")
            .unionByName(centres, allowMissingColumns=True))


def split(points: DataFrame, content: DataFrame, pid: str, grid: float, pad: float, bound: int,
          max_level: int = MAX_LEVEL) -> tuple[DataFrame, DataFrame]:
    """Points and content with their leaf (level, cx, cy) instead of their cell.

    ``content`` has border pieces a-b by cell, within ``pad`` of it, and a row without
    coordinates where the cell's centre is inside ``pid``. No leaf above ``max_level``
    holds more than ``bound`` pairs. Each level reads what the level before split, so
    a table without a dense cell is counted once.
    """
    kept: list[tuple[DataFrame, DataFrame]] = []
    for level in range(max_level + 1):
        points, content = (materialise(df, f"leaves_{level}") for df in (points, content))
        size = grid / 2 ** level
        named = [df.withColumn("level", F.lit(level)) for df in (points, content)]
        heavy = materialise(_heavy(points, content, bound), "heavy_cells")
        if level == max_level or heavy.isEmpty():
            kept.append(tuple(named))
            break
        kept.append(tuple(df.join(heavy, CELL, "left_anti") for df in named))
        points = points.join(heavy, CELL, "left_semi").withColumns(
            {"cx": F.floor(F.col("px") / (size / 2)), "cy": F.floor(F.col("py") / (size / 2))})
        content = _quarter(content.join(heavy, CELL, "left_semi"), pid, size, pad)
    out = kept[0]
    for more in kept[1:]:
        out = tuple(a.unionByName(b) for a, b in zip(out, more))
    return out
