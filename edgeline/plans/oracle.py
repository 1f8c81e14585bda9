"""The registered queries as DuckDB SQL on the driver's tables.

Each text is a plain reading of the operator (self-joins, theta joins, window
numbering), independent of the way the Spark plan gets there. Doubles are
rounded to six places because sums and trigonometry differ in the last bit.
"""

from __future__ import annotations

import re

from edgeline.sources import adapter


def r6(expr: str) -> str:
    """Rounded to six places, with negative zero removed."""
    return f"(round({expr}, 6) + 0.0)"


def _list(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v + "'" for v in values) + "]"


_LENGTHS = ", ".join(f"({k}, {n})" for k, n, _ in adapter.LENGTHS)

VIEWS: dict[str, str] = {}

VIEWS["gs_all"] = f"""
SELECT length_km, 'S' || o_custkey AS site_id, o_orderkey AS transect_id,
       CAST(p AS INTEGER) AS pnt_pst, CAST(y AS INTEGER) AS year,
       CASE WHEN h % 97 <> 0 THEN CAST(h % 10007 AS DOUBLE) / 100.0
            + (y - 2001) * CAST(0.01 AS DOUBLE) * ((o_custkey % 7) - 3) END AS grad
FROM (SELECT o.o_custkey, o.o_orderkey, l.length_km, p, y,
             o_orderkey * 7919 + (p + 3) * 104729 + y * 1299709 + o_custkey * 31
             + (l.length_km - 10) * 15485863 AS h
      FROM orders o, (VALUES {_LENGTHS}) l(length_km, n_side),
           (SELECT unnest(range(-2, 3)) AS p), (SELECT unnest(range(2001, 2021)) AS y)
      WHERE abs(p) <= n_side AND (o_orderkey * 31 + (p + 3) * 17) % 41 <> 0)
"""
VIEWS["gs"] = "SELECT * EXCLUDE (length_km) FROM gs_all WHERE length_km = 10"
VIEWS["placed"] = "SELECT 'S' || o_custkey AS site_id, o_orderkey AS transect_id FROM orders"
VIEWS["points"] = """
SELECT site_id, transect_id, CAST(p AS INTEGER) AS pnt_pst,
       CAST((transect_id * 131 + (p + 2) * 617) % 9000 AS DOUBLE) AS x,
       CAST((transect_id * 71 + (p + 2) * 389) % 7000 AS DOUBLE) AS y
FROM placed, (SELECT unnest(range(-2, 3)) AS p)
"""
VIEWS["sites"] = f"""
SELECT 'S' || c_custkey AS site_id, c_name AS name,
       {_list(adapter.RAW_BIOMES)}[c_custkey % {len(adapter.RAW_BIOMES)} + 1] AS biome,
       {_list(adapter.IUCN)}[c_custkey % {len(adapter.IUCN)} + 1] AS iucn_cat,
       CAST(CASE WHEN c_custkey % 11 = 0 THEN 0 ELSE 1950 + c_custkey % 70 END AS INTEGER)
         AS status_yr,
       n_name AS iso3, abs(c_acctbal) + 200.0 AS gis_area
FROM customer JOIN nation ON c_nationkey = n_nationkey
"""
VIEWS["points_info"] = """
SELECT p.*, s.name, s.biome, s.iucn_cat, s.status_yr, s.iso3, s.gis_area
FROM points p JOIN sites s USING (site_id)
"""
VIEWS["ori_counts"] = """
SELECT 'S' || o_custkey AS site_id, count(*) * (1 + o_custkey % 5) AS ntrsct
FROM orders GROUP BY o_custkey
"""
VIEWS["country"] = """
SELECT n_name AS iso3, 'Land ' || n_nationkey AS country FROM nation
UNION ALL SELECT n_name, 'Land 0 (old)' FROM nation WHERE n_nationkey = 0
"""
VIEWS["complete"] = """
SELECT gs.*, c.n FROM gs JOIN (
  SELECT site_id, transect_id, count(*) AS n FROM gs WHERE year = 2020
  GROUP BY ALL HAVING count(*) = 5) c USING (site_id, transect_id)
"""
VIEWS["diffs"] = """
SELECT o.site_id, o.transect_id, o.pnt_pst, o.year, o.grad, b.grad AS border,
       b.grad - o.grad AS diff
FROM complete o LEFT JOIN (SELECT * FROM complete WHERE pnt_pst = 0) b
  ON o.site_id = b.site_id AND o.transect_id = b.transect_id AND o.year = b.year
WHERE o.pnt_pst <> 0
"""
VIEWS["sides"] = """
SELECT * FROM (
  SELECT *, CASE WHEN pnt_pst < 0 THEN 'inner' ELSE 'outer' END AS side,
         CASE WHEN count(*) OVER w = count(diff) OVER w
              THEN sum(CASE WHEN diff > 0 THEN 1 ELSE 0 END) OVER w END AS n_above
  FROM diffs WINDOW w AS (PARTITION BY site_id, transect_id, year, pnt_pst < 0))
WHERE n_above > 0
"""
VIEWS["edges"] = """
SELECT DISTINCT i.site_id, i.transect_id, i.year
FROM (SELECT * FROM sides WHERE side = 'inner') i
JOIN (SELECT * FROM sides WHERE side = 'outer') o USING (site_id, transect_id, year)
"""
VIEWS["stage"] = """
SELECT o.site_id, o.ntrsct, coalesce(p.n, 0) AS ntrsct_2,
       coalesce(e20.n, 0) AS ntrsct_2020_eva, coalesce(e01.n, 0) AS ntrsct_2001_eva
FROM ori_counts o
LEFT JOIN (SELECT site_id, count(*) AS n FROM placed GROUP BY 1) p USING (site_id)
LEFT JOIN (SELECT site_id, count(*) AS n FROM complete WHERE pnt_pst = 0 AND year = 2020
           GROUP BY 1) e20 USING (site_id)
LEFT JOIN (SELECT site_id, count(*) AS n FROM complete WHERE pnt_pst = 0 AND year = 2001
           GROUP BY 1) e01 USING (site_id)
WHERE o.site_id IN (SELECT site_id FROM placed)
"""
VIEWS["levels"] = """
SELECT s.*, x20.n AS ntrsct_2020_edge,
       ntrsct_2020_eva / nullif(ntrsct, 0) AS perc_evaluated_2020,
       x20.n / nullif(ntrsct_2020_eva, 0) AS edge_level_2020,
       x01.n AS ntrsct_2001_edge,
       ntrsct_2001_eva / nullif(ntrsct, 0) AS perc_evaluated_2001,
       x01.n / nullif(ntrsct_2001_eva, 0) AS edge_level_2001
FROM stage s
LEFT JOIN (SELECT site_id, count(*) AS n FROM edges WHERE year = 2020 GROUP BY 1) x20
  USING (site_id)
LEFT JOIN (SELECT site_id, count(*) AS n FROM edges WHERE year = 2001 GROUP BY 1) x01
  USING (site_id)
"""


def with_views(select: str, extra: dict[str, str] | None = None) -> str:
    """Prefix a SELECT with the views it needs, in dependency order."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in known:
            if name not in order and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                visit(known[name])
                if name not in order:
                    order.append(name)

    visit(select)
    # Oracle engines inline a view per use; one evaluation is enough here.
    ctes = ",\n".join(f"{n} AS MATERIALIZED ({known[n].strip()})" for n in order)
    return f"WITH {ctes}\n{select.strip()}" if ctes else select.strip()
