"""Explicit schemas of the tables the engine reads.

Identifiers are strings throughout: registry ids are not all numeric, and a
reader that infers the type would turn some of them into numbers.
"""

from pyspark.sql import types as T


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


S, I, L, D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

REGISTRY = _schema(site_id=S, type=S, marine=I, desig_eng=S, status=S, gis_area=D,
                   perimeter=D)
SITES = _schema(site_id=S, name=S, desig=S, iucn_cat=S, biome=S, status=S,
                status_yr=I, iso3=S, gis_area=D)
VERTICES = _schema(fid=L, ring=I, vtx=L, x=D, y=D)
SAMPLES_RAW = _schema(site_id=S, transect_id=L, pnt_pst=I, year=I, grad=D, geom=S)
SAMPLES = _schema(site_id=S, transect_id=L, pnt_pst=I, year=I, grad=D)
POINTS = _schema(site_id=S, transect_id=L, pnt_pst=I, x=D, y=D)
ORIGINAL_COUNTS = _schema(site_id=S, ntrsct=L)
CELLS = _schema(cx=L, cy=L, value=D)
COUNTRY = _schema(iso3=S, country=S)
