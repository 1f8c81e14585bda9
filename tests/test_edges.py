"""Edge rules, completeness, null model and labels on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from edgeline.functions import labels
from edgeline.operators import nullmodel, rates, sites, stats
from edgeline.operators import samples as sm


def rows_of(site, transect, grads, year=2020):
    n = len(grads) // 2
    return [(site, transect, p, year, g) for p, g in zip(range(-n, n + 1), grads) if g != "absent"]


SCHEMA = "site_id string, transect_id long, pnt_pst int, year int, grad double"


def test_rules_differ_on_null(spark):
    data = (rows_of("A", 1, [None, 1.0, 5.0, 2.0, 3.0]) + rows_of("A", 2, [1.0, 1.0, 5.0, 2.0, 9.0])
            + rows_of("A", 3, [6.0, 7.0, 5.0, 2.0, 9.0]) + rows_of("A", 4, [1.0, 1.0, None, 2.0, 2.0])
            + rows_of("B", 5, [1.0, 1.0, 5.0, 2.0, "absent"]))
    df = spark.createDataFrame(data, SCHEMA)
    strict = {r.transect_id for r in sm.strict_edges(sm.complete_transects(df)).collect()}
    assert strict == {2}
    three = {r.transect_id: r.edge for r in
             sm.complete_wide(df).withColumn("edge", sm.edge_flag()).collect()}
    assert three == {1: 1, 2: 1, 3: 0, 4: None}
    outer = {r.transect_id: r.edge for r in
             sm.complete_wide(df).withColumn("edge", sm.edge_flag("outermost")).collect()}
    assert outer == {1: None, 2: 0, 3: 0, 4: None}
    flags = {r.transect_id: r.edge_2020 for r in sm.transect_flags(df, [2020]).collect()}
    assert flags == {1: False, 2: True, 3: False, 4: False}


def test_absent_neighbour_does_not_spoil_a_side(spark):
    data = (rows_of("A", 1, [1.0, 1.0, 5.0, 2.0, 3.0]) + rows_of("A", 1, ["absent", 1.0, 5.0, 2.0, 3.0], 2001)
            + rows_of("A", 2, [1.0, 1.0, 5.0, 2.0, 3.0])
            + rows_of("A", 2, [None, 1.0, 5.0, 2.0, 3.0], 2001))
    flags = {r.transect_id: r.edge_2001 for r in sm.transect_flags(
        spark.createDataFrame(data, SCHEMA)).collect()}
    assert flags == {1: True, 2: False}


def test_site_without_edges_has_null_level(spark):
    data = rows_of("A", 1, [6.0, 6.0, 5.0, 6.0, 6.0]) + rows_of("B", 2, [1.0, 1.0, 5.0, 1.0, 1.0])
    df = spark.createDataFrame(data, SCHEMA)
    placed = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "site_id string, transect_id long")
    original = spark.createDataFrame([("A", 2), ("B", 4), ("C", 0), ("D", 9)],
                                     "site_id string, ntrsct long")
    got = {r.site_id: r for r in sm.edge_levels(placed, original, df).collect()}
    assert set(got) == {"A", "B", "C"}
    assert got["A"].ntrsct_2020_edge is None and got["A"].edge_level_2020 is None
    assert got["B"].edge_level_2020 == 1 and got["B"].perc_evaluated_2020 == 0.25
    assert got["C"].ntrsct_2020_eva == 0 and got["C"].perc_evaluated_2020 is None
    filled = {r.site_id: r for r in sm.fill_missing_levels(
        sm.edge_levels(placed, original, df)).collect()}
    assert filled["A"].edge_level_2020 == 0
    assert {r.site_id for r in rates.reported_sites(
        sm.edge_levels(placed, original, df)).collect()} == {"A"}


def test_permutation_is_a_bijection(spark):
    data = [r for t in range(1, 400, 3) for r in rows_of("hot" if t % 2 else "b", t, [1.0] * 5)]
    df = spark.createDataFrame(data, SCHEMA)
    dense = nullmodel.shuffled_borders(df, [2020]).collect()
    for site in ("hot", "b"):
        ids = sorted({t for t in range(1, 400, 3) if (t % 2 == 1) == (site == "hot")})
        mine = [r for r in dense if r.site_id == site]
        assert sorted(r.transect_id for r in mine) == ids
        assert sorted(r.source_id for r in mine) == ids
    literal = nullmodel.shuffled_borders(df, [2020], mode="literal").filter("site_id = 'hot'")
    assert sorted(r.transect_id for r in literal.collect()) == list(range(1, 68))
    other = nullmodel.shuffled_borders(df, [2020], seed=2).collect()
    assert {tuple(r) for r in other} != {tuple(r) for r in dense}


def test_feistel_permutes_every_size(spark):
    """For each n up to 300 and two keys, 0 .. n - 1 is hit once each, and not in place."""
    sizes = spark.range(1, 301).select(F.col("id").alias("n")).crossJoin(
        spark.createDataFrame([("A",), ("B",)], "site_id string"))
    rows = sizes.select("*", F.lit(2020).alias("year"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
                        .alias("i")).withColumn("keys", nullmodel.round_keys(7))
    got = rows.select("site_id", "n", "i", nullmodel.permuted(F.col("i"), F.col("n"), F.col("keys")).alias("p"))
    by = {}
    for r in got.collect():
        by.setdefault((r.site_id, r.n), []).append((r.i, r.p))
    assert len(by) == 600
    for (_, n), pairs in by.items():
        assert sorted(p for _, p in pairs) == list(range(n))
    moved = [i != p for pairs in by.values() for i, p in pairs if len(pairs) > 100]
    assert sum(moved) / len(moved) > 0.98
    assert sorted(by["A", 250]) != sorted(by["B", 250])


def test_one_fold_equals_the_separate_rules(spark):
    """Counts of ``site_years`` against wide rows, strict edges and flags of random samples."""
    import random
    r = random.Random(9)
    data = []
    for site in "ABC":
        for t in range(25):
            for year in (2001, 2019, 2020):
                grads = [r.choice([None, "absent", *map(float, range(8))] if r.random() < 0.3 else
                                  [float(r.randint(0, 9))]) for _ in range(5)]
                data += rows_of(site, t, grads, year)
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r.site_id, r.year): (r.n, r.n_evaluated, r.n_any_pair, r.n_strict, r.n_outermost)
           for r in rates.site_years(df).collect()}
    wide = sm.complete_wide(df)
    any_pair, outer = ({(r.site_id, r.year): (r.n, r.n_edge) for r in rates.site_year_counts(
        wide.withColumn("edge", sm.edge_flag(rule))).collect()} for rule in ("any_pair", "outermost"))
    strict = {(r.site_id, r.year): r.n for r in sm.strict_edges(sm.complete_transects(df)).groupBy(
        "site_id", "year").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = {(r.site_id, r.year): r.n for r in sm.complete_transects(df.drop("n")).filter("pnt_pst = 0")
            .groupBy("site_id", "year").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert set(got) == set(any_pair)
    for key, (n, evaluated, some, all_known, far) in got.items():
        assert any_pair[key] == (n, some) and outer[key] == (n, far)
        assert strict.get(key, 0) == all_known and seen.get(key, 0) == evaluated


def test_trend_needs_three_rows(spark):
    data = (rows_of("two", 1, [0.0, 0.0, 1.0, 0.0, 0.0]) + rows_of("two", 1, [0.0, 0.0, 2.0, 0.0, 0.0], 2001)
            + [r for y in (2001, 2010, 2020) for r in rows_of("flat", 2, [0.0, 0.0, 3.0, 0.0, 0.0], y)])
    got = stats.site_trends(spark.createDataFrame(data, SCHEMA)).withColumn(
        "cls", labels.trend_class(F.col("slope"), F.col("p_value")))
    cls = {r.site_id: (r.p_value, r.cls) for r in got.collect()}
    assert cls["two"] == (None, "unknown")
    assert cls["flat"][1] == "Stable"


def test_nan_is_never_significant(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (float("nan"), 0.01), (0.0, 0.5), (-1.0, 0.01)],
                               "s double, p double")
    got = [r.c for r in df.select(labels.trend_class(F.col("s"), F.col("p"), "site").alias("c")).collect()]
    assert got == ["unknown", "unknown", "Stable", "Significantly Decrease"]


def test_registry_null_logic(spark):
    row = {"site_id": "1", "type": "Polygon", "marine": 0, "desig_eng": "Park",
           "status": "Designated", "gis_area": 300.0, "perimeter": 1.0}
    rows = [row, {**row, "site_id": None}, {**row, "desig_eng": None}, {**row, "site_id": "187"},
            {**row, "status": None}]
    df = spark.createDataFrame(rows, "site_id string, type string, marine int, desig_eng string, "
                                     "status string, gis_area double, perimeter double")
    assert [r.site_id for r in sites.terrestrial_sites(df).collect()] == ["1", None]


def test_labels_variants(spark):
    df = spark.createDataFrame([(None,), ("N/A",), ("Mangroves",), ("Tundra",)], "b string")
    pick = lambda v: [r.g for r in df.select(labels.regroup_biome(F.col("b"), v).alias("g")).collect()]
    assert pick("global") == ["Rock & Ice", "Rock & Ice", "Mangroves", "Tundra"]
    assert pick("site") == [None, "Rock & Ice", "Mangrove", "Tundra"]
    with pytest.raises(ValueError):
        labels.regroup_biome(F.col("b"), "other")


def test_residual_quantiles(spark):
    rows = [(f"s{i}", "ab"[i % 2], float((i * 37) % 11)) for i in range(60)]
    df = spark.createDataFrame(rows, "site_id string, g string, y double")
    got = sorted(stats.residual_quantiles(df, "g", "y", "site_id").collect(),
                 key=lambda r: r.theoretical)
    assert len({r.theoretical for r in got}) == 60
    z = [r.std_resid for r in got]
    assert z == sorted(z) and got[0].theoretical == pytest.approx(-got[-1].theoretical)
