"""Composites and gradients do not depend on tiling or on the hot-group route."""

import math

import numpy as np
import pytest

from edgeline.operators import imagery as im


@pytest.fixture(scope="module")
def composite(spark):
    rng = np.random.default_rng(11)
    rows = [("MODIS", 2020, x - 4, y - 3, [float(b) for b in rng.uniform(0.1, 1, 7)])
            for x in range(11) for y in range(9) if rng.random() < 0.9]
    return rows, spark.createDataFrame(
        rows, "sensor string, year int, cx long, cy long, bands array<double>")


def brute(rows, radius):
    spectra = {(r[2], r[3]): np.array(r[4]) / np.linalg.norm(r[4]) for r in rows}
    angle = lambda a, b: math.acos(max(-1, min(1, float(np.dot(spectra[a], spectra[b])))))
    out = {}
    for c in spectra:
        near = sorted((m for m in spectra if max(abs(m[0] - c[0]), abs(m[1] - c[1])) <= radius),
                      key=lambda m: (m[1], m[0]))
        total = [round(sum(angle(m, o) for o in near if o != m), 9) for m in near]
        out[c] = 100 * angle(near[int(np.argmax(total))], near[int(np.argmin(total))])
    return out


@pytest.mark.parametrize("radius, tile", [(3, 128), (3, 4), (2, 5), (1, 3)])
def test_gradient(composite, radius, tile):
    rows, df = composite
    got = {(r.cx, r.cy): r.gradient for r in im.spectral_gradient(df, radius, tile).collect()}
    want = brute(rows, radius)
    assert set(got) == set(want)
    for c, g in want.items():
        assert got[c] == pytest.approx(g, abs=1e-5)


def test_median_routes_agree(spark):
    rng = np.random.default_rng(3)
    rows = [("MODIS", 2020, int(c), 0, [float(b) for b in rng.normal(size=7)])
            for c in rng.integers(0, 4, 200)]
    df = spark.createDataFrame(rows, "sensor string, year int, cx long, cy long, bands array<double>")
    take = lambda d: {r.cx: list(r.bands) for r in d.collect()}
    cold, hot = take(im.yearly_median(df)), take(im.yearly_median(df.repartition(5)))
    for c in cold:
        assert cold[c] == pytest.approx(hot[c])
        assert cold[c] == pytest.approx(np.median([r[4] for r in rows if r[2] == c], axis=0))


def test_water_and_sampling(spark):
    pts = spark.createDataFrame([(1, 10.0, 10.0), (2, 40.0, 10.0), (3, 900.0, 10.0)],
                                "id long, x double, y double")
    water = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (1, 0, 1)],
                                  "px long, py long, max_extent int")
    assert [r.id for r in im.land_points(pts, water, ["id"]).collect()] == [1]
    grad = spark.createDataFrame([("M", 2019, 0, 0, 1.5), ("M", 2020, 0, 0, 2.5)],
                                 "sensor string, year int, cx long, cy long, gradient double")
    rows = im.sample_years(pts, grad, ["id"], [2019, 2020], {"M": 500.0}).collect()
    got = {(r.id, r.year): r.grad for r in rows}
    assert got == {(1, 2019): 1.5, (1, 2020): 2.5, (2, 2019): 1.5, (2, 2020): 2.5,
                   (3, 2019): None, (3, 2020): None}


def test_median_keeps_a_cell_year_of_null_bands(spark):
    rows = [("s", 2020, 1, 1, [None] * 7), ("s", 2020, 1, 1, [None] * 7), ("s", 2020, 2, 1, [1.0] * 7)]
    df = spark.createDataFrame(rows, "sensor string, year int, cx int, cy int, bands array<double>")
    got = {r.cx: r.bands for r in im.yearly_median(df).collect()}
    assert got == {1: [None] * 7, 2: [1.0] * 7}


def test_sampling_two_sensors_and_an_empty_gradient(spark):
    pts = spark.createDataFrame([(1, 40.0, 10.0)], "id long, x double, y double")
    schema = "sensor string, year int, cx long, cy long, gradient double"
    grad = spark.createDataFrame([("M", 2020, 0, 0, 1.5), ("L", 2020, 1, 0, 2.5)], schema)
    res = {"M": 500.0, "L": 30.0}
    take = lambda g: {(r.sensor, r.year): r.grad
                      for r in im.sample_years(pts, g, ["id"], [2019, 2020], res).collect()}
    assert take(grad) == {("M", 2019): None, ("M", 2020): 1.5, ("L", 2019): None, ("L", 2020): 2.5}
    assert take(grad.limit(0)) == {(s, y): None for s in "ML" for y in (2019, 2020)}


def test_box_before_the_gradient(composite):
    _, df = composite
    box, res = (1000.0, 0.0, 2200.0, 1800.0), {"MODIS": 500.0}
    take = lambda d: {(r.cx, r.cy): r.gradient for r in d.collect()}
    near = im.clip_to_box(df, box, res, margin=4)
    assert near.count() < df.count()
    assert take(im.clip_to_box(im.spectral_gradient(near), box, res)) == take(
        im.clip_to_box(im.spectral_gradient(df), box, res))
