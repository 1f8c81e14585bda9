"""Distribution functions against published test statistics."""

import math

import numpy as np
import pytest

from edgeline.functions import distributions as d


@pytest.mark.parametrize("f, d1, d2, p", [
    (10.17, 7, 4463, 1.08e-12), (3.886, 6, 3056, 0.000719), (2.401, 6, 3056, 0.0257),
    (5.099, 1, 4469, 0.02399), (0.03868, 1, 4469, 0.8441), (12.83, 1, 4048, 0.0003454)])
def test_f_probability(f, d1, d2, p):
    assert d.f_upper(f, d1, d2) == pytest.approx(p, rel=6e-3)


@pytest.mark.parametrize("t, df, p", [(2.258, 4469, 0.024), (0.197, 4469, 0.844),
                                      (-3.582, 4048, 0.000345), (1.0, 1, 0.5)])
def test_t_probability(t, df, p):
    assert d.t_two_sided(t, df) == pytest.approx(p, rel=4e-3)


@pytest.mark.parametrize("diff, lwr, p, n1, n2", [
    (0.032033105, 0.008466103, 0.0009986, 406, 403),
    (-0.023240799, -0.037270424, 0.0000146, 987, 1353),
    (0.019508264, 0.005170194, 0.0009814, 1224, 987)])
def test_tukey(diff, lwr, p, n1, n2):
    se = math.sqrt(54.52 / 4463 / 2 * (1 / n1 + 1 / n2))
    assert d.studentized_range_upper(abs(diff) / se, 8, 4463.0) == pytest.approx(p, rel=6e-3)
    assert diff - se * d.studentized_range_quantile(0.05, 8, 4463.0) == pytest.approx(lwr, abs=1e-6)


@pytest.mark.parametrize("k, df, q", [(3, 10.0, 3.877), (2, 2.0, 6.085), (5, 3.0, 7.502)])
def test_studentized_range_table(k, df, q):
    assert d.studentized_range_quantile(0.05, k, df) == pytest.approx(q, abs=2e-3)


def test_inverses_and_missing_values():
    assert d.t_quantile_two_sided(0.05, 18) == pytest.approx(2.10092204, abs=1e-7)
    p = np.array([0.001, 0.3, 0.5, 0.975])
    assert d.normal_cdf(d.normal_quantile(p)) == pytest.approx(p, abs=1e-12)
    assert np.isnan(d.t_two_sided(np.array([np.nan, 1.0]), np.array([5.0, np.nan]))).all()
    assert d.beta_inc(0.0, 2, 3) == 0 and d.beta_inc(1.0, 2, 3) == 1


def test_quantiles_beyond_the_first_bracket():
    far = float(d.t_quantile_two_sided(1e-7, 1.0))
    assert abs(far * 1e-7 * np.pi / 2 - 1) < 1e-6
    q = d.studentized_range_quantile(0.01, 20, 1.0)
    assert q > 200 and abs(d.studentized_range_upper(q, 20, 1.0) - 0.01) < 1e-6


def test_anova_does_not_cancel_under_a_shift(spark):
    from edgeline.operators.stats import anova
    rows = [(f"g{i % 3}", float((i * 37) % 11 + (i % 3) * 2)) for i in range(300)]
    values = []
    for shift in (0.0, 1e9):
        df = spark.createDataFrame([(g, y + shift) for g, y in rows], "g string, y double")
        values.append(anova(df, "g", "y", p_values=False).first().f_value)
    assert values[1] == pytest.approx(values[0], rel=1e-6)


def test_probit_column(spark):
    from statistics import NormalDist

    from pyspark.sql import functions as F

    from edgeline.functions.inference import probit
    ps = [1e-300, 1e-20, 1e-9, 0.001, 0.07, 0.075, 0.2, 0.5, 0.6, 0.925, 0.93, 0.999, 1 - 1e-12]
    df = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, -1.0, None]], "p double")
    got = {r.p: r.z for r in df.select("p", probit(F.col("p")).alias("z")).collect()}
    for p in ps:
        assert got[p] == pytest.approx(NormalDist().inv_cdf(p), rel=1e-13, abs=1e-15)
    assert got[0.0] is None and got[1.0] is None and got[-1.0] is None and got[None] is None
