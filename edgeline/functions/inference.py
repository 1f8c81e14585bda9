"""Arrow-batched wrappers that put p-values and quantiles on aggregated rows."""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from edgeline.functions import distributions as dist


def _null_nan(values, index) -> pd.Series:
    out = pd.Series(values, index=index, dtype="float64")
    return out.astype(object).where(out.notna(), None)


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _null_nan(dist.t_two_sided(t.astype(float), df.astype(float)), t.index)


@F.pandas_udf(DoubleType())
def f_p_value(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _null_nan(dist.f_upper(f.astype(float), d1.astype(float), d2.astype(float)),
                     f.index)


@F.pandas_udf(DoubleType())
def t_quantile(alpha: pd.Series, df: pd.Series) -> pd.Series:
    return _null_nan(dist.t_quantile_two_sided(alpha.astype(float), df.astype(float)),
                     df.index)


# Coefficients of Wichura's algorithm AS 241 (PPND16), constant term first.
_CENTRE = ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
            1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
            3.3430575583588128105e4, 2.5090809287301226727e3],
           [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
            2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
            5.2264952788528545610e3])
_MIDDLE = ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
            3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
            2.27238449892691845833e-2, 7.74545014278341407640e-4],
           [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
            1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
            1.05075007164441684324e-9])
_TAIL = ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
          2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
          2.71155556874348757815e-5, 2.01033439929228813265e-7],
         [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
          7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
          2.04426310338993978564e-15])


def _ratio(polynomials, r: Column) -> Column:
    above, below = (functools.reduce(lambda acc, c: acc * r + c, reversed(p[:-1]), F.lit(p[-1]))
                    for p in polynomials)
    return above / below


def probit(p: Column) -> Column:
    """Normal quantile as a column expression, by rational functions accurate to about
    sixteen digits; NULL outside 0 < p < 1."""
    q = p - 0.5
    r = F.sqrt(-F.log(F.least(p, 1 - p)))
    centre = q * _ratio(_CENTRE, 0.180625 - q * q)
    tail = F.signum(q) * F.when(r <= 5, _ratio(_MIDDLE, r - 1.6)).otherwise(_ratio(_TAIL, r - 5))
    return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, centre).otherwise(tail))


@F.pandas_udf(DoubleType())
def tukey_p_value(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    rows = zip(q.astype(float), k.astype(float), df.astype(float))
    values = [dist.studentized_range_upper(a, int(b), c) if a == a and c == c
              else float("nan") for a, b, c in rows]
    return _null_nan(values, q.index)


@F.pandas_udf(DoubleType())
def tukey_quantile(alpha: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    rows = zip(alpha.astype(float), k.astype(float), df.astype(float))
    values = [dist.studentized_range_quantile(a, int(b), c) if c == c
              else float("nan") for a, b, c in rows]
    return _null_nan(values, df.index)


def stars(p: Column) -> Column:
    """Significance marks at 0.1, 0.05 and 0.01."""
    return (F.when(p < 0.01, "***").when(p < 0.05, "**").when(p < 0.1, "*")
            .otherwise(""))
