"""Block-wise numbering and quantiles against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from edgeline.operators import ranking
from edgeline.operators.ranking import (exact_quantiles, id_levels, number_rows,
                                        quantile_values, rank_rows, running_totals)


def test_number_rows_with_a_hot_group(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.4 else f"g{rng.randrange(5)}", i)
            for i in rng.sample(range(-500, 500), 600)]
    df = spark.createDataFrame(rows, "g string, v long")
    got = number_rows(df, ["g"], [[F.floor(F.col("v") / 100)], [F.floor(F.col("v") / 7)]],
                      [F.col("v")], "i").collect()
    want, seen = {}, {}
    for g, v in sorted(rows, key=lambda r: r[1]):
        seen[g] = seen.get(g, 0) + 1
        want[g, v] = seen[g]
    assert {(r.g, r.v): r.i for r in got} == want


def test_number_whole_table(spark):
    df = spark.range(0, 300_000, 7).withColumnRenamed("id", "v")
    got = number_rows(df, [], id_levels(F.col("v")), [F.col("v")], "i")
    assert got.filter("i <> v / 7 + 1").count() == 0


def test_running_totals(spark):
    df = spark.createDataFrame([(g, i, float(i % 4)) for g in "ab" for i in range(50)],
                               "g string, i long, v double")
    got = running_totals(df, ["g"], F.floor(F.col("i") / 8), F.col("i"), F.col("v"), "s").collect()
    want = np.cumsum([i % 4 for i in range(50)])
    assert all(r.s == want[r.i] and r.s_total == want[-1] for r in got)


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [3.0] * 40 + [1.0, 9.0], list(np.random.default_rng(1).normal(size=997)),
    [1.0] * 500 + list(np.arange(400.0))])
def test_quantiles_match_linear_interpolation(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    row = exact_quantiles(df, [], "v", probs).first()
    assert [row[n] for n in probs] == pytest.approx(np.quantile(values, list(probs.values())))


def test_quantile_bracket_beyond_the_sketch(spark):
    """A coarse sketch must still give the exact value."""
    values = np.random.default_rng(5).exponential(size=200_000)
    df = spark.createDataFrame(values[:, None].tolist(), "v double")
    row = exact_quantiles(df, [], "v", {"q": 0.37}, accuracy=50).first()
    assert row.q == pytest.approx(np.quantile(values, 0.37), abs=0)


def test_hot_groups_equal_cold_groups(spark):
    rng = np.random.default_rng(2)
    rows = [(int(g), float(v)) for g, v in zip(rng.integers(0, 3, 900), rng.normal(size=900))]
    df = spark.createDataFrame(rows, "g int, v double")
    probs = {"q1": 0.25, "m": 0.5}
    exact = F.percentile("v", F.array(*[F.lit(p) for p in probs.values()]))
    want = df.groupBy("g").agg(exact.alias("q")).orderBy("g").collect()
    got = exact_quantiles(df, ["g"], "v", probs).orderBy("g").collect()
    for a, b in zip(want, got, strict=True):
        assert a.g == b.g and list(a.q) == pytest.approx([b[n] for n in probs])


PROBS = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}


@pytest.mark.parametrize("kind", ["low", "high", "nothing", "outside"])
@pytest.mark.parametrize("shape", ["outliers", "ties", "smooth", "two"])
def test_quantiles_need_no_right_sketch(spark, monkeypatch, kind, shape):
    """The counts decide: a sketch made wrong on purpose costs passes, not the result."""
    rng = np.random.default_rng(3)
    values = {"outliers": np.concatenate([rng.normal(size=3000), [1e300, -1e300, 5e18]]),
              "ties": rng.integers(0, 3, 3000) / 4, "smooth": rng.exponential(size=3000),
              "two": np.array([0.0] * 2999 + [1.0])}[shape]
    wrong = {"low": lambda b: [b.low] * 4, "high": lambda b: [b.high], "nothing": lambda b: [],
             "outside": lambda b: [b.low - 5, b.high + 5]}[kind]
    monkeypatch.setattr(ranking, "_sketch", lambda column, brackets, accuracy: [wrong(b) for b in brackets])
    monkeypatch.setattr(ranking, "FEW", 40)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    got = quantile_values(df, "v", PROBS)
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(float(np.quantile(values, p)), rel=1e-12, abs=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert quantile_values(df, "v", {"m": 0.5}) == {"m": None}
    row = exact_quantiles(df, [], "v", {"m": 0.5}).first()
    assert row.m is None


def test_keyed_quantiles_refuse_a_wrong_sketch(spark, monkeypatch):
    rows = [(1, float(i)) for i in range(5000)]
    df = spark.createDataFrame(rows, "g int, v double")
    monkeypatch.setattr(F, "percentile_approx", lambda v, probs, acc: F.array(F.lit(-2.0), F.lit(-1.0)))
    with pytest.raises(Exception, match="outside its sketch"):
        exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()


def test_ranks_spread_over_many_ranges(spark):
    """An outlier and a common value: no range holds much more than its share."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        _check_ranges(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _check_ranges(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=20_000), [1e12], np.full(6000, 0.25)])
    rows = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "id long, v double")
    tie = F.md5(F.col("id").cast("string").cast("binary"))
    got = rank_rows(rows, [F.col("v"), tie, F.col("id")], "rank", "total")
    back = {r.id: (r.rank, r.total) for r in got.collect()}
    assert sorted(r for r, _ in back.values()) == list(range(1, len(values) + 1))
    assert {t for _, t in back.values()} == {len(values)}
    in_rank = [values[i] for i, _ in sorted(back.items(), key=lambda kv: kv[1])]
    assert in_rank == sorted(in_rank)
    files = got.groupBy(F.input_file_name()).count().collect()
    assert len(files) >= 6 and max(r["count"] for r in files) < 0.4 * len(values)


def test_sparse_ids_rank(spark):
    ids = [0, 5, 1 << 40, (1 << 62) + 3, -(1 << 62), 77]
    df = spark.createDataFrame([(i,) for i in ids], "v long")
    got = {r.v: r.i for r in rank_rows(df, [F.col("v")], "i").collect()}
    assert got == {v: k + 1 for k, v in enumerate(sorted(ids))}
    assert rank_rows(df.limit(0), [F.col("v")], "i").collect() == []
