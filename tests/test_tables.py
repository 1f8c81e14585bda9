"""Stage audits in the pass and rewritten partitions."""

from pyspark.sql import functions as F

from edgeline.session import materialise, scratch_path
from edgeline.sources import tables as tb


def test_audit_counts_what_flows_by(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.5), (None, 4.0)], "k string, v double")
    audit = tb.StageAudit(spark)
    first = audit.watch(rows.repartition(3), "all", "k", F.col("v"))
    second = audit.watch(first.filter("v > 1"), "some", "k", F.col("v"))
    out = audit.watch(second.filter("k IS NOT NULL"), "keyed")
    written = materialise(out, "audited")
    audit.count_keys("keyed", written, "k")
    assert written.columns == ["k", "v"]
    got = {r.stage: tuple(r)[1:] for r in audit.table().collect()}
    assert got == {"all": (4, 2, 7.5), "some": (2, 1, 6.5), "keyed": (1, 1, None)}


def test_audited_filters_share_one_shuffle(spark):
    audit = tb.StageAudit(spark)
    df = audit.watch(spark.range(100).withColumn("k", F.col("id") % 7), "a", "k")
    df = audit.watch(audit.watch(df.filter("id > 3"), "b", "k").filter("id > 9"), "c", "k")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_audit_of_an_empty_stage(spark):
    audit = tb.StageAudit(spark)
    none = spark.createDataFrame([], "k string, v double")
    materialise(audit.watch(none, "none", "k", F.col("v")), "audited")
    assert [tuple(r) for r in audit.table().collect()] == [("none", 0, 0, None)]


def test_a_rerun_replaces_its_year_only(spark):
    path = scratch_path(spark, "years")
    rows = lambda year, *vs: spark.createDataFrame([(v, year) for v in vs], "v long, year int")
    tb.replace_partitions(rows(2019, 1, 2).union(rows(2020, 3)), path, "year")
    for _ in range(2):
        tb.replace_partitions(rows(2019, 7), path, "year")
    got = spark.read.schema("v long, year int").parquet(path).collect()
    assert sorted(map(tuple, got)) == [(3, 2020), (7, 2019)]
