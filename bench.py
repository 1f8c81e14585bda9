"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder and ``BENCH_CPUS`` the local cores. Each
query is run to the end with the no-op sink, so every row and column is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = [
    "e01_complete_transects",       # completeness over all samples
    "e06_edge_level",               # one shuffle from samples to site levels
    "e11_null_edge_level",          # permutation null model
    "e12_any_pair_edges",           # wide rows of all years
    "e17_biome_year_share",         # yearly rates per biome
    "e20_length_biome_table",       # three transect lengths in one plan
    "f01_site_trends",              # a regression per site
    "f05_rate_regressions",
    "f08_tukey_hsd_biome",
    "a04_slim_rewrite",             # sorted rewrite and read back
    "b03_quantile_cut",             # exact distributed quantile
    "c05_rasterise",
    "c11_largest_overlap",
    "c13_spaced_points",
    "c16_within_distance",          # spatial join
    "c19_good_transects",
    "d04_spectral_gradient",
    "d06_stacked_years",
]


def written_samples(spark, sf_dir: str) -> float:
    """Seconds of the yearly rates over samples read from files, in no useful order."""
    from pyspark.sql import functions as F

    from edgeline.operators import rates
    from edgeline.session import materialise
    from edgeline.sources.adapter import Views
    shuffled = Views(spark, sf_dir).samples().repartition(F.col("pnt_pst"), F.col("year"))
    samples = materialise(shuffled, "bench-samples")
    start = time.perf_counter()
    rates.site_years(samples).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from edgeline.plans.queries import runnable
    from edgeline.session import build_session
    spark = build_session("edgeline-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    # Start the JVM's and the Python workers' machinery outside the timings.
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        runnable(name)(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    if not sys.argv[1:]:
        seconds["written_samples_rates"] = written_samples(spark, sf_dir)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
