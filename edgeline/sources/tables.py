"""Reading and writing the engine's tables.

Readers take an explicit schema: inference costs a pass over the data and turns
identifier columns into numbers in some files.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from edgeline.session import parts_for


def read_table(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv",
               glob: str | None = None, recursive: bool = False) -> DataFrame:
    """One table from a file or from every matching file of a folder."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    return reader.load(path)


def stack(tables: Sequence[DataFrame]) -> DataFrame:
    """Stack tables of differing columns by name; a missing column is NULL."""
    out = tables[0]
    for table in tables[1:]:
        out = out.unionByName(table, allowMissingColumns=True)
    return out


#: Files that a task keeps open at a time; with more values of a partition column it sorts.
OPEN_FILES = "16"


def write_table(df: DataFrame, path: str, fmt: str = "csv", partition_by: Sequence[str] = (),
                max_rows: int | None = None, compression: str | None = None) -> str:
    """Write a table; ``max_rows`` splits the output into shards of that many rows.

    Up to ``OPEN_FILES`` values of ``partition_by`` are written beside each other, so the
    rows are not sorted and spilled for them.
    """
    writer = df.write.format(fmt)
    if compression:
        writer = writer.option("compression", compression)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if max_rows:
        writer = writer.option("maxRecordsPerFile", max_rows)
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    if partition_by:
        conf.set(name, OPEN_FILES)
    try:
        writer.save(path)
    finally:
        conf.set(name, before)
    return path


#: Bits that count the rows of one packed block, which bound what a packed row holds.
PACKED_BITS = 16


def _packed(rows: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """One row for the rows of a key that lie near each other, their values as arrays.

    An array holds values of one kind side by side, without the width and the key of a row
    for each, so a shuffle of packed rows writes far fewer bytes. Rows that are laid out by
    the key already are packed where they are, others are moved for it once.
    """
    block = F.shiftright(F.monotonically_increasing_id(), PACKED_BITS)
    packed = (rows.withColumn("__block", block).groupBy(*by, "__block")
              .agg(F.collect_list(F.struct(*values)).alias("__rows")))
    return packed.select(*by, *[F.col(f"__rows.{c}").alias(c) for c in values])


def slim_samples(raw: DataFrame, parts: int | None = None) -> DataFrame:
    """The five analysis columns, globally sorted by site, transect, year, point.

    Ranges are cut on (site, transect), so a site with many transects spreads
    over several tasks, and rows of one transect stay in one file for the
    map-side combine of later steps. ``parts`` is the number of ranges, for tables whose
    ranges would not fit a task's memory otherwise and be spilled. Samples go to their range
    packed by transect.
    """
    by, values = ["site_id", "transect_id"], ["pnt_pst", "year", "grad"]
    # Packed rows unfold: a fixed number keeps the runtime from merging ranges by their bytes.
    ranges = _packed(raw.select(*by, *values), by, values).repartitionByRange(
        parts or parts_for(raw.sparkSession, 0), *by)
    return (ranges.select(*by, F.inline(F.arrays_zip(*values)))
            .sortWithinPartitions("site_id", "transect_id", "year", "pnt_pst"))


def attach(geometry: DataFrame, results: DataFrame, on: str = "site_id") -> DataFrame:
    """Left join of results onto a geometry table."""
    return geometry.join(results, on, "left")


def replace_partitions(df: DataFrame, path: str, by: str, fmt: str = "parquet") -> str:
    """Write a table by the values of a column, replacing the partitions that ``df`` holds.

    A rerun of one year so replaces that year and leaves the others as they are, and a
    run that is repeated after a failure leaves no row twice.
    """
    (df.write.format(fmt).mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(by).save(path))
    return path


class StageAudit:
    """Rows, distinct keys and a column sum of stages, emitted while they are computed.

    ``watch`` passes a stage on and counts what flows by; the numbers are there once a job
    has run all of it, and ``table`` returns them. A stage is counted exactly once where it
    is watched behind its last shuffle, as rerun tasks of a written result count once.

    Distinct values of ``key`` are counted by the first row of each. Rows are dealt by key
    for that, once for all filters behind it, so a key must not hold many rows; the keys of
    other stages are counted with map-side combine on the written stage by ``count_keys``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._seen: dict[str, Observation] = {}
        self._keys: dict[str, int] = {}

    def watch(self, df: DataFrame, stage: str, key: str | None = None,
              total: Column | None = None) -> DataFrame:
        seen = self._seen[stage] = Observation(stage)
        first = F.lit(False)
        if key is not None:
            first = ((F.row_number().over(Window.partitionBy(key).orderBy(key)) == 1)
                     & F.col(key).isNotNull())
        value = (total if total is not None else F.lit(None)).cast("double")
        return (df.withColumn("__first", first).observe(
            seen, F.count(F.lit(1)).alias("n_rows"), F.count_if("__first").alias("n_ids"),
            F.sum(value).alias("total")).drop("__first"))

    def count_keys(self, stage: str, written: DataFrame, key: str) -> None:
        self._keys[stage] = written.agg(F.count_distinct(key)).collect()[0][0]

    def table(self) -> DataFrame:
        """One row per watched stage; waits for a stage whose job has not ended."""
        rows = [(stage, seen.get["n_rows"], self._keys.get(stage, seen.get["n_ids"]),
                 seen.get["total"]) for stage, seen in self._seen.items()]
        return self.spark.createDataFrame(
            rows, "stage string, n_rows long, n_ids long, total double")
