"""Run registered queries in Spark and DuckDB and compare whole results.

``python tests/compare.py <sf_dir> [name-prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


TIMES: list[float] = []     # when Spark had finished, per compared query


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.6f}"
    if isinstance(value, list):
        return "[" + ",".join(str(_cell(x)) for x in value) + "]"
    return "~" if value is None else str(value)


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(spark_df, con, sql) -> tuple[int, str]:
    """Row count of the Spark result and a description of the first difference."""
    got_cols, rows = spark_df.columns, [tuple(r) for r in spark_df.collect()]
    TIMES.append(time.time())
    rel = con.execute(sql)
    want_cols = [d[0] for d in rel.description]
    want = rel.fetchall()
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
             "boolean": "BOOLEAN", "date": "DATE"}
    if sorted(got_cols) != sorted(want_cols):
        return len(rows), f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    types = {d[0]: str(d[1]) for d in rel.description}
    wrong = [f"{c}: {t} vs {types[c]}" for c, t in spark_df.dtypes
             if kinds.get(t, t) != types[c] and not t.startswith("array")]
    if wrong:
        return len(rows), "types " + "; ".join(wrong)
    a, b = canonical(got_cols, rows), canonical(want_cols, want)
    if a != b:
        only_a, only_b = set(a) - set(b), set(b) - set(a)
        return len(rows), (f"rows {len(a)} vs {len(b)}; {len(only_a)} only Spark e.g. "
                           f"{sorted(only_a)[:2]}; {len(only_b)} only SQL e.g. "
                           f"{sorted(only_b)[:2]}")
    return len(rows), ""


def main() -> int:
    import __spark_entry__ as contract
    from edgeline.session import build_session
    sf_dir, prefixes = sys.argv[1], tuple(sys.argv[2:])
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                                "spark.ui.enabled": "false",
                                                "spark.driver.memory": "8g",
                                                "spark.log.level": "ERROR",
                                                "spark.ui.showConsoleProgress": "false"})
    con, bad = connect(sf_dir), 0
    oracles = contract.oracle_sql()
    for name, run in contract.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                n, problem = differences(df, con, oracles[name])
                status = problem and "DIFF " + problem[:1500] or "ok"
            else:
                n, status = len(df.collect()), "rows only"
        except Exception as error:  # report and go on with the next query
            n, status = -1, f"ERROR {type(error).__name__} {str(error)[:1500]}"
        bad += status.startswith(("DIFF", "ERROR")) or n == 0
        print(f"{name:40s} {n:8d} rows {time.time() - start:6.1f}s "
              f"(Spark {(TIMES[-1] if TIMES and TIMES[-1] > start else time.time()) - start:5.1f})"
              f"  {status}", flush=True)
    print("problems:", bad)
    spark.stop()
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
