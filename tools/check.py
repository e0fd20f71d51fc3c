"""Run registered queries in Spark and their oracles in DuckDB and compare all rows.

    python tools/check.py [--sf DIR] [name ...]     names may be prefixes
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb
from pyspark.sql import SparkSession

from cargoloom.operators.ordering import release
from cargoloom.registry import all_oracles, all_queries
from cargoloom.sources.erp_views import DRIVER_TABLES
from cargoloom.sources.tables import StarSchemaTables


def session() -> SparkSession:
    spark = (SparkSession.builder.master("local[8]").appName("check")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> int:
    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="/root/testdata/sf0.01")
    args.add_argument("names", nargs="*")
    opt = args.parse_args()
    spark, con = session(), duckdb.connect()
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{opt.sf}/{t}.parquet'")
    oracles, bad, tables = all_oracles(), 0, StarSchemaTables(spark, opt.sf)
    for name, run in all_queries().items():
        if opt.names and not any(name.startswith(n) for n in opt.names):
            continue
        started = time.time()
        try:
            for t in DRIVER_TABLES:
                tables.get(t)  # looks the tables' columns up
            spark.sparkContext.setJobGroup(name, name)
            df = run(spark, opt.sf)
            if jobs := len(spark.sparkContext.statusTracker().getJobIdsForGroup(name)):
                print(f"JOBS {name} {jobs} while its plan was built")
            cols, rows = df.columns, [tuple(r) for r in df.collect()]
            took = time.time() - started
            if len(set(c.lower() for c in cols)) != len(cols):
                raise ValueError(f"duplicate columns {cols}")
            if name not in oracles:
                print(f"rows-only {name} {len(rows)} rows {took:.1f}s")
                continue
            res = con.execute(oracles[name])
            names, want = [d[0] for d in res.description], res.fetchall()
            def norm(cs, rs):
                order = sorted(range(len(cs)), key=lambda i: cs[i])
                return sorted(tuple(repr(r[i]) for i in order) for r in rs)
            a, b = norm(cols, rows), norm(names, want)
            if sorted(cols) != sorted(names):
                bad += 1
                print(f"COLUMNS {name} spark-only={set(cols) - set(names)} oracle-only={set(names) - set(cols)}")
            elif a != b:
                bad += 1
                sa, sb = set(a), set(b)
                print(f"DIFF {name} rows {len(a)} vs {len(b)}\n  cols  {sorted(cols)}\n  spark  {sorted(sa - sb)[:2]}\n  oracle {sorted(sb - sa)[:2]}")
            else:
                print(f"ok {name} {len(rows)} rows {took:.1f}s" + ("" if rows else "  EMPTY"))
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"ERROR {name}: {str(e)[:700]}")
        release()
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
