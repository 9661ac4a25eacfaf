"""Run queries against their SQL in DuckDB and report differences."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from .oracles import build
from .queries import QUERIES

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows_of(frame) -> list:
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted((tuple(r) for r in frame.itertuples(index=False)),
                  key=lambda r: tuple((v is not None, str(v)) for v in r))


def difference(spark: SparkSession, con, sf_dir: str, name: str) -> str:
    """Empty if equal, else what differs."""
    start = time.time()
    got = rows_of(QUERIES[name](spark, sf_dir).toPandas())
    took = time.time() - start
    want = rows_of(con.execute(build(name)).df())
    print(f"{name}: {len(got)} rows, spark {took:.1f}s, sql {time.time() - start - took:.1f}s", flush=True)
    if len(got) != len(want):
        return f"{len(got)} rows instead of {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return f"{len(bad)} rows differ, e.g. {bad[0]}" if bad else ""


def session(cpus: str = "8") -> SparkSession:
    return (SparkSession.builder.master(f"local[{cpus}]")
            .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
            .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
            .config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate())


def main() -> None:
    sf_dir = sys.argv[1]
    spark, con = session(), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    failed = {}
    for name in sys.argv[2:] or list(QUERIES):
        try:
            diff = difference(spark, con, sf_dir, name)
        except Exception as e:
            diff = f"{type(e).__name__}: {str(e)[:700]}"
        if diff:
            failed[name] = diff
            print(f"  DIFFERS {diff[:900]}", flush=True)
    print(f"{len(failed)} differ: {sorted(failed)}")


if __name__ == "__main__":
    main()
