"""Runs registered queries beside their DuckDB SQL: python tests/compare.py [sf] [name...]."""

import os
import sys
import time

import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("NULL" if x is None or x is pd.NA or x != x else str(int(x)) if isinstance(x, float) and x.is_integer() else str(x) for x in row) for row in frame.itertuples(index=False))


def main(args):
    import duckdb
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = args[0] if args and args[0].startswith("sf") else "sf0.01"
    names = [a for a in args if a != sf]
    path = f"/root/testdata/{sf}"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    duck = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        duck.execute(f"create view {t} as select * from '{path}/{t}.parquet'")
    bad = []
    oracles = entry.oracle_sql()
    for name, query in entry.queries().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            mine = query(spark, path).toPandas()
            took = time.time() - began
            if name not in oracles:
                print(f"{name}: {len(mine)} rows, no SQL, {took:.1f} s")
                if names:
                    print(mine.head(8).to_string())
                continue
            theirs = duck.execute(oracles[name]).df()
            a, b = rows_of(mine), rows_of(theirs)
            ok = sorted(mine.columns) == sorted(theirs.columns) and a == b
            print(f"{name}: {'ok' if ok else 'DIFFERS'} {len(a)} {len(b)} rows, {took:.1f} s", flush=True)
            if not ok:
                bad.append(name)
                print("  ", sorted(mine.columns), sorted(theirs.columns))
                for x, y in [(x, y) for x, y in zip(a, b) if x != y][:3]:
                    print("  ", x, "\n  ", y)
        except Exception as e:
            bad.append(name)
            print(f"{name}: ERROR {str(e)[:700]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
