"""Compare queries with their SQL on one folder of tables: python tests/oracle_check.py [folder] [name ...]."""

import datetime
import decimal
import math
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (datetime.datetime, datetime.date)):
        return str(x)
    return x


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=str)


def compare(spark, folder, names=None):
    import duckdb

    import __spark_entry__ as e

    db = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        db.execute(f"create view {p.stem} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    bad = {}
    for name, sql in e.oracle_sql().items():
        if names and name not in names:
            continue
        try:
            df = e.queries()[name](spark, folder)
            mine = rows(df.columns, [tuple(r) for r in df.collect()])
            cursor = db.execute(sql)
            columns = [c[0] for c in cursor.description]
            theirs = rows(columns, cursor.fetchall())
            if sorted(df.columns) != sorted(columns):
                bad[name] = f"columns {sorted(df.columns)} and {sorted(columns)}"
            elif mine != theirs:
                bad[name] = f"{len(mine)} and {len(theirs)} rows; first that differ: {next(((a, b) for a, b in zip(mine, theirs) if a != b), None)}"
        except Exception as error:
            bad[name] = f"{type(error).__name__}: {str(error)[:600]}"
    return bad


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name, why in compare(spark, sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]).items():
        print("DIFFERS", name, why[:900])
    print("compared")
