"""Compare registered queries with their SQL in DuckDB: python tools/check_sql.py SF [name ...]."""

import pathlib
import sys
import time

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

import duckdb

from poseweave.plans.catalog import load_all
from poseweave.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return pdf.sort_values(list(pdf.columns), kind="stable").reset_index(drop=True)


def compare(spark_pdf, duck_pdf):
    if sorted(spark_pdf.columns) != sorted(duck_pdf.columns):
        return f"columns {sorted(spark_pdf.columns)} != {sorted(duck_pdf.columns)}"
    if len(spark_pdf) != len(duck_pdf):
        return f"rows {len(spark_pdf)} != {len(duck_pdf)}"
    a, b = normal(spark_pdf), normal(duck_pdf)
    kinds = {c: (a[c].dtype.kind, b[c].dtype.kind) for c in a if a[c].dtype.kind != b[c].dtype.kind}
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            at = (~same).idxmax()
            return f"{c}: {(~same).sum()} differ, first\n{a.loc[at].to_dict()}\n{b.loc[at].to_dict()}"
    return f"kinds {kinds}" if kinds else None


def main():
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    catalog = load_all()
    names = sys.argv[2:] or list(catalog)
    bad = 0
    for name in names:
        entry = catalog[name]
        start = time.time()
        try:
            got = entry.build(spark, sf_dir).toPandas()
        except Exception as error:
            print(f"FAIL {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
            bad += 1
            continue
        took = time.time() - start
        if entry.sql is None:
            print(f"ok   {name} rows={len(got)} {took:.1f}s (rows only)", flush=True)
            continue
        start = time.time()
        try:
            want = duck(sf_dir).execute(entry.sql).df()
            problem = compare(got, want)
        except Exception as error:
            problem = f"duckdb {str(error)[:800]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} rows={len(got)} {took:.1f}s duck={time.time() - start:.1f}s {problem or ''}",
              flush=True)
    sys.exit(bool(bad))


if __name__ == "__main__":
    main()
