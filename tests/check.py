"""Compare every query with its SQL: python tests/check.py [folder] [name ...]"""

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def plain(col: pd.Series) -> pd.Series:
    """A column with nulls as objects, as pandas has whole numbers beside nulls in several types."""
    if not col.isna().any():
        return col
    whole = lambda v: int(v) if isinstance(v, float) and v.is_integer() else v
    return pd.Series([None if null else whole(v) for v, null in zip(col, col.isna())], dtype=object)


def difference(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} / {sorted(sql_df.columns)}"
    a, b = normal(spark_df).apply(plain), normal(sql_df).apply(plain)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    for c in a.columns:
        kinds = (a[c].dtype.kind, b[c].dtype.kind)
        if (kinds[0] == "f") != (kinds[1] == "f"):
            return f"type of {c}: {a[c].dtype} / {b[c].dtype}"
        wrong = (a[c].astype(object) != b[c].astype(object)) & ~(a[c].isna() & b[c].isna())
        if wrong.any():
            i = wrong.idxmax()
            return f"{int(wrong.sum())} values of {c}, first {a[c][i]!r} / {b[c][i]!r}"
    return None


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(e.queries())
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, oracle = duck(sf_dir), e.oracle_sql()
    bad = 0
    for name in names:
        begin = time.time()
        try:
            found = e.queries()[name](spark, sf_dir).toPandas()
            seconds = time.time() - begin
            verdict = "rows only"
            if name in oracle:
                begin = time.time()
                verdict = difference(found, con.execute(oracle[name]).df()) or "equal"
                verdict += f" (sql {time.time() - begin:.1f}s)"
        except Exception as err:  # noqa: BLE001
            seconds, verdict, found = time.time() - begin, f"ERROR {type(err).__name__}: {str(err)[:300]}", []
        bad += not verdict.startswith(("equal", "rows only"))
        print(f"{name:24s} {seconds:6.1f}s {len(found):7d} rows  {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
