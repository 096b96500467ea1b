"""Compare registered queries with their SQL on DuckDB, the way the driver does."""

import glob
import os

import duckdb
import pandas as pd


def connection(sf_dir: str):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{f}'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            kinds = {type(v).__name__ for v in df[c].dropna()}
            if kinds <= {"Decimal", "float", "int"}:
                df[c] = df[c].astype(float)
        if str(df[c].dtype).lower().startswith(("int", "uint")):
            df[c] = df[c].astype(float)
        if str(df[c].dtype).startswith("float"):
            df[c] = df[c].round(6) + 0.0
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    got, want = spark_df.toPandas(), con.execute(sql).fetchdf()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = int((~same).to_numpy().argmax())
            return f"{c}: {int((~same).sum())} differ, first {a.loc[i].to_dict()} != {b.loc[i].to_dict()}"
    kinds = {c: (str(got[c].dtype), str(want[c].dtype)) for c in got.columns if str(got[c].dtype) != str(want[c].dtype)}
    return f"types {kinds}" if kinds else None
