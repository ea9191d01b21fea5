"""Spark results against DuckDB's on the same Parquet tables."""

import math
from pathlib import Path

import duckdb


def rows(columns, records):
    """Rows as sortable tuples, columns by name; whole numbers of any width are equal."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return (0, "")
        if isinstance(v, bool):
            return (1, str(v))
        return (2, repr(float(v))) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else (3, str(v))

    return sorted(tuple(plain(r[i]) for i in order) for r in records)


def expected(sql, sf_dir):
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return sorted(columns), rows(columns, found.fetchall())


def actual(df):
    return sorted(df.columns), rows(df.columns, [tuple(r) for r in df.collect()])
