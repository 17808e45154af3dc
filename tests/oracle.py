"""Compare a query's rows with those of its DuckDB statement."""

from collections import Counter
from pathlib import Path


def database(sf_dir):
    import duckdb

    db = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    return db


def rows_of(df):
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())


def _plain(x):
    return tuple(map(_plain, x)) if isinstance(x, (list, tuple)) else bytes(x) if isinstance(x, bytearray) else x


def sql_rows(db, statement):
    found = db.execute(statement)
    names = [c[0] for c in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in found.fetchall())


def difference(df, db, statement):
    """None if both have the same columns and rows."""
    (a, x), (b, y) = rows_of(df), sql_rows(db, statement)
    if a != b:
        return f"columns {a} and {b}"
    if x != y:
        return f"{sum(x.values())} and {sum(y.values())} rows; only here {list((x - y).items())[:2]}; only there {list((y - x).items())[:2]}"
    return None
