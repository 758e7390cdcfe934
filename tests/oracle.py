"""Holds a query against its SQL on the same tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd


def views(folder: str) -> duckdb.DuckDBPyConnection:
    """A connection with the tables of a folder."""
    connection = duckdb.connect()
    connection.sql("SET TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return connection


def rows(frame: pd.DataFrame) -> list[tuple]:
    """Rows in an order of their own, columns by name, numbers to nine places."""

    def plain(v: object) -> str:
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and not hasattr(v, "as_py") and getattr(v, "shape", ()):
            return str([plain(x) for x in v])
        if v is None or v is pd.NaT or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v)).lower()
        try:
            number = float(v)  # type: ignore[arg-type]
            return f"{number:.9g}" if not isinstance(v, str) else v
        except (TypeError, ValueError):
            return str(pd.Timestamp(v)) if "datetime" in type(v).__name__ or isinstance(v, pd.Timestamp) else str(v)

    names = sorted(frame.columns)
    return sorted(tuple(plain(v) for v in row) for row in frame[names].astype(object).itertuples(index=False))


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str:
    """What differs, empty if nothing does."""
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(sql_frame.columns)}"
    a, b = rows(spark_frame), rows(sql_frame)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; only first: {sorted(set(a) - set(b))[:3]}; only second: {sorted(set(b) - set(a))[:3]}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, such as {bad[:3]}" if bad else ""
