"""Writers of reports: small tables as CSV, id lists and nested summaries. Tables without rows still get their header."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _flat(df: DataFrame, python_style: bool) -> DataFrame:
    """Arrays joined by ``;``; booleans as True and False if wanted."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("array"):
            c = F.array_join(c.cast("array<string>"), ";")
        elif kind == "boolean" and python_style:
            c = F.when(c, "True").when(~c, "False")
        out.append(c.alias(name))
    return df.select(*out)


def csv_report(df: DataFrame, path: str, order: list[str] | None = None, python_style: bool = True) -> None:
    """One CSV file with a header in a folder; for reports, whose size a reader bounds."""
    flat = _flat(df, python_style)
    rows = flat.orderBy(*order) if order else flat
    rows.coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def csv_table(df: DataFrame, path: str, python_style: bool = True) -> None:
    """The same for tables of any size: as many files as partitions, each with a header."""
    _flat(df, python_style).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def id_list(df: DataFrame, key: str, path: str, order: str | None = None) -> None:
    """One id a line."""
    rows = df.orderBy(order) if order else df
    rows.select(F.col(key).cast("string").alias("value")).coalesce(1).write.mode("overwrite").text(path)


def summary_json(parts: dict[str, object], path: str | None = None, most: int = 10_000) -> dict:
    """A nested summary: DataFrames become lists of their rows (one row: an object), and must be aggregates of at most ``most`` rows
    (an error beyond: nothing is left out). Written to ``path`` if one is given."""
    def plain(v):
        if isinstance(v, DataFrame):
            rows = [r.asDict(recursive=True) for r in v.limit(most + 1).collect()]
            if len(rows) > most:
                raise ValueError(f"a part of the summary has more than {most} rows: write it as a table")
            return rows[0] if len(rows) == 1 else rows
        return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v

    out = plain(parts)
    if path is not None:
        Path(path).write_text(json.dumps(out, indent=2, default=str) + "\n", encoding="utf-8")
    return out


def digest(summary: dict, keys: list[str], width: int = 100) -> str:
    """Chosen entries of a summary, a line each, cut to a width: for consoles."""
    return "\n".join(f"{k}: {json.dumps(summary.get(k), default=str)[:width]}" for k in keys)
