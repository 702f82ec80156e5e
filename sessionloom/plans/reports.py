"""Markdown reports from result tables; each table is bounded before it reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame

from sessionloom.sources import exports


def report(title: str, tables: dict[str, DataFrame], most: int = 50, notes: dict[str, str] | None = None) -> str:
    """A section a table, at most `most` rows each."""
    parts = [f"# {title}\n"]
    for name, df in tables.items():
        parts += [f"## {name.replace('_', ' ').capitalize()}\n", *( [f"{notes[name]}\n"] if notes and name in notes else []), exports.markdown(df, most)]
    return "\n".join(parts)


def write_report(title: str, tables: dict[str, DataFrame], path: str, most: int = 50) -> None:
    """As one text dataset, in any store that Spark writes to."""
    first = next(iter(tables.values()))
    first.sparkSession.createDataFrame([(report(title, tables, most),)], "value string").coalesce(1).write.mode("overwrite").text(path)
