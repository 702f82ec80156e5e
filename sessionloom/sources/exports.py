"""Sinks: CSV with a byte-order mark, spreadsheet-safe CSV with side files, result tables, checkpoints."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.functions import text as T

BLOB_COLUMNS = ["agent_response", "generated_code"]
ID_COLUMNS = ["full_name", "source_file", "turn_index", "prompt_text"]
MOST_INLINE = 30_000


def spreadsheet(df: DataFrame, blob_dir: str, most: int = MOST_INLINE, prompts_only: bool = False) -> DataFrame:
    """The spreadsheet view: long texts become previews, with their side file's path and a truncated flag."""
    if prompts_only:
        gone = [*BLOB_COLUMNS, *[f"{c}_length" for c in BLOB_COLUMNS], *[f"{c}_{x}" for c in BLOB_COLUMNS for x in ("blob_path", "truncated")]]
        return df.drop(*gone)
    out = df
    for c in [c for c in BLOB_COLUMNS if c in df.columns]:
        long = F.length(T.text(c)) > most
        out = out.withColumns({
            f"{c}_blob_path": F.when(long, F.concat(F.lit(f"{blob_dir.rstrip('/')}/"), T.blob_id(ID_COLUMNS, c), F.lit(f"_{c}.txt"))).otherwise(""),
            f"{c}_truncated": long,
        })
    return out.withColumns({c: T.preview(c, most) for c in BLOB_COLUMNS if c in df.columns})


def blobs(df: DataFrame, most: int = MOST_INLINE) -> DataFrame:
    """blob_id, column, value of the long texts: one row a side file."""
    parts = [
        df.where(F.length(T.text(c)) > most).select(T.blob_id(ID_COLUMNS, c).alias("blob_id"), F.lit(c).alias("column"), F.col(c).alias("value"))
        for c in BLOB_COLUMNS
        if c in df.columns
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def write_blobs(df: DataFrame, folder: str, most: int = MOST_INLINE) -> None:
    """Side files in any store that pyarrow's file systems know; a task that runs again writes the same names."""

    def write(rows) -> None:
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        for r in rows:
            with fs.open_output_stream(f"{base}/{r['blob_id']}_{r['column']}.txt") as f:
                f.write(r["value"].encode())

    blobs(df, most).foreachPartition(write)


def write_csv(df: DataFrame, path: str, bom: bool = True, quote_all: bool = True) -> None:
    """Parts of a CSV dataset; the byte-order mark stands before the first header cell of each part."""
    named = df.withColumnRenamed(df.columns[0], "﻿" + df.columns[0]) if bom else df
    named.write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A result table as Markdown, doubles to four places; a longer table's first rows, and a line that says so."""
    rows = df.limit(most + 1).collect()
    note = f"\n{most} of {df.count()} rows; the table itself holds them all.\n" if len(rows) > most else ""
    rows = rows[:most]
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *["| " + " | ".join(cell(v) for v in r) + " |" for r in rows]]) + "\n" + note


def write_results(df: DataFrame, folder: str) -> None:
    """A result table as CSV and as Markdown."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder.rstrip('/')}/csv")
    df.sparkSession.createDataFrame([(markdown(df),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/markdown")


def checkpointed(df: DataFrame, path: str) -> DataFrame:
    """Overwrites the partial result and reads it again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def relocated(df: DataFrame, folder: str, columns: list[str]) -> DataFrame:
    """Path columns point into another folder; blank ones stay."""
    base = lambda c: F.element_at(F.split(F.replace(F.col(c), F.lit("\\"), F.lit("/")), "/"), -1)
    return df.withColumns({c: F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(folder.rstrip("/") + "/"), base(c))).otherwise(F.col(c)) for c in columns if c in df.columns})


def write_analysis(tables: dict[str, DataFrame], folder: str) -> None:
    """Small tables of a dataset's analysis: each as CSV, all of them in one JSON summary."""
    summary = {}
    for name, df in tables.items():
        write_csv(df.coalesce(1), f"{folder.rstrip('/')}/{name}")
        summary[name] = [r.asDict(recursive=True) for r in df.limit(1000).collect()]  # the CSV holds every row
    text = json.dumps(summary, indent=2, default=str)
    next(iter(tables.values())).sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder.rstrip('/')}/summary")


def english_view(df: DataFrame, columns: list[str], max_rows: int | None = None, order: str = "row_id") -> DataFrame:
    """Translated text columns first, the others after them; with max_rows, an option of the caller, the first rows by order."""
    df = df if max_rows is None else df.orderBy(order).limit(max_rows)
    first = [f"{c}_en" for c in columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def with_preview(df: DataFrame, column: str, most: int = MOST_INLINE) -> DataFrame:
    return df.withColumn(f"{column}_preview", T.preview(column, most))


def blob_id(column: str) -> Column:
    return T.blob_id(ID_COLUMNS, column)
