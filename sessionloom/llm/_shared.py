"""What the operators share: the shared folder, written intermediate tables, block sizes."""

from __future__ import annotations

import ctypes
import os
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (single-machine runs and tests).
LOCAL_FALLBACK = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, from spark.checkpoint.dir."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        os.makedirs(LOCAL_FALLBACK, exist_ok=True)
        spark.sparkContext.setCheckpointDir(LOCAL_FALLBACK)
        found = f"file://{LOCAL_FALLBACK}"
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: df as a Parquet table in the shared folder, read again.

    A lost executor costs at most its running tasks, and Spark knows the table's size when it picks
    a join strategy.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def drop_written(df: DataFrame) -> None:
    """Removes a table made by written() that no later plan reads."""
    path = getattr(df, "_written_at", None)
    if path:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)


def unused(taken: Iterable[str], *names: str) -> list[str]:
    """Each name, with as many underscores behind it as keep it from those taken (compared without case)."""
    low, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in low:
            name += "_"
        low.add(name.lower())
        out.append(name)
    return out


def columns_of(df: DataFrame, names: Iterable[str] | None = None, alias: str = "") -> list[Column]:
    """Columns by name, whatever characters the names hold."""
    return [F.col(f"{alias}." * bool(alias) + "`" + c.replace("`", "``") + "`") for c in (df.columns if names is None else names)]


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns named by place, for functions of batches, which can't resolve names with dots."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df


def parts_of(texts: pa.Array, most_chars: int) -> list[tuple[int, int]]:
    """Ranges of rows of bounded text (one row at least)."""
    piece = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)) // most_chars
    cuts = np.r_[0, np.flatnonzero(piece[1:] != piece[:-1]) + 1, len(piece)].tolist()
    return [(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


_HELD: dict[str, Callable[[], None]] = {}


def hold(name: str, clear: Callable[[], None]) -> None:
    """Lets one operator at a time keep values in a reused Python worker: those of all others are given back."""
    others = [k for k in _HELD if k != name]
    for k in others:
        _HELD.pop(k)()
    _HELD[name] = clear
    if others:
        give_back()


_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and path of a URI; Hadoop's names of stores that pyarrow knows by another are translated."""
    scheme, _, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"{_SCHEMES[scheme]}://{rest}" if scheme in _SCHEMES else uri)


def give_back() -> None:
    """Returns a worker's free memory to the system, so that reused workers don't hold what earlier stages took."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
