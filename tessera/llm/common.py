"""Helpers shared by the training-data operators: shared storage, column picking, size-checked broadcasts."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table may be broadcast or collected; callers state why their rows are of bounded width.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share.

    Where the setting is absent a temporary folder is made and the setting filled in, in a local session only: on a
    cluster other machines couldn't read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set; it must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, found by exact name first, so further columns (also `TEXT` beside `text`) never clash."""
    have = df.columns
    at = []
    for n in names:
        found = [i for i, c in enumerate(have) if c == n] or [i for i, c in enumerate(have) if c.lower() == n.lower()]
        if not found:
            raise ValueError(f"column {n} is missing from {have}")
        at.append(found[0])
    return df.toDF(*[f"_{i}" for i in range(len(have))]).select(*[F.col(f"_{i}").alias(n) for i, n in zip(at, names, strict=True)])


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if its counted rows are within limit; else df as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def sha_of_list(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def texts_of(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut into runs of rows whose texts come to about `limit` bytes: bounds the memory of Python objects."""
    for b in batches:
        lens = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lens) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if hi > lo:
                yield b.slice(lo, hi - lo)
