"""What the operators of this subpackage share: names, staging tables, word tables."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the separators that count as white space in lines and words.
BLANKS = " \t\n\x0b\x0c\r"
#: Fixed value: bytes that belong to an alphanumeric word; other bytes separate.
WORD_BYTES = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df_or_columns, *bases: str) -> list[str]:
    """Column names that clash with none of the given ones, whatever their case."""
    columns = getattr(df_or_columns, "columns", df_or_columns)
    used, out = {c.lower() for c in columns}, []
    for base in bases:
        name, k = f"_{base}", 0
        while name.lower() in used:
            k += 1
            name = f"_{base}_{k}"
        used.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where a session names none it is a temporary one, but only in local mode, as in
    tests; on a cluster that would be a folder that executors cannot see."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lodeseam-")
        spark.sparkContext.setCheckpointDir(named)
        spark.conf.set("spark.checkpoint.dir", named)
    return named if re.match(r"\w+:/", named) else f"file://{named}"


#: Arrow batches hold about so many bytes, unless the session names a bound of its own.
BATCH_BYTES = "4m"


def batched(df: DataFrame) -> DataFrame:
    """df, its session's Arrow batches bounded: by default one holds 10,000 rows, however long their texts are."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "1b") == "1b":
        conf.set(key, BATCH_BYTES)
    return df


def _give_back() -> None:
    """What a worker has freed goes back to the system, so that idle workers do not add up."""
    pa.default_memory_pool().release_unused()
    with suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches in parts, so that a worker holds Python copies of a few rows only; memory goes back at the end."""
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            yield batch.slice(s, rows)
    _give_back()


def staged(df: DataFrame, tag: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends here, and any executor can go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def share(column: Column) -> Column:
    """A hash of the column, from 0 up to 1."""
    return F.pmod(F.xxhash64(column), F.lit(1 << 53)) / float(1 << 53)


def smallest_hashes(ids: DataFrame, n: int) -> DataFrame:
    """The distinct ids of the n smallest hashes. Most rows are left out before anything is sorted or sent, whatever the size."""
    (c,) = ids.columns
    total = ids.count()
    few = ids.where(F.col(c).isNotNull() & (share(F.col(c)) <= min(1.0, 4 * n / max(1, total)))).distinct()
    return few.orderBy(share(F.col(c)), c).limit(n)


def hash128(*columns: Column) -> list[Column]:
    """Two independent 64-bit hashes."""
    return [F.xxhash64(*columns), F.xxhash64(F.lit("second"), *columns)]


def sha(column: Column) -> Column:
    return F.sha2(column, 256)
