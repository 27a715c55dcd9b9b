"""Helpers shared by the training-data operators: table access, shared-folder tables, let-binding, numpy text hashing."""

from __future__ import annotations

import gc
import os
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule [^\x20\x09-\x0D]+.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: Used only where the session names no shared folder (tests, a laptop).
OWN_CHECKPOINT_DIR = "file:///tmp/checkpoints"


def ship_code(spark: SparkSession) -> None:
    """Let Python workers find this package where it lies beside the driver's; on a cluster without it, pass it by --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, (env.get("PYTHONPATH"), root)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; our own one only where it is unset and there is one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or OWN_CHECKPOINT_DIR).rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive any executor."""
    path = f"{shared_dir(df.sparkSession)}/tables/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def write_shared(spark: SparkSession, name: str, data: bytes) -> str:
    """Write a file to the shared folder, through Spark's file systems; its path."""
    path = f"{shared_dir(spark)}/files/{name}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def drop_table(df: DataFrame) -> None:
    """Delete a materialized table that nothing reads any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        jvm, spark = df.sparkSession._jvm, df.sparkSession
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished jobs, which else stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


# --- numpy text hashing ------------------------------------------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on uint64 (wraps by design)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX2
    return x ^ (x >> np.uint64(31))


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    """1, B, B**2 ... modulo 2**64."""
    global _powers
    while len(_powers) < n:
        last = _powers[-1] * np.uint64(_BASE)
        _powers = np.concatenate([_powers, _powers * last])
    return _powers[:n]


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes -> (start byte of each white-space separated word, 64-bit hash of its bytes)."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    inside = ~is_space(data)
    edge = np.diff(np.concatenate([[0], inside.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    length = ends - starts
    # position of each byte in its word, so that equal words hash alike wherever they stand
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data)))) if starts[0] == 0 else None
    if at is None:
        at = np.concatenate([np.zeros(starts[0], np.int64), np.arange(starts[0], len(data)) - np.repeat(starts, np.diff(np.append(starts, len(data))))])
    term = (data.astype(np.uint64) + np.uint64(1)) * powers(int(at.max()) + 1)[at]
    term[~inside] = 0
    return starts, mix64(np.add.reduceat(term, starts) ^ (length.astype(np.uint64) << np.uint64(48)))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z in UTF-8 bytes; no other character changes."""
    return np.where((data >= 65) & (data <= 90), data + 32, data)
