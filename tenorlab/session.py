"""Session and settings."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def build_session(app: str = "tenorlab", **conf: str) -> SparkSession:
    """A session with UTC time, ANSI semantics and adaptive execution; ``conf`` overrides."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=settings).getOrCreate()


def setting(name: str, default: str | None = None) -> str | None:
    """A location from the environment (TENORLAB_<NAME>); no default ever holds a secret and nothing is logged."""
    return os.environ.get(f"TENORLAB_{name.upper()}", default)


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or 'file:///tmp/checkpoints').rstrip('/')}/tenorlab/{tag}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file_system(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> None:
    fs, p = _file_system(spark, path)
    if not fs.rename(p, _file_system(spark, to)[1]):
        raise OSError(f"{path} cannot be moved to {to}")
