"""Readers: stored tables, JDBC, landed JSON pages, catalogue, named relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """A query pushed to a database; the driver's jar and the credentials come from the caller."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def landed_pages(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Records of landed API pages {data: [...], links: {next}}; all fields as text, numbered by page and place."""
    row = StructType([StructField(c, StringType()) for c in columns])
    schema = StructType([StructField("data", ArrayType(row))])
    pages = spark.read.schema(schema).option("multiLine", "true").json(path).withColumn("page", F.input_file_name())
    return pages.select("page", F.posexplode("data").alias("place", "r")).select("page", "place", "r.*")


def json_records(texts: DataFrame, column: str, schema: str) -> DataFrame:
    """A text column parsed leniently: what does not parse is null."""
    return texts.withColumn(column, F.from_json(column, schema, {"mode": "PERMISSIVE"}))


def list_columns(spark: SparkSession, view: str) -> list[str]:
    return [c.name for c in spark.catalog.listColumns(view)]


def relation(frame: DataFrame, name: str) -> DataFrame:
    """Make a frame known to SQL under a name for this session; a name that exists is replaced."""
    frame.createOrReplaceTempView(name)
    return frame.sparkSession.table(name)
