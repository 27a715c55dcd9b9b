"""Loads into stored tables: full refresh, incremental append, insert-ignore and upsert, as plans over plain files."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tenorlab.session import exists, move, remove

#: Securities of one vendor request.
BATCH_SECURITIES = 5


def high_water_mark(table: DataFrame | None, column: str):
    """The largest value of ``column``; None where the table is missing or empty."""
    return None if table is None else table.agg(F.max(column)).first()[0]


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; the order must be total for a fixed result."""
    last = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("__r", F.row_number().over(last)).where(F.col("__r") == 1).drop("__r")


def align(rows: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, in its order and types; missing ones are null, unknown ones go."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in like.schema])


def insert_ignore(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The rows to append: incoming rows whose key is not there yet, of each key the first by ``order``. A null in a key never conflicts.

    Without an order the row of the least values stays, so that a run again gives the same.
    """
    fresh = align(incoming, existing)
    order = list(order) or [c for c in fresh.columns if c not in keys]
    whole = F.struct(*[F.col(c) for c in fresh.columns])
    clash = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    first = fresh.where(clash).groupBy(*keys).agg(F.min_by(whole, F.struct(*order, *[c for c in fresh.columns if c not in order])).alias("row")).select("row.*")
    return first.join(existing.select(*keys).distinct(), list(keys), "left_anti").select(*fresh.columns).unionByName(fresh.where(~clash))


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], stay: Sequence[str] = ("created_at",)) -> DataFrame:
    """The table after the upsert: incoming rows replace values, nulls included; ``stay`` columns keep their first value.

    Both sides are unique on ``keys``. One shuffle on the keys: both versions of a row meet in one aggregation.
    """
    both = existing.withColumn("__new", F.lit(0)).unionByName(align(incoming, existing).withColumn("__new", F.lit(1)))
    values = [c for c in existing.columns if c not in keys]
    pick = lambda c: (F.min_by if c in stay else F.max_by)(F.struct(c), "__new")[c].alias(c)  # noqa: E731  a struct is never null, so a null value can win
    return both.groupBy(*keys).agg(*[pick(c) for c in values]).select(*existing.columns)


def incremental(source: DataFrame, sink: DataFrame | None, ts: str = "ts", lookback_days: int = 0) -> DataFrame:
    """The rows of ``source`` to load: all when the sink is empty, else those after its high-water mark.

    With ``lookback_days`` they overlap the sink and belong into an upsert; appended, they would be there twice.
    """
    mark = high_water_mark(sink, ts)
    return source if mark is None else source.where(F.col(ts) > F.date_sub(F.lit(mark), lookback_days))


def incremental_by_key(source: DataFrame, sink: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """The rows of ``source`` after their own key's last time in the sink; a key that is new there comes whole."""
    marks = sink.groupBy(F.col(key).alias("known")).agg(F.max(ts).alias("mark"))
    later = source.join(marks, F.col(key).eqNullSafe(F.col("known")), "left").where(F.col("mark").isNull() | (F.col(ts) > F.col("mark")))
    return later.select(*source.columns)


def build(source: Callable[[], DataFrame], sink: DataFrame | None, mode: str = "incremental", ts: str = "ts") -> tuple[str, DataFrame | None]:
    """What a run does: ('full', rows), ('append', rows) or ('nothing', None)."""
    rows = source()
    newest = high_water_mark(rows, ts)
    if newest is None:
        return "nothing", None
    mark = high_water_mark(sink, ts)
    if mode == "full" or mark is None:
        return "full", rows
    return ("nothing", None) if mark >= newest else ("append", rows.where(F.col(ts) > F.lit(mark)))


def full_refresh(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Replace the table at ``path``; rows may be read from it.

    The new table is written whole beside the old one, which is moved aside only then: a failed write leaves the old table, and a failure
    between the two moves leaves both, under ``path`` with .new and .old.
    """
    spark, fresh, old = rows.sparkSession, f"{path}.new", f"{path}.old"
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(fresh)
    remove(spark, old)
    if exists(spark, path):
        move(spark, path, old)
    move(spark, fresh, path)
    remove(spark, old)
    spark.catalog.refreshByPath(path)
    return spark.read.parquet(path)


def written(rows: DataFrame, write: Callable[[DataFrame], object]) -> int:
    """Hand ``rows`` to ``write`` and tell how many it took, counted while they are written."""
    seen = Observation()
    write(rows.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]


def in_batches(keys: Sequence[str], load: Callable[[Sequence[str]], int], size: int = BATCH_SECURITIES, on_progress: Callable[[int, int, int], None] | None = None) -> int:
    """Load a few requested keys at a time, as vendors limit requests; rows in all. on_progress: batches done, batches, rows so far."""
    parts = [keys[i : i + size] for i in range(0, len(keys), size)]
    total = 0
    for k, part in enumerate(parts, 1):
        total += load(part)
        if on_progress:
            on_progress(k, len(parts), total)
    return total


def append(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)


def assert_unique(rows: DataFrame, keys: Sequence[str]) -> None:
    """Raise where a key occurs twice: plain files have no unique index."""
    if twice := rows.groupBy(*keys).count().where(F.col("count") > 1).limit(1).collect():
        raise ValueError(f"key {tuple(keys)} is not unique: {twice[0]}")


def ensure_table(spark: SparkSession, path: str, schema: StructType, partition_by: Sequence[str] = ()) -> bool:
    """Make an empty table of the schema unless there is one; a frame's schema makes an empty copy of it. True where it was made."""
    if exists(spark, path):
        return False
    spark.createDataFrame([], schema).write.partitionBy(*partition_by).parquet(path)
    return True


def print_rows(rows: DataFrame, n: int = 20) -> None:
    """The first rows on the console."""
    rows.show(n, truncate=False)


def with_year(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """The time chunk that stored tables are partitioned by."""
    return rows.withColumn("year", F.year(ts))
