"""Best-fit packing by hierarchical residual packing.

Documents become token items: a document's ids and one closing id, cut into full pieces when longer than a sequence (the first
piece takes what is left over). Full pieces are sequences already. The others are dealt evenly to partitions, and each
partition packs its items best-fit, longest first. Full bins are final. Underfull bins go on as items, four partitions to
one, and are packed again, until one partition is left.

A partition hands on its OPEN emptiest bins and closes the rest as they are, so no task's input grows with the corpus, and that closes no bin
that could have been saved. Best-fit leaves at most one bin that is half full or less, since its items would have fitted another such bin;
two bins over half full never join. So a task gets at most FAN_IN bins that may join another, each takes one partner, and the emptiest
bin takes whatever any bin takes: FAN_IN partners a level are enough, for all levels together far fewer than OPEN.

Only lengths and checksums travel; each level's items are a table in the shared folder.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenorlab.llm._common import materialize, read
from tenorlab.llm.bpe import default_vocabulary, vocabulary

CAPACITY = 2048
END_ID = 0
#: Items in a partition of the first level, partitions that merge into one, bins handed on.
ITEMS_A_PARTITION, FAN_IN, OPEN = 20_000, 4, 4_096
ITEM = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_items(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    end = np.array([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(vocabulary_path)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                ids = (known.encode(text).astype("<u4", copy=False).tobytes() if text else b"") + end
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    to = at + ((n - at) % capacity or capacity)
                    row.append(r)
                    piece.append(k)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(ids[4 * at : 4 * to]))
                    at, k = to, k + 1
            columns = [pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *columns], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, ITEM)


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, longest first into the fullest bin with room; and each bin's free space.

    Open bins are kept by free space and a bit set tells which spaces occur, so an item costs a few steps, not a search.
    """
    order = np.argsort(-sizes, kind="stable")
    bins, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    free: list[int] = []
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    spaces = 0
    for i, size in zip(order.tolist(), sizes[order].tolist(), strict=True):
        if fits := spaces >> size:
            space = size + (fits & -fits).bit_length() - 1
            b = by_space[space].pop()
            if not by_space[space]:
                spaces &= ~(1 << space)
        else:
            b, space = len(free), capacity
            free.append(capacity)
        bins[i], offset[i] = b, capacity - space
        free[b] = left = space - size
        if left:
            by_space[left].append(b)
            spaces |= 1 << left
    return bins, offset, np.array(free, np.int64)


def pack_level(items: DataFrame, level: int, capacity: int, last: bool) -> DataFrame:
    """Pack each partition's bins; adds ``final``. bin: what must stay together so far; offset: an item's place in it."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is None or not table.num_rows:
            return
        column = lambda name: table.column(name).to_numpy()
        names, which = np.unique(column("bin"), return_inverse=True)
        sizes = np.zeros(len(names), np.int64)
        np.maximum.at(sizes, which, column("offset") + column("length"))
        bins, offset, free = best_fit(sizes, capacity)
        final = (free == 0) | last
        if (~final).sum() > OPEN:  # the fullest are closed as they are
            emptiest = np.argsort(-free, kind="stable")[:OPEN]
            handed = np.zeros(len(free), bool)
            handed[emptiest] = True
            final |= ~handed
        first = (level << 56) | (TaskContext.get().partitionId() << 32)
        out = table.select(["doc_id", "piece", "start", "length", "ids_crc32"])
        out = out.append_column("bin", pa.array(first + bins[which])).append_column("offset", pa.array(offset[which] + column("offset"))).append_column("final", pa.array(final[bins[which]]))
        yield from out.to_batches()

    return items.mapInArrow(pack, f"{ITEM}, bin long, offset long, final boolean")


def pack_items(items: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Every item's sequence_id and offset; items: doc_id, piece, start, length (1 to capacity), ids_crc32."""
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    items = materialize(items.withColumn("bin", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long")), "items")
    done = [items.where(F.col("length") == capacity).select(*columns, (-1 - F.col("bin")).alias("sequence_id"), "offset")]
    left = items.where(F.col("length") < capacity)
    width, level = max(1, ceil(left.count() / ITEMS_A_PARTITION)), 1
    while True:
        packed = materialize(pack_level(left.repartition(width, F.xxhash64("bin")), level, capacity, width == 1), f"level{level}")
        done.append(packed.where("final").select(*columns, F.col("bin").alias("sequence_id"), "offset"))
        if width == 1:
            break
        left, width, level = packed.where(~F.col("final")), ceil(width / FAN_IN), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, vocabulary_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of every row of ``docs``.

    A null or empty text is the closing id alone. Repeated rows and null ids are packed like any others; other columns
    are ignored; an empty table gives an empty result.
    """
    return pack_items(token_items(docs, vocabulary_path, capacity), capacity)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents"), default_vocabulary())
