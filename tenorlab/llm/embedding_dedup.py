"""Embedding near-dedup on a robust-pruned flat graph.

Vectors of equal label and equal components are collapsed first. The rest are dealt to the shards of their pivots: a query asks in the
shard of its nearest one, and a vector is stored wherever a linked query may ask. Pivots are a sample of which none is near another,
so a dense group has one shard, not many. A linked query at most REACH away whose nearest pivot is p instead of the vector's own p* moves
the difference of the two products by at most REACH * |p - p*|; vectors within that are stored in p's shard. In many dimensions
few differences point that way, so SPREAD standard deviations of a random one are tried first; then a fixed number of vectors of each
label is compared with the whole label, and a label below MIN_RECALL is dealt again by the full bound, which misses none.
A label of at most OVERLAP * CHUNK vectors is one shard and one chunk: every vector asks where all are stored, so no routing can miss a link.

A larger shard is cut into chunks of CHUNK stored vectors. Every chunk builds a robust-pruned neighbour list
for its vectors; the lists of a vector from all its shards are united. A query then searches every chunk of its home shard:
greedily from the chunk's medoid and from its own place in the graph, and from whatever it reaches the range is expanded over the
united lists until no vector within the threshold is left to expand. Each chunk audits the recall of a fixed share of its
queries, each on its own, against brute force. Where one is below MIN_RECALL, it searches again with wider lists, audits again and, where
that fails too, compares all queries of the slice with the whole chunk. Reported links are cosines in double precision.

Only counts and a spanning forest of links leave a chunk, never the pairs of a group. Pivots are bounded by MAX_PIVOTS
whatever the data's size; chunks bound a task's memory whatever a shard's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenorlab.llm._common import let, materialize, read
from tenorlab.llm.components import connected_components

THRESHOLD = 0.98
SHARD, OVERLAP, CHUNK, MAX_PIVOTS = 600, 4, 2048, 8192
#: Distance of two vectors at the threshold; standard deviations of a random difference tried first; cosine from which one of two pivots goes.
REACH, SPREAD, SAME_PIVOT = (2 - 2 * THRESHOLD) ** 0.5, 3, 0.8
#: Vectors compared with their whole label: so many in all, but in each label between these two numbers.
COMPARED, LEAST_COMPARED, MOST_COMPARED = 16384, 16, 256
#: Vectors whose products with all pivots are held at once.
DEALT = 512
#: Neighbours kept, candidates pruned from, the pruning slack, the beam, and how far below the threshold the range still expands.
DEGREE, CANDIDATES, SLACK, BEAM, MARGIN = 16, 48, 1.2, 8, 0.02
AUDITED, MIN_RECALL = 16, 0.98
#: Queries searched together, cosines computed at once, and candidates pruned at once.
TOGETHER, VISITED, PRUNED = 256, 1 << 12, 24576


def robust_prune(cos: np.ndarray, degree: int, candidates: int) -> list[np.ndarray]:
    """Each vector's neighbours: the nearest candidate is kept and those it is SLACK times nearer to than the vector are dropped, and so on."""
    n = len(cos)
    k = min(candidates, n - 1)
    if k < 1:
        return [np.empty(0, np.int64)] * n
    far = 1 - cos
    np.fill_diagonal(far, np.inf)
    near, own = _nearest(far, k)
    flat = far.ravel()
    return _kept(near, own, degree, lambda best, first: flat[best[:, None] * n + near])


def pruned_lists(x: np.ndarray, degree: int, candidates: int) -> list[np.ndarray]:
    """robust_prune of the vectors' cosines, a block of vectors at a time: memory grows with their number, not with its square."""
    n = len(x)
    k = min(candidates, n - 1)
    if k < 1:
        return [np.empty(0, np.int64)] * n
    out = []
    block = max(1, PRUNED // k)
    for at in range(0, n, block):
        far = 1 - x[at : at + block] @ x.T
        rows = np.arange(len(far))
        far[rows, at + rows] = np.inf
        near, own = _nearest(far, k)
        of = x[near]
        apart = 1 - of @ of.transpose(0, 2, 1)
        out += _kept(near, own, degree, lambda best, first, rows=rows, apart=apart: apart[rows, first])
    return out


def _nearest(far: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of each row in order, and how far they are."""
    near = np.argpartition(far, k - 1, axis=1)[:, :k]
    own = np.take_along_axis(far, near, 1)
    order = np.argsort(own, axis=1, kind="stable")
    return np.take_along_axis(near, order, 1), np.take_along_axis(own, order, 1)


def _kept(near: np.ndarray, own: np.ndarray, degree: int, apart: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """Of each row's candidates those the pruning keeps; apart: how far all are from the row's best one, by its number and its column."""
    alive, rows = np.ones(near.shape, bool), np.arange(len(near))
    kept = np.full((len(near), degree), -1)
    limit = own / SLACK
    for r in range(degree):
        first = alive.argmax(1)
        some = alive[rows, first]
        if not some.any():
            break
        best = near[rows, first]
        kept[some, r] = best[some]
        alive[rows, first] = False
        if r + 1 < degree:
            alive &= apart(best, first) > limit
    return [x[x >= 0] for x in kept]


def both_ways(lists: list[np.ndarray]) -> list[np.ndarray]:
    """The lists with every link in both directions: what few others list would else be out of reach."""
    n = len(lists)
    here, there = np.repeat(np.arange(n), [len(x) for x in lists]), np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64)
    pairs = np.unique(np.concatenate([here * n + there, there * n + here]))
    return np.split(pairs % n, np.searchsorted(pairs, np.arange(1, n) * n)) if n else []


def range_search(queries: np.ndarray, stored: np.ndarray, lists: list[np.ndarray], medoid: int, own: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean queries x stored: what the search reaches within the threshold. Cosines are computed for visited nodes only; own: a query's place or -1.

    Nothing but the cosines' own table is as large as queries x stored, and no step of the search reads that whole.
    """
    n_q, n = len(queries), len(stored)
    first = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    linked = np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64)
    cos = np.full(n_q * n, -np.inf)
    last = np.empty(n_q * n, np.int32)  # where a pair stands last among those offered: of equal ones that one counts

    def visit(q: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of (query, node) pairs those not visited yet, each once and in order, and their cosines."""
        at = q * n + nodes
        new = np.flatnonzero(cos[at] == -np.inf)
        last[at[new]] = new
        new = new[last[at[new]] == new]
        i, j = q[new], nodes[new]
        got = np.empty(len(new))
        for k in range(0, len(new), VISITED):
            part = slice(k, k + VISITED)
            got[part] = np.einsum("ij,ij->i", queries[i[part]], stored[j[part]])
        cos[at[new]] = got
        return i, j, got

    def beyond(q: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and neighbours of (query, node) pairs."""
        size = first[nodes + 1] - first[nodes]
        at = np.arange(size.sum()) + np.repeat(first[nodes] - (np.cumsum(size) - size), size)
        return np.repeat(q, size), linked[at]

    k = min(BEAM, n)
    beam, near, done = np.full((n_q, k), -1), np.full((n_q, k), -np.inf), np.ones((n_q, k), bool)
    beam[:, 0], done[:, 0] = medoid, False
    near[:, 0] = visit(np.arange(n_q), beam[:, 0])[2]
    for _ in range(24):  # greedy: the best of the beam and of what it links to
        q, c = np.nonzero(~done)
        if not len(q):
            break
        done[q, c] = True
        i, j, got = visit(*beyond(q, beam[q, c]))
        better = got > near.min(1)[i]  # the beam holds the best of all visited, so only what is new and better can enter it
        i, j, got = i[better], j[better], got[better]
        rows, start, size = np.unique(i, return_index=True, return_counts=True)
        if not len(rows):
            continue
        row, column = np.repeat(np.arange(len(rows)), size), k + np.arange(len(i)) - np.repeat(start, size)
        pad = ((0, 0), (0, int(size.max())))
        nodes, value, old = np.pad(beam[rows], pad, constant_values=-1), np.pad(near[rows], pad, constant_values=-np.inf), np.pad(done[rows], pad, constant_values=True)
        nodes[row, column], value[row, column], old[row, column] = j, got, False
        best = np.argpartition(-value, k - 1, axis=1)[:, :k]
        beam[rows], near[rows], done[rows] = (np.take_along_axis(x, best, 1) for x in (nodes, value, old))
    placed = np.flatnonzero(own >= 0)
    visit(placed, own[placed])
    open_ = cos >= threshold - MARGIN
    open_[placed * n + own[placed]] = True
    q, nodes = np.divmod(np.flatnonzero(open_), n)
    while len(q):  # range: whatever is near enough passes the search on
        i, j, got = visit(*beyond(q, nodes))
        q, nodes = i[got >= threshold - MARGIN], j[got >= threshold - MARGIN]
    return (cos >= threshold).reshape(n_q, n)


def forest(found: np.ndarray, own: np.ndarray) -> list[tuple[int, int]]:
    """(query, stored) pairs, enough of ``found`` to join what it joins; own: a query's place among the stored or -1."""
    n_q, n = found.shape
    parent = list(range(n_q + n))

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, o in enumerate(own.tolist()):
        if o >= 0:
            parent[top(i)] = top(n_q + o)
    out = []
    for i in np.flatnonzero(found.any(1)).tolist():
        mine = top(i)
        for j in np.flatnonzero(found[i]).tolist():
            if (other := top(n_q + j)) != mine:
                parent[other] = mine
                out.append((i, j))
    return out


def _unit(column: Column) -> Column:
    """The vector over its length in double precision; null for what links with nothing."""
    v = F.transform(column, lambda x: x.cast("double"))
    clean = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = lambda x: F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, y: a + y * y))
    return F.when(clean & (F.size(v) > 0), let(v, lambda x: F.when((norm(x) > 0) & (norm(x) < float("inf")), let(norm(x), lambda n: F.transform(x, lambda y: y / n)))))


def _pivots(reps: DataFrame) -> dict[tuple[str, int], tuple[np.ndarray, int]]:
    """(label, dimension) -> pivot vectors and the number of the first; at most MAX_PIVOTS vectors reach the driver."""
    sizes = reps.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n"))
    total = reps.count()
    share = max(SHARD, -(-total // MAX_PIVOTS))
    k = F.floor(F.col("n") / share)
    large = sizes.where(F.col("n") > OVERLAP * CHUNK)  # the others are one chunk
    wanted = large.select("label", "dim", k.alias("k"), (2 * k / F.col("n")).alias("part")).where(F.col("k") >= 2)  # at most MAX_PIVOTS / 2 rows
    spread = F.pmod(F.xxhash64("g", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    # about twice the wanted rows pass a threshold on the hash, so that the ranking's input is bounded too
    few = reps.select("g", "label", "dim").join(F.broadcast(wanted), ["label", "dim"]).where(spread <= F.col("part"))
    order = Window.partitionBy("label", "dim").orderBy(spread, "g")
    chosen = few.withColumn("r", F.row_number().over(order)).where(F.col("r") <= F.col("k")).select("g")
    by: dict[tuple[str, int], list] = {}
    for r in reps.join(chosen, "g").select("label", "dim", "unit").orderBy("label", "dim", "g").collect():
        by.setdefault((r["label"], r["dim"]), []).append(r["unit"])
    out, first = {}, 0
    for key, vectors in by.items():
        apart = thinned(np.array(vectors))
        if len(apart) > 1:
            out[key] = (apart, first)
            first += len(apart)
    return out


def thinned(vectors: np.ndarray) -> np.ndarray:
    """The vectors without those that are near one before them."""
    kept, n = np.empty_like(vectors), 0
    for v in vectors:
        if not n or (kept[:n] @ v).max() < SAME_PIVOT:
            kept[n] = v
            n += 1
    return kept[:n].copy()


def shards_of(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pivot, whether it is the row's nearest) for every pivot that may be the nearest of a vector within ``reach`` of the row, and the OVERLAP nearest."""
    row, pivot, home = [], [], []
    for at in range(0, len(x), DEALT):
        dots = x[at : at + DEALT] @ pivots.T
        best, rows = dots.argmax(1), np.arange(len(dots))
        apart = np.sqrt(np.maximum(2 - 2 * (pivots[best] @ pivots.T), 0))
        stored = dots[rows, best][:, None] - dots <= reach * apart + 1e-9
        k = min(OVERLAP, len(pivots))
        np.put_along_axis(stored, np.argpartition(-dots, k - 1, axis=1)[:, :k], True, axis=1)
        r, p = np.nonzero(stored)
        row.append(at + r)
        pivot.append(p)
        home.append(p == best[r])
    return np.concatenate(row), np.concatenate(pivot), np.concatenate(home)


def vectors_of(column: pa.ListArray) -> list[np.ndarray]:
    """The vectors of a column without nulls, as views of its buffer."""
    return np.split(column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())[:-1]) if len(column) else []


def rows_of(column: pa.ListArray, dim: int) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    return column.flatten().to_numpy().reshape(-1, dim)


def unpacked(column: pd.Series) -> np.ndarray:
    """A column of packed vectors of one length as a matrix."""
    return np.frombuffer(b"".join(column)).reshape(len(column), -1)


def _stored(reps: DataFrame, known: Broadcast, whole: bool) -> DataFrame:
    """g, label, dim, mult, unit (packed doubles), shard, home: every vector in each shard where it may be asked for; -1 where a label has one shard."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, dim = batch.column("label").to_pylist(), batch.column("dim").to_pylist()
            row, shard, home = [], [], []
            by: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(label, dim, strict=True)):
                by.setdefault(key, []).append(i)
            for key, at in by.items():
                if key not in known.value:
                    row.append(np.array(at))
                    shard.append(np.full(len(at), -1))
                    home.append(np.ones(len(at), bool))
                    continue
                pivots, first = known.value[key]
                x = rows_of(batch.column("unit").take(pa.array(at)), key[1])
                r, p, nearest = shards_of(x, pivots, REACH if whole else REACH * min(1.0, SPREAD / key[1] ** 0.5))
                row.append(np.array(at)[r])
                shard.append(first + p)
                home.append(nearest)
            every = pa.array(np.concatenate(row) if row else [], pa.int64())
            packed = pa.array([x.tobytes() for x in vectors_of(batch.column("unit"))], pa.binary())
            columns = [*batch.drop_columns(["unit"]).take(every).columns, packed.take(every), pa.array(np.concatenate(shard) if row else [], pa.int64()), pa.array(np.concatenate(home) if row else [], pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, ["g", "label", "dim", "mult", "unit", "shard", "home"])

    return reps.select("g", "label", "dim", "mult", "unit").mapInArrow(deal, "g long, label string, dim int, mult long, unit binary, shard long, home boolean")


def _labels(spark: SparkSession, keys: list[tuple[str, int]]) -> DataFrame:
    """A small table of label and dim that is part of the plan: one made from Python rows would start a worker per core to read it."""
    return spark.createDataFrame(pa.table({"label": pa.array([a for a, _ in keys], pa.string()), "dim": pa.array([int(b) for _, b in keys], pa.int32())}))


def _true_links(reps: DataFrame, known: Broadcast) -> DataFrame:
    """g, label, dim, links: what a fixed number of vectors of each label with several shards link with in the whole label."""
    spark = reps.sparkSession
    keys = _labels(spark, list(known.value))
    several = reps.join(F.broadcast(keys), ["label", "dim"])
    each = max(LEAST_COMPARED, min(MOST_COMPARED, COMPARED // max(1, len(known.value))))
    sizes = several.groupBy("label", "dim").agg((each / F.count(F.lit(1))).alias("part"))
    spread = F.pmod(F.xxhash64("g", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    asked: dict[tuple[str, int], tuple[list, list]] = {}
    for r in several.join(F.broadcast(sizes), ["label", "dim"]).where(spread <= F.col("part")).select("g", "label", "dim", "unit").collect():
        g, units = asked.setdefault((r["label"], r["dim"]), ([], []))
        g.append(r["g"])
        units.append(r["unit"])
    sent = spark.sparkContext.broadcast({k: (np.array(g), np.array(u)) for k, (g, u) in asked.items()})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            by: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(batch.column("label").to_pylist(), batch.column("dim").to_pylist(), strict=True)):
                if key in sent.value:
                    by.setdefault(key, []).append(i)
            for key, at in by.items():
                g, units = sent.value[key]
                part = batch.take(pa.array(at))
                near = (units @ rows_of(part.column("unit"), key[1]).T >= THRESHOLD) & (g[:, None] != part.column("g").to_numpy()[None, :])
                out += [(x, *key, n) for x, n in zip(g.tolist(), (near @ part.column("mult").to_numpy()).tolist(), strict=True)]
            columns = list(zip(*out, strict=True)) or [[]] * 4
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["g", "label", "dim", "n"])

    counted = several.select("g", "label", "dim", "mult", "unit").mapInArrow(count, "g long, label string, dim int, n long")
    return counted.groupBy("g", "label", "dim").agg(F.sum("n").alias("true"))


def _short(reps: DataFrame, known: Broadcast, counts: DataFrame) -> list[tuple[str, int]]:
    """The labels (and dimensions) where the compared vectors' mean recall of links is under MIN_RECALL."""
    if not known.value:
        return []
    got = _true_links(reps, known).where(F.col("true") > 0).join(counts, "g", "left")
    recall = got.groupBy("label", "dim").agg(F.avg(F.coalesce("links", F.lit(0)) / F.col("true")).alias("recall"))
    return [(r["label"], r["dim"]) for r in recall.where(F.col("recall") < MIN_RECALL).collect()]


def _build(frame: pd.DataFrame) -> pd.DataFrame:
    x, g = unpacked(frame["unit"]), frame["g"].to_numpy()
    return pd.DataFrame({"g": g, "near": [g[i] for i in both_ways(pruned_lists(x, DEGREE, CANDIDATES))]})


def least_recall(found: np.ndarray, truth: np.ndarray) -> float:
    """The worst share of its true links that a query has found; 1 where no query has any."""
    n = truth.sum(1)
    return float(((found & truth).sum(1)[n > 0] / n[n > 0]).min(initial=1.0))


def _places(ids: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Where each id stands in the ascending ``g``; -1 for none."""
    at = np.minimum(np.searchsorted(g, ids), len(g) - 1)
    return np.where(g[at] == ids, at, -1)


def _search_with(asked: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
    """_search with the chunk's lists, which come without vectors."""
    return _search(asked.assign(near=lists.set_index("g")["near"].reindex(asked["g"]).to_numpy()))


def _search(frame: pd.DataFrame) -> pd.DataFrame:
    """Counts and forest links of one chunk's queries: g, links, other (null in a count row)."""
    stored, asked = frame[frame["stored"]].sort_values("g"), frame[frame["home"]].sort_values("g")
    empty = pd.DataFrame({"g": pd.Series(dtype="int64"), "links": pd.Series(dtype="int64"), "other": pd.Series(dtype="Int64")})
    if not len(stored) or not len(asked):
        return empty
    g, mult = stored["g"].to_numpy(), stored["mult"].to_numpy()
    x = unpacked(stored["unit"])
    near, ends = np.concatenate(stored["near"].tolist()), np.cumsum(stored["near"].map(len).to_numpy())
    to = _places(near, g)
    lists = np.split(to[to >= 0], np.append(0, np.cumsum(to >= 0))[ends[:-1]])
    medoid = int((x @ x.mean(0)).argmax())
    out, wide = [empty], None
    for at in range(0, len(asked), TOGETHER):
        part = asked.iloc[at : at + TOGETHER]
        mine = part["g"].to_numpy()
        own, queries = _places(mine, g), unpacked(part["unit"])
        found = range_search(queries, x, lists, medoid, own, THRESHOLD)
        audit = np.arange(0, len(mine), AUDITED)
        truth = queries[audit] @ x.T >= THRESHOLD
        truth[own[audit] >= 0, own[audit][own[audit] >= 0]] = False  # a vector that finds itself tells nothing
        if least_recall(found[audit], truth) < MIN_RECALL:
            wide = wide or both_ways([np.union1d(a, b) for a, b in zip(lists, pruned_lists(x, 4 * DEGREE, 4 * CANDIDATES), strict=True)])
            found |= range_search(queries, x, wide, medoid, own, THRESHOLD)
            if least_recall(found[audit], truth) < MIN_RECALL:
                found = queries @ x.T >= THRESHOLD
        placed = np.flatnonzero(own >= 0)
        found[placed, own[placed]] = False
        out.append(pd.DataFrame({"g": mine, "links": found @ mult, "other": pd.array([None] * len(mine), "Int64")}))
        pairs = forest(found, own)
        out.append(pd.DataFrame({"g": [mine[i] for i, _ in pairs], "links": [0] * len(pairs), "other": pd.array([g[j] for _, j in pairs], "Int64")}))
    return pd.concat([o for o in out if len(o)] or [empty], ignore_index=True)


def _links(dealt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(g, links) of every vector and (a, b), enough links to join what links."""
    stored = materialize(dealt, "shards")
    place = ["label", "dim", "shard"]
    n = F.count(F.lit(1))
    sizes = stored.groupBy(*place).agg(F.when(n <= OVERLAP * CHUNK, 1).otherwise(F.ceil(n / CHUNK)).cast("int").alias("chunks"))
    sized = stored.join(sizes, place).withColumn("chunk", F.pmod(F.xxhash64("g"), F.col("chunks")).cast("int"))
    built = sized.select(*place, "chunk", "g", "unit").groupBy(*place, "chunk").applyInPandas(_build, "g long, near array<long>")
    lists = built.groupBy("g").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    # a vector is stored in its chunk of each shard and asks in every chunk of its home shard
    every = F.when(F.col("home"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array("chunk"))
    asking = sized.withColumn("to", F.explode(every)).select(*place, "to", "g", "mult", "unit", "home", (F.col("to") == F.col("chunk")).alias("stored"))
    known = sized.select("g", *place, "chunk").join(lists, "g").toDF("g", *place, "to", "near")
    both = asking.groupBy(*place, "to").cogroup(known.groupBy(*place, "to"))
    found = materialize(both.applyInPandas(_search_with, "g long, links long, other long"), "found")
    counts = found.where(F.col("other").isNull()).groupBy("g").agg(F.sum("links").alias("links"))
    return counts, found.where(F.col("other").isNotNull()).select(F.col("g").alias("a"), F.col("other").alias("b"))


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    A null label, and a vector that is null, empty, zero or holds null or non-finite components, links with nothing and is its own
    component. Labels of any type are compared by their text. Repeated rows are other vectors that link. Vectors of other lengths never meet. A null id is never a
    component's smallest and is not kept. Other columns are ignored; an empty table gives an empty result.
    """
    # hashes skip nulls in an array, so a vector that holds one has none, or it would pass for the vector without
    whole = lambda h: F.when(~F.exists("embedding", lambda x: x.isNull()), h)
    rows = vectors.select(
        F.col("vec_id").cast("long"), F.col("label").cast("string").alias("label"), "embedding",
        whole(F.xxhash64("embedding")).alias("h1"), whole(F.xxhash64(F.lit(7919), "embedding")).alias("h2"),
    )
    equal = rows.where(F.col("label").isNotNull() & F.col("h1").isNotNull()).groupBy("label", "h1", "h2")
    classes = equal.agg(F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("least"), F.first("embedding").alias("embedding")).withColumn("unit", _unit(F.col("embedding"))).drop("embedding")
    reps = materialize(classes.where(F.col("unit").isNotNull()).withColumn("dim", F.size("unit")).withColumn("g", F.monotonically_increasing_id()), "vectors")
    known = vectors.sparkSession.sparkContext.broadcast(_pivots(reps))
    counts, edges = _links(_stored(reps, known, False))
    if short := _short(reps, known, counts):
        again = reps.join(F.broadcast(_labels(vectors.sparkSession, short)), ["label", "dim"])
        more, further = _links(_stored(again, known, True))
        counts = counts.join(again.select("g"), "g", "left_anti").unionByName(more)
        edges = edges.unionByName(further)
    named = reps.select("g", "label", "h1", "h2", "mult", "least").join(counts, "g", "left")
    roots = connected_components(edges)
    named = named.join(roots, named["g"] == roots["node"], "left").withColumn("root", F.coalesce("root", "g"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = named.join(least, "root").select("label", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), "component_id")
    # of equal vectors all have a class or none, so a row without one links with nothing
    joined = rows.select("vec_id", "label", "h1", "h2").join(of_class, ["label", "h1", "h2"], "left")
    result = joined.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
