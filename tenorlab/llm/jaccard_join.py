"""N-gram Jaccard join with parity sketches.

A document's set is its distinct word shingles, as 64-bit hashes. A parity sketch flips one bit for every token of a set, so the Hamming
distance of two sketches never exceeds the symmetric difference of the sets, and sets of sizes a and b that reach similarity t
differ in at most d = (1 - t)(a + b) / (1 + t) tokens.

Sizes fall into bands; a band's scheme takes the sizes that can meet a member of the band. Its sketch is cut into B > d blocks, so two
linked sets agree in at least B - d blocks (pigeonhole). A block's key is the XOR of its flipped bits' numbers. A set uses its d + 1
fullest blocks, ties by block number: of the blocks that agree, the one that comes first in that order has only blocks that differ
before it, d at most, in either set. Empty blocks, alike in all documents, and blocks of one common shingle thus stay out of the keys.

Sets that share a key are candidates. Equal sets are one class from the start. First a key's sets meet only the key's centre, the set that
meets most others over all its keys: a candidate must pass the bound of two dense parity sketches and then the exact count over both whole
sets. Verified links join components; a key whose sets are in one component is finished, since a further link in it changes no
component. Of the keys that are left, small ones are compared pair by pair. In the others, a set with more tokens that no other component
holds than a linked set may lack is done, and sets whose rarest tokens make up a prefix meet by these. What has too few rare tokens, or
may link with such a set, is settled by what it differs in from a
centre c, for all keys of a component's sets the one of them that meets most others: sets x and y link if and only if x ^ c and y ^ c share at least (|x ^ c| + |y ^ c| - d) / 2
tokens. Two sets that link with c are one component already, and where one does not, that is at least one token. So a prefix filter holds:
each set sends, common ones last, as many tokens of its difference as a partner must share one of, and a pair is formed only
where the places of a shared token leave room for the overlap it needs. Copies edited at random, however many, share few such tokens. No pair
of sets is formed for a large key's sake, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tenorlab.llm._common import drop_table, free_shuffles, lower_ascii, materialize, mix64, read, word_hashes
from tenorlab.llm.components import connected_components

#: Bytes of text handled at once.
SLICE = 1 << 21
#: Ratio of a band's ends; d over the number of blocks.
BAND, FILL = 1.3, 0.78
#: Sets up to which a key's pairs are simply joined.
SMALL_KEY = 16
#: A token is rare that so many of the large keys' sets hold at most.
RARE = 16
#: Tokens put last in prefixes of differences: held by more than one in so many of a centre's sets, and so many at most.
OFTEN, MOST_OFTEN = 16, 512
#: Rows with whole sets that a Python worker holds at once.
BATCH = 256


class Similarity:
    """At least percent / 100, in whole numbers; shingles of k words."""

    def __init__(self, k: int, percent: int):
        self.k, self.percent = k, percent

    def most_apart(self, total: int) -> int:
        """Largest symmetric difference of two linked sets whose sizes sum to ``total``."""
        return (100 - self.percent) * total // (100 + self.percent)

    def schemes(self, n: int) -> list[tuple[int, int, int, int]]:
        """(number, least size, largest size, blocks) of every band's scheme that takes sets of size n."""
        out, low, number = [], 1, 0
        while low <= n:
            above = max(low + 1, int(low * BAND))
            high = (above - 1) * 100 // self.percent
            d = self.most_apart(above - 1 + high)
            if n <= high:
                # a set of the largest size may differ from one of its own size, so block_keys asks for more blocks than d
                out.append((number, low, high, max(self.most_apart(2 * high) + 1, round(d / FILL))))
            low, number = above, number + 1
        return out

    def sizes_may_link(self, n: int, m: int) -> bool:
        return 100 * min(n, m) >= self.percent * max(n, m)

    def most_without(self, n: int | Column) -> int | Column:
        """The most tokens of a set of size n that a linked set lacks."""
        return F.floor((100 - self.percent) * n / 100) if isinstance(n, Column) else (100 - self.percent) * n // 100

    def apart_from_any(self, n: int, high: int) -> int:
        """Largest symmetric difference of a set of size n and a linked one of at most ``high``."""
        return self.most_apart(n + min(high, n * 100 // self.percent))


def shingle_sets(values: list[str | None], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer than k words is one shingle of all, none without words."""
    encoded, size = [], 0

    def work(parts: list[bytes]) -> Iterator[np.ndarray]:
        data = np.frombuffer(b"\n".join(parts), np.uint8)
        first = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])])
        starts, words = word_hashes(lower_ascii(data))
        cut = np.searchsorted(starts, first)
        rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for i in range(k):
            rolled = mix64(rolled * np.uint64(0x9E3779B97F4A7C15) + words[i : i + len(rolled)])
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            if b - a >= k:
                one = np.sort(rolled[a : b - k + 1])
                yield one[np.concatenate([[True], one[1:] != one[:-1]])]
            elif b > a:
                h = np.uint64(b - a)
                for w in words[a:b]:
                    h = mix64(np.array([h * np.uint64(31) + w], np.uint64))[0]
                yield np.array([h], np.uint64)
            else:
                yield np.empty(0, np.uint64)

    with np.errstate(over="ignore"):
        for v in values:
            encoded.append((v or "").encode("utf-8", "surrogatepass"))
            size += len(encoded[-1]) + 1
            if size >= SLICE:
                yield from work(encoded)
                encoded, size = [], 0
        if encoded:
            yield from work(encoded)


def _class_of(one: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    if not len(one):
        return 0, 0
    with np.errstate(over="ignore"):
        a = np.bitwise_xor.reduce(mix64(one ^ np.uint64(0xA5A5A5A5DEADBEEF)))
        b = np.add.reduce(mix64(one + np.uint64(0x1234567890ABCDEF)))
        pair = mix64(np.array([a + np.uint64(len(one)), b ^ a], np.uint64)).view(np.int64)
    return int(pair[0]), int(pair[1])


def dense_sketch(one: np.ndarray) -> bytes:
    """A parity sketch of two to four bits a token."""
    bits = 64
    while bits < 2 * len(one):
        bits *= 2
    at = np.bincount((one >> np.uint64(40)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(at.astype(np.uint8), bitorder="little").tobytes()


def _fold(sketch: np.ndarray, size: int) -> np.ndarray:
    """A parity sketch of fewer bytes, by XOR of its halves."""
    while len(sketch) > size:
        sketch = sketch[: len(sketch) // 2] ^ sketch[len(sketch) // 2 :]
    return sketch


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two parity sketches; the longer is folded onto the shorter, which keeps it a lower bound."""
    size = min(len(a), len(b))
    return int(np.bitwise_count(_fold(np.frombuffer(a, np.uint8), size) ^ _fold(np.frombuffer(b, np.uint8), size)).sum())


def block_keys(one: np.ndarray, how: Similarity) -> list[np.ndarray]:
    """The keys of a set in each scheme of its size: those of its d + 1 fullest blocks."""
    out, n = [], len(one)
    if not n or not how.apart_from_any(n, n * 100 // how.percent):  # sets that may not differ at all are one class already
        return out
    with np.errstate(over="ignore"):
        token = mix64(one + np.uint64(0x9E3779B97F4A7C15))
        mixed = mix64(token)
        for number, low, high, blocks in how.schemes(n):
            d = how.apart_from_any(n, high)
            assert blocks > d, (low, high, blocks, n, d)
            block = (((token >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)).astype(np.int64)
            held = np.bincount(block, minlength=blocks)
            used = np.argsort(-held, kind="stable")[: d + 1]
            order = np.argsort(block, kind="stable")
            parity = np.zeros(blocks, np.uint64)
            full = np.flatnonzero(held)
            parity[full] = np.bitwise_xor.reduceat(mixed[order], np.concatenate([[0], np.cumsum(held[full])[:-1]]))
            out.append(mix64(parity[used] + mix64(used.astype(np.uint64) + np.uint64(number << 32))))
    return out


def profiles(docs: DataFrame, how: Similarity) -> DataFrame:
    """doc_id, h (names the text under its id), n, c1, c2 (128 bits that name the set) for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, c1, c2 = [], [], []
            for one in shingle_sets(batch.column(2).to_pylist(), how.k):
                a, b = _class_of(one)
                n.append(len(one))
                c1.append(a)
                c2.append(b)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, c1, c2))], ["doc_id", "h", "n", "c1", "c2"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInArrow(work, "doc_id long, h long, n long, c1 long, c2 long")


def keys(docs: DataFrame, how: Similarity) -> DataFrame:
    """key, c1, salt of every set; a task sends a class once as long as it remembers it.

    salt is 0 but for rows whose key two other classes of the same batch hold: that key is shared, whatever other tasks hold.
    """

    def emit(parts: list[np.ndarray], owner: list[np.ndarray]) -> pa.RecordBatch:
        key, c = np.concatenate(parts).view(np.int64), np.concatenate(owner)
        order = np.argsort(key, kind="stable")
        ahead = np.zeros(len(key), bool)
        ahead[order[2:]] = key[order[2:]] == key[order[:-2]]
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(c), pa.array(np.where(ahead, c | 1, 0))], ["key", "c1", "salt"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            parts, owner, size = [], [], 0
            for one in shingle_sets(batch.column(0).to_pylist(), how.k):
                c = _class_of(one)[0]
                if c in seen or not len(one):
                    continue
                if len(seen) > 200_000:
                    seen.clear()
                seen.add(c)
                for k in block_keys(one, how):
                    parts.append(np.unique(k))
                    owner.append(np.full(len(parts[-1]), c, np.int64))
                    size += len(k)
                if size > 1 << 20:
                    yield emit(parts, owner)
                    parts, owner, size = [], [], 0
            if parts:
                yield emit(parts, owner)

    return docs.select("text").mapInArrow(work, "key long, c1 long, salt long")


def shared_keys(found: DataFrame) -> DataFrame:
    """key, c1 of the keys that at least two classes share. Rows known to share theirs are dealt by their salt, so a window holds two rows of a key and batch."""
    w = Window.partitionBy("key", "salt")
    shared = found.withColumn("lo", F.min("c1").over(w)).withColumn("hi", F.max("c1").over(w)).where((F.col("salt") != 0) | (F.col("lo") != F.col("hi")))
    return shared.select("key", "c1").distinct()


def token_sets(docs: DataFrame, wanted: DataFrame, how: Similarity) -> DataFrame:
    """g, n, sketch, tokens of the wanted classes (g, n, doc_id, h, c1, c2): one text of each is read again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketch, tokens, ok = [], [], []
            c1, c2 = batch.column("c1").to_pylist(), batch.column("c2").to_pylist()
            for one, *c in zip(shingle_sets(batch.column("text").to_pylist(), how.k), c1, c2, strict=True):
                ok.append(_class_of(one) == tuple(c))
                sketch.append(dense_sketch(one))
                tokens.append(one.tobytes())
            out = pa.RecordBatch.from_arrays([batch.column("g"), batch.column("n"), pa.array(sketch, pa.binary()), pa.array(tokens, pa.binary())], ["g", "n", "sketch", "tokens"])
            yield out.filter(pa.array(ok, pa.bool_()))

    texts = docs.select(F.col("doc_id").cast("long").alias("tid"), F.xxhash64("text").alias("th"), "text")
    # a shuffle of the texts at any size: how many classes share a key is not bounded
    one = texts.join(wanted.hint("merge"), texts["tid"].eqNullSafe(wanted["doc_id"]) & (texts["th"] == wanted["h"]))
    one = one.select("g", "n", "c1", "c2", "text").dropDuplicates(["g"])
    return one.mapInArrow(work, "g long, n long, sketch binary, tokens binary")


def verify(pairs: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """a, b: the pairs of classes that reach the similarity, by sketch bound and then by count over both whole sets."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, x, y = (batch.column(c).to_pylist() for c in ("an", "bn", "asketch", "bsketch"))
            ok = [how.sizes_may_link(i, j) and hamming(p, q) <= how.most_apart(i + j) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = zip(views(batch.column("atokens")), views(batch.column("btokens")), strict=True)
            ok = [len(x) + len(y) - 2 * len(np.intersect1d(x, y, assume_unique=True)) <= how.most_apart(len(x) + len(y)) for x, y in each]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    side = lambda s, *columns: sets.select(F.col("g").alias(s), *[F.col(c).alias(s + c) for c in columns])
    close = materialize(pairs.join(side("a", "n", "sketch"), "a").join(side("b", "n", "sketch"), "b").mapInArrow(near, "a long, b long"), "close")
    return close.join(side("a", "tokens"), "a").join(side("b", "tokens"), "b").mapInArrow(exact, "a long, b long")


def views(column: pa.Array) -> Iterator[np.ndarray]:
    """The token arrays of a binary column, not copied."""
    return (np.frombuffer(x.as_buffer(), np.uint64) for x in column)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it holds, Spark hands Python BATCH rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _centre(members: DataFrame) -> DataFrame:
    """g, m: each key's sets paired with the key's centre: of the component (root) of its set that meets most others, the set that does so."""
    sizes = members.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    meets = members.select("key", "g", "root").join(sizes, "key").groupBy("g", "root").agg(F.sum("size").alias("meets"))
    meets = materialize(meets, "meets")
    most = lambda *by: meets.groupBy(*by).agg(F.max(F.struct("meets", F.col("g").alias("m"))).alias("most"))
    ranked = materialize(members.select("key", "g").join(meets, "g"), "ranked")
    first = ranked.groupBy("key").agg(F.max(F.struct("meets", "g", "root")).alias("first")).select("key", F.col("first.root").alias("root"))
    centres = materialize(first.join(most("root"), "root").select("key", F.col("most.m").alias("m")), "centres")
    return ranked.select("key", "g").join(centres, "key").select("g", "m").where(F.col("g") != F.col("m")).distinct()


def rarities(large: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """g, root, n, own, rare of the large keys' sets that may link with one of another component.

    own: how many of the set's tokens no other component holds; rare: those of the others that at most RARE of the sets hold, by how many
    and by token. With more tokens of its own than a linked set may lack a set links with none.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [x.view(np.int64) for x in views(batch.column("tokens"))]
            ends, first = np.cumsum([len(x) for x in tokens]), 0
            while first < len(tokens):
                # sets of SLICE / 8 tokens in all, one at least
                after = max(first + 1, int(np.searchsorted(ends, ends[first] - len(tokens[first]) + SLICE // 8, "right")))
                at = pa.array(np.repeat(np.arange(first, after), [len(x) for x in tokens[first:after]]))
                columns = [*(batch.column(c).take(at) for c in ("g", "root", "n")), pa.array(np.concatenate(tokens[first:after]))]
                yield pa.RecordBatch.from_arrays(columns, ["g", "root", "n", "token"])
                first = after

    each = large.select("g", "root").distinct().join(sets.select("g", "n", "tokens"), "g").repartition("g").mapInArrow(work, "g long, root long, n long, token long")
    held = each.groupBy("token").agg(F.count(F.lit(1)).alias("held"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    shared = each.join(held.select("token", "held"), "token").groupBy("g", "root", "n")
    of_others = shared.agg(F.count(F.lit(1)).alias("shared"), F.sort_array(F.collect_list(F.when(F.col("held") <= RARE, F.struct("held", "token")))).alias("rare"))
    own = of_others.select("g", "root", "n", (F.col("n") - F.col("shared")).alias("own"), F.transform("rare", lambda x: x["token"]).alias("rare"))
    return own.where(F.col("own") <= how.most_without(F.col("n")))


def _rarest(ranked: DataFrame, how: Similarity) -> DataFrame:
    """a, b: pairs of different components whose prefixes share a rare token early enough to link.

    Tokens are ordered from rarest to commonest, so a prefix of one token more than a linked set may lack holds one that the linked set's
    prefix has too. Sets whose prefix is rare throughout take part; a token thus makes at most RARE squared pairs.
    """
    rows = ranked.select("g", "root", "n", "own", F.posexplode(F.slice("rare", F.lit(1), (how.most_without(F.col("n")) + 1 - F.col("own")).cast("int"))).alias("at", "token"))
    rows = materialize(rows.select("token", "g", "root", "n", (F.col("n") - F.col("own") - F.col("at")).alias("left")), "rarest")
    side = lambda s: rows.select("token", *[F.col(c).alias(s + c) for c in ("g", "root", "n", "left")])
    room = (100 + how.percent) * F.least("xleft", "yleft") >= how.percent * (F.col("xn") + F.col("yn"))
    both = side("x").join(side("y"), "token").where((F.col("xg") < F.col("yg")) & (F.col("xroot") != F.col("yroot")) & room)
    return both.select(F.col("xg").alias("a"), F.col("yg").alias("b")).distinct()


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def apart(met: DataFrame, sets: DataFrame, how: Similarity) -> DataFrame:
    """m, g, root, n, far (it does not link with centre m), short, prefix, tokens of the difference.

    Of the tokens in any one order, the ``short`` first ones hold one that any far partner shares, and the ``prefix`` first ones of a far set
    one that any partner shares.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, far, short, prefix, tokens = [], [], [], [], []
            for x, c in zip(views(batch.column("gtokens")), views(batch.column("mtokens")), strict=True):
                tokens.append(np.setxor1d(x, c, assume_unique=True).view(np.int64))
                d, n, m = len(tokens[-1]), len(x), len(c)
                # a far partner's difference is over most_apart(its size + m); that bound's growth from m to n is given up
                given_up = -(-(100 - how.percent) * max(0, n - m) // (100 + how.percent))
                size.append(n)
                far.append(d > how.most_apart(n + m))
                short.append(d - max(1, -(-(d + 1 - given_up) // 2)) + 1)
                prefix.append(max(short[-1], d - max(1, -(-(d - how.most_apart(n + m)) // 2)) + 1) if far[-1] else short[-1])
            data = [pa.array(size, pa.int64()), pa.array(far, pa.bool_()), pa.array(short, pa.int64()), pa.array(prefix, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("m", "g", "root")), *data], ["m", "g", "root", "n", "far", "short", "prefix", "tokens"])

    side = lambda s: sets.select(F.col("g").alias(s), F.col("tokens").alias(s + "tokens"))
    return met.join(side("g"), "g").join(side("m"), "m").mapInArrow(work, "m long, g long, root long, n long, far boolean, short long, prefix long, tokens array<long>")


def _prefixes(differ: DataFrame) -> DataFrame:
    """m, token, g, root, n, far, delta, place, full (place < short) of every set's prefix, in an order that puts common tokens last.

    Which tokens count as common changes no result: those that more than one in OFTEN of a centre's sets have, MOST_OFTEN at most.
    """
    # joined with tables, not aggregates, so that a centre of many sets is split; dealt anew by set before lists become rows
    sizes = materialize(differ.groupBy("m").agg(F.count(F.lit(1)).alias("sets")), "sizes")
    sized = differ.select("m", "g", "tokens").join(sizes, "m").repartition("g")
    held = sized.select("m", "sets", F.explode("tokens").alias("token")).groupBy("m", "token").agg(F.count(F.lit(1)).alias("held"), F.first("sets").alias("sets"))
    common = held.where((F.col("held") > 1) & (OFTEN * F.col("held") > F.col("sets"))).groupBy("m")
    common = materialize(common.agg(F.slice(F.sort_array(F.collect_list(F.struct("held", "token")), False), 1, MOST_OFTEN).alias("common")), "common")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, dict] = {}
        for batch in batches:
            tokens, delta = [], []
            lists, common = batch.column("tokens"), batch.column("common")
            for i, (m, prefix) in enumerate(zip(batch.column("m").to_pylist(), batch.column("prefix").to_pylist(), strict=True)):
                if m not in known:
                    if len(known) >= BATCH:
                        known.clear()
                    known[m] = {x["token"]: x["held"] for x in common[i].as_py() or ()}
                of, t = known[m], lists[i].as_py()
                delta.append(len(t))
                tokens.append(sorted(t, key=lambda x: (of.get(x, 0), x))[:prefix])  # noqa: B023
            kept = [batch.column(c) for c in ("m", "g", "root", "n", "far", "short")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(delta, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], ["m", "g", "root", "n", "far", "short", "delta", "tokens"])

    kinds = "m long, g long, root long, n long, far boolean, short long, delta long, tokens array<long>"
    rows = differ.join(common, "m", "left").mapInArrow(work, kinds).repartition("g")
    rows = rows.select("m", "g", "root", "n", "far", "delta", "short", F.posexplode("tokens").alias("place", "token"))
    return rows.withColumn("full", F.col("place") < F.col("short")).drop("short")


def _overlapping(rows: DataFrame, how: Similarity) -> DataFrame:
    """a, b: pairs of different components that share a token of their prefixes early enough to link.

    Two far sets share a token of their short parts, a far and a linked one a token of the first's prefix and of the second's short part;
    the first token they share leaves room for all others that they must share.
    """
    side = lambda s: rows.select("m", "token", *[F.col(c).alias(s + c) for c in ("g", "root", "n", "far", "delta", "place", "full")])
    two_full = F.col("yfull") & (F.col("xg") < F.col("yg")) & (F.col("xfar") | F.col("yfar"))
    needed = two_full | (~F.col("yfull") & ~F.col("xfar"))
    allowed = F.floor((100 - how.percent) * (F.col("xn") + F.col("yn")) / (100 + how.percent))
    room = 2 * F.least(F.col("xdelta") - F.col("xplace"), F.col("ydelta") - F.col("yplace")) >= F.col("xdelta") + F.col("ydelta") - allowed
    alike = 100 * F.least("xn", "yn") >= how.percent * F.greatest("xn", "yn")
    both = side("x").where("xfull").join(side("y"), ["m", "token"]).where((F.col("xroot") != F.col("yroot")) & needed & alike & room)
    return both.select(*_ordered("xg", "yg")).distinct()


def _unfinished(members: DataFrame, roots: DataFrame) -> DataFrame:
    """key, g, root, few of the keys whose sets are in several components; few: pairs in proportion to sets."""
    at = roots.select(F.col("node").alias("g"), "root")
    return _in_several(materialize(members.join(at, "g", "left").withColumn("root", F.coalesce("root", "g")), "placed"))


def _in_several(placed: DataFrame) -> DataFrame:
    by = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"))
    return placed.join(by.where("lo != hi").select("key", (F.col("size") <= SMALL_KEY).alias("few")), "key")


def _small_pairs(members: DataFrame) -> DataFrame:
    """a, b: the pairs of every key's sets that are in different components."""
    side = lambda s: members.select("key", F.col("g").alias(s), F.col("root").alias(s + "root"))
    return side("a").join(side("b"), "key").where((F.col("a") < F.col("b")) & (F.col("aroot") != F.col("broot"))).select("a", "b").distinct()


def link_classes(docs: DataFrame, classes: DataFrame, how: Similarity) -> DataFrame:
    """node, root: the components of the classes (g, n, doc_id, h, c1, c2) that link with another one."""
    # two sets of one c1 both take its keys; what they share is verified
    members = materialize(shared_keys(keys(docs, how)).join(classes.select("c1", "g"), "c1").select("key", "g"), "members")
    free_shuffles(docs.sparkSession)
    wanted = classes.join(members.select("g").distinct(), "g", "left_semi").select("g", "n", "doc_id", "h", "c1", "c2")
    with small_batches(docs.sparkSession):
        sets = materialize(token_sets(docs, wanted, how), "sets")
        free_shuffles(docs.sparkSession)
        pairs = materialize(_centre(members.withColumn("root", F.col("g"))).select(*_ordered("g", "m")).distinct(), "pairs")
        links = materialize(verify(pairs, sets, how), "links")
    drop_table(pairs)
    roots = connected_components(links)
    open_ = materialize(_unfinished(members, roots), "open")
    drop_table(members)
    large = open_.where("NOT few")
    # sets with enough rare tokens meet by these; those with few, and those that may link with such a one, by their differences from a centre
    most = how.most_without(F.col("n"))
    with small_batches(docs.sparkSession):
        ranked = materialize(rarities(large, sets, how), "ranked")
    free_shuffles(docs.sparkSession)
    scarce = F.col("own") + F.size("rare")
    few_rare = ranked.where(scarce <= most + how.most_without(F.floor(100 * F.col("n") / how.percent))).select("g")
    common = materialize(_in_several(materialize(large.select("key", "g", "root").join(few_rare, "g", "left_semi"), "common")), "common")
    large = common.where("NOT few")
    met = _centre(large).join(large.select("g", "root").distinct(), "g")
    with small_batches(docs.sparkSession):
        differ = materialize(apart(met, sets, how), "apart")
        prefixes = materialize(_prefixes(differ), "prefixes")
        left = _small_pairs(open_.where("few").unionByName(common.where("few")))
        left = left.unionByName(_rarest(ranked.where(scarce > most), how)).unionByName(_overlapping(prefixes, how))
        pairs = materialize(left.distinct(), "pairs")
        found = materialize(verify(pairs, sets, how), "links")
    for done in (sets, open_, prefixes, pairs):
        drop_table(done)
    near = differ.where(~F.col("far")).select(*_ordered("g", "m"))
    return connected_components(links.unionByName(near).unionByName(found))


def _grouped(docs: DataFrame, how: Similarity) -> DataFrame:
    """doc_id, h (of the text), n_shingles, component_id for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    rows = materialize(profiles(docs, how), "profiles")
    held = rows.where(F.col("n") > 0)
    # a class's text: one of its smallest id
    text = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("text")
    classes = held.groupBy("c1", "c2", "n").agg(text).select("c1", "c2", "n", "text.doc_id", "text.h")
    classes = materialize(classes.withColumn("g", F.monotonically_increasing_id()), "classes")
    roots = link_classes(docs, classes, how)
    at = roots.select(F.col("node").alias("g"), "root")
    named = classes.join(at, "g", "left").select("c1", "c2", "n", "doc_id", F.coalesce("root", "g").alias("root"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_class = named.join(least, "root").select("c1", "c2", "n", "component_id")
    out = held.join(of_class, ["c1", "c2", "n"]).select("doc_id", "h", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.where(F.col("n") == 0).select("doc_id", "h", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def jaccard_components(docs: DataFrame, k: int = 4, percent: int = 85) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two rows link when their sets' similarity is at least ``percent`` / 100. A null or empty text and one without words have no
    shingles, link with nothing and are their own component. Repeated rows link with each other; rows that share an id but not the text are
    compared each by its own text. A null doc_id is never a component's smallest; where there is no other it is null. Other columns
    are ignored; an empty table gives an empty result.
    """
    return _grouped(docs, Similarity(k, percent)).drop("h")


def keep_one(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """``docs`` without all but one document of each group of linked ones; texts without words stay.

    The document of the group's smallest id stays. Of the rows that repeat its id and text, the one whose other columns come first as JSON
    stays. A group whose ids are all null stays as it is, but for such repeats. Names of columns are free; an empty table stays empty.
    """
    groups = _grouped(docs, Similarity(k, percent))
    stays = groups.where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))
    # plain columns as keys, so that the join's shuffle of the texts serves the grouping too
    names = lambda id_, h: (F.coalesce(id_, F.lit(0).cast("long")).alias("id"), id_.isNull().alias("none"), h.alias("h"))
    rows = docs.select(*names(F.col("doc_id").cast("long"), F.xxhash64("text")), F.struct(*docs.columns).alias("row"))
    kept = rows.join(stays.select(*names(F.col("doc_id"), F.col("h"))).distinct(), ["id", "none", "h"], "left_semi")
    # others than id and text decide between repeats, so that a task that runs again keeps the same row
    rest = F.to_json(F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("doc_id", "text")], F.lit(0).alias("_")))
    return kept.groupBy("id", "none", "h").agg(F.min_by("row", rest).alias("row")).select("row.*")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read(spark, sf_dir, "documents"))
