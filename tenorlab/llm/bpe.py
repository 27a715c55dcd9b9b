"""Byte-level BPE encoding and decoding with a minimal acyclic transducer as the lexicon.

Words are the pre-tokens of the tokenizer's own pattern. The words that hold at least MIN_SHARE of all word occurrences in the
corpus (so at most 1 / MIN_SHARE of them) are compiled, with their ids, into a minimal acyclic automaton: equal suffixes
share states, and the outputs summed along a word's path give its rank, which indexes a table of ids. The automaton is one
file of flat arrays in the shared folder that every worker fetches and maps into memory. Words it does not hold are merged exactly: short
ones by the public rank-merging core, long ones rank by rank in arrays, so a text of one huge word or of millions of spaces takes bounded steps.

Each worker remembers a bounded number of words; a batch looks a word up once, however often it occurs.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import struct
import uuid
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tenorlab.llm._common import materialize, read, write_shared

#: Fixed value: the pre-token pattern of this kind of vocabulary.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A lexicon word holds at least this share of all occurrences.
MIN_SHARE = 1e-6
#: Bytes from which a word is merged in arrays; a text with a run of so many characters of one kind is cut by the pattern first.
LONG = 512
_RUN = regex.compile(rf"\s{{{LONG}}}|\S{{{LONG}}}")
_BYTES = [bytes((b,)) for b in range(256)]
#: First bytes of words after which a worker remembers where the automaton stands.
HEAD = 4
#: Words a worker remembers, and counts it holds before it emits them.
REMEMBERED = 400_000


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins for bytes: printable Latin-1 stands for itself, the rest is counted up from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Ids of byte strings, merge ranks and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._understood(spec)
        stand = _byte_of_char()
        raw = lambda s: bytes(stand[c] for c in s)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        self.bytes = {i: t for t, i in self.ids.items()}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.merges = {(self.ids[raw(a)], self.ids[raw(b)]): (rank, self.ids[raw(a) + raw(b)]) for rank, (a, b) in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.pieces = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.numbers = [str(i) for i in range(len(self.pieces))]
        # where ids stand in merge order, byte strings and ids are all that a rank-merging library needs
        merged = [new for _, new in self.merges.values()]
        self.core = tiktoken.Encoding("own", pat_str=WORDS.pattern, mergeable_ranks=self.ids, special_tokens=self.special) if merged == sorted(merged) else None
        order = sorted((a << 32 | b, rank, new) for (a, b), (rank, new) in self.merges.items())
        self._pairs, self._ranks, self._new = (np.array(x, np.int64) for x in (zip(*order, strict=True) if order else ([], [], [])))
        self._byte_ids = np.array([self.ids.get(bytes((b,)), -1) for b in range(256)], np.int64)
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @staticmethod
    def _understood(spec: dict) -> None:
        """Raise where a file asks for what is not done here."""
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [f"{t['content']}: {k}" for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
        odd += ["normalizer"] * bool(spec.get("normalizer"))
        odd += ["pre_tokenizer"] * (cut.get("type") != "ByteLevel" or bool(cut.get("add_prefix_space")) or not cut.get("use_regex", True))
        if odd or model.get("type", "BPE") != "BPE":
            raise ValueError(f"only plain byte-level BPE files are understood; this one has {', '.join(odd) or model['type']}")

    def words(self, text: str) -> list[str]:
        """The text cut into words and special strings, nothing left out."""
        if self._split is None or not any(s in text for s in self.special):
            return WORDS.findall(text)
        out: list[str] = []
        for k, part in enumerate(self._split.split(text)):
            out += [part] if k % 2 else WORDS.findall(part)
        return out

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text."""
        if self.core is not None and not _RUN.search(text):
            return self.core.encode_to_numpy(text, allowed_special="all")
        held, out = [], []
        for w in self.words(text):
            if len(w) < LONG or w in self.special:
                held += self.merge(w)
            else:
                out += [np.array(held, np.uint32), self.merge_ranks(w)]
                held = []
        return np.concatenate([*out, np.array(held, np.uint32)])

    def merge(self, word: str) -> list[int]:
        """The exact ids of one word."""
        if word in self.special:
            return [self.special[word]]
        if len(word) >= LONG:
            return self.merge_ranks(word).tolist()
        return self.core.encode_ordinary(word) if self.core is not None else self.merge_by_pairs(word)

    def merge_ranks(self, word: str) -> np.ndarray:
        """The word's ids by all merges of one rank at a time, lowest first: a merged pair's own merges rank higher, so none is missed."""
        ids = self._byte_ids[np.frombuffer(word.encode("utf-8", "surrogatepass"), np.uint8)]
        n = len(ids)
        after, before = np.append(np.arange(1, n), -1), np.arange(-1, n - 1)
        waiting: dict[int, list[np.ndarray]] = {}
        ranks: list[int] = []

        def offer(left: np.ndarray) -> None:
            """Note the merges of the pairs that begin at ``left``."""
            left = left[after[left] >= 0]
            if not len(left) or not len(self._pairs):
                return
            pair = ids[left] << 32 | ids[after[left]]
            at = np.minimum(np.searchsorted(self._pairs, pair), len(self._pairs) - 1)
            known = self._pairs[at] == pair
            left, at = left[known], at[known]
            order = np.argsort(self._ranks[at], kind="stable")
            left, at = left[order], at[order]
            for part, rank in zip(np.split(left, cut := np.flatnonzero(np.diff(self._ranks[at])) + 1), self._ranks[at[np.concatenate([[0], cut])]].tolist() if len(at) else (), strict=False):
                if rank not in waiting:
                    waiting[rank] = []
                    heapq.heappush(ranks, rank)
                waiting[rank].append(part)

        place = np.argsort(self._ranks)
        offer(np.arange(n))
        while ranks:
            rank = heapq.heappop(ranks)
            parts = waiting.pop(rank)
            left = np.unique(np.concatenate(parts))
            a, b = divmod(int(self._pairs[place[rank]]), 1 << 32)
            left = left[(ids[left] == a) & (after[left] >= 0)]
            left = left[ids[after[left]] == b]
            if a == b and len(left):  # of a run of equal tokens every other one, from the left
                follows = np.concatenate([[False], after[left[:-1]] == left[1:]])
                start = np.maximum.accumulate(np.where(follows, 0, np.arange(len(left))))
                left = left[(np.arange(len(left)) - start) % 2 == 0]
            right = after[left]
            ids[left], ids[right] = self._new[place[rank]], -1
            after[left] = after[right]
            some = after[left] >= 0
            before[after[left[some]]] = left[some]
            near = before[left]
            offer(np.unique(np.concatenate([near[near >= 0], left])))
        return ids[ids >= 0].astype(np.uint32)

    def merge_by_pairs(self, word: str) -> list[int]:
        """The word's ids by merging the pair of lowest rank, leftmost first, until none is left; a heap keeps long words cheap."""
        ids = [self.ids[bytes((b,))] for b in word.encode("utf-8", "surrogatepass")]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (m := merges.get((ids[left], ids[right]))):
                    heapq.heappush(heap, (m[0], left, ids[left], ids[right], m[1]))
        return [x for x in ids if x >= 0]


class Transducer:
    """A minimal acyclic automaton over words, mapped from a file; ``ids(word)`` gives its output or None."""

    _HEAD = struct.Struct("<5I")

    @staticmethod
    def build(entries: Iterable[tuple[str, list[int]]]) -> bytes:
        """Compile (word, ids): states are made in word order and joined with an equal one as soon as no later word can change them."""
        words = sorted({w.encode("utf-8", "surrogatepass"): ids for w, ids in entries}.items())
        # a state: [is a word's end, {byte: state number}]; open states lie on the path of the last word
        known: dict[tuple, int] = {}
        states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
        path: list[list] = [[False, {}]]
        last = b""

        def close(down_to: int) -> None:
            while len(path) > down_to + 1:
                end, arcs = path.pop()
                key = (end, tuple(arcs.items()))
                if key not in known:
                    known[key] = len(states)
                    states.append(key)
                path[-1][1][last[len(path) - 1]] = known[key]

        for word, _ in words:
            shared = len(os.path.commonprefix([word, last]))
            close(shared)
            path.extend([False, {}] for _ in word[shared:])
            path[-1][0] = True
            last = word
        close(0)
        root = len(states)
        states.append((path[0][0], tuple(path[0][1].items())))
        below: list[int] = []  # words that end at or below a state; targets come first
        first, target, out, end, labels = array("I"), array("I"), array("I"), bytearray(), bytearray()
        for is_end, arcs in states:
            first.append(len(target))
            end.append(is_end)
            passed = int(is_end)
            for label, to in arcs:
                labels.append(label)
                target.append(to)
                out.append(passed)
                passed += below[to]
            below.append(passed)
        first.append(len(target))
        offset, ids = array("I", [0]), array("I")
        for _, x in words:
            ids.extend(x)
            offset.append(len(ids))
        pad = lambda b: bytes(b) + b"\0" * (-len(b) % 4)
        head = Transducer._HEAD.pack(root, len(states), len(target), len(words), len(ids))
        return head + b"".join((first.tobytes(), target.tobytes(), out.tobytes(), offset.tobytes(), ids.tobytes(), pad(end), pad(labels)))

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, self.n_states, n_arcs, self.n_words, n_ids = self._HEAD.unpack_from(self._map, 0)
        numbers, at, parts = memoryview(self._map), self._HEAD.size, []
        for n in (self.n_states + 1, n_arcs, n_arcs, self.n_words + 1, n_ids):
            parts.append(numbers[at : at + 4 * n].cast("I"))
            at += 4 * n
        self._first, self._target, self._out, self._offset, self._ids = parts
        self._heads: dict[bytes, tuple[int, int] | None] = {}
        self._end, self._labels = at, at + self.n_states + -self.n_states % 4

    def _walk(self, data: bytes, state: int, rank: int) -> tuple[int, int] | None:
        """State and rank after some bytes; None where no word goes on so."""
        find, base, first, out, target = self._map.find, self._labels, self._first, self._out, self._target
        for b in data:
            arc = find(_BYTES[b], base + first[state], base + first[state + 1])
            if arc < 0:
                return None
            rank += out[arc - base]
            state = target[arc - base]
        return state, rank

    def ids(self, word: str) -> list[int] | None:
        data = word.encode("utf-8", "surrogatepass")
        head = data[:HEAD]
        try:
            at = self._heads[head]
        except KeyError:
            if len(self._heads) >= REMEMBERED // 4:
                self._heads.clear()
            at = self._heads[head] = self._walk(head, self.root, 0)
        at = at and self._walk(data[HEAD:], *at)
        if not at or not self._map[self._end + at[0]]:
            return None
        return self._ids[self._offset[at[1]] : self._offset[at[1] + 1]].tolist()


class Memory(dict):
    """word -> what ``make`` gives for its ids; bounded: it starts anew when full."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Transducer | None, make):
        super().__init__()
        self.vocabulary, self.lexicon, self.make = vocabulary, lexicon, make

    def __missing__(self, word: str):
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self.lexicon.ids(word) if self.lexicon else None
        got = self.make(self.vocabulary.merge(word) if ids is None else ids)
        if len(word) < 100:
            self[word] = got
        return got


_loaded: dict = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def count_words(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """word, n over all whole texts. Workers count locally and emit before they hold too many words; the sums stay exact."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held = vocabulary(vocabulary_path).words, Counter()
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for text in batch.column(0).to_pylist():
                held.update(words(text or ""))
                if len(held) > REMEMBERED:
                    yield emit()
                    held.clear()
        yield emit()

    return docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, vocabulary_path: str, min_share: float = MIN_SHARE) -> str:
    """The name of the lexicon file that every worker can get; at most 1 / min_share words reach the driver."""
    counts = materialize(count_words(docs, vocabulary_path), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent = [r["word"] for r in counts.where(F.col("n") >= F.lit(min_share * total)).select("word").collect()]
    known = vocabulary(vocabulary_path)
    name = f"lexicon-{uuid.uuid4().hex}.fst"
    path = write_shared(docs.sparkSession, name, Transducer.build((w, known.merge(w)) for w in frequent if w not in known.special))
    docs.sparkSession.sparkContext.addFile(path)
    return name


_local: dict[str, Transducer] = {}


def lexicon(name: str) -> Transducer:
    if name not in _local:
        _local[name] = Transducer(SparkFiles.get(name))
    return _local[name]


def encode_documents(docs: DataFrame, vocabulary_path: str, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, n_tokens, ids (comma-joined) and decoded text reduced to digests: one row per row of ``docs``.

    A null or empty text has no ids: its digests are of the empty string. Rows may repeat and ids may be null; other
    columns are ignored; an empty table gives an empty result. A special string in a text becomes its own id.
    """
    name = compile_lexicon(docs, vocabulary_path, min_share)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(vocabulary_path)
        numbers, pieces = known.numbers, known.pieces
        memory = Memory(known, lexicon(name), lambda ids: (",".join([numbers[i] for i in ids]), b"".join([pieces[i] for i in ids])))
        for batch in batches:
            n, said, back = [], [], []
            for text in batch.column(1).to_pylist():
                got = [memory[w] for w in known.words(text)] if text else []
                ids = ",".join([x[0] for x in got])
                n.append(ids.count(",") + 1 if got else 0)
                said.append(hashlib.sha256(ids.encode()).hexdigest())
                back.append(hashlib.sha256(b"".join([x[1] for x in got]).decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(said, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read(spark, sf_dir, "documents"), default_vocabulary())
