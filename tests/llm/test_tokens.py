import hashlib
import random

import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tenorlab.llm import bpe, packing
from tests.llm.conftest import rows

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def reference():
    return tokenizers.Tokenizer.from_file(bpe.default_vocabulary())


def test_merges_match_the_library_on_any_characters(reference):
    known = bpe.vocabulary(bpe.default_vocabulary())
    r = random.Random(3)
    kinds = [c for c in map(chr, range(0x3000)) if unicodedata.category(c) not in ("Cs", "Cn")] + ["😀", "𝔘", "<|endoftext|>", "'s", "'ll", "   ", "\n\n"]
    texts = ["".join(r.choice(kinds) for _ in range(60)) for _ in range(400)] + ["a" * 5000, "ab" * 3000, " " * 700, "x  \n y", "", "ﬁ\x85\x1c y"]
    for t in texts:
        want = reference.encode(t, add_special_tokens=False).ids
        got = [i for w in known.words(t) for i in known.merge(w)]
        assert got == want and known.encode(t).tolist() == want
        assert [i for w in known.words(t) for i in (known.merge_by_pairs(w) if w not in known.special else [known.special[w]])] == want
        assert b"".join(known.bytes[i] for i in got).decode("utf-8", "replace") == reference.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize("text", [" ", "\n", "\u00a0", "a", "ab", "!", "é", "xyz ", "\n\t", "1"])
def test_very_long_runs_match_the_library(reference, text):
    known = bpe.vocabulary(bpe.default_vocabulary())
    for t in (text * 1_000_000, "word " + text * 100_001 + "word"):
        want = np.array(reference.encode(t, add_special_tokens=False).ids)
        assert np.array_equal(known.encode(t), want)
        assert np.array_equal([i for w in known.words(t) for i in known.merge(w)], want)


def test_long_words_merge_like_short_ones(reference):
    known, r = bpe.vocabulary(bpe.default_vocabulary()), random.Random(6)
    for letters in ("ab", "etaoinshrdlu", "aaaaab", "0123456789", "éü😀a"):
        for n in (1, 2, 3, 7, 600, 20_000):
            w = "".join(r.choice(letters) for _ in range(n))
            want = reference.encode(w, add_special_tokens=False).ids
            assert [i for x in known.words(w) for i in known.merge_ranks(x)] == want and known.encode(w).tolist() == want


def test_files_of_other_kinds_are_refused():
    import json

    with open(bpe.default_vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    bpe.Vocabulary._understood(spec)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"content": "<x>", "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.Vocabulary._understood(spec | change)


def test_transducer_is_exact_and_minimal(tmp_path):
    r = random.Random(1)
    words = {"".join(r.choice("abcé") for _ in range(r.randint(1, 7))): [r.randrange(50_000) for _ in range(r.randint(1, 4))] for _ in range(800)}
    (tmp_path / "f").write_bytes(bpe.Transducer.build(words.items()))
    t = bpe.Transducer(str(tmp_path / "f"))
    assert all(t.ids(w) == ids for w, ids in words.items())
    other = ["".join(r.choice("abcéd") for _ in range(r.randint(0, 8))) for _ in range(2000)]
    assert all(t.ids(w) is None for w in other if w not in words)

    # the number of states is the number of different sets of what can follow a prefix
    follows = defaultdict(set)
    for w in (x.encode() for x in words):
        for i in range(len(w) + 1):
            follows[w[:i]].add(w[i:])
    assert t.n_states == len({frozenset(v) for v in follows.values()})
    (tmp_path / "e").write_bytes(bpe.Transducer.build([]))
    assert bpe.Transducer(str(tmp_path / "e")).ids("a") is None


def test_encoded_documents(docs, none, reference):
    got = Counter(tuple(r) for r in bpe.encode_documents(docs, bpe.default_vocabulary(), 1e-3).collect())
    want = Counter()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t, *_ in rows():
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want[(i, len(ids), sha(",".join(map(str, ids))), sha(reference.decode(ids, skip_special_tokens=False)))] += 1
    assert got == want
    assert bpe.encode_documents(none, bpe.default_vocabulary()).count() == 0


def check_packing(placed, capacity):
    by = defaultdict(list)
    for r in placed:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packed_documents(docs, none, reference):
    placed = packing.pack_documents(docs, bpe.default_vocabulary(), 64).collect()
    want = Counter()
    for i, t, *_ in rows():
        ids, at, k = [*reference.encode(t or "", add_special_tokens=False).ids, 0], 0, 0
        while at < len(ids):
            n = (len(ids) - at) % 64 or 64
            want[(i, k, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()))] += 1
            at, k = at + n, k + 1
    assert Counter(tuple(r)[:5] for r in placed) == want
    check_packing(placed, 64)
    assert packing.pack_documents(none, bpe.default_vocabulary()).count() == 0


def test_levels_merge_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_A_PARTITION", 40)
    monkeypatch.setattr(packing, "OPEN", 20)
    r = random.Random(2)
    items = spark.createDataFrame([(i, 0, 0, r.randint(1, 100), i) for i in range(1000)], packing.ITEM)
    placed = packing.pack_items(items, 100).collect()
    assert sorted(x.doc_id for x in placed) == list(range(1000))
    least = sum(x.length for x in placed) / 100
    assert check_packing(placed, 100) <= 1.1 * least


@pytest.mark.parametrize("at", [0, 2, 3])
def test_bins_with_little_room_take_what_fits(spark, monkeypatch, at):
    # a partition an item: three tokens meet the bins that have three free on later levels only
    monkeypatch.setattr(packing, "ITEMS_A_PARTITION", 1)
    lengths = [97] * 4
    lengths.insert(at, 3)
    items = spark.createDataFrame([(i, 0, 0, n, i) for i, n in enumerate(lengths)], packing.ITEM).coalesce(1)
    assert check_packing(packing.pack_items(items, 100).collect(), 100) == 4


def test_the_bins_kept_back_save_no_sequence(spark, monkeypatch):
    monkeypatch.setattr(packing, "ITEMS_A_PARTITION", 30)
    r = random.Random(5)
    items = spark.createDataFrame([(i, 0, 0, r.choice([r.randint(1, 10), r.randint(40, 99)]), i) for i in range(900)], packing.ITEM).coalesce(1)
    n = []
    for handed_on in (16, 10**6):
        monkeypatch.setattr(packing, "OPEN", handed_on)
        n.append(check_packing(packing.pack_items(items, 100).collect(), 100))
    assert n[0] == n[1]


def test_best_fit_takes_the_fullest_bin():
    bins, offset, free = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert bins.tolist() == [0, 1, 0, 1, 1] and offset.tolist() == [0, 0, 6, 5, 8] and free.tolist() == [0, 0]


