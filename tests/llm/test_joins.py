import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tenorlab.llm import embedding_dedup, jaccard_join
from tenorlab.llm.components import connected_components
from tests.llm.conftest import rows, words


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def brute_components(texts, k, percent):
    """doc -> (set size, smallest linked doc) by comparing every two."""
    import re

    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    parent = {i: i for i, _ in texts}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(parent, a), find(parent, b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(parent, i)) for i in ids}


def mutated(base, rate, r):
    return " ".join(f"w{r.randrange(10**6)}" if r.random() < rate else w for w in base)


@pytest.mark.parametrize(("k", "percent", "small"), [(4, 85, 1), (5, 80, 16)])
def test_components_match_brute_force_near_the_threshold(spark, k, percent, small, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL_KEY", small)
    r = random.Random(k)
    texts = []
    passage = words(99, 60).split()
    for g in range(12):
        base = words(g, r.choice([8, 15, 40, 120, 400])).split()
        for _ in range(r.randint(1, 14)):
            texts.append((len(texts), mutated(base, r.choice([0, 0.01, 0.02, 0.03]), r)))
    texts += [(len(texts) + i, " ".join([*words(200 + i, 90).split(), *passage])) for i in range(30)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), k, percent).collect()}
    assert got == brute_components(texts, k, percent)


def test_every_linked_pair_shares_a_key():
    r = np.random.default_rng(4)
    for how in (jaccard_join.Similarity(4, 85), jaccard_join.Similarity(5, 80)):
        for _ in range(300):
            n = int(r.integers(1, 900))
            a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[r.random(len(a)) > 0.09], r.integers(0, 2**63, int(r.integers(0, 1 + n // 11))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and 100 * both >= how.percent * (len(a) + len(b) - both):
                apart = len(a) + len(b) - 2 * both
                assert jaccard_join.hamming(jaccard_join.dense_sketch(a), jaccard_join.dense_sketch(b)) <= apart
                keys = [{int(x) for part in jaccard_join.block_keys(s, how) for x in part} for s in (a, b)]
                assert keys[0] & keys[1] or not apart


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80)])
def test_all_sizes_up_to_sixty_share_a_key(k, percent):
    how, r = jaccard_join.Similarity(k, percent), np.random.default_rng(9)
    assert all(low <= n <= high and blocks > how.apart_from_any(n, high) for n in range(1, 3000) for _, low, high, blocks in how.schemes(n))
    for m in range(1, 61):
        for n in range(m, 61):
            least = -(-percent * (m + n) // (100 + percent))  # shared tokens of a pair just linked
            if least > m or m == n == least:
                continue
            for _ in range(4):
                t = np.unique(r.integers(0, 2**63, m + n - least).astype(np.uint64))
                r.shuffle(t)
                a, b = np.sort(t[:m]), np.sort(t[m - least :])
                assert len(a) == m and len(b) == n
                one, two = ({int(x) for part in jaccard_join.block_keys(s, how) for x in part} for s in (a, b))
                assert one & two, (m, n)


def edited(base, rate, r):
    """Words replaced, dropped and inserted."""
    out = []
    for w in base:
        x = r.random()
        if x < rate:
            out += r.choice([[f"w{r.randrange(10**6)}"], [], [w, f"w{r.randrange(10**6)}"]])
        else:
            out.append(w)
    return " ".join(out)


@pytest.mark.parametrize(("small", "seed"), [(1, 1), (1, 2), (4, 3), (1000, 4)])
def test_clouds_of_copies_around_the_threshold(spark, monkeypatch, small, seed):
    # many sets of one key that do not link with its centre: small = 1 settles every key by what differs from centres
    monkeypatch.setattr(jaccard_join, "SMALL_KEY", small)
    r = random.Random(seed)
    base = words(seed, 120).split()
    other = edited(base, 0.06, r).split()  # a second centre with copies of its own
    texts = [(i, edited(r.choice([base, base, other]), r.choice([0, 0.004, 0.01, 0.02, 0.03, 0.05, 0.1]), r)) for i in range(160)]
    texts += [(1000 + i, " ".join(base[: r.randint(90, 120)])) for i in range(12)]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    want = brute_components(texts, 4, 85)
    assert got == want and len({c for _, c in want.values()}) > 10


@pytest.mark.parametrize(("rare", "small"), [(1, 1), (2, 1), (3, 4), (16, 1), (1000, 1)])
def test_rare_tokens_and_differences_together_lose_no_link(spark, monkeypatch, rare, small):
    monkeypatch.setattr(jaccard_join, "RARE", rare)
    monkeypatch.setattr(jaccard_join, "SMALL_KEY", small)
    r = random.Random(rare)
    passage = words(7, 50).split()
    texts = []
    for g in range(14):
        # texts that share a passage; of some there are chains of copies
        base = [*words(300 + g, r.choice([20, 60, 100])).split(), *passage]
        for _ in range(r.choice([1, 2, 3, 12])):
            base = edited(base, r.choice([0.01, 0.02, 0.03]), r).split()
            texts.append((len(texts), " ".join(base)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute_components(texts, 4, 85)


def test_a_shared_passage_sends_few_tokens(spark, monkeypatch):
    made, plain = {}, jaccard_join.materialize

    def counting(df, tag):
        out = plain(df, tag)
        made[tag] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "materialize", counting)
    passage = words(8, 80).split()
    texts = [(i, " ".join([*words(500 + i, 60).split(), *passage])) for i in range(120)]
    got = jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), 5, 80).collect()
    assert {x.component_id for x in got} == set(range(120))
    # 60 words of its own leave no text a link; all of them met in keys of the passage
    assert made["open"] > 120 and made["prefixes"] + made.get("rarest", 0) < 120


def test_rows_of_one_id_and_null_ids_are_compared_by_their_own_text(spark):
    near = words(1, 80).split()
    texts = [(7, words(1, 80)), (7, words(2, 80)), (None, words(2, 80)), (3, " ".join([*near[:40], "x", *near[41:]])), (None, words(3, 80)), (None, words(3, 80) + " y")]
    got = jaccard_join.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string"), 4, 80)
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == Counter(
        {(7, 77, 3): 1, (7, 77, 7): 1, (None, 77, 7): 1, (3, 77, 3): 1, (None, 77, None): 1, (None, 78, None): 1}
    )


def test_repeats_that_differ_elsewhere_keep_one_row_always_the_same(spark):
    rows_ = [(1, words(1, 30), x) for x in "cab"] + [(None, words(2, 30), "z"), (None, words(2, 30), "y")]
    got = jaccard_join.keep_one(spark.createDataFrame(rows_, "doc_id int, text string, stays string"), 5, 80)
    assert got.columns == ["doc_id", "text", "stays"] and sorted((r.doc_id or 0, r.stays) for r in got.collect()) == [(0, "y"), (1, "a")]


def test_rows_of_one_id_and_null_ids_stay_by_their_own_text(spark):
    texts = [(7, words(1, 80), "a"), (7, words(2, 80), "b"), (3, words(1, 80), "c"), (None, words(2, 80), "d"), (None, words(3, 80), "e")]
    got = jaccard_join.keep_one(spark.createDataFrame(texts, "doc_id long, text string, h string"), 5, 80)
    # of the rows and of the ids that stay
    assert got._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(id#") == 2
    assert sorted(r.h for r in got.collect()) == ["b", "c", "e"]


def test_odd_rows(docs, none):
    got = jaccard_join.jaccard_components(docs).collect()
    assert len(got) == len(rows())
    of = defaultdict(set)
    for r in got:
        of[r.doc_id].add((r.n_shingles, r.component_id))
    assert of[0] == {(297, 0)} and of[1] == {(297, 0)} and of[2] == {(297, 0)}
    assert of[3] == {(0, 3)} and of[4] == {(0, 4)} and of[5] == {(0, 5)} and of[6] == {(1, 6)} and of[7] == {(1, 6)}
    assert of[None] == {(47, None)} and len(of[9]) == 1 and of[8] == {(19_997, 8)}
    assert jaccard_join.jaccard_components(none).count() == 0


def test_one_document_of_each_group_stays(docs, none):
    got = jaccard_join.keep_one(docs, 5, 80)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter({None: 1, **{i: 1 for i in (0, 3, 4, 5, 6, 8, 9, 10, 11, 12, 13, 14, 15, 16)}})
    assert jaccard_join.keep_one(none, 5, 80).count() == 0


def test_connected_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + r.randrange(1, 50)) for _ in range(60)] + [(7777, 7777)] + [(r.randrange(1000, 1100), r.randrange(1000, 1100)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(parent, x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def vectors(seed=0, n=400, labels=2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 64))
    for i in range(0, n // 2, 5):
        x[i + 1] = x[i] + r.normal(size=64) * 0.1
    x[n // 2 : n // 2 + 60] = x[0] + r.normal(size=(60, 64)) * 0.13  # a hot group around the threshold
    x[n - 10 :] = x[n - 11]
    return [(i, [float(v) for v in np.float32(x[i])], int(i % labels) if n // 2 <= i or i % 5 > 1 else 0) for i in range(n)]


def brute_links(data):
    x = np.array([v for _, v, _ in data])
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([k for *_, k in data])
    m = (x @ x.T >= embedding_dedup.THRESHOLD) & (label[:, None] == label[None, :])
    np.fill_diagonal(m, False)
    parent = {i: i for i, *_ in data}
    for a, b in zip(*np.nonzero(m), strict=True):
        p, q = find(parent, int(a)), find(parent, int(b))
        parent[max(p, q)] = min(p, q)
    return m, {i: find(parent, i) for i in parent}


@pytest.mark.parametrize(("shard", "chunk"), [(600, 2048), (60, 2048), (60, 50)])
def test_vector_links_against_brute_force(spark, monkeypatch, shard, chunk):
    monkeypatch.setattr(embedding_dedup, "SHARD", shard)
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    data = vectors()
    m, component = brute_links(data)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    assert all(got[i].n_links <= m[i].sum() for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.98 * m.sum() > 100
    wrong = sum(got[i].component_id != component[i] for i in got)
    assert wrong <= (0 if shard == 600 else 2)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_a_tight_group_is_found_whole():
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=64) + r.normal(size=(300, 64)) * 0.1, r.normal(size=(500, 64))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = x @ x.T
    lists = embedding_dedup.both_ways(embedding_dedup.robust_prune(cos, embedding_dedup.DEGREE, embedding_dedup.CANDIDATES))
    assert all(i in lists[j] for i in range(800) for j in lists[i])
    found = embedding_dedup.range_search(x, x, lists, 500, np.arange(800), embedding_dedup.THRESHOLD)
    truth = cos >= embedding_dedup.THRESHOLD
    assert truth.sum() > 20_000 and not (found & ~truth).any() and found.sum() >= 0.99 * truth.sum()
    # a query that is not in the graph comes from the medoid alone
    far = embedding_dedup.range_search(x[:300], x, lists, 500, np.full(300, -1), embedding_dedup.THRESHOLD)
    assert not (far & ~truth[:300]).any()


def test_odd_vectors(spark):
    data = [
        (1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [1.0, 0.0], 0), (3, [1.0, 0.0], 0), (4, [1.0, 0.0], None), (5, None, 0), (6, [0.0, 0.0], 0), (7, [float("nan"), 1.0], 0),
        (8, [float("inf"), 1.0], 0), (9, [1.0, None], 0), (10, [1.0, 0.0, 0.0], 0), (11, [], 0), (None, [1.0, 0.0], 0), (12, [1.0, 0.0], 1),
    ]
    frame = spark.createDataFrame([(*d, "x", 1) for d in data], "vec_id long, embedding array<float>, label int, unit string, dim int")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(frame).collect())
    want = Counter([(1, 4, 1, True), (2, 4, 1, False), (3, 4, 1, False), (3, 4, 1, False), (None, 4, 1, False)])
    want += Counter((i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10, 11, 12))
    assert got == want
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_a_vector_that_holds_a_null_is_not_taken_for_the_one_without(spark):
    data = [(1, [1.0, 2.0], 0), (2, [1.0, None, 2.0], 0), (3, [1.0, 2.0, None], 0), (4, [1.0, 2.0], 0)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 1, False)]


def test_labels_of_other_types(spark):
    for kind, labels in (("string", ["a", "a", "b", None]), ("double", [1.2, 1.2, 1.9, None])):
        frame = spark.createDataFrame([(i, [1.0, 0.5], x) for i, x in enumerate(labels)], f"vec_id long, embedding array<float>, label {kind}")
        assert {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(frame).collect()} == {0: 1, 1: 1, 2: 0, 3: 0}


def test_the_search_computes_few_cosines(monkeypatch):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 64))[np.arange(2000) % 40] + r.normal(size=(2000, 64)) * 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]
    lists = embedding_dedup.both_ways(embedding_dedup.robust_prune(x @ x.T, embedding_dedup.DEGREE, embedding_dedup.CANDIDATES))
    computed, real = [], np.einsum
    monkeypatch.setattr(np, "einsum", lambda how, a, b: computed.append(len(a)) or real(how, a, b))
    found = embedding_dedup.range_search(x[:200], x, lists, 3, np.arange(200), embedding_dedup.THRESHOLD)
    truth = x[:200] @ x.T >= embedding_dedup.THRESHOLD
    assert sum(computed) < 0.5 * truth.size and found.sum() >= 0.98 * truth.sum() and not (found & ~truth).any()


def test_no_step_of_the_search_ranks_all_queries_with_all_stored(monkeypatch):
    r = np.random.default_rng(1)
    x = r.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    lists = embedding_dedup.both_ways(embedding_dedup.robust_prune(x @ x.T, embedding_dedup.DEGREE, embedding_dedup.CANDIDATES))
    ranked, real = [], np.argpartition
    monkeypatch.setattr(np, "argpartition", lambda a, *args, **kw: ranked.append(a.size) or real(a, *args, **kw))
    found = embedding_dedup.range_search(x[:200], x, lists, 3, np.arange(200), embedding_dedup.THRESHOLD)
    assert found.sum() == 200 and 0 < sum(ranked) < 0.5 * found.size


def test_vectors_are_not_shuffled_to_meet_their_lists(spark, monkeypatch):
    """The lists go to the chunks by themselves: a join of both carried every stored vector through one shuffle more."""
    joins, real = [], embedding_dedup.materialize

    def nodes(plan):
        yield plan
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    def noted(df, tag):
        if tag == "found":
            joins.extend(n.output().mkString(" ") for n in nodes(df._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join")
        return real(df, tag)

    monkeypatch.setattr(embedding_dedup, "materialize", noted)
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)
    embedding_dedup.near_duplicates(spark.createDataFrame(vectors(), "vec_id long, embedding array<float>, label int")).collect()
    assert any("near" in x for x in joins) and not any("near" in x and "unit" in x for x in joins)


def test_a_label_of_few_chunks_is_asked_once_and_loses_no_link(spark, monkeypatch):
    """Dealt to shards, every vector was stored about OVERLAP times, asked in two chunks or more, and found fewer links."""
    monkeypatch.setattr(embedding_dedup, "SHARD", 60)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 100)
    rows, real = {}, embedding_dedup.materialize

    def noted(df, tag):
        out = real(df, tag)
        rows[tag] = out.where("other is null").count() if tag == "found" else out.count()
        return out

    monkeypatch.setattr(embedding_dedup, "materialize", noted)
    data = vectors(labels=1)
    m, component = brute_links(data)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()}
    assert rows["vectors"] > 3 * 100 and rows["shards"] == rows["found"] == rows["vectors"]
    assert {i: r.n_links for i, r in got.items()} == dict(enumerate(m.sum(1).tolist())) and m.sum() > 100
    assert {i: r.component_id for i, r in got.items()} == component


@pytest.mark.parametrize(("shard", "chunk"), [(60, 45), (60, 20), (30, 20)])
def test_dealt_labels_against_brute_force(spark, monkeypatch, shard, chunk):
    monkeypatch.setattr(embedding_dedup, "SHARD", shard)
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    dealt, real = [], embedding_dedup._pivots
    monkeypatch.setattr(embedding_dedup, "_pivots", lambda reps: dealt.append(real(reps)) or dealt[-1])
    data = vectors()
    m, component = brute_links(data)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    assert dealt[0] and all(got[i].n_links <= m[i].sum() for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.98 * m.sum() > 100
    assert sum(got[i].component_id != component[i] for i in got) <= 2


def test_lists_built_in_blocks_are_those_built_at_once(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PRUNED", 48 * 64)  # 64 vectors a block, the last one smaller
    x = np.random.default_rng(2).normal(size=(500, 64))
    x[100:140] = x[100] + np.random.default_rng(3).normal(size=(40, 64)) * 0.1
    x /= np.linalg.norm(x, axis=1)[:, None]
    for n in (500, 30, 1, 0):
        at_once, blocks = embedding_dedup.robust_prune(x[:n] @ x[:n].T, 16, 48), embedding_dedup.pruned_lists(x[:n], 16, 48)
        assert [v.tolist() for v in at_once] == [v.tolist() for v in blocks] and len(blocks) == n


def test_robust_prune_keeps_the_nearest():
    x = np.random.default_rng(0).normal(size=(200, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    cos = x @ x.T
    lists = embedding_dedup.robust_prune(cos, 16, 48)
    np.fill_diagonal(cos, -1)
    assert all(len(n) <= 16 and cos[i].argmax() in n for i, n in enumerate(lists))


def dense(n=6000, group=2500, noise=0.1, seed=3):
    """A group of near copies around the threshold in one label of otherwise unlike vectors."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 64))
    x[:group] = x[0] + r.normal(size=(group, 64)) * noise
    return [(i, [float(v) for v in np.float32(x[i])], 0) for i in range(n)]


def test_a_dense_group_over_many_pivots_keeps_its_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 30)  # 83 of 200 sampled pivots lie in the group
    data = dense(noise=0.13)
    m, component = brute_links(data)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    assert all(got[i].n_links <= m[i].sum() for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.98 * m.sum() > 100_000
    assert all(got[i].component_id == component[i] for i in got)


def test_a_dense_group_in_a_dealt_label_keeps_its_links(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "SHARD", 30)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 500)
    dealt, real = [], embedding_dedup._pivots
    monkeypatch.setattr(embedding_dedup, "_pivots", lambda reps: dealt.append(real(reps)) or dealt[-1])
    data = dense(n=3000, group=1200, noise=0.13)
    m, component = brute_links(data)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3)).collect()}
    assert dealt[0] and all(got[i].n_links <= m[i].sum() for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.98 * m.sum() > 10_000
    assert all(got[i].component_id == component[i] for i in got)


def test_every_linked_query_asks_where_the_vector_is_stored():
    r = np.random.default_rng(5)
    x = r.normal(size=(3000, 8)) + 2 * r.normal(size=8)
    x /= np.linalg.norm(x, axis=1)[:, None]
    pivots = embedding_dedup.thinned(x[:400])
    assert 1 < len(pivots) < 400 and (pivots @ pivots.T - np.eye(len(pivots))).max() < embedding_dedup.SAME_PIVOT
    row, pivot, home = embedding_dedup.shards_of(x, pivots, embedding_dedup.REACH)
    stored = np.zeros((len(x), len(pivots)), bool)
    stored[row, pivot] = True
    nearest = np.zeros(len(x), int)
    nearest[row[home]] = pivot[home]
    assert stored[:, nearest].T[x @ x.T >= embedding_dedup.THRESHOLD].all() and home.sum() == len(x)


def test_a_query_with_one_link_is_audited_on_its_own(monkeypatch):
    import pandas as pd

    r = np.random.default_rng(2)
    x = r.normal(size=(200, 64))
    x[1] = x[0] + r.normal(size=64) * 0.05  # one link beside a group with many
    x[100:] = x[100] + r.normal(size=(100, 64)) * 0.05
    x /= np.linalg.norm(x, axis=1)[:, None]
    search = embedding_dedup.range_search

    def misses(*args):
        found = search(*args)
        found[0] = False
        return found

    monkeypatch.setattr(embedding_dedup, "range_search", misses)
    frame = pd.DataFrame({"g": np.arange(200), "mult": 1, "unit": list(x), "home": True, "stored": True, "near": [np.arange(200)] * 200})
    out = embedding_dedup._search(frame)
    links = out[out["other"].isna()].set_index("g")["links"]
    assert links[0] == 1 and links[1] == 1 and (links[100:] == 99).all() and not links[2:99].any()
