"""Packing, centroids and ranked search, against brute force and invariants."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest_llm import prose
from tokenizers import Tokenizer

from phonoweave.llm import centroids, packing, ranked_search

WORD = public_tokenizers.path("word_bpe_49k.json")


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed,n,capacity", [(1, 400, 64), (2, 3000, 64), (3, 1500, 256), (4, 5, 64), (5, 1, 64)])
def test_plan_is_whole_and_close(seed, n, capacity):
    lengths = np.clip(np.random.default_rng(seed).lognormal(math.log(capacity / 6), 1, n).astype(int), 1, capacity).tolist()
    patterns = packing.plan(Counter(lengths), capacity)
    got = Counter()
    for pattern, times in patterns:
        assert sum(pattern) <= capacity and times > 0
        for k in pattern:
            got[k] += times
    assert got == Counter(lengths)
    bound = max(-(-sum(lengths) // capacity), sum(2 * k > capacity for k in lengths))
    n_sequences = sum(t for _, t in patterns)
    assert n_sequences <= max(bound + 1, int(1.002 * bound) + 1) and n_sequences <= best_fit(lengths, capacity) + 1


def test_plan_is_optimal_where_longest_first_is_not():
    # Pairs of 6 + 4 and triples 3 + 3 + 4 fill sequences of 10; the program has to find both.
    assert sum(t for _, t in packing.plan({6: 10, 4: 30, 3: 40}, 10)) == 30
    assert packing.plan({}, 10) == [] and packing.plan({10: 7}, 10) == [((10,), 7)]


def test_knapsack_table():
    prices = np.array([-np.inf, 1.0, 2.5, -np.inf, 5.2, -np.inf])
    assert packing.knapsack(prices).tolist() == [0, 1, 2.5, 3.5, 5.2, 6.2]


def test_pack(spark, make, awkward):
    rows = packing.pack(make(awkward), WORD, keep_ids=True).collect()
    library, want = Tokenizer.from_file(WORD), []
    for doc_id, text in awkward:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want.append((doc_id is not None, doc_id or 0, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    by: dict = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) == -(-sum(w[4] for w in want) // 2048)
    packed = packing.pack(make(awkward), WORD, keep_ids=True)
    whole = packing.sequences(packed).collect()
    assert sorted(len(r.ids) // 4 for r in whole) == sorted(sum(n for _, n in p) for p in by.values()) and all(sum(r.lengths) * 4 == len(r.ids) for r in whole)
    assert packing.pack(make([]), WORD).count() == 0


def brute_clusters(vectors, k, rounds):
    """vectors: (id, integers) in any order."""
    known = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in vectors if i is not None)
    at = [q for _, q in known[:k]]
    away = lambda q, c: sum((a - b) ** 2 for a, b in zip(q, c))
    nearest = lambda q: min(range(len(at)), key=lambda j: (away(q, at[j]), j))
    for _ in range(rounds):
        of = [nearest(q) for _, q in vectors]
        for j in range(len(at)):
            mine = [q for (_, q), c in zip(vectors, of) if c == j]
            if mine:
                at[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return [(i, nearest(q), away(q, at[nearest(q)])) for i, q in vectors], at


@pytest.mark.parametrize("spread_of", [0.02, 0.3, 3.0])
def test_centroids(spark, spread_of):
    r = np.random.default_rng(7)
    rows = [(i, (r.normal(0, spread_of, 8)).tolist(), "x", 5) for i in range(700)]
    rows += [(i, rows[3][1], "x", 5) for i in range(700, 900)] + [(3, rows[4][1], "y", 5), (None, rows[5][1], None, 5)]
    rows += [(2000, None, "x", 5), (2001, [], "x", 5), (2002, [1.0] * 7, "x", 5), (2003, [float("nan")] * 8, "x", 5), (2004, [None] * 8, "x", 5), (2005, [float("inf")] + [0.0] * 7, "x", 5)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster string, distance int")
    got = centroids.clusters(frame, k=12, width=8, rounds=3).collect()
    kept = [(i, [math.floor(64 * x) for x in e]) for i, e, *_ in rows[:902]]
    want, at = brute_clusters(kept, 12, 3)
    key = lambda t: (t[0] is not None, t[0] or 0, *t[1:])
    assert sorted((tuple(g[:3]) for g in got), key=key) == sorted(want, key=key)
    sums = Counter()
    for _, j, d in want:
        sums[j] += d
    for g in got:
        assert g.cluster_inertia == sums[g.cluster] and g.inertia == sum(sums.values())
        assert g.centroid_sha256 == hashlib.sha256(",".join(map(str, at[g.cluster])).encode()).hexdigest()


def test_centroids_at_the_edges(spark):
    schema = "vec_id long, embedding array<double>"
    assert centroids.clusters(spark.createDataFrame([], schema), width=2).count() == 0
    few = centroids.clusters(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, -1.0])], schema), width=2).collect()
    assert sorted((r.vec_id, r.distance) for r in few) == [(1, 0), (2, 0)] and len({r.cluster for r in few}) == 2
    lost = centroids.clusters(spark.createDataFrame([(None, [0.0, 0.0])], schema), width=2).collect()
    assert [tuple(r) for r in lost] == [(None, None, None, None, None, None)]
    big = [(1, [1e30, 0.0]), (2, [-1e30, 5.0]), (3, [0.0, 1.7e308]), (4, [3e7, 1.0]), (5, [3e7, 1.5])]
    got = {r.vec_id: r for r in centroids.clusters(spark.createDataFrame(big, schema), k=2, width=2).collect()}
    want, _ = brute_clusters([(i, [int(x) * 64 if abs(x) > 1e300 else math.floor(64 * x) for x in e]) for i, e in big], 2, 3)
    assert {i: (r.cluster, r.distance) for i, r in got.items()} == {i: (j, d if d < 1 << 63 else None) for i, j, d in want}


def test_bounds_never_change_a_result():
    r = np.random.default_rng(11)
    q = r.integers(-40, 40, (3000, 6))
    at = [x.tolist() for x in q[:9]]
    now = centroids.Centroids(at)
    cluster, upper, lower = now.assign(q, None, None, None)
    for _ in range(6):
        before, at = at, [(q[cluster == j].sum(axis=0) // max(1, (cluster == j).sum())).tolist() if (cluster == j).any() else at[j] for j in range(9)]
        now = centroids.Centroids(at, before)
        cluster, upper, lower = now.assign(q, cluster, upper, lower)
        nearest, found = now.nearest_of_all(q)
        assert (cluster == nearest).all() and (upper >= np.sqrt(found.min(axis=1))).all() and (lower <= np.sqrt(found)).all()


@pytest.mark.parametrize("tops,most,want", [([10, 20, 30], 0, 0), ([10, 20, 30], 29, 9), ([10, 20, 30], 31, 10), ([10, 20, 30], 45, 17), ([10, 20, 30], 60, 30), ([5], 3, 3)])
def test_level(tops, most, want):
    assert ranked_search.level(tops, most) == want and sum(min(want, t) for t in tops) <= most


def brute_search(docs, items, most):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counts = [Counter(words(t)) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in counts), sum(sum(c.values()) for c in counts)
    df = Counter(t for c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc_id, _), c in zip(docs, counts):
            m = 75 + (25 * sum(c.values()) * n_docs) // max(1, n_terms)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in words(text) if t in c)
            if score > 0:
                scored.append((-score, doc_id is not None, doc_id or 0))
        out += [(item, k + 1, d if known else None, -s) for k, (s, known, d) in enumerate(sorted(scored)[:most])]
    return out


def test_ranked_search(spark, make, awkward, monkeypatch):
    docs = [*awkward, *((100 + k, prose(k % 40, 30 + k % 7)) for k in range(160)), (None, prose(3, 12)), (500, "ÀÉ Bc12_x bc12 'IT' x"), (501, " stone ")]
    items = [(1, prose(5, 12)), (2, "stone3 STONE3 river1 lantern2, the the unknownword"), (3, None), (4, "..."), (5, "nowhere"), (6, "àÉ bc12"), (6, "x"), (None, prose(8, 6)), (7, "日本語 'll")]
    items_frame = spark.createDataFrame([(i, t, "e", 2) for i, t in items], "item_id long, text string, term string, rank int")
    order = lambda rows: sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or 0, r[3]))
    want = order(brute_search(docs, items, 20))
    assert order(map(tuple, ranked_search.search(make(docs), items_frame).collect())) == want
    monkeypatch.setattr(ranked_search, "MOST_TERMS", 3)  # the join in place of the set, and nothing broadcast
    monkeypatch.setattr(ranked_search, "MOST_BROADCAST", 0)
    monkeypatch.setattr(ranked_search, "SLICE", 20)  # several slices, and blocks of few entries and items
    monkeypatch.setattr(ranked_search, "BLOCK", 500)
    monkeypatch.setattr(ranked_search, "ITEMS", 2)
    monkeypatch.setattr(ranked_search, "LOOSE", 1.0)
    assert order(map(tuple, ranked_search.search(make(docs).repartition(3), items_frame).collect())) == want
    assert ranked_search.search(make([]), items_frame).count() == 0 and ranked_search.search(make(docs), items_frame.limit(0)).count() == 0
