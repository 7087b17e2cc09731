"""Vantage-point shards and their cells against all pairs; the near-duplicate filter against all pairs of texts."""

import random

import numpy as np
import pytest

from lacuna.llm import simhash
from lacuna.llm.components import connected_components
from lacuna.llm.vptree import Links, VPTree, distances, link_leaf


def clusters(seed, n, bits, lanes=1):
    """Fingerprints in groups whose members lie up to so many bits from their centres, and lone ones."""
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, (n // 8, lanes), np.uint64)
    points = np.concatenate([centres[rng.integers(0, len(centres), n // 2)], rng.integers(0, 1 << 63, (n // 2, lanes), np.uint64)])
    for p in points[: n // 2]:
        for b in rng.choice(64 * lanes, rng.integers(0, bits + 1), replace=False).tolist():
            p[b // 64] ^= np.uint64(1 << b % 64)
    return np.unique(points, axis=0)


def roots_of(points, near):
    """The component of each point, by all pairs."""
    root = list(range(len(points)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = 0
    for i in range(len(points)):
        for j in np.flatnonzero(near(i)).tolist():
            if j < i:
                pairs += 1
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(points))], pairs


def test_every_near_pair_meets_in_a_home_leaf():
    points = clusters(1, 800, 4)
    for depth in (0, 3, 6):
        tree = VPTree(points[::2], depth)
        rows, leaves, home = tree.route(points, 3)
        assert sorted(rows[home].tolist()) == list(range(len(points)))
        of_home, visited = dict(zip(rows[home].tolist(), leaves[home].tolist())), set(zip(rows.tolist(), leaves.tolist()))
        assert all((j, of_home[i]) in visited for i in range(len(points)) for j in np.flatnonzero(distances(points, points[i]) <= 3).tolist())


def test_leaves_split_in_memory_lose_no_pair(monkeypatch):
    monkeypatch.setattr("lacuna.llm.vptree.BLOCK_PAIRS", 5_000)
    points = clusters(2, 1500, 4)
    links, at = Links(len(points)), np.arange(len(points))
    link_leaf(points, points, (3, 3), links, at, at, np.full(1, 2**64 - 1, np.uint64))
    assert links.roots().tolist() == roots_of(points, lambda i: distances(points, points[i]) <= 3)[0]


def test_cells_bring_each_pair_together_once(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL", 8)
    rows = [(s, i < homes, 1000 * s + i) for s, homes, n in ((1, 5, 8), (2, 30, 50), (3, 0, 20), (4, 3, 100)) for i in range(n)]
    cells = {}
    for r in simhash.in_cells(spark.createDataFrame(rows, "shard long, home boolean, fid long")).collect():
        cells.setdefault((r.shard, r.cell), []).append(r)
    met = [(s, a.fid, b.fid) for (s, _), rs in cells.items() for a in rs if a.member for b in rs if b.visitor]
    assert sorted(met) == sorted((s, f, g) for s, home, f in rows if home for t, _, g in rows if t == s)
    assert max(len(rs) for (s, _), rs in cells.items() if s == 2) < 30


@pytest.mark.parametrize(("leaf", "cell"), [(4000, 4096), (40, 4096), (40, 16), (4000, 50)])
def test_links_equal_all_pairs(spark, monkeypatch, leaf, cell):
    monkeypatch.setattr(simhash, "LEAF_AIM", leaf)
    monkeypatch.setattr(simhash, "CELL", cell)
    points = clusters(3, 1200, 2)
    want, pairs = roots_of(points, lambda i: distances(points, points[i]) <= 3)
    assert pairs > 500
    df = spark.createDataFrame([(i, int(p[0].view(np.int64)), 0) for i, p in enumerate(points)], "fid long, f0 long, shingles long")
    got = {r.node: r.root for r in connected_components(simhash.link_fingerprints(df, len(points), 1, 3)).collect()}
    assert [got.get(i, i) for i in range(len(points))] == want


def test_filter_against_all_pairs_of_texts(spark):
    """Edited copies from 0.6 to 1.0 alike: none is dropped but by a chain of pairs of 0.8, and nine tenths of the others go."""
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        words = [f"w{rng.randrange(99999)}" for _ in range(rng.randint(40, 300))]
        texts.append(words)
        for _ in range(rng.randint(0, 4)):
            texts.append([f"x{rng.randrange(99999)}" if rng.random() < rng.choice((0.004, 0.01, 0.02, 0.04)) else w for w in words])
    sets = [{" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    alike = np.array([[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets])
    root, pairs = roots_of(texts, lambda i: alike[i])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert set(root) <= kept
    assert pairs > 50 and len(kept - set(root)) <= 0.1 * (len(texts) - len(set(root)))


def test_unlike_texts_meet_in_no_shard(spark):
    """The near-duplicate search compares near copies only, however many texts of one size there are."""
    rng = random.Random(3)
    texts = [[f"w{rng.randrange(99999)}" for _ in range(100)] for _ in range(600)]
    texts += [[*t[:50], "other", *t[51:]] for t in texts[:40]]
    docs = spark.createDataFrame([(i, str(i), " ".join(t)) for i, t in enumerate(texts)], "doc_id long, row string, text string")
    prints = simhash.set_fingerprints(docs, 5, 2, ("doc_id", "row"), 0.8)
    of = {r.fid: r.doc_id for r in prints.collect()}
    met = {of[r.fid] for r in simhash.in_cells(simhash.sketched(prints, 2), alone=False).select("fid").distinct().collect()}
    assert met == {*range(40), *range(600, 640)}


@pytest.mark.parametrize("common", [0, 60])
def test_rare_shingles_miss_no_pair_of_the_wanted_similarity(common):
    """Each pair of 0.8 and more meets where the smaller is at home, in any order; the shards of bands missed some in 40000."""
    rng = np.random.default_rng(8)
    pool = np.unique(rng.integers(0, 1 << 64, 400, np.uint64))
    told = np.sort(rng.choice(pool, common, replace=False)), rng.permutation(common) + 1
    for _ in range(3000):
        n = int(rng.integers(1, 60))
        a = rng.choice(pool, n, replace=False)
        both, more = int(rng.integers(-(-4 * n // 5), n + 1)), int(rng.integers(0, n // 4 + 1))
        b = np.concatenate([a[:both], np.setdiff1d(pool, a)[:more]])
        if 5 * both >= 4 * (n + more):
            small, large = sorted((np.sort(a), np.sort(b)), key=len)
            homes, most = simhash.prefix_sizes(len(small), 0.8)[0], simhash.prefix_sizes(len(large), 0.8)[1]
            assert np.intersect1d(simhash.rarest(small, homes, told), simhash.rarest(large, most, told)).size
    assert simhash.prefix_sizes(10, 0.8) == (2, 3) and simhash.prefix_sizes(1, 0.8) == (1, 1) and simhash.prefix_sizes(0, 0.8) == (0, 0)


def test_a_pair_without_a_band_in_common_is_found(spark):
    """Eight of ten shingles in common, found by search: all twenty bands differ, the fingerprints by 26 bits at most."""
    words = [f"w52323x{i}" for i in range(14)]
    docs = spark.createDataFrame([(0, " ".join(words[:13])), (1, " ".join(words[1:]))], "doc_id long, text string")
    assert [r.doc_id for r in simhash.drop_near_duplicates(docs).collect()] == [0]


def test_bands_miss_hardly_a_pair_of_the_wanted_similarity():
    rng = np.random.default_rng(5)
    for similarity, size in ((0.8, 9), (0.8, 900), (0.5, 300)):
        rows, missed, met = simhash.band_rows(similarity), 0, 0
        for _ in range(300):
            x = rng.integers(0, 1 << 64, size + round(size * (1 - similarity) / (1 + similarity)), np.uint64)
            a, b, c = (simhash.band_keys(np.sort(s), rows) for s in (x[:size], x[len(x) - size :], rng.integers(0, 1 << 64, size, np.uint64)))
            missed, met = missed + (not (a == b).any()), met + (a == c).any()
        assert missed <= 1 and met == 0


@pytest.mark.parametrize("little, cell", [(64, 4096), (2, 4096), (2, 8)])
def test_sketched_links_are_those_of_all_pairs(spark, monkeypatch, little, cell):
    """A large group of near copies, small ones and unlike texts, by lots, by trees and by cells."""
    monkeypatch.setattr(simhash, "LITTLE", little)
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(4)
    base = [[f"w{rng.randrange(99999)}" for _ in range(120)] for _ in range(20)]
    texts = [[*b[:at], f"x{i}", *b[at + 1 :]] for i, (b, at) in enumerate((base[min(k // 3, 19)], 7 * k % 120) for k in range(90))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = simhash.set_fingerprints(docs, 5, 2, ("doc_id",), 0.8)
    of = {r.fid: r.doc_id for r in prints.collect()}
    roots = {}
    for r in connected_components(simhash.link_sketched(prints, 90, 2, 26, 0.8)).collect():
        roots.setdefault(r.root, set()).add(of[r.node])
    assert sorted(map(min, roots.values())) == [3 * k for k in range(20)] and max(map(len, roots.values())) == 33
