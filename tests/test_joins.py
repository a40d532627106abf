"""The set-similarity join, the vector similarity join and the greedy choice against plain loops."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from rosterforge.operators import consolidate as C
from rosterforge.operators import set_join as S
from rosterforge.operators import vector_join as V


def lineups(n=220, players=40, hot=True):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        own = set(rng.choices(range(2, players), k=rng.randint(0, 5)))
        if hot and i % 2:  # a player of half of all teams
            own.add(1)
        rows.append((i, sorted(own), "x"))
    return [*rows, (n, [1, 2, 3, 4], "x"), (n + 1, [4, 3, 2, 1], "x"), (n + 2, [], "x"), (n + 3, None, "x")]


@pytest.mark.parametrize("shared,block,depth", [(1, 7, 2), (2, 4096, 2), (3, 5, 2), (3, 6, 1)])
def test_sharing_pairs_equal_all_pairs(spark, shared, block, depth):
    rows = lineups()
    df = spark.createDataFrame(rows, "team_id long, lineup array<long>, p string")
    want = {(a[0], b[0]): n for a, b in combinations(rows, 2) if (n := len(set(a[1] or ()) & set(b[1] or ()))) >= shared}
    got = S.sharing_pairs(df, shared, block_sets=block, depth=depth).collect()
    assert len(got) == len(want) and {(r.a, r.b): r.shared for r in got} == want


def test_prefixes_make_few_candidates(spark):
    """A player of half of all teams pairs none of those that have rarer players in common places."""
    rng = random.Random(1)
    rows = [(i, [0, *rng.sample(range(1, 300), 3)]) for i in range(600)]
    df = spark.createDataFrame(rows, "team_id long, lineup array<long>")
    sharing_any = 600 * 599 // 2
    assert S.candidate_sets(df, 3).count() * 5 < sharing_any


def clustered(n=260, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, dim))
    v = centres[rng.integers(0, 30, n)] + 0.25 * rng.normal(size=(n, dim))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[5] = v[9]
    v[n - 1] = 0.0
    return v


@pytest.mark.parametrize("threshold,pivots,block", [(0.88, None, 2048), (0.94, 5, 16), (0.6, 40, 9), (0.9, 1, 50)])
def test_similarity_join_equals_all_pairs(spark, threshold, pivots, block):
    v = clustered()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "team_id long, final_vector array<double>")
    report = {}
    got = V.similarity_join(df, threshold, pivots=pivots, block_rows=block, report=report).collect()
    dots = v @ v.T
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if dots[i, j] >= threshold}
    assert len(got) == len(want) and {(r.a, r.b) for r in got} == want
    assert all(abs(r.similarity - dots[r.a, r.b]) < 1e-9 for r in got)
    assert report["sent"] >= report["rows"] == len(v)


def test_similarity_join_skips_far_cells(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(20, 32))
    v = centres[np.arange(600) % 20] + 0.1 * rng.normal(size=(600, 32))
    v /= np.linalg.norm(v, axis=1)[:, None]
    report = {}
    pairs = V.similarity_join(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "team_id long, final_vector array<double>"), 0.94, pivots=24, report=report).count()
    assert pairs == (np.triu(v @ v.T, 1) >= 0.94).sum()
    assert report["compared"] < 600 * 599 / 2 / 4 and report["sent"] < 3 * 600


def test_similarity_join_of_vectors_without_near_pivots(spark):
    """Distances in many dimensions crowd together: no vector goes to more tasks than there are blocks, and no batch of pairs is larger than a step."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(600, 64))
    v[300:360] = v[300] + 0.01 * rng.normal(size=(60, 64))
    v /= np.linalg.norm(v, axis=1)[:, None]
    report = {}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "team_id long, final_vector array<double>")
    got = V.similarity_join(df, 0.88, block_rows=200, report=report).collect()
    assert {(r.a, r.b) for r in got} == set(zip(*(k.tolist() for k in np.nonzero(np.triu(v @ v.T, 1) >= 0.88)))) and len(got) >= 60 * 59 // 2
    assert report["sent"] <= 600 * 3


def test_pairs_of_a_dense_block_come_in_bounded_batches():
    n = 1024
    columns = [[0] * n, [0] * n, [0] * n, [0] * n, [True] * n, list(range(n)), [[1.0, 0.0]] * n, [0.0] * n]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["cell", "lo", "hi", "side", "home", "team_id", "v", "d"])
    sizes = [b.num_rows for b in V._compare(0.9, 1.0)([batch])]
    assert sum(sizes) == n * (n - 1) // 2 and max(sizes) <= V.STEP_PAIRS


def test_similarity_join_of_no_rows(spark):
    assert V.similarity_join(spark.createDataFrame([], "team_id long, final_vector array<double>"), 0.9).isEmpty()


def sequential(order, near, min_size):
    taken, out = set(), []
    for seed in order:
        if seed not in taken:
            members = near[seed] - taken
            taken.add(seed)
            if len(members) >= min_size:
                taken |= members
                out.append(sorted(members))
    return out


@pytest.mark.parametrize("seed,edges,min_size", [(1, 60, 3), (2, 200, 2), (3, 25, 1), (4, 400, 3), (5, 0, 2)])
def test_greedy_choice_equals_the_loop(spark, seed, edges, min_size):
    rng = random.Random(seed)
    teams = [(i, rng.randint(1, 6)) for i in range(80)]
    pairs = [tuple(sorted(rng.sample(range(80), 2))) for _ in range(edges)] + [(i, i + 1) for i in range(20)] * bool(edges)
    near = {i: {i} for i, _ in teams}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    want = sequential([i for i, _ in sorted(teams, key=lambda t: (-t[1], t[0]))], near, min_size)
    df = spark.createDataFrame(teams, "team_id long, lineup_count long")
    got = C.greedy_choice(df, spark.createDataFrame(pairs, "a long, b long"), min_size).collect()
    found = {}
    for r in got:
        found.setdefault(r.cluster_id, []).append(r.team_id)
    assert [sorted(found[k]) for k in sorted(found)] == want and sorted(found) == list(range(len(want)))
    assert all(r.cluster_size == len(found[r.cluster_id]) for r in got)


def test_seeds_in_a_chain_are_chosen_in_one_round(spark, monkeypatch):
    """Ten seeds, each of which reaches two teams of its own and one that the next seed reaches, too, need no round each."""
    made, plain = [], C.new_folder
    monkeypatch.setattr(C, "new_folder", lambda session: made.append(1) or plain(session))
    pairs = [p for i in range(10) for p in ((i, 10 + i), (i, 30 + i), (i, 50 + i), (i + 1, 50 + i)) if p[0] < 10]
    teams = sorted({x for p in pairs for x in p})
    df = spark.createDataFrame([(i, 1) for i in teams], "team_id long, lineup_count long")
    got = C.greedy_choice(df, spark.createDataFrame(pairs, "a long, b long"), 3).collect()
    assert {(r.team_id, r.cluster_id) for r in got} == {(x, i) for i in range(10) for x in (i, 10 + i, 30 + i, 50 + i)}
    assert len(made) <= 5


@pytest.mark.parametrize("n,block", [(1, 2048), (2, 1), (90, 16), (90, 2048)])
def test_nearest_others_equal_all_pairs(spark, n, block):
    v = clustered()[:n]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    dots = v @ v.T
    np.fill_diagonal(dots, -np.inf)
    got = {r.id: r.similarity for r in V.nearest_others(df, block).collect()}
    assert set(got) == (set(range(n)) if n > 1 else set())
    assert all(abs(got[i] - dots[i].max()) < 1e-9 for i in got)


def parts(n, pairs):
    """The components with more than one of n rows."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    out = {}
    for x in range(n):
        out.setdefault(find(x), set()).add(x)
    return sorted(sorted(m) for m in out.values() if len(m) > 1)


def with_sets(n=240, dim=8):
    """Vectors with many pairs, sets with many common members, some empty; one large group of copies."""
    rng = random.Random(5)
    v = clustered(n, dim)
    v[100:180] = v[100]
    players = [[] if i % 17 == 0 else rng.sample(range(3000) if i % 3 == 0 else range(40), rng.randint(1, 12)) for i in range(n)]
    return v, players


@pytest.mark.parametrize("block", [8192, 37])
def test_stars_link_what_all_pairs_link(spark, block):
    v, _ = with_sets()
    want = [(i, j) for i, j in combinations(range(len(v)), 2) if v[i] @ v[j] >= 0.9]
    got = [tuple(r) for r in V.similarity_stars(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "team_id long, final_vector array<double>"), 0.9, block_rows=block).collect()]
    assert parts(len(v), got) == parts(len(v), want)
    blocks = -(-len(v) // block)
    assert len(got) < len(want) and (blocks > 1 or len(got) < len(v))


@pytest.mark.parametrize("block", [8192, 50])
def test_sharing_stars_link_what_sharing_pairs_link(spark, block):
    v, players = with_sets()
    small = lambda i, j: min(len(players[i]), len(players[j]))
    want = [(i, j) for i, j in combinations(range(len(v)), 2) if v[i] @ v[j] >= 0.3 and small(i, j) and len({*players[i]} & {*players[j]}) / small(i, j) >= 0.5]
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "team_id long, final_vector array<double>")
    sets = spark.createDataFrame(list(enumerate(players)), "team_id long, members array<long>")
    got = [tuple(r) for r in V.sharing_stars(rows, sets, 0.3, 0.5, block_rows=block).collect()]
    assert parts(len(v), got) == parts(len(v), want) and want


@pytest.mark.parametrize("block", [8192, 20])
def test_pairs_of_a_group_and_their_sums_equal_all_pairs(spark, block):
    v, players = with_sets()
    both = lambda i, j: len({*players[i]} & {*players[j]})
    union = lambda i, j: len({*players[i]} | {*players[j]})
    share = lambda i, j: both(i, j) / union(i, j) if union(i, j) else 0.0
    want = {(i % 3, i, j): (v[i] @ v[j], share(i, j), union(i, j), both(i, j)) for i, j in combinations(range(len(v)), 2) if i % 3 == j % 3 and v[i] @ v[j] >= 0.25 and share(i, j) <= 0.2}
    rows = spark.createDataFrame([(i, i % 3, x.tolist(), players[i]) for i, x in enumerate(v)], "team_id long, g long, final_vector array<double>, members array<long>")
    found = V.similar_within(rows, 0.25, "g", max_overlap=0.2, block_rows=block).collect()
    assert len(found) == len(want) and {(r.g, r.a, r.b): (r.pool, r.shared) for r in found} == {k: x[2:] for k, x in want.items()}
    assert all(abs(r.similarity - want[r.g, r.a, r.b][0]) < 1e-9 and abs(r.overlap - want[r.g, r.a, r.b][1]) < 1e-12 for r in found)
    sums = V.similar_within(rows, 0.25, "g", max_overlap=0.2, sums=True, block_rows=block).collect()
    assert parts(len(v), [(r.a, r.b) for r in sums]) == parts(len(v), [k[1:] for k in want])
    assert sum(r.pair_count for r in sums) == len(want) and len(sums) < len(want)
    held = [r for r in sums if r.pair_count]
    assert abs(sum(r.similarity_sum for r in held) - sum(x[0] for x in want.values())) < 1e-6
    for k, name in ((0, "similarity"), (1, "overlap")):
        assert abs(min(r[f"{name}_min"] for r in held) - min(x[k] for x in want.values())) < 1e-9
        assert abs(max(r[f"{name}_max"] for r in held) - max(x[k] for x in want.values())) < 1e-9
