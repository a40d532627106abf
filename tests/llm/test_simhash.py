import random

import numpy as np
import xxhash

from rosterforge.llm import simhash

SCHEMA = "doc_id long, text string, component_id string"


def brute_fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=4):
    label = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= radius and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_fingerprints_and_components_match_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(rng.randint(1, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    texts += [None, "", " \n ", "One two", "one TWO", "x " * 5000]
    rows = [(i * 3, t, "clash") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    fps = {i: brute_fingerprint(t) for i, t, _ in rows}
    want = brute_components(fps)
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {i: r.component_id for i, r in got.items()} == want
    assert len(set(want.values())) < len(want)


def test_shard_search_finds_every_link():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 2**63, size=30, dtype=np.uint64)
    fps = []
    for c in centres:
        for _ in range(20):
            flips = rng.choice(64, size=rng.integers(0, 6), replace=False)
            fps.append(int(c) ^ sum(1 << int(b) for b in flips))
    fps = np.unique(np.array(fps, dtype=np.uint64))
    ids = rng.permutation(len(fps)).astype(np.int64)
    a, b = simhash.shard_forest(fps, ids)
    want = brute_components({int(i): int(f) for f, i in zip(fps, ids, strict=True)})
    label = {int(i): int(i) for i in ids}
    label.update({int(m): int(c) for c, m in zip(a, b, strict=True)})
    assert label == want
    assert len(a) == len(fps) - len(set(want.values()))


def test_large_shards_cross_batches(spark):
    centre = 0x0123456789ABCDEF
    rows = [(k + 1, simhash._signed(centre ^ (1 << a) ^ (1 << b))) for k, (a, b) in enumerate((a, b) for a in range(40) for b in range(a))]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        nodes = spark.createDataFrame(rows, "node long, fp long")
        found = simhash.connected_components(simhash.links(nodes)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r.component for r in found} == {1} and len(found) == len(rows)


def test_similar_documents_find_near_copies_and_leave_others(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(2000)]
    rows, pairs = [], []
    for i in range(120):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(150, 400))]
        copy = list(base)
        for at in rng.sample(range(0, len(copy), 10), len(copy) // 100):  # about one word in a hundred: similarity 0.9
            copy[at] = rng.choice(vocabulary)
        other = base[: len(base) // 2] + [rng.choice(vocabulary) for _ in range(len(base) // 2)]  # half shared: 0.33
        rows += [(3 * i, " ".join(base), "x"), (3 * i + 1, " ".join(copy), "x"), (3 * i + 2, " ".join(other), "x")]
        pairs.append((3 * i, 3 * i + 1))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert sum(got[b] == a for a, b in pairs) >= 0.97 * len(pairs)
    assert all(got[3 * i + 2] == 3 * i + 2 for i in range(120))
    kept = simhash.keep_representatives(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "component_id"] and kept.count() == len(set(got.values()))


def similarity(a, b, shingle=5):
    sets = [{tuple(t[i : i + shingle]) for i in range(max(1, len(t) - shingle + 1))} for t in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_similar_documents_link_by_the_exact_similarity(spark):
    """Pairs just over and just under 0.8, short and long, are told apart as by brute force."""
    rng = random.Random(31)
    vocabulary = [f"v{i}" for i in range(3000)]
    rows, want = [], {}
    for i in range(400):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((14, 30, 80, 300)))]
        k = len(base) - 4  # shingles; a changed tail of n words leaves k - n of k in common
        n = next(n for n in range(k) if (k - n) / (k + n) < 0.8) - (i % 2)
        copy = base[: len(base) - n] + [rng.choice(vocabulary) + "z" for _ in range(n)]
        rows += [(2 * i, " ".join(base), "x"), (2 * i + 1, " ".join(copy), "x")]
        want |= {2 * i: 2 * i, 2 * i + 1: 2 * i + 1 - i % 2}
    assert all((similarity(rows[d][1], rows[d - 1][1]) >= 0.8) == (want[d] == d - 1) for d in range(1, len(rows), 2))
    rows += [(5000, None, "x"), (5001, " \n", "x")]
    want |= {5000: 5000, 5001: 5000}
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == want


def test_near_copies_are_found_by_fingerprints_in_trees(spark):
    """Pairs of shingle sets at 0.8, from 4 shingles to 400, meet over their fingerprints; sets that share a third don't."""
    rng = np.random.default_rng(9)
    sets = []
    for u, a, b in ((5, 4, 5), (10, 9, 9), (20, 16, 20), (40, 36, 36), (100, 90, 90), (400, 360, 360), (300, 200, 200)) * 12:
        values = np.unique(rng.integers(0, 1 << 63, size=u, dtype=np.uint64))[rng.permutation(u)]
        sets += [np.sort(values[:a]), np.sort(values[u - b :])]
    nodes = spark.createDataFrame([(i, len(x), bytearray(simhash.wide_fingerprint(x).tobytes())) for i, x in enumerate(sets)], "node long, size long, bits binary")
    got = {r.node: r.component for r in simhash.connected_components(simhash.candidate_links(nodes, 0.8)).collect()}
    assert [k for k in range(0, len(sets), 2) if (k // 2 % 7 < 6) != (got.get(k) == k == got.get(k + 1))] == []


def test_small_leaves_and_trees_give_the_same_components(spark, monkeypatch):
    rng = np.random.default_rng(10)
    base = rng.integers(0, 1 << 63, size=300, dtype=np.uint64)
    sets = [np.unique(base[rng.random(300) < share]) for share in (0.95,) * 60 + (0.5,) * 20]
    nodes = spark.createDataFrame([(i, len(x), bytearray(simhash.wide_fingerprint(x).tobytes())) for i, x in enumerate(sets)], "node long, size long, bits binary")
    one = sorted(simhash.connected_components(simhash.candidate_links(nodes, 0.8)).collect())
    monkeypatch.setattr(simhash, "LEAF_ROWS", 3)
    assert {r.component for r in one if r.node < 60} == {0} and sorted(r.node for r in one)[:60] == list(range(60))
    assert {tuple(r) for r in one if r.node < 60} <= {tuple(r) for r in simhash.connected_components(simhash.candidate_links(nodes, 0.8)).collect()}


def test_links_of_a_leaf_are_stars_and_not_all_pairs(spark):
    """A group of near copies gives at most one link for each of its rows and trees, whose ends still form one component."""
    rng = np.random.default_rng(11)
    base = rng.integers(0, 1 << 63, size=300, dtype=np.uint64)
    sets = [np.unique(base[rng.random(300) < 0.97]) for _ in range(300)]
    nodes = spark.createDataFrame([(i, len(x), bytearray(simhash.wide_fingerprint(x).tobytes())) for i, x in enumerate(sets)], "node long, size long, bits binary")
    links = simhash.candidate_links(nodes, 0.8)
    assert links.count() <= 40 * len(sets)  # all pairs of all leaves: 940,329
    assert {r.component for r in simhash.connected_components(links).collect()} == {0}


def test_stars_have_the_components_of_the_links():
    rng = np.random.default_rng(12)
    ids, a = rng.permutation(400), rng.integers(0, 399, size=300)
    b = np.where(rng.random(300) < 0.7, a + 1, rng.integers(0, 400, size=300))
    label = {int(i): int(i) for i in ids}
    for _ in ids:
        for x, y in zip(ids[a].tolist(), ids[b].tolist(), strict=True):
            label[x] = label[y] = min(label[x], label[y])
    centres, members = simhash.stars(a, b, ids)
    assert dict(zip(members.tolist(), centres.tolist(), strict=True)) == {i: k for i, k in label.items() if i != k}


def test_trees_of_two_levels_send_few_rows_and_lose_no_pair():
    """13 million sets (30 GB) ask for two levels; the rows sent to leaves stay under 80 a set."""
    trees, rng = simhash.Trees(13_000_000, 0.8), np.random.default_rng(13)
    assert trees.axes and trees.count <= 80 and simhash.Trees(200_000, 0.8).count <= 40
    for u, a, b in ((5, 4, 5), (9, 8, 9), (60, 54, 54), (500, 400, 500)):
        sets = [rng.integers(0, 1 << 63, size=u, dtype=np.uint64) for _ in range(200)]
        one, two = (trees.leaves(np.stack([simhash.votes(x)[0] for x in part])) for part in ([x[:a] for x in sets], [x[u - b :] for x in sets]))
        assert (one == two).any(axis=1).all()
        assert len(np.unique(one)) > 200


def test_similarity_forest_matches_brute_force():
    """A graded group: some members are linked only over others, some not at all."""
    rng = np.random.default_rng(4)
    base = rng.choice(10**6, size=100, replace=False).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(100) < rng.uniform(0.7, 1)], rng.integers(10**6, 10**9, size=rng.integers(0, 12)).astype(np.uint64)])) for _ in range(150)]
    label = list(range(len(sets)))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if len(set(sets[i]) & set(sets[j])) / len(set(sets[i]) | set(sets[j])) >= 0.8]
    for _ in sets:
        for i, j in pairs:
            label[i] = label[j] = min(label[i], label[j])
    a, b = simhash.similarity_forest(sets, 0.8)
    assert set(zip(a, b, strict=True)) <= {p for i, j in pairs for p in ((i, j), (j, i))}
    assert len(a) == len(sets) - len(set(label)) and 1 < len(set(label)) < len(sets)


def test_heavy_bands_in_blocks_give_the_same_components(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"v{i}" for i in range(200)]
    rows = [(i, " ".join(base[: 140 + rng.randint(0, 60)] + [f"t{i % 7}"] * rng.randint(0, 3)), "x") for i in range(150)]
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(simhash.similar_documents(docs).collect())
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 1500)
    assert sorted(simhash.similar_documents(docs).collect()) == whole and len({r.component_id for r in whole}) < 150


def test_null_repeated_and_text_ids(spark):
    base = " ".join(f"w{k}" for k in range(60))
    rows = [("b", base), ("a", base), (None, base), ("c", "other words here and there"), ("c", base), (None, "alone one two three"), (None, "alone one two three")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted((r.doc_id or "-", r.component_id or "-") for r in simhash.near_duplicates(docs).collect())
    assert got == [("-", "-"), ("-", "-"), ("-", "a"), ("a", "a"), ("b", "a"), ("c", "a"), ("c", "c")]
    kept = sorted((r.doc_id or "-", r.text) for r in simhash.keep_representatives(docs).collect())
    assert kept == [("-", rows[5][1]), ("a", base), ("c", rows[3][1])]


def test_equal_rows_leave_one(spark):
    docs = spark.createDataFrame([(4, "same text of some words here"), (4, "same text of some words here"), (4, "quite another text of words there")], "doc_id long, text string")
    assert sorted(r.text[:4] for r in simhash.keep_representatives(docs).collect()) == ["quit", "same"]


def test_children_of_the_tree_use_other_vantage_points():
    fps = np.random.default_rng(1).integers(0, 2**63, size=5000, dtype=np.uint64).reshape(-1, 1)
    tree, inner, shared, leaves = simhash.VantageTree(fps, np.arange(len(fps))), 0, 0, []
    todo = [tree]
    while todo:
        node = todo.pop()
        if node.left is None:
            leaves.append(node.size)
            continue
        for child in (node.left, node.right):
            todo.append(child)
            if child.left is not None:
                inner, shared = inner + 1, shared + bool((child.vantage == node.vantage).all())
    assert inner > 20 and shared == 0 and max(leaves) <= simhash.LEAF


def test_empty_table(spark):
    got = simhash.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "fingerprint", "component_id"] and got.isEmpty()
    assert simhash.similar_documents(spark.createDataFrame([], SCHEMA)).isEmpty()
