import random

from rosterforge.llm import mixing
from rosterforge.llm.common import table_rows

SCHEMA = "doc_id long, text string, source string, size string"


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        target = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target | {s: cap * sizes[s] for s in capped}
        capped |= over


def corpus():
    rng = random.Random(4)
    rows = []
    for i in range(900):
        source = rng.choice(["a", "a", "a", "a", "b", "c", "C", "é", None])
        rows.append((i, " ".join("w" for _ in range(rng.choice([1, 5, 20, 200]))), source, "clash"))
    return rows + [(5000, None, "a", ""), (5001, "", "b", ""), (5002, "x " * 3000, "c", ""), (5003, "tiny", "zz", ""), (5004, None, "void", "")]


def test_targets_and_words_taken(spark):
    rows = corpus()
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    size = {i: len((t or "").split()) for i, t, _, _ in rows}
    source = {i: s for i, _, s, _ in rows}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    want = brute_targets(sizes)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1.0, r.target)
        assert r.taken in (0, r.size, 2 * r.size)
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s, n in taken.items():
        largest = max(size[i] for i in size if source[i] == s)
        assert abs(n - want[s]) <= largest / 2 + 1e-6
    again = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert {r.doc_id: r.taken for r in got} == {r.doc_id: r.taken for r in again}


def test_order_is_the_pareto_rank(spark):
    rows = [(i, "one two", "s" if i % 2 else "t", "") for i in range(400)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights=(1, 3)).collect()
    import hashlib

    u = lambda i: (int(hashlib.md5(f"{i}:42".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
    for s in "st":
        mine = [r for r in got if (r.doc_id % 2 == 1) == (s == "s")]
        chosen = sorted(r.taken for r in mine)
        cut = max((u(r.doc_id) for r in mine if r.taken == chosen[-1]), default=0)
        assert all(r.taken == chosen[-1] for r in mine if u(r.doc_id) <= cut)


def brute_mix(rows, cap=2):
    """taken of every distinct id, by sorting whole sources."""
    import hashlib

    size = {i: len((t or "").split()) for i, t, *_ in rows}
    source = {i: s for i, _, s, *_ in rows}
    sizes = {}
    for i, s in source.items():
        sizes[s] = sizes.get(s, 0) + size[i]
    targets, out = brute_targets(sizes), {}
    for s, target in targets.items():
        mine = [i for i in size if source[i] == s]
        weight = {i: len(bin(size[i])) - 2 for i in mine}
        rate = dict.fromkeys(mine, float(cap))
        if target < cap * sizes[s]:
            for heaviest in sorted(set(weight.values()), reverse=True):
                full = sum(cap * size[i] for i in mine if weight[i] > heaviest)
                level = (target - full) / sum(weight[i] * size[i] for i in mine if weight[i] <= heaviest)
                if level * heaviest < cap:
                    rate = {i: min(float(cap), level * weight[i]) for i in mine}
                    break
        rest = target - sum(int(rate[i]) * size[i] for i in mine)

        def rank(i, rate=rate):
            part, u = rate[i] % 1, (int(hashlib.md5(f"{i}:42".encode()).hexdigest()[:12], 16) + 0.5) / 2**48
            odds = u / (1 - u) / (part / (1 - part))
            return odds / (1 + odds)

        run = 0
        for i in sorted((i for i in mine if rate[i] % 1 > 0), key=lambda i: (rank(i), i)):
            out[i] = (int(rate[i]) + (run + size[i] / 2 <= rest)) * size[i]
            run += size[i]
        out |= {i: int(rate[i]) * size[i] for i in mine if rate[i] % 1 == 0}
    return out


def test_equals_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_mix(rows)


def test_longer_documents_are_likelier_and_certain_copies_come_first(spark):
    rows = [(i, "w " * (2 if i % 2 else 200), "big" if i < 2000 else "cap", "") for i in range(2200)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA), weights=(1, 1)).collect()
    share = lambda rs: sum(r.copies for r in rs) / len(rs)
    short, long = ([r for r in got if r.doc_id < 2000 and r.size == n] for n in (2, 200))
    assert share(short) < 0.9 * share(long)
    assert all(r.copies == 2 for r in got if r.doc_id >= 2000)  # a source at its cap


def test_capped_sources_have_no_cut(spark):
    """All rows of a source at its cap are settled by the rate: none is ranked."""
    docs = spark.createDataFrame([(i, "one two three", "a" if i % 40 else "b", "") for i in range(400)], SCHEMA)
    plan = mixing.Mix(docs, (1, 3), 1.5, 2, 42, "doc_id", "text", "source")
    assert {r.cut_source for r in plan.cuts.collect()} == {"a"}


def test_repeated_rows_and_null_ids(spark):
    """Rows without an id, or with one they share, are decided one by one, so a source of them meets its target, too."""
    rows = [(None, f"w{i} " * 100, "n", "") for i in range(300)] + [(7, f"w{i} " * 100, "r", "") for i in range(300)] + [(1000 + i, "x " * 100, "u", "") for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs, weights=(1, 1, 5), share=1.0).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    for ids in ({None}, {7}, set(range(1000, 1300))):
        mine = [r for r in got if r.doc_id in ids]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 100


def test_rows_that_share_an_id_are_applied_as_planned(spark, tmp_path):
    rows = [(None, f"w{i} " * (i % 9), "s", "") for i in range(200)] + [(i % 5, "q " * 30, "t", "") for i in range(100)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "d"))
    docs = table_rows(spark.read.parquet(str(tmp_path / "d")))
    want, seen = {}, {}
    for r in mixing.mix(docs).collect():
        want[r.doc_id, r.size] = want.get((r.doc_id, r.size), 0) + (r.copies if r.taken else 0)
    for r in mixing.apply_mix(docs).collect():
        key = (r.doc_id, len(r.text.split()))
        seen[key] = seen.get(key, 0) + 1
    assert seen == {k: n for k, n in want.items() if n}


def test_apply_mix_repeats_rows_and_empty_table(spark):
    docs = spark.createDataFrame(corpus(), SCHEMA)
    plan = {r.doc_id: r.copies for r in mixing.mix(docs).where("taken > 0").collect()}
    counts = {r.doc_id: r["count"] for r in mixing.apply_mix(docs).groupBy("doc_id").count().collect()}
    assert counts == {i: c for i, c in plan.items() if c}
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).isEmpty()
