"""Searches over the trigram index against scans of all names."""

import random

import pytest

from rosterforge.operators import name_index as I
from rosterforge.operators import text as X


@pytest.fixture(scope="module")
def names():
    rng = random.Random(3)
    words = ["moon", "light", "Moonlight", "ring", "Ri-Ng", "sun", "a", "B2", "x9", "the", "été", "team", "--"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4))), rng.randint(0, 30)) for i in range(300)]
    return [*rows, (1000, None, 5), (1001, "", 7), (1002, "1003", 1), (1003, "other 17", None)]


@pytest.fixture(scope="module")
def index(spark, names, tmp_path_factory):
    return I.build(spark.createDataFrame(names, "id long, name string, weight long"), str(tmp_path_factory.mktemp("names") / "index"))


@pytest.mark.parametrize("text", ["moon", "oonl", "light r", "n l", "a", "b2 x9", "été", "-", "ring ring", "zzz"])
def test_holding_equals_a_scan(names, index, text):
    low = [(i, (n or "").lower()) for i, n, _ in names]
    assert sorted(r.id for r in index.holding(text).collect()) == sorted(i for i, n in low if text in n)
    assert sorted(r.id for r in index.holding(text, begins=True).collect()) == sorted(i for i, n in low if n.startswith(text))


@pytest.mark.parametrize("text,threshold", [("moonlgiht", 0.3), ("ring", 0.5), ("the sun", 0.1), ("a", 0.9), ("??", 0.3)])
def test_similar_equals_a_scan(spark, names, index, text, threshold):
    df = spark.createDataFrame(names, "team_id long, name string, lineup_count long").fillna("", ["name"])
    want = {r.team_id: round(r.similarity, 9) for r in X.trigram_search(df, text, threshold).collect()}
    assert {r.id: round(r.similarity, 9) for r in index.similar(text, threshold).collect()} == want


def scan(names, text, limit):
    """The chain by plain loops."""
    import re

    def grams(s):
        return {p[i : i + 3] for w in re.findall("[a-z0-9]+", s) for p in [f"  {w} "] for i in range(len(p) - 2)}

    key = re.sub("[^a-z0-9]+", "", text)
    rows = [(i, (n or "").lower(), w or 0) for i, n, w in names]
    flat = lambda n: re.sub("[^a-z0-9]+", "", n)
    first = [(0 if n == text else 1 if str(i) == text else 2 if flat(n) == key else 3, -w, i) for i, n, w in rows if text in n or str(i) == text or (key and flat(n) == key)]
    if first:
        return 0, [i for _, _, i in sorted(first)][:limit]
    q = grams(text)
    like = [(-len(q & grams(n)) / len(q | grams(n)), -w, i) for i, n, w in rows if q and len(q & grams(n)) / len(q | grams(n)) >= 0.3] if len(text) > 1 else []
    if like:
        return 1, [i for _, _, i in sorted(like)][:limit]
    top = sorted((-w, i, n) for i, n, w in rows)[: limit * 10]
    return 2, [i for _, i, n in top if key and (key in re.findall("[a-z0-9]+", n) if len(key) <= 4 else key in flat(n))][:limit]


@pytest.mark.parametrize("text", ["Moonlight", "17", "1003", " RING ", "moonlgiht", "m-oon", "ri.ng", "qqqq", "su-n-moon", "-"])
def test_targets_equal_the_chain(names, index, text):
    stage, want = scan(names, text.strip().lower(), 12)
    got = index.targets(text, 12).orderBy("place").collect()
    assert [r.id for r in got] == want and {r.stage for r in got} <= {stage}


def test_suggestions_fill_up_with_similar_names(spark, index):
    got = index.suggestions("moonlig", 40).orderBy("place").collect()
    begins = [r.name.lower().startswith("moonlig") for r in got]
    assert begins == sorted(begins, reverse=True) and any(begins) and not all(begins)
    assert index.suggestions(" ").isEmpty() and index.targets("").isEmpty()


def test_only_the_folders_of_the_trigrams_are_read(index):
    plan = index.similar("moon")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "bucket" in plan[plan.index("PartitionFilters") :].split("PushedFilters")[0]


def test_no_names(spark, tmp_path):
    index = I.build(spark.createDataFrame([], "id long, name string, weight long"), str(tmp_path / "none"))
    assert index.targets("moon").isEmpty() and index.suggestions("moon").isEmpty()
