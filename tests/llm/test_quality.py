import math
import random
import re
from collections import Counter

import xxhash

from rosterforge.llm import quality

SCHEMA = "doc_id long, text string, kept int"


def counts(text):
    text = text or ""
    words = [w.decode() for w in text.encode().split()]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = set()
    for i in range(len(words) - 4):
        if grams[tuple(words[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if x.encode().split()]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def corpus():
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "bcdfg" for b in ("an", "er", "ion", "el", "u")]
    rows, labels = [], []
    for i in range(300):
        base = [rng.choice(words) for _ in range(rng.randint(12, 60))]
        if i % 4 == 0:
            base = [w.upper() + "!!" if i % 8 else w + "***" for w in base]
        rows.append((i, " ".join(base), 0))
        if i % 3 == 0:
            labels.append((i, int(i % 4 != 0)))
    return rows, labels


def test_counts_and_verdicts(spark):
    rows, labels = corpus()
    extra = [None, "", " \n ", "a b c d e f a b c d e", "line one\nline one\n \nline two\nline two x", "x " * 20_000, "é# ñ| <b>", "a b c d e a b c d e f g h i j k l m n o p q r s t u v w x y z " + " ".join(f"q{k}" for k in range(30))]
    rows += [(1000 + k, t, 0) for k, t in enumerate(extra)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels + [(0, 0), (77777, 1)], "doc_id long, quality int")).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(t), i
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    right = sum(got[i].kept == (i % 4 != 0) for i in range(300) if not got[i].base_failed)
    assert right >= 0.98 * sum(not got[i].base_failed for i in range(300))


def test_without_labels_and_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(12)), 0), (2, "few words", 0)], SCHEMA)
    assert {r.doc_id: r.kept for r in quality.quality(docs, none).collect()} == {1: True, 2: False}
    assert quality.quality(docs.limit(0), none).isEmpty()


def brute_ratios(rows, labels):
    """doc_id: (llr, features) by counting n-grams with dictionaries, and the log ratios."""
    lower = {i: [w.decode() for w in (t or "").encode().split()] for i, t in rows}

    def shapes(text):
        out = re.sub(r"[0-9]+", "0", re.sub(r"[A-Z]+", "A", re.sub(r"[a-z]+", "a", text or "")))
        return out.split()

    def features(i, t):
        words = [xxhash.xxh64_intdigest(w.lower().encode(), 42) % 4096 for w in lower[i]]
        s = shapes(t)
        pairs = [4096 + xxhash.xxh64_intdigest(b.encode(), xxhash.xxh64_intdigest(a.encode(), 42)) % 4096 for a, b in zip(s, s[1:])]
        return words, pairs

    good = {i for i, q in labels if q == 1} - {i for i, q in labels if q == 0}
    raw, target = [1.0] * 8192, [1.0] * 8192
    found = {i: features(i, t) for i, t in rows}
    for i, (words, pairs) in found.items():
        for b in words + pairs:
            raw[b] += 1
            target[b] += i in good
    ratio = []
    for part in (0, 4096):
        a, b = sum(raw[part : part + 4096]), sum(target[part : part + 4096])
        ratio += [round(math.log(target[k] / b) - math.log(raw[k] / a), 6) for k in range(part, part + 4096)]
    return {i: (sum(ratio[b] for b in words + pairs) / max(1, 2 * len(words) - 1)) for i, (words, pairs) in found.items()}


def test_ratio_and_verdict_equal_brute_force(spark):
    rows, labels = corpus()
    rows += [(1000, None, 0), (1001, "", 0), (1002, "Only Seven words here, not enough.", 0), (1003, "w " * 40, 0)]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    want = brute_ratios([(i, t) for i, t, _ in rows], labels)
    assert all(abs(got[i].llr - want[i]) < 1e-6 for i in want)
    known = [(math.floor(want[i] * 100), q) for i, q in labels if not got[i].base_failed]
    n = [sum(q == k for _, q in known) for k in (0, 1)]
    score = lambda cut: sum(q == 1 for s, q in known if s >= cut) / n[1] - sum(q == 0 for s, q in known if s >= cut) / n[0]
    best = max(score(s) for s, _ in known)
    cut = min(s for s, _ in known if score(s) > best - 1e-12) / 100
    assert {i: r.kept for i, r in got.items()} == {i: not got[i].base_failed and want[i] >= cut for i in want}


def test_repeated_and_null_ids_and_clashing_columns(spark):
    docs = spark.createDataFrame([(None, "some words " * 3, "x", 1), (4, "a b", "x", 1), (4, "a b c", "x", 1), (4, "a b", "x", 1)], "doc_id long, text string, bucket string, llr int")
    labels = spark.createDataFrame([(4, 1), (4, 1), (None, 0)], "doc_id long, quality int")
    got = sorted((r.doc_id or -1, r.n_words) for r in quality.quality(docs, labels).collect())
    assert got == [(-1, 6), (4, 2), (4, 2), (4, 3)]
