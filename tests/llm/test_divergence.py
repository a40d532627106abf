import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from rosterforge.llm import divergence as D
from rosterforge.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, chunk string"


def brute(rows, min_docs, top):
    docs, counts, groups = Counter(), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        text, lang, source = text or "", lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)]
        counts[lang, source].update(terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for x, s in groups if x == lang)
        kept = sorted((t for x, t in docs if x == lang and docs[x, t] >= min_docs), key=str.encode)
        totals = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 5) // (totals[s] + 5 * len(kept)) for t in kept} for s in sources}
        q = {t: 1 + 10**9 * (sum(counts[lang, s][t] for s in sources) + 5) // (sum(totals.values()) + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return sorted(out)


def sample(n=300):
    rng = random.Random(11)
    words = ["Ab", "ab", "c", "é", "É", "zz", "中文", "ä-b", "x1y", "q_r", "\u0085n", "ﬀ", "😀", "𝄞", "ｚ", "don't", "A", "a"]
    rows = [(i % 50, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "é", "z"]), "t", "n", "c") for i in range(n)]
    return [*rows, *rows[:20], (None, None, "xx", "only", "t", "n", "c"), (1, "", "yy", "a", "t", "n", "c"), (1, "rare", "yy", "b", "t", "n", "c")]


@pytest.mark.parametrize("cells,held,piece", [(1 << 20, 300_000, 1 << 20), (4, 3, 5), (11, 50, 1)])
def test_equals_brute_force(spark, monkeypatch, cells, held, piece):
    for name, value in (("BLOCK_CELLS", cells), ("HELD_COUNTS", held), ("PIECE_BYTES", piece)):
        monkeypatch.setattr(D, name, value)
    rows = sample()
    got = D.audit(spark.createDataFrame(rows, SCHEMA).repartition(3), min_docs=9, top=4).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 9, 4)
    assert {r.value for r in got if r.lang == "yy"} == {0}
    assert not any(r.lang == "xx" for r in got)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = queries.op13_source_divergence(spark, sf)
    want = con.execute(queries.ORACLE_SQL["op13_source_divergence"])
    assert [c[0] for c in want.description] == df.columns
    assert sorted(tuple(r) for r in df.collect()) == sorted(want.fetchall())


def test_shares_are_exact():
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 10**13, 2000)
    totals = counts + rng.integers(5, 10**14, 2000)
    assert D.shares(counts, totals).tolist() == [1 + 10**9 * (int(c) + 5) // int(t) for c, t in zip(counts, totals)]


def test_long_text_in_pieces(monkeypatch):
    monkeypatch.setattr(D, "PIECE_BYTES", 7)
    text = ("Wörter und " + "lang" * 40 + " 12 ") * 30
    terms = [t for piece in D.term_pieces(text.encode()) for t in piece]
    assert terms == [t.encode() for t in text.lower().replace("12", "").split()]


def test_empty_table(spark):
    assert D.audit(spark.createDataFrame([], SCHEMA)).isEmpty()
