import hashlib
import re

import public_tokenizers as P

import corpus_pipeline
from rosterforge.llm import mixing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_take_effect_and_keep_columns(spark, tmp_path):
    en = "the shon wher ing of and to that {} was with for are by on this not be at or as from".split()
    rows = []
    for i in range(60):
        text = " ".join(w.format(f"k{i}") + (f"x{i}" if k % 3 == 0 else "") for k, w in enumerate(en * 3))
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    rows += [(100, rows[0][1], "en", "s0", 1), (101, rows[1][1].replace(" ", "\n", 4), "en", "s1", 1), (102, rows[2][1] + " end", "en", "s2", 1), (103, "12 34 !!", "en", "s0", 1), (104, None, "en", "s0", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path)
    docs.write.parquet(f"{path}/documents.parquet")
    seen = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, path)
        assert seen.columns == docs.columns, name
        kept.append({r.doc_id for r in seen.select("doc_id").collect()})
    assert {103, 104}.isdisjoint(kept[0]) and len(kept[0]) == 63
    assert kept[1] == kept[0] - {100, 101}
    assert kept[2] == kept[1] - {102}
    out = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in out} == kept[3]
    text = {r[0]: r[1] for r in rows}
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in out)


def words(text):
    return text.encode().lower().split()


def brute_stages(rows):
    """Rows left by the three filtering stages: (id, text) rows told apart by their position."""
    left = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    order = lambda r: (r[0] is None, r[0] or 0)
    firsts = {}
    for r in left:
        norm = re.sub(r"[ \t-\r]+", " ", r[1])
        if norm not in firsts or order(r) < order(firsts[norm]):
            firsts[norm] = r
    left = list(firsts.values())
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(r[1]) for r in left)]
    label = list(range(len(left)))
    for _ in left:
        for i in range(len(left)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    label[i] = label[j] = min(label[i], label[j])
    best = {}
    for r, k in zip(left, label, strict=True):
        if k not in best or order(r) < order(best[k]):
            best[k] = r
    return list(best.values())


def hard_corpus():
    """Null and repeated ids, repeated rows, near copies, an empty, a blank and a very long text."""
    base = [" ".join(f"w{(7 * i + k * k) % 900}" for k in range(80)) for i in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(3, base[3]), (3, base[4].replace(" ", "  ")), (None, base[5]), (None, base[5] + " tail"), (None, "only null id here to be kept ok"), (None, "only null id here to be kept ok")]
    rows += [(50, base[6] + " tail"), (50, "unique text under a repeated id"), (51, base[7][:-3]), (60, None), (61, ""), (62, " \n\t"), (63, "1 2 3"), (64, "long " * 60_000), (65, "z")]
    return rows


def test_stages_equal_brute_force_on_rows(spark, tmp_path):
    rows = hard_corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, size string"
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 2}", 0, "extra", "clash") for k, (i, t) in enumerate(rows)], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, seen, str(tmp_path))
        assert out.columns == docs.columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want = sorted(brute_stages(rows), key=key)
    assert sorted([(r.doc_id, r.text) for r in seen.collect()], key=key) == want
    mixed = corpus_pipeline.STAGES[3][1](spark, seen, str(tmp_path))
    plan = mixing.mix(seen).collect()
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan if r.taken)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == mixed.count()


def test_rows_that_stay_do_not_depend_on_the_names_of_files(spark, tmp_path):
    """Equal texts and near copies under null and repeated ids, from different sources: every copy of the table keeps the same rows."""
    base = " ".join(f"w{k}" for k in range(60))
    rows = [(None, "same text of some words here", "en", f"s{k}", 0) for k in range(6)] + [(7, base + f" tail{k}", "en", f"s{k}", 0) for k in range(6)]
    docs, found = spark.createDataFrame(rows, SCHEMA).repartition(6), set()
    for k in range(5):
        docs.write.parquet(f"{tmp_path}/copy{k}")
        seen = spark.read.parquet(f"{tmp_path}/copy{k}")
        exact, near = (stage(spark, seen, str(tmp_path)).collect() for _, stage in corpus_pipeline.STAGES[1:3])
        found.add((tuple(sorted(map(str, exact))), tuple(sorted(map(str, near)))))
        assert len(exact) == 7 and len(near) == 2
    assert len(found) == 1


def test_empty_table_passes_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).isEmpty()


def test_registry():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
    assert len(corpus_pipeline.STAGES) == 5 and P.PATTERN
