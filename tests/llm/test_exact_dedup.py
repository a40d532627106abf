import hashlib
import re

from pyspark.sql import functions as F

from rosterforge.llm import exact_dedup as xd
from rosterforge.llm.common import ROW, table_rows

SCHEMA = "doc_id long, text string, kept string, h int"


def brute(rows):
    norm = {i: re.sub(r"[ \t-\r]+", " ", t or "") for i, t, *_ in rows}
    groups = {}
    for i, t in norm.items():
        groups.setdefault(t, []).append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


def rows():
    texts = ["a b", "a  b", "a\n\tb", " a b", "a b", None, "", " ", "x" * 50_000, "é", "A b"] + [f"d{k % 7}" for k in range(40)] + ["hot text"] * 1500
    return [(10 * i + 3, t, "clash", 1) for i, t in enumerate(texts)]


def as_map(frame):
    return {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in frame.collect()}


def test_equals_brute_force(spark):
    data = rows()
    assert as_map(xd.exact_dedup(spark.createDataFrame(data, SCHEMA))) == brute(data)


def test_colliding_hashes_are_told_apart(spark):
    data = rows()[:60]
    weak = lambda norm: F.unhex(F.lpad(F.hex(F.length(norm) % 3), 32, "0"))
    assert as_map(xd.exact_dedup(spark.createDataFrame(data, SCHEMA), hash_fn=weak)) == brute(data)


def test_null_ids_repeated_rows_and_empty_table(spark):
    data = [(None, "n", "", 0), (None, "n", "", 0), (5, "m", "", 0), (None, "m", "", 0), (7, "r", "", 0), (7, "r", "", 0)]
    got = xd.exact_dedup(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == 6
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(None, None, 2), (5, 5, 2), (None, 5, 2), (7, 7, 2)}
    assert sorted(r.kept for r in got if r.doc_id == 7) == [False, True]
    assert sorted(r.kept for r in got if r.doc_id is None and r.keep_id is None) == [False, True]
    assert xd.exact_dedup(spark.createDataFrame([], SCHEMA)).isEmpty()
    kept = xd.deduplicate(spark.createDataFrame(rows(), SCHEMA))
    assert kept.columns == ["doc_id", "text", "kept", "h"] and kept.count() == len({v[0] for v in brute(rows()).values()})


def test_one_row_of_each_text_stays(spark):
    """An id that also labels a copy does not take a unique text along, and equal rows do not all stay."""
    data = [(3, "copy"), (7, "copy"), (7, "unique"), (None, "n"), (None, "n"), (None, "copy"), (9, "twice"), (9, "twice"), (9, "twice"), (None, "lone")]
    kept = xd.deduplicate(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.text) for r in kept) == [(-1, "lone"), (-1, "n"), (3, "copy"), (7, "unique"), (9, "twice")]


def test_parquet_rows_are_told_apart_by_their_place(spark, tmp_path):
    data = [(1, "a"), (1, "b"), (1, "a"), (None, "c"), (None, "c")]
    spark.createDataFrame(data, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/t")
    rows = table_rows(spark.read.parquet(f"{tmp_path}/t"))
    assert rows.select(ROW).distinct().count() == 5
    assert sorted((r.doc_id or -1, r.text) for r in xd.deduplicate(rows).collect()) == [(-1, "c"), (1, "a"), (1, "b")]
