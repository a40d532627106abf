import hashlib
import random

from pyspark.sql import functions as F

from rosterforge.llm import substring_dedup as sd
from rosterforge.llm.common import ROW, keyed


def brute(rows):
    words = {i: (t or "").encode().split() for i, t in rows}
    first = {}
    for i in sorted(words):
        w = words[i]
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone.update(range(k, k + 50))
        kept = [x for k, x in enumerate(w) if k not in gone]
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def corpus():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(400)}"
    passages = [[word() for _ in range(n)] for n in (49, 50, 51, 60, 90, 200)]
    rows = []
    for i in range(60):
        text = [word() for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(text))
            text[at:at] = rng.choice(passages)
        rows.append((i * 5, " ".join(text)))
    rows += [(500, rows[3][1]), (501, rows[3][1].replace(" ", "\n")), (502, rows[3][1] + " tail"), (503, None), (504, ""), (505, "a " * 300), (506, "a " * 120)]
    return rows


def digest(frame):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in frame.collect()}


def test_equals_brute_force(spark):
    rows = corpus()
    got = sd.substring_dedup(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_words int"))
    want = brute(rows)
    assert digest(got) == want
    assert any(0 < x[1] < x[0] for x in want.values())


def test_batches_equal_one_run_and_compact(spark):
    rows = sorted(corpus())
    log = sd.FingerprintLog(spark)
    got, history = {}, None
    step = -(-len(rows) // sd.FAN_OUT)
    for a in range(0, len(rows), step):
        batch = keyed(spark.createDataFrame(rows[a : a + step], "doc_id long, text string"))
        batch = batch.withColumn(ROW, F.struct(F.lit(a).alias("batch"), F.col(ROW).alias("n")))
        got |= digest(sd.ingest(log, batch, history))
        history = batch if history is None else history.union(batch)
    assert got == brute(rows)
    assert len(log.runs) == 1


def test_a_later_batch_of_smaller_ids(spark):
    """Batches need not come in order of their ids: each is judged by the smaller ids known so far."""
    words = " ".join(f"w{k}" for k in range(70))
    frame = lambda n, rows: keyed(spark.createDataFrame(rows, "doc_id long, text string")).withColumn(ROW, F.struct(F.lit(n).alias("batch"), F.col(ROW).alias("n")))
    log = sd.FingerprintLog(spark)
    one = frame(1, [(5, words), (6, words + " x")])
    assert {i: v[1] for i, v in digest(sd.ingest(log, one)).items()} == {5: 0, 6: 70}
    two = frame(2, [(2, "y " + words), (9, words), (10, "z " + words)])
    assert {i: v[1] for i, v in digest(sd.ingest(log, two, one)).items()} == {2: 0, 9: 70, 10: 70}


def test_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(70)) for c in "ab")
    rows = [(3, a), (7, a), (7, b), (9, b + " end"), (None, a), (None, b), (9, b + " end")]
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), batches=3).collect())
    assert got == [(-1, 70, 0), (-1, 70, 0), (3, 70, 0), (7, 70, 0), (7, 70, 70), (9, 71, 70), (9, 71, 70)]


def test_colliding_window_hashes(spark, monkeypatch):
    monkeypatch.setattr(sd, "BASES", (1, sd.BASES[1]))  # base 1: the order of words is lost
    rows = [(1, " ".join(f"a{i}" for i in range(60))), (2, " ".join(f"a{i}" for i in reversed(range(60))))]
    got = sd.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.n_removed for r in got.collect()] == [0, 0]


def test_empty_table(spark):
    assert sd.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).isEmpty()
