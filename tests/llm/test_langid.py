import random
import zlib

from rosterforge.llm import langid

WORDS = {"aa": ["the", "shon", "wher", "ing"], "bb": ["der", "schö", "keit", "ung"], "cc": ["que", "ción", "ñada", "los"]}


def corpus(n=240):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(3, 30))), lang if i % 7 else None, "x"))
    return rows


def test_held_out_accuracy_and_defined_cases(spark):
    extra = [(1000, None, "aa", "x"), (1001, "", None, "x"), (1002, "12 !! 3", None, "x"), (1003, "schö keit " * 40_000, None, "x"), (None, "der ung", None, "x")]
    docs = spark.createDataFrame(corpus() + extra, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert len(got) == 245
    truth = {i: sorted(WORDS)[i % 3] for i in range(240)}
    assert all(got[i].lang_pred == truth[i] for i in truth if got[i].held_out)
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert [got[i].lang_pred for i in (1000, 1001, 1002, 1003, None)] == ["und", "und", "und", "bb", "bb"]
    assert all(0.0 <= r.score <= 1.0 for r in got.values())


def brute_bits(train, lang, text):
    """Code length by walking the context trees byte by byte."""
    counts = {}
    for t, name in train:
        if name == lang:
            data = b"\0\0\0" + t.encode()
            for i in range(3, len(data)):
                for k in range(4):
                    counts.setdefault(data[i - k : i], {}).setdefault(data[i], 0)
                    counts[data[i - k : i]][data[i]] += 1
    import math

    total, data = 0.0, b"\0\0\0" + text.encode()
    for i in range(3, len(data)):
        for k in (3, 2, 1, 0):
            seen = counts.get(data[i - k : i], {})
            n = sum(seen.values())
            if not n:
                continue
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / (n + len(seen)))
                break
            total -= math.log2(len(seen) / (n + len(seen)))
        else:
            total += 8.0
    return total


def test_code_lengths_equal_a_walk_down_the_trees(spark):
    train = [(t, lang) for i, t, lang, _ in corpus(60) if lang]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(train)], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    texts = ["the keit zz", "ñada der", "wher\x00 \U0001f600", "ing"]
    bits = langid.code_lengths(model, [t.encode() for t in texts])
    for row, text in zip(bits, texts, strict=True):
        for value, lang in zip(row, model, strict=True):
            assert abs(value - brute_bits(train, lang, text)) < 1e-3


def test_nothing_to_learn_and_empty_table(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(none).collect()] == ["und"]
    assert langid.identify(none.limit(0)).isEmpty()


def test_language_of_few_long_documents_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_BYTES", 4_000)
    for begin in range(0, 60, 10):
        rows = [(begin + i, "kurze worte " * 50, "de") for i in range(5)] + [(begin + 5 + i, "lange texte weiter " * 9_000, "xx") for i in range(2)]
        assert set(langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))) == {"de", "xx"}
