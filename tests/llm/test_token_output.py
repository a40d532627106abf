import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from rosterforge.llm import token_output as T
from rosterforge.llm.common import table_rows

PATH = P.path("word_bpe_49k.json")
END = 2


LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids + [END]


def samples():
    rng = random.Random(5)
    parts = ["Ab", "c", "é", "é", " ́", "ΑΣ", "Σ.", "'s", "12", "!!", "中文", "😀", "<|endoftext|>", "<|endof", " ", "\t", "\x1c", "\x85", "\xa0", " ", "\n", "\x0b\x0c", "İ"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 80))) for _ in range(80)]


@pytest.mark.parametrize("bits", [1, 8])
def test_planes_turn_back(bits):
    rng = np.random.default_rng(1)
    for n in (1, 7, 8, 9, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint64).astype("<u4")
        planes = T.to_planes(ids, bits)
        assert len(planes) == 32 // bits
        assert (T.from_planes(planes, n, bits) == ids).all()


def test_words_alone_give_the_ids_of_the_text():
    encoder, rng = T.WordEncoder(open(PATH, encoding="utf-8").read(), False), random.Random(3)
    assert encoder.by_words
    latin = [chr(c) for c in [*range(0x20, 0x7F), *range(0xC0, 0x100)]]
    mixed = ["".join(rng.choice(latin) for _ in range(200)) for _ in range(200)]
    words = ["Größe, C'est l'été; it's THEY'LL x'S 'd''re 12a<|startoftext|>b ×÷ ÿß ÀÞ µª" + chr(c) for c in range(0x80, 0x250)]
    for text in [*samples(), *mixed, *words]:
        assert encoder.encode(text.encode(), b"").tolist() == library_ids(text)[:-1]


def test_another_tokenizer_encodes_whole_texts():
    path = P.path("byte_bpe_50k.json")
    encoder, library = T.WordEncoder(open(path, encoding="utf-8").read(), False), Tokenizer.from_file(path)
    assert not encoder.by_words
    for text in samples():
        assert encoder.encode(text.encode(), b"").tolist() == library.encode(text, add_special_tokens=False).ids


def test_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(T, "MEMO_WORDS", 5)
    encoder = T.WordEncoder(open(PATH, encoding="utf-8").read(), False)
    text = " ".join(f"w{i % 13} Größe{i % 7}" for i in range(200))
    assert encoder.encode(text.encode(), b"").tolist() == library_ids(text)[:-1]
    assert len(encoder) <= 5


def stored(spark, tmp_path, rows, **options):
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string, ids string, place int, start string").repartition(3).write.parquet(path)
    return T.write_ids(table_rows(spark.read.parquet(path)), PATH, END, **options)


def expected(rows):
    want, start = [], 0
    for doc, text in sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library_ids(text)
        want.append((doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()), ids))
        start += len(ids)
    return want


@pytest.mark.parametrize("bits,block", [(8, 64), (1, 50), (8, 65_536)])
def test_files_give_back_all_documents(spark, tmp_path, bits, block):
    texts = [*samples(), None, "", " \n", "word " * 3000, "q" * 5000]
    rows = [(7 * i % 401, t, "clash", i, "x") for i, t in enumerate(texts)]
    folder = stored(spark, tmp_path, rows, bits=bits, block_ids=block, shards=5)
    want = expected(rows)
    got = sorted((tuple(r) for r in T.read_digests(spark, folder).collect()), key=lambda r: r[1])
    assert got == [w[:4] for w in want]
    assert {r.doc_id: r.ids for r in T.read_documents(spark, folder).collect()} == {w[0]: w[4] for w in want}
    every = [i for w in want for i in w[4]]
    for begin, end in ((0, 10), (45, 160), (len(every) - 3, len(every) + 5), (700, 4000)):
        found = sorted(tuple(r) for r in T.read_range(spark, folder, begin, end).collect())
        assert found == list(enumerate(every))[begin:end]


def test_null_and_repeated_ids_keep_their_rows(spark, tmp_path):
    rows = [(None, "a b", "c", 1, "d"), (None, "b", "c", 1, "d"), (3, "x y z", "c", 1, "d"), (3, "x y z", "c", 1, "d"), (3, "x y z", "c", 1, "d"), (-1, None, "c", 1, "d")]
    got = sorted((tuple(r) for r in T.read_digests(spark, stored(spark, tmp_path, rows, shards=2)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, -1, 3, 3, 3]
    assert [r[1] for r in got] == [sum(x[2] for x in got[:i]) for i in range(6)]
    assert sorted(r[2] for r in got[:2]) == [2, 3] and got[3][2:] == got[4][2:] == got[5][2:]


def test_empty_table(spark, tmp_path):
    folder = stored(spark, tmp_path, [])
    assert T.read_digests(spark, folder).isEmpty()
    assert T.read_documents(spark, folder).isEmpty()
    assert T.read_range(spark, folder, 0, 9).isEmpty()


def test_torn_file_is_refused():
    out = T.ShardWriter(0)
    import pyarrow as pa

    content = b"".join(r + b"\n" for r in [*out.add(np.arange(70_000, dtype="<u4")), *out.close(pa.array([1]))])
    assert T.ShardReader(content).n_ids == 70_000
    with pytest.raises(ValueError):
        T.ShardReader(content[:-5])
    with pytest.raises(ValueError):
        T.ShardReader(b"")


def test_plain_texts_are_cut_at_once_into_the_ids_of_the_library():
    """Words that occur once cost no look at each word; other words, special tokens and long pieces have the library's ids, too."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from rosterforge.llm.token_output import WordEncoder

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    encoder, library = WordEncoder(spec, False), Tokenizer.from_str(spec)
    plain = ["It's 'Tis don't-they'll ''s 'S 'LL L'Été", "ÀÉß ÿ x\x0by\x0cz\r\n12a3\t!?", " ".join(f"once{k}x" for k in range(200)), "q" * 200 + " " + "!" * 300, "é" * 100, "", " \n"]
    others = ["×÷ x", "A<b c", "日本 it's", "\x1c a", "a\xa0b \xadc"]
    for text in plain + others:
        assert encoder.encode(text.encode(), b"").tolist() == library.encode(text, add_special_tokens=False).ids, text
        assert text not in plain or not len(encoder)
    assert len(encoder) and max(map(len, encoder._piece_ids.__self__)) <= 64
