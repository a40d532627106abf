import base64
import hashlib
import random

import public_tokenizers as P
import regex
import tiktoken

from rosterforge.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def samples():
    rng = random.Random(1)
    alphabet = ["a", "Bc", "é", "ß", "ñ", " ", "  ", "\n", "\n \n", "'s", "'ll", "1", "42", "!!", "***", "😀", "\t", "中文", "<|endoftext|>", " "]
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 400))) for _ in range(60)]


def test_stitched_chunks_equal_whole_matches():
    pattern = regex.compile(P.PATTERN)
    for text in [*samples(), "a" * 700, " " * 500 + "x", "ab " * 300, "x" * 150 + " " * 150 + "y" * 300, "'ll" * 200]:
        for chunk, overlap in ((7, 9), (16, 12), (50, 20), (64, 40)):
            assert bpe.pretokenize(pattern, text, chunk, overlap) == pattern.findall(text)


def test_ids_and_bytes_equal_the_library(spark):
    enc = library()
    texts = [*samples(), None, "", " ", "long " * 30_000, "q" * 40_000]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], "again")], "doc_id long, text string, ids string")
    got = bpe.digests(docs, PATH, P.PATTERN).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        ids = enc.encode_ordinary(texts[r.doc_id] or "")
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_round_trip_gives_what_the_digests_are_of(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(samples())], "doc_id long, text string")
    both = {r.doc_id: r for r in bpe.round_trip(docs, PATH, P.PATTERN).collect()}
    for r in bpe.digests(docs, PATH, P.PATTERN).collect():
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, both[r.doc_id].ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(bytes(both[r.doc_id].decoded)).hexdigest()


def test_work_is_linear_in_one_long_run():
    """One pre-token of twenty million letters, between others: matched in windows that double."""
    import time

    pattern = regex.compile(P.PATTERN)
    text = "ab 12 " * 5_000 + "q" * 20_000_000 + " tail!" * 5_000
    began = time.process_time()
    whole = pattern.findall(text)
    plain = time.process_time() - began
    began = time.process_time()
    assert bpe.pretokenize(pattern, text) == whole
    assert time.process_time() - began < 12 * plain + 2


def test_encode_then_decode(spark):
    docs = spark.createDataFrame([(1, "Größe 1\n"), (2, None)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert {r.doc_id: bytes(r.decoded).decode() for r in back} == {1: "Größe 1\n", 2: ""}


def test_empty_table(spark):
    assert bpe.round_trip(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).isEmpty()
