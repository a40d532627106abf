"""Byte-level BPE encoding and decoding.

A text is cut into chunks that overlap. Every chunk is pre-tokenised on its own; neighbours are stitched at the first pre-token
boundary that both agree on inside the overlap, and where they agree on none, the left chunk's pre-tokens simply run on.
The pieces are then encoded one by one (memoised by piece). Decoding concatenates the raw bytes of the ids.
Documents are spread over tasks; the chunks of one document stay together, since its ids are one row.

Defined cases: a null text counts as empty and has no ids; special-token strings are ordinary text; repeated rows
give repeated results; an id outside the vocabulary makes decoding fail; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_CHARS, OVERLAP_CHARS = 16_384, 256
#: A boundary nearer than this to a chunk's end may depend on characters after it.
MARGIN = 8
#: Pieces longer than this are encoded each time; the memo is emptied when it holds MEMO_PIECES.
MEMO_CHARS, MEMO_PIECES = 48, 100_000
#: Characters of text that one outgoing Arrow batch holds at most (a longer text is a batch of its own).
BATCH_CHARS = 1_000_000


def pretokenize(pattern, text: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[str]:
    """pattern.findall(text), by chunks that are matched independently and stitched where boundaries agree."""
    n = len(text)
    if n <= chunk + overlap:
        return pattern.findall(text)
    starts = list(range(0, n, chunk))
    parts = [pattern.findall(text, a, min(n, a + chunk + overlap)) for a in starts]
    return stitch(pattern, text, starts, parts, chunk, overlap)


def stitch(pattern, text: str, starts: list[int], parts: list[list[str]], chunk: int, overlap: int) -> list[str]:
    n, out, tokens, at, k = len(text), [], parts[0], 0, 1
    end = min(n, chunk + overlap)  # of the window that tokens were matched in, from at
    while k < len(starts) and end < n:
        limit = end - MARGIN
        left = {}
        sure, sure_at = 0, at
        for i, reached in enumerate(accumulate(map(len, tokens), initial=at)):
            if reached > limit:
                break
            sure, sure_at = i, reached
            if reached >= starts[k]:
                left[reached] = i
        met = None
        for j, begin in enumerate(accumulate(map(len, parts[k]), initial=starts[k])):
            if begin > limit:
                break
            if begin in left:
                met = (left[begin], j, begin)
                break
        if met:
            out += tokens[: met[0]]
            tokens, at = parts[k][met[1] :], met[2]
            end = min(n, starts[k] + chunk + overlap)
            k += 1
        else:  # a pre-token spans the overlap: go on from the last sure boundary, in a window of twice the width, so that the work stays linear
            out += tokens[:sure]
            end = min(n, max(starts[k] + chunk + overlap, sure_at + 2 * (end - sure_at)))
            tokens, at = pattern.findall(text, sure_at, end), sure_at
            k = max(k + 1, (end - overlap) // chunk)
    return out + tokens


class Codec:
    """Encodes and decodes by a table of ranks; pattern splits a text into pre-tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        import tiktoken

        self.pattern = regex.compile(pattern)
        # One match takes a whole piece, so that pieces are merged as they were cut here.
        self._merge = tiktoken.Encoding("ranks", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.raw = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.raw[i] = token
        self._memo: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        """The ids as bytes, which are smaller to keep and quicker to join than numbers."""
        ids = self._memo.get(piece)
        if ids is None:
            ids = np.array(self._merge(piece), dtype=np.int32).tobytes()
            if len(piece) <= MEMO_CHARS:
                if len(self._memo) >= MEMO_PIECES:
                    self._memo.clear()
                self._memo[piece] = ids
        return ids

    def encode(self, text: str | None, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> np.ndarray:
        pieces = pretokenize(self.pattern, text or "", chunk, overlap)
        return np.frombuffer(b"".join(map(self._piece, pieces)), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids.tolist()))


def _codec(ranks: bytes, pattern: str) -> Codec:
    """The codec of this worker process, which serves many tasks; the library's functions are shipped by value, so it is kept in a module made here."""
    import sys
    import types

    kept = sys.modules.setdefault("_codecs_of_worker", types.ModuleType("_codecs_of_worker"))
    key = (hash(ranks), pattern)
    if getattr(kept, "key", None) != key:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        kept.key, kept.codec = key, Codec(table, pattern)
    return kept.codec


def _ids_array(parts: list[np.ndarray]) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=pa.int32()))


def _slices(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose lengths sum to BATCH_CHARS at most, or of one row."""
    begin, size = 0, 0
    for i, length in enumerate(lengths):
        if i > begin and size + length > BATCH_CHARS:
            yield begin, i
            begin, size = i, 0
        size += length
    if begin < len(lengths):
        yield begin, len(lengths)


def _summed(columns: dict, ids: list[np.ndarray]) -> dict:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of rows with ids and decoded."""
    sha = lambda data: hashlib.sha256(data).hexdigest()
    return {
        "doc_id": columns["doc_id"], "n_tokens": pa.array(map(len, ids), pa.int64()),
        "ids_sha256": pa.array([sha(",".join(map(str, x.tolist())).encode()) for x in ids], pa.string()),
        "decoded_sha256": pa.array([sha(x.as_buffer()) for x in columns["decoded"]], pa.string()),
    }


def _read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _run(docs: DataFrame, ranks_path: str, pattern: str, id_col: str, value_col: str, kind: str) -> DataFrame:
    """kind: encode, decode, both, or digests of both. The rank table (bounded by the vocabulary) is broadcast."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(_read_ranks(ranks_path))

    def work(batches):
        codec = _codec(shared.value, pattern)
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1)) if kind == "decode" else pc.utf8_length(batch.column(1))
            for a, b in _slices(lengths.fill_null(0).to_pylist()):
                columns = {"doc_id": batch.column(0).slice(a, b - a)}
                values = batch.column(1).slice(a, b - a).to_pylist()
                if kind == "decode":
                    ids = [np.asarray(x or (), dtype=np.int32) for x in values]
                else:
                    ids = [codec.encode(x) for x in values]
                    columns["ids"] = _ids_array(ids)
                if kind != "encode":
                    columns["decoded"] = pa.array([codec.decode(x) for x in ids], type=pa.binary())
                yield pa.RecordBatch.from_pydict(_summed(columns, ids) if kind == "digests" else columns)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(value_col).alias("value"))
    kinds = {"encode": "ids array<int>", "decode": "decoded binary", "both": "ids array<int>, decoded binary", "digests": "n_tokens long, ids_sha256 string, decoded_sha256 string"}
    return rows.mapInArrow(work, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {kinds[kind]}")


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of every whole text."""
    return _run(docs, ranks_path, pattern, id_col, text_col, "encode")


def decode(rows: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded (raw bytes) of every list of ids."""
    return _run(rows, ranks_path, pattern, id_col, ids_col, "decode")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the bytes decoded from those ids, in one pass."""
    return _run(docs, ranks_path, pattern, id_col, text_col, "both")


def digests(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of round_trip's ids and bytes, which stay in the task that made them."""
    return _run(docs, ranks_path, pattern, id_col, text_col, "digests")
