"""Token-ID output: bit-plane shuffled blocks of ids in binary files, with a chunk index, and reading them back.

Documents are dealt by range of (id, row), so that a file holds whole documents in ascending order and the files' order continues it. Each task
encodes its documents and writes one file: blocks of BLOCK_IDS ids, each transposed into planes (one per byte, or per bit, of an
unsigned 32-bit little-endian id) that are compressed alone with zstandard, so that the nearly empty high planes cost almost nothing. Behind the blocks stand
the documents' ids and lengths, the chunk index (place, ids and compressed length of every plane of a block) and a tail of
fixed size. Spark's own writer makes the files (a record's bytes are one line of its text source, the line's end is part of the format), so any
store that Spark writes will do and a lost executor's file is committed once. A table of all files (`index`) gives each file's first id, and
a range of ids is read by decompressing the blocks that hold it and no other.

Encoding: where the tokenizer's file declares that white space is dropped (BY_WORDS), a text is split at the six ASCII white-space characters, across
which neither normalisation, pattern nor merges reach; each word's ids are kept in a memo of bounded size, and texts of plain characters are cut into pieces at once. Any other tokenizer encodes whole texts.

Defined cases: a null text counts as empty and has the end id alone; null ids come first, rows that repeat an id follow their place in the table; a text of any length is
one document in one file; an empty table gives no file and an empty index; other columns are ignored, whatever their names; ids are integers or strings.
Strings of special tokens in a text become special ids as in the library's default; `special_as_text` makes them ordinary text.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rosterforge.llm.common import ROW, broadcast_if_small, keyed, new_folder, slices

BLOCK_IDS = 65_536
#: Words longer than this (bytes) are encoded each time; the memo is emptied when it holds MEMO_WORDS.
MEMO_BYTES, MEMO_WORDS = 64, 300_000
#: What a tokenizer must declare to be encoded word by word (fixed values of the tokenizer's file format).
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
}
#: Fixed values of the format: first and last bytes of a file, and the tail's fields (length of the document table and of the
#: chunk index, ids, ids of a block, shard, bits of a plane).
MAGIC, TAIL = b"IDPLANES", "<QQQIIB8s"


def to_planes(ids: np.ndarray, bits: int) -> list[bytes]:
    """The planes of a block, lowest first: 4 byte planes, or 32 bit planes of which each is padded to whole bytes."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits == 8:
        return [p.tobytes() for p in octets.T]
    lowest_first = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(p, bitorder="little").tobytes() for p in lowest_first.T]


def from_planes(planes: list[bytes], n: int, bits: int) -> np.ndarray:
    rows = [np.frombuffer(p, dtype=np.uint8) for p in planes]
    if bits == 1:
        flat = np.stack([np.unpackbits(p, count=n, bitorder="little") for p in rows], axis=1)
        octets = np.packbits(flat, axis=1, bitorder="little")
    else:
        octets = np.stack(rows, axis=1)
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class ShardWriter:
    """The records of one file: add() yields full blocks, close() the rest, the tables and the tail."""

    def __init__(self, shard: int, block_ids: int = BLOCK_IDS, bits: int = 8):
        import zstandard

        self._pack = zstandard.ZstdCompressor(level=3).compress
        self.shard, self.block_ids, self.bits = shard, block_ids, bits
        self._waiting: list[np.ndarray] = []
        self._held = self._ids = 0
        self._at, self._index, self._lengths = 0, [], []

    def _record(self, body: bytes) -> bytes:
        head = MAGIC if not self._at else b""
        self._at += len(head) + len(body) + 1  # the line's end
        return head + body

    def _block(self, ids: np.ndarray) -> bytes:
        planes = [self._pack(p) for p in to_planes(ids, self.bits)]
        self._index.append([self._at or len(MAGIC), len(ids), *map(len, planes)])
        self._ids += len(ids)
        return self._record(b"".join(planes))

    def add(self, ids: np.ndarray) -> Iterator[bytes]:
        self._lengths.append(len(ids))
        self._waiting.append(ids)
        self._held += len(ids)
        if self._held >= self.block_ids:
            joined = np.concatenate(self._waiting)
            whole = len(joined) // self.block_ids * self.block_ids
            for a in range(0, whole, self.block_ids):
                yield self._block(joined[a : a + self.block_ids])
            self._waiting, self._held = [joined[whole:].copy()], len(joined) - whole

    def close(self, doc_ids: pa.Array) -> Iterator[bytes]:
        if self._held:
            yield self._block(np.concatenate(self._waiting))
        table = pa.table({"doc_id": doc_ids, "n_tokens": pa.array(self._lengths, pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        docs = self._pack(sink.getvalue().to_pybytes())
        index = self._pack(np.array(self._index, dtype="<i8").tobytes())
        yield self._record(docs + index + struct.pack(TAIL, len(docs), len(index), self._ids, self.block_ids, self.shard, self.bits, MAGIC))


class ShardReader:
    """A file's tables, and the ids of any of its blocks."""

    def __init__(self, content):
        import zstandard

        self._unpack = zstandard.ZstdDecompressor().decompress
        self._content = memoryview(content)
        tail = len(self._content) - 1 - struct.calcsize(TAIL)  # Spark's writer ends the last line, too
        if tail < 0 or self._content[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of id planes")
        docs, index, self.n_ids, self.block_ids, self.shard, self.bits, magic = struct.unpack_from(TAIL, self._content, tail)
        if magic != MAGIC:
            raise ValueError("a file of id planes that isn't whole")
        at = tail - docs - index
        with pa.ipc.open_stream(self._unpack(self._content[at : at + docs])) as rows:
            self.docs = rows.read_all()
        self.index = np.frombuffer(self._unpack(self._content[at + docs : tail]), dtype="<i8").reshape(-1, 2 + 32 // self.bits)

    def block(self, k: int) -> np.ndarray:
        at, n, *lengths = self.index[k].tolist()
        planes = []
        for length in lengths:
            planes.append(self._unpack(self._content[at : at + length]))
            at += length
        return from_planes(planes, n, self.bits)

    def ids(self, begin: int, end: int) -> Iterator[np.ndarray]:
        """The ids from begin to end, by block; blocks outside are not touched."""
        for k in range(begin // self.block_ids, -(-end // self.block_ids)):
            first = k * self.block_ids
            yield self.block(k)[max(0, begin - first) : end - first]

    def checksums(self) -> Iterator[int]:
        """The unsigned crc32 of every document's ids, whatever blocks it spans."""
        ends, at, k, part = np.cumsum(self.docs.column("n_tokens").to_numpy()).tolist(), 0, 0, 0
        for b in range(len(self.index)):
            block = self.block(b)
            raw, pos = memoryview(block.view(np.uint8)), 0
            while k < len(ends):
                stop = min(ends[k] - at, len(block))
                part = zlib.crc32(raw[4 * pos : 4 * stop], part)
                if ends[k] - at > len(block):  # it goes on in the next block
                    break
                yield part
                pos, part, k = stop, 0, k + 1
            at += len(block)
        yield from [0] * (len(ends) - k)

    def documents(self) -> Iterator[tuple[object, int, int]]:
        """id, place of the first id in the file, number of ids."""
        lengths = self.docs.column("n_tokens").to_numpy()
        yield from zip(self.docs.column("doc_id").to_pylist(), (np.cumsum(lengths) - lengths).tolist(), lengths.tolist())


class PieceEncoder(dict):
    """Piece of a word, as the tokenizer's pattern cuts it -> bytes of its ids by the library's merges, with a memo of two generations."""

    def __init__(self, model):
        super().__init__()
        self._old: dict[str, bytes] = {}
        self._merge = model.tokenize
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}  # bytes that stand for themselves at byte level
        others = (b for b in range(256) if b not in printable)
        self._byte_level = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}

    def __missing__(self, piece: str) -> bytes:
        ids = self._old.get(piece)
        if ids is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self._byte_level)
            ids = b"".join([struct.pack("<I", t.id) for t in self._merge(shown)])
            if len(piece) > MEMO_BYTES:
                return ids
        if len(self) >= MEMO_WORDS:
            self._old = dict(self)
            self.clear()
        self[piece] = ids
        return ids


class WordEncoder(dict):
    """Bytes of a word -> bytes of its ids (little-endian, 32 bits), by the library, with a memo of two generations.

    Words of printable ASCII and the accented letters of Latin-1 are cut here into the pieces that the tokenizer's pattern finds in them, and only
    the merges are the library's; a text that has no other words is cut whole, without a look at its words. Other words go through the library whole. A tokenizer that isn't declared as BY_WORDS encodes whole texts.
    """

    def __init__(self, spec: str, special_as_text: bool):
        import json
        import os
        import re

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        declared = json.loads(spec)
        self.by_words = {k: declared.get(k) for k in BY_WORDS} == BY_WORDS and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in declared["added_tokens"])
        self._tokenizer = Tokenizer.from_str(spec)
        self._tokenizer.encode_special_tokens = special_as_text
        self._old: dict[bytes, bytes] = {}
        # A word with "<" may hold a special token, so it goes through the library.
        self._plain = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ]+").fullmatch
        self._cut = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+").findall
        self._plain_text = re.compile(r"[!-;=-~À-ÖØ-öø-ÿ \t-\r]*").fullmatch
        self._cut_text = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ \t-\r]+").findall
        self._piece_ids = PieceEncoder(self._tokenizer.model).__getitem__

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        ids = self._old.get(word)
        if ids is None:
            text = word.decode()
            if len(word) > MEMO_BYTES:
                return self._whole(text)
            ids = b"".join(map(self._piece_ids, self._cut(text.lower()))) if self._plain(text) else self._whole(text)
        if len(self) >= MEMO_WORDS:
            self._old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def encode(self, text: bytes | None, end: bytes) -> np.ndarray:
        shown = (text or b"").decode()
        if not self.by_words:
            ids = self._whole(shown)
        elif self._plain_text(shown):
            ids = b"".join(map(self._piece_ids, self._cut_text(shown.lower())))
        else:
            ids = b"".join(map(self.__getitem__, text.split()))
        return np.frombuffer(ids + end, dtype="<u4")


def _encoder(spec: str, special_as_text: bool) -> WordEncoder:
    """The encoder of this worker process, which serves many tasks; the library's functions are shipped by value, so it is kept in a module made here."""
    import sys
    import types

    kept = sys.modules.setdefault("_encoders_of_worker", types.ModuleType("_encoders_of_worker"))
    key = (hash(spec), special_as_text)
    if getattr(kept, "key", None) != key:
        kept.key, kept.encoder = key, WordEncoder(spec, special_as_text)
    return kept.encoder


def write_ids(
    docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    shards: int | None = None, block_ids: int = BLOCK_IDS, bits: int = 8, special_as_text: bool = False,
) -> str:
    """Write the ids of all documents below folder (default: a new one in the shared folder) and return it.

    shards: files, by default as many as shuffle partitions; a file's documents must fit in a task. bits: 8 or 1, the width of a plane.
    """
    if bits not in (1, 8):
        raise ValueError("a plane has 1 or 8 bits")
    spark = docs.sparkSession
    folder = folder or new_folder(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    rows = keyed(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"), F.col(ROW).alias("place"))
    rows = rows.repartitionByRange(shards or int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id", "place").sortWithinPartitions("doc_id", "place")
    end = struct.pack("<I", end_id)

    def work(batches):
        encoder, out, doc_ids = _encoder(spec.value, special_as_text), ShardWriter(TaskContext.get().partitionId(), block_ids, bits), []
        for batch in slices(batches):
            if batch.num_rows:
                doc_ids.append(pa.concat_arrays([batch.column(0)]))
                for text in batch.column(1):
                    for record in out.add(encoder.encode(text.as_py(), end)):
                        yield pa.RecordBatch.from_pydict({"record": pa.array([record], pa.binary())})
        if doc_ids:
            for record in out.close(pa.concat_arrays(doc_ids)):
                yield pa.RecordBatch.from_pydict({"record": pa.array([record], pa.binary())})

    records = rows.select("doc_id", "text").mapInArrow(work, "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.text(f"{folder}/ids", lineSep="\n")
    _files(spark, folder).mapInArrow(_index_rows, INDEX).write.parquet(f"{folder}/index")
    return folder


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{folder}/ids").where("length > 0").select("path", "content")


INDEX = "shard int, path string, n_docs long, n_ids long, id_type string"


def _index_rows(batches):
    kinds = {pa.string(): "string", pa.int8(): "tinyint", pa.int16(): "smallint", pa.int32(): "int", pa.int64(): "bigint"}
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            shard = ShardReader(content.as_buffer())
            values = [shard.shard, path.as_py(), shard.docs.num_rows, shard.n_ids, kinds[shard.docs.schema.field("doc_id").type]]
            types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["shard", "path", "n_docs", "n_ids", "id_type"])


def index_of(spark: SparkSession, folder: str) -> DataFrame:
    """INDEX and first (place of the file's first id among all ids) of every file: one row a file."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    index = spark.read.schema(INDEX).parquet(f"{folder}/index")
    return index.withColumn("first", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _id_type(spark: SparkSession, folder: str) -> str:
    row = spark.read.schema(INDEX).parquet(f"{folder}/index").select("id_type").first()
    return row.id_type if row else "bigint"


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def work(batches):
        for batch in batches:
            for content in batch.column(1):
                shard = ShardReader(content.as_buffer())
                table, lengths = shard.docs, shard.docs.column("n_tokens").to_numpy()
                found = pa.table({
                    "shard": pa.array(np.full(len(lengths), shard.shard, dtype=np.int32)), "doc_id": table.column("doc_id"),
                    "offset": pa.array(np.cumsum(lengths) - lengths), "n_tokens": table.column("n_tokens"), "ids_crc32": pa.array(list(shard.checksums()), pa.int64()),
                })
                yield from found.combine_chunks().to_batches(max_chunksize=100_000)

    rows = _files(spark, folder).mapInArrow(work, f"shard int, doc_id {_id_type(spark, folder)}, offset long, n_tokens long, ids_crc32 long")
    first = broadcast_if_small(index_of(spark, folder).select("shard", "first"))
    return rows.join(first, "shard").select("doc_id", (F.col("first") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, ids (in order) of every document."""

    def work(batches):
        for batch in batches:
            for content in batch.column(1):
                shard = ShardReader(content.as_buffer())
                kind = shard.docs.schema.field("doc_id").type
                for doc, begin, n in shard.documents():
                    ids = np.concatenate([np.zeros(0, dtype="<u4"), *shard.ids(begin, begin + n)]).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([doc], kind), pa.array([ids], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return _files(spark, folder).mapInArrow(work, f"doc_id {_id_type(spark, folder)}, ids array<long>")


def read_range(spark: SparkSession, folder: str, begin: int, end: int) -> DataFrame:
    """place, id of the ids from place begin (inclusive) to end (exclusive) of all documents' ids; only files and blocks that hold them are decompressed."""
    held = index_of(spark, folder).where((F.col("first") < end) & (F.col("first") + F.col("n_ids") > begin)).select("path", "first").collect()
    if not held:
        return spark.createDataFrame([], "place long, id long")
    firsts = {r.path: r.first for r in held}

    def work(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                shard, first = ShardReader(content.as_buffer()), firsts[path.as_py()]
                at = max(0, begin - first)
                for ids in shard.ids(at, min(shard.n_ids, end - first)):
                    yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(ids)) + first + at), "id": pa.array(ids.astype(np.int64))})
                    at += len(ids)

    return spark.read.format("binaryFile").load(list(firsts)).select("path", "content").mapInArrow(work, "place long, id long")
