"""Substring deduplication: words covered by windows that start in an earlier document go.

A log-structured fingerprint index holds sorted immutable runs, one for each batch of documents: (anchor, doc_id, row) for each sampled window
hash of a document. Windows are sampled by minimizers: of the GRAM-word hashes inside a window of WINDOW words the smallest is its
anchor, so equal windows have equal anchors and about one word in fifteen is stored. A run is dealt into buckets by anchor and sorted inside them,
so that a new batch, dealt alike, is merge-joined with every run without moving or sorting the run again. Anchors that another document has, too, are
shared. Only documents with shared anchors are read again: the whole windows under these anchors are hashed in full (64 bits, verified
against a second independent 64 bits; where those differ, both are the key), and each is judged by the smallest doc_id that has it.
Runs are compacted into one when there are FAN_OUT of them. The registered query takes the table in BATCHES batches, by ranges of doc_id.

Documents that repeat an earlier one word by word are settled by their digest and enter no run.

Defined cases: a null text has no words; documents under 50 words lose nothing; rows are told apart by ROW, so rows that repeat an id
are one document each and none is smaller than the other; null ids neither lose words nor take any; texts are read whole; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterforge.llm.common import ROW, broadcast_if_small, keyed, materialize, remove_tree, shared_dir

WINDOW, GRAM = 50, 20
FAN_OUT = 4
BATCHES = 5
VOCABULARY = 300_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MASK = (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at ASCII white space only


class WindowHasher:
    """Hashes of all runs of k words, by sums of word hashes times powers of an odd base."""

    def __init__(self):
        self._words: dict[bytes, int] = {}
        self._powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        known = self._words
        if len(known) > VOCABULARY:
            known.clear()
        out = np.empty(len(words), dtype=np.uint64)
        digest, get = xxhash.xxh64_intdigest, known.get
        for i, w in enumerate(words):
            h = get(w)
            if h is None:
                h = known[w] = digest(w, 11)
            out[i] = h
        return out

    def _table(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = self._powers.get(base)
        if have is None or len(have[0]) < n:
            size = max(4096, 1 << (n - 1).bit_length())
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                steps = np.full(size, b, dtype=np.uint64)
                steps[0] = 1
                both.append(np.multiply.accumulate(steps))
            have = self._powers[base] = (both[0], both[1])
        return have

    def windows(self, h: np.ndarray, k: int, base: int) -> np.ndarray:
        n = len(h)
        if n < k:
            return np.zeros(0, dtype=np.uint64)
        powers, inverse = self._table(base, n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(h * powers[:n], out=sums[1:])
        x = (sums[k:] - sums[:-k]) * inverse[: n - k + 1]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x

    def anchors(self, h: np.ndarray) -> np.ndarray:
        """The anchor of every window: the smallest gram hash inside it."""
        grams = self.windows(h, GRAM, BASES[0])
        width = WINDOW - GRAM + 1
        if len(grams) < width:
            return np.zeros(0, dtype=np.uint64)
        low, span = grams, 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        return np.minimum(low[: len(grams) - width + 1], low[width - span :])


def _list(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _signature(docs: DataFrame) -> DataFrame:
    """ROW, doc_id, n_words, digest (SHA-256 of the words), anchors (distinct) of every document."""

    def work(batches):
        hasher = WindowHasher()
        for batch in batches:
            counts, digests, anchors = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                counts.append(len(words))
                digests.append(hashlib.sha256(b" ".join(words)).digest())
                anchors.append(np.unique(hasher.anchors(hasher.word_hashes(words))) if len(words) >= WINDOW else np.zeros(0, dtype=np.uint64))
            yield pa.RecordBatch.from_pydict({
                ROW: batch.column(ROW), "doc_id": batch.column("doc_id"), "n_words": pa.array(counts, type=pa.int64()),
                "digest": pa.array(digests, type=pa.binary()), "anchors": _list(anchors),
            })

    added = [T.StructField("n_words", T.LongType()), T.StructField("digest", T.BinaryType()), T.StructField("anchors", T.ArrayType(T.LongType()))]
    return docs.mapInArrow(work, T.StructType([*docs.select(ROW, "doc_id").schema, *added]))


def _full_windows(rows: DataFrame) -> DataFrame:
    """ROW, doc_id, mine, h1, h2 of the windows of rows (ROW, doc_id, mine, text, shared) whose anchor is in shared."""

    def work(batches):
        hasher = WindowHasher()
        for batch in batches:
            for i, (text, shared) in enumerate(zip(batch.column("text"), batch.column("shared"), strict=True)):
                h = hasher.word_hashes(words_of(text.as_py()))
                at = np.flatnonzero(np.isin(hasher.anchors(h), shared.values.to_numpy().view(np.uint64)))
                if not len(at):
                    continue
                first = hasher.windows(h, WINDOW, BASES[0])[at]
                second = hasher.windows(h, WINDOW, BASES[1])[at]
                _, one = np.unique(first, return_index=True)
                same = pa.array([i] * len(one))
                yield pa.RecordBatch.from_pydict({
                    **{c: batch.column(c).take(same) for c in (ROW, "doc_id", "mine")},
                    "h1": pa.array(first[one].view(np.int64)), "h2": pa.array(second[one].view(np.int64)),
                })

    added = [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())]
    return rows.mapInArrow(work, T.StructType([*rows.select(ROW, "doc_id", "mine").schema, *added]))


def covered_words(n: int, starts: np.ndarray) -> np.ndarray:
    """Which of n words lie in a window that starts at one of starts."""
    edge = np.zeros(n + 1, dtype=np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def _removal(rows: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of rows (doc_id, text, repeated: hashes of repeated windows)."""

    def work(batches):
        hasher = WindowHasher()
        for batch in batches:
            counts, removed, digests = [], [], []
            for text, repeated in zip(batch.column("text"), batch.column("repeated"), strict=True):
                words = words_of(text.as_py())
                windows = hasher.windows(hasher.word_hashes(words), WINDOW, BASES[0])
                starts = np.flatnonzero(np.isin(windows, repeated.values.to_numpy().view(np.uint64)))
                gone = covered_words(len(words), starts)
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                counts.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array(counts, type=pa.int64()),
                "n_removed": pa.array(removed, type=pa.int64()), "kept_sha256": pa.array(digests, type=pa.string()),
            })

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string")


class FingerprintLog:
    """Sorted immutable runs (tables of anchor, doc_id, ROW, in buckets by anchor), and the digests of whole documents (digest, first_id)."""

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path = spark, path or f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: list[str] = []
        self.digests: DataFrame | None = None

    def _write(self, rows: DataFrame) -> str:
        name = f"fingerprints_{uuid.uuid4().hex}"
        dealt = rows.repartition(self.buckets, "anchor").sortWithinPartitions("anchor")
        dealt.write.bucketBy(self.buckets, "anchor").sortBy("anchor").option("path", f"{self.path}/{name}").format("parquet").saveAsTable(name)
        return name

    def append(self, signatures: DataFrame) -> DataFrame:
        """Write the run of a batch; returns it."""
        self.runs.append(self._write(signatures.select(F.explode("anchors").alias("anchor"), "doc_id", ROW)))
        return self.spark.table(self.runs[-1])

    def hits(self) -> DataFrame:
        """anchor, doc_id, ROW of the newest run and of older ones, for the anchors that the newest run shares with another document.

        The newest run is merge-joined with each older one; all are dealt and sorted alike.
        """
        *older, newest = (self.spark.table(name) for name in self.runs)
        anchors = newest.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
        found = [newest.join(anchors.where("n > 1").hint("merge"), "anchor", "left_semi")]
        for run in older:
            found += [newest.join(run.hint("merge"), "anchor", "left_semi"), run.join(anchors.hint("merge"), "anchor", "left_semi")]
        out = found[0]
        for rows in found[1:]:
            out = out.unionByName(rows)
        return out

    def compact(self) -> None:
        if len(self.runs) >= FAN_OUT:
            old = self.runs
            merged = self.spark.table(old[0])
            for name in old[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self.runs = [self._write(merged)]
            self._drop(old)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            remove_tree(self.spark, f"{self.path}/{name}")

    def close(self) -> None:
        """Drop all runs."""
        self._drop(self.runs)
        self.runs = []


def ingest(log: FingerprintLog, docs: DataFrame, history: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Judge docs against themselves and history (all batches already in log), and add them to log.

    One row per row of docs: doc_id, n_words, n_removed, kept_sha256. Both docs and history have ROW, or only docs is given.
    """
    plain = lambda d, mine: d.select(ROW, F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(mine).alias("mine"))
    batch = plain(keyed(docs), True)
    texts = batch if history is None else batch.unionByName(plain(history, False))
    signed = materialize(_signature(batch))

    # A document equal to an earlier one, word by word, is wholly repeated: only the first of each digest goes on.
    whole = signed.where(f"n_words >= {WINDOW} AND doc_id IS NOT NULL")
    firsts = whole.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    if log.digests is not None:
        known = log.digests.withColumn("n", F.lit(1).cast("long"))
        firsts = firsts.unionByName(known).groupBy("digest").agg(F.min("first_id").alias("first_id"), F.sum("n").alias("n"))
    firsts = materialize(firsts)
    log.digests = firsts.select("digest", "first_id")
    judged = signed.join(broadcast_if_small(firsts.where("n > 1")), "digest", "left")
    is_copy = F.coalesce((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= WINDOW), F.lit(False))
    judged = materialize(judged.withColumn("is_copy", is_copy).drop("first_id", "n"))

    log.append(judged.where("NOT is_copy AND doc_id IS NOT NULL"))
    affected = materialize(log.hits().groupBy(ROW).agg(F.collect_set("anchor").alias("shared")))
    candidates = materialize(_full_windows(_with_texts(texts, affected, "shared")))
    first = candidates.groupBy("h1").agg(
        F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.min("h2").alias("a"), F.max("h2").alias("b")
    ).where("first_id < last_id")
    first = materialize(first)
    mine = candidates.where("mine")
    clean = first.where("a = b").select("h1", "first_id")
    repeated = mine.join(broadcast_if_small(clean), "h1").where("doc_id > first_id").select(ROW, "h1")
    clashing = first.where("a <> b").select("h1")
    if not clashing.isEmpty():  # equal in one hash only: both hashes are the key
        inside = candidates.join(broadcast_if_small(clashing), "h1", "left_semi")
        exact = inside.groupBy("h1", "h2").agg(F.min("doc_id").alias("first_id"))
        again = mine.join(broadcast_if_small(materialize(exact)), ["h1", "h2"])
        repeated = repeated.unionByName(again.where("doc_id > first_id").select(ROW, "h1"))
    lists = materialize(repeated.groupBy(ROW).agg(F.collect_set("h1").alias("repeated")))
    removed = _removal(_with_texts(batch, lists, "repeated"))
    rest = judged.join(broadcast_if_small(lists.select(ROW)), ROW, "left_anti")
    empty = hashlib.sha256(b"").hexdigest()
    rest = rest.select(
        "doc_id", "n_words", F.when(F.col("is_copy"), F.col("n_words")).otherwise(0).cast("long").alias("n_removed"),
        F.when(F.col("is_copy"), empty).otherwise(F.lower(F.hex("digest"))).alias("kept_sha256"),
    )
    log.compact()
    return rest.unionByName(removed)


def _with_texts(texts: DataFrame, lists: DataFrame, name: str) -> DataFrame:
    """texts and the list of the rows that have one; only their texts are shuffled where the rows are few."""
    wanted = texts.join(broadcast_if_small(lists.select(ROW)), ROW, "left_semi")
    return wanted.join(lists.hint("merge"), ROW)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """The rows of docs through a log of its own, in batches by ranges of the id (null ids in the first; ids that are no numbers make one batch).

    As smaller ids come first, the batches are judged as one table would be.

    doc_id, n_words, n_removed, kept_sha256.
    """
    rows = keyed(docs)
    ident = F.col(id_col)
    edges: list = []
    if batches > 1 and isinstance(rows.schema[id_col].dataType, T.NumericType):
        at = [k / batches for k in range(1, batches)]
        edges = sorted(set(rows.select(F.percentile_approx(ident, at, 1000)).first()[0] or []))
    log, out, history = FingerprintLog(rows.sparkSession), None, None
    for k in range(len(edges) + 1):
        inside = F.lit(True)
        if k > 0:
            inside &= ident > edges[k - 1]
        if k < len(edges):
            inside &= ident <= edges[k]
        batch = rows.where(inside | ident.isNull() if k == 0 else inside)
        found = ingest(log, batch, history, id_col, text_col)
        out = found if out is None else out.unionByName(found)
        history = rows.where(ident <= edges[k]) if k < len(edges) else None
    log.close()
    return out
