"""Source divergence audit: how far each source of a language departs from the language and from its other sources.

Terms are counted once, task by task, into (lang, source, term, occurrences, documents); the sums meet by (lang, term), where the terms of at least
MIN_DOCS documents of the language are kept. The kept rows are dealt by range of (lang, term), and neighbouring ranges of CHUNK_ROWS rows are one chunk of the language's integer
dictionary: its kept terms as a sorted array in UTF-8 order, ids by binary search in it, and a count vector per group by bincount. Order of
ids is order of terms, so ties need no look at the texts. Each chunk gets its language's groups (source, total of its counts, number of kept terms) as rows ahead of its
counts, and works out every group's dense vector of smoothed shares block by block, the sums of differences of all pairs of sources,
and each group's first TOP terms. Sums and firsts of the chunks are put together at the end. Nothing but the groups of one language is held whole by a
task, and nothing is broadcast or sent to the driver. All arithmetic is on integers; shares are divided digit by digit, so that no product leaves 64 bits.

Defined cases: null text, lang and source count as empty; empty texts make their group occur, without terms; a language without kept terms gives its pairs
the value 0 and no terms; repeated rows and ids are rows like others (no id is read); a language of one source has no pairs; very long texts are
counted piece by piece; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterforge.llm.common import broadcast_if_small, materialize, slices

MIN_DOCS, TOP = 30, 50
#: Share of everything, and what is added to every count (fixed values of the audit).
UNIT, PRIOR = 1_000_000_000, 5
#: A task gives its counts away when it holds so many of them; a text is counted in pieces of so many bytes.
HELD_COUNTS, PIECE_BYTES = 300_000, 1 << 20
#: Cells of a chunk's dense block: groups of the language times terms.
BLOCK_CELLS = 1 << 20
#: Kept rows of a chunk at least; with very many sources as many as pairs of sources, so that what a chunk gives is less than what it gets.
CHUNK_ROWS = 1 << 16
#: Bytes of terms, in UTF-8: small letters stay, capitals become small, bytes of other letters stay, all else separates.
_SEPARATED = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def term_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, some at a time."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        piece = text[at:end].translate(_SEPARATED)
        if end < len(text):
            cut = piece.rfind(b" ")
            while cut < 0 and end < len(text):  # one term goes on
                end += PIECE_BYTES
                piece = text[at:end].translate(_SEPARATED)
                cut = piece.rfind(b" ")
            if end < len(text):
                piece = piece[:cut]
        yield piece.split()
        at += max(len(piece), 1)


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (counts + PRIOR) / total), exact while total is below 9e15."""
    whole, rest = np.divmod(counts + PRIOR, total)
    for _ in range(3):  # three digits at a time
        digits, rest = np.divmod(rest * 1000, total)
        whole = whole * 1000 + digits
    return 1 + whole


_COUNTS = pa.schema({"lang": pa.string(), "source": pa.string(), "term": pa.string(), "n": pa.int64(), "docs": pa.int64()})


def _count(batches):
    """Occurrences and documents of the terms of each group, summed over what the task has read since it last gave them away."""
    counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def given():
        for (lang, source), (n, docs) in counts.items():
            terms = pa.array(n.keys(), pa.binary()).cast(pa.string())
            columns = [pa.array([x] * len(n), pa.string()) for x in (lang, source)]
            yield pa.RecordBatch.from_arrays([*columns, terms, pa.array(n.values(), pa.int64()), pa.array(map(docs.__getitem__, n), pa.int64())], schema=_COUNTS)
        counts.clear()

    for batch in slices(batches):
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
            n, docs = counts.setdefault((lang, source), (Counter(), Counter()))
            found: set[bytes] = set()
            for terms in term_pieces(text):
                n.update(terms)
                found.update(terms)
            docs.update(found)
        if sum(len(n) for n, _ in counts.values()) > HELD_COUNTS:
            yield from given()
    yield from given()


_FOUND = pa.schema({"lang": pa.string(), "source": pa.string(), "part": pa.string(), "item": pa.string(), "value": pa.int64()})


def _found(lang: str, source: str, part: str, items: list[str], values: np.ndarray) -> pa.RecordBatch:
    fixed = [pa.array([x] * len(items), pa.string()) for x in (lang, source, part)]
    return pa.RecordBatch.from_arrays([*fixed, pa.array(items, pa.string()), pa.array(values, pa.int64())], schema=_FOUND)


class ChunkAudit:
    """The groups of a language and a chunk of its terms, block by block."""

    def __init__(self, lang: str, groups: list[tuple[str, int, int]], top: int):
        self.lang, self.top = lang, top
        self.sources = [source for source, _, _ in groups]
        self.place = {source: g for g, source in enumerate(self.sources)}
        totals, kept = np.array([n for _, n, _ in groups], dtype=np.int64), groups[0][2]
        self._below, self._below_lang = totals + PRIOR * kept, totals.sum() + PRIOR * kept
        self.block_terms = max(1, BLOCK_CELLS // len(groups))
        # Sums of pairs are held for the whole chunk where they fit into a block's memory, and given by block otherwise.
        self._held = np.zeros((len(groups), len(groups)), dtype=np.int64) if len(groups) ** 2 <= BLOCK_CELLS else None

    def block(self, terms: list[str], of: list[int], n: list[int]) -> Iterator[pa.RecordBatch]:
        """Rows of some terms, in order: a term's rows of all groups are in one block."""
        kept = np.array([t.encode() for t, _ in groupby(terms)], dtype=object)  # sorted, in UTF-8 order
        ids = np.searchsorted(kept, np.array([t.encode() for t in terms], dtype=object))
        size, width = len(kept), len(self.sources)
        cells = np.bincount(ids * width + np.array(of), weights=np.array(n, dtype=np.float64), minlength=size * width)
        counts = cells.astype(np.int64).reshape(size, width)  # one count a cell: exact below 2 ** 53
        p = shares(counts, self._below)
        over = p - shares(counts.sum(axis=1), self._below_lang)[:, None]
        for g, source in enumerate(self.sources):
            sums = np.abs(p[:, g + 1 :] - p[:, g : g + 1]).sum(axis=0)
            if self._held is not None:
                self._held[g, g + 1 :] += sums
            elif len(sums):
                yield _found(self.lang, source, "pair", self.sources[g + 1 :], sums)
            first = np.flatnonzero((counts[:, g] > 0) & (over[:, g] > 0))
            first = first[np.lexsort((first, -over[first, g]))][: self.top]  # ids break ties as terms do
            if len(first):
                yield _found(self.lang, source, "term", [t.decode() for t in kept[first]], over[first, g])

    def close(self) -> Iterator[pa.RecordBatch]:
        for g, source in enumerate(self.sources[:-1]):
            sums = np.zeros(len(self.sources) - g - 1, dtype=np.int64) if self._held is None else self._held[g, g + 1 :]
            yield _found(self.lang, source, "pair", self.sources[g + 1 :], sums)


def _chunks(top: int):
    """Rows (lang, chunk, term, source, n, kept) of whole chunks; the rows of groups (term null) stand ahead of a chunk's counts."""

    def audit(batches):
        stream = (row for batch in slices(batches, 10_000) for row in zip(*(c.to_pylist() for c in batch.columns)))
        for (lang, _), rows in groupby(stream, key=lambda r: r[:2]):
            groups, chunk = [], None
            terms, of, n, distinct = [], [], [], 0
            for _, _, term, source, count, kept in rows:
                if term is None:
                    groups.append((source, count, kept))
                    continue
                chunk = chunk or ChunkAudit(lang, groups, top)
                if not terms or terms[-1] != term:
                    if distinct == chunk.block_terms:
                        yield from chunk.block(terms, of, n)
                        terms, of, n, distinct = [], [], [], 0
                    distinct += 1
                terms.append(term)
                of.append(chunk.place[source])
                n.append(count)
            chunk = chunk or ChunkAudit(lang, groups, top)
            if terms:
                yield from chunk.block(terms, of, n)
            yield from chunk.close()

    return audit


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: `pair` rows hold the distance to each other source, `term` rows the first terms over the language's share."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]
    texts = docs.select(*named, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    of_term = Window.partitionBy("lang", "term")
    counted = (
        texts.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        .repartition("lang", "term")  # sums and windows below go on in these partitions
        .groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .withColumn("docs", F.sum("docs").over(of_term)).withColumn("first", F.min("source").over(of_term) == F.col("source"))
        .where(F.col("docs") >= min_docs).select("lang", "term", "source", "n", "first")
    )
    ranges = materialize(materialize(counted).repartitionByRange("lang", "term").withColumn("range", F.spark_partition_id()))
    sources = texts.select("lang", "source").distinct()
    most = sources.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    # One row a range: a chunk is full when its rows are as many as they should be.
    ahead = F.sum("n").over(Window.orderBy("range")) - F.col("n")
    chunk_of = ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).select("range", F.floor(ahead / max(CHUNK_ROWS, most * most)).cast("int").alias("chunk"))
    kept = ranges.join(broadcast_if_small(materialize(chunk_of)), "range").drop("range")
    groups = (
        sources
        .join(kept.groupBy("lang", "source").agg(F.sum("n").alias("n")), ["lang", "source"], "left")
        .join(kept.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("kept")), "lang", "left")
        .select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("kept", F.lit(0)).alias("kept"))
    )
    groups = materialize(groups)
    chunks = kept.select("lang", "chunk").distinct().unionByName(groups.select("lang").distinct().withColumn("chunk", F.lit(-1)))
    heads = groups.join(chunks, "lang").select("lang", "chunk", F.lit(None).cast("string").alias("term"), "source", "n", "kept")
    rows = heads.unionByName(kept.select("lang", "chunk", "term", "source", "n", F.lit(0).cast("long").alias("kept")))
    rows = rows.repartition("lang", "chunk").sortWithinPartitions("lang", "chunk", F.col("term").asc_nulls_first(), "source")
    found = rows.mapInArrow(_chunks(top), "lang string, source string, part string, item string, value long")
    found = materialize(found.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")))
    other = F.when(F.col("part") == "pair", F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    both = found.withColumn("way", F.explode(F.coalesce(other, F.array(F.struct("source", "item"))))).select("lang", "way.source", "part", "way.item", "value")
    ranked = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item")
    return both.withColumn("rank", F.row_number().over(ranked)).where((F.col("part") == "pair") | (F.col("rank") <= top))
