"""Corpus pipeline: language ID, exact dedup, near dedup, mixing to target weights, BPE encoding.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents. SQL can't express the pipeline (language ID, SimHash and BPE are not SQL), so it
has no oracle; tests/llm compares it with a brute-force version.

Defined cases, for every stage: rows are told apart by their place in the table, not by their id, so null and repeated ids lose or add no
row. A null, empty or letterless text goes in the first stage; of equal texts, and of near copies, the row with the smallest
id stays (null ids last; of those that repeat it one row, chosen by the content of all its columns); the mix decides each row by itself, those that share an id too; the last stage gives one row for
each row it gets. Texts of any length are read whole; an empty table passes through every stage; other columns are
carried along by all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rosterforge.llm import bpe, exact_dedup, langid, mixing, simhash
from rosterforge.llm.common import materialize, smaller_batches, table, table_rows, without_rows

RANKS = "byte_bpe_multi_50k.tiktoken"


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found; texts without a letter (`und`) go."""
    rows = table_rows(docs)
    return without_rows(rows, langid.identify(rows).where("lang_pred = 'und'")).select(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.deduplicate(table_rows(docs, by_content=True)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard similarity of 0.8 or more."""
    return simhash.keep_representatives(table_rows(docs, by_content=True), shingle=5, similarity=0.8).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(table_rows(docs, by_content=True))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, with digests of the ids and of the bytes decoded from them."""
    ranks = public_tokenizers.path(RANKS)
    return bpe.digests(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mix_sources", mix_sources),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    smaller_batches(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs


ORACLE_SQL = None
