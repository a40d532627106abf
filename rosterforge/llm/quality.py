"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio of a trusted corpus against the raw one.

Features are hashed n-grams of two token streams: lower-cased words (n = 1) and word shapes (n = 2), where a shape maps runs of
capitals, small letters and digits to one sign each and keeps all other characters. Both multinomials are counted
over all documents (the trusted one over labelled documents, bounded by MAX_TRUSTED), smoothed by add-one. The score
is the mean log ratio per feature. The threshold is the cut of the labelled scores that best separates them (Youden's
index over 0.01-wide steps, ties to the lowest cut), so verdicts are the same in every run.

Defined cases: a null or blank text has no words, fails the base rules and scores 0; without labels of both kinds
the threshold is minus infinity (base rules decide alone); labels of repeated or unknown ids count once or not at all;
a document whose id is null is never trusted; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterforge.llm.common import SPACE_RUN, let, materialize, words_of

BUCKETS = 4096
#: Bound of the trusted sample whose ids are broadcast; beyond it ids are taken by hash order of their value.
MAX_TRUSTED = 50_000
NGRAM_WORDS = 5


def word_shapes(text: Column) -> Column:
    """The text with each run of capitals, small letters and digits replaced by A, a and 0."""
    lower = F.regexp_replace(text, r"\p{Ll}+", "a")
    return F.regexp_replace(F.regexp_replace(lower, r"\p{Lu}+", "A"), r"\p{Nd}+", "0")


def word_bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(F.lower(word)), F.lit(BUCKETS)).cast("int")


def bigram_bucket(first: Column, second: Column) -> Column:
    """Bucket of a pair of shapes, in its own range."""
    return F.pmod(F.xxhash64(first, second), F.lit(BUCKETS)).cast("int") + BUCKETS


def over_pairs(items: Column, f) -> Column:
    """f of each two neighbours of an array."""
    return let(items, lambda a: F.zip_with(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))), f))


def window_hashes(words: Column) -> Column:
    """Hashes of all five-word windows in order, built from those of two and four words."""

    def windows(h):
        from_k = lambda a, k: F.slice(a, k + 1, F.size(h) - NGRAM_WORDS + 1)
        two = F.zip_with(F.slice(h, 1, F.size(h) - 1), F.slice(h, 2, F.size(h) - 1), lambda x, y: F.xxhash64(x, y))
        four = let(two, lambda t: F.zip_with(from_k(t, 0), from_k(t, 2), lambda x, y: F.xxhash64(x, y)))
        return F.zip_with(four, from_k(h, NGRAM_WORDS - 1), lambda x, y: F.xxhash64(x, y))

    hashed = let(F.transform(words, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(words) > NGRAM_WORDS, hashed).otherwise(F.array().cast("array<bigint>"))


def repeat_words(g: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more in g, the window hashes of a text."""
    pairs = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))

    def of_sorted(s):
        same = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))
        hit = F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))
        starts = F.sort_array(F.transform(hit, lambda x: x["i"]))
        return let(
            starts,
            lambda p: F.aggregate(
                F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(NGRAM_WORDS)), F.lit(NGRAM_WORDS))),
                F.lit(0), lambda acc, x: acc + x),
        )

    return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(pairs, of_sorted))


def base_counts(docs: DataFrame, scorer, id_col: str, text_col: str) -> DataFrame:
    """doc_id, the base counts and whatever columns scorer(words, text) returns."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.col("words")
    lines = F.filter(F.split(F.col("text"), "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    dup_lines = let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a)))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), words_of(text).alias("words"))
    rows = rows.withColumn("windows", window_hashes(F.col("words")))
    return rows.select(
        "doc_id",
        F.size(words).cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
        repeat_words(F.col("windows")).cast("long").alias("n_repeat_words"),
        *scorer(words, F.col("text")),
    )


def ngram_counts(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """bucket, raw, target: occurrences over all documents and over the trusted ones."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).join(F.broadcast(trusted), "doc_id", "left")
    flag = F.coalesce("trusted", F.lit(0)).alias("trusted")
    words = rows.select(flag, F.explode(F.split("text", SPACE_RUN)).alias("w")).where("w <> ''")
    words = words.select("trusted", word_bucket(F.col("w")).alias("bucket"))
    shapes = rows.select(flag, F.explode(over_pairs(words_of(word_shapes(F.col("text"))), bigram_bucket)).alias("bucket"))
    every = words.unionByName(shapes)
    return every.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.sum("trusted").alias("target"))


def log_ratios(counts: DataFrame) -> list[float]:
    """Log ratio of every bucket; each of the two ranges of buckets is a multinomial of its own."""
    raw, target = [1.0] * (2 * BUCKETS), [1.0] * (2 * BUCKETS)
    for row in counts.collect():  # at most 2 * BUCKETS rows
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    out = []
    for part in range(2):
        a, b = part * BUCKETS, (part + 1) * BUCKETS
        total_raw, total_target = sum(raw[a:b]), sum(target[a:b])
        out += [math.log(target[i] / total_target) - math.log(raw[i] / total_raw) for i in range(a, b)]
    return out


def mean_ratio(ratios: list[float]):
    """Scorer column: the mean log ratio over a document's features."""
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")  # folded to a constant

    def score(words, text):
        plus = lambda acc, x: acc + x
        by_word = F.aggregate(words, F.lit(0.0), lambda acc, w: acc + F.get(table, word_bucket(w)))
        by_pair = over_pairs(words_of(word_shapes(text)), lambda x, y: F.get(table, bigram_bucket(x, y)))
        features = F.greatest(2 * F.size(words) - 1, F.lit(1))
        return [((by_word + F.aggregate(by_pair, F.lit(0.0), plus)) / features).alias("llr")]

    return score


def best_threshold(scored: DataFrame, labels: DataFrame) -> float:
    """The cut of the labelled scores with the largest (share of good at or over it) - (share of bad at or over it)."""
    step = F.floor(F.col("llr") * 100).cast("long").alias("step")
    known = scored.where("NOT base_failed").join(labels.select("doc_id", "quality"), "doc_id")
    rows = known.groupBy(step).agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")).orderBy("step").collect()
    good, bad = sum(r["good"] for r in rows), sum(r["bad"] for r in rows)
    if not good or not bad:
        return -math.inf
    best, cut, over_good, over_bad = -math.inf, -math.inf, good, bad
    for r in rows:
        if (value := over_good / good - over_bad / bad) > best + 1e-12:
            best, cut = value, r["step"] / 100.0
        over_good, over_bad = over_good - r["good"], over_bad - r["bad"]
    return cut


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float | None = None) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr.

    labels: doc_id, quality (1 trusted, 0 not).
    """
    known = materialize(
        labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    )
    good = known.where("quality = 1")
    share = min(1.0, MAX_TRUSTED / max(1, good.count()))
    picked = good.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    trusted = picked.select("doc_id", F.lit(1).alias("trusted"))
    ratios = log_ratios(ngram_counts(docs, trusted, id_col, text_col))
    counted = base_counts(docs, mean_ratio(ratios), id_col, text_col)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    scored = materialize(counted.withColumn("base_failed", failed))
    cut = best_threshold(scored, known) if threshold is None else threshold
    kept = ~F.col("base_failed") & (F.lit(True) if cut == -math.inf else F.col("llr") >= cut)
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "llr"
    )
