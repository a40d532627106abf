"""Scalar expressions of the domain: time normalisation, scores, tiers and text keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MS_FLOOR = 1_000_000_000_000


def epoch_seconds(value: Column) -> Column:
    """Seconds of an epoch value that may be in milliseconds (from 10^12 on) or already in seconds."""
    return F.when(value >= MS_FLOOR, F.floor(value / 1000)).otherwise(value).cast("long")


def match_time(finished: Column, created: Column, started: Column) -> Column:
    return F.coalesce(epoch_seconds(finished), epoch_seconds(created), epoch_seconds(started))


def clamp01(x: Column, default: float = 0.0) -> Column:
    return F.when(x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf")), F.lit(default)).otherwise(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def stability(top_share: Column, entropy: Column) -> Column:
    return 0.60 * top_share + 0.40 * (1.0 - entropy)


def volatility(entropy: Column, top_share: Column, distinct: Column, lineups: Column) -> Column:
    return 0.45 * entropy + 0.35 * (1.0 - top_share) + 0.20 * F.least(F.lit(1.0), distinct / F.greatest(lineups, F.lit(1)))


def recency(event_ms: Column, newest_ms: Column, half_life_days: float = 90.0) -> Column:
    """Exponential decay with age; 0.5 where the time is unknown."""
    age = F.greatest(newest_ms - event_ms, F.lit(0)) / 86_400_000.0
    return F.when(event_ms.isNull() | (event_ms <= 0), F.lit(0.5)).otherwise(F.exp(-0.693 * age / half_life_days))


def rivalry(matches: Column, win_rate: Column) -> Column:
    close = 1.0 - 2.0 * F.abs(win_rate - 0.5)
    return matches * (0.4 + 0.6 * close)


#: Upper bounds of the tournament tiers (fixed values); scores above the last bound stay in the last tier.
TIERS = ((5, "X"), (10, "S+"), (20, "S"), (40, "A+"), (80, "A"), (160, "A-"))


def tier(score: Column) -> Column:
    out = F.when(score.isNull() | F.isnan(score), F.lit("Unscored"))
    for bound, name in TIERS:
        out = out.when(score <= bound, F.lit(name))
    return out.otherwise(F.lit(TIERS[-1][1]))


def stability_hint(size: Column) -> Column:
    return F.when(size >= 8, "stable").when(size >= 4, "rotational").otherwise("small")


def alnum_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def family_key(name: Column) -> Column:
    """Bucket of spellings of one name: bracketed text dropped, other signs to spaces."""
    bare = F.regexp_replace(F.lower(name), r"\([^)]*\)|\[[^\]]*\]|\{[^}]*\}", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


def qualifier_penalty(name: Column) -> Column:
    bracketed = F.when(name.rlike(r"[\(\[\{]"), 2).otherwise(0)
    return bracketed + F.when(name.rlike(r"\s[-:/|]\s"), 1).otherwise(0)


def casing_penalty(name: Column) -> Column:
    letters = F.regexp_replace(name, "[^A-Za-z]", "")
    return F.when((F.length(letters) >= 4) & (letters == F.upper(letters)), 1).otherwise(0)


def trigrams(text: Column) -> Column:
    """Distinct trigrams of all words, each padded by two spaces in front and one behind."""
    grams = F.transform(tokens(text), lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams over all trigrams of two trigram sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def allowed_substitutions(n: Column) -> Column:
    return F.when(n <= 4, 1).otherwise((1 + F.floor((n - 4) / 3)).cast("int"))


def near_match(a: Column, b: Column) -> Column:
    """Whether two lineups (arrays) differ by no more substitutions than their sizes allow."""
    na, nb = F.size(a), F.size(b)
    shared = F.size(F.array_intersect(a, b))
    small, delta = F.least(na, nb), F.abs(na - nb)
    subs = allowed_substitutions(small)
    return (
        (small >= 3) & (delta <= 2) & (na + nb - 2 * shared <= 2 * subs + F.least(delta, F.lit(1)))
        & (shared >= F.greatest(F.lit(3), small - subs))
    )
