"""An inverted index of names by trigrams, and the searches that read only the postings of their own trigrams.

Postings (trigram -> id, name, number of the name's trigrams, weight) lie in folders by bucket of the trigram. A similarity search reads its own
trigrams' folders, keeps names whose number of trigrams can reach the threshold, and counts what they share. A search for a contained text or a
beginning reads the postings of its rarest trigram and looks at these names only. The largest rows are kept apart for the last resort of the
target search, which is the chain of names (exact, by id, same letters and digits, contained), similar names, and words of the largest teams.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterforge.functions.scalars import alnum_key, tokens, trigrams
from rosterforge.operators.text import TRIGRAM_THRESHOLD

BUCKETS = 64
#: The largest limit of a search, and how many times it the last resort looks at.
MAX_LIMIT, LAST_RESORT = 200, 10
_NAME = "id long, name string, weight long"
SCHEMAS = {"postings": f"{_NAME}, grams int, gram string, bucket int", "counts": "gram string, names long, bucket int", "keys": f"{_NAME}, key string, bucket int", "ids": _NAME, "largest": _NAME}


def bucket_of(value):
    return F.pmod(F.xxhash64(value), F.lit(BUCKETS)).cast("int")


def text_grams(text: str, begins: bool = False) -> list[str]:
    """Trigrams that every name holds in which text stands (begins: with which it starts): word ends count where text shows them."""
    found = []
    for m in re.finditer("[a-z0-9]+", text):
        left = "  " if m.start() > 0 or begins else ""
        padded = left + m[0] + (" " if m.end() < len(text) else "")
        found += [padded[i : i + 3] for i in range(len(padded) - 2)]
    return list(dict.fromkeys(found))


def query_grams(text: str) -> list[str]:
    return list(dict.fromkeys(p[i : i + 3] for w in re.findall("[a-z0-9]+", text) for p in [f"  {w} "] for i in range(len(p) - 2)))


def build(names: DataFrame, folder: str) -> NameIndex:
    """Write the index of names (id, name, weight) below folder."""
    rows = names.select("id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("weight", F.lit(0)).cast("long").alias("weight"))
    grams = trigrams(F.col("name"))
    each = rows.select("*", F.size(grams).alias("grams"), F.explode(grams).alias("gram")).withColumn("bucket", bucket_of(F.col("gram")))
    each.repartition("bucket", F.pmod(F.xxhash64("gram", "id"), F.lit(4))).sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/postings")
    index = NameIndex(names.sparkSession, folder)
    index.postings().groupBy("bucket", "gram").agg(F.count(F.lit(1)).alias("names")).repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/counts")
    keyed = rows.withColumn("key", alnum_key(F.col("name"))).withColumn("bucket", bucket_of(F.col("key")))
    keyed.repartition("bucket").sortWithinPartitions("bucket", "key").write.partitionBy("bucket").parquet(f"{folder}/keys")
    rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{folder}/ids")
    rows.orderBy(F.desc("weight"), "id").limit(MAX_LIMIT * LAST_RESORT).write.parquet(f"{folder}/largest")
    return index


class NameIndex:
    """A written index."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[table]).parquet(f"{self.folder}/{table}")

    def postings(self) -> DataFrame:
        return self._read("postings")

    def _of(self, table: str, column: str, values: list[str]) -> DataFrame:
        """Rows of a table in folders by bucket with one of the values: other folders are not read."""
        folders = [r.b for r in self.spark.createDataFrame([(v,) for v in values], "v string").select(bucket_of(F.col("v")).alias("b")).distinct().collect()]
        return self._read(table).where(F.col("bucket").isin(folders) & F.col(column).isin(values))

    def holding(self, text: str, begins: bool = False) -> DataFrame:
        """id, name, weight of names (lower case) that contain text, or begin with it."""
        fits = F.lower("name").startswith(text) if begins else F.lower("name").contains(text)
        grams = text_grams(text, begins)
        if not grams:  # too short for a trigram
            return self._read("ids").where(fits).select("id", "name", "weight")
        known = self._of("counts", "gram", grams).select("gram", "names").collect()  # a row a trigram of the text
        if len(known) < len(grams):
            return self._read("ids").where("false").select("id", "name", "weight")
        rarest = min(known, key=lambda r: (r.names, r.gram)).gram
        return self._of("postings", "gram", [rarest]).where(fits).select("id", "name", "weight")

    def similar(self, text: str, threshold: float = TRIGRAM_THRESHOLD) -> DataFrame:
        """id, name, weight, similarity of names whose trigrams are like those of text; threshold is over 0."""
        grams = query_grams(text)
        if not grams:
            return self._read("ids").where("false").select("id", "name", "weight", F.lit(0.0).alias("similarity"))
        n = len(grams)
        # Names of fewer or more trigrams can't reach the threshold whatever they share.
        near = self._of("postings", "gram", grams).where(F.col("grams").between(math.ceil(threshold * n - 1e-9), math.floor(n / threshold + 1e-9)))
        per = near.groupBy("id", "name", "weight", "grams").agg(F.count(F.lit(1)).alias("shared"))
        return per.withColumn("similarity", F.col("shared") / (n + F.col("grams") - F.col("shared"))).where(F.col("similarity") >= threshold).select("id", "name", "weight", "similarity")

    def named(self, text: str) -> DataFrame:
        """id, name, weight, priority: 0 the very name, 1 the id, 2 same letters and digits, 3 contained."""
        key = re.sub("[^a-z0-9]+", "", text)
        parts = [self.holding(text)]
        if key:
            parts.append(self._of("keys", "key", [key]).select("id", "name", "weight"))
        if text.isdecimal() and text.isascii():
            parts.append(self._read("ids").where(F.col("id") == int(text)).select("id", "name", "weight"))
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        same = alnum_key(F.col("name")) == key
        priority = F.when(F.lower("name") == text, 0).when(F.col("id").cast("string") == text, 1).when(same, 2).otherwise(3)
        return rows.distinct().withColumn("priority", priority)

    def of_largest(self, text: str, limit: int) -> DataFrame:
        """id, name, weight among the largest: a short text equals a word of the name, a longer one is contained in its letters and digits."""
        key = re.sub("[^a-z0-9]+", "", text)
        top = self._read("largest").orderBy(F.desc("weight"), "id").limit(LAST_RESORT * limit)
        hit = F.lit(False) if not key else F.array_contains(tokens(F.col("name")), key) if len(key) <= 4 else alnum_key(F.col("name")).contains(key)
        return top.where(hit)

    def targets(self, text: str, limit: int = 25) -> DataFrame:
        """place, id, name, stage (0 named, 1 similar, 2 word of a large one): the rows of the first stage that finds any, in its order."""
        text, limit = text.strip().lower(), max(1, min(limit, MAX_LIMIT))
        last = F.lit(None).cast("double")
        found = self.named(text).select("id", "name", "weight", F.lit(0).alias("stage"), F.col("priority").cast("double").alias("order")) if text else None
        if found is None:
            return self._read("ids").where("false").select(F.lit(0).alias("place"), "id", "name", F.lit(0).alias("stage"))
        if len(text) >= 2:
            found = found.unionByName(self.similar(text).select("id", "name", "weight", F.lit(1).alias("stage"), (-F.col("similarity")).alias("order")))
        found = found.unionByName(self.of_largest(text, limit).select("id", "name", "weight", F.lit(2).alias("stage"), last.alias("order")))
        return _placed(found, limit, first_stage=True)

    def suggestions(self, text: str, limit: int = 10) -> DataFrame:
        """place, id, name, weight, stage: names that begin with text, largest first, and behind them as many similar ones as the limit leaves."""
        text, limit = text.strip().lower(), max(1, min(limit, 50))
        if not text:
            return self._read("ids").where("false").select(F.lit(0).alias("place"), "id", "name", "weight", F.lit(0).alias("stage"))
        found = self.holding(text, begins=True).select("id", "name", "weight", F.lit(0).alias("stage"), F.lit(0.0).alias("order"))
        if len(text) >= 2:
            like = self.similar(text).where(~F.lower("name").startswith(text))
            found = found.unionByName(like.select("id", "name", "weight", F.lit(1).alias("stage"), (-F.col("similarity")).alias("order")))
        return _placed(found, limit, first_stage=False)


def _placed(found: DataFrame, limit: int, first_stage: bool) -> DataFrame:
    """The first rows by stage, order, weight and id, with their place; first_stage: of the first stage that has any."""
    order = [F.col("stage"), F.col("order"), F.desc("weight"), F.col("id")]
    top = found.orderBy(*order).limit(limit)  # rows of later stages are behind all of earlier ones
    rows = F.array_sort(F.collect_list(F.struct("stage", "order", (-F.col("weight")).alias("w"), "id", "name")))
    listed = top.agg(rows.alias("rows"))  # limit rows at most
    kept = F.filter("rows", lambda r: r["stage"] == F.col("rows")[0]["stage"]) if first_stage else F.col("rows")
    out = listed.select(F.posexplode(kept).alias("at", "r")).select((F.col("at") + 1).alias("place"), "r.id", "r.name", (-F.col("r.w")).alias("weight"), "r.stage")
    return out.drop("weight") if first_stage else out
