"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts of up to ORDER bytes with counts; an unseen byte escapes to the next shorter context
with probability d / (n + d) (n occurrences, d different bytes), at last to the uniform distribution over 256. With
frozen counts the code length of a byte after a context is a constant, so each tree is compiled into a table of (context, byte) -> bits and two steps
that lead from the last three bytes to the longest known context; a text's code length is a sum of look-ups over all of its
bytes. The shortest code wins.

The trees are fitted on a bounded sample of labelled documents: at most about MAX_DOCS documents and MAX_BYTES bytes
a language, chosen by hash of the id, and one document at least, however long it is. Every language with a label and every context of the sample is kept; a language is compiled in one task,
and its tables are as large as the contexts of its sample ask for.

Defined cases: a null text, or one without any letter, is `und` with score 0; with nothing to learn from every
document is `und`; equal code lengths go to the first language in order; null ids are never held out and never learnt from
(crc32 of a null is null); repeated rows are learnt from and predicted one by one; texts of any length are scored whole; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterforge.llm.common import ROW, slices

ORDER = 3
MAX_DOCS, MAX_BYTES = 3_000, 6_000_000
#: Bytes that are scored at once.
BLOCK = 1 << 20


def held_out(ident: Column) -> Column:
    return F.pmod(F.crc32(ident.cast("string")), F.lit(3)) == 1


def _grams(data: bytes) -> np.ndarray:
    """Each byte with the three before it (zero bytes ahead of the text), as one number."""
    b = np.frombuffer(b"\0\0\0" + data, dtype=np.uint8).astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


def _count_batches(batches):
    """lang, gram, n of the texts of a partition."""
    sums: dict[str, dict[int, int]] = {}
    for batch in batches:
        pending: dict[str, list[np.ndarray]] = {}
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            pending.setdefault(lang, []).append(_grams(text.encode()))
        for lang, parts in pending.items():
            grams, counts = np.unique(np.concatenate(parts), return_counts=True)
            have = sums.setdefault(lang, {})
            for g, c in zip(grams.tolist(), counts.tolist(), strict=True):
                have[g] = have.get(g, 0) + c
    for lang, have in sums.items():
        yield pa.RecordBatch.from_pydict({
            "lang": pa.array([lang] * len(have), type=pa.string()),
            "gram": pa.array(list(have.keys()), type=pa.int64()),
            "n": pa.array(list(have.values()), type=pa.int64()),
        })


def fit(train: DataFrame) -> dict | None:
    """The compiled trees of train (doc_id, text, lang) by language, in order; None where there is nothing to learn from."""
    usable = train.where("text IS NOT NULL AND lang IS NOT NULL AND text <> ''")
    place = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1 << 20))
    per = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.octet_length("text")).alias("bytes"), F.min(place).alias("first"))
    # A row a language. The first document by place is always in: few long texts must not lose their language.
    ends = {r["lang"]: max(int(min(1.0, MAX_DOCS / r["docs"], MAX_BYTES / r["bytes"]) * (1 << 20)), r["first"] + 1) for r in per.collect()}
    if not ends:
        return None
    wanted = F.create_map(*(F.lit(x) for lang, end in ends.items() for x in (lang, end)))
    sample = usable.where(place < F.try_element_at(wanted, F.col("lang"))).select("text", "lang")
    counts = sample.mapInArrow(_count_batches, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    compiled = counts.groupBy("lang").applyInArrow(_compile_group, "lang string, tree binary").orderBy("lang").collect()
    return {r["lang"]: _unpacked(r["tree"]) for r in compiled} or None


def _compile_group(counts: pa.Table) -> pa.Table:
    tree = compile_tree(counts.column("gram").to_numpy(), counts.column("n").to_numpy().astype(np.float64))
    held = io.BytesIO()
    np.savez(held, **tree)
    return pa.table({"lang": counts.column("lang").slice(0, 1), "tree": pa.array([held.getvalue()], type=pa.binary())})


def _unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as held:
        return {k: held[k] for k in held.files}


def compile_tree(gram: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """symbol of a byte, steps from the last byte to the longest known context, and the bits of every (context, symbol)."""
    used = np.unique(np.concatenate([(gram >> s) & 255 for s in (24, 16, 8, 0)]))
    symbol = np.full(256, len(used), dtype=np.int32)  # bytes never seen share one symbol
    symbol[used] = np.arange(len(used))
    size = len(used) + 1
    third, second, last, coded = (symbol[(gram >> s) & 255].astype(np.int64) for s in (24, 16, 8, 0))

    def bits(context: np.ndarray, contexts: int, shorter: np.ndarray) -> np.ndarray:
        table = np.bincount(context * size + coded, weights=n, minlength=contexts * size).reshape(contexts, size)
        total, kinds = table.sum(axis=1, keepdims=True), (table > 0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = -np.log2(table / (total + kinds))
            escaped = -np.log2(kinds / (total + kinds)) + shorter
        return np.where(total == 0, shorter, np.where(table > 0, seen, escaped))

    zero = bits(np.zeros_like(coded), 1, np.full((1, size), 8.0))
    one = bits(last, size, zero)
    pairs, pair = np.unique(last * size + second, return_inverse=True)
    two = bits(pair, len(pairs), one[pairs // size])
    triples, triple = np.unique((size + pair) * size + third, return_inverse=True)
    three = bits(triple, len(triples), two[triples // size - size])
    to_pair = np.repeat(np.arange(size, dtype=np.int32), size)
    to_pair[pairs] = size + np.arange(len(pairs))
    to_triple = np.repeat(np.arange(size + len(pairs), dtype=np.int32), size)
    to_triple[triples] = size + len(pairs) + np.arange(len(triples))
    cost = np.concatenate([one, two, three]).astype(np.float32).ravel()
    return {"symbol": symbol, "size": np.int64(size), "to_pair": to_pair, "to_triple": to_triple, "cost": cost}


def code_lengths(model: dict, texts: list[bytes]) -> np.ndarray:
    """Bits of every text under every language."""
    out = np.zeros((len(texts), len(model)))
    trees = list(model.values())

    def block(data: bytes, tree: dict[str, np.ndarray]) -> np.ndarray:
        size = int(tree["size"])
        s = tree["symbol"][np.frombuffer(data, dtype=np.uint8)]
        state = tree["to_pair"][s[2:-1] * size + s[1:-2]].astype(np.int64)
        state = tree["to_triple"][state * size + s[:-3]].astype(np.int64)
        return tree["cost"][state * size + s[3:]]

    group, held = [], 0

    def flush():
        nonlocal group, held
        if group:
            data = b"".join(b"\0\0\0" + texts[i] for i in group)
            ends = np.cumsum([len(texts[i]) + 3 for i in group])
            for k, tree in enumerate(trees):
                costs = block(data, tree)  # the entries that cross from one text to the next are left out of the sums
                for i, end in zip(group, ends.tolist(), strict=True):
                    out[i, k] = costs[end - len(texts[i]) - 3 : end - 3].sum(dtype=np.float64)
        group, held = [], 0

    for i, data in enumerate(texts):
        if len(data) > BLOCK:
            padded = b"\0\0\0" + data
            for a in range(0, len(data), BLOCK):
                for k, tree in enumerate(trees):
                    out[i, k] += block(padded[a : a + BLOCK + 3], tree).sum(dtype=np.float64)
        elif data:
            if held + len(data) > BLOCK:
                flush()
            group.append(i)
            held += len(data) + 3
    flush()
    return out


def predict(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (posterior share of the winner under equal priors), bits_per_byte, and ROW if docs has it."""
    key = [ROW] if ROW in docs.columns else []
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *key)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        m = shared.value
        for batch in slices(batches):
            raw = batch.column(1).to_pylist()
            known = [m is not None and bool(t) and any(map(str.isalpha, t)) for t in raw]
            texts = [t.encode() if k else b"" for t, k in zip(raw, known, strict=True)]
            names = list(m or ())
            langs, scores, rates = ["und"] * len(raw), np.zeros(len(raw)), np.zeros(len(raw))
            if m is not None:
                bits = code_lengths(m, texts)
                best = bits.argmin(axis=1)
                least = bits.min(axis=1)
                share = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
                for i, ok in enumerate(known):
                    if ok:
                        langs[i], scores[i], rates[i] = names[best[i]], share[i], least[i] / len(texts[i])
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column(0), **{k: batch.column(k) for k in key}, "lang_pred": pa.array(langs, type=pa.string()),
                "score": pa.array(scores), "bits_per_byte": pa.array(rates),
            })

    schema = rows.drop("text").schema.add("lang_pred", "string").add("score", "double").add("bits_per_byte", "double")
    return rows.mapInArrow(work, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the labelled documents that are not held out, then predict every document.

    doc_id, held_out, lang_pred, score, and ROW if docs has it.
    """
    train = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(train.where(~held_out(F.col("doc_id"))))
    found = predict(docs, model, id_col, text_col)
    key = [ROW] if ROW in docs.columns else []
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", *key)
