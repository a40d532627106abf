"""Conversation structure repair: cheapest edits that give every conversation the form of an optional system turn and user/assistant pairs.

A conversation is read by an automaton of four states (nothing yet, after a system turn, after a user turn, after an assistant turn). Each turn is a 4x4
matrix over (cost, audit) elements: sums choose the smaller cost and then the smaller audit, products add costs and join audits. Behind and ahead of every turn stands the
closure of insertions. Of two audits of one cost over the same turns between the same states neither is a prefix of the other, so the smaller one stays the
smaller whatever follows, and the product is associative. Turns are dealt by range of (conversation, turn), so a very long conversation lies in many
partitions; a task multiplies what it has of a conversation as a balanced tree, and the partial matrices of conversations at the partitions' borders are
reduced by a tree of FAN-wise products, one small shuffle a level. Interior conversations are done in their task.

The result is applied in one more pass over the texts: a head row with the audit goes ahead of the conversation's turns, which stream by in order, so memory is
bounded by the audit. A digest of one conversation is sequential by definition and is made in that pass.

Defined cases: null role or text counts as one space, a null conversation id is a conversation, null turns come first; rows of one turn follow a digest of role and
text, so that the result doesn't depend on the files; repeated rows are duplicates; the initial of an empty role fits nowhere; texts of any length are read whole; other columns are
ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterforge.llm.common import broadcast_if_small, materialize, slices

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Cost of an edit, and what an undeleted truncated turn adds (fixed values).
COST, TRUNCATED = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: Next state for an initial, by state; what is inserted or given a new role takes the only role that fits (fixed values of the form).
AFTER = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
FITTING = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDS = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
#: Partial matrices of one product in a level of the tree, and length of a run of turns whose matrix is remembered.
FAN, MEMO_TURNS, MEMO_RUNS = 16, 16, 50_000
SPACES = " \t\n\x0b\f\r"

#: Row i: reachable state j -> (cost, audit).
Matrix = list[dict[int, tuple[int, str]]]


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        found: dict[int, tuple[int, str]] = {}
        for k, (cost, audit) in row.items():
            for j, (more, rest) in b[k].items():
                total = cost + more
                if j not in found or total <= found[j][0]:
                    new = (total, audit + rest)
                    if j not in found or new < found[j]:
                        found[j] = new
        out.append(found)
    return out


def closure() -> Matrix:
    """Any number of insertions: at most two are ever worth their cost between two states."""
    once = [{i: (0, ""), FITTING[i]: (COST[INSERT], INSERT)} for i in range(4)]
    return product(once, once)


def turn_matrix(symbol: str) -> Matrix:
    """symbol: x (to be deleted), or the role's initial (o: another one), as a capital if the turn is truncated."""
    rows: Matrix = [{i: (COST[DELETE], DELETE)} for i in range(4)]
    if symbol != "x":
        extra = TRUNCATED if symbol.isupper() else 0
        for i, row in enumerate(rows):
            edits = [(COST[REROLE] + extra, REROLE, FITTING[i])]
            if i in AFTER.get(symbol.lower(), ()):
                edits.append((COST[KEEP] + extra, KEEP, AFTER[symbol.lower()][i]))
            for cost, edit, j in edits:
                row[j] = min(row.get(j, (cost, edit)), (cost, edit))
    return rows


class Scan:
    """Matrices of runs of turns, multiplied as balanced trees; short runs are remembered."""

    def __init__(self):
        self._closure = closure()
        self._turns = {s: product(product(self._closure, turn_matrix(s)), self._closure) for s in "xsuaoSUAO"}
        self._memo: dict[str, Matrix] = {}

    def run(self, symbols: str) -> Matrix:
        n = len(symbols)
        if n < 2:
            return self._turns[symbols] if n else self._closure
        found = self._memo.get(symbols) if n <= MEMO_TURNS else None
        if found is None:
            half = 1 << ((n - 1).bit_length() - 1)  # equal runs are cut alike
            found = product(self.run(symbols[:half]), self.run(symbols[half:]))
            if n <= MEMO_TURNS:
                if len(self._memo) >= MEMO_RUNS:
                    self._memo.clear()
                self._memo[symbols] = found
        return found


def cheapest(matrix: Matrix) -> tuple[int, str]:
    return min(matrix[START][j] for j in ENDS if j in matrix[START])


def damage(turns: DataFrame) -> DataFrame:
    """The rows of conv_id, turn, role, text after seeded faults, and `gone` for those that are dropped, which stay as marks of their conversation."""
    def shown(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    rows = turns.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn"))) % 20).alias("how"))
    text = F.when(F.col("how") == 1, F.lit("")).when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("how") == 0).alias("gone"), copies.alias("copy")).drop("copy")


def _marked(rows: DataFrame) -> DataFrame:
    """rows with nulls filled in, `gone` and `mark`, a digest that tells role and text apart."""
    filled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")]
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    rows = rows.select("conv_id", "turn", *filled, gone.alias("gone"))
    return rows.withColumn("mark", F.when(~F.col("gone"), F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))))


_STATS = ["n_rows", "first_turn", "last_turn", "n_turns", "blank", "duplicate", "truncated", "illegal", "first", "last"]


def _merged(a: dict, b: dict) -> dict:
    """Statistics of two runs of turns of one conversation, a ahead of b."""
    if not a["n_rows"] or not b["n_rows"]:
        return b if b["n_rows"] else a
    out = {k: a[k] + b[k] for k in ("n_rows", "n_turns", "blank", "duplicate", "truncated", "illegal")}
    out["n_turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    out["illegal"] += a["last"] + b["first"] not in LEGAL
    out["first_turn"] = b["first_turn"] if a["first_turn"] is None else a["first_turn"]
    return out | {"last_turn": a["last_turn"] if b["last_turn"] is None else b["last_turn"], "first": a["first"], "last": b["last"]}


def _one(turn, initial: str, blank: bool, truncated: bool, again: bool, n: int) -> tuple[dict, str]:
    """Statistics and symbols of n like rows."""
    blanks = n if blank else 0
    again_n = 0 if blank else n if again else n - 1
    own = not blank and not again
    stats = {"n_rows": n, "first_turn": turn, "last_turn": turn, "n_turns": int(turn is not None), "blank": blanks, "duplicate": again_n, "truncated": int(own and truncated), "illegal": n - 1, "first": initial, "last": initial}
    symbol = initial if initial in ("s", "u", "a") else "o"
    return stats, (symbol.upper() if truncated else symbol) + "x" * (n - 1) if own else "x" * n


_NOTHING = {"n_rows": 0, "first_turn": None, "last_turn": None, "n_turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": "", "last": ""}
_CELL = pa.struct([("i", pa.int32()), ("j", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
_STAT_TYPES = {"first": pa.string(), "last": pa.string()}


def _batch(keys: pa.Array, names: str, found: list[tuple[int, bool, dict, Matrix]]) -> pa.RecordBatch:
    stats = [pa.array([s[k] for _, _, s, _ in found], _STAT_TYPES.get(k, pa.int64())) for k in _STATS]
    cells = [[{"i": i, "j": j, "cost": c, "audit": a} for i, row in enumerate(m) for j, (c, a) in row.items()] for _, _, _, m in found]
    columns = [keys, pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.bool_()), *stats, pa.array(cells, pa.list_(_CELL))]
    return pa.RecordBatch.from_arrays(columns, names=[names, "seg", "border", *_STATS, "cells"])


def _part_schema(kind: T.DataType) -> str:
    stats = ", ".join(f"{k} {'string' if k in _STAT_TYPES else 'long'}" for k in _STATS)
    return f"conv_id {kind.simpleString()}, seg int, border boolean, {stats}, cells array<struct<i: int, j: int, cost: long, audit: string>>"


def _segments(batches):
    """What this task has of each conversation; the first and the last conversation may go on in another task and keep their whole matrices."""
    scan, seg = Scan(), TaskContext.get().partitionId()
    stream = (row for batch in slices(batches, 10_000) for row in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:])))
    held, kind, first = [], None, True
    ready: list[tuple] = []

    def flush():
        out = _batch(pa.array([k.as_py() for k, *_ in ready], kind), "conv_id", [f[1:] for f in ready])
        ready.clear()
        return out

    for conv, rows in groupby(stream, key=lambda r: r[0].as_py()):
        stats, symbols = _NOTHING, []
        for key, turn, mark, n, initial, blank, truncated, again in rows:
            kind = key.type
            if mark is not None:
                more, run = _one(turn, initial, blank, truncated, again, n)
                stats = _merged(stats, more)
                symbols.append(run)
        if held:
            ready.append((*held[:1], seg, first, held[1], held[2] if first else [{j: c for j, c in held[2][START].items() if j in ENDS}]))
            first = False
            if len(ready) >= 1000:
                yield flush()
        held = [pa.scalar(conv, kind), stats, scan.run("".join(symbols))]
    if held:
        ready.append((held[0], seg, True, held[1], held[2]))
        yield flush()


def _joined(table: pa.Table) -> pa.Table:
    """The product of at most FAN neighbouring parts of a conversation."""
    parts = sorted(table.to_pylist(), key=lambda r: r["seg"])
    stats, matrix = None, None
    for part in parts:
        own: Matrix = [{}, {}, {}, {}]
        for cell in part["cells"]:
            own[cell["i"]][cell["j"]] = (cell["cost"], cell["audit"])
        stats = {k: part[k] for k in _STATS} if stats is None else _merged(stats, {k: part[k] for k in _STATS})
        matrix = own if matrix is None else product(matrix, own)
    batch = _batch(table.column("conv_id").combine_chunks().slice(0, 1), "conv_id", [(parts[0]["seg"] // FAN, True, stats, matrix)])
    return pa.Table.from_batches([batch])


def plan(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation.

    rows: conv_id, turn, role, text, and optionally `gone`, whose rows count as absent but make their conversation occur.
    """
    marked = _marked(rows)
    bare = F.btrim("text", F.lit(SPACES))
    marks = marked.select("conv_id", F.when(~F.col("gone"), F.col("turn")).alias("turn"), "mark", F.substring("role", 1, 1).alias("initial"), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    # Like rows of one turn become one row with their number, so that no hot key is left for what follows.
    turns = materialize(marks.groupBy("conv_id", "turn", "mark").agg(F.count(F.lit(1)).alias("n"), F.max("initial").alias("initial"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated")))
    said = turns.where(F.col("mark").isNotNull()).groupBy("conv_id", "mark")
    many = said.agg(F.count(F.lit(1)).alias("turns"), F.max(F.col("turn").isNull()).alias("unnumbered"), F.min("turn").alias("first_turn")).where("turns > 1").drop("turns")
    many = broadcast_if_small(materialize(many.withColumnRenamed("conv_id", "of").withColumnRenamed("mark", "like")))
    again = F.when(F.col("like").isNull(), F.lit(False)).when(F.col("unnumbered"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first_turn"))
    turns = turns.join(many, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("like")), "left").select("conv_id", "turn", "mark", "n", "initial", "blank", "truncated", again.alias("again"))
    order = ["conv_id", "turn", "mark"]
    dealt = turns.repartitionByRange(partitions, *order) if partitions else turns.repartitionByRange(*order)
    kind = rows.schema["conv_id"].dataType
    parts = materialize(dealt.sortWithinPartitions(*order).mapInArrow(_segments, _part_schema(kind)))
    border = parts.where("border")
    segments = (parts.agg(F.max("seg")).first()[0] or 0) + 1
    while segments > 1:  # one level of the tree: FAN neighbours of a conversation become one
        border = materialize(border.groupBy("conv_id", F.expr(f"seg div {FAN}").alias("block")).applyInArrow(_joined, _part_schema(kind)))
        segments = -(-segments // FAN)
    whole = parts.where("not border").unionByName(border)
    ended = F.filter("cells", lambda c: (c["i"] == START) & c["j"].isin(*ENDS))
    best = F.array_min(F.transform(ended, lambda c: F.struct(c["cost"].alias("cost"), c["audit"].alias("audit"))))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).cast("long")
    return whole.withColumn("best", best).select("conv_id", "n_rows", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))


class Editor:
    """Applies the edits of an audit to the turns of one conversation, which come in order."""

    ROLE = {USER: "user", ASSISTANT: "assistant"}

    def __init__(self, audit: str):
        self._audit, self._at, self._state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str]]:
        """The turns that are inserted here."""
        while self._audit[self._at : self._at + 1] == INSERT:
            self._at, self._state = self._at + 1, FITTING[self._state]
            yield self.ROLE[self._state], ""

    def turn(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        edit, self._at = self._audit[self._at], self._at + 1
        if edit == KEEP:
            self._state = AFTER[role[:1]][self._state]
            yield role, text
        elif edit == REROLE:
            self._state = FITTING[self._state]
            yield self.ROLE[self._state], text


def _streamed(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """A conversation's head with its audit, and behind it its turns in order, in one partition."""
    heads = plans.select("conv_id", F.lit(0).alias("kind"), *[F.lit(None).cast(rows.schema["turn"].dataType if c == "turn" else "binary" if c == "mark" else "string").alias(c) for c in ("turn", "mark", "role", "text")], "audit")
    turns = _marked(rows).where("not gone").select("conv_id", F.lit(1).alias("kind"), "turn", "mark", "role", "text", F.lit(None).cast("string").alias("audit"))
    order = ("conv_id", "kind", "turn", "mark")
    return heads.unionByName(turns).repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "role", "text", "audit")


def _repairs(batches) -> Iterator[tuple[pa.Scalar, Iterator[tuple[str, str]]]]:
    """Each conversation and its repaired turns, to be read in order."""
    stream = (row for batch in slices(batches) for row in zip(batch.column(0), *(c.to_pylist() for c in batch.columns[1:])))

    def edited(rows):
        editor = None
        for _, kind, role, text, audit in rows:
            if kind == 0:
                editor = Editor(audit)
            else:
                yield from editor.turn(role, text)
        yield from editor.inserted()

    for _, rows in groupby(stream, key=lambda r: r[0].as_py()):
        head = next(rows)
        yield head[0], edited(r for part in ([head], rows) for r in part)


def repaired_turns(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role, text of the repaired conversations."""

    def work(batches):
        for conv, turns in _repairs(batches):
            for place, (role, text) in enumerate(turns):
                yield pa.RecordBatch.from_arrays([pa.array([conv.as_py()], conv.type), pa.array([place], pa.int64()), pa.array([role], pa.string()), pa.array([text], pa.string())], names=["conv_id", "place", "role", "text"])

    return _streamed(rows, plans).mapInArrow(work, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, place long, role string, text string")


def repaired_digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the repaired turns as role:text, joined by line ends."""

    def work(batches):
        keys, sums, kind = [], [], None
        for conv, turns in _repairs(batches):
            digest = hashlib.sha256()
            for place, (role, text) in enumerate(turns):
                digest.update(("\n" if place else "").encode() + f"{role}:{text}".encode())
            keys.append(conv.as_py())
            sums.append(digest.hexdigest())
            kind = conv.type
            if len(keys) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(sums)], names=["conv_id", "repaired_sha256"])
                keys, sums = [], []
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(sums)], names=["conv_id", "repaired_sha256"])

    return _streamed(rows, plans).mapInArrow(work, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")


def report(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """plan()'s rows with repaired_sha256."""
    plans = materialize(plan(rows, partitions))
    sums = repaired_digests(rows, plans).withColumnRenamed("conv_id", "of")
    return plans.join(sums, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of", "n_rows")
