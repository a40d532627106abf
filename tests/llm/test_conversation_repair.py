import hashlib
import itertools
import random
import re
import zlib

import pytest

from rosterforge.llm import conversation_repair as C
from rosterforge.llm import queries

SPACE = " \t\n\x0b\f\r"
SCHEMA = "conv_id long, turn long, role string, text string, seg int, cells string, mark string"


def mark(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = out.setdefault(conv, [])
        if how == 0:
            continue
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        own += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, mark(r[1], r[2])))
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def options(role, text, fault):
    """(cost, letter, resulting turn) of every edit of one row."""
    found = [(3, "D", None)]
    if fault not in ("blank", "duplicate"):
        extra = fault == "truncated"
        found += [(extra, "K", (role, text)), *[(2 + extra, "R", (r, text)) for r in ("user", "assistant")]]
    return found


def enumerated(rows, most=2):
    """All edits of few rows, judged by the form's expression: nothing of the operator's automaton."""
    inserts = [[(2 * n, "I" * n, [(r, "") for r in roles]) for n in range(most + 1) for roles in itertools.product(("user", "assistant"), repeat=n)]]
    gaps = inserts * (len(rows) + 1)
    best = None
    for choice in itertools.product(*[options(r, t, f) for (_, r, t), f in zip(rows, faults(rows))]):
        for ins in itertools.product(*gaps):
            turns, letters, cost = [], "", 0
            for k, (c, word, new) in enumerate(ins):
                turns, letters, cost = turns + new, letters + word, cost + c
                if k < len(choice):
                    turns, letters, cost = turns + ([choice[k][2]] if choice[k][2] else []), letters + choice[k][1], cost + choice[k][0]
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in turns)) and (best is None or (cost, letters) < best[:2]):
                best = (cost, letters, turns)
    return best


def stepwise(rows):
    """The cheapest edits by states and one row after another, with the repaired turns."""
    def extend(best):
        for _ in range(2):
            for s in list(best):
                c, a, turns = best[s]
                t, role = ("a", "assistant") if s == "u" else ("u", "user")
                new = (c + 2, a + "I", [*turns, (role, "")])
                if t not in best or new[:2] < best[t][:2]:
                    best[t] = new
        return best

    best = extend({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults(rows)):
        after = {}
        for s, (c, a, turns) in best.items():
            for cost, letter, new in options(role, text, fault):
                t = s if new is None else new[0][:1]
                if new is not None and (not t or s + t not in ("s", "u", "su", "ua", "au")):
                    continue
                found = (c + cost, a + letter, turns if new is None else [*turns, new])
                if t not in after or found[:2] < after[t][:2]:
                    after[t] = found
        best = extend(after)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def expected(rows_by_conv, solve=stepwise):
    out = {}
    for conv, rows in rows_by_conv.items():
        found, turns = faults(rows), [r[0] for r in rows if r[0] is not None]
        cost, audit, repaired = solve(rows)
        initials = [r[1][:1] for r in rows]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, found.count("blank"), found.count("duplicate"), found.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
        )
    return out


def got(df):
    rows = df.collect()
    out = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def drawn(rng, convs, longest):
    texts = ["Hi.", "ok", "no!", "", " \t", "why?", "sure. ", "x", None, "a:b\nc."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "User", "sage"]
    return [(c, rng.choice([t, t, t, t * 2, None]), rng.choice(roles), rng.choice(texts)) for c in [*range(convs), None] for t in range(rng.randint(1, longest))]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c", "m") for r in rows], SCHEMA).repartition(3)


def test_matrices_equal_every_edit():
    rng = random.Random(4)
    for _ in range(60):
        rows = [(t, rng.choice(["system", "user", "assistant", "tool"]), rng.choice(["Hi.", "ok", "", "yes!"])) for t in range(rng.randint(0, 2))]
        marks = [(r[0] if r[0] in "sua" else "o") for _, r, _ in rows]
        symbols = "".join("x" if f in ("blank", "duplicate") else m.upper() if f else m for m, f in zip(marks, faults(rows)))
        want = enumerated(rows)
        assert C.cheapest(C.Scan().run(symbols)) == want[:2] == stepwise(rows)[:2]
        assert stepwise(rows)[2] == want[2]


def test_products_are_associative():
    rng, scan = random.Random(9), C.Scan()
    for _ in range(200):
        symbols = "".join(rng.choice("xsuaoSUAO") for _ in range(rng.randint(3, 12)))
        a, b = sorted(rng.sample(range(len(symbols) + 1), 2))
        x, y, z = scan.run(symbols[:a]), scan.run(symbols[a:b]), scan.run(symbols[b:])
        assert C.product(C.product(x, y), z) == C.product(x, C.product(y, z)) == scan.run(symbols)


@pytest.mark.parametrize("partitions", [None, 7])
def test_report_equals_brute_force(spark, partitions):
    rows = drawn(random.Random(2), 120, 9)
    rows += [(999, t, ["user", "assistant"][t % 2], f"t{t % 90}.") for t in range(700)] + [(998, None, "user", "same.")] * 40
    assert got(C.report(C.damage(frame(spark, rows)), partitions)) == expected(damaged(rows))


def test_conversation_over_more_partitions_than_a_product_takes(spark, monkeypatch):
    monkeypatch.setattr(C, "FAN", 3)
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{t}!"])) for t in range(400)] + [(c, 0, "user", "z.") for c in (0, 2)]
    assert got(C.report(C.damage(frame(spark, rows)), 11)) == expected(damaged(rows))


def test_repaired_turns(spark):
    rows = frame(spark, [(1, 0, "user", "A."), (1, 1, "user", "B."), (2, 0, "assistant", " ")]).select("conv_id", "turn", "role", "text")
    plans = C.plan(rows)
    assert {r.conv_id: (r.cost, r.audit) for r in plans.collect()} == {1: (2, "KR"), 2: (3, "D")}
    assert [tuple(r) for r in C.repaired_turns(rows, plans).collect()] == [(1, 0, "user", "A."), (1, 1, "assistant", "B.")]


def test_nothing_left_and_empty_table(spark):
    dropped = next((c, t) for c in range(99) for t in range(9) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)
    assert got(C.report(C.damage(frame(spark, [(*dropped, "user", "x.")])))) == {dropped[0]: (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())}
    assert C.report(C.damage(frame(spark, []))).isEmpty()


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_conversation_repair(spark, sf)) == expected(damaged(rows))
