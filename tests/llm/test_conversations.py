"""Conversation repair against a plain search over edits and a row-by-row reading of the rules."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ragspark.llm import conversations as cv
from ragspark.llm.common import read

SHAPE = re.compile(r"(s?(ua)+)?")


def best_edits(symbols):
    """Least (cost, audit) over all edits, by states and whole strings."""
    steps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def inserted(table):
        for _ in range(3):
            for state, (cost, audit) in list(table.items()):
                for c, to in steps[state].items():
                    if c != "s":
                        table[to] = min(table.get(to, (10 ** 9, "")), (cost + 5, audit + "I"))
        return table

    table = inserted({0: (0, "")})
    for initial, fault in symbols:
        after = {}

        def put(state, value):
            after[state] = min(after.get(state, (10 ** 9, "")), value)

        for state, (cost, audit) in table.items():
            put(state, (cost + 2, audit + "D"))
            if fault in ("ok", "truncated"):
                more = 5 * (fault == "truncated")
                for c, to in steps[state].items():
                    if c == initial:
                        put(to, (cost + more, audit + "K"))
                    if c != "s":
                        put(to, (cost + more + 1, audit + "R"))
        table = inserted(after)
    return min(table[s] for s in (0, 3) if s in table)


def every_edit(symbols, most):
    """Least (cost, audit) by trying every string of edits with at most so many inserts."""
    best = (10 ** 9, "")
    for inserts in range(most + 1):
        for places in itertools.combinations_with_replacement(range(len(symbols) + 1), inserts):
            for edits in itertools.product("DKR", repeat=len(symbols)):
                audit, cost, out = "", 0, []
                for i in range(len(symbols) + 1):
                    audit += "I" * places.count(i)
                    out += ["?"] * places.count(i)
                    cost += 5 * places.count(i)
                    if i < len(symbols):
                        initial, fault = symbols[i]
                        audit += edits[i]
                        if edits[i] == "D":
                            cost += 2
                            continue
                        if fault in ("blank", "duplicate"):
                            cost += 10 ** 6
                        cost += (edits[i] == "R") + 5 * (fault == "truncated")
                        out.append(initial if edits[i] == "K" else "?")
                shape = "".join(out)
                fits = any(len(t) == len(shape) and all(x in ("?", y) for x, y in zip(shape, t)) and
                           all(not (x == "?" and y == "s") for x, y in zip(shape, t))
                           for t in ("ua" * 5, "", *(p + "ua" * k for p in ("", "s") for k in range(1, 6))))
                if fits:
                    best = min(best, (cost, audit))
    return best


def expected(rows, ids):
    """What the rules say of the rows, read one by one."""
    by_conv = defaultdict(list)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by_conv[conv] += [(turn, role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv in ids:
        ordered = sorted(by_conv[conv], key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        seen, symbols = set(), []
        for _, role, text in ordered:
            bare = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "ok"
            seen.add((role, text))
            symbols.append((role[:1], fault))
        cost, audit = best_edits(symbols)
        turns = [t for t, *_ in ordered if t is not None]
        lines, left = [], iter(ordered)
        for edit in audit:
            if edit == "I":
                lines.append((None, ""))
            else:
                _, role, text = next(left)
                if edit != "D":
                    lines.append((role if edit == "K" else None, text))
        start = 1 if lines and lines[0][0] and lines[0][0][:1] == "s" else 0
        lines = [(role or ("user", "assistant")[(i - start) % 2], text) for i, (role, text) in enumerate(lines)]
        assert SHAPE.fullmatch("".join(role[0] for role, _ in lines))
        count = [sum(f == k for _, f in symbols) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(symbols, symbols[1:]))
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *count, illegal, cost, audit,
                     hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def invented(seed=4):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "cut, ", "", "  \n", None, "é 日本.", "fine. ", "x" * 5000 + "."]
    rows = []
    for conv in range(60):
        for turn in range(r.randrange(0, 12)):
            rows.append((conv, r.choice([turn, turn, turn, turn + 1, None]), r.choice(["system", "user", "assistant", "tool", "", None, "user", "assistant"]),
                         r.choice(texts) if r.random() < 0.6 else f"text {r.random()}."))
    rows += [(500, t, "user" if t % 3 else "assistant", f"line {t % 250}" + "." * (t % 5 > 0)) for t in range(700)]
    rows += [(501, None, "user", "same.")] * 50 + [(None, 1, "user", "of nobody."), (None, 2, "assistant", None)]
    rows += [(600, t, "user", "a.") for t in range(200) if zlib.crc32(f"600:{t}".encode()) % 20 == 0]
    return rows


@pytest.fixture(scope="module")
def table(spark):
    rows = invented()
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    return rows, df.select("*", F.lit("r").alias("run"), F.lit(1).alias("conv"), F.lit(2).alias("kind"), F.lit(3).alias("state"))


def found(df, key="conv_id"):
    rows = df.collect()
    assert len({r[key] for r in rows}) == len(rows)
    return {r[key]: tuple(r[c] for c in (*cv.FIGURES, "audit", "repaired_sha256")) for r in rows}


@pytest.mark.parametrize("limits", [{}, {"run_rows": 3}, {"run_chars": 40}])
def test_invented_conversations(table, limits):
    rows, df = table
    want = expected(rows, {r[0] for r in rows})
    assert found(cv.repair(cv.damaged(df), all_ids=df, **limits)) == want
    assert want[600] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_a_conversation_over_many_partitions(spark, table):
    rows, df = table
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert found(cv.repair(cv.damaged(df), all_ids=df)) == expected(rows, {r[0] for r in rows})
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)


def test_given_conversations(spark, small):
    df = read(spark, small, "conversations")
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert found(cv.repair(cv.damaged(df), all_ids=df)) == expected(rows, {r[0] for r in rows})


def test_solver_against_states_and_every_edit():
    r, faults = random.Random(8), ["ok", "blank", "duplicate", "truncated"]
    sequences = [[(r.choice("suat"), r.choices(faults, [6, 1, 1, 2])[0]) for _ in range(r.choice([0, 1, 2, 3, 5, 8, 13, 40, 300]))]
                 for _ in range(400)]
    spelled = ["".join(cv.letter(i, faults.index(f)) for i, f in s) for s in sequences]
    solver = cv.Solver()
    assert solver.of(spelled) == [best_edits(s) for s in sequences] == cv.Solver().of(spelled[::-1])[::-1]
    assert len(solver.grammar.rules) > 50
    for s in sequences:
        if len(s) <= 3:
            assert best_edits(s) == every_edit(s, 3)


def test_rules_are_shared_and_long_runs_compress():
    grammar = cv.Grammar()
    sequence = (cv.letter("u", 0) + cv.letter("a", 0)) * 50_000
    items = grammar.compress([sequence, sequence[:4000]])
    assert len(items[0]) < 500 and len(grammar.rules) < 100
    assert grammar.cheapest(items[0]) == (0, "K" * 100_000)


def test_ropes_compare_like_strings():
    r = random.Random(2)
    for _ in range(300):
        texts = ["".join(r.choice("DK") for _ in range(r.randrange(0, 9))) for _ in range(2)]
        ropes = []
        for t in texts:
            parts = [cv.Rope.letter(c) for c in t] or [cv.NOTHING]
            while len(parts) > 1:
                i = r.randrange(len(parts) - 1)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
            ropes.append(parts[0])
        if all(texts):
            assert (ropes[0] < ropes[1]) == (texts[0] < texts[1]) and str(ropes[0]) == texts[0]


def test_empty(table):
    _, df = table
    got = cv.repair(df.where("false"))
    assert got.count() == 0 and got.columns == ["conv_id", *cv.FIGURES, "audit", "repaired_sha256"]
