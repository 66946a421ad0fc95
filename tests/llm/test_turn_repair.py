"""Conversation repair: alignment against all scripts, whole repairs against a direct version, long conversations in pieces."""

import random
import re
from hashlib import md5, sha256
from zlib import crc32

import pytest
from corpus_audit.llm import queries
from corpus_audit.llm import turn_repair as T

GRAMMAR = re.compile("(s?(ua)+)?")


def every_script(codes):
    """The least (cost, audit) of all scripts that cost no more than deleting everything."""
    best = (2 * len(codes), "D" * len(codes))

    def go(i, roles, cost, audit):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(codes) and GRAMMAR.fullmatch(roles):
            best = min(best, (cost, audit))
        for r in "ua":
            go(i, roles + r, cost + 5, audit + "I")
        if i < len(codes):
            go(i + 1, roles, cost + 2, audit + "D")
            if (code := codes[i]) != "-":
                cut = 5 * code.isupper()
                if code not in "xX":
                    go(i + 1, roles + code.lower(), cost + cut, audit + "K")
                for r in "ua":
                    go(i + 1, roles + r, cost + cut + 1, audit + "R")

    go(0, "", 0, "")
    return best


def by_states(codes):
    """The same by states of the grammar, each with its least cost and audit so far."""
    have = {0: (0, "")}

    def least(found, state, value):
        found[state] = min(found.get(state, value), value)

    def inserted():
        for _ in range(2):
            for state, (cost, audit) in list(have.items()):
                least(have, 2 if state == 3 else 3, (cost + 5, audit + "I"))

    for code in codes:
        inserted()
        found = {}
        for state, (cost, audit) in have.items():
            least(found, state, (cost + 2, audit + "D"))
            if code == "-":
                continue
            cost += 5 * code.isupper()
            if code in "sS" and state == 0:
                least(found, 1, (cost, audit + "K"))
            keeps = code.lower() == ("a" if state == 3 else "u")
            least(found, 2 if state == 3 else 3, (cost + (not keeps), audit + ("K" if keeps else "R")))
        have = found
    inserted()
    return min(have[s] for s in (0, 2) if s in have)


def test_alignment_against_all_scripts():
    rng = random.Random(11)
    for _ in range(300):
        codes = "".join(rng.choice("suaSUAx-ua") for _ in range(rng.randrange(6)))
        ((_, _, cost, audit),) = T.align(codes)
        assert (cost, audit) == every_script(codes) == by_states(codes)
        roles = "".join(r[0] if r else codes[i].lower() for i, r in T.script(codes, audit))
        assert GRAMMAR.fullmatch(roles)


@pytest.mark.parametrize("letters", ["suaSUAxX-", "ua", "uaUA", "uaua-", "suauauaU-"])
def test_long_alignments(letters):
    rng = random.Random(letters)
    for _ in range(150):
        codes = "".join(rng.choice(letters) for _ in range(rng.randrange(70)))
        assert T.align(codes)[0][2:] == by_states(codes)


def test_band_leaves_cells_out():
    codes = "ua" * 100
    table = T.Table(codes, T.USER, True, 0, [0] * 201)
    assert sum(len(row) for _, row in table.rows) == 201 and T.align(codes)[0][2:] == (0, "K" * 200)


BLANK = " \t\n\x0b\x0c\r"


def direct(rows):
    """(conv_id, turn, role, text) to {conv_id: (gaps, ..., audit, repaired)}."""
    convs = {}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        convs.setdefault(c, []).append((t is not None, t or 0, r, md5(x.encode()).digest(), x))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        seen, codes, counts = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, _, r, _, x in turns:
            code = r[:1] if r[:1] and r[0] in "sua" else "x"
            body = x.strip(BLANK)
            fault = "blank" if not body else "duplicate" if (r, x) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((r, x))
            if fault:
                counts[fault] += 1
            codes += code.upper() if fault == "truncated" else "-" if fault else code
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = {t[1] for t in turns if t[0]}
        cost, audit = by_states(codes)
        lines = [f"{turns[i][2] if r is None else r}:{turns[i][4]}" if i is not None else f"{r}:" for i, r in T.script(codes, audit)]
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        out[c] = (gaps, *counts.values(), illegal, cost, audit, lines)
    return out


SCHEMA = "conv_id long, turn long, role string, text string"


def made(df, **how):
    audits, turns = T.repair(df, **how)
    lines = {}
    for r in sorted(turns.collect(), key=lambda r: (r["piece"], r["place"])):
        lines.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    hashes = {r["conv_id"]: r["sha256"] for r in T.digests(turns).collect()}
    assert hashes == {c: sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()}
    rows = audits.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: (*[r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")], lines.get(r["conv_id"], [])) for r in rows}


def some_rows(rng, conv, n, words=("Yes.", "No!", "", " \t", "cut", "Why?", None, "Long\nline.", "é.")):
    roles = ["user", "assistant"] * 4 + ["system", "tool", "", None, "User"]
    return [(conv, rng.choice([k, k, k, None, 0]), rng.choice(roles[k % 2 :: 2] if rng.random() < 0.8 else roles), f"{rng.choice(words) or ''}" if rng.random() < 0.3 else f"text {k}.") for k in range(n)]


def test_awkward_conversations(spark):
    rng = random.Random(3)
    rows = [r for c in range(60) for r in some_rows(rng, c, rng.randrange(1, 14))]
    rows += some_rows(rng, None, 20) + [(100, None, None, None)] * 4 + [(101, 5, "user", "x" * 300_000 + "."), (102, 2**40, "user", "Hi."), (102, -(2**40), "assistant", "Ho.")]
    rows += [(103, 1, "user", "Same.")] * 50 + [(104, 1, "system", "Rules.")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'a' AS audit", "1 AS piece", "'u' AS uid", "0 AS cost").repartition(7)
    assert made(df) == direct(rows)


def test_empty_table(spark):
    assert made(spark.createDataFrame([], SCHEMA)) == {}


@pytest.mark.parametrize("size", [1, 2, 5, 16])
def test_pieces_make_no_difference(spark, size):
    """A third of all rows in one conversation, over several ranges, and pieces much shorter than conversations."""
    rng = random.Random(size)
    rows = some_rows(rng, 7, 150) + [r for c in range(20, 50) for r in some_rows(rng, c, rng.randrange(1, 12))]
    rows += [(8, 1, "user", "Same.")] * 40 + [(9, k, "user", "Same.") for k in range(40)] + [(10, k, ["system", "assistant"][k > 3], "") for k in range(9)]
    assert made(spark.createDataFrame(rows, SCHEMA).repartition(9), piece=size) == direct(rows)


def test_query_against_direct_version(spark, tmp_path):
    rng = random.Random(1)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [r for c in [None, *range(500, 540)] for r in some_rows(rng, c, rng.randrange(1, 10))] + [(k, 0, "user", "gone?") for k in range(1000, 1060)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = []
    for c, t, r, x in rows:
        kind = crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(kind, x)
        damaged += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = direct(damaged)
    none = (0, 0, 0, 0, 0, 0, "", [])
    got = queries.QUERIES["op11_turn_repair"](spark, str(tmp_path)).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {
        c: (*want.get(c, none)[:-1], sha256("\n".join(want.get(c, none)[-1]).encode()).hexdigest()) for c in {r[0] for r in rows}
    }
    assert any(c not in want for c, *_ in rows)
