"""Conversation repair against all edits in turn, and the faults and digests against plain Python."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from clipatlas.llm import conversations
from clipatlas.llm import role_grammar as grammar
from clipatlas.llm.conversation_queries import damaged

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def every_edit(codes):
    """The least (cost, audit) of all sequences of edits, with a few inserted rows."""
    best = 4 * len(codes), "D" * len(codes)  # deleting all rows is always a repair

    def go(i, roles, cost, audit):
        nonlocal best
        if cost > best[0]:
            return
        if i == len(codes) and LEGAL.match(roles) and (cost, audit) < best:
            best = cost, audit
        if not audit.endswith("III"):
            for s in "ua":
                go(i, roles + s, cost + 3, audit + "I")
        if i < len(codes):
            go(i + 1, roles, cost + 4, audit + "D")
            if codes[i] != "-":
                more = 3 if codes[i].isupper() else 0
                if codes[i].lower() in "sua":
                    go(i + 1, roles + codes[i].lower(), cost + more, audit + "K")
                for s in "ua":
                    go(i + 1, roles + s, cost + 3 + more, audit + "R")

    go(0, "", 0, "")
    return best


def parsed(*pieces):
    tops = {grammar.ROOT: (0, "")}
    for number, piece in enumerate(pieces):
        tops = grammar.joined(tops, grammar.passages(piece, number > 0))
    return grammar.finished(tops)


def test_parser_against_every_edit():
    draw = random.Random(1)
    for size in range(6):
        for _ in range(25):
            codes = "".join(draw.choice("suaoSUAO-") for _ in range(size))
            cut = draw.randrange(size + 1)
            assert every_edit(codes) == parsed(codes) == parsed(codes[:cut], codes[cut:]), codes


def test_grammar_accepts_its_language():
    for codes in ("", "ua", "sua", "uaua", "suaua"):
        assert parsed(codes) == (0, "K" * len(codes))
    assert parsed("u")[0] > 0 and parsed("s")[0] > 0 and parsed("usa")[0] > 0
    assert len(grammar.NODES) == 8


def plain(rows):
    """The result for rows (conv_id, turn, role, text) by a reading of the rule."""
    found = {}
    for conv_id in {r[0] for r in rows}:
        mine = [(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv_id]
        mine.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1], hashlib.sha256(m[2].encode()).digest()))
        counts, codes, seen = dict.fromkeys(("blank", "duplicate", "truncated"), 0), "", set()
        for _, role, text in mine:
            black = re.sub(r"[\x20\x09-\x0D]+", "", text)
            fault = "blank" if not black else "duplicate" if (role, text) in seen else "truncated" if black[-1] not in ".!?" else None
            seen.add((role, text))
            code = role[0] if role[:1] in ("s", "u", "a") else "o"
            if fault:
                counts[fault] += 1
                code = code.upper() if fault == "truncated" else "-"
            codes += code
        initials = [role[:1] for _, role, _ in mine]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        cost, audit = every_edit(codes) if len(codes) < 6 else parsed(codes)
        out, left = [], list(mine)
        for edit in audit:
            row = left.pop(0) if edit != "I" else None
            if edit != "D":
                role = row[1] if edit == "K" else "assistant" if out and out[-1][0][:1] == "u" else "user"
                out.append((role, "" if edit == "I" else row[2]))
        turns = {t for t, _, _ in mine if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        digest = hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()
        found[conv_id] = (conv_id, gaps, *counts.values(), illegal, cost, audit, digest), out
    return found


NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, pos string, digest int, initial long, audit string, fault int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], SCHEMA)


EDGES = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "Hello?"), (1, 2, "assistant", "Yes!"), (1, 2, "assistant", "Yes!"), (1, 5, "user", "cut off"),
    (2, None, None, None), (2, None, "user", "No turn."), (2, 3, "", "No role."), (2, 3, "tool", "Other."), (2, 2, "assistant", "\t \n"),
    (3, 4, "user", ""), (3, 4, "user", ""), (4, 1, "assistant", "Word. " * 50_000), (4, 0, "assistant", "Same."), (4, 0, "assistant", "Same."),
    (None, 1, "user", "Of nobody."), (None, 2, "assistant", "Nor this."), (None, 2, "user", " ."), (5, -3, "user", "Line\nbreak."), (5, 9, "assistant", "End. "), (5, 10, "a", ". "),
]


@pytest.mark.parametrize("run_rows", [512, 2])
def test_edges(spark, tmp_path, run_rows):
    docs = frame(spark, EDGES)
    rows = conversations.number_rows(docs.repartition(3), f"{tmp_path}/rows")
    repairs = conversations.find_repairs(rows, run_rows)
    parts = [repairs, conversations.repaired_digests(rows, repairs), conversations.turn_gaps(docs)]
    got = conversations.merged([*parts, spark.createDataFrame([(9,), (1,)], "conv_id long")])
    assert got.columns == NAMES
    want = plain(EDGES)
    empty = (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert {r["conv_id"]: tuple(r) for r in got.collect()} == {**{c: x for c, (x, _) in want.items()}, 9: empty}
    shown = {}
    for r in conversations.repaired_rows(rows, repairs).orderBy("conv_id", "place").collect():
        shown.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert shown == {c: out for c, (_, out) in want.items() if out}
    none = frame(spark, [])
    assert conversations.repair_conversations(spark, none, f"{tmp_path}/none", none).count() == 0


def test_long_conversations_over_tasks(spark, tmp_path):
    draw = random.Random(3)
    rows = []
    for conv_id, size in ((1, 900), (2, 3), (3, 400), (None, 200)):
        for turn in range(size):
            text = draw.choice(["", "Said before.", "no end", *[f"Number {draw.randrange(10**6)}." for _ in range(5)]])
            rows.append((conv_id, turn, draw.choice(["user", "assistant", "user", "assistant", "system", "tool"]), text))
    docs = frame(spark, rows).repartition(8)
    numbered = conversations.number_rows(docs, f"{tmp_path}/rows")
    repairs = conversations.find_repairs(numbered, 50)
    parts = [repairs, conversations.repaired_digests(numbered, repairs), conversations.turn_gaps(docs)]
    assert {r["conv_id"]: tuple(r) for r in conversations.merged(parts).collect()} == {c: x for c, (x, _) in plain(rows).items()}


def test_damage(spark):
    rows = [(c, t, "system", "A. B?") for c in range(40) for t in (0, 1, None)]
    got = damaged(frame(spark, rows)).where("conv_id IS NOT NULL").collect()
    import zlib

    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else "A B" if kind == 2 else text
        want += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    nulls = damaged(spark.createDataFrame([(None, None, None, None)], "conv_id long, turn long, role string, text string"))
    assert nulls.select(F.count("role"), F.count("text")).first() == (1, 1) or nulls.count() == 0
