import functools
import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from compare import connect, difference
from wardlake.llm import queries, turnrepair

RIGHT = re.compile(r"(s?(ua)+)?")


def plain_edits(symbols):
    """(cost, audit) of the best edits: every choice of every row, remembered by place and state."""

    @functools.cache
    def best(i, state, inserts):
        choices = []
        wanted = "a" if state == "u" else "u"
        if i == len(symbols):
            if state in "-a":
                choices.append((0, ""))
        else:
            initial, must_go, added = symbols[i]
            steps = [(2, "D", state)]
            if not must_go:
                steps.append((1 + added, "R", wanted))
                if initial == wanted or (initial == "s" and state == "-"):
                    steps.append((added, "K", initial))
            for cost, edit, to in steps:
                rest = best(i + 1, to, 0)
                choices.append((cost + rest[0], edit + rest[1]))
        if inserts < 3:
            rest = best(i, wanted, inserts + 1)
            choices.append((5 + rest[0], "I" + rest[1]))
        return min(choices, default=(10**9, ""))

    return best(0, "-", 0)


def meaning(s):
    return "sua"[(s - 1) % 4 : (s - 1) % 4 + 1], s == 0, 5 if s > 4 else 0


@pytest.mark.parametrize("block", [1, 2, 4])
def test_tables_equal_all_choices(block):
    tables, rng = turnrepair.Tables(block), random.Random(block)
    for n in list(range(9)) * 60:
        symbols = bytes(rng.choices(range(9), k=n))
        assert tables.repair(symbols) == plain_edits([meaning(s) for s in symbols])
    assert len(tables.vectors) < 100


def test_long_conversations_are_read_by_blocks():
    tables, symbols = turnrepair.Tables(), bytes(random.Random(1).choices(range(9), k=50_001))
    cost, audit = tables.repair(symbols)
    assert (cost, audit) == turnrepair.Tables(1).repair(symbols)
    assert len(audit.replace("I", "")) == len(symbols)


def plain_repair(rows):
    out, conversations = [], {}
    for r in rows:
        members = conversations.setdefault(r["conv_id"], [])
        key = ":".join(" " if r[c] is None else str(r[c]) for c in ("conv_id", "turn"))
        fate = zlib.crc32(key.encode()) % 20
        role, text = (" " if r[c] is None else r[c] for c in ("role", "text"))
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        members += [(r["turn"], role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    for conv_id, members in conversations.items():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1].encode(), hashlib.sha256(m[2].encode()).digest()))
        seen, symbols, faults = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}
        for _, role, text in members:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), 5 if fault == "truncated" else 0))
        cost, audit = plain_edits(symbols)
        turns = [m[0] for m in members if m[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(members, members[1:])]
        lines, at = [], 0
        for edit in audit:
            wanted = "assistant" if len([x for x in lines if x[0] != "s"]) % 2 else "user"
            if edit == "I":
                lines.append((wanted[0], wanted + ":"))
                continue
            _, role, text = members[at]
            at += 1
            if edit != "D":
                name = role if edit == "K" else wanted
                lines.append((name[0], name + ":" + text))
        assert RIGHT.fullmatch("".join(x[0] for x in lines))
        digest = hashlib.sha256("\n".join(x[1] for x in lines).encode()).hexdigest()
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out.append((conv_id, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, digest))
    return sorted(out, key=str)


def run(df):
    return sorted(map(tuple, turnrepair.repair(turnrepair.damaged(df)).collect()), key=str)


def test_query_equals_sql_and_all_choices(spark, small):
    got = queries.QUERIES["op13_turn_repair"](spark, small)
    assert difference(got, connect(small), queries.CHECKS["op13_turn_repair"]) is None
    rows = [r.asDict() for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    assert sorted(map(tuple, got.collect()), key=str) == plain_repair(rows)


def test_edges(spark):
    rng = random.Random(3)
    rows = []
    for conv_id in [None, *range(60), 2**62 + 1]:
        for turn in range(rng.randint(1, 7)):
            rows.append((conv_id, rng.choice([turn, turn, 1, None, 2**61]), rng.choice(["user", "assistant", "system", "tool", "", None]),
                         rng.choice(["Yes.", "No! ", "cut", "  ", "", None, "Same. ", "dot.\n\t", "Ж日. x"])))
    rows += [(7, 3, "user", "Copy.")] * 5 + [(8, t, "user", "Again.") for t in range(6)] + [(9, 5, "user", t) for t in "bdac"]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3)
    own = df.withColumns({c: F.lit("own") for c in ("copies", "fault", "gone", "digest", "kind", "audit", "counts", "first")})
    want = plain_repair([dict(zip(("conv_id", "turn", "role", "text"), r)) for r in rows])
    assert run(df) == run(own) == want
    assert run(df.limit(0)) == []


def test_conversations_without_rows_are_returned(spark):
    gone = [(c, t, "user", "Hello.") for c in range(300) for t in range(2) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    got = run(spark.createDataFrame(gone, "conv_id bigint, turn bigint, role string, text string"))
    assert len(got) == len({g[0] for g in gone}) and {g[1:] for g in got} == {(0,) * 6 + ("", hashlib.sha256(b"").hexdigest())}


def test_one_conversation_with_a_third_of_all_rows(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"Text {t % 700}.") for t in range(3000)] + [(c, 0, "user", "Hi.") for c in range(2, 6000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)
    got = {r[0]: r for r in run(df)}
    audit = got[1][7]
    assert len(got) == 5999 and len(audit.replace("I", "")) == sum(
        {0: 0, 3: 2}.get(zlib.crc32(f"1:{t}".encode()) % 20, 1) for t in range(3000)
    )
