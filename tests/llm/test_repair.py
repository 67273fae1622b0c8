"""Repairs next to a version that lists every cheapest edit, and the grammar next to none."""

import functools
import hashlib
import random
import zlib

import duckdb
import pytest

from shelltrail.llm import repair
from shelltrail.llm.sql import SQL

NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}


def plain_repair(rows):
    """(cost, least audit) by listing all cheapest audits; rows are (initial, fault)."""

    @functools.cache
    def rest(at, state, inserted):
        found = []
        if at == len(rows) and state in ("", "a"):
            found.append((0, {""}))
        if inserted < 3:
            cost, audits = rest(at, NEXT[state], inserted + 1)
            found.append((2 + cost, {"I" + x for x in audits}))
        if at < len(rows):
            initial, fault = rows[at]
            ways = [("D", 3, state)]
            if fault not in ("b", "d"):
                more = fault == "t"
                ways.append(("R", 2 + more, NEXT[state]))
                if (initial == "s" and state == "") or (initial in ("u", "a") and NEXT[state] == initial):
                    ways.append(("K", more, initial))
            for letter, price, to in ways:
                cost, audits = rest(at + 1, to, 0)
                found.append((price + cost, {letter + x for x in audits}))
        least = min((cost for cost, _ in found), default=10**9)
        return least, set().union(*(audits for cost, audits in found if cost == least))

    cost, audits = rest(0, "", 0)
    return cost, min(audits)


def plain(turns, damage=True):
    """Everything asked for, per conversation, from (conv_id, turn, role, text)."""
    rows = {}
    for conv_id, turn, role, text in turns:
        rows.setdefault(conv_id, [])
        role, text = (" " if x is None else x for x in (role, text))
        name = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        way = zlib.crc32(name.encode()) % 20 if damage else 9
        if way == 0:
            continue
        text = "" if way == 1 else "".join(c for c in text if c not in ".!?") if way == 2 else text
        role = "user" if way == 4 else role
        rows[conv_id] += [(turn, role, text)] * (2 if way == 3 else 1)
    out = {}
    for conv_id, found in rows.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        judged, seen = [], set()
        for turn, role, text in found:
            said = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else ""
            seen.add((role, text))
            judged.append((role[:1], fault))
        numbers = [r[0] for r in found if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:]))
        cost, audit = plain_repair(tuple(judged))
        lines, at, state = [], 0, ""
        for edit in audit:
            if edit == "I":
                state = NEXT[state]
                lines.append({"u": "user:", "a": "assistant:"}[state])
                continue
            _, role, text = found[at]
            at += 1
            if edit == "D":
                continue
            state = NEXT[state] if edit == "R" else role[:1]
            lines.append((role if edit == "K" else {"u": "user", "a": "assistant"}[state]) + ":" + text)
        faults = [sum(f == x for _, f in judged) for x in "bdt"]
        out[conv_id] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def fixture(seed, conversations=60):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "No. ", "ok?\n", "", " \t", "Why!\x0b", "é…", "x.y", None, "　", "." * 3]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "unknown"]
    rows = []
    for conv_id in [*range(conversations), None, -7]:
        for n in range(rng.choice([1, 1, 2, 3, 5, 8, 9])):
            role = rng.choice(roles) if rng.random() < 0.4 else ("user", "assistant")[n % 2]
            turn = rng.choice([n, n, n, 2 * n, None, 0])
            rows.append((conv_id, turn, role, rng.choice(texts) if rng.random() < 0.6 else f"Number {rng.random()}."))
    rows += rows[::9]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def digests(spark, rows, damage=True, schema=SCHEMA):
    turns = spark.createDataFrame(rows, schema).repartition(4)
    hurt = repair.damaged(turns) if damage else repair.turns_of(turns)
    return {row[0]: tuple(row)[1:] for row in repair.repair_digest(hurt, turns).collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_plain(spark, seed):
    rows = fixture(seed)
    assert digests(spark, rows) == plain(rows)


def test_a_conversation_in_many_pieces(spark, monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(repair, "CHUNK", 3)
    monkeypatch.setattr(repair, "ROWS_OUT", 5)
    roles = ["user", "assistant", "system"]
    rows = [(1, n // 3, rng.choice(roles), rng.choice(["a.", "b", "", f"{n}."])) for n in range(14)] + [(2, 5, "user", "same.")] * 11 + fixture(7, 8)
    assert digests(spark, rows, damage=False) == plain(rows, damage=False)


def test_a_long_conversation(spark):
    rows = [(1, n, ("user", "assistant")[n % 2], f"Turn {n}.") for n in range(5000)]
    del rows[2500], rows[1200]
    (found,) = digests(spark, rows, damage=False).values()
    assert found[0] == 2 and found[4] == 2 and found[5] == 4 and found[6].count("K") == 4998 and found[6].count("I") == 2


def test_grammar_changes_nothing():
    rng = random.Random(5)
    rows = ["".join(rng.choices(repair.TERMINALS, [1, 5, 5, 1, 1, 2, 2, 1, 2], k=rng.randint(1, 9))) for _ in range(150)]
    rules = []
    for _ in range(6):
        counts = sum((repair.count_pairs(repair.Grammar(rules).compressed(x)) for x in rows), repair.Counter())
        rules += repair.disjoint([pair for pair, _ in counts.most_common(20)], 4)
    with_rules, without = repair.Grammar(rules), repair.Grammar([])
    assert any(len(with_rules.compressed(x)) == 1 < len(x) for x in rows)
    for x in rows:
        fault = {"x": "d"}
        judged = tuple((c.lower(), fault.get(c, "t" if c.isupper() else "")) for c in x)
        expected = plain_repair(judged)
        assert with_rules.repair([x]) == without.repair([x]) == expected
        assert with_rules.repair(list(x)) == with_rules.repair([x[:4], *([x[4:]] if x[4:] else [])]) == expected


def test_shared_grammar_learns_frequent_pairs(spark):
    chunks = spark.createDataFrame([("uaua",)] * 30 + [("suaua",)] * 9 + [("x",)], "symbols string")
    rules = repair.shared_grammar(chunks)
    assert rules[0] == "ua" and repair.Grammar(rules).compressed("suaua") == chr(repair.FIRST_RULE + rules.index("s" + chr(repair.FIRST_RULE + 1)))


def test_equals_sql(spark):
    rows = fixture(6)
    connection = duckdb.connect()
    connection.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    connection.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    relation = connection.execute(SQL["op12_repair"])
    assert [d[0] for d in relation.description] == [*repair.SOLVED_NAMES, "repaired_sha256"]
    assert {row[0]: row[1:] for row in relation.fetchall()} == plain(rows)


def test_repaired_turns(spark):
    rows = [("c", 0, "user", "Hi."), ("c", 1, "user", "Well?"), ("c", 2, "assistant", "cut of"), ("d", 0, "assistant", " ")]
    turns = repair.turns_of(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string"))
    found = repair.audits(turns)
    assert {r.conv_id: r.audit for r in found.collect()} == {"c": "KIKK", "d": "D"}
    got = [tuple(r) for r in repair.repaired_turns(turns, found).orderBy("conv_id", "place").collect()]
    assert got == [("c", n, edit, *row) for n, (edit, *row) in enumerate([("K", "user", "Hi."), ("I", "assistant", ""), ("K", "user", "Well?"), ("K", "assistant", "cut of")])]


def test_no_rows_and_other_columns(spark):
    assert digests(spark, []) == {}
    turns = spark.createDataFrame([(1, 0, "user", "a.", "x", 3)], SCHEMA + ", audit string, place int")
    assert len(repair.repair_digest(repair.damaged(turns), turns).collect()) == 1
