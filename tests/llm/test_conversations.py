"""Repair and prefix trie of conversations against plain versions."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from markgrid.llm import repair, trie
from markgrid.llm.common import table

SCHEMA = "conv_id long, turn long, role string, text string"
SMALL = "/root/testdata/sf0.001"
TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
REPAIR = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def order(row):
    return (row[1] is not None, row[1] or 0, *row[2:])


def plain_trie(rows):
    convs = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            convs[r[0]].append((r[0], r[1], r[2] or "", r[3] or ""))
    own = {c: [x[2:] for x in sorted(v, key=order)] for c, v in convs.items()}
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - c % 100, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members[tuple(whole[:d])].append(c)
        ends[tuple(whole)].append(c)
    for k in members:
        if k:
            kids[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[x] for x in kids[k]) or 1
        saved[k] = sum(saved[x] for x in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), len(kids[k]), leaves[k], saved[k], sha(",".join(map(str, sorted(ends[k]))))) for k, m in members.items())


def got_trie(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.select(*TRIE).collect())


def some_conversations(seed, convs, longest, kinds=3):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(convs * 3), convs):
        same = rnd.random() < 0.4
        for t in range(rnd.randrange(longest)):
            rows.append((c, rnd.choice([None, t, t, t]), rnd.choice(["user", "assistant", None]) if not same else "user", "x" * (1 if same else rnd.randrange(kinds)) or None))
    return rows


@pytest.mark.parametrize("width, shard", [(64, 20_000), (1, 5), (2, 3), (5, 1)])
def test_trie_in_shards_and_levels(spark, monkeypatch, width, shard):
    monkeypatch.setattr(trie, "SHARD_ROWS", shard)
    rows = some_conversations(width, 70, 12)
    df = spark.createDataFrame(rows, SCHEMA)
    assert got_trie(trie.prefix_trie(*trie.with_shared_beginnings(trie.turn_rows(df)), width=width)) == plain_trie(rows)


def test_trie_query(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got_trie(trie.op13_prefix_trie(spark, SMALL)) == plain_trie(rows)


def test_trie_edges(spark, monkeypatch):
    """Nulls anywhere, no rows, turnless conversations, copies, clashing columns."""
    rows = [(None, 1, "user", "a"), (101, 0, "user", "a"), (101, 0, "user", "a"), (103, None, None, None), (100, 5, "user", ""), (100, 5, "user", None), *[(200 + i, 0, "user", "漢字") for i in range(60)]]
    df = spark.createDataFrame([(*r, 1.5, "z") for r in rows], SCHEMA + ", chars double, pos string")
    monkeypatch.setattr("markgrid.llm.turns.LIST_ROWS", 7)
    assert got_trie(trie.prefix_trie(*trie.with_shared_beginnings(trie.turn_rows(df)))) == plain_trie(rows)
    assert got_trie(trie.prefix_trie(*trie.with_shared_beginnings(trie.turn_rows(df.limit(0))))) == []


def test_long_conversation_is_a_chain(spark):
    rows = [(7, t, "user", f"t{t}") for t in range(300)] + [(8, t, "user", f"t{t}") for t in range(150)] + [(9, 0, "user", "t0")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got_trie(trie.prefix_trie(*trie.with_shared_beginnings(trie.turn_rows(df)))) == plain_trie(rows)


def every_script(shape, i=0, state=0, inserted=0):
    """All edit scripts of a string of symbols, with at most two insertions in a row."""
    if i == len(shape) and state in (0, 3):
        yield 0, ""
    if inserted < 2:
        for cost, rest in every_script(shape, i, 3 if state == 2 else 2, inserted + 1):
            yield cost + 2, "I" + rest
    if i == len(shape):
        return
    symbol, short = shape[i], int(shape[i] in repair.SHORT)
    ways = [(3, "D", state)]
    if symbol != "x":
        legal = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
        if (symbol.lower(), state) in legal:
            ways.append((short, "K", legal[symbol.lower(), state]))
        ways += [(2 + short, "R", legal[to, state]) for to in "ua" if (to, state) in legal]
    for c, letter, after in ways:
        for cost, rest in every_script(shape, i + 1, after):
            yield cost + c, letter + rest


def test_repair_equals_all_scripts_tried():
    rnd = random.Random(3)
    known = repair.matrices([])
    for n in range(5):
        for _ in range(40 if n else 1):
            shape = "".join(rnd.choice("xsuaoSUAO") for _ in range(n))
            assert repair.solved(shape, known) == min(every_script(shape)), shape


def test_rules_do_not_change_the_result(spark):
    rnd = random.Random(5)
    found = {"".join(rnd.choice("uauauasxU") for _ in range(rnd.randrange(60))) for _ in range(200)} | {"ua" * 500, ""}
    df = spark.createDataFrame([(s, 2) for s in found], "shape string, n long")
    coded, rules = repair.repair_rules(df)
    assert len(rules) > 10
    with_rules, without = repair.matrices(rules), repair.matrices([])
    rows = coded.collect()
    assert len(rows) == len(found) and sum(len(r.coded) for r in rows) < 0.7 * sum(map(len, found))
    for r in rows:
        assert repair.solved(r.coded, with_rules) == repair.solved(r.shape, without)


BLANK = re.compile(r"[^\x20\x09-\x0D]")


def plain_repair(rows):
    convs = {r[0]: [] for r in rows}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        text = "" if kind == 1 else re.sub(r"[.!?]", "", text) if kind == 2 else text
        convs[c] += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    known, out = repair.matrices([]), []
    for c, found in convs.items():
        found.sort(key=order)
        seen, shape, faults = set(), "", []
        for _, _, role, text in found:
            full = BLANK.findall(text)
            fault = "blank" if not full else "duplicate" if (role, text) in seen else "truncated" if full[-1] not in ".!?" else ""
            seen.add((role, text))
            who = role[:1] if role[:1] in ("s", "u", "a") else "o"
            faults.append(fault)
            shape += "x" if fault in ("blank", "duplicate") else who.upper() if fault else who
        cost, audit = repair.solved(shape, known)
        lines, at = [], iter(found)
        for letter in audit:
            role, text = ("", "") if letter == "I" else next(at)[2:]
            if letter in "IR":
                role = "assistant" if lines and lines[-1][0] == "u" else "user"
            if letter != "D":
                lines.append(f"{role}:{text}")
        turns = [r[1] for r in found if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:]))
        out.append((-1 if c is None else c, gaps, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out)


def got_repair(df):
    return sorted((-1 if r[0] is None else r[0], *r[1:]) for r in df.select(*REPAIR).collect())


def test_repair_query(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert got_repair(repair.op12_structure_repair(spark, SMALL)) == plain_repair(rows)


def test_repair_edges(spark):
    rnd = random.Random(2)
    texts = ["Done.", "cut", "", " \n\t", None, "Why?  \n", "漢字。", "a.b", "x!"]
    roles = ["user", "assistant", "system", "tool", "", None, "usher"]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, *range(9)]), rnd.choice(roles), rnd.choice(texts)) for _ in range(400)]
    rows += [(77, t, ("user", "assistant")[t % 2], f"Line {t}.") for t in range(900)]
    df = spark.createDataFrame([(*r, 3) for r in rows], SCHEMA + ", cost int")
    assert got_repair(repair.repaired(repair.damaged(df), df)) == plain_repair(rows)
    none = df.limit(0)
    assert repair.repaired(repair.damaged(none), none).collect() == []


@pytest.mark.parametrize("name", ["op12_structure_repair", "op13_prefix_trie"])
def test_sql_says_the_same_of_edges(name):
    """The SQL of the queries on nulls, repeated rows and odd roles, against the plain versions."""
    import duckdb
    import pandas as pd

    from markgrid.llm.registry import ORACLE_SQL

    rnd = random.Random(6)
    rows = [(rnd.choice([None, *range(230)]), rnd.choice([None, *range(9)]), rnd.choice(["user", "assistant", "system", "tool", None]), rnd.choice(["Done.", "cut", "", None, "漢字。", "x!"])) for _ in range(900)]
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con.register("conversations", frame)
    columns, plain = (REPAIR, plain_repair) if name.startswith("op12") else (TRIE, plain_trie)
    got = con.execute(f"select {', '.join(columns)} from ({ORACLE_SQL[name]}) q").fetchall()
    assert sorted(tuple(-1 if x is None else x for x in r) for r in got) == plain(rows)
