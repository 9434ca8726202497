"""Repair of conversations against all lists of edits, and against plain loops over whole tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from trackloom.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, place long, conv string"
NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
CLASSES = {"s": 0, "u": 1, "a": 2}


def code_of(role, fault):
    return 4 * CLASSES.get(role[:1], 3) + fault


def every_repair(rows):
    """Cost, edits and initials of every list of edits; ``rows`` are (initial, fault)."""
    gaps = [("", "")] + [("I" * n, "".join(x)) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    found = [(0, "", "")]
    for initial, fault in rows:
        own = [(2, "D", "")]
        if fault not in (1, 2):
            more = 5 if fault == 3 else 0
            own += [(more, "K", initial), (1 + more, "R", "u"), (1 + more, "R", "a")]
        found = [(c + 5 * len(g) + d, a + g + b, i + j + x) for c, a, i in found for g, j in gaps for d, b, x in own]
    return [(c + 5 * len(g), a + g, i + j) for c, a, i in found for g, j in gaps]


def test_edits_are_the_least_of_all(monkeypatch):
    rng = random.Random(0)
    for n in (0, 1, 2, 3):
        for _ in range(12):
            rows = [(rng.choice("suax"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
            legal = [(c, a) for c, a, i in every_repair(rows) if re.fullmatch("(s?(ua)+)?", i)]
            cost, audit = min(legal)
            codes = bytes(code_of(r, f) for r, f in rows)
            assert conversations.walk(codes, conversations._END, (0,), True)[0][:2] == (audit, cost), rows


def plain_repair(rows):
    """The least edits by (cost, letters) of every place and state, from the front, with the turns left."""
    best = {0: (0, "", ())}
    follow = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}

    def inserted(states):
        for _ in range(2):
            for q, (c, a, out) in list(states.items()):
                to, role = follow[q]
                new = (c + 5, a + "I", (*out, (role, "")))
                if to not in states or new[:2] < states[to][:2]:
                    states[to] = new
        return states

    for role, text, fault in rows:
        nxt = {}
        for q, (c, a, out) in inserted(best).items():
            options = [(2, "D", q, ())]
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                to, other = follow[q]
                if role[:1] == "s" and q == 0:
                    options.append((more, "K", 1, ((role, text),)))
                if role[:1] == other[0]:
                    options.append((more, "K", to, ((role, text),)))
                options.append((1 + more, "R", to, ((other, text),)))
            for d, letter, to, left in options:
                new = (c + d, a + letter, out + left)
                if to not in nxt or new[:2] < nxt[to][:2]:
                    nxt[to] = new
        best = nxt
    return min((v for q, v in inserted(best).items() if q in (0, 3)), key=lambda v: v[:2])


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def plain(table, ids=None):
    """All columns by conversation, by plain loops; ``table`` has (conv_id, turn, role, text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        groups[conv].append(((turn is not None, turn or 0, role.encode(), digest(role, text)), turn, role, text))
    out = {}
    for conv in set(ids if ids is not None else groups):
        rows = [x[1:] for x in sorted(groups.get(conv, []))]
        seen, faulty, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in rows:
            left = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not left else "duplicate" if (role, text) in seen else "truncated" if left[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
            if fault:
                count[fault] += 1
        turns = {t for t, _, _ in rows if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, lines = plain_repair(faulty)
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, *count.values(), illegal, cost, audit, sha)
    return out


def plain_damage(table):
    for conv, turn, role, text in table:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        if kind:
            yield from [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def told(found):
    return {r.conv_id: tuple(r[x] for x in NAMES) for r in found.collect()}


def made(seed, convs=40, longest=14):
    rng = random.Random(seed)
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"])
            text = rng.choice(["Yes.", "No", " \t", "", "What?", "Ends \n", "Ends. \n", "Long " * 20 + "!", None, "a "])
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), role, text))
            rows.extend([rows[-1]] * rng.choice([0, 0, 0, 2]))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA)


@pytest.fixture
def many_tasks(spark):
    """Small shuffles keep their partitions."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    yield
    spark.conf.unset(name)


@pytest.mark.parametrize("block", [1 << 16, 5, 1])
def test_repair_equals_plain_loops(spark, many_tasks, block):
    rows = made(block) + [(None, t, "user", "Who.") for t in range(3)] + [(99, None, "user", "x"), (99, None, "assistant", "y")]
    found = told(conversations.summaries(frame(spark, rows), most=block))
    assert found == plain(rows)


def test_a_conversation_over_many_blocks_and_tasks(spark, many_tasks):
    """One conversation with most of the rows, with long stretches that only its end decides."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), f"Turn {rng.randrange(400)}{rng.choice(['.', '', '!'])}") for t in range(3000)]
    rows += [(1, 3000 + t, "user", "Same.") for t in range(300)] + [(2, 1, "user", "Hi."), (2, 2, "assistant", "Ho.")]
    found = conversations.blocks(conversations._prepared(frame(spark, rows)), 200).where("conv = '1'").collect()
    assert all(r.open for r in found) and len(found) > 16 and len({r.place >> 36 for r in found}) > 1
    assert told(conversations.summaries(frame(spark, rows), most=200)) == plain(rows)


def test_blocks_meet_as_tables():
    """Vectors through blocks' tables equal those through all turns, and walks from block to block give the edits of the whole."""
    rng = random.Random(6)
    codes = bytes(rng.randrange(16) for _ in range(700))
    whole = conversations.walk(codes, conversations._END, (0,), True)[0]
    parts = [codes[i : i + 90] for i in range(0, 700, 90)]
    after = [conversations._END]
    for part in reversed(parts):
        after.append(conversations.through(conversations.table(part), after[-1]))
        direct = after[-2]
        for code in reversed(part):
            direct = conversations.before(code, direct)
        assert after[-1] == direct
    after.reverse()
    state, letters, cost = 0, "", 0
    for k, part in enumerate(parts):
        audit, paid, state = conversations.walk(part, after[k + 1], (0, 1, 2, 3), k == len(parts) - 1)[state]
        letters, cost = letters + audit, cost + paid
    assert (letters, cost) == whole[:2]


def test_vectors_are_stored_at_checkpoints_only():
    codes = bytes(random.Random(7).randrange(16) for _ in range(10000))
    step, kept = conversations.checkpoints(codes, conversations._END)
    assert step == 101 and len(kept) <= 102


def test_repaired_turns(spark):
    rows = [(7, 0, "assistant", "Well."), (7, 1, "user", "Cut"), (7, 2, "assistant", "So."), (7, 3, "user", " ")]
    found = conversations.repair(frame(spark, rows)).orderBy("line").collect()
    assert [(r.conv, r.line, r.edit, r.role, r.text) for r in found] == [("7", 0, "R", "user", "Well."), ("7", 1, "K", "assistant", "So.")]


def test_damage_and_every_id(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"Text {c} of {t}. More!") for c in range(60) for t in range(3)] + [(None, None, None, None)]
    convs = frame(spark, rows)
    damaged = list(plain_damage(rows))
    assert sorted(map(str, map(tuple, conversations.damage(convs).collect()))) == sorted(map(str, damaged))
    ids = [r[0] for r in rows]
    assert told(conversations.summaries(conversations.damage(convs), convs)) == plain(damaged, ids)
    alone = [(c, 0, "user", "x.") for c in range(100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    lost = told(conversations.summaries(conversations.damage(frame(spark, alone)), frame(spark, alone)))
    assert set(lost.values()) == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())} and len(lost) == len(alone) > 0


def test_empty_tables_and_long_texts(spark):
    assert conversations.summaries(frame(spark, [])).count() == 0
    assert conversations.repair(frame(spark, [])).count() == 0
    rows = [(1, 0, "user", "long " * 400000 + "."), (1, 1, "assistant", "x" * 3000000 + ". \n" + " " * 100000)]
    assert told(conversations.summaries(frame(spark, rows))) == plain(rows)


def test_query_equals_plain_loops(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = queries.queries()["op13_conversation_repair"](spark, sf_dir)
    assert found.columns == ["conv_id", *NAMES]
    assert told(found) == plain(list(plain_damage(rows)), [r[0] for r in rows])
