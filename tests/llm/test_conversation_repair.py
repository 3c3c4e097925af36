import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pandas as pd
import pytest

from fluvial.llm import conversation_repair, transducers
from fluvial.llm.queries import op12_conversation_repair

SCHEMA = "conv_id long, turn long, role string, text string, conv string, at int, segment string"
SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    key = lambda r: (r[1] is not None, r[1] or 0, hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest())
    return sorted(out, key=key)


def repairs(rows, faults):
    """(cost, audit, lines) of every way to edit the rows with two inserts at most in a place."""
    gaps = [x for n in range(3) for x in itertools.product(("user", "assistant"), repeat=n)]
    found = [(0, "", [], "")]
    for k in range(len(rows) + 1):
        found = [(c + 2 * len(g), a + "I" * len(g), ls + [f"{r}:" for r in g], w + "".join(r[0] for r in g)) for c, a, ls, w in found for g in gaps]
        found = [f for f in found if re.fullmatch("(s?(ua)*u?)?", f[3])]
        if k < len(rows):
            (role, text), dead, more = rows[k][2:], faults[k] in ("blank", "duplicate"), faults[k] == "truncated"
            ways = [(3, "D", [], "")] + ([] if dead else [(more, "K", [f"{role}:{text}"], role[:1] or "?")] + [(2 + more, "R", [f"{r}:{text}"], r[0]) for r in ("user", "assistant")])
            found = [(c + x[0], a + x[1], ls + x[2], w + x[3]) for c, a, ls, w in found for x in ways]
            found = [f for f in found if re.fullmatch("(s?(ua)*u?)?", f[3]) and f[0] <= 3 * len(rows)]
    return [f for f in found if re.fullmatch("(s?(ua)+)?", f[3])]


def expected(rows):
    out = []
    for conv in {r[0] for r in rows}:
        own = damage([r for r in rows if r[0] == conv])
        faults, seen = [], set()
        for _, _, role, text in own:
            said = text.strip(SPACE)
            faults.append("blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[2][:1] + b[2][:1]) not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit, lines, _ = min(repairs(own, faults), key=lambda f: f[:2])
        out.append((conv, min(gaps, 2**63 - 1), *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    return sorted(map(tuple, conversation_repair.repair_conversations(df).collect()), key=repr)


def sql(rows):
    c = duckdb.connect()
    c.register("frame", pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"}))
    c.execute("CREATE VIEW conversations AS SELECT * FROM frame")
    return sorted(c.execute(conversation_repair.ORACLE).fetchall(), key=repr)


def conversations(rng, n, most):
    texts = ["Yes.", "No!", "Why? \n", "cut off", "", " \t\n", None, "a.b", "é…", "What?"]
    return [(conv, rng.choice([None, *range(-2, 6)]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "User"]), rng.choice(texts)) for conv in [None, *range(n)] for _ in range(rng.randrange(1, most))]


@pytest.mark.parametrize("bits,part", [(10, 1 << 20), (1, 8)])
def test_against_all_edits(spark, monkeypatch, bits, part):
    """Segments of two rows cut nearly every conversation; the result is the same."""
    monkeypatch.setattr(conversation_repair, "SEGMENT_BITS", bits)
    monkeypatch.setattr(conversation_repair, "PART", part)
    rows = conversations(random.Random(bits), 60, 5) + [(1000, 2**62, "user", "Far."), (1000, -(2**62), "assistant", "Far."), (1001, None, None, None)]
    assert run(spark, rows) == expected(rows)


def test_long_conversations(spark, monkeypatch):
    """One conversation has most rows; repeated rows; a long text."""
    monkeypatch.setattr(conversation_repair, "SEGMENT_BITS", 5)
    rng = random.Random(9)
    rows = [(7, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["A.", "B", "C?", f"{t}."])) for t in range(900)]
    rows += [(8, 0, "user", "Same.")] * 300 + conversations(rng, 20, 12) + [(9000, 0, "user", "word " * 200_000 + "."), (9000, 1, "assistant", "Ok.")]
    got = run(spark, rows)
    # SQL breaks ties of one turn by the same digest
    assert got == sql(rows)
    assert [r for r in got if r[0] == 8][0][3] >= 299


def test_empty_table(spark):
    assert run(spark, []) == []
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [(gone, 0, "user", "Hi.")]) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_segments_compose():
    rng = random.Random(3)
    for _ in range(200):
        word = "".join(rng.choice("suaoSUA0145") for _ in range(rng.randrange(1, 12)))
        cuts = sorted(rng.sample(range(1, len(word)), rng.randrange(len(word)))) if len(word) > 1 else []
        parts = [word[a:b] for a, b in itertools.pairwise([0, *cuts, len(word)])]
        weights = [conversation_repair._weights(p) for p in parts]
        cost, chain = transducers.best_chain([w[:2] for w in weights])
        audit = "".join(w[2][g * 4 + h] for w, (g, h) in zip(weights, chain, strict=True)) + transducers.TAILS[chain[-1][1]][1]
        assert (cost, audit) == transducers.distances(word, transducers.FINAL, True)[0]
        assert len(transducers.edits(word, audit, 0)) in (len(word), len(word) + 1)


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = op12_conversation_repair(spark, sf)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = c.execute(conversation_repair.ORACLE)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
