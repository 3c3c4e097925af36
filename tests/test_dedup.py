"""Duplicates among cards with several sources against the greedy decision, one card after the other."""

import random
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvial.operators import cards
from fluvial.plans import dedup, documents
from fluvial.plans import queries as base


def canon(text):
    return re.sub(r"[\W_]", "", text.lower().replace("ß", "ss"))


def greedy(rows, threshold):
    """rows: id, sources, front, back in order."""

    def share(x, y):
        return len(x & y) / len(x | y) if x | y else 0.0

    kept, out = [], {}
    for i, sources, front, back in sorted(rows, key=lambda r: r[0]):
        key = (canon(front), canon(back))
        words = set(re.findall("[a-z0-9_]{2,}", f"{front}\n{back}".lower().replace("ß", "ss")))
        whole = "\n".join(key)
        runs = {whole[k : k + 3] for k in range(len(whole) - 2)} or {whole}
        for j, s, f, b, k, w, r in kept:
            if (front, back) == (f, b):
                out[i] = (j, "exact")
            elif key == k:
                out[i] = (j, "canonical")
            elif s & sources and max(share(words, w), share(runs, r)) >= threshold:
                out[i] = (j, "similar")
            if i in out:
                break
        else:
            kept.append((i, sources, front, back, key, words, runs))
    return out


def test_source_ids(spark):
    row = spark.createDataFrame([("b", None, ["a", "b", "x y", "", "é", None], None)], "p string, q string, l array<string>, n array<string>")
    assert row.select(cards.source_ids(F.col("p"), F.col("q"), lists=(F.col("l"), F.col("n")))).first()[0] == ["a", "b"]


def test_sets_of_sources(spark):
    rng = random.Random(5)
    words = "cell wall energy light plant root".split()
    rows = []
    for i in range(150):
        front, back = (" ".join(rng.choice(words) for _ in range(rng.choice([4, 5, 6]))) + rng.choice(["", "?", "!"]) for _ in range(2))
        if i % 3 == 2:
            front, back = rows[rng.randrange(len(rows))][2:]
            front = rng.choice([front, front.upper(), front.replace(" ", "-"), front + " x"])
        rows.append((i, rng.sample("abcdefgh", rng.choice([0, 1, 1, 2, 4])), front, back))
    df = spark.createDataFrame(rows, "card_id long, ids array<string>, front string, back string")
    got = cards.deduplicate(df, 0.6, cards.source_ids(lists=(F.col("ids"),))).collect()
    want = greedy([(i, set(s), f, b) for i, s, f, b in rows], 0.6)
    assert {r.card_id: (r.matched_id, r.kind) for r in got} == want and len(got) == len(want)
    assert {k for _, k in want.values()} == {"exact", "canonical", "similar"}


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("query,threshold,kinds", [(dedup.source_decisions, 0.86, 4), (documents.duplicate_decisions, 0.86, 1)])
def test_queries_against_greedy(spark, query, threshold, kinds):
    """The tables' cards, decided by the plain loop."""
    rows = []
    for r in base._changed(spark, SF).collect():
        conv, turn = r.card_id
        sources = {f"c-{conv}", f"p-{conv % 5}", f"k-{conv // 2}", f"k-{conv // 2 + 1}"} if kinds == 4 else {conv}
        rows.append((conv * 10_000 + turn, sources, r.front, r.back))
    want = greedy(rows, threshold)
    got = query(spark, SF).collect()
    assert {r.card_id: (r.matched_id, r.kind) for r in got} == want and len(got) == len(want) > 0


def test_large_sources_and_no_broadcast_by_file_size(spark, monkeypatch):
    """Sources above and below the bound give the pairs of all with all; stored tables aren't broadcast for their small files."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(240):
        own = rng.sample(words, rng.choice([1, 5, 30]))
        if i % 2:
            own = [*rows[-1][2].split(), *rng.sample(words, rng.choice([0, 1, 2, 9]))]
        rows.append((i, ["all"] * (i % 5 > 0) + [f"k{i // 4}"], " ".join(own), ""))
    df = spark.createDataFrame(rows, "card_id long, ids array<string>, front string, back string")
    sets = [(i, set(s), set(f.split())) for i, s, f, _ in rows]
    share = lambda a, b: len(a & b) / len(a | b)
    for most, threshold in ((64, 0.5), (64, 0.86), (1000, 0.5), (0, 0.7)):
        monkeypatch.setattr(cards, "ALL_WITH_ALL", most)
        want = {(i, j): round(share(a, b), 3) for i, s, a in sets for j, t, b in sets if i < j and s & t and share(a, b) >= threshold}
        got = cards.similar_pairs(df, threshold, sources=F.col("ids")).collect()
        assert {(r.first_id, r.second_id): r.similarity for r in got} == want and len(got) == len(want) > 50
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"


def test_copies_in_many_sources_are_compared_once(spark, monkeypatch):
    """Cards of two similar texts that share a source with all and have one of their own: a pair of texts, not of cards, is stored; blocks of few rows change nothing."""
    fronts = ["cell wall energy light plant root leaf stem", "cell wall energy light plant root leaf stem x", "other words"]
    rows = [(i, ["all", f"c{i}", *([f"k{i // 3}"] if i % 4 else [])][i % 5 == 4 :], fronts[i * i % 7 % 3], "b") for i in range(60)]
    df = spark.createDataFrame(rows, "card_id long, ids array<string>, front string, back string")
    want = greedy([(i, set(s), f, b) for i, s, f, b in rows], 0.7)
    stored, keep = {}, cards.materialize
    monkeypatch.setattr(cards, "materialize", lambda d, name: stored.setdefault(name, keep(d, name)) if name == "dedup_pairs" else keep(d, name))
    monkeypatch.setattr(cards, "ALL_WITH_ALL", 2)
    got = cards.deduplicate(df, 0.7, cards.source_ids(lists=(F.col("ids"),))).collect()
    assert {r.card_id: (r.matched_id, r.kind) for r in got} == want and len(got) == len(want) > 50
    assert stored["dedup_pairs"].count() == 1


def count_texts(monkeypatch, folder):
    """From now on each batch of texts that is compared leaves its number of rows in the folder."""
    compare = cards._compared

    def counted(batches, threshold):
        def seen():
            for batch in batches:
                (folder / uuid.uuid4().hex).write_text(str(len(batch)))
                yield batch

        return compare(seen(), threshold)

    monkeypatch.setattr(cards, "_compared", counted)


def texts(n, rng):
    """Cards of one large source and of small ones, of which each second is like the one before."""
    rows = []
    for i in range(n):
        own = [*rows[-1][2].split(), "again"] if i % 2 else [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 60))]
        rows.append((i, ["all", f"k{i // 2}", f"m{i // 4}"], " ".join(own), ""))
    return rows


def test_texts_of_a_large_source_go_only_where_signatures_leave_room(spark, monkeypatch, tmp_path):
    """Over 30 blocks of a source don't repeat its texts, and a pair in several sources is compared in one of them."""
    rows = texts(240, random.Random(3))
    df = spark.createDataFrame(rows, "card_id long, ids array<string>, front string, back string")
    monkeypatch.setattr(cards, "ALL_WITH_ALL", 8)
    count_texts(monkeypatch, tmp_path)
    got = {(r.first_id, r.second_id) for r in cards.similar_pairs(df, 0.5, sources=F.col("ids")).collect()}
    sets = [set(f.split()) for _, _, f, _ in rows]
    assert got == {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i < j and len(a & b) / len(a | b) >= 0.5} and len(got) >= 120
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) <= 300


def test_many_similar_cards_of_a_block_are_named_as_rows(spark, monkeypatch):
    """A cluster whose pairs are many more than its cards, beside pairs, cards of one element and empty ones."""
    rng = random.Random(4)
    base_words = [f"b{k}" for k in range(30)]
    rows = texts(100, rng) + [(100 + i, ["all", "part"[: i % 5]], " ".join(w for w in base_words if rng.random() < 0.9) + " one" * (i % 3), "") for i in range(80)]
    rows += [(180 + i, ["all"], ["", "single", "x"][i % 3], "") for i in range(9)]
    df = spark.createDataFrame(rows, "card_id long, ids array<string>, front string, back string")
    sets = [(i, set(s), set(re.findall(r"\w{2,}", f))) for i, s, f, _ in rows]
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 0
    stored, keep = {}, cards.materialize
    monkeypatch.setattr(cards, "materialize", lambda d, name: stored.setdefault(name, keep(d, name)) if name == "card_meetings" else keep(d, name))
    for most, threshold in ((16, 0.6), (16, 0.9), (1000, 0.6)):
        stored.clear()
        monkeypatch.setattr(cards, "ALL_WITH_ALL", most)
        want = {(i, j): round(share(a, b), 3) for i, s, a in sets for j, t, b in sets if i < j and s & t and share(a, b) >= threshold}
        got = cards.similar_pairs(df, threshold, sources=F.col("ids")).collect()
        assert {(r.first_id, r.second_id): r.similarity for r in got} == want and len(got) == len(want) > 100
    assert 80 <= stored["card_meetings"].filter("source = 'all'").count() < len(want) / 2


def test_decisions_in_a_large_source_compare_few_texts(spark, monkeypatch, tmp_path):
    """Neither words nor runs of letters are repeated for each of a source's blocks."""
    rows = texts(160, random.Random(6))
    df = spark.createDataFrame(rows, "card_id long, ids array<string>, front string, back string")
    monkeypatch.setattr(cards, "ALL_WITH_ALL", 8)
    count_texts(monkeypatch, tmp_path)
    got = cards.deduplicate(df, 0.7, F.col("ids")).collect()
    want = greedy([(i, set(s), f, b) for i, s, f, b in rows], 0.7)
    assert {r.card_id: (r.matched_id, r.kind) for r in got} == want and len(got) == len(want) == 80
    assert sum(int(f.read_text()) for f in tmp_path.iterdir()) <= 2 * 200


def test_all_letters_of_a_run_decide_its_place():
    """Runs that differ in their first letter alone fall on many bits of a signature."""
    codes = np.array([ord(c) << 42 | ord("n") << 21 | ord("d") for c in "abcdefghijklmnopqrstuvwxyz"], np.int64)
    for width in (256, 4_096):
        assert np.bitwise_count(np.frombuffer(cards._signature(codes, width), np.uint8)).sum() > 12
