import random
import re

import numpy as np
import pyarrow as pa
import pytest

from fluvial.llm import jaccard_join, shingles


def sets(rows):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def expected(rows):
    s = sets(rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s[i]), least.get(find(i)) if s[i] else d) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(rng, n):
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice([2, 3, 4])))
    passage = [word() for _ in range(30)]
    base = [[word() for _ in range(rng.choice([3, 5, 8, 20, 60, 150]))] for _ in range(n // 6)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.3:
            w = w + passage
        out.append(rng.choice([" ", "  ", "\n"]).join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "LEAST", 5)
    rng = random.Random(seed)
    texts = corpus(rng, 240)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "A b"), (2004, "a  B"), (None, "a b"), (2005, texts[0]), (2005, texts[0]), (2006, "w " * 40_000)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_shingles string").repartition(3)
    assert sorted((tuple(r) for r in jaccard_join.near_components(docs).collect()), key=repr) == expected(rows)
    kept = {r.doc_id for r in jaccard_join.keep_least(docs).collect()}
    assert kept == {d for d, n, c in expected(rows) if d is None or not n or d == c}


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_words_of_a_pattern_stay_apart(spark):
    """Such words and their complements have equal polynomial hashes, whatever the base."""
    words = [w for n in (8, 16, 64, 128, 1024, 4096) for w in (thue_morse(n), thue_morse(n).translate(str.maketrans("ab", "ba")))]
    rows = [(i, w) for i, w in enumerate(words)] + [(100 + i, f"one two three four {w}") for i, w in enumerate(words)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.near_components(docs).collect()) == [(i, 1, i) for i, _ in rows]


def test_keep_least_of_a_repeated_id_goes_by_text(spark):
    texts = {1: "a b c d e f g", 2: "q w e r t y u"}
    rows = [(1, texts[1], "x"), (5, texts[1], "x"), (5, texts[2], "y"), (7, texts[2], "z"), (None, texts[1], "n"), (5, "", "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, a string")
    assert sorted(map(tuple, jaccard_join.keep_least(docs).collect()), key=repr) == sorted([rows[0], rows[2], rows[4], rows[5]], key=repr)
    assert jaccard_join.keep_least(docs.limit(0)).count() == 0


def test_hot_keys_are_dealt_over_salts(spark, monkeypatch):
    from fluvial import staging

    monkeypatch.setattr(staging, "hot_groups", lambda spark: 10**9)
    monkeypatch.setattr(staging, "LEAST_HOT", 100)
    rows = [(i, " ".join(f"w{j}" for j in range(30)) + f" x{i % 500}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.n_shingles, r.component_id) for r in jaccard_join.near_components(docs).collect()} == {(27, 0)}


def test_empty_table(spark):
    assert jaccard_join.near_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_tile_finds_all_pairs_of_different_components():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 2**63, 200).astype(np.uint64)
    found = []
    for _ in range(60):
        own = base.copy()
        own[rng.integers(0, 200, rng.integers(0, 40))] = rng.integers(0, 2**63)
        found.append(np.unique(own))
    rows = []
    for i, s in enumerate(found):
        band = int(jaccard_join._band(np.array([len(s)]))[0])
        rows += [{"token": 5, "tile": tile, "i": 0, "j": 0, "block": 0, "pos": 0, "a": i, "b": 0, "n": len(s), "label_a": i % 7, "label_b": 0, "bits": shingles.bitmap(s).tobytes()} for tile in (band, band - 1)]
    batches = pa.Table.from_pylist(sorted(rows, key=lambda r: r["tile"])).to_batches(max_chunksize=17)
    got = {(r["a"], r["c"]) for b in jaccard_join._tiles(iter(batches)) for r in b.to_pylist()}
    similar = {(i, j) for i in range(60) for j in range(i + 1, 60) if i % 7 != j % 7 and jaccard_join.similar(len(np.intersect1d(found[i], found[j])), len(found[i]), len(found[j]))}
    assert similar and similar <= got


def test_prefixes_of_similar_sets_meet():
    rng = random.Random(3)
    for _ in range(3000):
        n, extra = rng.randint(1, 40), rng.randint(0, 10)
        x = set(range(n))
        y = {i for i in x if rng.random() > 0.1} | {1000 + i for i in range(extra)}
        if y and jaccard_join.similar(len(x & y), len(x), len(y)):
            order = {t: rng.random() for t in x | y}
            first = [set(sorted(s, key=order.get)[: jaccard_join.prefix_length(len(s))]) for s in (x, y)]
            assert first[0] & first[1]


def test_shingles_equal_definition(monkeypatch):
    rng = random.Random(4)
    texts = corpus(rng, 60) + ["", " ", "é ß É", "a", "x" * 9000 + " y " * 30]
    names = {}
    for size in (64, 1 << 20):
        monkeypatch.setattr(shingles, "SLICE", size)
        got = [list(zip(*map(np.ndarray.tolist, shingles.shingle_set(np.frombuffer(t.encode(), np.uint8))), strict=True)) for t in texts]
        together = [list(zip(*map(np.ndarray.tolist, x), strict=True)) for x in shingles.shingle_sets(pa.array(texts))]
        assert got == together
        want = sets([(0, t) for t in texts])
        for g, w in zip(got, want, strict=True):
            assert len(g) == len(w)
        names[size] = got
    assert names[64] == names[1 << 20]
    for (g, w), (h, x) in zip(zip(got, want), zip(got[1:], want[1:]), strict=False):
        assert len(set(g) & set(h)) == len(w & x)
