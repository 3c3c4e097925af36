import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from fluvial.llm import minhash, shingles
from fluvial.llm.queries import op11_minhash_dedup


def sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    return out


def expected(rows):
    s = sets(t for _, t in rows)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 85 * len(s[i] | s[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    label = [least.get(find(i)) if s[i] else d for i, (d, _) in enumerate(rows)]
    return sorted(((d, len(s[i]), label[i], d == label[i]) for i, (d, _) in enumerate(rows)), key=repr)


def corpus(rng, n):
    word = lambda: "".join(rng.choice("abcdef") for _ in range(rng.choice([2, 3, 4])))
    passage = [word() for _ in range(30)]
    base = [[word() for _ in range(rng.choice([2, 4, 8, 20, 60, 150]))] for _ in range(n // 8)]
    out = []
    for _ in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            w[rng.randrange(len(w))] = word()
        if rng.random() < 0.2:
            w = w + passage
        out.append(rng.choice([" ", "  ", "\n"]).join(w))
    return out


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, n_shingles string, sid int").repartition(3)
    return sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=repr)


@pytest.mark.parametrize("seed,tile", [(2, 4)])
def test_components(spark, monkeypatch, seed, tile):
    monkeypatch.setattr(minhash, "TILE", tile)
    texts = corpus(random.Random(seed), 260)
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts)] + [(2000, None), (2001, ""), (2002, " \n"), (2003, "A b"), (2004, "a  B"), (None, "a b"), (None, None), (2005, texts[0]), (2005, texts[0]), (2006, "w " * 40_000), (2007, " ".join(map(str, range(30_000)))), (2008, " ".join(map(str, range(30_100))))]
    assert run(spark, rows) == expected(rows)


def test_chains_around_an_odd_first_set(spark):
    """Sets of a bucket whose first one is similar to none, while the others are one chain of near copies."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    rows = [(0, " ".join(base[:95] + [f"q{i}" for i in range(16)]))]
    for i in range(1, 60):
        at = rng.randrange(120)
        base = base[:at] + [f"x{i}"] + base[at + 1 :]
        rows.append((i, " ".join(base)))
    assert run(spark, rows) == expected(rows)


def test_large_group_of_near_copies_without_all_pairs(spark, monkeypatch):
    from fluvial import staging

    monkeypatch.setattr(staging, "hot_groups", lambda spark: 10**9)
    monkeypatch.setattr(staging, "LEAST_HOT", 100)
    seen = []
    whole = minhash._links
    monkeypatch.setattr(minhash, "_links", lambda pairs, *a: seen.append(pairs.count()) or whole(pairs, *a))
    rows = [(i, " ".join(f"w{j}" for j in range(60)) + f" x{i % 500}") for i in range(2000)]
    assert {r[1:3] for r in run(spark, rows)} == {(59, 0)}
    assert sum(seen) < 500 * minhash.BANDS


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, None), (4, "")]) == [(3, 0, 3, True), (4, 0, 4, True)]


def test_stars_of_paths_hubs_and_circles(spark):
    rng = random.Random(1)
    for edges in ([(i, i + 1) for i in range(300)], [(0, i) for i in range(1, 200)], [(i, (i + 1) % 50) for i in range(50)], [(rng.randrange(400), rng.randrange(400)) for _ in range(250)]):
        mixed = list(range(500))
        rng.shuffle(mixed)
        edges = [(mixed[a], mixed[b]) for a, b in edges if a != b]
        root = {x: x for e in edges for x in e}

        def find(x):
            while root[x] != x:  # noqa: B023
                x = root[x]  # noqa: B023
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        want = {(x, find(x)) for x in root if find(x) != x}
        got = [tuple(r) for r in minhash.components(spark.createDataFrame(edges, "x long, y long")).collect()]
        assert len(got) == len(want) and set(got) == want


def test_minima_estimate_similarity():
    rng = np.random.default_rng(0)
    by = minhash.multipliers(bytes(range(16)))
    for share in (0.5, 0.85):
        x = rng.integers(0, 1 << 64, 2000, np.uint64)
        k = int(2000 * 2 * share / (1 + share))
        y = np.concatenate([x[:k], rng.integers(0, 1 << 64, 2000 - k, np.uint64)])
        found = minhash.minima([x, y, x[:1]], by)
        assert abs((found[0] == found[1]).mean() - share) < 0.12
        assert (found[2] == ((x[0] * by) >> np.uint64(32))).all()
        for one in (1, 50, 10**6):
            assert (minhash.minima([x, y], by) == found[:2]).all(), one
    keys = minhash.band_keys(found)
    assert keys.shape == (3, minhash.BANDS) and len(np.unique(keys[0])) == minhash.BANDS
    assert minhash.minima([], by).shape == (0, minhash.MINIMA)


def test_bits_never_exclude_a_link():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        x = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        y = np.unique(np.concatenate([x[rng.random(len(x)) > 0.08], rng.integers(0, 1 << 64, int(rng.integers(0, 20)), np.uint64)]))
        if len(y) and minhash.similar(len(np.intersect1d(x, y)), len(x), len(y)):
            same = np.zeros((1, minhash.MINIMA), np.uint8)
            assert minhash._may_link(same, same, np.array([len(x)]), np.array([len(y)]), [shingles.bitmap(x).tobytes()], [shingles.bitmap(y).tobytes()]).all()


def test_tiles_that_batches_cut():
    """Each tile is compared once, however batches fall, and its links connect what is similar."""
    rng = np.random.default_rng(1)
    rows = []
    for k in range(4):
        base = np.sort(rng.integers(0, 1 << 64, 60, np.uint64))
        for i in range(8):
            own = np.sort(np.concatenate([base[: 60 - 4 * (i % 4)], rng.integers(0, 1 << 64, 4 * (i % 4), np.uint64)]))
            rows.append({"key": k, "i": 0, "j": 0, "block": 0, "sid": 10 * k + i, "label": 100 + 10 * k + i // 2, "n": 60, "sig": bytes(minhash.MINIMA), "bits": shingles.bitmap(own).tobytes(), "keys": [k, 7, 8], "shingles": own.tobytes()})
    table = pa.Table.from_pylist(rows)
    assert list(minhash._tiles(iter(pa.Table.from_pylist([{**r, "keys": [9, r["key"]]} for r in rows]).to_batches()))) == []  # their first common key is another

    def groups(links):
        root = {r["sid"]: r["label"] for r in rows}
        for x, y in links:
            a, b = root[x], root[y]
            root = {s: min(a, b) if g in (a, b) else g for s, g in root.items()}
        return root

    sets = {r["sid"]: np.frombuffer(r["shingles"], np.uint64) for r in rows}
    want = groups([(x, y) for x in sets for y in sets if x // 10 == y // 10 and x < y and minhash.similar(len(np.intersect1d(sets[x], sets[y])), 60, 60)])
    assert 4 < len(set(want.values())) < 16
    for size in (1, 5, 6, 7, 100):
        got = [(r["x"], r["y"]) for b in minhash._tiles(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert groups(got) == want and len(got) < 4 * 4


def test_sets_of_the_largest_component_do_not_meet(spark, monkeypatch):
    """Every pair of different components meets in one tile, and a large component's rows grow no faster than its sets."""
    monkeypatch.setattr(minhash, "TILE", 8)
    monkeypatch.setattr(minhash, "TILE_SHINGLES", 400)
    rng = random.Random(6)
    labels = {1: [0] * 600 + [*range(1, 7)], 2: [0, 0, 1], 3: [rng.randrange(5) for _ in range(40)], 4: list(range(20))}
    rows = [(key, 1000 * key + at, 30, label) for key, own in labels.items() for at, label in enumerate(own)]
    dealt = minhash._dealt(spark.createDataFrame(rows, "key long, sid long, n long, label long")).collect()
    assert all(r.block in (r.i, r.j) for r in dealt)
    met = {}
    tiles = {}
    for r in dealt:
        tiles.setdefault((r.key, r.i, r.j), []).append(r)
    for (key, i, j), own in tiles.items():
        for at, a in enumerate(own):
            for b in own[at + 1 :]:
                if a.label != b.label and (i == j or a.block != b.block):
                    pair = (min(a.sid, b.sid), max(a.sid, b.sid))
                    met[pair] = met.get(pair, 0) + 1
    assert met == {(a[1], b[1]): 1 for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and a[3] != b[3]}
    assert sum(r.key == 1 for r in dealt) < 2 * len(labels[1])


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = op11_minhash_dedup(spark, sf)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = c.execute(minhash.ORACLE)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
