import hashlib
import math
import random
from collections import defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from fluvial.llm import vector_codes
from fluvial.llm.queries import op13_vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, dim string, code int, vector int"


def expected(rows):
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v] + [0] * (-len(v) % 16), len(v), label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, totals = [], defaultdict(int)
    for dim in {k[2] for k in kept}:
        own = [k for k in kept if k[2] == dim]
        p = len(own[0][1]) // 16
        cut = lambda v: [v[i * p : (i + 1) * p] for i in range(16)]  # noqa: B023, E731
        first = sorted(own, key=lambda k: (k[0] is None, k[0] or 0, k[1]))[:64]
        books = [[cut(k[1])[i] for k in first] for i in range(16)]

        def best(part, i):
            return min((sum((a - b) ** 2 for a, b in zip(part, c, strict=True)), e) for e, c in enumerate(books[i]))  # noqa: B023

        for _ in range(2):
            sums = defaultdict(list)
            for k in own:
                for i, part in enumerate(cut(k[1])):
                    sums[i, best(part, i)[1]].append(part)
            for (i, e), parts in sums.items():
                books[i][e] = [sum(x) // len(parts) for x in zip(*parts, strict=True)]
        h = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
        for k in own:
            found = [best(part, i) for i, part in enumerate(cut(k[1]))]
            error = sum(f for f, _ in found)
            totals[k[3]] += min(error, vector_codes.MOST)
            out.append((k[0], "".join(f"{e:02x}" for _, e in found), min(error, vector_codes.MOST), k[3], h))
    return sorted(((i, c, e, min(totals[label], vector_codes.MOST), h) for i, c, e, label, h in out), key=repr)


def run(spark, rows):
    df = spark.createDataFrame([(i, v, label, "x", 1, 2) for i, v, label in rows], SCHEMA)
    return sorted(map(tuple, vector_codes.product_codes(df).collect()), key=repr)


def test_against_plain_python(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(150), [rng.choice([-1.0, 0.0, 0.25, 0.5, rng.gauss(0, 1)]) for _ in range(32)], rng.choice([None, 1, 1, 2])) for _ in range(200)]
    rows += [(1, [1.0] * 32, 1)] * 60  # a third of all rows are one
    rows += [(300, None, 1), (301, [None] * 32, 1), (302, [math.nan] * 32, 1), (303, [math.inf] + [0.0] * 31, 2), (None, [0.5] * 32, None), (304, [], 3), (305, [], 3)]
    rows += [(400 + i, [rng.gauss(0, 1) for _ in range(20)], 4) for i in range(9)]  # not a multiple of 16
    assert run(spark, rows) == expected(rows)


def test_numbers_beyond_a_long(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([1.7e308, -1e300, 3e38, 1.5, 2.0**60 + 2.0**12, 1e9]) for _ in range(16)], i % 2) for i in range(40)]
    assert run(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, None, 1)]) == []


@pytest.mark.parametrize("scale", [3, 50, 2**22, 2**27])
def test_screening_keeps_the_nearest(scale):
    """Near ties far from the origin, where float32 can't tell entries apart."""
    rng = np.random.default_rng(scale)
    book = scale * 4 + rng.integers(-2, 3, (64, 4))
    x = scale * 4 + rng.integers(-3, 4, (500, 4))
    at, far = vector_codes.nearest(x, book)
    every = ((x[:, None] - book) ** 2).sum(axis=2)
    assert (far == every.min(axis=1)).all() and (at == every.argmin(axis=1)).all()
    wrong = np.argmin((book.astype(np.float32) ** 2).sum(1) - 2 * (x.astype(np.float32) @ book.astype(np.float32).T), axis=1)
    assert scale < 2**20 or (wrong != at).any()
    assert len(vector_codes.candidates(x, book)[0]) < 500 * 64 or scale > 2**20


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    got = op13_vector_codes(spark, sf)
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = c.execute(vector_codes.ORACLE)
    assert [d[0] for d in want.description] == got.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
