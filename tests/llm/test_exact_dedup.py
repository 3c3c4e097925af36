import hashlib
import re
from collections import Counter, defaultdict

import pytest

from fluvial.llm import exact_dedup

ROWS = [(5, "a  b"), (3, "a\tb"), (9, "a b"), (4, " a b"), (7, None), (2, ""), (8, "  "), (None, "n"), (None, "n"), (1, "r"), (1, "r"), (1, "R"), (6, "long " * 50_000), (10, "a b")]


def expected(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        kept = 0
        for i in sorted(ids, key=lambda i: (i is None, i or 0)):
            out[(i, keep, len(ids), kept == 0, hashlib.sha256(text.encode()).hexdigest())] += 1
            kept += 1
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_groups(spark, monkeypatch, hot):
    rows = ROWS + [(100 + i, "hot") for i in range(1500)] * (2 if hot else 1)
    if hot:
        rows += [(5000 + i, f"u{i}") for i in range(20)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, keep_id string, kept long").repartition(5)
    got = Counter(tuple(r) for r in exact_dedup.exact_groups(docs).collect())
    assert got == expected(rows)
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def test_one_digest_two_texts(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    source = docs.select("doc_id", exact_dedup.normalized(docs.text).alias("_text")).selectExpr("*", "unhex(sha2(_text, 256)) AS sha")
    assert Counter(tuple(r) for r in exact_dedup._by_text(source).collect()) == expected(ROWS)


def test_keep_first(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in ROWS], "doc_id long, text string, kept string")
    got = Counter((r.doc_id, re.sub(r"\s+", " ", r.text or "")) for r in exact_dedup.keep_first(docs).collect())
    want = Counter()
    for (i, _, _, kept, sha), n in expected(ROWS).items():
        if kept:
            text = next(re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ROWS if hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() == sha)
            want[(i, re.sub(r"\s+", " ", text))] += n
    assert got == want and exact_dedup.keep_first(docs).columns == docs.columns


def test_keep_first_with_clashing_names(spark):
    """Columns named as the operator's own, in any case, and a null in them."""
    names = ["_key", "_sha", "key", "sha", "row", "keep_id", "_text", "_salt", "kept"]
    docs = spark.createDataFrame([(i, t, *([None] * len(names))) for i, t in ROWS], f"doc_id long, text string, {', '.join(f'`{n}` string' for n in names)}")
    got = exact_dedup.keep_first(docs)
    assert got.columns == docs.columns
    plain = exact_dedup.keep_first(docs.select("doc_id", "text"))
    norm = lambda rows: Counter((r.doc_id, re.sub(r"\s+", " ", r.text or "")) for r in rows)
    assert norm(got.collect()) == norm(plain.collect())
    assert exact_dedup.keep_first(docs.limit(0)).count() == 0


def test_two_texts_of_one_digest_take_the_slow_way(spark, monkeypatch):
    """Every text gets the same digest, so groups must come from the texts alone."""
    real = exact_dedup.F.sha2
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda column, bits: real(exact_dedup.F.lit("x"), bits))
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = Counter(tuple(r)[:4] for r in exact_dedup.exact_groups(docs).collect())
    want = Counter()
    for k, n in expected(ROWS).items():
        want[k[:4]] += n
    assert got == want


def test_no_python_in_plan(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    plan = exact_dedup.exact_groups(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
