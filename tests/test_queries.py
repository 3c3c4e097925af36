"""Each query that has SQL against the same in DuckDB."""

import math

import duckdb
import pytest

from fluvial.plans import answered, chunks, dedup, documents, lifecycles, notes, outcomes, queries, reviews, sections, stages, streams

QUERIES, ORACLES = queries.QUERIES | chunks.QUERIES | documents.QUERIES | reviews.QUERIES | outcomes.QUERIES | sections.QUERIES | notes.QUERIES | streams.QUERIES | dedup.QUERIES | answered.QUERIES | lifecycles.QUERIES | stages.QUERIES, queries.ORACLES | chunks.ORACLES | documents.ORACLES | reviews.ORACLES | outcomes.ORACLES | sections.ORACLES | notes.ORACLES | streams.ORACLES | dedup.ORACLES | answered.ORACLES | lifecycles.ORACLES | stages.ORACLES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6)
    return x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", ORACLES)
def test_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in got.select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(plain(v) for v in r) for r in want.fetchall()), key=repr)
    assert rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0 or name == "duplicate_decisions"


def _folder(tmp_path, **rows):
    """The smallest tables, some of them with other rows."""
    for t in TABLES:
        (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    for t, select in rows.items():
        (tmp_path / f"{t}.parquet").unlink()
        duckdb.connect().execute(f"COPY ({select}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def _same(spark, name, sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = c.execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    rows = sorted((tuple(r) for r in QUERIES[name](spark, sf).select(*columns).collect()), key=repr)
    assert rows == sorted((tuple(r) for r in want.fetchall()), key=repr) and rows


@pytest.mark.parametrize("name", ["model_cards", "model_points"])
def test_cuts_that_end_with_a_line_end(spark, tmp_path, name):
    """the 30th character of each text is a line end."""
    change = f"SELECT conv_id, turn, role, substr(text, 1, 29) || chr(10) || substr(text, 31) AS text FROM '{SF}/conversations.parquet'"
    _same(spark, name, _folder(tmp_path, conversations=change))


def test_large_files(spark, tmp_path):
    """a file of more than 200,000 bytes, damaged or with too many characters."""
    change = f"SELECT doc_id, CASE WHEN doc_id < 14 THEN repeat('ab cd ', 40000) ELSE text END AS text, lang, source, n_chars FROM '{SF}/documents.parquet'"
    _same(spark, "text_reads", _folder(tmp_path, documents=change))
