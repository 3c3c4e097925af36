"""Odd inputs of the review path, of answers, coverage and lifecycle."""

import json

import pytest
from pyspark.sql import functions as F

from fluvial.operators import answers, coverage, fields, lifecycle, review


def card(n=1, **more):
    return {"front": f"What is {n}?", "back": f"It is {n}.", "source_excerpt": "it"} | more


CASES = [
    (json.dumps([card(1)]), "success", 1),
    (json.dumps({"cards": [card(i) for i in range(9)]}), "success", 5),
    ("```\n" + json.dumps([card(1), card(2)]) + "\n```", "success", 2),
    ("Well [sic]: " + json.dumps({"cards": [card(1)]}), "success", 1),
    (json.dumps({"cards": [card(1, source_excerpt="", rationale="why")]}), "success", 1),
    (json.dumps({"cards": [card(1), card(2, front="x" * 501)]}), "invalid_json", 0),
    (json.dumps({"cards": [card(1, back=None)]}), "invalid_json", 0),
    (json.dumps({"cards": [card(1, front=5)]}), "invalid_json", 0),
    (json.dumps({"cards": [[]]}), "invalid_json", 0),
    (json.dumps({"cards": {}}), "invalid_json", 0),
    (json.dumps({"other": [card(1)]}), "invalid_json", 0),
    ("[]", "empty_cards", 0),
    ("5", "invalid_json", 0),
    ("", "empty_output", 0),
    (None, "empty_output", 0),
    ("{" * 50, "invalid_json", 0),
]


def test_cards_of_answers(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(CASES)], "answer_id long, text string")
    got = answers.parse_cards(rows).groupBy("answer_id").agg(F.min("state").alias("state"), F.count("front").alias("n")).orderBy("answer_id").collect()
    assert [(r.state, r.n) for r in got] == [(s, n) for _, s, n in CASES]
    assert answers.parse_cards(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('[{"title": " a ", "explanation": "b", "tags": ["x", 5, " "]}]', [(None, "a", "medium", ["x", "5"])]),
        ('{"knowledge_points": [{"title": "a", "explanation": "b", "importance": "high"}]}', [(None, "a", "high", [])]),
        ("[]", []),
        ('{"knowledge_points": 5}', [("invalid_json", None, None, None)]),
        ('[{"title": "a", "explanation": " "}]', [("invalid_json", None, None, None)]),
        ("[1]", [("invalid_json", None, None, None)]),
        (None, [("invalid_json", None, None, None)]),
    ],
)
def test_points_of_answers(spark, text, want):
    got = answers.parse_points(spark.createDataFrame([(1, text)], "chunk_id long, text string")).collect()
    assert [(r.error, r.title, r.importance, r.tags) for r in got] == want


def test_basic_cards(spark):
    rows = spark.createDataFrame([(1, 0, "basic", "f", "b"), (1, 1, "basic", "f", "b"), (1, 2, "cloze", "f", "b"), (2, 0, "basic", "f", " "), (2, 1, "basic", "f", "b")], "answer_id long, card_ord int, card_type string, front string, back string")
    got = answers.basic_cards(rows, "answer_id", F.col("card_type"), 2).orderBy("answer_id", "card_ord").collect()
    assert [(r.answer_id, r.error) for r in got] == [(1, None), (1, None), (2, "card_validation"), (2, "card_validation")]


def test_case_of_excerpts(spark):
    cards = spark.createDataFrame([(1, 1, 1, "GROSSE  Straße")], "answer_id long, point_id long, chunk_id long, source_excerpt string")
    points = spark.createDataFrame([(1, 1)], "point_id long, chunk_id long")
    chunks = spark.createDataFrame([(1, "Die große\nSTRASSE.")], "chunk_id long, text string")
    assert answers.ground(cards, points, chunks).first().accepted


def test_selection(spark):
    points = spark.createDataFrame([(1, "a" * 200), (2, None)], "point_id long, explanation string")
    ids = spark.createDataFrame([(1,), (1,), (9,)], "point_id long")
    assert [r.point_id for r in review.select_points(points, ids).collect()] == [1]
    assert [r.point_id for r in review.unknown_ids(ids, points, "point_id").collect()] == [9]
    got = {r.point_id: (r.selected, len(r.preview)) for r in review.selection_preview(points, ids).collect()}
    assert got == {1: (True, 140), 2: (False, 0)}


def test_reorder_of_nothing(spark):
    points = spark.createDataFrame([(1, 10, 0), (1, 11, 1)], "run_id long, point_id long, point_ord int")
    none = spark.createDataFrame([(1, [])], "run_id long, point_ids array<long>")
    assert [(r.point_id, r.new_ord) for r in coverage.reorder(points, none).orderBy("new_ord").collect()] == [(10, 0), (11, 1)]


def test_card_limits(spark):
    assert {r.asked: r.card_limit for r in fields.card_limits(spark).collect()} == lifecycle.CARD_LIMITS
    row = spark.range(1).select(lifecycle.card_limit(F.lit(None).cast("string")).alias("a"), fields.append_material(F.lit(" "), F.lit("l"), F.lit("n")).alias("b")).first()
    assert (row.a, row.b) == (5, "n")


def test_scrubbed_keys(spark):
    m = F.create_map(*(F.lit(x) for x in ("Api-Key", "1", "AUTH orization", "2", "plain", "3", "x_token_y", "4")))
    assert spark.range(1).select(fields.scrubbed(m).alias("m")).first().m == {"plain": "3"}


def test_full_width_and_folded_cards_are_canonical_copies(spark):
    from fluvial.operators import cards

    rows = spark.createDataFrame([(1, 1, "What is Straße?", "A way!"), (2, 1, "Ｗｈａｔ　ｉｓ STRASSE", "a  way"), (3, 1, "What is C++?", "b"), (4, 1, "What is C?", "b")], "card_id long, section long, front string, back string")
    got = [tuple(r)[:3] for r in cards.deduplicate(rows).collect()]
    assert (2, 1, "canonical") in got and not any(r[0] == 4 and r[2] == "canonical" for r in got)


def test_html_keys(spark):
    from fluvial.functions.text import note_key

    rows = spark.createDataFrame([("<div>A &amp; B</div><script>x</script><p>&lt;c&gt;<br>d</p>",), ("a & b <C> D",), (None,)], "x string")
    assert [r[0] for r in rows.select(note_key(F.col("x"))).collect()] == ["a & b <c> d", "a & b d", ""]


def test_number_within(spark):
    from fluvial.staging import number_within

    rows = spark.createDataFrame([(i % 3 if i % 7 else None, i) for i in range(100)] + [(1, 5)], "k int, o long").repartition(5)
    got = number_within(rows, "k", ["o"], "n").collect()
    want = {}
    for r in sorted(got, key=lambda r: (str(r.k), r.o, r.n)):
        want[r.k] = want.get(r.k, -1) + 1
        assert r.n == want[r.k]
    assert len(got) == 101


def test_chunk_titles_and_bounds(spark):
    from fluvial.operators.planning import chunk_title

    rows = spark.createDataFrame([("# H\n\n- a | b\nrow", ["table"]), ("# H\n* one\ntwo", ["paragraph"]), ("only", ["table"])], "t string, k array<string>")
    assert [r[0] for r in rows.select(chunk_title(F.col("t"), F.col("k"))).collect()] == ["row", "one", "only"]


def test_text_reads_of_odd_bytes(spark):
    from fluvial.sources.importers import read_text

    cases = [b"\xff\xfe\x00\x00" + "hé".encode("utf-32-le"), b"\x00\x00\xfe\xff" + "hé".encode("utf-32-be"), b"\xff\xfea", b"a\r\nb\rc", b"\xff", b"", None, b" \n ", b"x" * 30, "é".encode() * 11]
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, content binary")
    got = [(r.text, r.encoding, r.error) for r in read_text(rows, "content", most_bytes=25, most_chars=10).orderBy("i").collect()]
    assert got == [("hé", "utf-32-le", None), ("hé", "utf-32-be", None), (None, None, "binary_file"), ("a\nb\nc", "utf-8", None), (None, None, "binary_file"), (None, None, "empty_file"), (None, None, "empty_file"), (None, None, "empty_file"), (None, None, "file_too_large"), (None, None, "document_too_complex")]


def test_files_in_order_and_first_rows(spark):
    from fluvial.operators import overview

    a, b = spark.createDataFrame([("s1", 1), ("s2", 2)], "section_id string, n int"), spark.createDataFrame([("s1", 3)], "section_id string, n int")
    rows = overview.in_file_order([a, b]).collect()
    assert len({r.section_id for r in rows}) == 3 and [r.file_ord for r in sorted(rows, key=lambda r: r.n)] == [0, 0, 1]
    assert [r.n for r in overview.first_rows(a, "n", 1).collect()] == [1]
    kept, removed = overview.without_flagged(a.withColumn("k", F.lit(1)), "k", F.col("n") == 1, invert=True)
    assert [r.n for r in kept.collect()] == [1] and removed.first().removed == 1
