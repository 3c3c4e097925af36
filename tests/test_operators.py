import random
import re

from pyspark.sql import functions as F

from fluvial.functions import labels
from fluvial.operators import cards, chunking, critic, quality, render, routing, runs
from fluvial.plans import queries
from fluvial.sources import islands, paths
from fluvial.staging import new_path


def test_cuts_lose_nothing():
    rng = random.Random(1)
    for n in (0, 1, 50, 101, 400, 3000):
        text = "".join(rng.choice(["ab", " ", "\n", ". ", "。", "x" * 30, "\n\n"]) for _ in range(n))
        pieces = list(chunking.cuts(text, 40, 100))
        assert "".join(text[a:b] for a, b in pieces) == text
        assert all(b - a <= 102 for a, b in pieces)


def test_cut_prefers_paragraphs():
    text = "a" * 30 + "\n\n" + "b" * 6 + " " + "c" * 200
    assert list(chunking.cuts(text, 40, 100))[0] == (0, 32)


def test_blocks(spark):
    docs = spark.createDataFrame([(1, "\r\na \r\nb\n\n \n c  "), (2, ""), (3, None)], "doc_id long, text string")
    got = [(r.doc_id, r.block_ord, r.text, r.line_start, r.line_end) for r in islands.blocks(docs).orderBy("doc_id", "block_ord").collect()]
    assert got == [(1, 0, "a\nb", 2, 3), (1, 1, " c", 6, 6)]
    assert [r.text for r in islands.blocks(docs, "code").orderBy("block_ord").collect()] == ["a \nb", " c  "]


def test_json_paths(spark):
    rows = spark.createDataFrame([(1, '{"a.b": [1, {"c": null}], "d": "x"}'), (2, "NaN"), (3, "{")], "k long, j string")
    got = sorted((r.k, r.block_ord, r.text, r.error) for r in paths.json_blocks(rows, "k", "j").filter("error is null").collect())
    assert got == [(1, 0, "$.a\\.b[0] = 1", None), (1, 1, "$.a\\.b[1].c = null", None), (1, 2, "$.d = x", None)]
    assert paths.json_blocks(rows, "k", "j").filter("error is not null").count() == 2


def test_quality_rules_of_modes(spark):
    cases = [
        ("", "", "concept", ["empty_front", "empty_back"], 0.0, "blocked"),
        ("What is attention?", "A weighting of inputs.", "concept", [], 1.0, "ready"),
        ("Explain this content now?", "A weighting.", "concept", ["generic_front"], 0.88, "review"),
        ("Compare A", "One side only.", "compare_contrast", ["compare_card_missing_two_sides"], 0.88, "review"),
        ("How to brew tea?", "Boil water.", "process_steps", ["process_card_missing_order"], 0.88, "review"),
        ("How to brew tea?", "First boil, then pour.", "process_steps", [], 1.0, "ready"),
        ("What is F?", "F = m a", "formula_rule", ["formula_card_missing_condition"], 0.88, "review"),
        ("It?", "A thing.", "definition", ["short_front", "definition_card_missing_term"], 0.76, "review"),
        ("{{c1::x}} is y", "y", "cloze_candidate", ["unsupported_cloze"], 0.45, "blocked"),
        ("List steps?", "- a\n- b\n- c\n- d", "concept", ["multi_point_card", "too_many_bullets"], 0.78, "review"),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, front string, back string, mode string")
    got = quality.evaluate(rows, F.lit(""), F.col("mode")).orderBy("i").collect()
    assert [(r.rule_ids, r.score, r.status) for r in got] == [c[3:] for c in cases]


def test_added_issue_counts_once(spark):
    rows = quality.evaluate(spark.createDataFrame([("What is attention?", "A weighting.")], "front string, back string"), F.lit(""), F.lit("concept"))
    twice = quality.add_issue(quality.add_issue(rows, "duplicate_candidate", F.lit(True)), "duplicate_candidate", F.lit(True))
    assert [(r.rule_ids, r.score) for r in twice.collect()] == [(["duplicate_candidate"], 0.88)]


def canon(text):
    return "".join(c for c in text.lower() if c.isalnum() or c in "+=$<>|~^`")


def greedy(rows, threshold):
    def share(x, y):
        return len(x & y) / len(x | y) if x | y else 0.0

    kept, out = [], {}
    for i, section, front, back in sorted(rows):
        key = (canon(front), canon(back))
        words = set(re.findall("[a-z0-9_]{2,}", f"{front}\n{back}".lower()))
        whole = "\n".join(key)
        runs = {whole[k : k + 3] for k in range(len(whole) - 2)} or {whole}
        for j, s, f, b, k, w, r in kept:
            if (front, back) == (f, b):
                out[i] = (j, "exact", 1.0)
            elif key == k:
                out[i] = (j, "canonical", 1.0)
            elif s == section and max(share(words, w), share(runs, r)) >= threshold:
                out[i] = (j, "similar", round(max(share(words, w), share(runs, r)), 3))
            if i in out:
                break
        else:
            kept.append((i, section, front, back, key, words, runs))
    return out


def test_dedup_equals_greedy(spark):
    rng = random.Random(3)
    words = "cell wall energy light plant root".split()
    rows = []
    for i in range(120):
        front, back = (" ".join(rng.choice(words) for _ in range(rng.choice([4, 5, 6]))) + rng.choice(["", "?", "!"]) for _ in range(2))
        if i % 3 == 2:
            front, back = rows[rng.randrange(len(rows))][2:]
            front = rng.choice([front, front.upper(), front.replace(" ", "-"), front + " x"])
        rows.append((i, i % 4, front, back))
    rows += [(200, 1, "", ""), (201, 2, "", ""), (202, 1, "", ""), (203, 0, "a+b", "c"), (204, 1, "ab", "c")]
    got = cards.deduplicate(spark.createDataFrame(rows, "card_id long, section long, front string, back string"), 0.6).collect()
    want = greedy(rows, 0.6)
    assert {r.card_id: (r.matched_id, r.kind, r.similarity) for r in got} == want
    assert {k for _, k, _ in want.values()} == {"exact", "canonical", "similar"} and len(got) == len(want)


def test_structural_chunks(spark):
    def b(doc, section, path, at, kind, text, line):
        return (doc, section, path[-1] if path else None, path, at, kind, text, line, line)

    table = "h1\th2\n" + "\n".join(f"r{i}\t{i}" for i in range(30))
    rows = [
        b(1, 0, [], 0, "paragraph", "intro", 1), b(1, 1, ["A", "../x", "B"], 1, "heading", "B", 2), b(1, 1, ["A", "../x", "B"], 2, "paragraph", "same", 2),
        b(1, 1, ["A", "../x", "B"], 3, "paragraph", "see", 3), b(1, 1, ["A", "../x", "B"], 4, "code", "x = 1", 4), b(1, 1, ["A", "../x", "B"], 5, "table", table, 5),
        b(1, 2, [], 6, "list_item", "i", 6), b(1, 2, [], 7, "list_item", "j", 7), b(2, 0, [], 0, "paragraph", "word " * 60, 1), b(3, 0, ["h" * 200], 0, "paragraph", "x", 1), b(4, 0, [], 0, "paragraph", None, 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, section_ord int, heading string, heading_path array<string>, block_ord int, kind string, text string, line_start int, line_end int")
    got = chunking.structural_chunks(df, target=60, most=100).orderBy("doc_id", "sequence").collect()
    one = [r for r in got if r.doc_id == 1]
    assert [r.sequence for r in one] == list(range(len(one))) and len({r.chunk_id for r in got}) == len(got)
    assert [r.text for r in one[:3]] == ["intro", "# A > B\n\nB\n\nsame", "# A > B\n\nsee\n\nx = 1"]
    tables = [r.text.removeprefix("# A > B\n\n").split("\n") for r in one if r.block_kinds == ["table"]]
    assert all(t[0] == "h1\th2" for t in tables) and [x for t in tables for x in t[1:]] == table.split("\n")[1:]
    assert one[-1].text == "i\n\nj" and one[-1].block_ords == [6, 7]
    assert "".join(r.text for r in got if r.doc_id == 2) == "word " * 60
    assert [(r.error, r.text) for r in got if r.doc_id > 2] == [("heading_too_long", None), (None, "")]


def test_critic(spark):
    cases = [
        ("What is a cell?", "A small unit of life", "a small unit of life", None, None, False, "pass", []),
        ("What is a cell?", "Completely unrelated answer", "a small unit of life", "pass", None, False, "repair", ["source_not_grounded"]),
        ("What is a cell?", "Completely unrelated answer", "a small unit of life", "pass", None, True, "reject", ["source_not_grounded", "repair_failed_local_validation"]),
        ("", "A small unit of life", "a small unit of life", None, None, False, "repair", ["empty_front"]),
        ("What is a cell?", "A small unit of life", "", "flag", ["b", "a b", "b"], False, "flag", ["b"]),
        ("What is a cell?", "A small unit of life", "", "maybe", None, False, "flag", ["critic_output_invalid"]),
        ("What is a cell?", "A small unit of life", "", "repair", ["x"], True, "reject", ["x", "repair_limit_reached"]),
    ]
    rows = spark.createDataFrame([(i, *c[:6]) for i, c in enumerate(cases)], "i int, front string, back string, source string, verdict string, reasons array<string>, repaired boolean")
    rated = quality.evaluate(rows, F.col("source"), F.lit("concept"))
    got = critic.decide(rated, F.col("source"), F.col("verdict"), F.col("reasons"), F.col("repaired")).orderBy("i").collect()
    assert [(r.action, r.reason_codes) for r in got] == [c[6:] for c in cases]


def test_runs(spark):
    log = [(1, i, "standard", s) for i, s in enumerate(["planning", "generating", "completed", "reviewing", "repairing", "reviewing", "checking_coverage", "deduplicating", "completed", "failed"])]
    log += [(2, i, "fast", s) for i, s in enumerate(["planning", "generating", "reviewing", "repairing", None, "superseded", "planning"])]
    got = {r.run_id: tuple(r)[1:] for r in runs.stages(spark.createDataFrame(log, "run_id int, ord int, level string, stage string")).collect()}
    assert got == {1: ("completed", 8, 2), 2: ("superseded", 4, 3)}
    chunks = spark.createDataFrame([(1, "a", "succeeded"), (1, "b", "failed"), (2, "c", "pending"), (3, "d", "succeeded")], "run_id int, chunk_id string, state string")
    assert {r.run_id: r.status for r in runs.completion(chunks).collect()} == {1: "partial", 2: "running", 3: "completed"}
    assert runs.to_retry(chunks, chunks.limit(0)).count() == 1 and runs.to_retry(chunks, chunks).count() == 0
    calls = spark.createDataFrame([(1, i, "fast", p) for i, p in enumerate(["generate", "planner", "generate", "generate", "generate"])], "run_id int, ord int, level string, purpose string")
    assert [(r.call_number, r.error) for r in runs.reserve(calls).orderBy("ord").collect()] == [(1, None), (None, "call_not_allowed"), (2, None), (3, None), (None, "call_budget_exhausted")]
    values = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, None), (1, 5, "a")], "k int, o int, v string")
    assert [r.revision for r in runs.revisions(values, "k", "o", "v").orderBy("o").collect()] == [1, 1, 2, 2, 3]
    given = spark.createDataFrame([("a", None), ("b", "bad")], "chunk_id string, error string")
    assert {r.chunk_id: r.error for r in runs.outcomes(chunks.select("chunk_id"), given).collect()} == {"a": None, "b": "bad", "c": "generation_result_missing", "d": "generation_result_missing"}


def test_labels(spark):
    def row(expression, *values):
        return spark.range(1).select(*(expression(F.lit(v)).alias(f"c{i}") for i, v in enumerate(values))).first()

    assert list(row(labels.source_label, "/a/b\tc .md", "C:\\x\\y.txt", "..", "", None, "n" * 130)) == ["b c .md", "y.txt", "document", "document", "document", "n" * 120]
    assert list(row(labels.tag, " A_b  C!", "--", None, "x" * 60)) == ["a-b-c", "", "", "x" * 48]
    assert list(row(labels.clock, 5.9, 3599.0, 3600.0, -1.0, 360000.0)) == ["00:05", "59:59", "01:00:00", "00:00", "100:00:00"]
    assert list(row(labels.preview, " a  b ", "x" * 121)) == ["a b", "x" * 117 + "..."]
    assert list(row(labels.escaped, "a<b>\r\n'\"&")) == ["a&lt;b&gt;<br>&#x27;&quot;&amp;"]
    assert list(row(labels.split_tags, "a, b；a c")) == [["a", "b", "c"]]
    places = spark.createDataFrame([(2, None, None, None, 3, 5), (None, "S", "A1", 1, None, None), (None, None, None, None, 3, 5), (None, None, None, None, 4, 4), (None, None, None, None, None, None)], "page int, sheet string, cell_range string, row_start int, line_start int, line_end int").withColumn("row_end", F.col("row_start"))
    at = labels.locator(places.columns)
    assert [r.s for r in places.select(labels.shown(F.lit("f"), at).alias("s")).collect()] == ["f · page 2", "f · cell A1", "f · lines 3–5", "f · line 4", "f"]


def test_render(spark):
    blocks = [(1, 0, None, [], 0, "paragraph", "pre"), (1, 1, "H", ["T", "H"], 1, "heading", "H"), (1, 1, "H", ["T", "H"], 2, "code", "x\ny"), (1, 1, "H", ["T", "H"], 3, "quote", "q\nr"), (1, 1, "H", ["T", "H"], 4, "list_item", "i")]
    df = spark.createDataFrame(blocks, "doc_id int, section_ord int, heading string, heading_path array<string>, block_ord int, kind string, text string")
    assert render.plain_text(df).first().text == "pre\n\nH\nx\ny\nq\nr\ni"
    assert render.markdown(df).first().text == "pre\n\n## H\n\n```\nx\ny\n```\n\n> q\n> r\n\n- i"
    assert tuple(render.summary(df).first()) == (1, 2, 5, 11, {"code": 1, "heading": 1, "list_item": 1, "paragraph": 1, "quote": 1})


def test_signals_and_routes(spark):
    blocks = [(1, "paragraph", "A cell is a unit. First mix, then pour."), (1, "code", "x"), (1, "table", "a\tb"), (2, "paragraph", " "), (3, "heading", "细胞 相比 其他"), (4, "paragraph", None)]
    got = routing.signals(spark.createDataFrame(blocks, "doc_id int, kind string, text string"))
    rows = {r.doc_id: r for r in got.collect()}
    assert (rows[1].document_kind, rows[1].modes, rows[1].confidence) == ("mixed", ["code_understanding", "table_relationship", "process_steps", "definition", "concept"], 0.84)
    assert (rows[2].document_kind, rows[2].confidence, rows[2].language, rows[2].estimated_points, rows[4].document_kind) == ("empty", 0.25, "unknown", 0, "empty")
    assert (rows[3].document_kind, rows[3].modes, rows[3].language) == ("structured", ["compare_contrast", "concept"], "zh")
    route = lambda *a: [(r["mode"], r["template"], r["reason_code"], r["route_confidence"]) for r in routing.route(got.filter("doc_id in (1, 2)"), *a).orderBy("doc_id").collect()]
    none = F.lit(None).cast("string")
    assert route(none, none, F.lit(None).cast("array<string>")) == [("code_understanding", "concept", "auto.code", 0.84), ("concept", "concept", "auto.concept_fallback", 0.5)]
    assert route(F.lit("exam"), none, F.array(F.lit("table")))[0] == ("exam", "exam_answer", "explicit_mode", 1.0)
    assert route(F.lit("auto"), F.lit("Definition"), F.array(F.lit("table")))[1] == ("table_relationship", "compare_contrast", "auto.table", 0.92)
    levels = {r.level: (r.card_min, r.card_max, r.call_max, r.confirm) for r in routing.estimate(got.filter("doc_id = 1")).collect()}
    assert levels == {"fast": (2, 3, 3, False), "standard": (3, 4, 8, True), "deep": (3, 5, 12, True)}


def test_point_types_gate_and_replacement(spark):
    rows = spark.createDataFrame([(0, "A cell is a unit", ["code", "formula"]), (1, "cats versus dogs", ["paragraph"]), (2, "First mix, then pour", []), (3, "A cell is a unit", []), (4, "Cells", []), (5, "x", ["transcript"])], "i int, title string, kinds array<string>")
    got = rows.select("i", routing.point_type(F.col("title"), F.col("kinds")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == ["formula", "comparison", "process", "definition", "concept", "transcript"]
    rated = spark.createDataFrame([(1, ["empty_back", "long_back"]), (2, [])], "card_id int, rule_ids array<string>")
    assert [[tuple(i) for i in r.issues] for r in critic.as_gate(rated).orderBy("card_id").collect()] == [[("empty_back", "error"), ("long_back", "warning")], []]
    new = spark.createDataFrame([(2, None)], "card_id int, front string")
    old = spark.createDataFrame([(1, "a"), (2, "b")], "card_id int, front string")
    assert {r.card_id: r.front for r in runs.replaced(old, new, "card_id").collect()} == {1: "a", 2: None}


def test_cards_of_a_long_conversation_have_ids_of_their_own(spark):
    text = {(1, 10_006): "same ask here", (1, 10_007): "same reply there", (2, 6): "same ask here", (2, 7): "same reply there"}
    rows = [(c, t, ("user", "assistant")[t % 2], text.get((c, t), f"w{c}x{t} v{c}x{t}")) for c, n in ((1, 10_012), (2, 12)) for t in range(n)]
    folder = new_path(spark, "tables")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    late = lambda turn: -(1 << 62) - (1 << 31) - turn
    marked = queries.duplicate_cards(spark, folder).collect()
    assert len({r.card_id for r in marked}) == len(marked) == 5_012 and [r.card_id for r in marked if r.duplicate] == [20_006]
    notes = queries.existing_notes(spark, folder).collect()
    assert len(notes) == 5_012 and {r.card_id: r.note_id for r in notes if r.note_id is not None} == {20_000 + t: 20_000 + t for t in range(0, 12, 2)} | {late(10_006): 20_006}
    own = cards.from_conversations(spark.read.parquet(f"{folder}/conversations.parquet")).withColumn("section", F.lit(0))
    assert [tuple(r) for r in cards.numbered(cards.similar_pairs(own, 0.5), "first_id", "second_id").collect()] == [(late(10_006), 20_006, 1.0)]
    few = cards.from_conversations(spark.createDataFrame([r for r in rows if r[1] % 10_000 < 12 and (r[0] == 2 or r[1] > 9_999)], "conv_id long, turn long, role string, text string")).withColumn("section", F.lit(0))
    assert [(tuple(r.card_id), tuple(r.matched_id), r.kind) for r in cards.deduplicate(few).collect()] == [((2, 6), (1, 10_006), "exact")]
