import random
import re

import corpus_pipeline
from fluvial.llm import bpe, toxicity
from fluvial.staging import new_path


def test_stages_against_plain_python(spark):
    from test_jaccard_join import corpus, expected

    rng = random.Random(7)
    texts = corpus(rng, 90)
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)] + [(200 + i, texts[i].replace(" ", "  "), "en", "s", 1) for i in range(20)]
    rows += [(300 + i, f"zorgword {texts[i]}", "en", "s", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    folder = new_path(spark, "tables")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 300)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    model = toxicity.fit(toxicity.training_rows(docs, spark.read.parquet(f"{folder}/labels.parquet")))
    scorer = toxicity.Scorer(model)
    left = [(r[0], r[1]) for r in rows if scorer.score(r[1])[0] < 0.5]
    assert len(left) < len(rows)
    seen, once = set(), []
    for i, t in sorted(left):
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t)
        if key not in seen:
            once.append((i, t))
        seen.add(key)
    kept = {d for d, n, c in expected(once) if d == c}
    enc = bpe.Encoder(open(bpe.default_vocabulary(), encoding="utf-8").read())
    want = {i: len(enc.encode(t)) + 1 for i, t in once if i in kept}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.doc_tokens for r in got} == want
    assert sum(r.length for r in got) == sum(want.values())


def test_odd_rows_and_clashing_names(spark):
    """Null and empty texts and ids, repeated rows, a long text, an empty table, and columns named as the stages' own."""
    text = "one two three four five six seven"
    rows = [(1, None), (2, ""), (3, " "), (None, text), (None, None), (5, text), (5, text), (6, text + " "), (7, "w " * 60_000), (8, "a b"), (8, "a b c d e f g h i")]
    names = ["_key", "_sha", "key", "sha", "row", "a", "b", "kept", "goes", "start", "score", "_there"]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {', '.join(f'`{n}` string' for n in names)}"
    folder = new_path(spark, "tables")
    full = [(i, t, None, None, None, *([None] * len(names))) for i, t in rows]
    spark.createDataFrame(full, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    enc = bpe.Encoder(open(bpe.default_vocabulary(), encoding="utf-8").read())
    n = lambda t: len(enc.encode(t or "")) + 1
    # 2 has the text of 1 and of the row without an id; 5 has those of 6 and of the other
    want = sorted([(1, n("")), (3, n(" ")), (5, n(text)), (7, n("w " * 60_000)), (8, n("a b")), (8, n("a b c d e f g h i"))])
    # 3 and 1 differ by a blank; the kept row of 1, 2 and null is 1
    docs = {}
    for r in got:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length))
    assert sorted(docs) == want
    assert all(sum(x for _, x in p) == k[1] for k, p in docs.items())
    spark.createDataFrame([], schema).write.parquet(f"{folder}/none/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/none/labels.parquet")
    assert corpus_pipeline.run(spark, f"{folder}/none").count() == 0
