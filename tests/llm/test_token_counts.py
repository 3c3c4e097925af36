from collections import Counter

from fluvial.llm import bpe, token_counts
from fluvial.staging import new_path


def totals(rollup):
    return {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens, r.n_bytes) for r in rollup.totals().collect()}


def test_rollup(spark):
    rows = [(1, "one two", "en", "a"), (2, "drei", "de", "a"), (3, None, None, None), (4, "", "en", "b"), (1, "one two", "en", "a"), (5, "é" * 5000, "fr", "b")]
    docs = spark.createDataFrame([(i, t, g, s, 7) for i, t, g, s in rows], "doc_id long, text string, lang string, source string, n_tokens long")
    counts = token_counts.count_tokens(docs, "v1")
    enc = bpe.Encoder(open(bpe.default_vocabulary(), encoding="utf-8").read())
    want = {}
    for _, t, g, s in rows:
        n = Counter(dict(zip("dtb", want.get((s, g, "v1"), (0, 0, 0)), strict=True)))
        want[(s, g, "v1")] = (n["d"] + 1, n["t"] + len(enc.encode(t or "")), n["b"] + len((t or "").encode()))
    rollup = token_counts.Rollup(spark, new_path(spark, "rollup"))
    assert totals(rollup) == {}
    rollup.commit("b1", token_counts.inserts(counts))
    assert totals(rollup) == want
    rollup.commit("b1", token_counts.inserts(counts))  # a batch again
    assert totals(rollup) == want
    gone = counts.filter("doc_id = 2")
    rollup.commit("b2", token_counts.deletes(gone))
    rollup.commit("b2", token_counts.deletes(gone))
    del want[("a", "de", "v1")]
    assert totals(rollup) == want
    old = counts.filter("doc_id = 5")
    rollup.commit("b3", token_counts.revisions(old, old.selectExpr("doc_id", "source", "lang", "n_tokens + 10 AS n_tokens", "n_bytes", "'v2' AS tokenizer_version")))
    d, t, b = want.pop(("b", "fr", "v1"))
    want[("b", "fr", "v2")] = (d, t + 10, b)
    assert totals(rollup) == want
    rollup.commit("b4", token_counts.inserts(counts.limit(0)))
    assert totals(token_counts.Rollup(spark, rollup.path)) == want
    assert rollup.compact() and totals(rollup) == want
    rollup.commit("b1", token_counts.inserts(counts))
    assert totals(rollup) == want


def test_a_batch_again_with_nothing_left(spark):
    docs = spark.createDataFrame([(1, "one two", "en", "a"), (2, "drei", "de", "a")], "doc_id long, text string, lang string, source string")
    counts = token_counts.count_tokens(docs, "v1")
    rollup = token_counts.Rollup(spark, new_path(spark, "rollup"))
    rollup.commit("b1", token_counts.inserts(counts))
    rollup.commit("b2", token_counts.inserts(counts.filter("doc_id = 1")))
    rollup.commit("b2", token_counts.inserts(counts.limit(0)))
    assert totals(rollup) == {("a", "en", "v1"): (1, 2, 7), ("a", "de", "v1"): (1, 3, 4)}
    rollup.commit("b1", token_counts.inserts(counts.filter("doc_id = 2")))
    assert totals(rollup) == {("a", "de", "v1"): (1, 3, 4)}


def test_query_equals_a_recount(spark):
    from fluvial.llm.queries import op6_token_counts

    rows = [(i, t, g, s) for i, (t, g, s) in enumerate([("one two", "en", "a"), ("one two", "en", "a"), (None, None, None), ("", "en", None), ("é" * 300, "fr", "b"), ("x " * 9000, "fr", "b")])] + [(0, "one two", "en", "a")]
    folder = new_path(spark, "tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS n_docs", "2 AS batch_id").write.parquet(f"{folder}/documents.parquet")
    enc = bpe.Encoder(open(bpe.default_vocabulary(), encoding="utf-8").read())
    want = {}
    for _, t, g, s in rows:
        d, n, b = want.get((s, g, "byte_bpe_50k"), (0, 0, 0))
        want[(s, g, "byte_bpe_50k")] = (d + 1, n + len(enc.encode(t or "")), b + len((t or "").encode()))
    got = op6_token_counts(spark, folder).collect()
    assert {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens, r.n_bytes) for r in got} == want
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/none/documents.parquet")
    assert op6_token_counts(spark, f"{folder}/none").count() == 0
