import random
import zlib

import pytest

from fluvial.llm import toxicity as t


def corpus(rng, n):
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 6)))
    out = []
    for i in range(n):
        sentences = [[word() for _ in range(rng.randint(3, 9))] for _ in range(rng.randint(1, 30))]
        bad = rng.random() < 0.2
        if bad:
            s = rng.choice(sentences)
            s[rng.randrange(len(s))] = rng.choice(["Grumbox", "vilkator", "schnorfling", "schnorfen"])
        out.append((i, ". ".join(" ".join(s) for s in sentences) + ".", int(bad)))
    return out


@pytest.fixture(scope="module")
def scored(spark):
    rows = corpus(random.Random(1), 1500)
    docs = spark.createDataFrame([(i, x, 1.0) for i, x, _ in rows] + [(9000, None, 1.0), (9001, "", 1.0), (None, "x", 1.0), (0, rows[0][1], 1.0), (9002, "clean words here. " * 20_000, 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    training = t.training_rows(docs, labels)
    assert not any(zlib.crc32(str(i).encode()) % 5 == 0 and [x, y] in [[r.text, r.toxic] for r in training] for i, x, y in rows[:50])
    return rows, docs, t.fit(training)


def test_held_out_accuracy(scored):
    rows, docs, model = scored
    got = {r.doc_id: r for r in t.score_documents(docs, model).collect() if r.doc_id is not None}
    assert len(got) == 1503 and t.score_documents(docs, model).count() == docs.count()
    fresh = [(got[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(r.held_out for r, _ in fresh)
    assert sum(r.predicted == y for r, y in fresh) / len(fresh) > 0.97
    assert got[9000].score == got[9001].score == 0 and all(0 <= r.score <= 1 for r in got.values())


def test_offending_sentences_are_found(scored):
    rows, docs, model = scored
    scorer = t.Scorer(model)
    hit = total = 0
    for _, text, y in rows[:300]:
        if y:
            found = scorer.score(text)[1]
            total += 1
            hit += any(w in text[a : a + n].lower() for a, n, _ in found for w in ("grumbox", "vilkator", "schnorf"))
    assert hit / total > 0.9


def test_stage_keeps_clean_rows(scored):
    rows, docs, model = scored
    kept = t.keep_clean(docs, model)
    assert kept.schema == docs.schema
    want = sorted(str(r.doc_id) for r in t.score_documents(docs, model).collect() if not r.predicted)
    assert sorted(str(r.doc_id) for r in kept.collect()) == want


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = t.fit(t.training_rows(docs, spark.createDataFrame([], "doc_id long, toxic int")))
    assert t.score_documents(docs, model).first().score == 0 and t.score_documents(docs.limit(0), model).count() == 0


def test_length_alone_is_not_toxic(scored):
    rows, docs, model = scored
    got = {r.doc_id: r for r in t.score_documents(docs.filter("doc_id = 9002"), model).collect()}
    assert got[9002].predicted == 0 and t.keep_clean(docs.filter("doc_id = 9002"), model).count() == 1
    rng, weak = random.Random(2), sorted(w for w in model.weights if w[0] != "=")
    scorer = t.Scorer(model._replace(weights=model.weights | {"=mild": 1.0}))
    word = lambda: "".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 6)))
    plain = "".join(" ".join(word() for _ in range(6)) + (" mild. " if i % 2 else ". ") for i in range(100_000))
    assert len(plain) > 3_000_000 and weak and scorer.score(plain)[0] < 0.5
    assert scorer.score(plain + "grumbox schnorfling.")[0] > 0.5


def test_long_labelled_rows_are_learnt_from(spark):
    ids = [i for i in range(20) if zlib.crc32(str(i).encode()) % 5][:10]
    docs = spark.createDataFrame([(i, f"{i} " * 20_000) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, toxic int")
    assert sorted(r.text[:2].strip() for r in t.training_rows(docs, labels)) == sorted(map(str, ids))
    few = t.training_rows(docs, labels, max_bytes=200_000)
    assert few and sum(len(r.text) for r in few) <= 200_000 and all(len(r.text) >= 40_000 for r in few)
    assert t.training_rows(docs, labels, max_bytes=1) == []


def test_scores_equal_brute_force(spark):
    """Noisy-or by its definition, in plain Python."""
    import math
    import re

    rng = random.Random(4)
    weights = {"=bad": 3.0, "bad": 1.5, "=awful": 2.0, "awf": 1.0, "=mild": 0.5, "goo": -2.0}
    model = t.Model(-4.0, weights)
    words = ["bad", "Bad", "badly", "awful", "awfully", "mild", "good", "plain", "x1", "é", "BAD!", "a"]
    texts = ["".join(rng.choice(words) + rng.choice([" ", " ", ". ", "! ", "\n", "? "]) for _ in range(rng.choice([0, 1, 5, 40, 300]))) for _ in range(120)] + [None, "", " ", "...", "bad " * 50_000]

    def brute(text):
        out = []
        for sentence in re.split(r"[.!?\n。！？]", text or ""):
            found = {w for w in re.findall(r"[^\W\d_]+", sentence.lower())}
            own = {w: sum(weights.get(f, 0) for f in ["=" + w] + [w[:n] for n in range(3, 9) if n < len(w)]) for w in found}
            if any(own.values()):
                out.append(1 / (1 + math.exp(4.0 - sum(own.values()))))
        return max([0, *out, 1 - math.prod(1 - s for s in out if s >= 0.1)]), sum(s >= 0.5 for s in out)

    docs = spark.createDataFrame([(i, x, 1, "a") for i, x in enumerate(texts)] + [(None, "bad", 1, "a"), (3, texts[3], 1, "a")], "doc_id long, text string, score int, held_out string")
    got = t.score_documents(docs, model).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        score, n = brute("bad" if r.doc_id is None else texts[r.doc_id])
        assert r.score == pytest.approx(score, abs=1e-9) and r.predicted == (score >= 0.5) and r.n_offending == n
