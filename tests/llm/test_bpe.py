"""Encoding against the vocabulary's own library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from fluvial.llm import bpe

PLAIN = Tokenizer.from_file(bpe.default_vocabulary())
SPEC = open(bpe.default_vocabulary(), encoding="utf-8").read()


def expected(text):
    return PLAIN.encode(text, add_special_tokens=False).ids


def words(rng, n):
    kinds = ["ab", "the", "é", "ß", "123", " ", "  ", "\n", "\t", "'s", "'", "!!", "##", "中文", "😀", "a" * 40, "9" * 30, " " * 50, "-" * 30, "<|endoftext|>", "don't", " "]
    return "".join(rng.choice(kinds) * rng.choice([1, 1, 1, 2, 9]) for _ in range(n))


@pytest.mark.parametrize("leaf", [64, 256])
def test_tree_equals_library(leaf):
    enc, rng = bpe.Encoder(SPEC, leaf), random.Random(leaf)
    for _ in range(120):
        text = words(rng, rng.choice([0, 1, 5, 60]))
        assert enc.encode(text).tolist() == expected(text)


@pytest.mark.parametrize("alphabet", ["ab", "etaoin shrdlu".replace(" ", ""), "0123456789", "!#'", " ", "\n ", "é中"])
def test_unsplit_runs(alphabet):
    enc, rng = bpe.Encoder(SPEC, 512), random.Random(1)
    for n in (511, 2000, 9000):
        text = "x " + "".join(rng.choice(alphabet) for _ in range(n)) + " y"
        assert enc.encode(text).tolist() == expected(text)
        assert enc.decode(enc.encode(text)) == text


def test_query_and_long_path(spark):
    rng = random.Random(5)
    rows = [(i, words(rng, 200)) for i in range(5)] + [(7, None), (8, ""), (9, "q" * 3000), (9, "q" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "text AS ids")
    for segment in (bpe.SEGMENT, 100):
        got = sorted(map(tuple, bpe.encode_documents(docs, segment=segment).collect()))
        want = []
        for i, t in rows:
            ids = expected(t or "")
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(PLAIN.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert got == sorted(want)
    assert bpe.encode_documents(docs.limit(0)).count() == 0


def test_digest_chunks():
    enc = bpe.Encoder(SPEC)
    ids = enc.encode("naïve 😀 中文 text " * 50)
    assert bpe.digests(enc, ids, step=3) == bpe.digests(enc, ids)


@pytest.mark.parametrize("alphabet", ["ab", "a", "acegikmo", "0", " ", "é中", "#-"])
def test_production_sizes_with_unsplit_runs(alphabet):
    """Runs of a million characters without a cut, between ordinary text, with the sizes of the query."""
    enc, rng = bpe.Encoder(SPEC), random.Random(alphabet)
    text = "It was said, that " + "".join(rng.choice(alphabet) for _ in range(1_000_000)) + " and so on, as it was. " * 3
    assert enc.encode(text).tolist() == expected(text)
    assert enc.joins["window"] > 0
    segments = [(b, a, enc.encode(t)) for b, a, t in enc.leaves(text, bpe.SEGMENT)]
    assert len(segments) > 10 and enc.join(segments, lambda x: x).tolist() == expected(text)


def test_window_grows_to_a_whole_side():
    """A run whose ids depend on where it begins: no short window will do."""
    for leaf in (16, 64):
        enc = bpe.Encoder(SPEC, leaf)
        for n in range(leaf, 9 * leaf, 7):
            for text in ("a" * n, " " * n + "x", "ab" * n, "-" * n + "\n" * n, "x" + "=" * n):
                assert enc.encode(text).tolist() == expected(text)
