"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the sigmoid of a bias and the weights of its words' features;
a document's score is the noisy-or of its sentences', 1 - prod(1 - s), over those of LEAST or more. The
many that score less say nothing together, so that length alone makes no text toxic; without any above, the highest
score of one sentence is the document's. Sentences without a feature score 0. Labels are known for documents only, and the
weights are fitted through the noisy-or, so the sentences that make a document toxic are found along the way.

The fit takes labelled documents of any length, those whose doc_id hashes lowest: at most MAX_ROWS of them, and each if
its whole text still fits into MAX_BYTES with those before it.
Scoring takes every document and its whole text, sentence by sentence.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluvial.staging import bounded_batches

MAX_ROWS, MAX_BYTES = 12_000, 24 << 20
#: A feature must be in so many toxic documents of the sample; so many features are kept.
MIN_TOXIC, MAX_FEATURES = 3, 4_000
#: A sentence of a lower score adds nothing to others.
LEAST = 0.1
FOLDS = 5
SENTENCE = re.compile(r"[^.!?\n。！？]+")
WORD = re.compile(r"[^\W\d_]+")
CACHED_WORDS = 400_000


class Model(NamedTuple):
    bias: float
    weights: dict[str, float]


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text, mod 5, is 0. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def features(word: str) -> list[str]:
    """The word in lower case, and its beginnings of 3 to 8 letters, as compounds share them."""
    return [f"={word}", *(word[:n] for n in range(3, min(8, len(word) - 1) + 1))]


def sentences(text: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words in lower case) of each sentence that has a word."""
    for m in SENTENCE.finditer(text):
        if words := WORD.findall(m[0].lower()):
            yield m.start(), m.end(), words


class Example(NamedTuple):
    text: str
    toxic: int


class Examples(Sequence):
    """Labelled texts in Arrow memory, of which one at a time becomes a Python string."""

    def __init__(self, table: pa.Table) -> None:
        self.texts, self.toxic = table["text"], table["toxic"].to_pylist()

    def __len__(self) -> int:
        return len(self.toxic)

    def __getitem__(self, i: int) -> Example:
        if i >= len(self):
            raise IndexError(i)
        return Example(self.texts[i].as_py(), self.toxic[i])

    def __iter__(self) -> Iterator[Example]:
        return (Example(t.as_py(), y) for t, y in zip(self.texts, self.toxic, strict=True))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Sequence[Example]:
    """(text, toxic) of the sample. Labels without a doc_id or a value take no part."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out(F.col("doc_id")))
    drawn = known.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_rows)
    few = F.broadcast(drawn)  # max_rows rows
    texts = docs.filter(F.length("text") > 0).select("doc_id", "text")
    sizes = texts.join(few, "doc_id").groupBy("doc_id").agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.count("*").alias("n"))
    taken, room, rows = [], max_bytes, 2 * max_rows
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # max_rows rows, without texts
        if r.bytes <= room and r.n <= rows:
            taken.append((r.doc_id,))
            room, rows = room - r.bytes, rows - r.n
    if not taken:
        return []
    ids = docs.sparkSession.createDataFrame(taken, sizes.select("doc_id").schema)
    return Examples(texts.join(F.broadcast(few.join(F.broadcast(ids), "doc_id")), "doc_id").orderBy("doc_id", "text").select("text", "toxic").toArrow())


def select_features(rows: Sequence[Example]) -> list[str]:
    """Features that set toxic documents apart most, by a log-likelihood ratio of their document counts."""
    toxic: Counter[str] = Counter()
    for text, y in rows:
        if y:
            toxic.update({f for _, _, words in sentences(text) for w in words for f in features(w)})
    counts = {f: [n, 0] for f, n in toxic.items() if n >= MIN_TOXIC}
    del toxic
    seen: dict[str, tuple[str, ...]] = {}
    for text, y in rows:
        if not y:
            found = set()
            if len(seen) > CACHED_WORDS // 4:
                seen.clear()
            for w in {w for _, _, words in sentences(text) for w in words}:
                if (own := seen.get(w)) is None:
                    own = seen[w] = tuple(f for f in features(w) if f in counts)
                found.update(own)
            for f in found:
                counts[f][1] += 1
    n1 = sum(1 for _, y in rows if y)
    n0 = len(rows) - n1

    def gain(f: str) -> float:
        a, b = counts[f]
        return a * math.log((a + 0.5) / (n1 + 1) / ((b + 0.5) / (n0 + 1)))

    return sorted((f for f in counts if gain(f) > 6), key=lambda f: (-gain(f), f))[:MAX_FEATURES]


def fit(rows: Sequence[Example], steps: int = 300, rate: float = 0.1, ridge: float = 2e-5) -> Model:
    """Weights by Adam on the noisy-or likelihood of document labels. Without both labels: a model that scores 0."""
    labels = np.array([bool(y) for y in (rows.toxic if isinstance(rows, Examples) else [y for _, y in rows])], float)
    if len(set(labels.tolist())) < 2:
        return Model(-math.inf, {})
    names = select_features(rows)
    index = {f: i for i, f in enumerate(names)}
    of_word: dict[str, tuple[int, ...]] = {}
    sent = 0
    doc_of, at, cols = array("q"), array("q"), array("q")
    for d, (text, _) in enumerate(rows):
        for _, _, words in sentences(text):
            own: list[int] = []
            for w in set(words):
                if (found := of_word.get(w)) is None:
                    found = of_word[w] = tuple(index[f] for f in features(w) if f in index)
                own += found
            if own:
                cols.extend(own)
                at.extend([sent] * len(own))
                doc_of.append(d)
                sent += 1
    y = labels
    del of_word
    cols_, at_, doc_ = (np.frombuffer(x, np.int64) if x else np.empty(0, np.int64) for x in (cols, at, doc_of))
    theta = np.append(np.full(len(names), 1.5), -6.0)
    m = v = np.zeros_like(theta)
    for t in range(1, steps + 1):
        z = theta[-1] + np.bincount(at_, theta[cols_], sent)
        s = 1 / (1 + np.exp(-z))
        none = np.bincount(doc_, -np.logaddexp(0, z), len(rows))  # log of prod(1 - s)
        p = -np.expm1(np.minimum(none, -1e-12))
        pull = np.where(y > 0, -np.exp(none) / p, 1.0)  # of the loss by each z, over its s
        dz = pull[doc_] * s
        grad = np.append(np.bincount(cols_, dz[at_], len(names)), dz.sum()) / len(rows)
        grad[:-1] += ridge * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Model(float(theta[-1]), {f: float(w) for f, w in zip(names, theta[:-1], strict=True)})


class Scorer:
    """Scores texts with a model, keeping the weights of words it has met, CACHED_WORDS at most."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def weight(self, word: str) -> float:
        if (w := self.known.get(word)) is None:
            if len(self.known) >= CACHED_WORDS:
                self.known.clear()
            w = self.known[word] = sum(self.model.weights.get(f, 0.0) for f in features(word))
        return w

    def score(self, text: str, least: float = 0.5) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's score, and (start, length, score) of the sentences that score `least` or more."""
        none, most, found, weight = 0.0, 0.0, [], self.weight
        for start, end, words in sentences(text):
            # each distinct feature counts once a sentence, as in the fit; words without weight are most of them
            heavy = [w for w in words if weight(w)]
            if not heavy:
                continue
            z = self.model.bias + sum(map(weight, set(heavy)))
            s = 1 / (1 + math.exp(-max(z, -700)))
            most = max(most, s)
            if s >= LEAST:
                none -= max(z, 0) + math.log1p(math.exp(-abs(z)))
            if s >= least:
                found.append((start, end - start, s))
        return min(1.0, max(most, -math.expm1(none))), found


SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_offending long, offending array<struct<start: long, length: long, score: double>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("score", pa.float64())]))


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted, n_offending, offending (places of sentences of 0.5 or more).

    Null and empty texts, and texts without a word, score 0. Repeated rows get equal scores; an empty table gives an
    empty result; other columns, and those named as the result's, are ignored. Texts of any length are scored whole.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # MAX_FEATURES weights

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer.score(t.as_py() or "") for t in batch["text"]]
            spans = [[{"start": a, "length": n, "score": s} for a, n, s in x] for _, x in found]
            columns = [batch["doc_id"], batch["held_out"], pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= 0.5) for s, _ in found], pa.int32()), pa.array([len(x) for _, x in found], pa.int64()), pa.array(spans, _SPANS)]
            yield pa.record_batch(columns, ["doc_id", "held_out", "score", "predicted", "n_offending", "offending"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, SCHEMA)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns, whatever their names.

    Null and empty texts and those without a word stay; equal texts go or stay together; texts of any length are scored
    whole; an empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t.as_py() or "")[0] < 0.5 for t in batch["text"]], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
