"""Product codes of vectors: each vector's parts as indices into codebooks that are fitted on all vectors, in exact integers.

Each task screens a block of parts against a codebook with one float32 matrix product. A product of rounded numbers is off
by at most gamma(p + 3) * |x| * |c|, in whatever order it is summed, so every score |c|^2 - 2xc lies in a known interval.
Entries whose interval overlaps that of the best one are evaluated again in int64, and ties go to the lower index. A
score that isn't finite excludes nothing. Numbers too large for sums of squares in int64 are held as Python integers.

A round is one pass over the table. Each task sums the parts of each entry; these sums, not rows, are shuffled and added.
Only codebooks (64 entries) pass the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluvial.staging import bounded_batches, join_skewed, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows that meet a codebook at once.
BLOCK = 4_096
#: The largest long; greater errors are given as this.
MOST = 2**63 - 1
_UNIT32, _UNIT64 = 2.0**-24, 2.0**-53

#: A length's codebooks: an array (entries, length of a part) for each part.
Books = dict[int, list[np.ndarray]]


def whole(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) of rows of numbers as (rows, parts, length of a part): int64, or Python integers where sums of squares could pass int64.

    A length that isn't a multiple of the number of parts is filled up with zeros.
    """
    x = np.pad(x, ((0, 0), (0, -x.shape[1] % PARTS)))
    x = x.reshape(len(x), PARTS, x.shape[1] // PARTS)
    if x.size == 0 or np.abs(x).max() < (2.0**62 / (4 * PARTS * x.shape[2])) ** 0.5 / SCALE - 1:
        return np.floor(x * SCALE).astype(np.int64)
    out = np.empty(x.shape, object)
    out.ravel()[:] = [int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in x.ravel().tolist()]
    return out


def _floats(x: np.ndarray) -> np.ndarray:
    """In float64; integers beyond it are infinite."""
    if x.dtype != object:
        return x.astype(np.float64)
    return np.array([float(v) if abs(v) < 2**1023 else np.inf for v in x.ravel().tolist()], np.float64).reshape(x.shape)


def _norms(x: np.ndarray) -> np.ndarray:
    """Upper bounds of the rows' lengths."""
    return np.sqrt((x**2).sum(axis=1)) * (1 + (x.shape[1] + 4) * 2 * _UNIT64)


def candidates(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, entry) of all entries that may be nearest by the intervals of their scores, in order; at least one a row."""
    p = x.shape[1]
    x, book = _floats(x), _floats(book)
    with np.errstate(over="ignore", invalid="ignore"):
        dot = (x.astype(np.float32) @ book.astype(np.float32).T).astype(np.float64)
        score = (book**2).sum(axis=1) - 2 * dot
        n = (p + 3) * _UNIT32
        longest = _norms(book).max()
        both = _norms(x) * longest
        # 2xc in float32 (from float64, rounded twice at most), then |c|^2, the subtraction and the sums below in float64
        off = (2 * n / (1 - n) * both if n < 0.5 else np.inf) + (p + 8) * 2 * _UNIT64 * (longest**2 + 4 * both)
        bound = score.min(axis=1) + 2 * off
        bound += np.abs(bound) * 4 * _UNIT64
        keep = score <= bound[:, None]
        keep[~np.isfinite(score).all(axis=1) | ~np.isfinite(bound)] = True
    return np.nonzero(keep)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry (ties to the lower one) and its squared distance, exactly."""
    rows, entries = candidates(x, book)
    if x.dtype == object or book.dtype == object:
        x, book = x.astype(object), book.astype(object)
    off = x[rows] - book[entries]
    far = (off * off).sum(axis=1) if x.shape[1] else np.zeros(len(rows), np.int64)
    starts = np.searchsorted(rows, np.arange(len(x)))
    best = np.flatnonzero(far == np.minimum.reduceat(far, starts)[rows])
    first = best[np.unique(rows[best], return_index=True)[1]]
    return entries[first], far[first]


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, values as whole numbers) of blocks of a batch's vectors of one length."""
    lists = batch["vector"]
    ends = lists.offsets.to_numpy()
    values, lengths = lists.values.to_numpy(), np.diff(ends)
    for dim in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == dim)
        for k in range(0, len(at), BLOCK):
            some = at[k : k + BLOCK]
            yield dim, some, whole(values[ends[some][:, None] + np.arange(dim)])


def _sums(vectors: DataFrame, books: Books) -> Books:
    """The codebooks after a round: each entry is the floor of the mean of its parts, or as it was if it has none."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int, int], list] = {}
        for batch in batches:
            for dim, _, x in _blocks(batch):
                for part in range(PARTS):
                    at = nearest(x[:, part], books[dim][part])[0]
                    order = np.argsort(at, kind="stable")
                    used, starts, n = np.unique(at[order], return_index=True, return_counts=True)
                    sums = np.add.reduceat(x[order, part], starts, axis=0) if x.shape[2] else np.zeros((len(used), 0), np.int64)
                    for entry, k, s in zip(used.tolist(), n.tolist(), sums.tolist(), strict=True):
                        own = total.setdefault((dim, part, entry), [0, [0] * len(s)])
                        own[0] += k
                        own[1] = [a + b for a, b in zip(own[1], s, strict=True)]
        yield _partial([(*key, n, [str(v) for v in s]) for key, (n, s) in total.items()])

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            for k, s in zip(batch["n"].to_pylist(), batch["sums"].to_pylist(), strict=True):
                n += k
                s = list(map(int, s))
                sums = s if sums is None else [a + b for a, b in zip(sums, s, strict=True)]
        yield _partial([(*(k.as_py() for k in key), n, [str(v) for v in sums])])

    schema = "dim int, part int, entry int, n long, sums array<string>"
    found = vectors.select("vector").mapInArrow(add_up, schema).groupBy("dim", "part", "entry").applyInArrow(merge, schema)
    after = {dim: [[row.tolist() for row in book] for book in parts] for dim, parts in books.items()}
    for r in found.collect():  # a row an entry
        after[r.dim][r.part][r.entry] = [int(s) // r.n for s in r.sums]
    return {dim: [_array(book) for book in parts] for dim, parts in after.items()}


def _partial(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * 5
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["dim", "part", "entry", "n", "sums"])


def _array(book: list[list[int]]) -> np.ndarray:
    most = max((abs(v) for row in book for v in row), default=0)
    return np.array(book, np.int64 if most < 2**30 else object).reshape(len(book), len(book[0]))


def _first_books(vectors: DataFrame) -> Books:
    """For each length, the parts of the vectors with the smallest ids. A table has few lengths, mostly one."""
    books = {}
    for (dim,) in vectors.select(F.size("vector").alias("dim")).distinct().collect():
        of_dim = vectors.filter(F.size("vector") == dim)
        rows = of_dim.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
        x = whole(np.array([r.vector for r in rows], np.float64).reshape(len(rows), dim))
        books[dim] = [_array(x[:, part].tolist()) for part in range(PARTS)]
    return books


def _digest(parts: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for book in parts for row in book.tolist() for v in row).encode()).hexdigest()


def codes(vectors: DataFrame, books: Books) -> DataFrame:
    """vec_id, label, dim, code and error of each of the vectors, of which a code has two hex digits for each part."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.zeros((len(batch), PARTS), np.uint8)
            error = [0] * len(batch)
            lengths = np.zeros(len(batch), np.int32)
            for dim, at, x in _blocks(batch):
                total = 0
                for part in range(PARTS):
                    code[at, part], far = nearest(x[:, part], books[dim][part])
                    total = total + far
                lengths[at] = dim
                for k, e in zip(at.tolist(), total.tolist(), strict=True):
                    error[k] = min(e, MOST)
            texts = [row.tobytes().hex() for row in code]
            yield pa.record_batch([batch["vec_id"], batch["label"], pa.array(lengths), pa.array(texts, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "dim", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(encode, f"vec_id long, label {kind}, dim int, code string, error long")


def product_codes(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 for each vector that is not null and has finite components only.

    Components become floor(256 * x), exactly, however large. Codebooks start as the parts of the 64 vectors with the
    smallest ids (null ids last, then by components; fewer vectors make fewer entries) and take two rounds. Vectors of
    another length have codebooks of their own; lengths that aren't a multiple of 16 are filled up with zeros, and an
    empty vector has code 0 and error 0. Repeated rows and ids are rows like others. label_error sums errors over rows of
    one label, null labels together. Errors and sums beyond a long are given as the greatest long. An empty table gives
    an empty result; other columns, whatever their names, are ignored.
    """
    bounded_batches(table.sparkSession)
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    vectors = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector"))
    vectors = vectors.filter(F.col("vector").isNotNull() & finite)
    books = _first_books(vectors)
    for _ in range(ROUNDS if books else 0):
        books = _sums(vectors, books)

    coded = materialize(codes(vectors, books).withColumn("_label", F.struct("label")), "codes")  # equal even if it is null
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(MOST).cast("decimal(38,0)")).cast("long")
    sums = materialize(coded.groupBy("_label").agg(total.alias("label_error")), "label_errors")
    digests = F.create_map(*[F.lit(x) for dim, parts in books.items() for x in (dim, _digest(parts))]) if books else F.create_map(F.lit(0), F.lit(""))
    full = join_skewed(coded, sums, ["_label"], ["vec_id"])
    return full.select("vec_id", "code", "error", "label_error", digests[F.col("dim")].alias("codebooks_sha256"))


def _sql() -> str:
    step = """a{k} AS (
  SELECT vec_id, part, x, min(struct_pack(far := far, entry := entry)) AS m FROM (
    SELECT vec_id, part, entry, x, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i]))) AS far
    FROM parts JOIN c{k} USING (part)) GROUP BY ALL
)"""
    mean = """, s{k} AS (
  SELECT part, m.entry AS entry, i, sum(x[i]) AS s, count(*) AS n FROM a{k}, range(1, len(x) + 1) t(i) GROUP BY ALL
), g{k} AS (
  SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM s{k} GROUP BY ALL
), c{n} AS (SELECT part, entry, coalesce(g.c, o.c) AS c FROM c{k} o LEFT JOIN g{k} g USING (part, entry)), """
    rounds = "".join(step.format(k=k) + mean.format(k=k, n=k + 1) for k in range(ROUNDS))
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS (
  SELECT vec_id, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] AS x FROM kept, range(16) t(part)
), c0 AS (
  SELECT part, row_number() OVER w - 1 AS entry, x AS c FROM parts WINDOW w AS (PARTITION BY part ORDER BY vec_id)
  QUALIFY row_number() OVER w <= 64
), {rounds}{step.format(k=ROUNDS)}, codes AS (
  SELECT vec_id, string_agg(lpad(lower(to_hex(m.entry)), 2, '0'), '' ORDER BY part) AS code, CAST(sum(m.far) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS h FROM c{ROUNDS}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM codes JOIN kept USING (vec_id), books
"""


ORACLE = _sql()
