"""Byte-level BPE encoding and decoding of whole texts.

A text is cut into leaves of bounded size, the leaves are encoded apart, and their ids are joined pairwise up a tree.
Most cuts fall where the split pattern starts a new piece whatever stands to the left: before white space that
follows something else, and where a run of letters or of digits ends. There the joined ids are the ids of the whole.
Only inside an unsplit run longer than half a leaf is a cut "tight". Then the pieces' last and first ids are encoded anew
as one window, which grows until its first and last ids are those that both sides already have, or until it is all of a
side. Ids of a byte-level BPE are the encoding of their bytes exactly if every two neighbours are, so such a join is
exact. Each leaf knows how far the run goes to either side of its cut; only a window that would leave the run gives way to
encoding both sides again as one.

Leaves make segments of SEGMENT characters. A text of one segment is encoded where it is; the segments of a longer one
are dealt out over tasks, each joined up its own tree, and the ids of the text then meet in one task, as bytes.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvial.staging import bounded_batches

#: The split pattern of the byte-level vocabularies (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a leaf, and of a segment of a text.
LEAF, SEGMENT = 1 << 12, 1 << 16
_RUN = regex.compile(r"\p{L}+|\p{N}+|\s+|[^\s\p{L}\p{N}]+")
_SAFE = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?!\p{L})|(?<=\p{N})(?!\p{N})")
_LAST_SAFE = regex.compile(_SAFE.pattern, regex.REVERSE)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def share_vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The vocabulary file's text for the executors; its size is that of a vocabulary, whatever the corpus."""
    with open(path or default_vocabulary(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


class Encoder:
    """Encodes and decodes as the vocabulary's own library does with add_special_tokens=False."""

    def __init__(self, text: str, leaf: int = LEAF) -> None:
        spec = json.loads(text)
        model = spec["model"]
        # The printable stand-ins of bytes in such files: printable Latin-1 stands for itself, the others follow from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in k): v for k, v in model["vocab"].items() if k not in self.special}
        merges = ("".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"])
        if any(model["vocab"][m] != 256 + i for i, m in enumerate(merges)):
            raise ValueError("ids must follow the order of merges")
        self.core = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
        self.size = max(ranks.values()) + 1 + len(self.special)
        self.leaf = leaf
        self.joins: Counter[str] = Counter()  # joins so far: where a piece begins, by a window, by encoding both sides again

    def encode(self, text: str) -> np.ndarray:
        """All ids of the text (uint32)."""
        return self.join(self.leaves(text, self.leaf), self.plain)

    def plain(self, text: str) -> np.ndarray:
        return self.core.encode_to_numpy(text, allowed_special="all", disallowed_special=())

    def leaves(self, text: str, size: int) -> Iterator[tuple[int, int, str]]:
        """(behind, ahead, leaf) from left to right: how far the run that the cut before the leaf divides goes to both sides; 0, 0 where a piece begins."""
        at, behind, ahead, n = 0, 0, 0, len(text)
        run = (0, 0)  # the last run that was cut, so that a long one is measured once
        while at < n:
            end = min(at + size, n)
            cut, rooms = end, (0, 0)
            if end < n:
                low = at + size // 2
                cut = self._safe_cut(text, low, end)
                if cut < 0:
                    cut, run = self._tight_cut(text, low, end, run, size)
                    if cut >= 0:
                        rooms = cut - run[0], run[1] - cut  # characters, so as many bytes at least
                    else:  # no run is long enough: a longer leaf
                        cut = next(self._safe_after(text, end), n)
            yield behind, ahead, text[at:cut]
            at, (behind, ahead) = cut, rooms

    def _safe_cut(self, text: str, low: int, end: int) -> int:
        """The last place in (low, end] where a piece begins in any context; -1 if there is none."""
        for m in _LAST_SAFE.finditer(text, low, min(end + 1, len(text))):
            if low < m.start() <= end and not self._in_special(text, m.start()):
                return m.start()
        return -1

    def _in_special(self, text: str, at: int) -> bool:
        return any(text.find(s, max(0, at - len(s) + 1), at + len(s) - 1) >= 0 for s in self.special)

    def _safe_after(self, text: str, at: int) -> Iterator[int]:
        for m in _SAFE.finditer(text, at):
            if m.start() > at and not self._in_special(text, m.start()):
                yield m.start()

    def _tight_cut(self, text: str, low: int, end: int, run: tuple[int, int], size: int) -> tuple[int, tuple[int, int]]:
        """A place inside a run of one kind, with a good part of the run on either side, and that run; -1 if there is none."""
        at = low
        while at < end:
            if not run[0] <= at < run[1]:
                run = _RUN.match(text, at).span()  # it may have begun before `at`, which makes no difference
            if min(run[1], end) - at >= size // 8:
                cut = (at + min(run[1], end)) // 2
                if not self._in_special(text, cut):
                    return cut, run
            at = run[1]
        return -1, run

    def join(self, leaves: Iterable[tuple[int, int, object]], ids_of: Callable[[object], np.ndarray]) -> np.ndarray:
        """Ids of the whole from (behind, ahead, leaf); two neighbours of equal height become one, as in a binary counter."""
        stack: list[tuple[int, int, int, np.ndarray]] = []

        def merge() -> None:
            (_, behind, ahead, right), (height, *before, left) = stack.pop(), stack.pop()
            stack.append((height + 1, *before, self.concatenate(left, right, behind, ahead)))

        for behind, ahead, leaf in leaves:
            stack.append((0, behind, ahead, ids_of(leaf)))
            while len(stack) > 1 and stack[-2][0] <= stack[-1][0]:
                merge()
        while len(stack) > 1:
            merge()
        return stack[0][3] if stack else np.empty(0, np.uint32)

    def concatenate(self, left: np.ndarray, right: np.ndarray, behind: int, ahead: int) -> np.ndarray:
        """Join two encodings. If they meet inside a run, which goes `behind` and `ahead` bytes to the sides at least, by a window that grows."""
        if not ahead:
            self.joins["safe"] += 1
            return np.concatenate([left, right])
        k, core = 4, self.core._core_bpe
        while True:
            head, tail = left[-k:], right[:k]
            a, b = core.decode_bytes(head.tolist()), core.decode_bytes(tail.tolist())
            if len(a) > behind or len(b) > ahead:
                break
            ids = core.encode_single_piece(a + b)
            # an end of the window that is the end of its side is checked when that side is joined
            if (len(head) == len(left) or ids[0] == head[0]) and (len(tail) == len(right) or ids[-1] == tail[-1]):
                self.joins["window"] += 1
                return np.concatenate([left[: len(left) - len(head)], np.array(ids, np.uint32), right[len(tail) :]])
            k *= 2
        self.joins["whole"] += 1
        return self.plain(self.decode(np.concatenate([left, right])))

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        return self.core._core_bpe.decode_bytes(ids.tolist())

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def encoder(text: str) -> Encoder:
    """One encoder a worker."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(text)


@functools.lru_cache(maxsize=1)
def _decimals(size: int) -> list[bytes]:
    return [str(i).encode() for i in range(size)]


def digests(enc: Encoder, ids: np.ndarray, step: int = 1 << 20) -> tuple[int, str, str]:
    """Number of ids, SHA-256 of the decimal ids joined by commas, SHA-256 of the decoded text in UTF-8."""
    of_ids, of_text, names, rest = hashlib.sha256(), hashlib.sha256(), _decimals(enc.size), b""
    for at in range(0, len(ids), step):
        part = ids[at : at + step].tolist()
        of_ids.update((b"," if at else b"") + b",".join(map(names.__getitem__, part)))
        whole = rest + enc.core._core_bpe.decode_bytes(part)
        keep = _open_end(whole) if at + step < len(ids) else 0
        whole, rest = (whole[:-keep], whole[-keep:]) if keep else (whole, b"")
        of_text.update(whole.decode("utf-8", "replace").encode())
    return len(ids), of_ids.hexdigest(), of_text.hexdigest()


def _open_end(data: bytes) -> int:
    """Bytes at the end that begin a character which is not complete."""
    for k in range(1, min(3, len(data)) + 1):
        b = data[-k]
        if b >= 0xC0:
            return k if (2 if b < 0xE0 else 3 if b < 0xF0 else 4) > k else 0
        if b < 0x80:
            return 0
    return 0


def texts(column: pa.Array) -> Iterator[str]:
    """Texts of an Arrow column one at a time; null is empty."""
    for x in column:
        yield x.as_py() or ""


def encode_documents(docs: DataFrame, vocabulary: str | None = None, segment: int = SEGMENT) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids and the digests of the empty string. The special tokens' strings in a text are
    their ids. Texts of any length are encoded whole. Repeated rows give repeated results, an empty table an empty one;
    other columns, whatever their names, are ignored.
    """
    bounded_batches(docs.sparkSession)
    spec = share_vocabulary(docs.sparkSession, vocabulary)
    rows = docs.select("doc_id", "text")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in batches:
            found = [digests(enc, enc.encode(t)) for t in texts(batch["text"])]
            yield _result(batch["doc_id"], found)

    one = rows.filter(F.coalesce(F.length("text"), F.lit(0)) <= segment).mapInArrow(whole, RESULT)
    return one.unionByName(_over_tasks(rows.filter(F.length("text") > segment), spec, segment))


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _result(ids: pa.Array, found: list[tuple[int, str, str]]) -> pa.RecordBatch:
    n, a, b = zip(*found, strict=True) if found else ((), (), ())
    return pa.record_batch([ids.cast(pa.int64()), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def _over_tasks(rows: DataFrame, spec: Broadcast, segment: int) -> DataFrame:
    """Texts of several segments: these are dealt out and encoded by themselves, then each text's ids are joined in order."""
    parts = ["_row", "doc_id", "segment", "behind", "ahead"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in batches:
            for i, text in enumerate(texts(batch["text"])):
                for k, (behind, ahead, part) in enumerate(enc.leaves(text, segment)):
                    yield pa.record_batch([batch["_row"][i : i + 1], batch["doc_id"][i : i + 1], pa.array([k]), pa.array([behind]), pa.array([ahead]), pa.array([part])], [*parts, "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        for batch in batches:
            ids = pa.array([enc.encode(t).astype("<u4").tobytes() for t in texts(batch["text"])], pa.binary())
            yield pa.record_batch([*(batch[c] for c in parts), ids], [*parts, "ids"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(spec.value)
        row, segments = None, []

        def done() -> pa.RecordBatch:
            ids = enc.join(segments, lambda b: np.frombuffer(b, "<u4"))
            return _result(pa.array([row[1]], pa.int64()), [digests(enc, ids)])

        for batch in batches:
            for key, doc, behind, ahead, ids in zip(*(batch[c].to_pylist() for c in ("_row", "doc_id", "behind", "ahead", "ids")), strict=True):
                if row is not None and row[0] != key:
                    yield done()
                    segments = []
                row = (key, doc)
                segments.append((behind, ahead, ids))
        if row is not None:
            yield done()

    shape = "_row long, doc_id long, segment long, behind long, ahead long"
    cuts = rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(cut, f"{shape}, text string")
    encoded = cuts.repartition("_row", "segment").mapInArrow(encode, f"{shape}, ids binary")
    return encoded.repartition("_row").sortWithinPartitions("_row", "segment").mapInArrow(join, RESULT)
