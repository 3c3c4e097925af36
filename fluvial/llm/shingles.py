"""Sets of word shingles as sorted arrays of hashes, computed from UTF-8 bytes with array operations.

A word's identity is 128 bits of a keyed hash: SipHash-1-3 for words of at most LANES * 8 bytes, computed for many words
at once, and BLAKE2b for longer ones. A shingle is a sum of its words' identities times odd numbers, mixed, in each half
apart. 64 bits (`hi`) put shingles in order and find candidates; exact steps compare 96 (`hi` and 32 bits of `lo`).
With a key that is drawn for each job no text can be written to collide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at once, unless a single word is longer.
SLICE = 1 << 18
#: Words of more 8-byte lanes are hashed one by one.
LANES = 8
KEY = bytes(range(16))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = _LOWER[97:123]  # A-Z
_MIX = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 64, 16, np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SPACE = np.array([0x20], np.uint8)
_MASKS = np.array([(1 << (8 * i)) - 1 for i in range(9)], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(v: list[np.ndarray]) -> None:
    v[0] = v[0] + v[1]
    v[1] = _turn(v[1], 13) ^ v[0]
    v[0] = _turn(v[0], 32)
    v[2] = v[2] + v[3]
    v[3] = _turn(v[3], 16) ^ v[2]
    v[0] = v[0] + v[3]
    v[3] = _turn(v[3], 21) ^ v[0]
    v[2] = v[2] + v[1]
    v[1] = _turn(v[1], 17) ^ v[2]
    v[2] = _turn(v[2], 32)


def identities(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes = KEY) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each of the byte ranges of data, as two arrays."""
    k = np.frombuffer(key, "<u8").astype(np.uint64)
    begin = (0x736F6D6570736575, 0x646F72616E646F6D ^ 0xEE, 0x6C7967656E657261, 0x7465646279746573)  # fixed values of SipHash with 128 bits
    lengths = ends - starts
    v = [np.full(len(starts), np.uint64(c) ^ k[i % 2], np.uint64) for i, c in enumerate(begin)]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))  # the eight bytes from each place on
    short = np.flatnonzero(lengths <= 8 * LANES)
    for lane in range(LANES):
        at = short[lengths[short] >= 8 * lane + 8]
        if not len(at):
            break
        _absorb(v, at, eight[starts[at] + 8 * lane])
    rest = lengths % 8
    last = eight[np.minimum(starts + lengths - rest, len(data))] & _MASKS[rest]
    _absorb(v, None, last | (lengths.astype(np.uint64) << np.uint64(56)))
    v[2] = v[2] ^ np.uint64(0xEE)
    out = []
    for half in range(2):
        if half:
            v[1] = v[1] ^ np.uint64(0xDD)
        for _ in range(3):
            _round(v)
        out.append(v[0] ^ v[1] ^ v[2] ^ v[3])
    for i in np.flatnonzero(lengths > 8 * LANES).tolist():
        d = hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=16, key=key).digest()
        out[0][i], out[1][i] = np.frombuffer(d, "<u8")
    return out[0], out[1]


def _absorb(v: list[np.ndarray], at: np.ndarray | None, lane: np.ndarray) -> None:
    """One lane into the states at the places `at` (all, if None)."""
    own = v if at is None or len(at) == len(v[0]) else [x[at] for x in v]
    own[3] = own[3] ^ lane
    _round(own)
    own[0] = own[0] ^ lane
    if own is not v:
        for x, y in zip(v, own, strict=True):
            x[at] = y


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are not ASCII white space."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], _IS_SPACE[data], [True]]).view(np.int8)))
    return edges[::2], edges[1::2]


def word_hashes(data: np.ndarray, key: bytes = KEY) -> tuple[np.ndarray, np.ndarray]:
    """The identity of each word of a text, in order."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while end < len(data):  # no word is cut
            spaces = np.flatnonzero(_IS_SPACE[data[max(at, end - 4096) : end]])
            if len(spaces):
                end = max(at, end - 4096) + int(spaces[-1]) + 1
                break
            end = min(end + 4096, len(data))
        part = _LOWER[data[at:end]]
        parts.append(identities(part, *_words(part), key))
        at = end
    return (np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])) if parts else (np.empty(0, np.uint64), np.empty(0, np.uint64))


def _shingles(hi: np.ndarray, lo: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle that begins at each word, of all but the last ones."""
    n = len(hi) - words + 1
    out = []
    for k, h in enumerate((hi, lo)):
        total = np.full(n, np.uint64(words))
        for i in range(words):
            total += h[i : i + n] * _MIX[8 * k + i]
        out.append(mix(total))
    return out[0], out[1]


def _distinct(hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In order of hi, and lo where hi is equal; each once. lo: its upper half."""
    order = np.argsort(hi)
    hi, lo = hi[order], (lo[order] >> np.uint64(32)).astype(np.uint32)
    same = hi[1:] == hi[:-1]
    if (same & (lo[1:] != lo[:-1])).any():
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        same = (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])
    keep = np.concatenate([[True], ~same]) if len(hi) else np.empty(0, bool)
    return hi[keep], lo[keep]


def shingle_set(data: np.ndarray, words: int = 5, key: bytes = KEY) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs of `words` words (hi, lo), sorted; of fewer words, the whole sequence is the only one; of none, empty."""
    hi, lo = word_hashes(data, key)
    k = min(words, len(hi))
    return _distinct(*_shingles(hi, lo, k)) if k else (hi, lo.astype(np.uint32))


def shingle_sets(column: pa.Array, words: int = 5, key: bytes = KEY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The set of each text of an Arrow column, in order. Short texts are hashed together."""
    held: list[np.ndarray] = []
    size = 0
    for data in byte_arrays(column):
        if len(data) > SLICE // 4:
            yield from _together(held, words, key)
            held, size = [], 0
            yield shingle_set(data, words, key)
            continue
        held.append(data)
        size += len(data)
        if size >= SLICE:
            yield from _together(held, words, key)
            held, size = [], 0
    yield from _together(held, words, key)


def _together(texts: list[np.ndarray], words: int, key: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if not texts:
        return
    data = _LOWER[np.concatenate([x for t in texts for x in (t, _SPACE)])]
    starts, ends = _words(data)
    hi, lo = identities(data, starts, ends, key)
    bounds = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts])).tolist()
    full = _shingles(hi, lo, words) if len(hi) >= words else None
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            yield _distinct(full[0][a : b - words + 1], full[1][a : b - words + 1])
        elif b > a:
            yield _distinct(*_shingles(hi[a:b], lo[a:b], b - a))
        else:
            yield hi[:0], np.empty(0, np.uint32)


def overlap(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """Number of shingles of both sets, by merging their sorted arrays."""
    if len(x[0]) > len(y[0]):
        x, y = y, x
    at = np.searchsorted(y[0], x[0])
    ok = at < len(y[0])
    at[~ok] = 0
    same = ok & (y[0][at] == x[0])
    if (y[0][1:] == y[0][:-1]).any() or (x[0][1:] == x[0][:-1]).any():  # shingles that share 64 bits
        return len(set(zip(x[0].tolist(), x[1].tolist(), strict=True)) & set(zip(y[0].tolist(), y[1].tolist(), strict=True)))
    return int((same & (y[1][at] == x[1])).sum())


def name(hi: np.ndarray, lo: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set, as two signed integers."""
    digest = hashlib.blake2b(hi.tobytes(), digest_size=16)
    digest.update(lo.tobytes())
    d = digest.digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def byte_arrays(column: pa.Array) -> Iterator[np.ndarray]:
    """The UTF-8 bytes of each text of an Arrow column, without copies; null is empty."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if offsets is None:
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    null = column.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield raw[at[i] : at[i]] if null[i] else raw[at[i] : at[i + 1]]


def bitmap(shingles: np.ndarray, least: int = 64) -> np.ndarray:
    """A parity bitmap of one or two bits a shingle: each flips the bit that its hash picks. Powers of two wide (uint64 words)."""
    width = max(least, 1 << int(len(shingles) - 1).bit_length()) if len(shingles) else least
    bits = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def fold(bits: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same set with fewer words (a smaller power of two)."""
    while bits.shape[-1] > words:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits
