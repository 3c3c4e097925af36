import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from fluvial.llm import bpe, packing


@given(st.integers(1, 20_000))
def test_cuts(n):
    got = packing.cut_lengths(n)
    assert sum(got) == n and all(0 < x <= packing.CAPACITY for x in got)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=80))
def test_bins(lengths):
    out = []
    bins = packing.Bins(lambda p, k, at: out.append((p, k, at)))
    pieces = [(d, i, n) for d, total in enumerate(lengths) for i, n in enumerate(packing.cut_lengths(total))]
    for p in pieces:
        bins.add(p)
    bins.finish()
    assert sorted(p for p, _, _ in out) == sorted(pieces)
    rooms = defaultdict(list)
    for p, k, at in out:
        rooms[k].append((at, p[2]))
    for room in rooms.values():
        end = 0
        for at, n in sorted(room):
            assert at == end
            end += n
        assert end <= packing.CAPACITY


def test_documents(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice(["word ", "é", "12 ", "\n"]) for _ in range(rng.choice([0, 3, 900, 9000])))) for i in range(60)] + [(99, None), (77, "again"), (77, "again")]
    docs = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, length long").repartition(3)
    got = packing.pack_documents(docs).collect()
    enc = bpe.Encoder(open(bpe.default_vocabulary(), encoding="utf-8").read())
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(np.append(enc.encode(t or ""), 1).astype("<u4"))
    for i, all_ids in want.items():
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert sum(r.length for r in own) == sum(map(len, all_ids))
        for r in own:
            assert r.doc_tokens == len(all_ids[0]) and r.ids_crc32 == zlib.crc32(all_ids[0][r.start : r.start + r.length].tobytes())
    rooms = defaultdict(list)
    for r in got:
        rooms[r.sequence_id].append((r.offset, r.length))
    filled = 0
    for room in rooms.values():
        end = 0
        for at, n in sorted(room):
            assert at == end
            end += n
        filled += end if end & (end - 1) == 0 else packing.CAPACITY
    assert filled <= 1.1 * sum(r.length for r in got)
    assert packing.pack_documents(docs.limit(0)).count() == 0
