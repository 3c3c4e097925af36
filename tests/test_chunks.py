"""Running values along large keys, and the chunker against a plain greedy model."""

import random

import pytest
from pyspark.sql import functions as F

from fluvial import scans, staging
from fluvial.operators import chunking


@pytest.mark.parametrize("bits", [1, 3, 10])
def test_along(spark, monkeypatch, bits):
    monkeypatch.setattr(scans, "BUCKET_BITS", bits)
    rng = random.Random(bits)
    rows = []
    for k in [None, 1, 2, 3]:
        at = sorted(rng.sample(range(3000), 200 if k == 2 else rng.randrange(1, 20)))
        rows += [(k, a, rng.choice([None, 0, 1, 5]), rng.choice([None, "x", "y"])) for a in at]
    df = spark.createDataFrame(rows, "k int, at long, v long, s string").select(F.struct("k").alias("key"), "at", "v", "s").repartition(3)
    got = scans.along(df, ["key"], "at", {"total": F.col("v")}, {"above": F.col("s")}, {"seen": F.col("s")})
    assert got.columns == ["key", "at", "v", "s", "total", "above", "seen"]
    want, state = [], {}
    for k, a, v, s in rows:
        total, above, seen = state.get(k, (0, None, None))
        total, seen = total + (v or 0), s or seen
        want.append((k, a, total, above, seen))
        state[k] = (total, s, seen)
    assert sorted(((r.key.k, r.at, r.total, r.above, r.seen) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_last_within(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(4):
        end = 0
        ends = []
        for i in range(rng.randrange(1, 120)):
            end += rng.randrange(0, 30)
            ends.append((end, i))
        for end, i in ends:
            reach = end + rng.randrange(0, 50)
            rows.append((k, i, end, reach))
            want[k, i] = max(x for x in ends if x[0] <= reach)[1]
    df = spark.createDataFrame(rows, "k int, i int, hi long, reach long")
    got = scans.last_within(df, ["k"], F.col("hi"), F.col("reach"), 50, "i").collect()
    assert {(r.k, r.i): r["_last"] for r in got} == want


def table(text, target, most):
    header, *rows = text.split("\n")
    out, now = [], []
    for row in rows:
        if now and len("\n".join([header, *now, row])) > target:
            out.append("\n".join([header, *now]))
            now = []
        if len(header) + 1 + len(row) > most:
            out += [f"{header}\n{row[a:b]}" for a, b in chunking.cuts(row, max(1, target - len(header) - 1), most - len(header) - 1)]
            continue
        now.append(row)
        if len("\n".join([header, *now])) >= target:
            out.append("\n".join([header, *now]))
            now = []
    return [*out, "\n".join([header, *now])] if now else out


def test_table_cuts():
    rng = random.Random(8)
    for _ in range(300):
        text = "\n".join("x" * rng.randrange(1, 9) + " y" * rng.choice([0, 0, 3, 30]) for _ in range(rng.randrange(2, 20)))
        text = "head\n" + text
        if len(text) > 40:
            assert list(chunking.table_cuts(text, 25, 40)) == table(text, 25, 40)
    with pytest.raises(ValueError):
        list(chunking.table_cuts("h" * 40 + "\nrow", 20, 40))


def greedy(rows, target, most):
    """One block after the other: rows of (doc, section, path, at, kind, text, page)."""
    out = []
    for key in sorted({r[:2] for r in rows}, key=repr):
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: r[3])
        head = "# " + " > ".join(own[0][2]) + "\n\n" if own[0][2] else ""
        if len(head) >= most:
            out.append((*key, None, None))
            continue
        room, wanted = most - len(head), max(1, target - len(head))
        units = []
        for r in own:
            last = units[-1][-1][4] if units else None
            if (r[4] == last == "list_item") or (r[4] in ("code", "formula") and last == "paragraph"):
                units[-1].append(r)
            else:
                units.append([r])
        chunks, size = [], 0
        for u in units:
            n = len("\n\n".join(x[5] for x in u))
            alone = lambda v: v[0][4] == "table" or len("\n\n".join(x[5] for x in v)) > room  # noqa: B023, E731
            page = lambda v: next((x[6] for x in v if x[6] is not None), None)
            if not chunks or alone(u) or alone(chunks[-1][-1]) or page(u) != page(chunks[-1][-1]) or size + 2 + n > min(wanted, room):
                chunks.append([u])
                size = n
            else:
                chunks[-1].append(u)
                size += 2 + n
        for c in chunks:
            blocks = [x for u in c for x in u]
            texts = ["\n\n".join(x[5] for x in blocks)]
            if len(texts[0]) > room:
                first = blocks[0][5] + "\n\n"
                if len(blocks) == 1 and blocks[0][4] == "table" and "\n" in texts[0]:
                    texts = table(texts[0], wanted, room)
                elif len(blocks) == 2 and blocks[0][4] == "paragraph" and len(first) < room:
                    texts = [first + blocks[1][5][a:b] for a, b in chunking.cuts(blocks[1][5], max(1, wanted - len(first)), room - len(first))]
                else:
                    texts = [texts[0][a:b] for a, b in chunking.cuts(texts[0], wanted, room)]
            out += [(*key, head + t, tuple(x[3] for x in blocks)) for t in texts]
    return out


def run(spark, rows, target, most, max_chunks=10**6):
    df = spark.createDataFrame([(d, s, None, p, a, k, t, page, "x") for d, s, p, a, k, t, page in rows], "doc_id long, section_ord int, heading string, heading_path array<string>, block_ord int, kind string, text string, page int, chunk string")
    return chunking.structural_chunks(df.repartition(3), target=target, most=most, place=("page",), max_chunks=max_chunks)


def blocks(rng, doc, section, n, path):
    kinds = ["paragraph", "paragraph", "paragraph", "code", "formula", "list_item", "list_item", "table", "transcript"]
    out = []
    for i in range(n):
        kind = rng.choice(kinds)
        text = " ".join("w" * rng.randrange(1, 6) for _ in range(rng.choice([0, 1, 3, 8, 8, 40])))
        out.append((doc, section, path, i * 3, kind, "head\n" + text.replace(" ", "\n") if kind == "table" else text, rng.choice([None, i // 7])))
    return out


@pytest.mark.parametrize("bits", [2, 10])
def test_chunks_against_greedy_model(spark, monkeypatch, bits):
    monkeypatch.setattr(scans, "BUCKET_BITS", bits)
    rng = random.Random(bits)
    rows = []
    for doc in [None, *range(8)]:
        for section in range(rng.randrange(1, 4)):
            rows += blocks(rng, doc, section, rng.choice([1, 5, 30]), rng.choice([[], ["A"], ["A", "B c"], ["h" * 120]]))
    got = run(spark, rows, 60, 100).collect()
    want = greedy(rows, 60, 100)
    assert sorted(((r.doc_id, r.section_ord, r.text, tuple(r.block_ords) if r.block_ords else None) for r in got), key=repr) == sorted(want, key=repr)
    for doc in {r.doc_id for r in got}:  # in order, without gaps
        own = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.sequence)
        assert [r.sequence for r in own] == list(range(len(own)))
        assert [(d, s, t) for d, s, t, _ in want if d == doc] == [(r.doc_id, r.section_ord, r.text) for r in own]
    assert len({r.chunk_id for r in got}) == len(got)


def test_one_section_holds_nearly_all_blocks(spark, monkeypatch):
    """A long section is packed over many buckets, and more chunks than are allowed is an error of the document's rows."""
    monkeypatch.setattr(scans, "BUCKET_BITS", 5)
    rng = random.Random(1)
    rows = [(1, 0, [], i, "paragraph", "w" * rng.randrange(0, 30), None) for i in range(3000)] + [(2, 0, [], 0, "paragraph", "short", None)]
    got = run(spark, rows, 60, 100, 48).collect()
    assert sorted((r.doc_id, r.section_ord, r.text, tuple(r.block_ords)) for r in got) == sorted(greedy(rows, 60, 100))
    assert {(r.doc_id, r.error) for r in got} == {(1, "too_many_chunks"), (2, None)}


def test_no_blocks(spark):
    assert run(spark, [], 60, 100).collect() == []


def test_text_chunks_in_bounded_batches(spark, monkeypatch):
    """neither the texts nor the pieces of many rows are held at once."""
    import pyarrow as pa

    monkeypatch.setattr(chunking, "PIECES", 1_000)
    texts = ["word " * 200, None, "x" * 700, ""] * 20
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    out = list(chunking._cut_batches(iter([batch]), 60, 120))
    assert max(sum(map(len, b["text"].to_pylist())) for b in out) < 1_000 + 120 and len(out) > 20
    got = [r for b in out for r in zip(*(b[c].to_pylist() for c in ("doc_id", "sequence", "text")))]
    assert ["".join(t for d, _, t in got if d == i) for i in range(len(texts))] == [t or "" for t in texts]
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    chunking.text_chunks(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(8 << 20)


def test_scans_are_not_joined_by_file_size(spark):
    """offsets of stored rows are small in their files only, so no join broadcasts them for it."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    df = spark.createDataFrame([(1, 0, 5), (1, 1, 6)], "key long, at long, v long")
    plan = scans.along(df, ["key"], "at", {"total": F.col("v")})._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_shuffled_tables_are_broadcast_up_to_few_bytes(spark):
    """A session's own bound on what is broadcast once it was shuffled holds only if it is lower."""
    measured = "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = spark.conf.get(measured, None)
    for given, kept in (("10485760b", "1048576"), ("30m", "1048576"), ("256k", "262144"), ("1MB", "1048576"), ("-1", "-1")):
        spark.conf.set(measured, given)
        staging.joins_by_rows(spark)
        assert (spark.conf.get(measured), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")) == (kept, "-1")
    spark.conf.set(measured, before) if before else spark.conf.unset(measured)
