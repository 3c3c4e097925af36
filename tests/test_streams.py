"""Queues from a stream against the same commands followed one by one."""

import random

import pytest

from fluvial.streaming import queues


def commands(rng, queue, n):
    out = []
    for seq in range(n):
        kind = rng.choice(["add", "add", "add", "begin", "begin", "complete", "complete", "move", "remove", "retry", "other"])
        out.append((queue, seq, kind, rng.choice([None, -1, 1 << 20, 3 << 20]), rng.choice([None, -1, 0, 1, 2, 9]), rng.choice([0, 1, 3]), rng.randrange(1, 6), rng.randrange(1, 8), rng.choice([None, "success", "warning", "failure"])))
    return out


def folded(rows):
    out = {}
    for queue in {r[0] for r in rows}:
        q = queues.Queue([])
        for r in sorted(r for r in rows if r[0] == queue):
            q.follow(*r[2:])
        out[queue] = (q.items, q.refused, q.stale)
    return out


def state(store):
    return {r.queue: ([tuple(x) for x in r.items], r.refused, r.stale) for r in queues.latest_queues(store).collect()}, {r.queue: (r.seq, r.held) for r in queues.latest_queues(store).collect()}


def test_restart_and_commands_out_of_turn(spark, tmp_path):
    rng = random.Random(3)
    rows = [r for q in range(6) for r in commands(rng, q, rng.randrange(1, 60))]
    dealt = rows + rng.sample(rows, 20)  # some come twice
    rng.shuffle(dealt)
    at, files, checkpoint = f"file://{tmp_path}/store", f"file://{tmp_path}/files", f"file://{tmp_path}/checkpoint"
    store = queues.queue_store(spark, at)
    for k, part in enumerate((dealt[: len(dealt) // 2], dealt[len(dealt) // 2 :])):
        spark.createDataFrame(part, queues.COMMAND).coalesce(2).write.mode("append").parquet(files)
        queues.follow_commands(spark, files, queues.queue_store(spark, at), checkpoint, 1)
        if k == 0:
            assert any(held for _, held in state(store)[1].values())
    found, ends = state(store)
    assert found == folded(rows) and all(held == 0 for _, held in ends.values())
    batches = store.committed()
    queues.follow_commands(spark, files, queues.queue_store(spark, at), checkpoint, 1)
    assert store.committed() == batches and state(store)[0] == found


@pytest.mark.parametrize("size,kept", [(1 << 20, 20), (2 << 20, 12)])
def test_limits(size, kept):
    q = queues.Queue([])
    for _ in range(30):
        q.follow("add", size, None, None, None, None, None)
    assert len(q.items) == kept and q.refused == 30 - kept


def test_requests():
    q = queues.Queue([])
    for _ in range(3):
        q.follow("add", 1, None, None, None, None, None)
    q.follow("begin", None, 0, None, None, None, None)
    q.follow("begin", None, 0, None, None, None, None)  # runs already
    q.follow("complete", None, None, None, 1, 9, "success")  # of no request
    q.follow("complete", None, None, None, 1, 1, "failure")
    q.follow("begin", None, 2, None, None, None, None)
    q.follow("complete", None, None, None, 3, 2, None)
    q.follow("move", None, 2, 0, None, None, None)
    q.follow("retry", None, None, None, None, None, None)
    assert q.items == [(3, 1, "importing", 3), (1, 1, "importing", 4), (2, 1, "queued", None)]
    assert (q.refused, q.stale) == (1, 1)


def test_calls_of_the_state_do_not_grow_with_commands():
    """a queue's batch of commands takes a few calls, however many come before their turn."""
    calls = []

    class State:
        def __init__(self, value=None):
            self.value = value

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                if name == "exists":
                    return self.value is not None
                if name == "get":
                    return self.value if self.value is not None else iter(())
                self.value = args[0] if args else None
                return None

            return call

    class Handle:
        def getValueState(self, *_):
            return State()

        getListState = getMapState = getValueState

    processor = queues._Processor()
    processor.init(Handle())
    row = lambda n: queues.Row(queue=1, seq=n, kind="add", size=1, at=None, to=None, item=None, request=None, outcome=None)
    first = list(processor.handleInputRows((1,), iter([row(n) for n in range(1, 200)]), None))
    assert (first[0].seq, first[0].held) == (-1, 199) and len(calls) <= 5
    last = list(processor.handleInputRows((1,), iter([row(0)]), None))
    assert (last[0].seq, last[0].held, last[0].refused) == (199, 0, 180) and len(calls) <= 10
