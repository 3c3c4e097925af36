"""Import queues kept up to date from a stream of commands.

A queue's state holds its files in order and the commands that came before their turn: commands are numbered along their
queue, each is applied once and in turn, in whatever order and however often files bring it. The state is bounded by the
queue's limits and by how far commands come out of turn. Results go to a BatchStore under the micro-batch's number, so a
restart from the checkpoint neither loses nor repeats anything.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from fluvial.sinks import BatchStore

# Files of a queue and their bytes in all, at most; which files may be read.
MOST_FILES, MOST_BYTES = 20, 25 << 20
STARTABLE = ("queued", "failure")

ITEM = "struct<item:int,size:bigint,status:string,request:int>"
COMMAND = "queue long, seq long, kind string, size long, at int, to int, item int, request int, outcome string"
QUEUE = f"queue long, seq long, held int, items array<{ITEM}>, refused int, stale int"
_STATE = f"seq long, held int, next_item int, next_request int, refused int, stale int, items array<{ITEM}>"
_FIELDS = ("kind", "size", "at", "to", "item", "request", "outcome")

Item = tuple[int, int, str, int | None]


class Queue:
    """A queue's files (number, size, status, request) and what is next; a command that can't be followed changes nothing."""

    def __init__(self, items: list[Item], next_item: int = 1, next_request: int = 1, refused: int = 0, stale: int = 0) -> None:
        self.items, self.next_item, self.next_request, self.refused, self.stale = items, next_item, next_request, refused, stale

    def _begin(self, k: int) -> bool:
        number, size, status, _ = self.items[k]
        if status not in STARTABLE:
            return False
        self.items[k] = (number, size, "importing", self.next_request)
        self.next_request += 1
        return True

    def follow(self, kind: str, size: int | None, at: int | None, to: int | None, item: int | None, request: int | None, outcome: str | None) -> None:
        """add(size), remove(at), move(at, to), begin(at), complete(item, request, outcome), retry.

        refused counts files beyond the limits, places that aren't there and files that can't be started; stale counts what
        completes a request that is not the file's current one.
        """
        there = lambda k: k is not None and 0 <= k < len(self.items)
        done = True
        if kind == "add":
            done = size is not None and 0 <= size and len(self.items) < MOST_FILES and sum(x[1] for x in self.items) + size <= MOST_BYTES
            if done:
                self.items.append((self.next_item, size, "queued", None))
                self.next_item += 1
        elif kind == "remove" and there(at):
            del self.items[at]
        elif kind == "move" and there(at) and there(to):
            self.items.insert(to, self.items.pop(at))
        elif kind == "begin" and there(at):
            done = self._begin(at)
        elif kind == "complete":
            found = [k for k, x in enumerate(self.items) if x[0] == item and x[2] == "importing" and x[3] == request]
            for k in found:
                self.items[k] = (*self.items[k][:2], outcome or "failure", request)
            self.stale += not found
        elif kind == "retry":
            for k in [k for k, x in enumerate(self.items) if x[2] == "failure"]:
                self._begin(k)
        else:
            done = False
        self.refused += not done


class _Processor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("queue", _STATE)
        self.early = handle.getListState("early", COMMAND.removeprefix("queue long, "))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        # each call of a state goes to the JVM and back, so there are a few for a queue in a batch, not some for each command
        seq, held, queue = -1, 0, Queue([])
        if self.state.exists():
            seq, held, *rest, items = self.state.get()
            queue = Queue([tuple(x) for x in items], *rest)
        early = {n: fields for n, *fields in self.early.get()} if held else {}
        for row in rows:
            if row.seq is not None and row.seq > seq:
                early[row.seq] = tuple(row[f] for f in _FIELDS)
        while seq + 1 in early:
            seq += 1
            queue.follow(*early.pop(seq))
        if early:
            self.early.put([(n, *fields) for n, fields in early.items()])
        elif held:
            self.early.clear()
        held = len(early)
        self.state.update((seq, held, queue.next_item, queue.next_request, queue.refused, queue.stale, list(queue.items)))
        items = [Row(item=a, size=b, status=c, request=d) for a, b, c, d in queue.items]
        yield Row(queue=key[0], seq=seq, held=held, items=items, refused=queue.refused, stale=queue.stale)

    def close(self) -> None:
        pass


def queue_states(commands: DataFrame) -> DataFrame:
    """A stream of commands (COMMAND) to a stream of queues (QUEUE) as they are after each micro-batch that brings them commands."""
    commands.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return commands.groupBy("queue").transformWithState(_Processor(), QUEUE, "update", "none")


def follow_commands(spark: SparkSession, files: str, store: BatchStore, checkpoint: str, files_a_batch: int = 1000) -> None:
    """Take in all command files that have come since the checkpoint; store's table `queues` gets the changed queues."""

    def put(rows: DataFrame, batch: int) -> None:
        store.commit(f"{batch:012d}", {"queues": rows})

    stream = spark.readStream.schema(COMMAND).option("maxFilesPerTrigger", files_a_batch).parquet(files)
    query = queue_states(stream).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def queue_store(spark: SparkSession, path: str) -> BatchStore:
    return BatchStore(spark, path, {"queues": QUEUE})


def latest_queues(store: BatchStore) -> DataFrame:
    """Each queue as it is after the last command that could be applied; batches come in their order, as held may change alone."""
    rows = store.read("queues")
    last = rows.groupBy("queue").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "queue")), "batch_id").alias("q"))
    return last.select("queue", "q.seq", "q.held", "q.items", "q.refused", "q.stale")


def queue_files(queues: DataFrame) -> DataFrame:
    """queue, position, item, size, status and request of each file."""
    return queues.select("queue", F.posexplode("items").alias("position", "x")).select("queue", "position", "x.*")
