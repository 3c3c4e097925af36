"""Tables that batches are added to exactly once.

A batch's rows are first written to a folder of their own that nothing refers to. Then one rename gives the store its next
manifest, the list of all folders that count: before it nobody sees any of the batch's tables, after it everybody sees all
of them. A job that dies in between leaves files that no manifest names; the batch can be committed again, and
`vacuum` deletes them. A batch that a manifest has is not added again, so a retry changes nothing.

The driver handles names of batches and folders alone: a manifest has one short entry a commit, and `compact` makes many
folders one. Two writers can't both give the next manifest: the rename fails for one, which takes the other's into account.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH = "batch_id"


class Conflict(Exception):
    """Another writer was first with a manifest."""


class BatchStore:
    """Tables in a folder that driver and executors share; each has the column batch_id besides its own.

    tables: schema (DDL) by name. Rows come in no order and may repeat.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str]) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.tables = {name: StructType.fromDDL(f"{BATCH} string, {ddl}") for name, ddl in tables.items()}
        self._files = self._path("manifests").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(self._path("manifests"))

    def _path(self, name: str):  # noqa: ANN202
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _latest(self) -> tuple[int, list[dict]]:
        """Number and entries of the last manifest. An entry: folder, its batches, and those of them that no longer count."""
        found = [int(f.getPath().getName()) for f in self._files.listStatus(self._path("manifests")) if f.getPath().getName().isdigit()]
        if not found:
            return -1, []
        text = self.spark.read.text(f"{self.path}/manifests/{max(found)}", wholetext=True).first()[0]
        return max(found), json.loads(text)

    def _publish(self, number: int, entries: list[dict]) -> None:
        """Give the store manifest `number`; Conflict if there is one."""
        jvm, temporary, final = self.spark._jvm, self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{number}")
        out = self._files.create(temporary)
        out.write(bytearray(json.dumps(entries).encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(temporary, final, options)
        except Exception as e:
            self._files.delete(temporary, False)
            if "FileAlreadyExistsException" in str(e):
                raise Conflict(number) from e
            raise

    def _change(self, change: Callable[[list[dict]], list[dict] | None]) -> bool:
        """Publish what `change` makes of the last entries, again if others were first; False if it makes nothing."""
        while True:
            number, entries = self._latest()
            after = change(entries)
            if after is None:
                return False
            try:
                self._publish(number + 1, after)
                return True
            except Conflict:
                continue

    def committed(self) -> set[str]:
        """Ids of the batches that count."""
        return {b for e in self._latest()[1] for b in e["batches"] if b not in e["gone"]}

    def stage(self, batch_id: str, rows: dict[str, DataFrame]) -> str:
        """Write a batch's rows where nobody sees them; the folder's name."""
        folder = uuid.uuid4().hex
        for name, df in rows.items():
            schema = self.tables[name]
            df.select(F.lit(batch_id).alias(BATCH), *(F.col(f.name).cast(f.dataType) for f in schema[1:])).write.parquet(f"{self.path}/data/{folder}/{name}")
        return folder

    def commit(self, batch_id: str, rows: dict[str, DataFrame], replace: bool = False) -> bool:
        """Add a batch to all tables at once; False if it is there already. replace: it takes the place of what it was."""
        if not batch_id:
            raise ValueError("a batch needs an id")
        if not replace and batch_id in self.committed():
            return False
        folder = self.stage(batch_id, rows)

        def add(entries: list[dict]) -> list[dict] | None:
            there = any(batch_id in e["batches"] and batch_id not in e["gone"] for e in entries)
            if there and not replace:
                return None
            kept = [{**e, "gone": sorted({*e["gone"], batch_id})} if batch_id in e["batches"] else e for e in entries]
            return [*(e for e in kept if set(e["batches"]) - set(e["gone"])), {"folder": folder, "batches": [batch_id], "gone": [], "tables": sorted(rows)}]

        return self._change(add)

    def read(self, name: str) -> DataFrame:
        """A table's rows of all batches that count, as of now; of each folder only those that still do."""
        return self._rows(name, self._latest()[1])

    def _rows(self, name: str, entries: list[dict]) -> DataFrame:
        own = [e for e in entries if name in e["tables"]]
        parts = [[e["folder"] for e in own if not e["gone"]], *([e["folder"]] for e in own if e["gone"])]
        gone = [[], *(e["gone"] for e in own if e["gone"])]
        out = self.spark.createDataFrame([], self.tables[name])
        for folders, without in zip(parts, gone, strict=True):
            if folders:
                rows = self.spark.read.schema(self.tables[name]).parquet(*(f"{self.path}/data/{f}/{name}" for f in folders))
                out = out.unionByName(rows.filter(~F.col(BATCH).isin(without)) if without else rows)
        return out

    def compact(self) -> bool:
        """Make one folder of all that count now; batches that others add meanwhile stay as they are. False if there is nothing to gain."""
        number, entries = self._latest()
        if len(entries) < 2 and not any(e["gone"] for e in entries):
            return False
        folder = uuid.uuid4().hex
        for name in self.tables:
            self._rows(name, entries).coalesce(max(1, len(entries) // 8)).write.parquet(f"{self.path}/data/{folder}/{name}")
        old = {e["folder"]: set(e["batches"]) - set(e["gone"]) for e in entries}

        def swap(now: list[dict]) -> list[dict] | None:
            since = [e for e in now if e["folder"] not in old]
            live = {b for e in now if e["folder"] in old for b in set(e["batches"]) - set(e["gone"])}
            merged = sorted(set().union(*old.values()))
            if not live:  # another writer has merged them
                return None
            return [{"folder": folder, "batches": merged, "gone": sorted(set(merged) - live), "tables": sorted(self.tables)}, *since]

        return self._change(swap)

    def vacuum(self) -> int:
        """Delete folders and manifests that the last one doesn't need; their number. Only while nobody stages or reads an older state."""
        number, entries = self._latest()
        keep, gone = {e["folder"] for e in entries}, 0
        data = self._path("data")
        for f in self._files.listStatus(data) if self._files.exists(data) else []:
            if f.getPath().getName() not in keep:
                gone += self._files.delete(f.getPath(), True)
        for f in self._files.listStatus(self._path("manifests")):
            if f.getPath().getName() != str(number):
                gone += self._files.delete(f.getPath(), False)
        return gone
