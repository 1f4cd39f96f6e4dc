"""A results table that a stream adds to: a batch that comes twice adds nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from framegate.sources.versions import Conflict, Versions, remove


@dataclass
class ResultTable:
    """Rows under opaque keys, in Parquet folders by day that a version names. A batch's folder
    and its number are committed together, so a batch that is written again after a
    failure is known and skipped. Writers go by names of their own. A batch leaves out keys that its
    days hold already; where another writer commits first, that is looked up again."""

    spark: SparkSession
    path: str
    key: str
    day: str

    @property
    def _versions(self) -> Versions:
        return Versions(self.spark, f"{self.path}/versions")

    def _held(self, parts: list[str], schema: StructType) -> DataFrame:
        found = [self.spark.read.schema(schema).parquet(part) for part in parts]
        return reduce(DataFrame.unionByName, found)

    def add(self, rows: DataFrame, writer: str, batch: int) -> bool:
        """Adds a batch and returns whether it was new. Of rows that share a key one is kept.
        Batches of a writer come in order of their numbers."""
        versions, part = self._versions, ""
        while True:
            base = versions.last()
            now = versions.read(base) or {"parts": [], "batches": {}}
            known = now["batches"].get(writer, -1) >= batch
            if part:  # another writer came first: what was written may hold keys of its batch
                remove(self.spark, part)
            if known:
                return False
            fresh = rows.dropDuplicates([self.day, self.key])
            if now["parts"]:
                held = self._held(now["parts"], rows.select(self.key, self.day).schema)
                held = held.join(rows.select(self.day).distinct(), self.day, "left_semi")
                fresh = fresh.join(held, [self.key, self.day], "left_anti").select(rows.columns)
            part = f"{self.path}/data/{uuid.uuid4().hex}"
            fresh.write.partitionBy(self.day).parquet(part)
            state = {"parts": [*now["parts"], part], "batches": now["batches"] | {writer: batch}, "schema": rows.schema.jsonValue()}
            try:
                versions.commit(state, base)
                return True
            except Conflict:
                continue

    def read(self) -> DataFrame | None:
        """All rows of the last version; None before the first."""
        now = self._versions.read(self._versions.last())
        if not now:
            return None
        return self._held(now["parts"], StructType.fromJson(now["schema"]))

    def sink(self, writer: str) -> Callable[[DataFrame, int], None]:
        """What foreachBatch takes."""
        return lambda rows, batch: self.add(rows, writer, batch)

    def drain(self, stream: DataFrame, writer: str, checkpoint: str) -> StreamingQuery:
        """Adds all that the stream's source holds now."""
        query = stream.writeStream.foreachBatch(self.sink(writer)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return query
