"""A token store: items by day of creation, and an index of tokens that is cleaned by copy-on-write.

Items lie in a Parquet table partitioned by day, so a sweep touches the days that can hold an
expired item and no other: days that hold nothing else are removed, the day that the limit
falls in is overwritten by its live rows. The index lies in buckets by hash of the token; a
version names the folders of each bucket, and a cleaning rewrites the buckets that hold an
orphan and commits the next version.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framegate.operators.policy import MICROS, orphan_index
from framegate.presets import TTL_SECONDS
from framegate.sources.versions import Versions, hadoop_path, remove

DAY_US = 86_400 * MICROS
#: The day of items without a creation time; they count as expired.
NO_DAY = -1
BUCKETS = 64


@dataclass
class TokenStore:
    """A store under one folder, which driver and executors share. Each token is put once."""

    spark: SparkSession
    path: str
    token: str = "token"
    created_us: str = "created_us"
    ttl_s: int = TTL_SECONDS
    buckets: int = BUCKETS

    @property
    def _items(self) -> str:
        return f"{self.path}/items"

    @property
    def _versions(self) -> Versions:
        return Versions(self.spark, f"{self.path}/index-versions")

    def _day(self) -> Column:
        at = F.col(self.created_us)
        return F.coalesce(((at - F.pmod(at, F.lit(DAY_US))) / DAY_US).cast("long"), F.lit(NO_DAY))

    def _schema(self, like: DataFrame | None = None) -> StructType:
        """The columns of all items, as the first put has them; like must have the same."""
        kept = Versions(self.spark, f"{self.path}/schema")
        if like is not None:
            kept.change(lambda now: None if now else {"schema": like.schema.jsonValue()})
        schema = StructType.fromJson(kept.read(1)["schema"])
        if like is not None and [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in like.schema]:
            raise ValueError(f"the store has other columns: {schema.simpleString()}")
        return schema

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.token)), F.lit(self.buckets)).cast("int")

    # -- writes -----------------------------------------------------------------------

    def put(self, items: DataFrame) -> None:
        """Adds items and then their tokens to the index, so a token of the index has its item
        from the start. A writer that is lost in between leaves items without a token, which
        a sweep takes as it takes others. Items of other columns than the first are an error."""
        self._schema(items)
        items.withColumn("day", self._day()).write.mode("append").partitionBy("day").parquet(self._items)
        self.put_index(items)

    def put_index(self, tokens: DataFrame) -> None:
        """Adds tokens to the index alone."""
        made = self._bucketed(tokens)
        self._versions.change(lambda now: {b: [*now.get(b, []), *made.get(b, [])] for b in {*now, *made}})

    def _bucketed(self, tokens: DataFrame) -> dict[str, list[str]]:
        """Writes tokens by bucket; the folders of each."""
        folder = f"{self.path}/index/{uuid.uuid4().hex}"
        rows = tokens.select(self.token, self._bucket().alias("bucket"))
        rows.repartition("bucket").write.partitionBy("bucket").parquet(folder)
        fs, where = hadoop_path(self.spark, folder)
        held = [n.split("=")[1] for s in fs.listStatus(where) if (n := s.getPath().getName()).startswith("bucket=")]
        return {b: [f"{folder}/bucket={b}"] for b in held}

    def sweep(self, as_of_us: int) -> DataFrame:
        """Removes items that are older than the time to live, and returns (day, evicted, kept)
        of the days that lost any. Days after the limit are not read. A sweep that breaks off
        is finished by the next."""
        limit = as_of_us - self.ttl_s * MICROS
        gone = F.col(self.created_us).isNull() | (F.col(self.created_us) < limit)
        near = self.items(with_day=True).filter(F.col("day") <= limit // DAY_US)  # only these folders are listed and read
        told = near.groupBy("day").agg(F.count_if(gone).alias("evicted"), F.count_if(~gone).alias("kept")).filter("evicted > 0")
        days = [tuple(r) for r in told.collect()]  # a row a day of the retention time
        split = [day for day, _, kept in days if kept]
        if split:
            aside = f"{self.path}/aside/{uuid.uuid4().hex}"
            near.filter(F.col("day").isin(split) & ~gone).write.parquet(aside)
            live = self.spark.read.schema(near.schema).parquet(aside)
            live.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self._items)
            remove(self.spark, aside)
        for day in {d for d, *_ in days} - set(split):
            remove(self.spark, f"{self._items}/day={day}")
        return self.spark.createDataFrame(days, "day long, evicted long, kept long")

    def clean_index(self) -> int:
        """Takes tokens without an item from the index and returns how many. Only buckets
        that hold such a token are rewritten; folders of earlier versions stay for readers
        that began on them, until vacuum()."""
        cleaned = 0

        def without_orphans(now: dict) -> dict | None:
            nonlocal cleaned
            index, items = self._read(now), self.items()
            orphans = orphan_index(index, items, self.token)
            per = {r["bucket"]: r["count"] for r in orphans.groupBy(self._bucket().alias("bucket")).count().collect()}  # a row a bucket
            cleaned = sum(per.values())
            if not per:
                return None
            left = self._read({str(b): now[str(b)] for b in per}).join(items.select(self.token), self.token, "left_semi")
            made = self._bucketed(left)
            return {b: folders for b in now if (folders := made.get(b, []) if int(b) in per else now[b])}

        self._versions.change(without_orphans)
        return cleaned

    def vacuum(self) -> None:
        """Removes folders of the index that the last version does not name."""
        versions = self._versions
        now = {f for folders in versions.read(versions.last()).values() for f in folders}
        for v in range(1, versions.last()):
            for f in {f for folders in versions.read(v).values() for f in folders} - now:
                remove(self.spark, f)

    # -- reads ------------------------------------------------------------------------

    def items(self, with_day: bool = False) -> DataFrame:
        rows = self.spark.read.schema(self._schema().add("day", "long")).parquet(self._items)
        return rows if with_day else rows.drop("day")

    def index(self) -> DataFrame:
        """Tokens of the last version."""
        return self._read(self._versions.read(self._versions.last()))

    def _read(self, version: dict) -> DataFrame:
        folders = [f for b in sorted(version, key=int) for f in version[b]]
        if not folders:
            return self.items().select(self.token).limit(0)
        return self.spark.read.parquet(*folders).select(self.token)
