"""What the operators of this subpackage share: tables, the shared folder, literals."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python task works on at a time (a longer text is taken alone).
CHUNK_BYTES = 2_000_000

#: `[\x20\x09-\x0D]`, for SQL's trim functions.
BLANKS = " \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir of the
    session. Where that is unset a temporary one is made on a single machine, and on a
    cluster nothing runs."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not root:
        root = tempfile.mkdtemp(prefix="framegate-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: it is computed once, and a lost executor
    costs a new read, not a new computation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def as_struct(df: DataFrame) -> Column:
    """All columns of a row in one, so that no name of a caller's column meets one of ours."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def free_name(name: str, df: DataFrame) -> str:
    """The name, with as many _ after it as it takes not to be one of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of few MB, so that long texts do not add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def long_array(values: list[int]) -> Column:
    """A constant array<bigint> that is folded into one literal."""
    if not values:
        return F.expr("cast(array() as array<bigint>)")
    return F.expr(f"cast(split('{','.join(map(str, values))}', ',') as array<bigint>)")


def ascii_lower(col: Column) -> Column:
    """A-Z to a-z and nothing else. lower() does just that where every character is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(col) == F.octet_length(col), F.lower(col)).otherwise(
        F.translate(col, upper, upper.lower())
    )


def learnable(doc_id: Column) -> Column:
    """Rows whose labels may be learned from: crc32 of the id as text, mod 5, is not 0."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
