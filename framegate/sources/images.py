"""Image files as a table, and upload rules."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framegate.presets import MAX_SIDE, MAX_UPLOAD_BYTES, MIN_SIDE


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, length, height, width, n_channels, data (BGR). A file that cannot be decoded
    stays, with negative sizes, so that validation can name it."""
    pictures = spark.read.format("image").option("dropInvalid", False).load(path).select("image.*", F.col("_metadata.file_size").alias("length"))
    plain = F.regexp_replace("origin", "^file:/+", "file:/")
    return pictures.select(plain.alias("path"), "length", "height", "width", F.col("nChannels").alias("n_channels"), "data")


def gray_png(pixels: np.ndarray) -> bytes:
    """A PNG file of rows of bytes, one channel."""
    rows = np.concatenate((np.zeros((len(pixels), 1), np.uint8), pixels.astype(np.uint8)), axis=1)  # each row begins with its filter, none

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", pixels.shape[1], pixels.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(rows.tobytes())) + part(b"IEND", b"")


def write_files(files: DataFrame, name: str, data: str, folder: str) -> int:
    """Writes a file a row into a folder that driver and executors share, by the tasks; the same
    names again are overwritten, so a task may run twice. Returns how many rows there were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for n, body in zip(batch.column(0), batch.column(1), strict=True):
                with store.open_output_stream(f"{root}/{n}") as out:
                    out.write(body.as_py())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return files.select(name, data).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


Rules = Sequence[tuple[str, Column]]


def upload_rules(length: Column, height: Column, width: Column) -> Rules:
    """What is wrong with an upload, in the order in which it is told."""
    return (
        ("too large", length > MAX_UPLOAD_BYTES),
        ("not an image", height.isNull() | (height < 0)),
        ("too small", F.least(height, width) < MIN_SIDE),
        ("too many pixels", F.greatest(height, width) > MAX_SIDE),
    )


def first_violation(rules: Rules) -> Column:
    """The name of the first rule that holds; NULL if none does."""
    return F.coalesce(*[F.when(broken, name) for name, broken in rules])


def validate_items(df: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame]:
    """(good, quarantine); the latter with its violation."""
    told = df.withColumn("violation", first_violation(rules))
    return told.filter("violation is null").drop("violation"), told.filter("violation is not null")
