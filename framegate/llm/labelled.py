"""A bounded sample of labelled documents to learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framegate.llm.common import learnable, written


#: A sample's texts together: characters, and LINE more for each line.
FIT_SIZE, LINE = 80_000_000, 100


def sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, fit_docs: int, fit_size: int = FIT_SIZE) -> DataFrame:
    """(text, y) of labelled documents of any length, whole, in an order by hash: at most fit_docs,
    and as many as come before their texts together pass fit_size. Only ids of docs whose crc32 mod
    5 is not 0 count, so labels of other tables' ids take no place. An id with several labels has
    the commoner one (a tie: 1); null labels and ids are left out; a null text is empty; of
    rows that share an id the least text is taken. The chosen ids, fit_docs at most, are
    broadcast; texts stay with the executors."""
    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    per = (
        labels.select(F.col(id_col).cast("long").alias("k"), F.col(label_col).cast("int").alias("y"))
        .filter(F.col("k").isNotNull() & F.col("y").isNotNull())
        .filter(learnable(F.col("k")))
        .groupBy("k")
        .agg((F.avg("y") >= 0.5).cast("long").alias("y"))
        .join(rows.select("k"), "k", "left_semi")
    )
    chosen = written(per.orderBy(F.xxhash64("k"), "k").limit(fit_docs), "labelled-ids")
    found = rows.join(F.broadcast(chosen), "k").groupBy("k").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    size = F.length("text") + LINE * F.size(F.split("text", "\n"))
    found = written(found.withColumn("size", size.cast("long")), "labelled-texts")
    upto = Window.orderBy(F.xxhash64("k"), "k").rowsBetween(Window.unboundedPreceding, -1)  # fit_docs numbers at most
    fit = found.select("k", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("before")).filter(F.col("before") < fit_size)
    return found.join(F.broadcast(fit.select("k")), "k").select("text", "y")
