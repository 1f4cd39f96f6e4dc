"""Mixing sources to target weights by entropy balancing.

Document rates minimise their (bounded, Fermi-Dirac) relative entropy to one copy each,
subject to each source's words meeting its target. The minimiser is an exponential tilt,
rate = 2 / (1 + exp(-lambda * size / mean size)), with one multiplier a source: at lambda 0
each document is taken once, and no rate passes 2. The dual is convex; its Newton steps,
kept inside a bracket, need two sums a source, which Spark makes over the table of
(source, size) counts in each round.

Rates are rounded into whole copies from the longest documents to the shortest, carrying
the words missed so far, so a source ends about its shortest document from its target.
Which documents of equal source and size get the extra copy is decided by hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framegate.llm.common import WORD, as_struct, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SMALL = 10_000
PER_SALT = 2_000


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        row_hash(id_col, text, source_col).alias("h"),
    )


def row_hash(id_col: str, text: Column, source_col: str) -> Column:
    """Of the id, the text and the source, a null of which differs from an empty one."""
    return F.xxhash64(F.col(id_col), text, F.col(source_col), F.col(source_col).isNull())


def targets(sizes: DataFrame) -> DataFrame:
    """(source, sid, source_size, n, target): sources by code point, null last, weigh
    WEIGHTS in turn; shares of SHARE times all words; no target above MOST times its source,
    the excess reshared by weight. Windows run over one row a source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(order)
    per = per.withColumn("sid", turn).withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (turn - 1) % len(WEIGHTS) + 1).cast("double"))
    every = Window.partitionBy(F.lit(0))
    rising = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("cap", (MOST * F.col("source_size")).cast("double"))
    per = per.withColumn("goal", SHARE * F.sum("source_size").over(every)).withColumn("all_w", F.sum("w").over(every))
    left = F.col("goal") - F.coalesce(F.sum("cap").over(rising), F.lit(0.0))
    left_w = F.col("all_w") - F.coalesce(F.sum("w").over(rising), F.lit(0.0))
    per = per.withColumn("full", left / left_w >= F.col("cap") / F.col("w"))
    spare = F.col("goal") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)
    open_w = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(every)
    level = F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * spare / F.when(open_w > 0, open_w))
    return per.select("source", "sid", "source_size", "n", F.least(level, F.col("cap")).alias("target"), "full")


def _joined(big: DataFrame, small: DataFrame, rows: int, on: list[str]) -> DataFrame:
    """A broadcast only where the counted rows are few; else a join that AQE can split."""
    return big.join(F.broadcast(small) if rows <= SMALL else small, on)


def rate(lam: Column, size: Column, mean: Column) -> Column:
    return F.lit(float(MOST)) / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), lam * size / mean))))


def balance(bins: DataFrame, aims: DataFrame, n_sources: int, rounds: int = 80, close: float = 1e-9) -> DataFrame:
    """lambda of every source, by Newton steps on the dual inside a bracket."""
    state = aims.select(
        "sid", "target", (F.col("source_size") / F.col("n")).alias("mean"), F.lit(0.0).alias("lam"), F.lit(-1e4).alias("lo"), F.lit(1e4).alias("hi"), F.lit(False).alias("done")
    ).filter(~aims["full"] & (F.col("source_size") > 0))
    for _ in range(rounds):
        r = rate(F.col("lam"), F.col("size"), F.col("mean"))
        words = F.col("n_docs") * F.col("size")
        sums = (
            _joined(bins, state.select("sid", "lam", "mean"), n_sources, ["sid"])
            .groupBy("sid")
            .agg(F.sum(words * r).alias("got"), F.sum(words * F.col("size") / F.col("mean") * r * (1 - r / MOST)).alias("slope"))
        )
        both = state.join(sums, "sid")
        miss = F.col("got") - F.col("target")
        lo = F.when(miss < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(miss > 0, F.col("lam")).otherwise(F.col("hi"))
        newton = F.col("lam") - miss / F.when(F.col("slope") > 0, F.col("slope"))
        done = (F.abs(miss) <= close * F.col("target")) | (hi - lo <= 1e-12 * F.greatest(F.abs(lo), F.lit(1e-3)))
        step = F.when(done, F.col("lam")).when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        state = written(both.select("sid", "target", "mean", step.alias("lam"), lo.alias("lo"), hi.alias("hi"), done.alias("done")), "multipliers")
        if state.filter(~F.col("done")).isEmpty():
            break
    else:
        raise RuntimeError(f"multipliers did not settle in {rounds} rounds")
    return state.select("sid", "lam", "mean")


def _round(bins: pd.DataFrame) -> pd.DataFrame:
    """Whole copies for one source's (size, n_docs, rate), longest first, carrying words."""
    bins = bins.sort_values("size", ascending=False)
    carry, copies = 0.0, []
    for size, n, r in zip(bins["size"], bins["n_docs"], bins["rate"], strict=True):
        want = r * n
        k = int(min(MOST * n, max(0, np.floor(want + (carry / size if size else 0) + 0.5))))
        carry += (want - k) * size
        copies.append(k)
    return pd.DataFrame({"sid": bins["sid"], "size": bins["size"], "copies_all": copies, "docs_all": bins["n_docs"]})


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, size, source_size, target, taken and copies of every row.

    Size: words of the text (null: 0). Null sources form one source, the last. Texts without
    words keep one copy. Repeated rows are separate rows; which of them gets an extra copy
    makes no difference. An empty table gives no rows; other columns are ignored. Of a text,
    however long, only its number of words travels.
    """
    sizes = written(sized(docs, id_col, text_col, source_col), "sizes")
    aims = written(targets(sizes), "targets")
    n_sources, n_docs = aims.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    key = aims.select(F.col("source").alias("of"), "sid")
    known = sizes.join(F.broadcast(key) if n_sources <= SMALL else key, sizes.source.eqNullSafe(F.col("of")))
    salts = max(1, n_docs // PER_SALT)
    known = known.select("id", "sid", "size", "h", F.pmod("h", F.lit(salts)).alias("salt"))
    salted = written(known.groupBy("sid", "size", "salt").agg(F.count("*").alias("n_docs")), "salted")
    bins = written(salted.groupBy("sid", "size").agg(F.sum("n_docs").alias("n_docs")), "bins")
    lam = balance(bins, aims, n_sources)
    rated = (
        bins.join(aims.select("sid", "full"), "sid")
        .join(lam, "sid", "left")
        .select(
            "sid", "size", "n_docs",
            F.when(F.col("size") == 0, 1.0).when(F.col("full"), float(MOST)).otherwise(F.coalesce(rate(F.col("lam"), F.col("size"), F.col("mean")), F.lit(1.0))).alias("rate"),
        )
    )
    rounded = rated.groupBy("sid").applyInPandas(_round, "sid int, size long, copies_all long, docs_all long")
    upto = F.sum("n_docs").over(Window.partitionBy("sid", "size").orderBy("salt"))
    part = salted.join(rounded, ["sid", "size"]).withColumn("upto", upto)
    share = F.expr("copies_all * upto div docs_all - copies_all * (upto - n_docs) div docs_all")
    part = part.select("sid", "size", "salt", "n_docs", share.alias("k"))
    rank = F.row_number().over(Window.partitionBy("sid", "size", "salt").orderBy("h", "id"))
    copies = F.expr("k div n_docs + if(rank <= k % n_docs, 1, 0)")
    chosen = known.withColumn("rank", rank).join(part, ["sid", "size", "salt"]).withColumn("copies", copies)
    facts = aims.select("sid", "source_size", "target")
    return _joined(chosen, facts, n_sources, ["sid"]).select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "h"
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as the mix takes it. Rows meet their number of copies
    by id and hash of text and source; rows alike in these share the sum of theirs, and a
    hash of the whole row decides which has one more. Texts move once. Other columns come
    along, whatever their names; null texts and repeated rows are rows like others; an empty
    table stays empty."""
    unnamed = F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("idk")
    taken = (
        mix(docs, id_col, text_col, source_col)
        .groupBy("h", unnamed)
        .agg(F.sum("copies").alias("all_copies"), F.count("*").alias("n_rows"))
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(as_struct(docs).alias("row"), row_hash(id_col, text, source_col).alias("h"), unnamed)
    met = keyed.join(taken, ["h", "idk"])
    nth = F.row_number().over(Window.partitionBy("h", "idk").orderBy(F.xxhash64("row")))
    times = F.expr("cast(all_copies div n_rows + if(nth <= all_copies % n_rows, 1, 0) as int)")
    met = met.withColumn("nth", nth).withColumn("times", times).filter("times > 0")
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy")).select("row.*")
