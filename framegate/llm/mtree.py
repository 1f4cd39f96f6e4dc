"""Exact top-k inner-product search: an M-tree with best-first search.

Inner products become distances by one more coordinate: with x' = (x, sqrt(M - |x|^2)), M
the largest squared norm, and q' = (q, 0), |q' - x'|^2 = |q|^2 + M - 2 q.x, so the nearest x'
has the highest score. Scores themselves are whole numbers and are compared as such;
distances only prune, with a small slack.

The tree's top level are cells: pivots (at most MAX_PIVOTS rows, so their table is bounded)
with the covering radius of what is nearest to them. Cells with more than CELL_ROWS vectors
are split by hash. Below a cell lie pages: a routing vector, its distance to the pivot, a
covering radius, and entries with their distances to the routing vector. A search prunes
cells, then pages, then entries by the stored distances and the triangle inequality before
it computes anything.

A query first searches one cell of its nearest pivot; its k-th best there bounds the search
in every other cell. Queries meet cells in blocks of BLOCK.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framegate.llm.common import long_array, written

MAX_PIVOTS = 1024
CELL_ROWS = 4096
PAGE = 256
BLOCK = 4096
SLACK = 1e-6
#: Squared norms from here on could make scores that doubles do not hold exactly. Such vectors
#: stay out of the tree and meet the queries in blocks of exact products.
EXACT = float(1 << 53)
LONG = 1 << 63
#: Exact scores travel as hexadecimal text of so many digits, moved up by OFFSET, so that text
#: sorts as the numbers do: two components below 2^1024 each, over any number of components.
OFFSET, DIGITS = 1 << 2200, 552
#: The bound of a query whose first cell held too few vectors.
NO_BOUND = -(1 << 62)
#: The id left out of a search that leaves none out (ids of queries are divisible).
NOBODY = -(1 << 63) + 1


def fine_vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v, norm): floor(256 x) of every component, as double (which holds it exactly), and
    the square sum. Vectors that are null or hold null components or such that 256 x is not
    finite take no part, nor do rows without an id."""
    fine = F.expr("forall(vec, x -> x is not null and not isnan(x) and abs(256 * x) < double('Infinity'))")
    whole = F.transform("vec", lambda x: F.when(F.abs(x) < 1e12, F.floor(256 * x).cast("double")).otherwise(256 * x))
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(fine).select("id", whole.alias("v"))
    return rows.withColumn("norm", F.expr("aggregate(v, 0D, (s, x) -> s + x * x)"))


def whole_vectors(fine: DataFrame) -> DataFrame:
    """(id, v) of fine_vectors with v as long: those that every product of doubles is exact for."""
    return fine.filter(F.col("norm") < EXACT).select("id", F.col("v").cast("array<bigint>").alias("v"))


def exact_scores(q: list[float], rows: np.ndarray, norms: np.ndarray) -> list[int]:
    """Inner products of whole numbers held in doubles, exact whatever their size."""
    length = float(np.linalg.norm(np.array(q) / 2.0**512))  # no square overflows
    if length * float(norms.max(initial=0)) < 2.0 ** (62 - 1024):
        return (rows.astype(np.int64) @ np.array(q).astype(np.int64)).tolist()
    held = [(j, int(x)) for j, x in enumerate(q) if x]
    return [sum(x * int(row[j]) for j, x in held) for row in rows]


def blocked(asking: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(query_id, h1, h2, key, score, vec_id): the k best of each asking(id, h1, h2, v) in each
    block of candidates(id, v), both in doubles, by exact products; key sorts as the score does,
    score ends at the limits of a long. Work is queries times candidates; a task holds a block of each."""
    queries, rows = max(1, asking.count() // BLOCK), max(1, candidates.count() // BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asking.select(F.col("id").alias("own"), "h1", "h2", F.col("v").alias("q"), F.pmod("h1", F.lit(queries)).alias("b"), every(rows).alias("c"))
    right = candidates.select(F.col("id").alias("n"), F.col("v").alias("x"), every(queries).alias("b"), F.pmod(F.xxhash64("v", "id"), F.lit(rows)).alias("c"))

    def run(_key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            q, ids = left["q"].to_pylist(), right["n"].to_pylist()
            x = _matrix(right["x"], max(max(map(len, q)), max(np.asarray(right["x"].combine_chunks().value_lengths()))))
            norms = np.linalg.norm(x / 2.0**512, axis=1)
            for own, h1, h2, v in zip(*(left[c].to_pylist() for c in ("own", "h1", "h2")), q, strict=True):
                scores = exact_scores(v + [0.0] * (x.shape[1] - len(v)), x, norms)
                best = nsmallest(k, ((-s, n) for s, n in zip(scores, ids, strict=True) if n != own))
                out += [(own, h1, h2, sortable(-s), min(max(-s, -LONG), LONG - 1), n) for s, n in best]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array([r[j] for r in out], kind) for j, kind in enumerate(kinds)], ["query_id", "h1", "h2", "key", "score", "vec_id"])

    met = left.groupBy("b", "c").cogroup(right.groupBy("b", "c"))
    return met.applyInArrow(run, "query_id long, h1 long, h2 long, key string, score long, vec_id long")


def sortable(score: int) -> str:
    return f"{score + OFFSET:0{DIGITS}x}"


def _sortable():
    @F.arrow_udf("string")
    def key(scores: pa.Array) -> pa.Array:
        return pa.array([sortable(s) for s in scores.to_pylist()], pa.string())

    return key


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of numbers as float64 (whole numbers below 2^53 are exact), zeros after shorter ones."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten(), np.float64)
    if len(flat) == width * len(lengths):
        return flat.reshape(len(lengths), width)
    out = np.zeros((len(lengths), width))
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _lift(x: np.ndarray, most: float) -> np.ndarray:
    """With the last coordinate of a data vector."""
    return np.concatenate((x, np.sqrt(np.maximum(0, most - (x**2).sum(axis=1)))[:, None]), axis=1)


def _query(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.zeros((len(x), 1))), axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def build_pages(x: np.ndarray, pivot: np.ndarray, page: int = PAGE) -> list[tuple[int, float, float, np.ndarray, np.ndarray]]:
    """Bulk load: (row of the routing vector, its distance to the pivot, covering radius,
    rows, their distances to the routing vector) of every page."""
    out = []
    todo = [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) > page:
            n = min(16, -(-len(rows) // page) + 1)
            seeds = rows[np.linspace(0, len(rows) - 1, n).astype(int)]
            near = _distances(x[rows], x[seeds]).argmin(axis=1)
            parts = [rows[near == k] for k in range(n)]
            if max(map(len, parts)) == len(rows):  # all alike
                parts = np.array_split(rows, -(-len(rows) // page))
            todo += [p for p in parts if len(p)]
            continue
        centre = x[rows].mean(axis=0, keepdims=True)
        route = int(rows[_distances(x[rows], centre)[:, 0].argmin()])
        apart = _distances(x[rows], x[route : route + 1])[:, 0]
        up = float(_distances(x[route : route + 1], pivot[None])[0, 0])
        out.append((route, up, float(apart.max()), rows, apart))
    return out


class Cell:
    """A cell's pages, ready for searches."""

    def __init__(self, pages: pa.Table, width: int, most: float, pivot: np.ndarray):
        self.most, self.pivot = most, pivot
        self.route = _lift(_matrix(pages["route"], width), most)
        self.up, self.radius = (pages[c].to_numpy() for c in ("up", "radius"))
        self.entries = []
        for ids, v, apart in zip(pages["ids"], pages["entries"], pages["apart"], strict=True):
            x = np.frombuffer(v.as_py(), np.int64).astype(np.float64).reshape(-1, width)
            self.entries.append((ids.values, x, np.frombuffer(apart.as_py(), np.float64)))
        self.computed = self.offered = 0

    def best(self, q: np.ndarray, k: int, bound: float = -np.inf, own: int | None = None) -> list[tuple[int, int]]:
        """(score, id) of the k best, best first, equal scores by id, without the id own; what
        scores below the bound may be missing. Each entry stands for up to k equal vectors."""
        lifted = np.append(q, 0.0)
        norm = float(q @ q)

        def reach(score: float) -> float:  # no vector beyond this distance scores so high
            if score == -np.inf:
                return np.inf
            return np.sqrt(max(0.0, norm + self.most - 2 * score)) * (1 + SLACK) + SLACK

        far = reach(bound)
        to_pivot = float(np.sqrt(((lifted - self.pivot) ** 2).sum()))
        open_ = np.flatnonzero(np.abs(to_pivot - self.up) - self.radius <= far)
        if not len(open_):
            return []
        d = np.sqrt(((self.route[open_] - lifted) ** 2).sum(axis=1))
        least = np.maximum(0, d - self.radius[open_])
        found: list[tuple[int, int]] = []
        for j in np.argsort(least, kind="stable"):
            if least[j] > far:
                break
            ids, x, apart = self.entries[open_[j]]
            self.offered += len(x)
            near = np.flatnonzero(np.abs(d[j] - apart) <= far)
            self.computed += len(near)
            scores = x[near] @ q
            floor = max(bound, -found[k - 1][0] if len(found) >= k else -np.inf)
            for i in np.flatnonzero(scores >= floor):
                found += [(-int(scores[i]), n) for n in ids[int(near[i])].as_py() if n != own]
            if len(found) > k:
                found = sorted(found)[:k]
            else:
                found.sort()
            if len(found) >= k:
                far = min(far, reach(-found[k - 1][0]))
        return [(-s, n) for s, n in found]


@dataclass
class Top:
    """The top of the tree: pivots, their cells and the cells' covering radii. At most
    MAX_PIVOTS pivots; a cell more for every CELL_ROWS vectors (65 numbers a pivot)."""

    width: int
    most: float  # largest squared norm
    pivots: np.ndarray
    parts: list[int]  # cells of each pivot
    radius: np.ndarray  # of each cell; -inf for an empty one

    @property
    def first(self) -> np.ndarray:
        """Each pivot's first cell."""
        return np.concatenate(([0], np.cumsum(self.parts)))[:-1]

    @property
    def pivot_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.parts)), self.parts)

    def reach(self, q: np.ndarray, score: int) -> float:
        """No vector further from q scores as high."""
        if score == NO_BOUND:
            return np.inf
        return np.sqrt(max(0.0, (q**2).sum() + self.most - 2 * score)) * (1 + SLACK) + SLACK


def distinct_entries(rows: DataFrame, k: int) -> DataFrame:
    """(h1, h2, v, ids): each vector once with its k + 1 least ids, which is all that a
    result can hold, the query's own left out or not. The limit is applied before the shuffle too."""
    least = Window.partitionBy("h1", "h2").orderBy("id")
    return (
        rows.dropDuplicates(["h1", "h2", "id"])
        .withColumn("nth", F.row_number().over(least))
        .filter(F.col("nth") <= k + 1)
        .groupBy("h1", "h2")
        .agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids"))
    )


def placed_in_cells(entries: DataFrame) -> tuple[DataFrame, Top] | None:
    """Entries with their cell, and the top of the tree; None without vectors. The driver
    gets the pivots and a number or two for each pivot and cell."""
    norm = F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")
    n, width, most = entries.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
    if not n or not width:
        return None
    wanted = min(MAX_PIVOTS, -(-n // (CELL_ROWS // 2)))
    chosen = entries.orderBy("h1", "h2").limit(wanted).select("v").collect()  # the order of hashes is random
    pivots = np.zeros((len(chosen), width))
    for i, r in enumerate(chosen):
        pivots[i, : len(r[0])] = r[0]
    pivots = _lift(pivots, most)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = _distances(_lift(_matrix(batch.column(0), width), most), pivots)
            near = d.argmin(axis=1)
            apart = d[np.arange(len(near)), near]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(apart)], ["v", "ids", "h1", "pivot", "apart"])

    placed = written(entries.select("v", "ids", "h1").mapInArrow(place, "v array<bigint>, ids array<bigint>, h1 long, pivot int, apart double"), "placed")
    sizes = {r[0]: r[1] for r in placed.groupBy("pivot").count().collect()}
    top = Top(width, most, pivots, [max(1, -(-sizes.get(p, 0) // CELL_ROWS)) for p in range(len(pivots))], np.zeros(0))
    at = F.col("pivot") + 1
    cell = F.element_at(long_array(top.first.tolist()), at) + F.pmod("h1", F.element_at(long_array(top.parts), at))
    placed = placed.withColumn("cell", cell.cast("int"))
    top.radius = np.full(len(top.pivot_of), -np.inf)
    for r in placed.groupBy("cell").agg(F.max("apart").alias("radius")).collect():
        top.radius[r[0]] = r[1]
    return placed, top


def build_index(placed: DataFrame, top: Top) -> DataFrame:
    """One row a page."""

    def build(key: tuple, cell: pa.Table) -> pa.Table:
        x, c, ids = _matrix(cell["v"], top.width), key[0].as_py(), cell["ids"].to_pylist()
        pages = build_pages(_lift(x, top.most), top.pivots[top.pivot_of[c]])
        return pa.Table.from_arrays(
            [
                pa.array([c] * len(pages), pa.int32()),
                pa.array([x[p[0]].astype(np.int64).tolist() for p in pages], pa.list_(pa.int64())),
                pa.array([p[1] for p in pages]),
                pa.array([p[2] for p in pages]),
                pa.array([[ids[i] for i in p[3]] for p in pages], pa.list_(pa.list_(pa.int64()))),
                pa.array([x[p[3]].astype(np.int64).tobytes() for p in pages], pa.binary()),
                pa.array([p[4].tobytes() for p in pages], pa.binary()),
            ],
            ["cell", "route", "up", "radius", "ids", "entries", "apart"],
        )

    schema = "cell int, route array<bigint>, up double, radius double, ids array<array<bigint>>, entries binary, apart binary"
    return placed.select("cell", "v", "ids").groupBy("cell").applyInArrow(build, schema)


def routed(queries: DataFrame, top: Top) -> DataFrame:
    """queries (h1, h2, v, own, block, bound) with each cell that they must search: without a
    bound one cell of the nearest pivot, else all others in reach of the bound."""
    first, pivot_of, cells = top.first, top.pivot_of, np.arange(len(top.radius))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column(2), top.width)
            d = _distances(_query(q), top.pivots)
            near = d.argmin(axis=1)
            who, where = [np.zeros(0, int)], [np.zeros(0, int)]
            for i, (h, bound) in enumerate(zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), strict=True)):
                home = cells == first[near[i]] + h % top.parts[near[i]]
                found = np.flatnonzero(home if bound is None else ~home & (d[i][pivot_of] - top.radius <= top.reach(q[i], bound)))
                who.append(np.full(len(found), i))
                where.append(found)
            taken = batch.take(pa.array(np.concatenate(who)))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(np.concatenate(where).astype(np.int32))], ["h1", "h2", "v", "own", "block", "bound", "cell"])

    rows = queries.select("h1", "h2", "v", "own", "block", "bound")
    return rows.mapInArrow(run, "h1 long, h2 long, v array<bigint>, own long, block int, bound long, cell int")


def searched(queries: DataFrame, index: DataFrame, top: Top, blocks: int, k: int) -> DataFrame:
    """(h1, h2, own, score, vec_id): the k best of each query in each of its cells. Pages go once
    to each block of queries, so that a task holds one cell and one block."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            cell = Cell(right, top.width, top.most, top.pivots[top.pivot_of[right["cell"][0].as_py()]])
            q = _matrix(left["v"], top.width)
            for i, (h1, h2, own, bound) in enumerate(zip(*(left[c].to_pylist() for c in ("h1", "h2", "own", "bound")), strict=True)):
                out += [(h1, h2, own, s, n) for s, n in cell.best(q[i], k, -np.inf if bound in (None, NO_BOUND) else bound, own)]
        return pa.Table.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(5)], ["h1", "h2", "own", "score", "vec_id"])

    pages = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = queries.groupBy("cell", "block").cogroup(pages.groupBy("cell", "block"))
    return met.applyInArrow(search, "h1 long, h2 long, own long, score long, vec_id long")


def _hashed(rows: DataFrame) -> DataFrame:
    return rows.select("id", "v", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(3), "v").alias("h2"))


def _ranked(found: DataFrame, k: int, order: str) -> DataFrame:
    own = Window.partitionBy("query_id", "h1", "h2").orderBy(F.col(order).desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= k)


def top_k(table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding", tree: bool = True) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id is divisible by every, its k best
    other rows by inner product, ties to the smaller id (all, if there are fewer).

    Rows that repeat an id and a vector count once. Rows that share an id but not a vector are
    queries of their own, each with its list of k; rows with the query's id are no candidates.
    Vectors of unequal length are compared as if zeros followed the shorter. Vectors that are
    null or hold null or non-finite components (times 256) take no part. Ranks are by exact
    scores whatever their size; a score beyond a long is returned as the nearest long. An empty
    table gives no rows; other columns are ignored.

    Vectors too long for exact products of doubles (EXACT) stay out of the tree: queries meet
    them, and they as queries meet all rows, in blocks. tree=False does so with all vectors,
    which costs less where vectors lie so evenly that no bound avoids much.
    """
    fine = fine_vectors(table, id_col, vec_col)
    apart = fine.filter(F.col("norm") >= EXACT) if tree else fine
    if tree and apart.isEmpty():
        return _ranked(_in_tree(whole_vectors(fine), k, every), k, "score").select("query_id", "rank", "vec_id", "score")
    fine = written(_hashed(fine).dropDuplicates(["h1", "h2", "id"]), "fine")
    apart = fine.filter(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)") >= EXACT) if tree else fine
    ask = F.col("id") % every == 0
    found = blocked(fine.filter(ask), apart, k)
    if tree:
        small = fine.join(apart.select("h1", "h2", "id"), ["h1", "h2", "id"], "left_anti")
        found = found.unionByName(blocked(apart.filter(ask), small, k))
        inside = _in_tree(small.select("id", F.col("v").cast("array<bigint>").alias("v")), k, every)
        inside = inside.withColumn("key", _sortable()(F.col("score")))
        # The tree's hashes are of longs; those of the same vector in doubles name the query here.
        names = small.filter(ask).select("id", "h1", "h2", F.col("v").cast("array<bigint>").alias("w"))
        names = names.select(F.col("id").alias("query_id"), F.xxhash64("w").alias("t1"), F.xxhash64(F.lit(3), "w").alias("t2"), F.col("h1").alias("n1"), F.col("h2").alias("n2"))
        inside = inside.withColumnsRenamed({"h1": "t1", "h2": "t2"}).join(names, ["query_id", "t1", "t2"])
        found = found.unionByName(inside.select("query_id", F.col("n1").alias("h1"), F.col("n2").alias("h2"), "key", "score", "vec_id"))
    return _ranked(found, k, "key").select("query_id", "rank", "vec_id", "score")


def _in_tree(vectors: DataFrame, k: int, every: int) -> DataFrame:
    """(query_id, h1, h2, score, vec_id): each query's k best and more, from the tree of
    vectors(id, v). Queries with equal vectors are searched once, for k + 1, of which their own
    id goes; those whose id has several vectors are searched without these."""
    rows = written(_hashed(vectors), "vectors")
    tree = placed_in_cells(written(distinct_entries(rows, k), "entries"))
    if tree is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, h1 long, h2 long, score long, vec_id long")
    placed, top = tree
    index = written(build_index(placed, top), "mtree")
    asking = rows.filter(F.col("id") % every == 0).dropDuplicates(["h1", "h2", "id"])
    several = asking.groupBy("id").count().filter("count > 1").select("id", F.col("id").alias("own"))
    asking = written(asking.join(several, "id", "left").withColumn("own", F.coalesce("own", F.lit(NOBODY))), "asking")
    key = ["h1", "h2", "own"]
    asked = written(asking.select(*key, "v").dropDuplicates(key), "queries")
    blocks = max(1, asked.count() // BLOCK)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("h1", "own"), F.lit(blocks)).cast("int"))
    unbounded = asked.withColumn("bound", F.lit(None).cast("long"))
    at_home = written(searched(routed(unbounded, top), index, top, blocks, k + 1), "home")
    bounds = at_home.groupBy(key).agg(F.when(F.count("*") >= k + 1, F.min("score")).alias("bound"))
    bounded = asked.join(bounds, key, "left").withColumn("bound", F.coalesce("bound", F.lit(NO_BOUND)))
    away = searched(routed(bounded, top), index, top, blocks, k + 1)
    best = Window.partitionBy(key).orderBy(F.col("score").desc(), "vec_id")
    merged = at_home.unionByName(away).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k + 1).drop("nth")
    found = asking.select(F.col("id").alias("query_id"), *key).join(merged, key).filter("vec_id <> query_id")
    return found.select("query_id", "h1", "h2", "score", "vec_id")
