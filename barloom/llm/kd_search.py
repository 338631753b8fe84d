"""Exact top-k inner products with a KD-tree per shard.

Vectors become whole numbers. Median splits learned from a bounded sample cut
the space into cells, and a cell with many rows into several shards by hash; the
splits only decide which rows lie together, never a result. One task learns them
and the driver gets only the splits, since a sample of wide vectors is large. Each shard is one
KD-tree: median splits of the widest dimension down to small leaves, with the
tight bounding box of every node, stored as one packed row.

A box bounds the inner product of a query with whatever lies in it. Every query
first searches the shard of its most promising cell. The kth score found there
goes with it to the other shards: cells whose box stays below it are never
visited, nor are subtrees. Within a tree, queries are taken in blocks: bounds are
computed level by level for what is still open, and leaves are visited best bound
first until the bound falls below the kth score, which rises on the way. A
child's bound never exceeds its parent's, so this is the order of a best-first
walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import quote, settle

SHARD_ROWS = 8192
LEAF_ROWS = 64
QUERY_ROWS = 2048
# Vectors from which the cells are learned, the most cells, and the most values that all their lower edges have.
SAMPLE_ROWS = 20_000
MOST_CELLS = 1024
BOX_VALUES = 1 << 20

NOTHING = np.iinfo(np.int64).min
EXACT = 1 << 53


def pack(values: np.ndarray) -> bytes:
    """Whole numbers in the smallest type that holds them."""
    for kind in "bhi":
        limits = np.iinfo(kind)
        if not values.size or (values.min() >= limits.min and values.max() <= limits.max):
            return kind.encode() + values.astype(kind).tobytes()
    return b"q" + values.astype(np.int64).tobytes()


def unpack(data: bytes, width: int | None = None) -> np.ndarray:
    values = np.frombuffer(data, data[:1].decode(), offset=1).astype(np.int64)
    return values if width is None else values.reshape(-1, width)


def _most(values: np.ndarray) -> int:
    return max(abs(int(values.min())), abs(int(values.max()))) if values.size else 0


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``a`` with those of ``b``, held to 64 bits."""
    if _most(a) * _most(b) * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    limits = np.iinfo(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, limits.min, limits.max).astype(np.int64)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product that a query can have in a box."""
    sides = np.concatenate((np.maximum(queries, 0), np.minimum(queries, 0)), axis=1)
    return products(sides, np.concatenate((high, low), axis=1))


class Tree:
    """Rows in leaf order; nodes in heap order, node ``i`` above ``2 i + 1`` and ``2 i + 2``."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.ids, self.rows, self.low, self.high = ids, rows, low, high
        self.depth = (len(low) + 1).bit_length() - 2
        self.ends = _ends(len(rows), self.depth)

    @staticmethod
    def build(ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
        depth = max(0, (-(-len(rows) // leaf_rows) - 1).bit_length())
        order = np.arange(len(rows))
        low = np.empty((2 ** (depth + 1) - 1, rows.shape[1]), np.int64)
        high = np.empty_like(low)
        for level in range(depth + 1):
            ends = _ends(len(rows), level)
            for k in range(2 ** level):
                part = order[ends[k]:ends[k + 1]]
                node = 2 ** level - 1 + k
                inside = rows[part]
                low[node], high[node] = inside.min(axis=0), inside.max(axis=0)
                if level < depth and rows.shape[1]:
                    widest = int(np.argmax(high[node] - low[node].astype(np.float64)))
                    half = _ends(len(rows), level + 1)[2 * k + 1] - ends[k]
                    order[ends[k]:ends[k + 1]] = part[np.argpartition(inside[:, widest], min(half, len(part) - 1))]
        return Tree(ids[order], rows[order], low, high)

    def open_leaves(self, queries: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Bounds of (query, leaf), lowest where a box above the leaf stays below the query's floor."""
        bound = np.full((len(queries), 1), np.iinfo(np.int64).max)
        for level in range(self.depth + 1):
            nodes = slice(2 ** level - 1, 2 ** (level + 1) - 1)
            above = np.repeat(bound, 2, axis=1) if level else bound
            alive = above >= floor[:, None] if level else np.ones_like(above, bool)
            rows, columns = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            bound = np.full(above.shape, NOTHING)
            bound[np.ix_(rows, columns)] = bounds(queries[rows], self.low[nodes][columns], self.high[nodes][columns])
            bound[~alive | (bound < floor[:, None])] = NOTHING
        return bound

    def search(self, numbers: np.ndarray, queries: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of the best ``k`` of each query that reach its floor; its own id left out."""
        floor = floor.copy()
        bound = self.open_leaves(queries, floor)
        order = np.argsort(bound, axis=1, kind="stable")[:, ::-1]
        bound = np.take_along_axis(bound, order, axis=1)
        none = np.empty(0, np.int64)
        held, at, step = (none, none, none), 0, 1
        while at < order.shape[1]:
            near = bound[:, at:at + step]
            query, place = np.nonzero((near >= floor[:, None]) & (near > NOTHING))
            if not len(query):
                break
            leaf = order[query, at + place]
            by_leaf = np.argsort(leaf, kind="stable")
            query, leaf = query[by_leaf], leaf[by_leaf]
            found = [held]
            for part in np.split(np.arange(len(leaf)), np.flatnonzero(np.diff(leaf)) + 1):
                low, high = self.ends[leaf[part[0]]], self.ends[leaf[part[0]] + 1]
                asked, ids = query[part], self.ids[low:high]
                score = products(queries[asked], self.rows[low:high])
                row, column = np.nonzero((score >= floor[asked, None]) & (ids != numbers[asked, None]))
                found.append((asked[row], ids[column], score[row, column]))
            held = _best(*map(np.concatenate, zip(*found)), k)
            rank = np.arange(len(held[0])) - np.searchsorted(held[0], held[0])
            floor[held[0][rank == k - 1]] = held[2][rank == k - 1]
            at, step = at + step, step * 2
        return held


def _ends(rows: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end."""
    return np.arange(2 ** level + 1) * rows // 2 ** level


def _best(query: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -score, query))
    query = query[order]
    order = order[np.arange(len(query)) - np.searchsorted(query, query) < k]
    return query[np.arange(len(query)) - np.searchsorted(query, query) < k], ids[order], score[order]


def _extents(rows: np.ndarray, part: np.ndarray) -> np.ndarray:
    """How far each dimension reaches within the rows numbered ``part``, taken a block at a time."""
    blocks = (rows[part[at:at + 1024]] for at in range(0, len(part), 1024))
    low, high = (np.array(x) for x in zip(*((b.min(axis=0), b.max(axis=0)) for b in blocks)))
    return high.max(axis=0) - low.min(axis=0).astype(np.float64)


class Cells:
    """Median splits in heap order; a row goes right where its value is above the split's."""

    def __init__(self, dims: np.ndarray, values: np.ndarray):
        self.dims, self.values = dims, values
        self.depth = (len(dims) + 1).bit_length() - 1

    @staticmethod
    def learn(sample: np.ndarray, wanted: int) -> Cells:
        """Splits of a sample of any whole type; nodes hold row numbers, so it is not copied."""
        depth = max(0, min(wanted, len(sample) // 8) - 1).bit_length()
        dims, values = np.zeros(2 ** depth - 1, np.int64), np.full(2 ** depth - 1, np.iinfo(np.int64).max)
        parts = {0: np.arange(len(sample))}
        for node in range(2 ** depth - 1):
            part = parts.pop(node)
            left = np.ones(len(part), bool)
            if len(part):
                widest = int(np.argmax(_extents(sample, part)))
                column = sample[part, widest]
                dims[node], values[node] = widest, np.partition(column, (len(part) - 1) // 2)[(len(part) - 1) // 2]
                left = column <= values[node]
            parts[2 * node + 1], parts[2 * node + 2] = part[left], part[~left]
        return Cells(dims, values)

    def __len__(self) -> int:
        return 2 ** self.depth

    def of(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (rows[np.arange(len(rows)), self.dims[node]] > self.values[node])
        return node - (len(self) - 1)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, width) if width else np.empty((len(column), 0), np.int64)


def _squeezed(width: int):
    """The vectors of a batch as one packed row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([pack(_matrix(batch.column(0), width))], pa.binary())], names=["rows"])
    return run


def _learned(width: int, wanted: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = [x.as_py() for batch in batches for x in batch.column(0)]
        pieces = [np.frombuffer(x, x[:1].decode(), offset=1).reshape(-1, width) for x in packed]
        cells = Cells.learn(np.concatenate(pieces) if pieces else np.empty((0, width), np.int64), wanted)
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.list_(pa.int64())) for x in (cells.dims, cells.values)], names=["dims", "values"])
    return run


def _cells(sample: DataFrame, width: int, wanted: int) -> Cells:
    """Cells learned in one task from the ``vector`` column of ``sample``; only their splits come to the driver."""
    wanted = min(wanted, MOST_CELLS, 1 << (BOX_VALUES // width).bit_length() >> 1) if width else 1
    splits = wanted > 1 and sample.mapInArrow(_squeezed(width), "rows binary").repartition(1).mapInArrow(
        _learned(width, wanted), "dims array<long>, values array<long>").first()
    return Cells(*(np.array(x, np.int64) for x in splits or ([], [])))


def _placed(cells, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = cells.value.of(_matrix(batch.column(2), width))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], names=["row", "id", "vector", "cell"])
    return run


def _boxes(width: int):
    """Per batch and cell: rows, and the least and largest value of each dimension."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, rows = batch.column(0).to_numpy(), _matrix(batch.column(1), width)
            order = np.argsort(cell, kind="stable")
            starts = np.flatnonzero(np.diff(cell[order], prepend=-1))
            if not len(starts):
                continue
            low, high = (f.reduceat(rows[order], starts, axis=0) for f in (np.minimum, np.maximum))
            yield pa.RecordBatch.from_arrays([
                pa.array(cell[order][starts]), pa.array(np.diff(np.append(starts, len(cell)))),
                *[pa.array(list(x), pa.list_(pa.int64())) for x in (low, high)]], names=["cell", "n", "low", "high"])
    return run


def _built(width: int):
    def run(table: pa.Table) -> pa.Table:
        tree = Tree.build(table["id"].to_numpy(), _matrix(table["vector"].combine_chunks(), width))
        packed = [pack(x) for x in (tree.ids, tree.rows, tree.low, tree.high)]
        return pa.table({"cell": table["cell"][:1], "part": table["part"][:1].cast(pa.int64()),
                         **{n: pa.array([p], pa.binary()) for n, p in zip(("ids", "rows", "low", "high"), packed)}})
    return run


def _asked(plan, width: int, first: bool):
    """Queries packed by the shards they go to: at first the one of the best cell, later all others that their floor leaves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, parts = plan.value
        full = np.flatnonzero(parts)
        for whole in batches:
            for at in range(0, whole.num_rows, QUERY_ROWS):
                batch = whole.slice(at, QUERY_ROWS)
                row, number, floor = (batch.column(i).to_numpy() for i in (0, 1, 3))
                queries = _matrix(batch.column(2), width)
                bound = bounds(queries, low[full], high[full])
                home = np.argmax(bound, axis=1)
                home_part = row % parts[full][home]
                for k, cell in enumerate(full):
                    goes = home == k if first else bound[:, k] >= floor
                    for part in range(parts[cell]):
                        here = (home == k) & (home_part == part)
                        own = np.flatnonzero(goes & here if first else goes & ~here)
                        if len(own):
                            yield pa.RecordBatch.from_arrays([
                                pa.array([cell], pa.int64()), pa.array([part], pa.int64()),
                                *[pa.array([pack(x[own])], pa.binary()) for x in (row, number, queries, floor)]],
                                names=["cell", "part", "query_rows", "numbers", "vectors", "floors"])
    return run


def _found(k: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids, rows, low, high, own, numbers, vectors, floors = (c[i].as_py() for c in batch.columns)
                tree = Tree(unpack(ids), *(unpack(x, width) if width else np.empty((n, 0), np.int64) for x, n in (
                    (rows, len(unpack(ids))), (low, 1), (high, 1))))
                number = unpack(numbers)
                queries = unpack(vectors, width) if width else np.empty((len(number), 0), np.int64)
                query, vec, score = tree.search(number, queries, unpack(floors), k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(unpack(own)[query]), pa.array(number[query]), pa.array(vec), pa.array(score)], names=["row", "query_id", "vec_id", "score"])
    return run


def whole_numbers(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of the rows that take part, each component as ``floor(scale * x)``."""
    vector = F.col(quote(vector_col)).cast("array<double>")

    def unfit(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    return vectors.select(F.col(quote(id_col)).cast("long").alias("id"), vector.alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", unfit)).select(
        "id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("vector"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_col: str = "vec_id",
          vector_col: str = "embedding", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the highest inner product for each query: query_id, rank (from 1), vec_id, score.

    Components count as ``floor(scale * x)``, beyond 64 bits as the nearest
    64-bit value, and so do scores. Equal scores go by the smaller id. Rows of
    the query's own id are no candidates; fewer candidates give fewer rows. Rows
    with a null id or vector, or a component that is null or not finite, take no
    part, nor do vectors of another length than the commonest of ``vectors`` (of
    equally common ones the longest). Repeated rows are candidates each; a query
    row that repeats id and vector is asked once, one that repeats the id only
    is answered apart. Ids are whole numbers. Empty tables give an empty result.
    Only the two named columns are read. ``shard_rows`` changes no result.
    """
    if k < 1 or shard_rows < 1:
        raise ValueError("k and shard_rows must be positive")
    spark = vectors.sparkSession
    share = spark.sparkContext.broadcast
    fit = settle(whole_numbers(vectors, scale, id_col, vector_col), "vectors")
    length = fit.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if length is None:
        return spark.createDataFrame([], result)
    width, count = length["size"], length["count"]
    of_length = F.size("vector") == width
    drawn = F.pmod(F.xxhash64("id", "vector"), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / count) * (1 << 30))
    cells = _cells(fit.where(of_length & drawn).select("vector").distinct(), width, -(-count // shard_rows))
    placed = settle(fit.where(of_length).select(F.monotonically_increasing_id().alias("row"), "id", "vector").mapInArrow(
        _placed(share(cells), width), "row long, id long, vector array<long>, cell long"), "placed")
    # At most MOST_CELLS boxes.
    partial = settle(placed.select("cell", "vector").mapInArrow(_boxes(width), "cell long, n long, low array<long>, high array<long>"), "boxes")
    sizes = np.zeros(len(cells), np.int64)
    for cell, n in partial.groupBy("cell").agg(F.sum("n")).collect():
        sizes[cell] = n
    low, high = (np.zeros((len(cells), width), np.int64) for _ in range(2))
    edges = partial.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("at", "box")).groupBy("cell", "at").agg(
        F.min("box.low").alias("low"), F.max("box.high").alias("high")).toArrow()
    low[edges["cell"].to_numpy(), edges["at"].to_numpy()] = edges["low"].to_numpy()
    high[edges["cell"].to_numpy(), edges["at"].to_numpy()] = edges["high"].to_numpy()
    parts = -(-sizes // shard_rows)
    shards = F.broadcast(spark.createDataFrame([(c, int(p)) for c, p in enumerate(parts)], "cell long, parts long"))
    trees = settle(placed.join(shards, "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).select(
        "cell", "part", "id", "vector").groupBy("cell", "part").applyInArrow(
        _built(width), "cell long, part long, ids binary, rows binary, low binary, high binary"), "trees")

    asked = settle(whole_numbers(queries, scale, id_col, vector_col).where(of_length).distinct().select(
        F.monotonically_increasing_id().alias("row"), "id", "vector"), "queries")
    plan = share((low, high, parts))
    packed = "cell long, part long, query_rows binary, numbers binary, vectors binary, floors binary"

    def searched(wanted: DataFrame, first: bool) -> DataFrame:
        # Never a broadcast: a query goes to many shards, which the planner's estimate of a small file does not know.
        sent = wanted.mapInArrow(_asked(plan, width, first), packed).hint("merge")
        return trees.join(sent, ["cell", "part"]).select(
            "ids", "rows", "low", "high", "query_rows", "numbers", "vectors", "floors").mapInArrow(
            _found(k, width), "row long, query_id long, vec_id long, score long")

    near = settle(searched(asked.withColumn("floor", F.lit(int(NOTHING)).cast("long")), True), "near")
    kth = near.groupBy("row").agg(F.when(F.count(F.lit(1)) == k, F.min("score")).alias("kth"))
    rest = searched(asked.join(kth, "row", "left").select("row", "id", "vector", F.coalesce("kth", F.lit(int(NOTHING))).alias("floor")), False)
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return near.union(rest).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
