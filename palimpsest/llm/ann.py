"""Approximate nearest neighbours by an inverted multi-index.

Each half of the vectors is quantised by its own centroids, learned from a bounded sample; the
pair of centroids is a row's cell. A query visits cells in the multi-sequence order, by falling sum of
its halves' inner products with the centroids, until the cells visited hold enough vectors; only rows
of these cells count: they are scored in single precision, and those that can be among the first by
the exact measure. As a share of all cells is visited, their sums are sorted at once; a heap would
take a step of Python for each cell.

Cells lie in blocks of bounded size: small ones share a block, and a hot one is dealt over many.
A query travels to the blocks of its cells with the sum at which it stopped, from which a block
tells its cells. Rows travel to their block once; nothing but centroids and the counts of cells
(CENTROIDS squared, at most) is known to the driver or to all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import mix, table

#: Rows from which centroids are learned, centroids of each half, rounds, and their seed.
LEARN_ROWS, CENTROIDS, ROUNDS, SEED = 16_384, 256, 12, 99
#: A query visits cells until they hold this share of all distinct vectors, and this many, at least.
SHARE, VISITED = 0.3, 4_000
#: Rows of a block, at most and at least (fewer give small tables more tasks), and queries answered together.
BLOCK_ROWS, LEAST_ROWS, TOGETHER = 65_536, 1_024, 256
#: A query that visits this share of the rows of a run (a block's cells of one first centroid), or more, meets the run in one product with others (what it doesn't visit there is left out).
DENSE = 0.5
#: Sums with centroids may differ by less than this between tasks, relative to the largest; the rounding of single precision.
SLACK, EPSILON = 1e-9, 2.0**-24
#: Bins of sums, of which only those that are visited are sorted, and numbers of vectors whose exact scores are added together.
BINS, NUMBERS = 1_024, 1 << 22


def matrix_of(column, width: int) -> np.ndarray:
    """An Arrow column of lists of ``width`` numbers, none of them null, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(len(column), width)


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id whose vector takes part: neither null nor zero, and with finite components only."""
    v = F.col("embedding")
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    own = v if kind in ("float", "double") else F.transform(v, lambda x: x.cast("double"))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), own.alias("embedding"))
    return kept.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(v, lambda x: x != 0))


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's rounds from k distinct rows."""
    x = np.unique(x, axis=0)
    centres = x[rng.permutation(len(x))[:k]]
    for _ in range(ROUNDS):
        near = np.argmax(x @ centres.T - (centres**2).sum(1) / 2, 1)
        held = np.bincount(near, minlength=len(centres))
        order = np.argsort(near, kind="stable")
        some = np.flatnonzero(held)
        sums = np.zeros_like(centres)
        sums[some] = np.add.reduceat(x[order], (np.cumsum(held) - held)[some], 0)
        centres = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centres)
    return centres


def _cell(x: np.ndarray, codebooks) -> np.ndarray:
    half = codebooks[0].shape[1]
    parts = [np.argmax(y @ c.T - (c**2).sum(1) / 2, 1) for y, c in zip((x[:, :half], x[:, half:]), codebooks)]
    return parts[0] * len(codebooks[1]) + parts[1]


def cells_by_sum(first: np.ndarray, second: np.ndarray, held: np.ndarray, enough: int) -> tuple[np.ndarray, float]:
    """Cells (i, j) that hold something by falling first[i] + second[j], until they hold ``enough``, and the last one's sum."""
    some = np.flatnonzero(held > 0)
    sums = np.add.outer(first, second).ravel().take(some)
    span = float(sums.max() - sums.min()) if len(sums) else 0.0
    if 0 < span < float("inf"):
        bins = ((sums - sums.min()) * (BINS / span)).astype(np.int64)
        past = np.cumsum(np.bincount(bins, held[some])[::-1])
        top = np.flatnonzero(bins >= len(past) - 1 - np.searchsorted(past, enough))
        some, sums = some[top], sums[top]
    order = np.argsort(-sums)
    order = order[: np.searchsorted(np.cumsum(held[some[order]]), enough) + 1]
    return some[order], float(sums[order[-1]]) if len(order) else float("inf")


def exact_scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added component by component from the first."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


def prints(x: np.ndarray) -> np.ndarray:
    """A hash of each vector, by which rows of one id and score are told apart."""
    total = np.zeros(len(x), np.uint64)
    for column in np.ascontiguousarray((x + 0.0).T).view(np.uint64):
        total = mix(total * np.uint64(0xC2B2AE3D27D4EB4F) + mix(column))
    return total.view(np.int64)


def _near(rough: np.ndarray, error: np.ndarray, top: int) -> np.ndarray:
    """Places that can be among the first ``top`` by exact score, which is within ``error`` of ``rough``."""
    if len(rough) <= top:
        return np.arange(len(rough))
    least = np.partition(rough - error, len(rough) - top)[len(rough) - top]
    return np.flatnonzero(rough + error >= least)


def _few_copies(ids: np.ndarray, x: np.ndarray, top: int) -> np.ndarray:
    """Rows that can be among the first ``top``: repeated ones once, and of equal vectors those of the smallest ids."""
    _, group = np.unique(x, axis=0, return_inverse=True)
    order = np.lexsort((ids, group.ravel()))
    g, i = group.ravel()[order], ids[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (i[1:] != i[:-1])]
    order, g = order[new], g[new]
    place = np.arange(len(g)) - np.searchsorted(g, g)
    return order[place <= top]


class _Layout:
    """Which blocks hold a cell's rows: cells come in order, and a block takes ``size`` rows or so."""

    def __init__(self, rows: np.ndarray, size: int):
        past = np.cumsum(rows)
        self.first = (past - rows) // size
        self.count = np.maximum(past - 1, past - rows) // size - self.first + 1

    def of_rows(self, cells: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """The rows of one cell are dealt over its blocks by a hash of id and vector."""
        return self.first[cells] + (marks.astype(np.uint64) % self.count[cells].astype(np.uint64)).astype(np.int64)

    def of_cells(self, cells: np.ndarray) -> np.ndarray:
        begin, n = self.first[cells], self.count[cells]
        return np.unique(np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum())))


class _Block:
    """Rows of some cells, sorted by cell, repeated ones once."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, codebooks, top: int):
        few = _few_copies(ids, x, top)
        ids, x = ids[few], x[few]
        cells = _cell(x, codebooks)
        order = np.argsort(cells, kind="stable")
        self.ids, self.x, self.codebooks, self.top = ids[order], x[order], codebooks, top
        self.marks = prints(self.x)
        # In single precision for the rough scores; scaled, so that nothing overflows.
        self.rough = (self.x / np.abs(self.x).max()).astype(np.float32)
        self.error = (2 * (x.shape[1] + 4) * EPSILON * (np.linalg.norm(self.rough, axis=1) + 1e-30)).astype(np.float32)
        self.cells, self.starts = np.unique(cells[order], return_index=True)
        self.held = np.diff(np.r_[self.starts, len(ids)])
        _, self.runs = np.unique(self.cells // len(codebooks[1]), return_index=True)
        self.run_starts = self.starts[self.runs]
        self.run_rows = np.diff(np.r_[self.run_starts, len(ids)])

    def answer(self, query_ids: np.ndarray, q: np.ndarray, least: np.ndarray):
        """Queries, ids, scores and prints of each query's best rows in the cells whose sum is ``least`` or more, some queries at a time."""
        half, other = self.codebooks[0].shape[1], len(self.codebooks[1])
        first, second = q[:, :half] @ self.codebooks[0].T, q[:, half:] @ self.codebooks[1].T
        visit = first.take(self.cells // other, 1) + second.take(self.cells % other, 1) >= least[:, None] - SLACK * np.maximum(1.0, np.abs(least[:, None]))
        dense = np.add.reduceat(visit * self.held, self.runs, axis=1) >= DENSE * self.run_rows
        visited = np.repeat(visit, self.held, axis=1)
        single = visited & ~np.repeat(dense, self.run_rows, axis=1)
        visited &= query_ids[:, None] != self.ids
        y = (q / np.abs(q).max(1, keepdims=True)).astype(np.float32)
        rough = np.empty(visited.shape, np.float32)
        for k, (lo, n) in enumerate(zip(self.run_starts.tolist(), self.run_rows.tolist())):
            asking = np.flatnonzero(dense[:, k])
            rough[asking, lo : lo + n] = y[asking] @ self.rough[lo : lo + n].T
        length, near, waiting = np.linalg.norm(y, axis=1), [], 0
        for k in range(len(q)):
            rows = np.flatnonzero(single[k])
            rough[k, rows] = self.rough.take(rows, 0) @ y[k]
            seen = np.flatnonzero(visited[k])
            near.append(seen[_near(rough[k, seen], self.error[seen] * length[k], self.top)])
            waiting += len(near[-1])
            if waiting >= NUMBERS // q.shape[1] or k + 1 == len(q):
                asked, rows = np.repeat(np.arange(k + 1 - len(near), k + 1), [len(n) for n in near]), np.concatenate(near)
                yield self._best(query_ids, q, asked, rows)
                near, waiting = [], 0

    def _best(self, query_ids: np.ndarray, q: np.ndarray, asked: np.ndarray, rows: np.ndarray):
        """The first ``top`` of each query's rows by exact score, ties by id; no row is repeated."""
        step = max(1, NUMBERS // q.shape[1])
        scores = np.concatenate([exact_scores(q[asked[lo : lo + step]], self.x[rows[lo : lo + step]]) for lo in range(0, len(rows) or 1, step)])
        order = np.lexsort((self.marks[rows], self.ids[rows], -scores, asked))
        asked = asked[order]
        first = np.arange(len(asked)) - np.searchsorted(asked, asked) < self.top
        order, asked = order[first], asked[first]
        return query_ids[asked], self.ids[rows[order]], scores[order], self.marks[rows[order]]


def _index(rows: DataFrame, width: int, learn: int):
    """Centroids of both halves, and each cell's distinct vectors and rows."""
    spark = rows.sparkSession
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(learn).select("embedding").toArrow()
    x, rng, half = matrix_of(sample.column(0).combine_chunks(), width), np.random.default_rng(SEED), width // 2
    codebooks = _centroids(x[:, :half], CENTROIDS, rng), _centroids(x[:, half:], CENTROIDS, rng)
    shared = spark.sparkContext.broadcast(codebooks)

    def count(batches):
        for batch in batches:
            x = matrix_of(batch.column(0), width)
            yield pa.RecordBatch.from_arrays([pa.array(_cell(x, shared.value), pa.int64()), pa.array(prints(x))], ["cell", "print"])

    marks = rows.select("embedding").mapInArrow(count, "cell long, print long").groupBy("cell", "print").agg(F.count(F.lit(1)).alias("n"))
    cells = marks.groupBy("cell").agg(F.count(F.lit(1)).alias("distinct"), F.sum("n").alias("rows")).toPandas()
    distinct, held = np.zeros((2, len(codebooks[0]) * len(codebooks[1])), np.int64)
    distinct[cells["cell"]], held[cells["cell"]] = cells["distinct"], cells["rows"]
    return codebooks, distinct, held


def nearest(vectors: DataFrame, is_query, top: int = 20, share: float = SHARE, visited: int = VISITED) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's nearest rows by inner product.

    A query never finds rows of its own id; ties go to the smaller vec_id; fewer rows than ``top``
    are all returned. Null, zero or not finite vectors, and rows without id, take no part; of
    vectors of several lengths, those of the most common length do. Of repeated rows of one
    id and vector one counts. A query id of several vectors is asked by each, and a row counts by its
    best score. Other columns are ignored; no queries or an empty table give no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    widths = rows.groupBy(F.size("embedding").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total = widths[0]
    rows = rows.where(F.size("embedding") == width)
    codebooks, distinct, held = _index(rows, width, LEARN_ROWS)
    size = min(BLOCK_ROWS, max(LEAST_ROWS, total // (4 * spark.sparkContext.defaultParallelism)))
    enough = max(visited, int(np.ceil(share * distinct.sum())))
    shared = spark.sparkContext.broadcast((codebooks, distinct, _Layout(held, size), enough))
    kind = rows.schema["embedding"].dataType.simpleString()
    number = pa.float32() if "float" in kind else pa.float64()
    names = ["block", "asked", "vec_id", "least", "embedding"]
    sent = f"block long, asked int, vec_id long, least double, embedding {kind}"

    def batch_of(blocks, asked, ids, least, column):
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(np.full(n, asked, np.int32)), pa.array(ids, pa.int64()), pa.array(least, pa.float64()), column.cast(pa.list_(number))], names)

    def place(batches):
        codebooks, _, layout, _ = shared.value
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix_of(batch.column(1), width)
            blocks = layout.of_rows(_cell(x, codebooks), prints(np.c_[x, ids]))
            yield batch_of(blocks, 0, ids, np.zeros(len(ids)), batch.column(1))

    def ask(batches):
        codebooks, distinct, layout, enough = shared.value
        half = codebooks[0].shape[1]
        for batch in batches:
            ids, x = batch.column(0).to_numpy(), matrix_of(batch.column(1), width)
            for lo in range(0, len(ids), TOGETHER):
                q = x[lo : lo + TOGETHER]
                first, second = q[:, :half] @ codebooks[0].T, q[:, half:] @ codebooks[1].T
                found = [cells_by_sum(f, s, distinct, enough) for f, s in zip(first, second)]
                blocks = [layout.of_cells(c) for c, _ in found]
                at = np.repeat(np.arange(len(q)), [len(b) for b in blocks])
                least = np.array([s for _, s in found])
                yield batch_of(np.concatenate(blocks), 1, ids[lo + at], least[at], batch.column(1).take(pa.array(lo + at)))

    def answer(batches):
        def answered(block, ids, q, least):
            for lo in range(0, len(ids), TOGETHER):
                some = slice(lo, lo + TOGETHER)
                for best in block.answer(ids[some], q[some], least[some]):
                    yield pa.RecordBatch.from_arrays([pa.array(column) for column in best], ["query_id", "vec_id", "score", "print"])

        codebooks = shared.value[0]
        key, held, block = None, [], None
        for batch in batches:
            keys, asked, ids, least = (batch.column(k).to_numpy() for k in range(4))
            x = matrix_of(batch.column(4), width)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (asked[1:] != asked[:-1])) + 1
            for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(keys)]):
                if hi == lo:
                    continue
                if keys[lo] != key:
                    key, held, block = keys[lo], [], None
                if not asked[lo]:
                    held.append((ids[lo:hi], x[lo:hi]))
                elif held or block:
                    if block is None:
                        block, held = _Block(*(np.concatenate(p) for p in zip(*held)), codebooks, top), []
                    yield from answered(block, ids[lo:hi], x[lo:hi], least[lo:hi])

    # A stated number of parts, which isn't reduced for the queries' few bytes: the ordering of cells is theirs.
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    queries = rows.where(is_query).select("vec_id", "embedding").distinct().repartition(parts, "vec_id")
    both = rows.select("vec_id", "embedding").mapInArrow(place, sent).union(queries.mapInArrow(ask, sent))
    meet = both.repartition("block").sortWithinPartitions("block", "asked").select(*names)
    found = meet.mapInArrow(answer, "query_id long, vec_id long, score double, print long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = found.groupBy("query_id", "vec_id", "print").agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {"op6_nearest": query}
ORACLE_SQL: dict[str, str] = {}
