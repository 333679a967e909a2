"""Whitening of embeddings by principal components.

Entries become integers, so that every mean, deviation and the total variance are exact. The
distinct vectors are centred, and Spark MLlib's ``RowMatrix.computeSVD`` sums their Gramian over the
executors and decomposes it; singular values are rescaled by the number of vectors. The total
variance comes from exact sums of squared deviations, not from the singular values.
"""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, named_apart, small_batches, table

#: What an entry is multiplied by before it is cut to an integer, and the components that are kept.
SCALE, COMPONENTS = 256, 4
#: Components whose singular value is a smaller share of the largest are zero, as a Gramian in doubles can't tell them from rounding.
LEAST = 1e-6
#: Dimensions at most: the Gramian, which the driver decomposes, has their square (128 MB). More are refused.
MOST_DIMENSIONS = 4096
#: Rows of an Arrow batch.
ROWS = 4096

_WIDE = pa.decimal128(38, 0)


def finite(vector: Column) -> Column:
    """Whether a vector is there, has entries, and each is a finite number."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))


def integers(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sum of (n*x - sum)^2 over the dimensions of each row, exactly."""
    largest = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
    if largest * largest * len(sums) < 1 << 63:
        away = n * x - np.array(sums, np.int64)
        return pa.array((away * away).sum(axis=1)).cast(_WIDE)
    away = n * x.astype(object) - np.array(sums, object)
    return pa.array([Decimal(int(v)) for v in (away * away).sum(axis=1)], _WIDE)


class Whitening:
    """Means and components of a list of distinct vectors; ``apply`` projects any vectors on them."""

    def __init__(self, fit: DataFrame, dimensions: int, components: int = COMPONENTS):
        """``fit`` has the distinct integer vectors, column ``x``, all of ``dimensions`` entries; it is read four times."""
        self.dimensions, self.n = dimensions, fit.count()
        found = fit.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("total")).collect()
        self.sums = [r["total"] for r in sorted(found)]
        self.means = np.array([float(Fraction(s, self.n)) for s in self.sums])
        centred = F.zip_with("x", F.array(*map(F.lit, self.means.tolist())), lambda v, m: v - m)
        rows = MLUtils.convertVectorColumnsFromML(fit.select(array_to_vector(centred).alias("x")), "x")
        # all singular values are asked for, as then the Gramian is decomposed wholly, to double precision
        svd = RowMatrix(rows, self.n, dimensions).computeSVD(dimensions, computeU=False, rCond=LEAST)
        values, vectors = svd.s.toArray(), svd.V.toArray()
        kept = int(min(components, (values > 0).sum()))
        vectors = vectors[:, :kept]
        turn = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(kept)])
        self.vectors = vectors * np.where(turn == 0, 1.0, turn)
        self.variances = values[:kept] ** 2 / self.n
        self._check(fit)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.means) @ self.vectors) / np.sqrt(self.variances)

    def _check(self, fit: DataFrame) -> None:
        """The total variance, from exact deviations, and the whitened covariance, from its sums over the fit list."""
        small_batches(fit.sparkSession, ROWS)
        kept, dimensions, n, sums, whitened = len(self.variances), self.dimensions, self.n, self.sums, self.whitened

        def run(batches):
            first, second, total = np.zeros(kept), np.zeros((kept, kept)), 0
            for batch in batches:
                x = _matrix(batch.column(0), dimensions)
                w = whitened(x)
                first, second = first + w.sum(axis=0), second + w.T @ w
                total += sum(int(v) for v in deviations(x, n, sums).to_pylist())
            cells = pa.array(np.r_[first, second.ravel()])
            # the exact total goes in two parts, as one of 38 digits could overflow when partitions are added
            yield pa.RecordBatch.from_arrays([pa.array([*range(len(cells)), -1, -2]), pa.array([*cells.to_pylist(), 0.0, 0.0]), pa.array([0] * len(cells) + [total >> 60, total & (1 << 60) - 1]).cast(_WIDE)], ["k", "v", "whole"])

        parts = fit.mapInArrow(run, "k long, v double, whole decimal(38,0)").groupBy("k").agg(F.sum("v").alias("v"), F.sum("whole").alias("whole")).collect()
        held = {r["k"]: r for r in parts}
        total = (int(held[-1]["whole"]) << 60) + int(held[-2]["whole"])
        self.total_variance = float(Fraction(total, n**3))
        first = np.array([held[k]["v"] for k in range(kept)]) / n
        second = np.array([held[kept + k]["v"] for k in range(kept * kept)]).reshape(kept, kept) / n
        self.identity_error = float(np.abs(second - np.outer(first, first) - np.eye(kept)).max(initial=0.0))

    def apply(self, rows: DataFrame, keep: tuple[str, ...], x: str) -> DataFrame:
        """A row for each row and component: the columns ``keep``, component, n, deviation, whitened, explained, identity_error."""
        small_batches(rows.sparkSession, ROWS)
        rows = rows.select(*keep, x)
        kept, dimensions, n, sums, whitened = len(self.variances), self.dimensions, self.n, self.sums, self.whitened
        explained, error = self.variances / self.total_variance if kept else self.variances, self.identity_error
        types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
        names = [*keep, "component", "n", "deviation", "whitened", "explained", "identity_error"]

        def run(batches):
            for batch in batches:
                m = _matrix(batch.column(len(keep)), dimensions)
                size = len(m)
                again = pa.array(np.repeat(np.arange(size), kept))
                columns = [batch.column(k).take(again) for k in range(len(keep))]
                columns += [pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), size)), pa.array(np.full(size * kept, n, np.int64)), deviations(m, n, sums).take(again)]
                columns += [pa.array(whitened(m).ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(size * kept, error))]
                yield pa.RecordBatch.from_arrays(columns, names)

        return rows.mapInArrow(run, f"{types}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, column: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """Each vector's places on the first ``components`` whitened principal components, a row a component.

    Vectors that are null, empty, or hold null or non-finite entries take no part, nor do those of
    another length than most have (the longest of equally frequent ones). Equal vectors count once in means and components,
    and each of them gets its rows; null and repeated ids are kept; other columns are left out. There are
    fewer components where vectors differ in fewer directions, and no rows for one vector, equal
    vectors, or an empty table. ``deviation`` is exact, a decimal of 38 digits. A component's sign is
    that which makes its largest entry positive.
    """
    x = named_apart("x", vectors.select(*keep))
    rows = vectors.where(finite(F.col(column))).select(*keep, integers(F.col(column)).alias(x))
    sizes = rows.groupBy(F.size(x).alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    none = rows.limit(0).select(*keep, *[F.lit(None).cast(t).alias(c) for c, t in (("component", "int"), ("n", "long"), ("deviation", "decimal(38,0)"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double"))])
    if sizes is None:
        return none
    if sizes["size"] > MOST_DIMENSIONS:
        raise ValueError(f"{sizes['size']} dimensions; at most {MOST_DIMENSIONS} can be decomposed")
    rows = rows.where(F.size(x) == sizes["size"])
    fit = cut(rows.select(F.col(x).alias("x")).distinct())
    if fit.limit(2).count() < 2:
        return none
    return Whitening(fit, sizes["size"], components).apply(rows, keep, x)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is long here, which holds up to some millions of different vectors; a larger one raises an error."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES = {"op12_whitening": query}
ORACLE_SQL: dict[str, str] = {}
