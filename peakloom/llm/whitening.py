"""Embedding whitening by distributed block matrices.

Vectors become whole numbers; each different vector is one row of the fit matrix. Its centred rows are
an MLlib ``IndexedRowMatrix`` cut into blocks; transpose times matrix gives the scatter, which is only
dimension x dimension and is decomposed on the driver. A second block multiplication by the whitening
matrix projects every different vector once, and rows find their projection by a 128-bit hash of their
vector. Hot vectors (at most ``1 / HEAVY_SHARE``) are joined by broadcast, so a vector that a third of
all rows hold does not go to one task. All of it runs in the JVM but the sums of columns (numpy in tasks).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from peakloom.llm.common import stored

SCALE, COMPONENTS = 256, 4
#: Bytes of one block, and pairs of blocks that one task multiplies.
BLOCK_BYTES, BLOCKS_PER_TASK, BLOCK_COLUMNS = 1 << 20, 8, 1024
#: A vector is hot when more than this share of the rows holds it.
HEAVY_SHARE = 0.001
#: A component with a smaller share of the trace has no direction of its own in double precision.
LEAST_SHARE = 1e-13


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, x): floor(scale * c) of every entry; rows whose vector is null or holds null, NaN or infinite entries go."""
    c = F.col(vector_col).cast("array<double>")
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf))
    good = df.filter(F.col(vector_col).isNotNull() & ~F.coalesce(F.exists(c, bad), F.lit(False)))
    return good.select(F.col(id_col).alias("id"), F.transform(c, lambda v: F.floor(v * scale)).alias("x"))


def _same_length(rows: DataFrame) -> tuple[DataFrame, int]:
    """Shorter vectors are filled up with zeros."""
    d = rows.agg(F.coalesce(F.max(F.size("x")), F.lit(0))).first()[0]
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("bigint"), F.lit(d) - F.size("x")))
    return rows.withColumn("x", F.when(F.size("x") < d, filled).otherwise(F.col("x"))), d


def _column_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Row count and exact sum of each column: one row of partial sums per task, then a small aggregate."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "high": pa.array([high.tolist()], pa.list_(pa.int64())), "low": pa.array([low.tolist()], pa.list_(pa.int64()))})

    parts = fit.select("x").mapInArrow(partial, "n long, high array<long>, low array<long>")
    each = parts.select("n", F.posexplode(F.arrays_zip("high", "low")).alias("pos", "s"))
    rows = each.groupBy("pos").agg(F.sum("n"), F.sum(F.col("s.high").cast("decimal(38,0)")), F.sum(F.col("s.low").cast("decimal(38,0)"))).collect()
    sums = {r[0]: (int(r[2]) << 32) + int(r[3]) for r in rows}
    return (rows[0][1] if rows else 0), [sums[i] for i in range(len(sums))]


def _indexed(fit: DataFrame) -> DataFrame:
    """Add a gapless ``index`` to stored rows that carry ``place``, their partition and position when written."""
    part = F.shiftright("place", 33)
    sizes = fit.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    # one row per partition
    offsets = F.broadcast(sizes.select("part", F.coalesce(before, F.lit(0)).alias("offset")))
    at = F.col("place").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("offset")
    return fit.join(offsets, part == F.col("part")).withColumn("index", at).drop("part", "offset")


def _blocks(rows: DataFrame, n: int, d: int, block_rows: int, block_columns: int) -> BlockMatrix:
    """Blocks of (index, values array<double>)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("values").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, d).toBlockMatrix(block_rows, block_columns)


def _scatter(blocks: BlockMatrix, block_rows: int) -> np.ndarray:
    """Transpose times matrix, its middle split so that a task multiplies ``BLOCKS_PER_TASK`` pairs of blocks."""
    splits = max(1, -(-blocks.numRows() // (block_rows * BLOCKS_PER_TASK)))
    product = blocks.transpose()._java_matrix_wrapper.call("multiply", blocks._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, blocks.colsPerBlock, blocks.colsPerBlock).toLocalMatrix().toArray()


def principal_components(scatter: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions as columns, their variances, shares of the trace), by falling variance; sign fixed by the largest entry."""
    v = scatter / n
    e, u = np.linalg.eigh((v + v.T) / 2)
    trace = float(np.trace(v))
    order = [i for i in np.argsort(-e, kind="stable")[:k] if trace > 0 and e[i] > LEAST_SHARE * trace]
    u = u[:, order]
    signs = np.sign(u[np.abs(u).argmax(axis=0), range(len(order))]) if order else np.ones(0)
    return u * signs, e[order], e[order] / trace if trace else e[order]


def _projected(blocks: BlockMatrix, matrix: np.ndarray, spark) -> DataFrame:
    """(index, p array<double>): block matrix times a small matrix with one row per dimension."""
    k = matrix.shape[1]
    small = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(matrix)], "index long, values array<double>")
    product = blocks.multiply(_blocks(small, len(matrix), k, blocks.colsPerBlock, k))
    rows = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").cast("bigint").alias("index"), vector_to_array("vector").alias("p"))


def _identity_error(projected: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of the projections minus the identity."""
    p = [F.element_at("p", i + 1) for i in range(k)]
    mean = projected.agg(*[F.sum(c) / n for c in p]).first()
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    cov = projected.agg(*[F.sum((p[i] - mean[i]) * (p[j] - mean[j])) / n for i, j in pairs]).first()
    return max(abs(c - (i == j)) for c, (i, j) in zip(cov, pairs))


def _hashes() -> list[Column]:
    return [F.xxhash64("x").alias("h1"), F.xxhash64(F.lit(1), F.col("x")).alias("h2")]


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, dict]:
    """Whitened coordinates of every row, and the model.

    The frame has (id, x, n, deviation decimal(38,0), whitened array<double>); the model has n, sums,
    directions, variances, explained, identity_error. Rows whose vector is null or has null or non-finite
    entries are dropped, null and repeated ids stay, vectors shorter than the longest are filled up with
    zeros. Directions without variance are left out, so ``whitened`` may be shorter than ``components``,
    and empty when all vectors are equal. An empty table gives no rows. Other columns are not read.
    ``deviation`` is exact up to 38 digits and null beyond them; entries beyond a long take its bounds.
    """
    spark = df.sparkSession
    rows, d = _same_length(stored(whole_vectors(df, id_col, vector_col, scale), "whiten-rows"))
    rows = rows.select("id", "x", *_hashes())
    different = rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies")).select("x", "copies", F.monotonically_increasing_id().alias("place"))
    fit = stored(different, "whiten-fit")
    n, sums = _column_sums(fit, d) if d else (0, [])
    mean = F.array(*[F.lit(s / n) for s in sums]) if n else F.array().cast("array<double>")
    exact = F.array(*[F.lit(str(s)).cast("decimal(38,0)") for s in sums]) if n else F.array().cast("array<decimal(38,0)>")
    indexed = _indexed(fit)
    centred = indexed.select("index", F.zip_with("x", mean, lambda a, m: a - m).alias("values"))
    columns = min(d, BLOCK_COLUMNS)
    block_rows = max(16, BLOCK_BYTES // (8 * max(columns, 1)))
    model = {"n": n, "sums": sums, "directions": np.zeros((d, 0)), "variances": np.zeros(0), "explained": np.zeros(0), "identity_error": 0.0}
    if n:
        blocks = _blocks(centred, n, d, block_rows, columns)
        u, e, share = principal_components(_scatter(blocks, block_rows), n, components)
        model |= {"directions": u, "variances": e, "explained": share}
    if len(model["variances"]):
        projected = stored(_projected(blocks, u / np.sqrt(e), spark), "whiten-projected")
        model["identity_error"] = _identity_error(projected, n, len(e))
    else:
        projected = indexed.select("index", F.array().cast("array<double>").alias("p"))
    times = F.lit(str(n)).cast("decimal(38,0)")
    wide = F.zip_with("x", exact, lambda a, s: F.try_subtract(F.try_multiply(a.cast("decimal(38,0)"), times).cast("decimal(38,0)"), s))
    squares = F.aggregate(wide, F.lit(0).cast("decimal(38,0)"), lambda t, v: F.try_add(t, F.try_multiply(v, v)).cast("decimal(38,0)"))
    known = indexed.select("index", "copies", *_hashes(), squares.alias("deviation")).join(projected.withColumnRenamed("p", "whitened"), "index").drop("index")
    known = stored(known, "whiten-known")
    least = max(1000, int(rows.count() * HEAVY_SHARE))
    heavy = F.broadcast(known.filter(F.col("copies") > least).drop("copies"))  # at most 1 / HEAVY_SHARE rows
    light = known.filter(F.col("copies") <= least).drop("copies")
    hot = heavy.select("h1", "h2")
    out = rows.join(heavy, ["h1", "h2"]).unionByName(rows.join(F.broadcast(hot), ["h1", "h2"], "left_anti").join(light, ["h1", "h2"]))
    return out.select("id", "x", F.lit(n).cast("bigint").alias("n"), "deviation", "whitened"), model
