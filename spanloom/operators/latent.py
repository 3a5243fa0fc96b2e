"""Maths of latent vectors: kernels, discrepancies, correlations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512


def _rows_of(batch: pa.RecordBatch, k: int) -> np.ndarray:
    column = batch.column(k)
    return np.array(column.flatten(), dtype=float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _blocks(rows: DataFrame, vector: str, name: str) -> DataFrame:
    """Vectors, BLOCK of one partition at a time, as one array of doubles and its number of vectors."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows_of(batch, 0)
            parts = [x[i : i + BLOCK] for i in range(0, len(x), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array([len(p) for p in parts], pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=[f"{name}_n", name])

    return rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")).mapInArrow(each, f"{name}_n int, {name} binary")


def mean_kernel(a: DataFrame, b: DataFrame, vector: str) -> DataFrame:
    """The mean of the kernel exp(-mean((x - y)^2) / d) over all pairs.

    The statistic is over all pairs, so work grows with their number; it is done block by
    block with matrix products, and only blocks are paired in Spark.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = 0.0, 0
        for batch in batches:
            for k, x, m, y in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                x, y = np.frombuffer(x).reshape(k, -1), np.frombuffer(y).reshape(m, -1)
                d = x.shape[1]
                apart = np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0)
                total += float(np.exp(-apart / d / d).sum())
                n += k * m
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([n], pa.int64())], names=["total", "n"])

    pairs = _blocks(a, vector, "x").crossJoin(_blocks(b, vector, "y"))
    return pairs.mapInArrow(each, "total double, n long").agg((F.sum("total") / F.sum("n")).alias("k"))


def mmd(a: DataFrame, b: DataFrame, vector: str) -> DataFrame:
    """Maximum mean discrepancy: mean k(a, a) + mean k(b, b) - 2 mean k(a, b)."""
    parts = mean_kernel(a, a, vector).withColumn("w", F.lit(1.0)).union(mean_kernel(b, b, vector).withColumn("w", F.lit(1.0))).union(mean_kernel(a, b, vector).withColumn("w", F.lit(-2.0)))
    return parts.agg(F.sum(F.col("k") * F.col("w")).alias("mmd"))


def cross_correlation(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """i, j, c: sum over pairs of left_i * right_j, over their number. Each task sums matrix products of its batches."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in batches:
            if len(batch.column(0)):
                got = _rows_of(batch, 0).T @ _rows_of(batch, 1)
                total, n = got if total is None else total + got, n + len(batch.column(0))
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(total.ravel()), pa.array(np.full(total.size, n))], names=["i", "j", "s", "n"])

    whole = pairs.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(F.col(left).cast("array<double>"), F.col(right).cast("array<double>"))
    return whole.mapInArrow(each, "i int, j int, s double, n long").groupBy("i", "j").agg((F.sum("s") / F.sum("n")).alias("c"))


def twin_loss(correlation: DataFrame, weight: float = 0.005) -> DataFrame:
    """Squared distance of the diagonal from 1, plus the weighted squares off it."""
    on = F.sum(F.when(F.col("i") == F.col("j"), (F.col("c") - 1) * (F.col("c") - 1)).otherwise(0.0))
    off = F.sum(F.when(F.col("i") != F.col("j"), F.col("c") * F.col("c")).otherwise(0.0))
    return correlation.agg(on.alias("diagonal"), off.alias("off_diagonal"), (on + weight * off).alias("loss"))


def batch_mmd(a: DataFrame, b: DataFrame, batch: str, vector: str) -> DataFrame:
    """batch, mmd: the exact discrepancy of the vectors of a and b within each batch, as a training step has it; batches that one side lacks are left out.

    A batch is of the size of a training batch: its vectors meet in one task.
    """
    kind = dict(a.dtypes)[batch]

    def each(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        if not (left.num_rows and right.num_rows):
            return pa.table({"batch": pa.array([], left.schema.field(0).type), "mmd": pa.array([], pa.float64())})
        x, y = (np.array(t.column(1).combine_chunks().flatten(), dtype=float).reshape(t.num_rows, -1) for t in (left, right))
        value = kernel_mean(x, x) + kernel_mean(y, y) - 2 * kernel_mean(x, y)
        return pa.table({"batch": pa.array([key[0].as_py()], left.schema.field(0).type), "mmd": [value]})

    side = lambda rows: rows.where(F.col(batch).isNotNull() & F.col(vector).isNotNull()).select(F.col(batch).alias("batch"), F.col(vector).cast("array<double>").alias("v")).groupBy("batch")
    return side(a).cogroup(side(b)).applyInArrow(each, f"batch {kind}, mmd double").withColumnRenamed("batch", batch)


def kernel_mean(x: np.ndarray, y: np.ndarray) -> float:
    """The mean of the kernel exp(-mean((x - y)^2) / d) over all pairs of rows."""
    d = x.shape[1]
    apart = np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * x @ y.T, 0)
    return float(np.exp(-apart / d / d).mean())


def frequencies(dims: int, count: int, seed: int) -> np.ndarray:
    """count random frequencies (dims by count) of the kernel, whose Fourier transform is a Gauss curve of variance 2 / d^2."""
    return np.random.default_rng(seed).normal(0.0, np.sqrt(2.0) / dims, (dims, count))


def _waves(rows: DataFrame, vector: str, side: int, count: int, seed: int) -> DataFrame:
    """For each task: the sums of the cosines and sines of its vectors at each frequency and of their lengths, their number, and that of components."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, w = np.zeros(2 * count + 1), 0, None
        for batch in batches:
            x = _rows_of(batch, 0)
            if len(x):
                w = frequencies(x.shape[1], count, seed) if w is None else w
                phase = x @ w
                total += np.concatenate([np.cos(phase).sum(axis=0), np.sin(phase).sum(axis=0), [np.sqrt((x * x).sum(axis=1)).sum()]])
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([side], pa.int32()), pa.array([n], pa.int64()), pa.array([len(w)], pa.int32()), pa.array([total.tolist()], pa.list_(pa.float64()))], names=["side", "n", "dims", "waves"])

    return rows.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>")).mapInArrow(each, "side int, n long, dims int, waves array<double>")


def mmd_by_waves(a: DataFrame, b: DataFrame, vector: str, count: int = 1024, seed: int = 0, doubt: float = 0.01) -> DataFrame:
    """mmd, bound: the discrepancy of two sets of vectors in one pass over each, and what it differs from mmd() by at most, but for a chance of doubt.

    The kernel is the mean of cos(w (x - y)) over random frequencies w, so the discrepancy is the
    mean over w of |mean e^(iwx) - mean e^(iwy)|^2; count frequencies stand for all. The bound is
    Bernstein's: it has the variance over the frequencies, and what a term can be, which is 4 or
    the square of w's length times both sides' mean lengths, if that is less. Lengths of w beyond
    what count draws have but for half the doubt count as drawn by then.
    """
    parts = _waves(a, vector, 0, count, seed).unionAll(_waves(b, vector, 1, count, seed))
    sums = parts.groupBy("side").agg(F.sum("n").alias("n"), F.max("dims").alias("dims"), vector_to_array(Summarizer.sum(array_to_vector("waves"))).alias("waves"))
    means = sums.select("side", "dims", F.transform("waves", lambda x: x / F.col("n")).alias("m"))
    of = lambda side: F.first(F.when(F.col("side") == side, F.col("m")), ignorenulls=True)
    one = means.agg(of(0).alias("x"), of(1).alias("y"), F.max("dims").alias("dims")).where("x is not null and y is not null")
    square = F.zip_with("x", "y", lambda p, q: (p - q) * (p - q))
    lengths = F.element_at("x", 2 * count + 1) + F.element_at("y", 2 * count + 1)
    tail = float(np.log(2 * count / doubt))
    longest = 2 / F.col("dims") / F.col("dims") * (F.col("dims") + 2 * F.sqrt(F.col("dims") * tail) + 2 * tail)
    terms = one.select(F.zip_with(F.slice(square, 1, count), F.slice(square, count + 1, count), lambda c, s: c + s).alias("t"), F.least(F.lit(4.0), longest * lengths * lengths).alias("most"))
    mean = F.aggregate("t", F.lit(0.0), lambda s, x: s + x) / count
    spread = F.aggregate("t", F.lit(0.0), lambda s, x: s + x * x) / count - F.col("mmd") * F.col("mmd")
    log = float(np.log(6 / doubt))
    bound = F.sqrt(2 * F.greatest(spread, F.lit(0.0)) * log / count) + 3 * F.col("most") * log / count + 2 * doubt / count
    return terms.withColumn("mmd", mean).select("mmd", bound.alias("bound"))


def acyclicity(weights, dims: int) -> float:
    """tr((I + W*W/d)^d) - d of a square matrix: 0 for a graph without cycles."""
    return float(_acyclicities(np.asarray(weights, dtype=float).reshape(1, dims, dims))[0])


def _acyclicities(w: np.ndarray) -> np.ndarray:
    dims = w.shape[-1]
    powers = np.linalg.matrix_power(np.eye(dims) + w * w / dims, dims)
    return np.trace(powers, axis1=1, axis2=2) - dims


def acyclicities(rows: DataFrame, weights: str, dims: int, name: str = "acyclicity") -> DataFrame:
    """rows with the acyclicity of each row's matrix (dims * dims weights, row by row); null where it is null or has another size. Matrix powers are taken a batch at a time."""

    def each(column: pa.Array) -> pa.Array:
        fits = np.array([x.is_valid and len(x) == dims * dims and x.values.null_count == 0 for x in column], dtype=bool)
        out = np.full(len(column), np.nan)
        if fits.any():
            out[fits] = _acyclicities(np.array(column.filter(pa.array(fits)).flatten(), dtype=float).reshape(-1, dims, dims))
        return pa.array(out, mask=~fits)

    return rows.withColumn(name, F.arrow_udf(each, "double")(F.col(weights).cast("array<double>")))


def _graph(r: np.random.Generator, nodes: int, mean_nodes: float, mean_edges: float, features: int, sigma: float) -> tuple[list[int], np.ndarray, np.ndarray]:
    drawn = lambda mean, most: int(np.clip(round(r.normal(mean, sigma)), 0, most))
    subset = np.sort(r.choice(nodes, drawn(mean_nodes, nodes), replace=False))
    n = len(subset)
    chosen = r.choice(n * n, drawn(mean_edges, n * n), replace=False) if n else np.zeros(0, int)
    edges = np.zeros((nodes, nodes))
    edges[subset[chosen // max(n, 1)], subset[chosen % max(n, 1)]] = 1.0
    labels = np.zeros((nodes, features))
    labels[subset] = r.random((n, features)) < 0.5
    return subset.tolist(), edges, labels


def sampled_graphs(rows: DataFrame, key: str, nodes: int, mean_nodes: float, mean_edges: float, features: int = 10, sigma: float = 0.0, seed: int = 0) -> DataFrame:
    """key, subset, edges (nodes * nodes) and labels (nodes * features) of a random directed graph for each row, the same for the same key and seed.

    As many nodes as a Gauss curve around mean_nodes gives, drawn without repetition; among
    them, loops included, as many edges as one around mean_edges gives; labels of the chosen
    nodes are 0 or 1 alike, those of the others 0.
    """
    kind = dict(rows.dtypes)[key]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_graph(np.random.default_rng([seed, h & 0xFFFFFFFF, h >> 32 & 0xFFFFFFFF]), nodes, mean_nodes, mean_edges, features, sigma) for h in batch.column(1).to_pylist()]
            columns = zip(*[(s, e.ravel().tolist(), v.ravel().tolist()) for s, e, v in made], strict=True) if made else [[], [], []]
            kinds = (pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)]], names=[key, "subset", "edges", "labels"])

    return rows.select(key, F.xxhash64(key).alias("_seed")).mapInArrow(each, f"{key} {kind}, subset array<int>, edges array<double>, labels array<double>")
