"""Orders of correlated variables: a correlation matrix by blocks, and complete linkage of its rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Variables of one block of the matrix.
BLOCK = 128


def product_blocks(rows: DataFrame, vector: str, block: int = BLOCK) -> DataFrame:
    """bi, bj, values: blocks (bi <= bj, row by row) of the sum over all rows of x' times x, x being a vector with a 1 behind it.

    A task has one matrix of its own; blocks are added up in Spark. Null vectors, and those with
    a null component, are left out.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            n = batch.num_rows
            if n:
                x = np.concatenate([np.array(batch.column(0).flatten(), dtype=float).reshape(n, -1), np.ones((n, 1))], axis=1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            parts = -(-len(total) // block)
            where = [(i, j) for i in range(parts) for j in range(i, parts)]
            cut = [total[i * block : (i + 1) * block, j * block : (j + 1) * block].ravel().tolist() for i, j in where]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in where], pa.int32()), pa.array([j for _, j in where], pa.int32()), pa.array(cut, pa.list_(pa.float64()))], names=["bi", "bj", "values"])

    whole = rows.where(F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull())).select(F.col(vector).cast("array<double>"))
    parts = whole.mapInArrow(each, "bi int, bj int, values array<double>")
    return parts.groupBy("bi", "bj").agg(vector_to_array(Summarizer.sum(array_to_vector("values"))).alias("values"))


def _matrix(blocks: pd.DataFrame, block: int) -> np.ndarray:
    """The correlations (Pearson's; 0 with a constant) of the variables whose products blocks has."""
    parts = int(blocks["bj"].max()) + 1
    corner = len(blocks.loc[(blocks["bi"] == parts - 1) & (blocks["bj"] == parts - 1), "values"].iloc[0])
    n = (parts - 1) * block + int(round(corner**0.5))
    s = np.zeros((n, n))
    for i, j, values in blocks.itertuples(index=False):
        low, high = slice(i * block, min(n, (i + 1) * block)), slice(j * block, min(n, (j + 1) * block))
        s[low, high] = np.asarray(values).reshape(low.stop - low.start, -1)
        s[high, low] = s[low, high].T
    count, mean = s[-1, -1], s[-1, :-1] / s[-1, -1]
    cov = s[:-1, :-1] / count - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov), 0))
    flat = scale <= 1e-12 * np.maximum(1.0, np.abs(mean))
    scale[flat] = 1.0
    out = cov / scale[:, None] / scale[None, :]
    out[flat, :] = out[:, flat] = 0.0
    np.fill_diagonal(out, 1.0)
    return out


def _from_matrix(rows: DataFrame, vector: str, block: int, schema: str, make) -> DataFrame:
    """What make does with the whole matrix: a task's work, which grows with the variables and not with the rows."""

    def each(blocks: pd.DataFrame) -> pd.DataFrame:
        return make(_matrix(blocks, block))

    return product_blocks(rows, vector, block).withColumn("whole", F.lit(0)).groupBy("whole").applyInPandas(lambda b: each(b[["bi", "bj", "values"]]), schema)


def correlations(rows: DataFrame, vector: str, block: int = BLOCK) -> DataFrame:
    """i, j, c: the correlation of each two components of a vector column."""

    def cells(c: np.ndarray) -> pd.DataFrame:
        i, j = np.indices(c.shape)
        return pd.DataFrame({"i": i.ravel().astype(np.int32), "j": j.ravel().astype(np.int32), "c": c.ravel()})

    return _from_matrix(rows, vector, block, "i int, j int, c double", cells)


def linkage(points: np.ndarray) -> np.ndarray:
    """Complete linkage of the rows of a matrix by their Euclidean distances: left, right, distance of each merger, by rising distance.

    Clusters of one are numbered by their rows, merged ones after those in the order of the
    mergers; left is the smaller number. By chains of nearest neighbours: a chain grows to
    nearer and nearer clusters until two are each other's nearest and merge, so work grows
    with the square of the rows.
    """
    n = len(points)
    squares = (points * points).sum(axis=1)
    d = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * points @ points.T, 0))
    for i in range(n):  # differences of like rows are lost in the squares
        near = d[i] < 1e-3 * np.sqrt(squares[i] + 1e-300)
        d[i, near] = np.sqrt(((points[near] - points[i]) ** 2).sum(axis=1))
    d = np.maximum(d, d.T)
    np.fill_diagonal(d, np.inf)
    merged, chain, alive = [], [], np.ones(n, bool)
    while len(merged) < n - 1:
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            b = int(d[a].argmin())
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        a, b = chain.pop(), chain.pop()
        merged.append((float(d[a, b]), a, b))
        kept, gone = min(a, b), max(a, b)
        far = np.maximum(d[kept], d[gone])
        far[[kept, gone]] = np.inf
        d[kept], d[:, kept] = far, far
        d[gone], d[:, gone], alive[gone] = np.inf, np.inf, False
    top, out = list(range(n)), []
    number = list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for k, (far, a, b) in enumerate(sorted(merged, key=lambda m: m[0])):
        a, b = find(a), find(b)
        out.append((min(number[a], number[b]), max(number[a], number[b]), far))
        top[max(a, b)] = min(a, b)
        number[min(a, b)] = n + k
    return np.array(out).reshape(-1, 3)


def correlated_order(correlation) -> list[int]:
    """An order of variables with like ones side by side: complete linkage of the rows of their correlation matrix, cut at half the largest distance of two rows.

    Clusters are in the order of the tree, where a branch stands before a single variable, and
    the smaller number before the larger; variables of a cluster are in their own order.
    """
    c = np.asarray(correlation, dtype=float)
    n = len(c)
    if n < 2:
        return list(range(n))
    tree = linkage(c)
    limit, way, cluster = tree[-1, 2] / 2, {2 * n - 2: ""}, {}
    for k in range(n - 2, -1, -1):
        left, right, far = int(tree[k, 0]), int(tree[k, 1]), tree[k, 2]
        for child, digit in ((left, "02"[left < n]), (right, "13"[right < n])):
            way[child] = way[n + k] + digit
            if n + k in cluster:
                cluster[child] = cluster[n + k]
            elif far <= limit:
                cluster[child] = way[n + k]
    return sorted(range(n), key=lambda i: (cluster.get(i, way[i]), i))


def ordered_components(rows: DataFrame, vector: str, block: int = BLOCK) -> DataFrame:
    """place, component: the components of a vector column in the order of correlated_order()."""

    def places(c: np.ndarray) -> pd.DataFrame:
        order = correlated_order(c)
        return pd.DataFrame({"place": np.arange(len(order), dtype=np.int32), "component": np.array(order, dtype=np.int32)})

    return _from_matrix(rows, vector, block, "place int, component int", places)
