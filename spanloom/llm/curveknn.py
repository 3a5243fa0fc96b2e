"""Nearest neighbours by shifted space-filling curves.

Vectors are turned by the principal axes of a bounded sample (FIT_ROWS rows). Each of
CURVES Hilbert orders takes its own axes and its own shift; Spark range-sorts the rows
of each order, and a query is compared with the WINDOW rows before and after it in each.
The merged windows give the query a radius: the distance of its k-th nearest so far.
An exact check follows: the rows of the first order lie in blocks of BLOCK neighbours
with their bounding boxes, and a block is compared with just those queries whose radius
reaches into its box. So results are exact; what the curves decide is how few blocks are
read. On vectors without any structure (as far from one another as in random directions)
boxes exclude little, and the check reads most blocks for most queries.

Queries are broadcast in chunks of QUERY_CHUNK, one chunk at a time; other rows are never
sent to the driver beyond the sample. Blocks, windows and results are of bounded size for any group of equal vectors.

Defined results: vectors that are null, zero, or hold null or non-finite components take
no part, nor do those of another length than the most common; a row is never its own
neighbour, but an equal vector with another id is; rows with equal vec_id count as
one (equal vectors) and share rank order by distance, then vec_id; with fewer than k
candidates all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .hilbert import hilbert_key
from .workspace import Workspace

CURVES, DIMS, BITS = 3, 5, 10
WINDOW = 256
BLOCK = 512
QUERY_CHUNK = 4096
FIT_ROWS = 20_000
RESULT = "query_id long, rank int, vec_id long, score double"


class Axes:
    """Principal axes of a sample, and the scale of each curve's coordinates."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dims: int = DIMS, bits: int = BITS):
        width = sample.shape[1]
        self.mean = sample.mean(axis=0)
        spread = np.cov((sample - self.mean).T) if len(sample) > 1 else np.eye(width)
        _, vectors = np.linalg.eigh(np.atleast_2d(spread))
        self.turn = vectors[:, ::-1].copy()
        self.bits, self.dims, self.curves = bits, min(dims, width), curves
        turned = self.turned(sample)
        self.low, self.high = turned.min(axis=0), turned.max(axis=0)

    def turned(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.turn

    def keys(self, turned: np.ndarray, curve: int) -> np.ndarray:
        """Hilbert keys on one curve: the leading axes, with axes further on mixed in, shifted by a part of a cell."""
        axes = [(d + curve * (d % 2) * self.dims) % turned.shape[1] for d in range(self.dims)]
        span = np.maximum(self.high[axes] - self.low[axes], 1e-12)
        unit = (turned[:, axes] - self.low[axes]) / span
        unit = unit / 2 + curve / (2 * self.curves)  # the curve's shift; what lies beyond the sample is clipped
        return hilbert_key((np.clip(unit, 0, 1) * ((1 << self.bits) - 1)).astype(np.int64), self.bits)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, summed component by component."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += (x[:, d] - q[:, d]) ** 2
    return np.sqrt(total)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<f8").reshape(-1, width)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """vec_id and vector (as doubles) of the rows that take part, and the length of the vectors."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull()).where(fine)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    width = sizes[0]["n"] if sizes else 0
    return rows.where(F.size("v") == width), width


def nearest(vectors: DataFrame, is_query: str = "vec_id % 100 = 0", k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", window: int = WINDOW, fit_rows: int = FIT_ROWS, query_chunk: int = QUERY_CHUNK, check: bool = True) -> DataFrame:
    """The k nearest rows of each query (a SQL condition on vec_id), as in RESULT; without check, the nearest in the merged windows alone."""
    spark = vectors.sparkSession
    rows, width = usable(vectors, id_col, vec_col)
    if not width:
        return spark.createDataFrame([], RESULT)
    work = Workspace(spark)
    total = rows.count()
    share = min(1.0, fit_rows / total)
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit("sample")), F.lit(1 << 20)) < share * (1 << 20)).limit(2 * fit_rows)
    fitted = np.array([r[0] for r in sample.select("v").collect()], dtype=float).reshape(-1, width)
    axes = Axes(fitted if len(fitted) else np.array(rows.select("v").first()[0], dtype=float)[None, :])
    sent = spark.sparkContext.broadcast(axes)

    def place(batches):
        for batch in batches:
            x = np.array(batch.column(1).flatten()).reshape(-1, width)
            turned = sent.value.turned(x)
            raw = pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary())
            for c in range(sent.value.curves):
                yield pa.RecordBatch.from_arrays([pa.array([c] * len(x), pa.int32()), pa.array(sent.value.keys(turned, c)), batch.column(0), batch.column(2), raw], names=["curve", "key", "vec_id", "query", "raw"])

    placed = rows.withColumn("query", F.expr(is_query)).mapInArrow(place, "curve int, key long, vec_id long, query boolean, raw binary")
    order = ["curve", "key", "vec_id"]
    ordered = work.keep(placed.repartitionByRange(*order).sortWithinPartitions(*order))

    def around(batches):
        """Each query with the rows around it, in one task's part of an order."""
        held = None
        for batch in [*batches, None]:
            if batch is not None:
                own = (batch.column(0).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False), _matrix(batch.column(4), width))
                done = max(0, len(held[0]) - window) if held else 0
                if held:
                    own = tuple(np.concatenate((a, b)) for a, b in zip(held[:4], own, strict=True))
                upto = len(own[0]) - window
            elif held is None:
                return
            else:
                own, done, upto = held[:4], held[4], len(held[0])
            curve, ids, query, x = own
            out = [[], [], []]
            for i in np.flatnonzero(query):
                if done <= i < upto:
                    a, b = max(0, i - window), i + window + 1
                    near = np.arange(a, min(b, len(ids)))
                    near = near[(curve[near] == curve[i]) & (ids[near] != ids[i])]
                    d = distances(x[near], np.broadcast_to(x[i], (len(near), width)))
                    best = near[np.lexsort((ids[near], d))[: 4 * k]]
                    dist = dict(zip(near.tolist(), d.tolist(), strict=True))
                    seen: dict[int, float] = {}
                    for n in best.tolist():
                        seen.setdefault(int(ids[n]), dist[n])
                    for n, s in list(seen.items())[:k]:
                        out[0].append(int(ids[i]))
                        out[1].append(n)
                        out[2].append(s)
            keep = max(0, upto - window) if batch is not None else 0
            held = (*[a[keep:] for a in own], max(done, upto) - keep)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["query_id", "vec_id", "score"])
            if batch is None:
                return

    by_query = Window.partitionBy("query_id").orderBy("score", "vec_id")
    windows = ordered.mapInArrow(around, "query_id long, vec_id long, score double").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    ranked = windows.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
    found = work.keep(ranked)
    radius = found.where(F.col("rank") == k).select("query_id", F.col("score").alias("radius"))
    asked = ordered.where("curve = 0 and query").join(radius, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "raw", F.coalesce("radius", F.lit(float("inf"))).alias("radius"))
    asked = work.keep(asked.dropDuplicates(["vec_id", "raw"]).repartitionByRange("vec_id").withColumn("n", F.monotonically_increasing_id()))
    parts = [found.select("query_id", "vec_id", "score")]
    first = ordered.where("curve = 0").select("vec_id", "raw")
    count = asked.count()
    chunks = max(1, -(-count // query_chunk)) if check else 0
    for c in range(chunks):
        own = asked if chunks == 1 else asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(chunks)) == c)
        got = own.select("vec_id", "raw", "radius").collect()  # about query_chunk rows
        if got:
            q = spark.sparkContext.broadcast((np.array([r[0] for r in got]), np.frombuffer(b"".join(bytes(r[1]) for r in got), "<f8").reshape(-1, width), np.array([r[2] for r in got])))
            part = first.mapInArrow(_check(sent, q, width, k), "query_id long, vec_id long, score double")
            if chunks > 1:  # one chunk at a time is held, by the driver and by executors
                part = work.keep(part)
                q.destroy()
            parts.append(part)
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    whole = merged.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return whole.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _check(axes, queries, width: int, k: int):
    """Blocks of rows against the queries whose radius reaches into the block's box."""

    def each(batches):
        ids, q, radius = queries.value
        turned_q = axes.value.turned(q)
        best = [(np.full(k, np.inf), np.zeros(k, np.int64)) for _ in ids]
        reach = radius.copy()
        norm_q = (q * q).sum(axis=1)
        for batch in batches:
            all_x, all_ids = _matrix(batch.column(1), width), batch.column(0).to_numpy()
            for i in range(0, len(all_x), BLOCK):
                x, own = all_x[i : i + BLOCK], all_ids[i : i + BLOCK]
                turned = axes.value.turned(x)
                low, high = turned.min(axis=0), turned.max(axis=0)
                gap = np.maximum(0, np.maximum(low - turned_q, turned_q - high))
                near = np.flatnonzero(np.sqrt((gap * gap).sum(axis=1)) <= reach * (1 + 1e-9) + 1e-9)
                if not len(near):
                    continue
                rough = (x * x).sum(axis=1)[None, :] + norm_q[near][:, None] - 2 * q[near] @ x.T
                scale = norm_q[near] + (x * x).sum(axis=1).max()
                a, b = np.nonzero(rough <= (reach[near] ** 2 * (1 + 1e-9) + 1e-9 * scale)[:, None])
                other = ids[near[a]] != own[b]
                a, b = a[other], b[other]
                d = distances(x[b], q[near[a]])
                for n in np.unique(a):
                    mine = a == n
                    score, vec = np.concatenate((best[near[n]][0], d[mine])), np.concatenate((best[near[n]][1], own[b[mine]]))
                    rank = np.lexsort((vec, score))
                    again = (score[rank[1:]] == score[rank[:-1]]) & (vec[rank[1:]] == vec[rank[:-1]])
                    rank = rank[np.append(True, ~again)][:k]
                    pad = k - len(rank)
                    best[near[n]] = (np.append(score[rank], np.full(pad, np.inf)), np.append(vec[rank], np.zeros(pad, np.int64)))
                    reach[near[n]] = min(reach[near[n]], best[near[n]][0][-1])
        out = [(int(ids[n]), int(v), float(s)) for n, (score, vec) in enumerate(best) for s, v in zip(score, vec, strict=True) if np.isfinite(s)]
        columns = list(zip(*out, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return each
