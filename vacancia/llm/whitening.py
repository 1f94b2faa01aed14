"""Whitening of embeddings whose covariance is taken once per distinct vector, weighted by its copies."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vacancia.llm.common import stored

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 32
SPLITS = 1000  # a vector of more than 1/SPLITS of all rows is joined back by broadcast; there are fewer than SPLITS
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)
_LIMIT = 2.0**53  # entries whose scaled value is not below this have no exact whole number


def packed(rows: DataFrame, vector: str) -> DataFrame:
    """The columns of `rows` but `vector`, `x` (whole numbers of the scaled entries in the least width that holds them) and `dim`.

    Rows whose vector is null, empty or has a null, non-finite or too large entry are left out.
    """
    kept = [c for c in rows.columns if c != vector]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column, good, found = batch.column("_vector"), [], []
            for i, entries in enumerate(column):
                if not entries.is_valid or not len(entries):
                    continue
                x = np.floor(SCALE * entries.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.all(np.abs(x) < _LIMIT):  # false for nan
                    least, most = x.min(), x.max()
                    width = next(w for w in _WIDTHS if np.iinfo(w).min <= least and most <= np.iinfo(w).max)
                    good.append(i)
                    found.append(bytes([np.dtype(width).itemsize]) + x.astype(width).tobytes())
            at = pa.array(good, pa.int64())
            dims = pa.array([(len(x) - 1) // x[0] for x in found], pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in kept], pa.array(found, pa.binary()), dims], [*kept, "x", "dim"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != vector)
    return rows.select(*kept, F.col(vector).cast("array<double>").alias("_vector")).mapInArrow(run, f"{kinds}x binary, dim int")


def unpacked(column: pa.Array) -> np.ndarray:
    """Whole numbers (without OFFSET) of packed vectors of one dimension, one per row."""
    return np.stack([np.frombuffer(x, f"<i{x[0]}", offset=1).astype(np.int64) for x in column.to_pylist()])


def totals(distinct: DataFrame) -> tuple[int, list[int]]:
    """Sum of the weights and exact weighted sum of each dimension (without OFFSET). The driver gets one row per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, 0
        for batch in batches:
            if batch.num_rows:
                w = batch.column("w").to_numpy()
                # Python's whole numbers where the sum could leave 64 bits
                x = unpacked(batch.column("x"))
                small = float(np.abs(x).max()) * float(w.sum()) < 2**62
                n += int(w.sum())
                sums = sums + (w @ x if small else w.astype(object) @ x.astype(object)).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(sums)), pa.int32()), pa.array([str(v) for v in [n, *sums]])], ["i", "v"])

    found = distinct.select("x", "w").mapInArrow(run, "i int, v string").groupBy("i").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    by_dim = {r["i"]: int(r["v"]) for r in found.collect()}
    return by_dim[-1], [by_dim[i] for i in range(len(by_dim) - 1)]


def gemm(rows: DataFrame, centred) -> np.ndarray:
    """Sum over all rows of w * z z' for z = `centred(batch)`, merged by rows of the matrix in a fixed order.

    A task adds up one matrix, then sends its rows; the driver gets the merged matrix, whose size is that of
    the dimension and not of the data.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                z = centred(batch)
                part = (z * batch.column("w").to_numpy()[:, None]).T @ z
                total = part if total is None else total + part
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([task] * len(total), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "task", "v"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column("i").to_pylist(), batch.column("v"), strict=True):
                sums[i] = sums.get(i, 0.0) + v.values.to_numpy()
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["i", "v"])

    parts = rows.mapInArrow(run, "i int, task int, v array<double>").repartition("i").sortWithinPartitions("i", "task")
    found = {r["i"]: r["v"] for r in parts.select("i", "v").mapInArrow(merge, "i int, v array<double>").collect()}
    return np.array([found[i] for i in sorted(found)])


def centre(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The whole number next to each mean and what is left of the mean, so that x - mean keeps every digit."""
    whole = [(2 * s + n) // (2 * n) for s in sums]
    return np.array(whole, np.int64), np.array([(s - n * c) / n for s, c in zip(sums, whole, strict=True)])


def principal(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues and unit eigenvectors (columns) by falling eigenvalue, and the trace; no eigenvalue is below zero."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return np.maximum(values[::-1][:components], 0.0), vectors[:, ::-1][:, :components], float(np.trace(covariance))


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sum over dimensions of (n x - S)^2 of each row; null where it leaves 64 bits."""
    most = max(float(n) * float(np.abs(x).max()), max(map(abs, sums)))
    if most < 2**62:
        d = n * x - np.array(sums, np.int64)
        if float(np.abs(d).max()) ** 2 * d.shape[1] < 2**62:
            return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, weighted: bool = True) -> DataFrame:
    """key, component, n, deviation, whitened, explained, identity_error: a row for each kept row and component.

    Entries c become whole numbers x = floor(64 c) + 1000000. Equal x-vectors are one row with the number of
    its copies as fit weight (one if not `weighted`). Sums are exact, the covariance is a weighted product of
    centred vectors, and each distinct vector is whitened once and joined back to its rows. OFFSET moves the
    mean alone, so it enters no other result.

    Left out are rows whose vector is null, empty, or has an entry that is null, not finite or 2**47 or more;
    vectors of another dimension than the most frequent one (the larger of equals) are left out as well. Null
    and repeated keys are rows like others. A component without variance (all vectors equal, or fewer
    vectors than dimensions) has null in `whitened` and does not enter identity_error; without any variance
    `explained` and identity_error are null. A deviation beyond 64 bits is null. Extra columns are not read;
    no rows give no rows.
    """
    vectors = packed(rows.select(F.col(key).cast("long").alias("_key"), F.col(vector).alias("_v")), "_v")
    counted = stored(vectors.groupBy("x", "dim").agg(F.count("*").alias("copies")), "whiten-distinct", "zstd")
    shape = "_key long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    top = counted.groupBy("dim").agg(F.sum("copies").alias("c")).orderBy(F.desc("c"), F.desc("dim")).first()
    if top is None:
        return rows.sparkSession.createDataFrame([], shape).withColumnRenamed("_key", key)
    distinct = counted.filter(F.col("dim") == top["dim"]).select("x", "copies", (F.col("copies") if weighted else F.lit(1).cast("long")).alias("w"))
    n, sums = totals(distinct)
    whole, left = centre(n, sums)
    values, basis, trace = principal(gemm(distinct.select("x", "w"), lambda batch: unpacked(batch.column("x")) - whole - left) / n, components)
    spread = values > max(trace, 0.0) * len(whole) * np.finfo(float).eps
    stretch = basis / np.sqrt(np.where(spread, values, np.inf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = unpacked(batch.column("x"))
                z = (x - whole - left) @ stretch
                white = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32()), pa.array(z.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("x", "copies", "w")], pa.array(deviations(x, n, sums), pa.int64()), white], ["x", "copies", "w", "deviation", "white"])

    done = stored(distinct.mapInArrow(run, "x binary, copies long, w long, deviation long, white array<double>"), "whitened", "zstd")
    again = gemm(done.select("white", "w"), lambda batch: batch.column("white").flatten().to_numpy().reshape(batch.num_rows, -1)) / n
    error = float(np.abs(again - np.eye(len(again)))[np.ix_(spread, spread)].max()) if spread.any() else None
    share = [float(v / trace) if trace > 0 else None for v in values]

    often = F.col("copies") * SPLITS > F.lit(top["c"])
    heavy, rest = done.filter(often).drop("copies", "w"), done.filter(~often).drop("copies", "w")
    ids = vectors.select("_key", "x")
    met = ids.join(F.broadcast(heavy), "x").unionByName(ids.join(F.broadcast(heavy.select("x")), "x", "left_anti").join(rest, "x"))
    each = met.select("_key", "deviation", F.posexplode("white").alias("_at", "_z"))
    at = lambda items: F.get(F.array(*[F.lit(v) for v in items]), F.col("_at"))
    return each.select(
        F.col("_key").alias(key),
        (F.col("_at") + 1).cast("int").alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.when(at([bool(s) for s in spread]), F.col("_z")).alias("whitened"),
        at(share).cast("double").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
