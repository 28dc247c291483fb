"""Operator 13: whitening of embeddings.

Every component ``c`` becomes the whole number ``floor(SCALE * c) + SHIFT``, so
counts, sums and squared deviations are exact.  The rows are centred exactly,
``(n*x - S) / n`` with a whole numerator, and go as vectors to MLlib's
``RowMatrix``; ``computeGramianMatrix`` adds them up in a tree of tasks and its
``d x d`` result, divided by ``n``, is the covariance.  ``eigh`` of that small
matrix is local; the whitening matrix is broadcast and applied in
``mapInPandas``.  The covariance of the whitened rows is measured on the rows
themselves, in another pass of small partial sums.

Defined results: rows with a null vector, or a null or non-finite component, are
dropped, and so are those whose vector is not of the most frequent length (of
equally frequent ones the greatest: one fit has one number of dimensions); a null id is kept as it is; repeated rows are
rows of their own; there are as many components as dimensions at most; a
component whose eigenvalue is zero (to rounding) has null ``whitened`` and takes
no part in ``identity_error``, which is null if there is none other; with no
variance at all ``explained`` is null; a squared deviation beyond 64 bits is null
in ``deviation`` and always whole in ``deviation_text``; no rows give no rows;
other columns are ignored.  Signs make the largest entry of a component
positive.  A component beyond 2**52 after scaling is refused with an error.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from episodeframe.llm.shared import bounded_batches

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: whole numbers that doubles hold
MOST = 1 << 52


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector) of rows without null or non-finite entries, as doubles."""
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    odd = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~odd)


def whole_numbers(values: np.ndarray, scale: int, shift: int) -> np.ndarray:
    out = np.floor(values * scale) + shift
    if out.size and np.abs(out).max() >= MOST:
        raise ArithmeticError("a component is too large to be a whole number that doubles hold")
    return out.astype(np.int64)


def _matrix(column: pa.ListArray) -> np.ndarray:
    """All vectors of a batch, which have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _sums(scale: int, shift: int):
    """One row a task: n and the sum of every dimension."""

    def run(batches):
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = whole_numbers(_matrix(batch.column("vector")), scale, shift)
                n, sums = n + len(x), x.sum(axis=0) + (0 if sums is None else sums)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["n", "sums"])

    return run


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n*x - S in whole numbers, the same over n as doubles)."""
    most = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * n + int(np.abs(sums).max(initial=0))
    exact = n * x.astype(object if most >= 1 << 62 else np.int64) - sums
    return exact, (exact / n).astype(np.float64)


def _rows(scale: int, shift: int, n: int, sums: np.ndarray):
    """Exactly centred rows as arrays of doubles."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows = centred(whole_numbers(_matrix(batch.column("vector")), scale, shift), n, sums)[1]
                offsets = np.arange(0, rows.size + 1, rows.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.ravel()))], names=["row"])

    return run


def gramian(rows: DataFrame, column: str, n: int, size: int) -> np.ndarray:
    """Sum of the outer products of an array column's ``n`` rows, by MLlib."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(column).alias("v")), "v")
    return RowMatrix(vectors, n, size).computeGramianMatrix().toArray()


class Whitening:
    """What one fit knows: n, sums, eigenvalues and the matrix that whitens centred rows."""

    def __init__(self, n: int, sums: np.ndarray, covariance: np.ndarray, components: int) -> None:
        values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
        values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
        largest = np.abs(vectors).argmax(axis=0)
        vectors = vectors * np.where(vectors[largest, np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
        self.n, self.sums, self.trace = n, sums, float(np.trace(covariance))
        self.real = values > max(0.0, self.trace) * len(covariance) * 1e-14
        self.explained = [max(0.0, float(v)) / self.trace if self.trace > 0 else None for v in values]
        self.matrix = vectors / np.sqrt(np.where(self.real, values, 1.0))


def fit(rows: DataFrame, n: int, sums: np.ndarray, components: int, scale: int, shift: int) -> Whitening:
    exact = rows.mapInArrow(_rows(scale, shift, n, sums), "row array<double>")
    return Whitening(n, sums, gramian(exact, "row", n, len(sums)) / n, components)


def _whiten(model, scale: int, shift: int):
    """mapInPandas: the whitened rows and their squared deviations."""

    def run(frames):
        fit_ = model.value
        for frame in frames:
            if len(frame):
                exact, rows = centred(whole_numbers(np.stack(frame["vector"].to_numpy()), scale, shift), fit_.n, fit_.sums)
                if float(np.square(rows * fit_.n).sum(axis=1).max()) < 2.0**62:
                    squares = np.square(exact).sum(axis=1).tolist()
                else:
                    squares = [sum(v * v for v in row) for row in exact.tolist()]
                yield pd.DataFrame({"vec_id": frame["vec_id"], "deviation_text": [str(v) for v in squares], "whitened": list(rows @ fit_.matrix)})

    return run


def _products():
    """One row a task: n, the sums of the components and of their products."""

    def run(frames):
        n, sums, products = 0, 0.0, 0.0
        for frame in frames:
            if len(frame):
                w = np.stack(frame["whitened"].to_numpy())
                n, sums, products = n + len(w), sums + w.sum(axis=0), products + w.T @ w
        if n:
            yield pd.DataFrame({"n": [n], "sums": [sums], "products": [products.ravel()]})

    return run


def _total(partial: DataFrame, column: str, kind: str) -> np.ndarray:
    """Arrays of all rows added up place by place; the result is as long as one of them."""
    added = partial.select(F.posexplode(column).alias("place", "value")).groupBy("place").agg(F.sum("value").cast(kind).alias("value"))
    return np.array([r["value"] for r in sorted(added.collect(), key=lambda r: r["place"])])


def identity_error(whitened: DataFrame, model: Whitening) -> float | None:
    """Largest entry of the measured covariance of the whitened rows minus the identity."""
    if not model.real.any():
        return None
    k = len(model.real)
    partial = whitened.select("whitened").mapInPandas(_products(), "n bigint, sums array<double>, products array<double>")
    mean = _total(partial, "sums", "double") / model.n
    measured = _total(partial, "products", "double").reshape(k, k) / model.n - np.outer(mean, mean)
    return float(np.abs(measured - np.eye(k))[np.ix_(model.real, model.real)].max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_text: a row for each vector and component."""
    bounded_batches(vectors)
    spark = vectors.sparkSession
    found = usable(vectors, id_col, vector_col)
    kind = found.schema["vec_id"].dataType.simpleString()
    lengths = found.groupBy(F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    rows = found.where(F.size("vector") == (lengths["size"] if lengths else 0))
    head = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_text string"
    if lengths is None:
        return spark.createDataFrame([], head)
    partial = rows.select("vector").mapInArrow(_sums(scale, shift), "n bigint, sums array<bigint>")
    n, sums = lengths["n"], _total(partial, "sums", "bigint")
    model = fit(rows, n, sums, components, scale, shift)
    shared = spark.sparkContext.broadcast(model)
    # Pandas would make doubles of whole ids beside nulls.
    named = rows.withColumn("vec_id", F.col("vec_id").cast("string"))
    white = named.mapInPandas(_whiten(shared, scale, shift), "vec_id string, deviation_text string, whitened array<double>")
    error = identity_error(white, model)
    per = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("component"), (F.col("whitened")[i] if real else F.lit(None).cast("double")).alias("whitened"), F.lit(e).cast("double").alias("explained")) for i, (real, e) in enumerate(zip(model.real, model.explained, strict=True)))))
    return white.select(F.col("vec_id").cast(kind).alias("vec_id"), F.expr("try_cast(deviation_text AS bigint)").alias("deviation"), "deviation_text", per.alias("c")).select(
        "vec_id", "c.component", F.lit(n).cast("bigint").alias("n"), "deviation", "c.whitened", "c.explained", F.lit(error).cast("double").alias("identity_error"), "deviation_text"
    )
