"""Whitening of embeddings by an exact covariance: digit-slice products on float64, merged as big integers.

Vectors become integers.  Their covariance is that of the distinct ones, centred before they are multiplied: with n
vectors and sums S, the rows n * x - S are integers too.  These are cut into limbs of LIMB bits, and the products of two
limbs of up to 2^(53 - 2 LIMB) rows are sums below 2^53, which BLAS forms exactly in float64.  Each task recombines its
limbs as big integers and sends their digits, Spark adds those up, and the driver turns the exact matrix, once, into
doubles for the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import lean, saved, table

#: Bits of a limb, and the rows whose products of limbs stay exact in float64.
LIMB = 20
EXACT_ROWS = 1 << 53 - 2 * LIMB
#: Bits of the digits as which big integers travel: 2^31 tasks can be added up in a long.
DIGIT = 32
#: Numbers that a task holds as one block of rows.
BLOCK_NUMBERS = 1 << 20


def integers(vectors: pa.Array, scale: int, shift: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of one length, and their integers floor(scale * c) + shift; vectors that are null or
    empty, or hold null or non-finite entries, are left out."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
    for dims in np.unique(lengths[lengths > 0]):
        at = np.flatnonzero(lengths == dims)
        flat = pc.list_flatten(vectors.take(pa.array(at))).cast(pa.float64())
        c = np.asarray(pc.fill_null(flat, np.nan)).reshape(len(at), dims)
        fine = np.isfinite(c).all(axis=1)
        scaled = np.floor(scale * c[fine])
        if scaled.size and np.abs(scaled).max() >= 2.0**62:
            raise ValueError("a vector's entry is too large for a 64-bit integer")
        yield at[fine], scaled.astype(np.int64) + shift


def as_integers(rows: DataFrame, key: str, vector: str, scale: int, shift: int) -> DataFrame:
    """key and x, the integers of each vector that takes part, as little-endian bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in integers(batch.column(1), scale, shift):
                if len(at):
                    yield pa.RecordBatch.from_pydict({"key": batch.column(0).take(pa.array(at)), "x": pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())})

    return rows.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector")).mapInArrow(run, "key long, x binary")


def blocks(batches: Iterator[pa.RecordBatch], column: str, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of the batches with their integers as an array, a block of bounded size at a time."""
    step = max(1, min(EXACT_ROWS, BLOCK_NUMBERS // dims))
    for batch in batches:
        for first in range(0, batch.num_rows, step):
            part = batch.slice(first, step)
            yield part, np.frombuffer(b"".join(part.column(column).to_pylist()), "<i8").reshape(part.num_rows, dims)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exact: 64-bit integers where they fit, Python's otherwise."""
    most = n * max(map(abs, (int(x.max(initial=0)), int(x.min(initial=0))))) + max(map(abs, sums))
    if most < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def limbs(d: np.ndarray) -> list[np.ndarray]:
    """d as float64 arrays of LIMB bits, lowest first; the highest holds the sign."""
    out = []
    while True:
        if not d.size or max(abs(int(d.min())), abs(int(d.max()))) < 1 << LIMB:
            return [*out, d.astype(np.float64)]
        out.append((d & (1 << LIMB) - 1).astype(np.float64))
        d = d >> LIMB


def gram(parts: Iterator[np.ndarray], dims: int) -> np.ndarray:
    """The exact sum of d' d over blocks of at most EXACT_ROWS integer rows, as Python integers.

    Products of limbs i and j are below 2^53 and join those of the same i + j in 64-bit integers, which are emptied
    into the big ones before they could overflow."""
    total, held, n = np.zeros((dims, dims), object), {}, 0
    for d in parts:
        cut = limbs(d)
        for i, a in enumerate(cut):
            for j in range(i, len(cut)):
                product = (a.T @ cut[j]).astype(np.int64)
                held[i + j] = held.get(i + j, 0) + (product if i == j else product + product.T)
        n += 1
        if n == 1 << 6:  # so many blocks of up to 2^54 for each of a few pairs of limbs
            total, held, n = _emptied(total, held), {}, 0
    return _emptied(total, held)


def _emptied(total: np.ndarray, held: dict[int, np.ndarray]) -> np.ndarray:
    for place, product in held.items():
        total = total + (product.astype(object) << LIMB * place)
    return total


def digits(value: int, count: int) -> list[int]:
    """An integer in base 2^DIGIT, lowest digit first; the highest holds the sign."""
    return [value >> DIGIT * k & (1 << DIGIT) - 1 for k in range(count - 1)] + [value >> DIGIT * (count - 1)]


#: Digits that travel: 159 bits and a sign.
DIGITS = 5


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors with sums S per dimension; components in rows by falling eigenvalue of the covariance of x,
    their eigenvalues, the covariance's trace, and what whitened vectors' covariance differs from the identity by."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    scale: int
    shift: int
    identity_error: float = float("nan")

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """x - S / n on the components, over the roots of their eigenvalues."""
        d = centred(x, self.n, self.sums)
        return (d / self.n).astype(np.float64) @ (self.components / np.sqrt(self.eigenvalues)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sums of (n * x - S)^2, exact."""
        d = centred(x, self.n, self.sums)
        if d.dtype != object and d.size and max(abs(int(d.min())), abs(int(d.max()))) ** 2 * d.shape[1] >= 1 << 63:
            d = d.astype(object)
        return (d * d).sum(axis=1).tolist()


def moments(fit_list: DataFrame) -> tuple[int, list[int]]:
    """Rows and exact sums per dimension of saved integer vectors; a few numbers a dimension to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = {}, {}, {}
        for batch in batches:
            widths = np.asarray(pc.binary_length(batch.column(0))) // 8
            for dims in np.unique(widths):
                own = batch.filter(pa.array(widths == dims))
                for part, x in blocks(iter([own]), "x", int(dims)):
                    high[dims] = high.get(dims, 0) + (x >> DIGIT).sum(axis=0)
                    low[dims] = low.get(dims, 0) + (x & (1 << DIGIT) - 1).sum(axis=0)
                    n[dims] = n.get(dims, 0) + part.num_rows
        for dims in n:
            yield pa.RecordBatch.from_pydict({"dims": pa.array([int(dims)] * int(dims)), "at": pa.array(range(int(dims))), "high": pa.array(high[dims]), "low": pa.array(low[dims]), "n": pa.array([n[dims]] * int(dims))})

    sums = fit_list.mapInArrow(run, "dims long, at long, high long, low long, n long").groupBy("dims", "at").agg(*(F.sum(c).alias(c) for c in ("high", "low", "n"))).orderBy("at").collect()
    if len({r["dims"] for r in sums}) > 1:
        raise ValueError(f"vectors of different lengths: {sorted({r['dims'] for r in sums})}")
    return (sums[0]["n"] if sums else 0), [(r["high"] << DIGIT) + r["low"] for r in sums]


def scatter(fit_list: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The exact sum of (n * x - S)'(n * x - S): digits of each entry by task, added up by Spark."""
    dims = len(sums)
    rows, cols = (a.tolist() for a in np.triu_indices(dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = gram((centred(x, n, sums) for _, x in blocks(batches, "x", dims)), dims)
        if not total.any():
            return
        each = [digits(total[i, j], DIGITS) for i, j in zip(rows, cols, strict=True)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(rows, pa.int64()), "j": pa.array(cols, pa.int64())} | {f"d{k}": pa.array([e[k] for e in each], pa.int64()) for k in range(DIGITS)})

    names = [f"d{k}" for k in range(DIGITS)]
    merged = fit_list.mapInArrow(run, "i long, j long, " + ", ".join(f"{d} long" for d in names)).groupBy("i", "j").agg(*(F.sum(d).alias(d) for d in names))
    got, out = merged.toArrow(), np.zeros((dims, dims), object)
    i, j = (got.column(c).to_numpy() for c in "ij")
    out[i, j] = sum(got.column(d).to_numpy().astype(object) << DIGIT * k for k, d in enumerate(names))
    out[j, i] = out[i, j]
    return out


def fit(fit_list: DataFrame, most: int | None, scale: int, shift: int) -> Whitening | None:
    """The whitening of saved distinct integer vectors; None without any."""
    n, sums = moments(fit_list)
    if not n:
        return None
    exact = scatter(fit_list, n, sums)
    cube = n**3
    covariance = np.array([[value / cube for value in row] for row in exact.tolist()])  # division of integers is rounded once
    values, vectors = np.linalg.eigh(covariance)
    values, components = values[::-1], vectors.T[::-1]
    kept = values > max(values[0], 0.0) * len(sums) * np.finfo(float).eps
    values, components = values[kept][:most], components[kept][:most]
    largest = np.abs(components).argmax(axis=1)
    components = components * np.sign(components[np.arange(len(components)), largest])[:, None]
    found = Whitening(n, sums, components, values, sum(exact[k, k] for k in range(len(sums))) / cube, scale, shift)
    return Whitening(**vars(found) | {"identity_error": identity_error(fit_list, found)})


def identity_error(fit_list: DataFrame, w: Whitening) -> float:
    """The largest entry of the covariance of the whitened fit list less the identity, from the whitened rows themselves."""
    k, dims = len(w.eigenvalues), len(w.sums)
    if not k:
        return 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for _, x in blocks(batches, "x", dims):
            y = w.whitened(x)
            total += np.concatenate([y.T @ y, y.sum(axis=0)[None]])
        at = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_pydict({"i": pa.array(at[0]), "j": pa.array(at[1]), "v": pa.array(total.ravel())})

    total = np.zeros((k + 1, k))
    for r in fit_list.mapInArrow(run, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    mean = total[k] / w.n
    return float(np.abs(total[:k] / w.n - np.outer(mean, mean) - np.eye(k)).max())


def _prepared(vectors: DataFrame, key: str, vector: str, scale: int, shift: int, most: int | None) -> tuple[DataFrame, Whitening | None]:
    lean(vectors.sparkSession)
    rows = as_integers(vectors, key, vector, scale, shift)
    return rows, fit(saved(rows.select("x").distinct(), "distinct"), most, scale, shift)


OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, most: int | None = 16, scale: int = 64, shift: int = 1_000_000, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component, up to `most`: see OUT.

    Vectors that are null or empty, or hold null or non-finite entries, take no part; the others' entries c are
    floor(scale * c) + shift.  Vectors that are alike as integers count once in the fit, and each has its rows in the
    result; null keys and repeated rows do too.  Components of no variance (below rounding error of the largest) are
    none, so vectors that are all alike, or a single one, give no rows; so does an empty table.  Vectors of different
    lengths are an error, and so are entries beyond 64 bits.  Only the key and the vector are read, so other columns'
    names can't clash.  The driver holds matrices of dimensions by dimensions, whatever the number of rows.
    """
    rows, found = _prepared(vectors, key, vector, scale, shift, most)
    if found is None or not len(found.eigenvalues):
        return vectors.sparkSession.createDataFrame([], OUT)
    k, dims, w = len(found.eigenvalues), len(found.sums), found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches, "x", dims):
            m = part.num_rows
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": part.column("key").take(pa.array(np.repeat(np.arange(m), k))),
                    "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    "n": pa.array(np.full(m * k, w.n)),
                    "deviation": pa.array([str(d) for d in w.deviations(x) for _ in range(k)]),
                    "whitened": pa.array(w.whitened(x).ravel()),
                    "explained": pa.array(np.tile(w.eigenvalues / w.trace, m)),
                    "identity_error": pa.array(np.full(m * k, w.identity_error)),
                }
            )

    return rows.mapInArrow(run, OUT.replace("decimal(38,0)", "string")).withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whitener(vectors: DataFrame, most: int | None = None, scale: int = 64, shift: int = 1_000_000, key: str = "vec_id", vector: str = "embedding") -> tuple[Whitening | None, Callable[[DataFrame], DataFrame]]:
    """The fitted whitening and a function that whitens other tables with it: key and `whitened`, an array a row."""
    _, w = _prepared(vectors, key, vector, scale, shift, most)

    def apply(others: DataFrame) -> DataFrame:
        schema = "key long, whitened array<double>"
        if w is None:
            return others.sparkSession.createDataFrame([], schema)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, x in blocks(batches, "x", len(w.sums)):
                yield pa.RecordBatch.from_pydict({"key": part.column("key"), "whitened": pa.array(list(w.whitened(x)), pa.list_(pa.float64()))})

        return as_integers(others, key, vector, scale, shift).mapInArrow(run, schema)

    return w, apply


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 components of all embeddings; a deviation beyond 64 bits is an error."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
