"""Whitening of embeddings along their leading components.

Golub-Kahan-Lanczos bidiagonalisation of the centred rows X: products Xv and X'u alternate, each over all rows by Spark, and their
coefficients form a small bidiagonal matrix, whose singular values and right vectors give deviations and components. Every new
vector is made orthogonal again to all before it. A left vector u has one entry per row, but is X times a short vector, so the driver
holds only vectors of one entry per dimension; a pass over the rows returns X'Xq, the length of Xq and its products with all
earlier left vectors, a few numbers summed by Spark.

Rows are written once as blocks of integers and centred exactly, as (n x - S) / n, whenever they are read.

Defined results: a vector that is null, empty, or holds a null, non-finite or unrepresentable entry (beyond 2^50 after scaling) is dropped, and so is one
whose number of entries is not the most frequent (ties: the larger); repeated rows and rows without an id are rows of their own; a component
without variance has no ``whitened`` (null) and explains 0, or null if there is no variance at all; ``deviation`` is null beyond a long; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strataframe.llm.shared import Scratch, flat_bytes

#: Rows of a block.
BLOCK_ROWS = 2048
#: Dimensions up to which the bidiagonalisation is carried through, and its most steps beyond.
WHOLE = 256
#: Singular values below this part of the largest count as none.
NONE = 1e-13
LARGEST = float(1 << 50)


def whole_numbers(vector: Column) -> Column:
    """Entries as floor(1024 c) + 100000."""
    return F.transform(vector, lambda c: (F.floor(c.cast("double") * 1024.0) + 100000).cast("long"))


def _usable(vector: Column) -> Column:
    # A NaN is larger than every number, also in its absolute value.
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * 1024.0 < LARGEST, F.lit(False))), F.lit(False))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK_ROWS):
            part = batch.slice(lo, BLOCK_ROWS)
            data = part.column("x").flatten().to_numpy().astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part.num_rows], pa.int32()), pa.array([part.column("vec_id").to_pylist()], pa.list_(pa.int64())),
                                              pa.array([data], pa.binary())], names=["rows", "ids", "data"])


class Rows:
    """The rows to fit, as written blocks: their number ``n``, dimensions ``d``, exact ``sums`` and total ``spread`` (summed squares around the mean)."""

    def __init__(self, vectors: DataFrame, vector: str, scratch: Scratch):
        usable = vectors.where(_usable(F.col(vector))).select(F.col("vec_id").cast("long").alias("vec_id"), whole_numbers(F.col(vector)).alias("x"))
        common = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        self.n, self.d = 0, 0
        if common is None:
            return
        self.d = common["d"]
        self.blocks = scratch.write(usable.where(F.size("x") == self.d).mapInArrow(_blocks, "rows int, ids array<long>, data binary"), "blocks")
        d = self.d

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total, most, count = np.zeros(d, object), 0, 0
            for batch in batches:
                for x in _matrices(batch, d):
                    total += x.sum(axis=0).astype(object)
                    most, count = max(most, int(np.abs(x).max())), count + len(x)
            if count:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d + 2), pa.int32()), pa.array([str(int(v)) for v in (*total, count, most)])], names=["at", "value"])

        parts = self.blocks.select("data").mapInArrow(sums, "at int, value string").withColumn("value", F.col("value").cast("decimal(38,0)"))
        found = {r["at"]: (int(r["s"]), int(r["m"])) for r in parts.groupBy("at").agg(F.sum("value").alias("s"), F.max("value").alias("m")).collect()}
        self.sums, self.n, most = [found[i][0] for i in range(d)], found[d][0], found[d + 1][1]
        # Beyond 64 bits the differences are taken with whole numbers of any size.
        self.wide = self.n * most >= 1 << 61
        self.spread = self.total(lambda y: (y * y).sum(keepdims=True).ravel())[0]

    def differences(self) -> Callable[[np.ndarray], np.ndarray]:
        """n x - S of a matrix, exact."""
        n, sums = self.n, np.array(self.sums, object if self.wide else np.int64)
        wide = self.wide
        return lambda x: (x.astype(object) if wide else x) * n - sums

    def total(self, body: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """Sum of a short vector that ``body`` works out for each block of centred rows."""
        differences, n, d = self.differences(), self.n, self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for batch in batches:
                for x in _matrices(batch, d):
                    part = body(differences(x).astype(np.float64) / n)
                    held = part if held is None else held + part
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held)), pa.int32()), pa.array(held)], names=["at", "value"])

        parts = self.blocks.select("data").mapInArrow(run, "at int, value double")
        return np.array([r["value"] for r in sorted(parts.groupBy("at").agg(F.sum("value").alias("value")).collect(), key=lambda r: r["at"])])


def _matrices(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    raw, offsets = flat_bytes(batch.column("data"))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        yield np.frombuffer(raw[a:b].tobytes(), "<i8").reshape(-1, d)


def _pass(rows: Rows, q: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """X'Xq, the squared length of Xq, and the products of Xq with the vectors X left."""
    d = len(q)

    def body(y: np.ndarray) -> np.ndarray:
        z = y @ q
        return np.concatenate([y.T @ z, [z @ z], (y @ left).T @ z])

    out = rows.total(body)
    return out[:d], float(out[d]), out[d + 1:]


def bidiagonalise(rows: Rows, wanted: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """Singular values (falling) and right singular vectors (columns) of the centred rows, ``wanted`` at least."""
    d = rows.d
    rng = np.random.default_rng(seed)
    scale = np.sqrt(rows.spread)

    def fresh(basis: list[np.ndarray]) -> np.ndarray:
        v = rng.standard_normal(d)
        for _ in range(3):
            for b in basis:
                v = v - b * (b @ v)
            v /= np.linalg.norm(v)
        return v

    right, left, back = [fresh([])], [], []  # v; w with u = Xw; X'u
    alphas, betas = [], []
    while True:
        v = right[-1]
        q = v - betas[-1] * left[-1] if left else v
        w_all = np.array(left).T.reshape(d, len(left))
        product, square, against = _pass(rows, q, w_all)
        if left:
            # Full reorthogonalisation of u, on the short vectors; a second pass where the first took much away.
            q = q - w_all @ against
            product = product - np.array(back).T @ against
            rest = square - against @ against
            if rest < 0.5 * square:
                product, square, against = _pass(rows, q, w_all)
                q, product, rest = q - w_all @ against, product - np.array(back).T @ against, square - against @ against
            square = rest
        alpha = float(np.sqrt(max(square, 0.0)))
        if alpha <= NONE * scale:
            alpha, w, product = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, product = q / alpha, product / alpha
        left.append(w)
        back.append(product)
        alphas.append(alpha)
        k = len(alphas)
        rest = product - alpha * v
        for _ in range(2):
            for b in right:
                rest = rest - b * (b @ rest)
        beta = float(np.linalg.norm(rest))
        bidiagonal = np.diag(alphas) + np.diag(betas, 1)
        u, s, vt = np.linalg.svd(bidiagonal)
        # Left to go: what a triplet lacks is its last entry times the next coefficient.
        exact = d > WHOLE and k >= wanted and np.all(beta * np.abs(u[-1, :wanted]) <= 1e-15 * s[0])
        if k == d or exact:
            vectors = np.array(right).T @ vt.T
            return s, vectors
        if beta <= NONE * scale:
            beta, v = 0.0, fresh(right)
        else:
            v = rest / beta
        betas.append(beta)
        right.append(v)


OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, scratch: Scratch, *, vector: str = "embedding", components: int = 8) -> DataFrame:
    """Per usable row of ``vectors`` (vec_id, ``vector``) and component: its whitened coordinate, in ``OUT``.

    ``deviation`` is the sum over dimensions of (n x - S)^2, ``explained`` the component's part of the variance, ``identity_error`` the
    largest absolute entry of the whitened covariance minus the identity.
    """
    rows = Rows(vectors, vector, scratch)
    if not rows.n:
        return vectors.sparkSession.createDataFrame([], OUT)
    count = min(components, rows.d)
    if rows.spread > 0:
        values, found = bidiagonalise(rows, count)
    else:
        values, found = np.zeros(count), np.eye(rows.d)
    values, found = values[:count], found[:, :count]
    found = found / np.linalg.norm(found, axis=0)
    # One sign for all rows: the largest entry is positive.
    found = found * np.sign(found[np.abs(found).argmax(axis=0), np.arange(count)])
    present = values > NONE * max(values[0], 1e-300)
    eigen = values ** 2 / rows.n
    explained = [float(e * rows.n / rows.spread) if rows.spread > 0 else None for e in np.where(present, eigen, 0.0)]
    scaled = found[:, present] / np.sqrt(eigen[present])
    error, n, d = None, rows.n, rows.d
    if scaled.shape[1]:
        mean = rows.total(lambda y: (y @ scaled).sum(axis=0)) / n

        def products(y: np.ndarray) -> np.ndarray:
            z = y @ scaled - mean
            return (z.T @ z).ravel()

        covariance = rows.total(products).reshape(scaled.shape[1], -1) / n
        error = float(np.abs(covariance - np.eye(len(covariance))).max())
    differences = rows.differences()
    at = np.flatnonzero(present)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in zip(batch.column("ids").to_pylist(), _matrices(batch, d)):
                y = differences(x)
                exact = y if y.dtype == object or np.abs(y).max() < 1 << 27 and d <= 256 else y.astype(object)
                deviation = (exact * exact).sum(axis=1)
                whitened = np.zeros((len(x), count))
                whitened[:, at] = (y.astype(np.float64) / n) @ scaled
                none = np.tile(~present, len(x))
                m = len(x) * count
                yield pa.RecordBatch.from_arrays([
                    pa.array([i for i in ids for _ in range(count)], pa.int64()), pa.array(np.tile(np.arange(1, count + 1), len(x)), pa.int32()),
                    pa.array(np.full(m, n), pa.int64()), pa.array([int(v) for v in np.repeat(deviation, count)], pa.decimal128(38, 0)),
                    pa.array(whitened.ravel(), pa.float64(), mask=none), pa.array(explained * len(x), pa.float64()),
                    pa.array([error] * m, pa.float64())], names=[f.split()[0] for f in OUT.split(", ")])

    return rows.blocks.select("ids", "data").mapInArrow(run, OUT)
