"""Embedding whitening by QDWH spectral divide and conquer.

Entries are put on a grid of whole numbers, so that equal vectors are equal exactly and
sums are exact. Each distinct grid vector counts once: Spark collapses the
copies and sums what the fit needs, numbers in proportion to the square of a
vector's length. The eigenvectors of the covariance come from polar decompositions: the
dynamically weighted Halley iteration takes the shifted covariance to its matrix sign,
half of sign plus identity is the projector onto the eigenvectors above the
shift, and the covariance restricted to either side is split further until single
components are left. The whitening matrix, a vector's length times at most `components`
numbers, goes to every task.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from lateline.llm.common import ready
from lateline.sources.staging import settle

SCALE, ORIGIN = 64, 1_000_000
COMPONENTS = 16
_WIDEST = float(1 << 53)  # grid numbers beyond are not exact in double precision
_FLAT = 1e-12  # a component of less than this share of the largest eigenvalue has no scale to divide by
_SEED = 11

# ---- eigenvectors --------------------------------------------------------------


def polar_factor(matrix):
    """The orthogonal polar factor of a symmetric matrix, its sign, by QDWH."""
    size = len(matrix)
    x = matrix / np.linalg.norm(matrix)
    try:
        low = 1 / (np.linalg.norm(np.linalg.inv(x), 1) * np.sqrt(size))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low, 1e-17), 1.0)
    unit = np.eye(size)
    for _ in range(30):
        ratio = np.cbrt(4 * (1 - low * low) / low**4)
        root = np.sqrt(1 + ratio)
        a = root + np.sqrt(8 - 4 * ratio + 8 * (2 - low * low) / (low * low * root)) / 2
        b = (a - 1) ** 2 / 4
        c = a + b - 1
        if c > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, unit]))
            onward = b / c * x + (a - b / c) / np.sqrt(c) * (q[:size] @ q[size:].T)
        else:
            onward = b / c * x + (a - b / c) * np.linalg.solve(unit + c * (x @ x), x)
        onward = (onward + onward.T) / 2
        low = min(low * (a + b * low * low) / (1 + c * low * low), 1.0)
        moved, x = np.linalg.norm(onward - x), onward
        if moved < 1e-13 * size and 1 - low < 1e-14:
            break
    return x


def _split(matrix, shift, rng):
    """(basis, count, leak): the first columns span the eigenvectors above the shift; leak couples the sides."""
    size = len(matrix)
    projector = (polar_factor(matrix - shift * np.eye(size)) + np.eye(size)) / 2
    count = int(round(np.trace(projector)))
    if not 0 < count < size:
        return None, count, np.inf
    start = rng.standard_normal((size, size))
    above = np.linalg.qr(projector @ start[:, :count])[0]
    below = np.linalg.qr(start[:, count:] - projector @ start[:, count:])[0]
    above, below = projector @ above, below - projector @ below
    basis = np.linalg.qr(np.hstack([above, below]))[0]
    return basis, count, np.linalg.norm(basis[:, count:].T @ matrix @ basis[:, :count])


def spectrum(matrix):
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, by falling eigenvalue."""
    whole, rng = np.linalg.norm(matrix), np.random.default_rng(_SEED)
    found, waiting = [], [(matrix, np.eye(len(matrix)))]
    while waiting:
        part, basis = waiting.pop()
        beside = np.linalg.norm(part - np.diag(np.diag(part)))
        if len(part) == 1 or beside <= 1e-16 * whole:
            found += zip(np.diag(part), basis.T, strict=True)
            continue
        # the middle halves the work; the mean lies between two eigenvalues wherever they differ
        diagonal, mean = np.diag(part), np.trace(part) / len(part)
        spread = max(np.linalg.norm(part - mean * np.eye(len(part))) / np.sqrt(len(part)), np.finfo(float).tiny)
        best = None, 0, np.inf
        for shift in (np.median(diagonal), mean, mean + 0.11 * spread, mean - 0.11 * spread, mean + 0.37 * spread, mean - 0.37 * spread):
            split = _split(part, shift, rng)
            if split[2] < best[2]:
                best = split
            if best[2] <= 1e-15 * len(part) * whole:
                break
        turned, count, leak = best
        if turned is None or leak >= beside:  # equal up to rounding: any basis will do
            found += zip(diagonal, basis.T, strict=True)
            continue
        inner = turned.T @ part @ turned
        inner = (inner + inner.T) / 2
        basis = basis @ turned
        waiting += [(inner[:count, :count], basis[:, :count]), (inner[count:, count:], basis[:, count:])]
    vectors = np.array([vector for _, vector in found]).reshape(-1, len(matrix)).T
    vectors = np.linalg.qr(vectors)[0] if vectors.size else vectors
    values = np.einsum("ij,ij->j", vectors, matrix @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


# ---- grid vectors --------------------------------------------------------------


def usable(embedding):
    """Vectors without nulls, of finite entries that have a place on the grid."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < _WIDEST / (2 * SCALE)))
    return embedding.isNotNull() & F.coalesce(fine, F.lit(False))


def _grid(column, length):
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)
    return np.floor(rows * SCALE).astype(np.int64)


def _by_length(batch, name):
    lengths = pc.list_value_length(batch.column(name)).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths).tolist():
        if length:
            yield length, batch.take(pa.array(np.flatnonzero(lengths == length)))


def distinct_vectors(vectors):
    """(length, grid) of each distinct grid vector, two bytes an entry where that is enough."""

    def keys(batches):
        for batch in batches:
            for length, part in _by_length(batch, "embedding"):
                grid = _grid(part.column("embedding"), length)
                narrow = (np.abs(grid) < 1 << 15).all(axis=1)
                raw = [(row.astype("<i2") if small else row.astype("<i8")).tobytes() for row, small in zip(grid, narrow.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([length] * len(raw), pa.int32()), pa.array(raw, pa.binary())], ["length", "grid"])

    return vectors.select("embedding").mapInArrow(keys, "length int, grid binary").distinct()


def _rows(batch):
    """(length, grid vectors) of a batch of distinct vectors."""
    lengths = batch.column("length").to_numpy()
    sizes = pc.binary_length(batch.column("grid")).to_numpy(zero_copy_only=False)
    for length, size in sorted(set(zip(lengths.tolist(), sizes.tolist(), strict=True))):
        raw = batch.column("grid").take(pa.array(np.flatnonzero((lengths == length) & (sizes == size)))).to_pylist()
        yield length, np.frombuffer(b"".join(raw), f"<i{size // length}").reshape(len(raw), length).astype(np.int64)


def _totals(distinct):
    """{length: (n, exact sums per dimension)} as whole numbers, beside the origin."""

    def sums(batches):
        found = {}
        for batch in batches:
            for length, rows in _rows(batch):
                exact = rows.sum(axis=0) if np.abs(rows).max() * len(rows) < _WIDEST else rows.astype(object).sum(axis=0)
                n, before = found.get(length, (0, np.zeros(length, object)))
                found[length] = n + len(rows), before + exact.astype(object)
        for length, (n, total) in found.items():
            values = [int(v) for v in (n, *total)]
            columns = [pa.array([length] * len(values), pa.int32()), pa.array(np.arange(-1, length, dtype=np.int32)), pa.array(values, pa.decimal128(38, 0))]
            yield pa.RecordBatch.from_arrays(columns, ["length", "i", "value"])

    summed = distinct.mapInArrow(sums, "length int, i int, value decimal(38,0)").groupBy("length", "i").agg(F.sum("value").alias("value"))
    totals = {}
    for row in summed.collect():  # one row per dimension
        totals.setdefault(row["length"], {})[row["i"]] = int(row["value"])
    return {length: (found[-1], [found[i] for i in range(length)]) for length, found in totals.items()}


@dataclass
class Model:
    """What a fit to vectors of one length found."""

    n: int
    sums: list  # per dimension, beside the origin
    matrix: np.ndarray  # whitening: a centred vector times this
    explained: np.ndarray
    identity_error: float = 0.0

    def __post_init__(self):
        self.near = np.array([(2 * total + self.n) // (2 * self.n) for total in self.sums], np.int64)
        self.left = [total - self.n * int(near) for total, near in zip(self.sums, self.near, strict=True)]
        self.beside = np.array([left / self.n for left in self.left])

    def centred(self, grid):
        return (grid - self.near).astype(np.float64) - self.beside

    def deviations(self, grid):
        """The exact sum of (n * x - S)^2 of each vector; None where a long does not hold it."""
        rough = self.centred(grid) * self.n
        if (rough * rough).sum(axis=1).max(initial=0) < 9e18:
            whole = (grid - self.near) * self.n - np.array(self.left, np.int64)
            return (whole * whole).sum(axis=1).tolist()
        whole = (grid - self.near).astype(object) * self.n - np.array(self.left, object)
        return [int(v) if v < 1 << 63 else None for v in (whole * whole).sum(axis=1)]


def _products(distinct, models):
    """{length: sum over the fit list of z z^T}, z the centred vectors times their model's matrix."""

    def moments(batches):
        found = {}
        for batch in batches:
            for length, rows in _rows(batch):
                z = models[length].centred(rows) @ models[length].matrix
                found[length] = found.get(length, 0) + z.T @ z
        for length, square in found.items():
            i, j = np.tril_indices(len(square))
            columns = [np.full(len(i), length, np.int32), i.astype(np.int32), j.astype(np.int32), square[i, j]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["length", "i", "j", "value"])

    schema = "length int, i int, j int, value double"
    summed = distinct.mapInArrow(moments, schema).groupBy("length", "i", "j").agg(F.sum("value").alias("value"))
    squares = {length: np.zeros((model.matrix.shape[1],) * 2) for length, model in models.items()}
    for row in summed.collect():  # half the square of a vector's length
        square = squares[row["length"]]
        square[row["i"], row["j"]] = square[row["j"], row["i"]] = row["value"]
    return squares


def fit(embeddings, components=COMPONENTS):
    """{length: Model} of the vectors of `embeddings` (embedding); each length is fitted on its own.

    Copies count once. Components whose eigenvalue is 0 up to rounding are left out.
    """
    ready(embeddings.sparkSession)
    distinct = settle(distinct_vectors(embeddings.where(usable(F.col("embedding")))), "distinct")
    models = {length: Model(n, sums, np.eye(length), np.zeros(0)) for length, (n, sums) in _totals(distinct).items()}
    for length, square in _products(distinct, models).items():
        model = models[length]
        covariance = square / model.n
        values, vectors = spectrum(covariance)
        kept = int((values[:components] > max(_FLAT * values[0], 0)).sum())
        model.matrix = vectors[:, :kept] / np.sqrt(values[:kept])
        model.explained = values[:kept] / np.trace(covariance) if kept else np.zeros(0)
    for length, square in _products(distinct, models).items():
        models[length].identity_error = float(np.abs(square / models[length].n - np.eye(len(square))).max(initial=0.0))
    return models


def whiten(embeddings, models):
    """(vec_id, n, deviation, whitened, explained, identity_error) of every vector with a model for its length.

    Null vectors and those that hold nulls or numbers that are not finite are left
    out, and so are entries beyond 2^53 / 128, which have no exact place on the grid.
    Rows stay as they are, repeated and null vec_ids too; other columns are not
    looked at. A vector of length 0, and all vectors of a length whose vectors are all
    equal, have no components: `whitened` is empty.
    """

    def rows(batches):
        for batch in batches:
            for length, part in _by_length(batch, "embedding"):
                model, grid = models.get(length), _grid(part.column("embedding"), length)
                if model is None:
                    continue
                size, kept = len(grid), model.matrix.shape[1]
                offsets = pa.array(np.arange(size + 1, dtype=np.int32) * kept)
                columns = [
                    part.column("vec_id"),
                    pa.array(np.full(size, model.n, np.int64)),
                    pa.array(model.deviations(grid), pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array((model.centred(grid) @ model.matrix).ravel())),
                    pa.ListArray.from_arrays(offsets, pa.array(np.tile(model.explained, size))),
                    pa.array(np.full(size, model.identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "n", "deviation", "whitened", "explained", "identity_error"])

    ready(embeddings.sparkSession)
    vectors = embeddings.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), "embedding")
    schema = "vec_id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    return vectors.mapInArrow(rows, schema)


def query(spark, sf_dir):
    """One row per vector and component of the whole table embeddings."""
    from lateline.llm.common import table

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = whiten(vectors, fit(vectors))
    each = found.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select(
        "vec_id",
        (F.col("at") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"),
        "identity_error",
    )
