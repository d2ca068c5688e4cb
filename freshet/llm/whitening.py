"""Embedding whitening from exact second moments, counted bit by bit.

Every entry c becomes the integer x = floor(1024 c) + 100000. Tasks take blocks of rows, shift each dimension by
its least value in the block and slice the shifted integers into bit planes: one bit a row, packed into 64-bit
words. The cross-product of two dimensions is the sum over all pairs of their planes of 2^(i+j) times the
popcount of the planes' AND, an exact integer; undoing the shift keeps it one. Spark adds the blocks' sums and
cross-products as decimals, and n * M - S S' is the centred scatter, still exact. Only then does it become a
double matrix, whose eigenvectors whiten the rows. The driver holds numbers per pair of dimensions, never rows.

Left out: vectors that are null or empty, hold null or non-finite entries, or entries beyond 2^43 (whose integers
do not fit), and those whose number of dimensions is not the commonest one (of equally common ones, the greatest).
Repeated rows and vectors count as often as they occur; a null vec_id stays null. Components without variance
(an eigenvalue within rounding error of zero) cannot be scaled and are left out, as are all if no row remains.
Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from freshet.llm.common import Scratch, prepare

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Rows of a block: 64 words of 64 bits a plane.
BLOCK_ROWS = 4096
_LARGEST = float(1 << 43)


@dataclass(frozen=True)
class Moments:
    """n, sums and cross-products of integer vectors, exact."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def scatter(self) -> list[list[int]]:
        """n * M - S S': n squared times the covariance."""
        s = self.sums
        return [[self.n * m - s[i] * s[j] for j, m in enumerate(row)] for i, row in enumerate(self.products)]

    def covariance(self) -> np.ndarray:
        # Quotients of integers are rounded once, whatever their size.
        return np.array([[v / self.n**2 for v in row] for row in self.scatter()])


def usable(df: DataFrame, column: str) -> DataFrame:
    """Rows whose vector can take part, but for its number of dimensions."""
    good = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) <= _LARGEST))
    return df.where(F.col(column).isNotNull() & (F.size(column) > 0)).where(good)


def integers(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of x as int64."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    c = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(c * SCALE).astype(np.int64) + SHIFT).reshape(-1, width)


def bit_planes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Planes (rows packed into words) of non-negative columns, and each plane's dimension and weight exponent."""
    widths = [int(v).bit_length() for v in values.max(axis=0)]
    owner = np.repeat(np.arange(len(widths)), widths)
    power = np.arange(len(owner)) - np.repeat(np.cumsum(widths) - widths, widths)
    packed = np.zeros((len(owner), -(-len(values) // 64) * 8), np.uint8)
    for k, (j, p) in enumerate(zip(owner, power)):
        bits = np.packbits((values[:, j] >> p) & 1 == 1)
        packed[k, : len(bits)] = bits
    return packed.view(np.uint64), owner, power


def block_moments(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and cross-products of a block: int64 where they cannot overflow, else Python integers."""
    n, width = x.shape
    low = x.min(axis=0)
    planes, owner, power = bit_planes(x - low)
    bits = int(power.max()) + 1 if len(power) else 0
    kind = np.int64 if 2 * bits + n.bit_length() < 62 else object
    weight = (1 << power.astype(object)).astype(kind)
    products, sums, own = np.zeros((width, width), kind), np.zeros(width, kind), np.zeros(width, kind)
    dims, starts = np.unique(owner, return_index=True)
    for k, i in enumerate(owner):
        # Each pair of planes once: plane k meets itself and the earlier ones.
        met = np.bitwise_count(planes[: k + 1] & planes[k]).sum(axis=1, dtype=np.int64).astype(kind)
        seen = int(np.searchsorted(starts, k, "right"))
        products[i, dims[:seen]] += np.add.reduceat(met * weight[: k + 1], starts[:seen]) * weight[k]
        sums[i] += met[k] * weight[k]
        own[i] += met[k] * weight[k] * weight[k]
    # Two different planes of one dimension meet twice in its square.
    at = np.arange(width)
    square = 2 * products[at, at] - own
    products = products + products.T
    products[at, at] = square
    shift, sums, products = low.astype(object), sums.astype(object), products.astype(object)
    products = products + np.outer(shift, sums) + np.outer(sums, shift) + n * np.outer(shift, shift)
    return n, sums + n * shift, products


def common_width(df: DataFrame, column: str) -> int | None:
    sizes = usable(df, column).groupBy(F.size(column).alias("width")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.desc("n"), F.desc("width")).first()
    return first and first["width"]


def moments(df: DataFrame, column: str, width: int) -> Moments:
    """Exact moments of all usable vectors of that width: one scan, numbers per pair of dimensions to the driver."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products, waiting, rows = 0, np.zeros(width, object), np.zeros((width, width), object), [], 0

        def add() -> None:
            nonlocal n, sums, products, waiting, rows
            x = np.concatenate(waiting)
            for low in range(0, len(x), BLOCK_ROWS):
                more = block_moments(x[low : low + BLOCK_ROWS])
                n, sums, products = n + more[0], sums + more[1], products + more[2]
            waiting, rows = [], 0

        for batch in batches:
            if batch.num_rows:
                waiting.append(integers(batch.column(0), width))
                rows += batch.num_rows
                if rows >= BLOCK_ROWS:
                    add()
        if rows:
            add()
        if n:
            for i in range(width):
                values = [Decimal(int(v)) for v in (*products[i, : i + 1], sums[i], n)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([i] * len(values), pa.int32()), pa.array([*range(i + 1), -1, -2], pa.int32()), pa.array(values, pa.decimal128(38, 0)),
                ], ["i", "j", "v"])

    found = usable(df, column).where(F.size(column) == width).select(column).mapInArrow(scan, "i int, j int, v decimal(38,0)")
    total = {(r["i"], r["j"]): int(r["v"]) for r in found.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()}
    products = [[total[max(i, j), min(i, j)] for j in range(width)] for i in range(width)]
    return Moments(total[0, -2], [total[i, -1] for i in range(width)], products)


@dataclass(frozen=True)
class Axes:
    """Eigenvalues (falling) and eigenvectors (rows) of a covariance, without those of no variance, and its trace."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float


def principal_axes(m: Moments, count: int) -> Axes:
    v = m.covariance()
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1], vector[:, ::-1].T
    some = value > len(value) * np.finfo(float).eps * max(value[0], 0.0)
    value, vector = value[some][:count], vector[some][:count]
    # A defined sign: the greatest entry is positive.
    lead = np.abs(vector).argmax(axis=1) if len(vector) else np.zeros(0, int)
    return Axes(value, vector * np.sign(vector[np.arange(len(vector)), lead])[:, None], float(np.trace(v)))


def project(df: DataFrame, column: str, key: str, m: Moments, axes: Axes) -> DataFrame:
    """(key, deviation, deviation_exact, w): each row's squared distance from the mean, times n squared, and its whitened vector."""
    width, n = len(m.sums), m.n
    whole = np.array([s // n for s in m.sums], np.int64)
    rest = [s - n * (s // n) for s in m.sums]
    small = np.array([r / n for r in rest])
    to = (axes.vectors / np.sqrt(axes.values)[:, None]).T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            near = integers(batch.column(1), width) - whole
            white = (near - small) @ to
            kind = np.int64 if width * (n * (int(np.abs(near).max()) + 1)) ** 2 < 1 << 63 else object
            gap = near.astype(kind) * n - np.array(rest, kind)
            exact = [int(v) for v in (gap * gap).sum(axis=1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([v if v < 1 << 63 else None for v in exact], pa.int64()),
                pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0)), pa.array(list(white), pa.list_(pa.float64())),
            ], ["key", "deviation", "deviation_exact", "w"])

    rows = usable(df, column).where(F.size(column) == width).select(F.col(key).cast("long").alias("key"), column)
    return rows.mapInArrow(run, "key long, deviation long, deviation_exact decimal(38,0), w array<double>")


def whiten(df: DataFrame, column: str = "embedding", key: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(key, n, deviation, deviation_exact, w array<double>, explained array<double>, identity_error) for every usable vector.

    ``deviation`` is null where it does not fit a long; ``deviation_exact`` goes on to 38 digits. ``identity_error``
    is measured on the written result: the greatest entry of its covariance minus the identity.
    """
    spark = df.sparkSession
    prepare(spark)
    schema = "key long, n long, deviation long, deviation_exact decimal(38,0), w array<double>, explained array<double>, identity_error double"
    width = common_width(df, column)
    if width is None:
        return spark.createDataFrame([], schema)
    m = moments(df, column, width)
    axes = principal_axes(m, components)
    scratch = Scratch()
    white = scratch.last(project(df, column, key, m, axes))
    at = range(len(axes.values))
    w = [F.get("w", F.lit(i)) for i in at]
    error = 0.0
    if len(at):
        mean = white.agg(*[F.avg(w[i]).alias(f"m{i}") for i in at]).first()
        each = [w[i] - F.lit(mean[i]) for i in at]
        pairs = [(i, j) for i in at for j in at if j <= i]
        got = white.agg(*[F.avg(each[i] * each[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(got[k] - (i == j)) for k, (i, j) in enumerate(pairs))
    shares = F.array(*[F.lit(float(v / axes.trace)) for v in axes.values]) if len(at) else F.array().cast("array<double>")
    return white.select(
        "key", F.lit(m.n).cast("long").alias("n"), "deviation", "deviation_exact", "w", shares.alias("explained"), F.lit(float(error)).alias("identity_error")
    )
