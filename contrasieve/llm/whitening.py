"""Whitening of embeddings along exact principal components.

Vectors become integers, so the scatter n * sum(y y') - s s' of all different vectors is a matrix of unbounded integers,
summed exactly by Spark in limbs of 32 bits. Its characteristic polynomial is found modulo many primes, one Spark row
each, by reduction to Hessenberg form, and put together by Chinese remaindering; the number of primes follows from a
bound on the coefficients. All roots are real, hence the sign changes of the shifted polynomial count the roots above a
point exactly: intervals are halved until each holds one root of the square-free part, then narrowed to as many
bits as the gap to the neighbours asks for. A component is a null vector of scatter - root: inverse iteration on an
elimination in fixed-point integers of that precision, one Spark row per root; equal roots give an orthonormal set.

Bounds: driver and closures hold matrices of dims x dims integers, never anything that grows with the rows. Equal vectors
meet by partial aggregation, so a common vector is one row per task before the shuffle.

Cases: a null vector, or one with a null, NaN or infinite entry, is left out. Vectors shorter than the longest end in
zeros. Scaled entries are held within +-2**62. Repeated rows and null ids are rows like others, and each is returned. A
component with eigenvalue 0 has whitened null; explained is null if all vectors are equal, identity_error if no
component can be whitened; deviation is null where it does not fit a long. An empty table gives no rows. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrasieve.llm import _vectors as vec
from contrasieve.session import cut_lineage

SCALE = 64
COMPONENTS = 16
LIMB, LIMBS = 32, 5
#: Bits of a component beyond what the gap between eigenvalues takes.
GUARD = 96


@dataclass
class Fit:
    """n different vectors, their sums (of entries before the shift), the scatter's leading roots and unit vectors."""

    n: int
    dims: int
    sums: list[int]
    trace: int
    roots: list[Fraction]
    vectors: np.ndarray
    error: float | None = None


# --- exact sums ---------------------------------------------------------------------------------------------------


def _distinct(df: DataFrame, vector_col: str, dims: int, scale: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, rows = vec.scaled(batch["v"], scale, dims)
            yield pa.RecordBatch.from_arrays([vec.pack(rows)], ["key"])

    return df.select(vec.as_doubles(vector_col).alias("v")).mapInArrow(run, "key binary").distinct()


def gram(rows: np.ndarray) -> np.ndarray:
    """rows' rows as unbounded integers, by exact products of limbs where entries are large."""
    if vec.largest(rows) ** 2 * max(len(rows), 1) < 1 << 53:
        x = rows.astype(np.float64)
        return (x.T @ x).astype(np.int64).astype(object)
    total = np.zeros((rows.shape[1],) * 2, object)
    for at in range(0, len(rows), 4096):
        part, limbs = rows[at : at + 4096], []
        while vec.largest(part) >= 1 << 20:
            limbs.append((part & ((1 << 20) - 1)).astype(np.float64))
            part = part >> 20
        limbs.append(part.astype(np.float64))
        for i, a in enumerate(limbs):
            for j, b in enumerate(limbs):
                total += (a.T @ b).astype(np.int64).astype(object) * (1 << 20 * (i + j))
    return total


def _totals(distinct: DataFrame, dims: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sums and sums of products of all different vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, products = 0, np.zeros((dims, dims), object)
        sums = np.zeros(dims, object)
        for batch in batches:
            rows = vec.unpack(batch["key"], dims)
            n += len(rows)
            small = vec.largest(rows) * max(len(rows), 1) < 1 << 62
            sums += rows.sum(axis=0).astype(object) if small else rows.astype(object).sum(axis=0)
            products += gram(rows)
        if n:
            flat = np.concatenate([np.array([n], object), sums, products[np.triu_indices(dims)]])
            for k in range(LIMBS):
                top = k == LIMBS - 1
                limb = flat >> LIMB * k if top else (flat >> LIMB * k) & ((1 << LIMB) - 1)
                at = np.flatnonzero(limb != 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(np.full(len(at), k, np.int32)), pa.array(limb[at].astype(np.int64))], ["slot", "limb", "part"]
                )

    parts = distinct.mapInArrow(run, "slot bigint, limb int, part bigint")
    flat = np.zeros(1 + dims + dims * (dims + 1) // 2, object)
    for r in parts.groupBy("slot", "limb").agg(F.sum("part").alias("part")).collect():
        flat[r["slot"]] += r["part"] << LIMB * r["limb"]
    products = np.zeros((dims, dims), object)
    products[np.triu_indices(dims)] = flat[1 + dims :]
    return int(flat[0]), flat[1 : 1 + dims], np.where(np.tri(dims, k=-1, dtype=bool), products.T, products)


# --- characteristic polynomial ------------------------------------------------------------------------------------


def _is_prime(n: int) -> bool:
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):  # enough below 3,215,031,751
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(r - 1)):
            return False
    return True


def primes(bits: int) -> list[int]:
    """The largest primes under 2**31 whose product has more than ``bits`` bits."""
    out, at, have = [], (1 << 31) - 1, 0.0
    while have <= bits + 1:
        if _is_prime(at):
            out.append(at)
            have += math.log2(at)
        at -= 2
    return out


def coefficient_bits(dims: int, trace: int) -> int:
    """Bits of the largest coefficient: the k-th is at most binomial(dims, k) * (trace / dims)**k, for roots >= 0."""
    return max((math.comb(dims, k) * trace**k // dims**k).bit_length() for k in range(dims + 1)) + 1


def polynomial_mod(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo ``p`` < 2**31, lowest first."""
    a = matrix % p
    n = len(a)
    for k in range(n - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        i = k + 1 + int(below[0])
        a[[k + 1, i]] = a[[i, k + 1]]
        a[:, [k + 1, i]] = a[:, [i, k + 1]]
        u = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - u[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((n + 1, n + 1), np.int64)
    polys[0, 0] = 1
    for m in range(n):
        factor, run = np.zeros(m + 1, np.int64), 1
        for i in range(m, -1, -1):
            factor[i] = a[i, m] * run % p
            run = run * int(a[i, i - 1]) % p if i else 0
        polys[m + 1, 1:] = polys[m, :-1]
        polys[m + 1] = (polys[m + 1] - (factor[:, None] * polys[: m + 1] % p).sum(axis=0)) % p
    return polys[n]


def combine(residues: list[tuple[int, list[int]]]) -> list[int]:
    """The integers of least size with these residues (Chinese remaindering, prime after prime)."""
    value, modulus = np.zeros(len(residues[0][1]), object), 1
    for p, row in residues:
        step = (np.array(row, object) - value) * pow(modulus, -1, p) % p
        value, modulus = value + step * modulus, modulus * p
    return [int(v - modulus if 2 * v > modulus else v) for v in value]


def characteristic(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Coefficients of det(x - matrix), lowest first, for a positive semidefinite integer matrix."""
    dims = len(matrix)
    chosen = primes(coefficient_bits(dims, int(np.trace(matrix))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [polynomial_mod((matrix % p).astype(np.int64), p).tolist() for p in frame["p"].tolist()]
            yield pd.DataFrame({"p": frame["p"], "c": rows})

    tasks = min(len(chosen), spark.sparkContext.defaultParallelism)
    found = spark.createDataFrame([(p,) for p in chosen], "p bigint").repartition(tasks).mapInPandas(run, "p bigint, c array<bigint>")
    return combine([(r["p"], r["c"]) for r in found.collect()])


# --- roots --------------------------------------------------------------------------------------------------------


def _trim(poly: list[int]) -> list[int]:
    poly = list(poly)
    while poly and poly[-1] == 0:
        poly.pop()
    content = math.gcd(*poly) if poly else 1
    return [c // content for c in poly]


def _gcd_degree(a: list[int], b: list[int], p: int) -> int:
    a, b = [c % p for c in a], [c % p for c in b]
    while True:
        while b and b[-1] == 0:
            b.pop()
        if not b:
            return len(a) - 1
        inverse = pow(b[-1], -1, p)
        while len(a) >= len(b):
            f, shift = a[-1] * inverse % p, len(a) - len(b)
            for i, c in enumerate(b):
                a[i + shift] = (a[i + shift] - f * c) % p
            a.pop()
        a, b = b, a


def _remainder(a: list[int], b: list[int]) -> list[int]:
    a = list(a)
    while len(a) >= len(b):
        lead, shift = a[-1], len(a) - len(b)
        a = [c * b[-1] for c in a]
        for i, c in enumerate(b):
            a[i + shift] -= lead * c
        a.pop()
    return _trim(a)


def _quotient(a: list[int], b: list[int]) -> list[int]:
    a, out = [Fraction(c) for c in a], []
    while len(a) >= len(b):
        f, shift = a[-1] / b[-1], len(a) - len(b)
        for i, c in enumerate(b):
            a[i + shift] -= f * c
        out.append(f)
        a.pop()
    scale = math.lcm(*(c.denominator for c in out))
    return _trim([int(c * scale) for c in reversed(out)])


def square_free(poly: list[int]) -> list[int]:
    """``poly`` with each root once."""
    slope = [k * c for k, c in enumerate(poly)][1:]
    if any(_gcd_degree(poly, slope, p) == 0 for p in primes(90)):
        return poly
    a, b = _trim(poly), _trim(slope)
    while b:
        a, b = b, _remainder(a, b)
    return _quotient(poly, a)


def roots_above(poly: list[int], x: int, bits: int) -> int:
    """How many roots exceed x / 2**bits, each as often as it occurs; exact as all roots are real."""
    top = len(poly) - 1
    row = [c << bits * (top - k) for k, c in enumerate(poly)][::-1]
    shifted = []
    while row:
        row = list(accumulate(row, lambda carry, c: carry * x + c))
        shifted.append(row.pop())
    signs = [c > 0 for c in shifted if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(poly: list[int], x: int, bits: int) -> int:
    value, scale = 0, 0
    for c in reversed(poly):
        value, scale = value * x + (c << scale), scale + bits
    return (value > 0) - (value < 0)


def leading_roots(poly: list[int], k: int, guard: int = GUARD) -> list[tuple[Fraction, int, int]]:
    """(root, multiplicity, bits) of the largest positive roots, at least ``k`` counting multiplicities.

    A root is at most 2**-bits above its value, where bits leaves ``guard`` bits below the gap to its neighbours.
    """
    zeros = next(i for i, c in enumerate(poly) if c)
    poly = poly[zeros:]
    if len(poly) < 2:
        return []
    simple = square_free(poly)
    bound = abs(poly[-2]).bit_length() + 1  # the roots sum to the trace
    whole, found = roots_above(simple, 0, 0), []
    # (low, high] / 2**bits with the numbers of roots above both ends, the rightmost on top of the stack
    stack = [(0, 1 << bound, 0, whole, 0)]
    enough = 0
    while stack and enough <= k:
        low, high, bits, above_low, above_high = stack.pop()
        if above_low == above_high:
            continue
        if above_low - above_high == 1:
            found.append((low, high, bits))
            enough += roots_above(poly, low, bits) - roots_above(poly, high, bits)
            continue
        if high - low == 1:
            low, high, bits = 2 * low, 2 * high, bits + 1
        middle = (low + high) // 2
        above = roots_above(simple, middle, bits)
        stack += [(low, middle, bits, above_low, above), (middle, high, bits, above, above_high)]

    def narrow(low: int, high: int, bits: int, to: int) -> tuple[int, int, int]:
        right = _sign(simple, high, bits)
        while right and (bits < to or high - low > 1):
            if high - low == 1:
                low, high, bits = 2 * low, 2 * high, bits + 1
            middle = (low + high) // 2
            at = _sign(simple, middle, bits)
            if at == 0:
                return middle, middle, bits
            low, high = (low, middle) if at == right else (middle, high)
        return (low, high, bits) if right else (high, high, bits)

    # neighbours are told apart by bits relative to the largest root
    out, edges = [], []
    for low, high, bits in found:
        count = roots_above(poly, low, bits) - roots_above(poly, high, bits)
        low, high, bits = narrow(low, high, bits, max(0, 40 - bound))
        edges.append([Fraction(low, 1 << bits), Fraction(high, 1 << bits), low, high, bits, count])
    rest = Fraction(0) if len(found) == whole else edges[-1][0] / 2
    for i, (a, b, low, high, bits, count) in enumerate(edges):
        below = edges[i + 1][1] if i + 1 < len(edges) else rest
        above = edges[i - 1][0] - b if i else edges[0][1]
        while min(above, a - below) <= 0:  # touching intervals: narrow all of them further
            edges[i][2:5] = low, high, bits = narrow(low, high, bits, bits + 40)
            edges[i][:2] = a, b = Fraction(low, 1 << bits), Fraction(high, 1 << bits)
            for j in (i - 1, i + 1):
                if 0 <= j < len(edges):
                    edges[j][2:5] = narrow(*edges[j][2:5], edges[j][4] + 40)
                    edges[j][0], edges[j][1] = (Fraction(edges[j][h], 1 << edges[j][4]) for h in (2, 3))
            below = edges[i + 1][1] if i + 1 < len(edges) else (rest if rest < a else a / 2)
            above = edges[i - 1][0] - b if i else edges[0][1]
        need = guard + max(0, -_exponent(min(above, a - below)))
        low, high, bits = narrow(low, high, bits, need)
        out.append((Fraction(low, 1 << bits), count, need + bound))
    return out


def _exponent(x: Fraction) -> int:
    return x.numerator.bit_length() - x.denominator.bit_length() - 1


# --- null vectors -------------------------------------------------------------------------------------------------


def null_vectors(matrix: np.ndarray, root: Fraction, count: int, bits: int) -> np.ndarray:
    """``count`` orthonormal vectors that ``matrix - root`` takes to nothing, as rows of doubles.

    Elimination with row exchange in integers scaled by 2**bits, then inverse iteration on hashed starts.
    """
    dims = len(matrix)
    one = 1 << bits
    size = max(int(np.abs(matrix).max()), 1).bit_length()
    a = np.array([[(int(v) << bits) >> size for v in row] for row in matrix], object)
    shift = (root.numerator << bits) // (root.denominator << size)
    a[np.diag_indices(dims)] -= shift
    moves = []
    for k in range(dims):
        i = k + max(range(dims - k), key=lambda r: abs(a[k + r, k]))
        if i != k:
            a[[k, i]] = a[[i, k]]
        moves.append(i)
        a[k, k] = a[k, k] or 1
        if k + 1 < dims:
            f = (a[k + 1 :, k] << bits) // a[k, k]
            a[k + 1 :, k + 1 :] -= (f[:, None] * a[k, k + 1 :][None, :]) >> bits
            a[k + 1 :, k] = f

    def solve(b: np.ndarray) -> np.ndarray:
        b = b.copy()
        for k, i in enumerate(moves):
            b[[k, i]] = b[[i, k]]
            b[k + 1 :] -= (a[k + 1 :, k] * b[k]) >> bits
        for k in range(dims - 1, -1, -1):
            b[k] = (b[k] << bits) // a[k, k]
            b[:k] -= (a[:k, k] * b[k]) >> bits
        return b

    def unit(v: np.ndarray) -> np.ndarray:
        length = math.isqrt(int((v * v).sum()))
        return (v << bits) // length

    found: list[np.ndarray] = []
    seed = 0
    while len(found) < count:
        seed += 1
        v = np.array([(pow(seed * 7919 + 104729 * (i + 1), 5, 2_147_483_647) - (1 << 30)) << (bits - 31) for i in range(dims)], object)
        for _ in range(2):
            for u in found:
                v = v - ((u * (((u * v).sum()) >> bits)) >> bits)
            v = unit(solve(v))
        for _ in range(2):
            for u in found:
                v = v - ((u * (((u * v).sum()) >> bits)) >> bits)
        if (v * v).sum() << 8 < one * one:  # the start lay almost within those found
            continue
        found.append(unit(v))
    out = np.array([[float(Fraction(int(x), one)) for x in v] for v in found])
    return out * np.sign(out[np.arange(count), np.abs(out).argmax(axis=1)])[:, None]


def components(spark: SparkSession, matrix: np.ndarray, k: int) -> tuple[list[Fraction], np.ndarray]:
    """The ``k`` largest roots of ``matrix`` (zeros where there are no more) and unit vectors of the positive ones."""
    roots = leading_roots(characteristic(spark, matrix), k)
    plan = [(i, count, bits) for i, (_, count, bits) in enumerate(roots)]
    values = [r for r, _, _ in roots]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, count, bits in frame.itertuples(index=False):
                found = null_vectors(matrix, values[i], int(count), int(bits))
                yield pd.DataFrame({"i": [i] * len(found), "j": range(len(found)), "v": found.tolist()})

    if not plan:
        return [Fraction(0)] * k, np.zeros((0, len(matrix)))
    tasks = min(len(plan), spark.sparkContext.defaultParallelism)
    found = spark.createDataFrame(plan, "i int, count int, bits int").repartitionByRange(tasks, "i").mapInPandas(run, "i int, j int, v array<double>")
    rows = sorted((r["i"], r["j"], r["v"]) for r in found.collect())[:k]
    roots_out = [values[i] for i, _, _ in rows]
    return roots_out + [Fraction(0)] * (k - len(rows)), np.array([v for _, _, v in rows])


# --- whitening ----------------------------------------------------------------------------------------------------


def _centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * rows - sums, exact."""
    if n * vec.largest(rows) + max(map(abs, sums), default=0) < 1 << 62:
        return rows * n - np.array(sums, np.int64)
    return rows.astype(object) * n - np.array(sums, object)


def _projector(fit: Fit) -> np.ndarray:
    """Columns that take n * rows - sums to whitened values."""
    sizes = np.array([math.sqrt(r) for r in fit.roots[: len(fit.vectors)]])  # sqrt(e) * n, as root = e * n * n
    return fit.vectors.T / sizes


def _identity_error(distinct: DataFrame, fit: Fit) -> float | None:
    k, dims, n, sums = len(fit.vectors), fit.dims, fit.n, fit.sums
    if not k:
        return None
    through = _projector(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            w = _centred(vec.unpack(batch["key"], dims), n, sums).astype(np.float64) @ through
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), pa.array(total.ravel())], ["slot", "part"])

    parts = distinct.mapInArrow(run, "slot bigint, part double").groupBy("slot").agg((F.sum("part") / n).alias("c"))
    gap = F.abs(F.col("c") - F.when(F.col("slot") % (k + 1) == 0, 1.0).otherwise(0.0))
    return parts.agg(F.max(gap).alias("e")).first()["e"]


def fit(df: DataFrame, vector_col: str = "embedding", k: int = COMPONENTS, scale: int = SCALE) -> Fit:
    """Exact sums of the different vectors and the ``k`` leading components."""
    spark, dims = df.sparkSession, vec.width(df, vector_col)
    distinct = cut_lineage(_distinct(df, vector_col, dims, scale))
    n, sums, products = _totals(distinct, dims)
    if not n or not dims:
        return Fit(n, dims, [], 0, [], np.zeros((0, dims)))
    scatter = n * products - sums[:, None] * sums[None, :]
    roots, vectors = components(spark, scatter, min(k, dims))
    found = Fit(n, dims, [int(s) for s in sums], int(np.trace(scatter)), roots, vectors)
    found.error = _identity_error(distinct, found)
    return found


def transform(df: DataFrame, found: Fit, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """A row for each usable vector and component, with its whitened value."""
    n, dims, sums, error = found.n, found.dims, found.sums, found.error
    through, k = _projector(found), len(found.roots)
    explained = [float(r / found.trace) if found.trace else None for r in found.roots]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = vec.scaled(batch["v"], scale, dims)
            if not len(at) or not k:
                continue
            centred = _centred(rows, n, sums)
            if vec.largest(centred) ** 2 * dims < 1 << 63:
                deviation = pa.array((centred.astype(np.int64) ** 2).sum(axis=1))
            else:
                whole = (centred.astype(object) ** 2).sum(axis=1).tolist()
                deviation = pa.array([v if v < 1 << 63 else None for v in whole], pa.int64())
            w = np.full((len(at), k), np.nan)
            w[:, : through.shape[1]] = centred.astype(np.float64) @ through
            missing = np.zeros((len(at), k), bool)
            missing[:, through.shape[1] :] = True
            times = np.repeat(np.arange(len(at)), k)
            size = len(times)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["id"].take(pa.array(at)).take(pa.array(times)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(size, n, np.int64)),
                    deviation.take(pa.array(times)),
                    pa.array(w.ravel(), mask=missing.ravel()),
                    pa.array(explained * len(at), pa.float64()),
                    pa.array([error] * size, pa.float64()),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = df.select(F.col(id_col).cast("bigint").alias("id"), vec.as_doubles(vector_col).alias("v"))
    return rows.mapInArrow(run, schema)


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    return transform(df, fit(df, vector_col, k, scale), id_col, vector_col, scale)
