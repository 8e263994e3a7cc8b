"""Whitening of embedding vectors by an exact characteristic polynomial.

Entries are made whole numbers, x = floor(scale * c), so the scatter matrix n * sum(x x') - S S' (n squared times the covariance) is exact.
Its characteristic polynomial is found modulo many primes by reduction to Hessenberg form, primes dealt over tasks, and put together by the Chinese
remainder theorem. All roots are real, so the number of sign changes after a shift counts the roots beyond it: the largest roots are isolated by bisection and
narrowed far below the distance to their neighbours. Each gives its components as the null space of scatter - root: inverse iteration in fixed-point
numbers with as many bits as that distance calls for. A root of multiplicity m gives m orthogonal components.

Spark does all work that grows with rows: sums of products are exact in blocks in each task and added by key; rows are whitened and checked where they
lie. The driver holds numbers of dimensions only: d * (d + 1) / 2 sums and d + 1 residues for each of about d * log2(trace) / 31 primes.

Defined results: vectors that are null, empty, or hold a null, a NaN, an infinity or an entry whose whole number needs more than 61 bits have no row. If vectors
differ in length, those of the commonest length remain (the longer one if equally common). Components belong to eigenvalues above zero; if all vectors are equal, or
there are none, there are no components. A deviation beyond a long is null. Equal rows give equal rows; other columns stay, but
`deviation` and `whitened` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows multiplied at once, and bits of a limb: 2 * 20 bits and 4,096 rows make at most 52 bits, which doubles hold exactly.
BLOCK_ROWS, LIMB_BITS = 4096, 20
#: Matrix entries that one task reduces at once, over all its primes.
BLOCK_ENTRIES = 1 << 17
#: Bits to which a root and its components are known beyond what their neighbours call for.
GUARD_BITS = 96
SPLIT = 10**18


@dataclass
class Whitening:
    """Sums are of whole entries; components are rows of unit length, by falling eigenvalue."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray


# --- rows


def usable(vectors: DataFrame, vector_col: str, scale: int = 64) -> DataFrame:
    """Rows whose vector has a defined whole form; the vector as array of double."""
    limit = float(1 << 61) / scale
    entry_ok = F.forall(vector_col, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < limit) & ~F.isnan(c.cast("double")))
    return vectors.where(F.coalesce(entry_ok & (F.size(vector_col) > 0), F.lit(False))).withColumn(vector_col, F.col(vector_col).cast("array<double>"))


def _whole(column: pa.Array, dims: int, scale: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * scale).astype(np.int64).reshape(-1, dims)


def exact_products(x: np.ndarray) -> np.ndarray:
    """x' x as Python integers, by products of limbs that doubles hold exactly."""
    limbs, rest = [], x
    while len(limbs) == 0 or (rest != 0).any():
        if (rest == -1).all() or ((rest >= -(1 << LIMB_BITS)) & (rest < (1 << LIMB_BITS))).all():
            limbs.append(rest.astype(np.float64))
            break
        limbs.append((rest & ((1 << LIMB_BITS) - 1)).astype(np.float64))
        rest = rest >> LIMB_BITS
    total = np.zeros((x.shape[1], x.shape[1]), dtype=object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            total += (a.T @ b).astype(np.int64).astype(object) << (LIMB_BITS * (i + j))
    return total


def scatter_sums(rows: DataFrame, vector_col: str, dims: int, scale: int) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, sums of products), exact. Each task sends d * (d + 3) / 2 + 1 numbers, added by key."""
    upper = [(i, j) for i in range(dims) for j in range(i, dims)]
    cells = [(-1, -1), *((-1, j) for j in range(dims)), *upper]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(dims, dtype=object), np.zeros((dims, dims), dtype=object)
        for batch in batches:
            x = _whole(batch.column(0), dims, scale)
            n += len(x)
            for k in range(0, len(x), BLOCK_ROWS):
                block = x[k : k + BLOCK_ROWS]
                sums += block.astype(object).sum(0)
                products += exact_products(block)
        if n:
            values = [n, *sums, *(products[i, j] for i, j in upper)]
            parts = [divmod(int(v), SPLIT) for v in values]
            columns = [pa.array([c[k] for c in cells], pa.int32()) for k in (0, 1)]
            columns += [pa.array([Decimal(p[k]) for p in parts], pa.decimal128(38, 0)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "high", "low"])

    partial = rows.select(vector_col).mapInArrow(work, "i int, j int, high decimal(38,0), low decimal(38,0)")
    total = {(r.i, r.j): int(r.high) * SPLIT + int(r.low) for r in partial.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()}
    products = np.zeros((dims, dims), dtype=object)
    for i, j in upper:
        products[i, j] = products[j, i] = total.get((i, j), 0)
    return total.get((-1, -1), 0), [total.get((-1, j), 0) for j in range(dims)], products


# --- characteristic polynomial


def primes_below(limit: int, count: int) -> list[int]:
    """The largest primes below limit (at most 2**31), by a Miller-Rabin test that is exact there."""

    def is_prime(n: int) -> bool:
        if n < 11 or n % 2 == 0:
            return n in (2, 3, 5, 7)
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):
            y = pow(base, odd, n)
            if y not in (1, n - 1) and not any((y := y * y % n) == n - 1 for _ in range(twos - 1)):
                return False
        return True

    found, n = [], limit - 1
    while len(found) < count:
        if is_prime(n):
            found.append(n)
        n -= 1
    return found


def polynomials_modulo(matrix: np.ndarray, primes: list[int]) -> np.ndarray:
    """Coefficients of det(x - matrix), lowest first, one row a prime."""
    d, count = len(matrix), len(primes)
    p = np.array(primes, dtype=np.int64)
    h = np.array([[[int(v) % q for v in row] for row in matrix] for q in primes], dtype=np.int64).reshape(count, d, d)
    each, p2, p3 = np.arange(count), p[:, None], p[:, None, None]
    for k in range(d - 2):
        pivot = k + 1 + np.argmax(h[:, k + 1 :, k] != 0, axis=1)
        rows = h[each, pivot].copy()
        h[each, pivot] = h[:, k + 1]
        h[:, k + 1] = rows
        columns = h[each, :, pivot].copy()
        h[each, :, pivot] = h[:, :, k + 1]
        h[:, :, k + 1] = columns
        inverse = np.array([pow(int(v), -1, q) if v else 0 for v, q in zip(h[:, k + 1, k], primes)], dtype=np.int64)
        factor = h[:, k + 2 :, k] * inverse[:, None] % p2
        h[:, k + 2 :] = (h[:, k + 2 :] - factor[:, :, None] * h[:, None, k + 1] % p3) % p3
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * factor[:, None, :] % p3).sum(2)) % p2
    found = np.zeros((count, d + 1, d + 1), dtype=np.int64)
    found[:, 0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros((count, d + 1), dtype=np.int64)
        new[:, 1:] = found[:, k - 1, :-1]
        new -= h[:, k - 1, k - 1][:, None] * found[:, k - 1] % p2
        path = np.ones(count, dtype=np.int64)
        for i in range(k - 1, 0, -1):
            path = path * h[:, i, i - 1] % p
            new -= (h[:, i - 1, k - 1] * path % p)[:, None] * found[:, i - 1] % p2
        found[:, k] = new % p2
    return found[:, d]


def characteristic_polynomial(spark, matrix: np.ndarray) -> list[int]:
    """Exact coefficients of det(x - matrix), lowest first, for a symmetric matrix without eigenvalues below zero."""
    d, trace = len(matrix), int(sum(matrix[i, i] for i in range(len(matrix))))
    mean = Fraction(trace, d)
    # Sums of products of k eigenvalues are largest if all are equal.
    bound = max(math.ceil(math.comb(d, k) * mean**k) for k in range(d + 1))
    primes = primes_below(1 << 31, (2 * bound).bit_length() // 30 + 2)
    at_once = max(1, BLOCK_ENTRIES // (d * d))
    blocks = -(-len(primes) // at_once)
    values = matrix.tolist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                mine = primes[number * at_once : (number + 1) * at_once]
                rows = polynomials_modulo(np.array(values, dtype=object), mine)
                yield pa.RecordBatch.from_arrays([pa.array(mine, pa.int64()), pa.array(rows.tolist(), pa.list_(pa.int64()))], ["prime", "residues"])

    whole, modulus = [0] * (d + 1), 1
    for r in spark.range(0, blocks, 1, blocks).mapInArrow(work, "prime long, residues array<long>").collect():
        inverse = pow(modulus, -1, r.prime)
        whole = [w + modulus * ((int(v) - w) * inverse % r.prime) for w, v in zip(whole, r.residues)]
        modulus *= r.prime
    return [w - modulus if 2 * w > modulus else w for w in whole]


# --- roots


def _remainder(a: list[int], b: list[int]) -> list[int]:
    """Pseudo-remainder of integer polynomials, lowest coefficient first, without common factors."""
    a = list(a)
    while len(a) >= len(b):
        lead = a[-1]
        a = [v * b[-1] for v in a]
        shift = len(a) - len(b)
        for k, v in enumerate(b):
            a[shift + k] -= lead * v
        while a and a[-1] == 0:
            a.pop()
    common = math.gcd(*a) if a else 1
    return [v // common for v in a]


def _divide(a: list[int], b: list[int]) -> list[int]:
    """Quotient of an exact division."""
    a, out = [Fraction(v) for v in a], []
    while len(a) >= len(b):
        q = a[-1] / b[-1]
        out.append(q)
        shift = len(a) - len(b)
        for k, v in enumerate(b):
            a[shift + k] -= q * v
        a.pop()
    factor = math.lcm(*(q.denominator for q in out))
    whole = [int(q * factor) for q in reversed(out)]
    common = math.gcd(*whole) * (1 if whole[-1] > 0 else -1)
    return [v // common for v in whole]


def _coprime_modulo(a: list[int], b: list[int], p: int) -> bool:
    a, b = ([v % p for v in x] for x in (a, b))
    while b and b[-1] == 0:
        b.pop()
    while b:
        inverse = pow(b[-1], -1, p)
        while len(a) >= len(b):
            q, shift = a[-1] * inverse % p, len(a) - len(b)
            for k, v in enumerate(b):
                a[shift + k] = (a[shift + k] - q * v) % p
            while a and a[-1] == 0:
                a.pop()
        a, b = b, a
    return len(a) == 1


def square_free(poly: list[int]) -> list[int]:
    """The polynomial with each root once."""
    slope = [k * v for k, v in enumerate(poly)][1:]
    if len(poly) < 3 or any(poly[-1] % p and _coprime_modulo(poly, slope, p) for p in primes_below(1 << 31, 3)):
        return poly
    a, b = poly, slope
    while b:
        a, b = b, _remainder(a, b)
    return _divide(poly, a)


def roots_beyond(poly: list[int], at: int, shift: int) -> int:
    """How many real roots exceed at / 2**shift, with multiplicity, of a polynomial all of whose roots are real."""
    top = len(poly) - 1
    c = [v << (shift * (top - k)) for k, v in enumerate(poly)]
    for i in range(top):
        for k in range(top - 1, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def sign_at(poly: list[int], at: int, shift: int) -> int:
    value = 0
    for k, v in enumerate(reversed(poly)):
        value = value * at + (v << (shift * k))
    return (value > 0) - (value < 0)


def largest_roots(poly: list[int], count: int, upper: int) -> list[tuple[int, int, int, int]]:
    """The largest roots, (at, shift, multiplicity, bits) from the largest on: root = at / 2**shift but for less than 2**-shift; bits say
    how far it was narrowed below the distance to its neighbours.

    All roots must be above zero and at most upper. Roots are taken until their multiplicities reach count.
    """
    simple = square_free(poly)
    todo, alone = [(0, upper, 0, roots_beyond(simple, 0, 0), 0)], []  # (low, high] / 2**shift, roots beyond low and beyond high
    while todo and len(alone) <= count:
        low, high, shift, beyond_low, beyond_high = todo.pop()
        if beyond_low - beyond_high == 0:
            continue
        if beyond_low - beyond_high == 1:
            alone.append((low, high, shift))
            continue
        if high - low == 1:
            low, high, shift = 2 * low, 2 * high, shift + 1
        middle = (low + high) // 2
        inner = roots_beyond(simple, middle, shift)
        todo += [(low, middle, shift, beyond_low, inner), (middle, high, shift, inner, beyond_high)]

    def narrow(low: int, high: int, shift: int, until: int) -> tuple[int, int, int]:
        """Halves until the interval is one unit wide and the shift is at least until."""
        if sign_at(simple, high, shift) == 0:
            up = max(until - shift, 0)
            return (high << up) - 1, high << up, shift + up
        below = sign_at(simple, low, shift)
        if not below:  # the root before this one lies on the border: just above it the sign is that of the slope
            below = -sign_at(simple, high, shift)
        while high - low > 1 or shift < until:
            if high - low == 1:
                low, high, shift = 2 * low, 2 * high, shift + 1
            middle = (low + high) // 2
            found = sign_at(simple, middle, shift)
            if found == 0:
                up = max(until - shift, 0)
                return (middle << up) - 1, middle << up, shift + up
            low, high = (middle, high) if found == below else (low, middle)
        return low, high, shift

    found, got = [], 0
    edges = [narrow(*a, until=0) for a in alone]
    for k, interval in enumerate(edges):
        # Narrow this root and its neighbours until they are far apart in units of the width.
        shift = interval[2]
        while True:
            near = [narrow(*edges[m], until=shift) for m in (k - 1, k, k + 1) if 0 <= m < len(edges)]
            own = near[1] if k else near[0]
            unit = max(a[2] for a in near)
            gaps = [abs((a[1] << (unit - a[2])) - (own[1] << (unit - own[2]))) for a in near if a is not own]
            distance = min(gaps, default=own[1])
            if distance > 16:
                break
            shift += 8
        bits = max((own[1] << (unit - own[2])).bit_length() - distance.bit_length(), 0) + 2 * GUARD_BITS
        low, high, shift = narrow(*own, until=max(own[2], bits - (own[1] >> own[2]).bit_length()))
        multiplicity = 1 if simple is poly else roots_beyond(poly, low, shift) - roots_beyond(poly, high, shift)
        found.append((high, shift, multiplicity, bits))
        got += multiplicity
        if got >= count:
            break
    return found


# --- components


def null_space(matrix: np.ndarray, at: int, shift: int, wanted: int, bits: int) -> np.ndarray:
    """Unit vectors (rows, doubles) that span the null space of matrix - at / 2**shift, by inverse iteration in fixed point."""
    d, size = len(matrix), max(int(sum(matrix[i, i] for i in range(len(matrix)))).bit_length(), 1)
    point = bits + 2 * d.bit_length() + GUARD_BITS

    def fixed(value: int, binary: int) -> int:
        """value / 2**binary / 2**size in units of 2**-point."""
        up = point - size - binary
        return value << up if up >= 0 else value >> -up

    a = np.array([[fixed(int(v), 0) for v in row] for row in matrix], dtype=object)
    for i in range(d):
        a[i, i] -= fixed(at, shift)
    order = list(range(d))
    for k in range(d):
        best = max(range(k, d), key=lambda r: abs(a[r, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
            order[k], order[best] = order[best], order[k]
        if a[k, k] == 0:
            a[k, k] = 1
        if k + 1 < d:
            factors = (a[k + 1 :, k] << point) // a[k, k]
            a[k + 1 :, k + 1 :] -= (factors[:, None] * a[None, k, k + 1 :]) >> point
            a[k + 1 :, k] = factors

    def solve(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for k in range(1, d):
            x[k] -= int((a[k, :k] * x[:k]).sum()) >> point
        for k in range(d - 1, -1, -1):
            rest = int((a[k, k + 1 :] * x[k + 1 :]).sum()) >> point if k + 1 < d else 0
            x[k] = ((x[k] - rest) << point) // a[k, k]
        return x

    def unit(x: np.ndarray) -> np.ndarray:
        norm = math.isqrt(int((x * x).sum()))
        return (x << point) // norm

    rng, basis = np.random.default_rng(d), []
    while len(basis) < wanted:
        x = np.array([int(v) << (point - 20) for v in rng.integers(1, 1 << 20, d)], dtype=object)
        for _ in range(3):
            x = unit(solve(x))
            for b in basis:
                x = x - ((b * (int((b * x).sum()) >> point)) >> point)
            x = unit(x)
        basis.append(x)
    return np.array([[int(v) / (1 << point) for v in x] for x in basis])


def learn(vectors: DataFrame, vector_col: str = "embedding", components: int = 32, scale: int = 64) -> Whitening:
    """Components of the usable rows of vectors."""
    rows = usable(vectors, vector_col, scale)
    size = F.size(vector_col)
    commonest = rows.groupBy(size.alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    if commonest is None:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), np.zeros(0))
    dims = commonest.dims
    n, sums, products = scatter_sums(rows.where(size == dims), vector_col, dims, scale)
    scatter = n * products - np.outer(np.array(sums, dtype=object), np.array(sums, dtype=object))
    common = math.gcd(*(int(v) for v in scatter.ravel())) or 1
    scatter = scatter // common
    trace = int(sum(scatter[i, i] for i in range(dims)))
    if not trace:
        return Whitening(n, sums, np.zeros((0, dims)), np.zeros(0), np.zeros(0))
    poly = characteristic_polynomial(vectors.sparkSession, scatter)
    while poly[0] == 0:
        poly = poly[1:]  # eigenvalues of zero give no component
    axes, eigenvalues, explained = [], [], []
    for at, shift, multiplicity, bits in largest_roots(poly, min(components, len(poly) - 1), trace):
        some = min(multiplicity, components - len(eigenvalues))
        axes.append(null_space(scatter, at, shift, some, bits))
        eigenvalues += [float(Fraction(at * common, n * n << shift))] * some
        explained += [float(Fraction(at, trace << shift))] * some
    return Whitening(n, sums, np.concatenate(axes), np.array(eigenvalues), np.array(explained))


def transform(vectors: DataFrame, model: Whitening, vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """The usable rows, with deviation (sum over dimensions of (n x - S) squared, exact) and whitened (array of double)."""
    n, sums, dims = model.n, model.sums, len(model.sums)
    kept = [c for c in vectors.columns if c not in ("deviation", "whitened")]
    rows = usable(vectors.select(*[F.col(f"`{c}`") for c in kept]), vector_col, scale).where(F.size(vector_col) == dims)
    place = kept.index(vector_col)
    centre = [round(Fraction(s, n)) for s in sums] if n else []
    rest = np.array([float(Fraction(s, n) - c) for s, c in zip(sums, centre)])
    axes = (model.components / np.sqrt(model.eigenvalues)[:, None]).T if len(model.components) else np.zeros((dims, 0))
    out = T.StructType([*rows.schema.fields, T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType(), False), False)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _whole(batch.column(place), dims, scale)
            reach = n * max(int(x.max()), -int(x.min()), 1) + max(abs(s) for s in sums)
            if reach * reach * dims < 1 << 63:
                deviation = ((n * x - np.array(sums, dtype=np.int64)) ** 2).sum(1).tolist()
            else:
                exact = [int(v) for v in ((n * x.astype(object) - np.array(sums, dtype=object)) ** 2).sum(1)]
                deviation = [v if v < 1 << 63 else None for v in exact]
            white = ((x - np.array(centre, dtype=np.int64)).astype(np.float64) - rest) @ axes
            offsets = np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]
            arrays = [pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(white.ravel(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], out.names)

    return rows.mapInArrow(work, out)


def identity_error(whitened: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of column `whitened` minus the identity; sums of each task are added by key."""
    k = len(model.components)
    if not k:
        return 0.0

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            z = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
            total[:k] += z.T @ z
            total[k] += z.sum(0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(v.ravel()) for v in (i, j, total)], ["i", "j", "v"])

    sums = np.zeros((k + 1, k))
    for r in whitened.select("whitened").mapInArrow(work, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        sums[r.i, r.j] = r.v
    means = sums[k] / model.n
    return float(np.abs(sums[:k] / model.n - np.outer(means, means) - np.eye(k)).max())
