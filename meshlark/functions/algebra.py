"""Complex numbers, small matrices, tensors, four-vectors and spinors as column expressions of built-in functions.

A matrix is an array of 2 n^2 doubles, row by row, real and imaginary parts in turn; a vector of n complex numbers is 2 n
doubles. Sizes are given, so every expression is written out and compiled with the rest of the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Complex = tuple[Column, Column]


def _at(m: Column, k: int) -> Complex:
    return F.get(m, F.lit(2 * k)), F.get(m, F.lit(2 * k + 1))


def _times(a: Complex, b: Complex) -> Complex:
    return a[0] * b[0] - a[1] * b[1], a[0] * b[1] + a[1] * b[0]


def _sum(terms: list[Complex]) -> Complex:
    return reduce(lambda a, b: (a[0] + b[0], a[1] + b[1]), terms)


def _conj(a: Complex) -> Complex:
    return a[0], -a[1]


def _array(entries: list[Complex]) -> Column:
    return F.array(*(x for e in entries for x in e))


def magnitude_squared(re: Column, im: Column) -> Column:
    return re * re + im * im


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(magnitude_squared(re, im))


def argument(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def multiplied(a: Column, b: Column, n: int) -> Column:
    """The product of two n x n matrices."""
    return _array([_sum([_times(_at(a, i * n + k), _at(b, k * n + j)) for k in range(n)]) for i in range(n) for j in range(n)])


def transposed(m: Column, n: int) -> Column:
    return _array([_at(m, j * n + i) for i in range(n) for j in range(n)])


def conjugated(m: Column) -> Column:
    return F.transform(m, lambda x, k: F.when(k % 2 == 1, -x).otherwise(x))


def adjoint(m: Column, n: int) -> Column:
    """The conjugate transpose; for a unitary matrix its inverse."""
    return _array([_conj(_at(m, j * n + i)) for i in range(n) for j in range(n)])


def subtracted(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def frobenius(m: Column) -> Column:
    return F.sqrt(F.aggregate(m, F.lit(0.0), lambda s, x: s + x * x))


def determinant(m: Column, n: int) -> Column:
    """Struct (re, im) of the determinant of a 1 x 1, 2 x 2 or 3 x 3 matrix."""

    def minor(rows: list[int], columns: list[int]) -> Complex:
        if len(rows) == 1:
            return _at(m, rows[0] * n + columns[0])
        terms = []
        for k, c in enumerate(columns):
            re, im = _times(_at(m, rows[0] * n + c), minor(rows[1:], columns[:k] + columns[k + 1 :]))
            terms.append((re, im) if k % 2 == 0 else (-re, -im))
        return _sum(terms)

    re, im = minor(list(range(n)), list(range(n)))
    return F.struct(re.alias("re"), im.alias("im"))


def acted(u: Column, v: Column, n: int) -> Column:
    """u v for a vector v of n complex numbers."""
    return _array([_sum([_times(_at(u, i * n + k), _at(v, k)) for k in range(n)]) for i in range(n)])


def acted_back(u: Column, v: Column, n: int) -> Column:
    """The adjoint of u, applied to v."""
    return _array([_sum([_times(_conj(_at(u, k * n + i)), _at(v, k)) for k in range(n)]) for i in range(n)])


def is_unitary(u: Column, n: int, tolerance: float = 1e-9) -> Column:
    """Whether no entry of U U+ differs from the identity's by more than the tolerance."""
    out = F.lit(True)
    for i in range(n):
        for j in range(n):
            re, im = _sum([_times(_at(u, i * n + k), _conj(_at(u, j * n + k))) for k in range(n)])
            out = out & (F.abs(re - float(i == j)) <= tolerance) & (F.abs(im) <= tolerance)
    return out


def has_unit_determinant(u: Column, n: int, tolerance: float = 1e-9) -> Column:
    d = determinant(u, n)
    return (F.abs(d["re"] - 1.0) <= tolerance) & (F.abs(d["im"]) <= tolerance)


def u1_link(theta: Column) -> Column:
    return F.array(F.cos(theta), F.sin(theta))


def u1_angle(u: Column) -> Column:
    return argument(*_at(u, 0))


def su2_from_quaternion(a: Column, b: Column, c: Column, d: Column) -> Column:
    """a + i (b s1 + c s2 + d s3) with the Pauli matrices s1, s2, s3."""
    return F.array(a, d, b, c, -b, c, a, -d)


def su2_from_angle(theta: Column) -> Column:
    """exp(i theta s3)."""
    zero = F.lit(0.0)
    return su2_from_quaternion(F.cos(theta), zero, zero, F.sin(theta))


def su2_angle(u: Column) -> Column:
    """The angle t of exp(i t n.s), between 0 and pi, from half the trace."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.get(u, F.lit(0)) + F.get(u, F.lit(6))) / 2)))


def su2_algebra(u: Column) -> Column:
    """The three components of the Hermitian t n.s with U = exp(i t n.s): the extraction that exp undoes."""
    t = su2_angle(u)
    scale = F.when(F.sin(t) > 1e-12, t / F.sin(t)).otherwise(1.0)
    b, c = (F.get(u, F.lit(2)) - F.get(u, F.lit(4))) / 2, (F.get(u, F.lit(3)) + F.get(u, F.lit(5))) / 2
    return F.array(scale * b, scale * c, scale * (F.get(u, F.lit(1)) - F.get(u, F.lit(7))) / 2)


def tensor_zero(shape: tuple[int, ...]) -> Column:
    n = reduce(lambda a, b: a * b, shape, 1)
    return F.array_repeat(F.lit(0.0), n)


def tensor_added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def tensor_entry(t: Column, shape: tuple[int, ...], *index: Column) -> Column:
    """The entry at an index, the last dimension fastest; null outside of the shape."""
    at, inside = F.lit(0), F.lit(True)
    for n, i in zip(shape, index, strict=True):
        at, inside = at * n + i, inside & (i >= 0) & (i < n)
    return F.when(inside, F.get(t, at.cast("int")))


#: The metric of flat spacetime.
METRIC = (1.0, -1.0, -1.0, -1.0)


def lowered(v: Column) -> Column:
    """A four-vector (t, x, y, z) with its index lowered."""
    return F.array(*(F.get(v, F.lit(k)) * s for k, s in enumerate(METRIC)))


def minkowski_dot(a: Column, b: Column) -> Column:
    return sum((F.get(a, F.lit(k)) * F.get(b, F.lit(k)) * s for k, s in enumerate(METRIC)), F.lit(0.0))


def interval(v: Column) -> Column:
    """Positive for timelike, zero for lightlike, negative for spacelike four-vectors."""
    return minkowski_dot(v, v)


def spin(psi: Column, component: int) -> Column:
    """The expectation of twice the spin along axis 1, 2 or 3 of a spinor of four complex numbers, not divided by its norm."""
    pairs = [(0, 1), (2, 3)]
    if component == 3:
        return sum((magnitude_squared(*_at(psi, a)) - magnitude_squared(*_at(psi, b)) for a, b in pairs), F.lit(0.0))
    return sum((2.0 * _times(_conj(_at(psi, a)), _at(psi, b))[component - 1] for a, b in pairs), F.lit(0.0))


def scalar_density(psi: Column) -> Column:
    """The Dirac adjoint of psi times psi: upper components less lower ones."""
    return sum((magnitude_squared(*_at(psi, k)) * (1.0 if k < 2 else -1.0) for k in range(4)), F.lit(0.0))
