"""Small complex matrices in columns: arrays of 2 n^2 doubles, row by row, real and imaginary parts in turn.

Batches of rows are one numpy array, so a function costs one call for a batch and not for a row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def unpack(column: pd.Series) -> np.ndarray:
    """(rows, n, n) complex."""
    flat = np.stack(column.to_numpy()) if len(column) else np.empty((0, 2))
    z = flat.reshape(len(flat), -1, 2)
    z = z[..., 0] + 1j * z[..., 1]
    n = math.isqrt(z.shape[1])
    return z.reshape(-1, n, n)


def pack(m: np.ndarray) -> pd.Series:
    m = np.ascontiguousarray(m)
    return pd.Series(list(np.stack((m.real, m.imag), -1).reshape(len(m), -1)))


def adjoint(m: np.ndarray) -> np.ndarray:
    return m.conj().swapaxes(-1, -2)


def expm(a: np.ndarray) -> np.ndarray:
    """exp by scaling to a norm of 1/2, a Taylor series of 18 terms, and squaring."""
    norm = np.sqrt((np.abs(a) ** 2).sum((-1, -2)))
    k = int(np.clip(np.ceil(np.log2(max(norm.max(initial=0.0), 0.5) / 0.5)), 0, 60))
    x = a / 2.0**k
    out = np.broadcast_to(np.eye(a.shape[-1], dtype=complex), a.shape).copy()
    term = out.copy()
    for i in range(1, 19):
        term = term @ x / i
        out += term
    for _ in range(k):
        out = out @ out
    return out


def logm(u: np.ndarray) -> np.ndarray:
    """The principal logarithm of unitary matrices, by their eigenvectors."""
    w, v = np.linalg.eig(u)
    return (v * (1j * np.angle(w))[..., None, :]) @ np.linalg.inv(v)


def unitarize(m: np.ndarray) -> np.ndarray:
    """Gram-Schmidt on the columns; for n > 1 the first column's phase makes the determinant 1."""
    q = m.astype(complex).copy()
    n = q.shape[-1]
    for j in range(n):
        for i in range(j):
            q[..., :, j] -= (q[..., :, i].conj() * q[..., :, j]).sum(-1, keepdims=True) * q[..., :, i]
        q[..., :, j] /= np.sqrt((np.abs(q[..., :, j]) ** 2).sum(-1, keepdims=True))
    if n > 1:
        det = np.linalg.det(q)
        q[..., :, 0] *= (det.conj() / np.abs(det))[..., None]
    return q


def to_algebra(m: np.ndarray) -> np.ndarray:
    """The anti-Hermitian part, traceless for n > 1."""
    a = (m - adjoint(m)) / 2
    n = m.shape[-1]
    if n > 1:
        a = a - np.trace(a, axis1=-2, axis2=-1)[..., None, None] * np.eye(n) / n
    return a


def haar(rng: np.random.Generator, rows: int, n: int) -> np.ndarray:
    """Uniform unitary matrices, of determinant 1 for n > 1."""
    z = rng.normal(size=(rows, n, n)) + 1j * rng.normal(size=(rows, n, n))
    q, r = np.linalg.qr(z)
    d = np.diagonal(r, axis1=-2, axis2=-1)
    q = q * (d / np.abs(d))[..., None, :]
    return q / np.linalg.det(q)[..., None, None] ** (1 / n) if n > 1 else q


def near_identity(rng: np.random.Generator, rows: int, n: int, spread: float) -> np.ndarray:
    """exp of Gaussian algebra elements of that spread: unitary matrices, of determinant 1 for n > 1, about the identity."""
    return expm(spread * to_algebra(rng.normal(size=(rows, n, n)) + 1j * rng.normal(size=(rows, n, n))))


def _one(f):
    def run(a: pd.Series) -> pd.Series:
        return pack(f(unpack(a)))

    return F.pandas_udf(run, "array<double>")


def exp(m: Column) -> Column:
    return _one(expm)(m)


def half_link(u: Column) -> Column:
    """The square root of a link along the shortest path: unitarize((1 + U) / 2)."""
    return _one(lambda m: unitarize((np.eye(m.shape[-1]) + m) / 2))(u)


def unitarized(m: Column) -> Column:
    return _one(unitarize)(m)


def projected(m: Column) -> Column:
    return _one(to_algebra)(m)


def product(a: Column, b: Column) -> Column:
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pack(unpack(x) @ unpack(y))

    return F.pandas_udf(run, "array<double>")(a, b)


def adjoined(m: Column) -> Column:
    return _one(adjoint)(m)


def identity(n: int) -> Column:
    return F.array(*(F.lit(float(i % (n + 1) == 0 and not k)) for i in range(n * n) for k in range(2)))


def trace(m: Column, n: int) -> Column:
    """Struct of the trace's real and imaginary part; built-in functions only."""
    at = [2 * i * (n + 1) for i in range(n)]
    return F.struct(sum((F.get(m, F.lit(k)) for k in at), F.lit(0.0)).alias("re"), sum((F.get(m, F.lit(k + 1)) for k in at), F.lit(0.0)).alias("im"))


def norm_squared(m: Column) -> Column:
    return F.aggregate(m, F.lit(0.0), lambda s, x: s + x * x)


def added(a: Column, b: Column, scale: float | Column = 1.0) -> Column:
    """a + scale b, element by element."""
    return F.zip_with(a, b, lambda x, y: x + scale * y)


def scaled(a: Column, scale: float | Column) -> Column:
    return F.transform(a, lambda x: x * scale)


#: Pauli and Gell-Mann matrices.
PAULI = np.array([[[0, 1], [1, 0]], [[0, -1j], [1j, 0]], [[1, 0], [0, -1]]])


def gell_mann() -> np.ndarray:
    """The eight generators of SU(3), from pairs of rows and the two diagonal ones, in their usual order."""
    out = []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        for value in (1, -1j):
            m = np.zeros((3, 3), complex)
            m[i, j], m[j, i] = value, np.conj(value)
            out.append(m)
    out.insert(2, np.diag([1, -1, 0]).astype(complex))
    out.append(np.diag([1, 1, -2]) / math.sqrt(3) + 0j)
    return np.array(out)


def gammas() -> np.ndarray:
    """Gamma matrices 0 to 3 in the Dirac representation."""
    zero, one = np.zeros((2, 2)), np.eye(2)
    return np.array([np.block([[one, zero], [zero, -one]]).astype(complex), *(np.block([[zero, s], [-s, zero]]) for s in PAULI)])


def gamma5() -> np.ndarray:
    """i times the product of gamma matrices 0 to 3: it squares to one and anticommutes with each."""
    g = gammas()
    return 1j * g[0] @ g[1] @ g[2] @ g[3]
