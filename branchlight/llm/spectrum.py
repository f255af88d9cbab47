"""Eigenvalues and eigenvectors of a symmetric positive semidefinite matrix of integers, from its exact characteristic polynomial.

The polynomial is found modulo many primes of 31 bits, by reduction to Hessenberg form, and put together by Chinese
remaindering; the primes are dealt to tasks. All its roots are real, so the sign changes of its Taylor shift to a point count
the roots above the point exactly; bisection isolates them, and goes on to any precision. Multiplicities
come from square-free factors. A root's null space is found by inverse iteration in decimals of the precision that
its distance to the next root asks for; the roots are dealt to tasks as well.
"""

from __future__ import annotations

import decimal
import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Matrix cells that one pass of the reduction holds, over all its primes.
CELLS = 1 << 18


def primes() -> Iterator[int]:
    """The primes below 2**31, largest first."""
    for p in range((1 << 31) - 1, 2, -2):
        odd, twos = p - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        # Strong probable primes to these bases are primes below 3215031751.
        if all(pow(b, odd, p) in (1, p - 1) or any(pow(b, odd << i, p) == p - 1 for i in range(1, twos)) for b in (2, 3, 5, 7)):
            yield p


def _inverse(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """x ** (p - 2) modulo p; 0 for 0."""
    out, power, rest = np.ones_like(x), x.copy(), p - 2
    while rest.any():
        out = np.where(rest & 1 == 1, out * power % p, out)
        power = power * power % p
        rest = rest >> 1
    return out


def polynomials_modulo(matrix: list[list[int]], moduli: list[int]) -> np.ndarray:
    """Coefficients, lowest first, of det(x - matrix) modulo each of ``moduli``, primes below 2**31."""
    d, many = len(matrix), len(moduli)
    p = np.array(moduli, np.int64)
    a = np.array([[[x % m for x in row] for row in matrix] for m in moduli], np.int64).reshape(many, d, d)
    at, p1, p2 = np.arange(many), p[:, None], p[:, None, None]
    for k in range(d - 2):
        # Bring a row with a nonzero entry to place k + 1, and its column with it.
        pivot = k + 1 + np.argmax(a[:, k + 1:, k] != 0, axis=1)
        for swapped in (a, a.transpose(0, 2, 1)):
            row = swapped[at, pivot].copy()
            swapped[at, pivot] = swapped[:, k + 1]
            swapped[:, k + 1] = row
        u = a[:, k + 2:, k] * _inverse(a[:, k + 1, k], p)[:, None] % p1
        a[:, k + 2:] = (a[:, k + 2:] - u[:, :, None] * a[:, None, k + 1] % p2) % p2
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2:] * u[:, None] % p2).sum(2)) % p1
    # Polynomials of the leading blocks, by expansion along the last column.
    poly = np.zeros((many, d + 1, d + 1), np.int64)
    poly[:, 0, 0] = 1
    for k in range(1, d + 1):
        poly[:, k, 1:] = poly[:, k - 1, :-1]
        below = np.ones(many, np.int64)
        for i in range(k - 1, -1, -1):
            poly[:, k] = (poly[:, k] - (a[:, i, k - 1] * below % p)[:, None] * poly[:, i]) % p1
            below = below * a[:, i, i - 1] % p if i else below
    return poly[:, d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients, lowest first, of det(x - matrix), for a symmetric positive semidefinite matrix of integers."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    # The coefficients are, but for signs, sums of products of roots: together at most the product of (1 + root).
    bound = 2 * ((d + trace) ** d // d ** d + 1)
    moduli, product = [], 1
    for p in primes():
        if product > bound:
            break
        moduli.append(p)
        product *= p
    each = max(1, CELLS // (d * d))
    held = spark.sparkContext.broadcast(matrix)

    def run(batches):
        for batch in batches:
            own = batch.column("p").to_pylist()
            for a in range(0, len(own), each):
                found = polynomials_modulo(held.value, own[a: a + each])
                yield pa.RecordBatch.from_pydict({"p": pa.array(own[a: a + each], pa.int64()),
                                                  "c": pa.array(list(found), pa.list_(pa.int64()))})

    rows = (spark.createDataFrame([(p,) for p in moduli], "p long").repartition(math.ceil(len(moduli) / each))
            .mapInArrow(run, "p long, c array<long>").collect())
    out = [0] * (d + 1)
    for r in rows:
        rest = product // r.p
        unit = rest * pow(rest, -1, r.p)
        for i, c in enumerate(r.c):
            out[i] += c * unit
    return [c % product - product if 2 * (c % product) > product else c % product for c in out]


# --- integer polynomials, lowest coefficient first ----------------------------------------------------------------------------


def _primitive(f: list[int]) -> list[int]:
    while f and f[-1] == 0:
        f = f[:-1]
    g = math.gcd(*f) if f else 1
    return [c // g if f[-1] > 0 else -c // g for c in f]


def _remainder(f: list[int], g: list[int]) -> list[int]:
    """A multiple of the remainder of f by g, without common factors."""
    f = list(f)
    while len(f) >= len(g):
        top, shift = f[-1], len(f) - len(g)
        f = [c * g[-1] for c in f]
        for i, c in enumerate(g):
            f[i + shift] -= top * c
        f = f[:-1]
        while f and f[-1] == 0:
            f.pop()
    return _primitive(f)


def _gcd(f: list[int], g: list[int]) -> list[int]:
    f, g = _primitive(f), _primitive(g)
    while g:
        f, g = g, _remainder(f, g)
    return f


def _quotient(f: list[int], g: list[int]) -> list[int]:
    """f / g, which divides it; g is primitive."""
    f, out = list(f), [0] * (len(f) - len(g) + 1)
    for shift in range(len(out) - 1, -1, -1):
        out[shift] = f[shift + len(g) - 1] // g[-1]
        for i, c in enumerate(g):
            f[i + shift] -= out[shift] * c
    return out


def _derivative(f: list[int]) -> list[int]:
    return [i * c for i, c in enumerate(f)][1:]


def _square_free_modulo(f: list[int], p: int) -> bool:
    """Whether monic f has no repeated factor modulo p; then it has none at all."""
    g, h = [c % p for c in f], [c % p for c in _derivative(f)]
    while h and h[-1] == 0:
        h.pop()
    while h:
        inverse = pow(h[-1], -1, p)
        while len(g) >= len(h):
            q, shift = g[-1] * inverse % p, len(g) - len(h)
            for i, c in enumerate(h):
                g[i + shift] = (g[i + shift] - q * c) % p
            while g and g[-1] == 0:
                g.pop()
        g, h = h, g
    return len(g) == 1


def square_free_factors(f: list[int]) -> list[tuple[list[int], int]]:
    """(factor, multiplicity): factors without repeated or common roots whose powers multiply to f, which is monic."""
    if len(f) < 2:
        return []
    if _square_free_modulo(f, (1 << 61) - 1):
        return [(f, 1)]
    out, common = [], _gcd(f, _derivative(f))
    rest, many = _quotient(f, common), 1
    while len(rest) > 1:
        shared = _gcd(rest, common)
        own = _quotient(rest, shared)
        if len(own) > 1:
            out.append((own, many))
        rest, common, many = shared, _quotient(common, shared), many + 1
    return out


def roots_above(f: list[int], number: int, scale: int) -> int:
    """How many roots of f, all of which are real, are above number / 2**scale: the sign changes of f shifted to that point."""
    d = len(f) - 1
    g = [c << scale * (d - i) for i, c in enumerate(f)]  # its roots are 2**scale times those of f
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            g[j] += number * g[j + 1]
    signs = [c > 0 for c in g if c]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def _sign(f: list[int], number: int, scale: int) -> int:
    total, shift = 0, 0
    for c in reversed(f):
        total = total * number + (c << shift)
        shift += scale
    return (total > 0) - (total < 0)


class Root:
    """The ``place``-th largest root of a square-free f: above low / 2**scale and not above high / 2**scale, alone there."""

    def __init__(self, f: list[int], many: int, place: int, low: int, high: int, scale: int):
        self.f, self.many, self.place, self.low, self.high, self.scale = f, many, place, low, high, scale

    def refine(self, bits: int) -> None:
        """Halve the interval until its width is at most 2**-bits of its lower end."""
        while self.low != self.high and (self.high - self.low) << bits > self.low:
            self.low, self.high, self.scale = 2 * self.low, 2 * self.high, self.scale + 1
            middle = (self.low + self.high) // 2
            sign = _sign(self.f, middle, self.scale)
            if sign == 0:
                self.low = self.high = middle
            elif (sign < 0) == (self.place % 2 == 1):  # an odd number of larger roots makes f negative
                self.low = middle
            else:
                self.high = middle

    def value(self) -> Fraction:
        return Fraction(self.low + self.high, 2 << self.scale)


def isolated(f: list[int], many: int, top: int, wanted: int) -> list[Root]:
    """The ``wanted`` largest roots (all, if fewer) of square-free f, whose roots are all in (0, top], largest first."""
    out: list[Root] = []
    left = [(0, top, 0, len(f) - 1, 0)]  # intervals (low, high] with the number of roots above each end, leftmost first
    while left and len(out) < wanted:
        low, high, scale, above_low, above_high = left.pop()
        if above_low == above_high:
            continue
        if above_low - above_high == 1:
            out.append(Root(f, many, above_low, low, high, scale))
            continue
        if (low + high) % 2:
            low, high, scale = 2 * low, 2 * high, scale + 1
        middle = (low + high) // 2
        above = roots_above(f, middle, scale)
        left += [(low, middle, scale, above_low, above), (middle, high, scale, above, above_high)]
    return out


def largest_roots(polynomial: list[int], wanted: int, bits: int = 64) -> list[Root]:
    """The distinct nonzero roots that hold the ``wanted`` largest, counted as often as they repeat, and the one after them.

    ``polynomial`` is monic and all its roots are real and not negative. Each root is known to 2**-bits of itself, and further until
    no two intervals touch.
    """
    zeros = next(i for i, c in enumerate(polynomial) if c)
    f = polynomial[zeros:]
    if len(f) < 2:
        return []
    top = -f[-2]
    found = [r for g, many in square_free_factors(f) for r in isolated(g, many, top, wanted + 1)]
    while True:
        for r in found:
            r.refine(bits)
        found.sort(key=Root.value, reverse=True)
        if all(Fraction(b.high, 1 << b.scale) < Fraction(a.low, 1 << a.scale) for a, b in zip(found, found[1:])):
            break
        bits *= 2
    out, many = [], 0
    for r in found:
        out.append(r)
        if many >= wanted:
            break
        many += r.many
    return out


def null_space(matrix: list[list[int]], root: Decimal, many: int, digits: int) -> np.ndarray:
    """``many`` orthonormal vectors (rows, doubles) of the null space of matrix - root, by inverse iteration in ``digits`` digits.

    The largest component of each vector is positive."""
    with decimal.localcontext(prec=digits, Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN):
        d = len(matrix)
        whole = np.array([[Decimal(x) for x in row] for row in matrix], object).reshape(d, d)
        size = max(abs(x) for x in whole.ravel())
        lu, order = whole.copy(), list(range(d))
        for i in range(d):
            lu[i, i] -= root
        for k in range(d):
            pivot = max(range(k, d), key=lambda i: abs(lu[i, k]))
            if pivot != k:
                lu[[k, pivot]] = lu[[pivot, k]]
                order[k], order[pivot] = order[pivot], order[k]
            if lu[k, k] == 0:
                lu[k, k] = size.scaleb(-digits)
            if k + 1 < d:
                lu[k + 1:, k] = lu[k + 1:, k] / lu[k, k]
                lu[k + 1:, k + 1:] -= np.outer(lu[k + 1:, k], lu[k, k + 1:])
        # Any start will do that isn't orthogonal to the space.
        basis = np.array([[Decimal((i + 1) * 7919 + j * j * 104729 % 1009 + (i * j * 31) % 61) for j in range(d)]
                          for i in range(many)], object).reshape(many, d)
        limit = size.scaleb(-(digits * 2 // 3))
        for _ in range(8):
            for v in range(many):
                x = basis[v][order].copy()
                for i in range(1, d):
                    x[i] -= sum(lu[i, :i] * x[:i], Decimal(0))
                for i in range(d - 1, -1, -1):
                    x[i] = (x[i] - sum(lu[i, i + 1:] * x[i + 1:], Decimal(0))) / lu[i, i]
                for _ in range(2):
                    x = x / max(abs(c) for c in x)
                    for b in basis[:v]:
                        x = x - b * sum(b * x)
                basis[v] = x / sum(x * x).sqrt()
            if all(max(abs(c) for c in whole @ b - b * root) <= limit for b in basis):
                out = basis.astype(float)
                top = out[np.arange(many), np.abs(out).argmax(1)]
                return out * np.where(top < 0, -1.0, 1.0)[:, None]
    raise ArithmeticError("inverse iteration doesn't converge")


def principal_components(spark: SparkSession, matrix: list[list[int]], most: int) -> tuple[list[Fraction], np.ndarray]:
    """(eigenvalues, unit eigenvectors as rows) of the ``most`` largest nonzero eigenvalues, falling; fewer if the rank is less."""
    d = len(matrix)
    if not any(matrix[i][i] for i in range(d)):
        return [], np.zeros((0, d))
    found = largest_roots(characteristic_polynomial(spark, matrix), most)
    values = [r.value() for r in found]
    wanted, many = [], 0
    for i, r in enumerate(found):
        if many >= most:
            break
        # Vectors are as good as the digits beyond those of the size over the distance to the nearest other root.
        gaps = [abs(values[i] - values[j]) for j in (i - 1, i + 1) if 0 <= j < len(found)] + [values[i]]
        digits = 50 + 2 * len(str(values[0] // min(gaps)))
        r.refine(4 * digits)
        wanted.append((i, f"{r.value().numerator}/{r.value().denominator}", r.many, digits))
        many += r.many
    held = spark.sparkContext.broadcast(matrix)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with decimal.localcontext(prec=row["digits"] + 20):
                    over, under = row["root"].split("/")
                    root = Decimal(over) / Decimal(under)
                for i, v in enumerate(null_space(held.value, root, row["many"], row["digits"])):
                    yield pa.RecordBatch.from_pydict({"place": pa.array([row["place"]], pa.int64()),
                                                      "i": pa.array([i], pa.int64()), "v": pa.array([v], pa.list_(pa.float64()))})

    rows = (spark.createDataFrame(wanted, "place long, root string, many int, digits int").repartition(len(wanted))
            .mapInArrow(run, "place long, i long, v array<double>").collect())
    rows = sorted(rows, key=lambda r: (r.place, r.i))[:most]
    return [found[r.place].value() for r in rows], np.array([r.v for r in rows])
