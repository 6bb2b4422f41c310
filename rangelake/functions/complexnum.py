"""Complex arithmetic on column pairs.

Spark has no complex type. A scalar is a ``Complex(re, im)`` of two columns; a
vector is two parallel ``array<double>`` columns.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Complex(NamedTuple):
    """A complex column expression."""

    re: Column
    im: Column

    def times(self, other: "Complex") -> "Complex":
        return Complex(
            self.re * other.re - self.im * other.im,
            self.re * other.im + self.im * other.re,
        )

    def plus(self, other: "Complex") -> "Complex":
        return Complex(self.re + other.re, self.im + other.im)

    def minus(self, other: "Complex") -> "Complex":
        return Complex(self.re - other.re, self.im - other.im)

    def scale(self, factor: Column) -> "Complex":
        return Complex(self.re * factor, self.im * factor)

    def conj(self) -> "Complex":
        return Complex(self.re, -self.im)

    def power(self) -> Column:
        return self.re * self.re + self.im * self.im

    def magnitude(self) -> Column:
        return F.sqrt(self.power())

    def phase(self) -> Column:
        return F.atan2(self.im, self.re)

    def log_magnitude(self) -> Column:
        """Magnitude of the complex natural logarithm."""
        ln = F.log(self.magnitude())
        return F.sqrt(ln * ln + self.phase() * self.phase())

    def total(self) -> "Complex":
        return Complex(F.sum(self.re), F.sum(self.im))

    def mean(self) -> "Complex":
        return Complex(F.avg(self.re), F.avg(self.im))


def cplx(re: str | Column, im: str | Column) -> Complex:
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    return Complex(as_col(re), as_col(im))


def unit_phase(angle: Column) -> Complex:
    """exp(j * angle)."""
    return Complex(F.cos(angle), F.sin(angle))


def vector_sum(left: Column, right: Column, op) -> Column:
    """Sum of op(left[i], right[i]) over two parallel arrays."""
    return F.aggregate(F.zip_with(left, right, op), F.lit(0.0), lambda acc, x: acc + x)


def vector_dot_conj(a_re: Column, a_im: Column, b_re: Column, b_im: Column) -> Complex:
    """Sum of a[i] * conj(b[i]) over array columns."""
    mul = lambda x, y: x * y
    return Complex(
        vector_sum(a_re, b_re, mul) + vector_sum(a_im, b_im, mul),
        vector_sum(a_im, b_re, mul) - vector_sum(a_re, b_im, mul),
    )
