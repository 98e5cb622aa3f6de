"""Complex arithmetic on pairs of double columns.

Spark has no complex type; keeping the two parts as plain doubles leaves all
arithmetic in generated code and lets ``sum`` aggregate them directly.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


def _minus(x: Column) -> Column:
    """Whether the sign of a number is set; comparisons take -0.0 for 0.0."""
    return (x < 0) | ((x == 0) & (F.pow(x, F.lit(-1.0)) < 0))


def atan2(y: Column, x: Column) -> Column:
    """Angle of (x, y) by the signs of zeros, which Spark's own function drops."""
    flat = F.when(_minus(y), -math.pi).otherwise(math.pi)
    return F.when((y == 0) & _minus(x), flat).otherwise(F.atan2(y, x))


def _divide(num: Column, den: Column) -> Column:
    """Quotient by a number of at least 0; by 0 it is infinite or no number."""
    return F.when(den == 0, num * F.lit(math.inf)).otherwise(F.try_divide(num, den))


class Cx(NamedTuple):
    """A complex valued column expression."""

    re: Column
    im: Column

    def plus(self, other: Cx) -> Cx:
        return Cx(self.re + other.re, self.im + other.im)

    def minus(self, other: Cx) -> Cx:
        return Cx(self.re - other.re, self.im - other.im)

    def times(self, other: Cx) -> Cx:
        return Cx(self.re * other.re - self.im * other.im,
                  self.re * other.im + self.im * other.re)

    def scaled(self, factor: Column) -> Cx:
        return Cx(self.re * factor, self.im * factor)

    def over(self, other: Cx) -> Cx:
        num, den = self.times(other.conj()), other.abs2()
        return Cx(_divide(num.re, den), _divide(num.im, den))

    def conj(self) -> Cx:
        return Cx(self.re, -self.im)

    def abs2(self) -> Column:
        return self.re * self.re + self.im * self.im

    def abs(self) -> Column:
        return F.sqrt(self.abs2())

    def arg(self) -> Column:
        return atan2(self.im, self.re)

    def power(self, n: int) -> Cx:
        """Integer power by repeated squaring."""
        if n < 0:
            return literal(1.0).over(self.power(-n))
        result, base = literal(1.0), self
        while n:
            if n & 1:
                result = result.times(base)
            base, n = base.times(base), n >> 1
        return result

    def pseudo_inverse(self) -> Cx:
        """conj(z) / abs(z)^2"""
        return literal(1.0).over(self)

    def struct(self) -> Column:
        return F.struct(self.re.alias("re"), self.im.alias("im"))


def col(re: str = "re", im: str = "im") -> Cx:
    return Cx(F.col(re), F.col(im))


def literal(z: complex) -> Cx:
    z = complex(z)
    return Cx(F.lit(z.real), F.lit(z.imag))


def cis(phase: Column) -> Cx:
    """exp(i * phase)"""
    return Cx(F.cos(phase), F.sin(phase))


def turns(cycles: Column) -> Cx:
    """exp(2 pi i * cycles)"""
    return cis(F.lit(2 * math.pi) * cycles)
