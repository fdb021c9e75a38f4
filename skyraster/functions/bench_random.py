"""Repeatable pseudo-random numbers of an integer, as pure column arithmetic.

A linear congruential step modulo 2**30 applied ten times is again one linear step; its factor and
increment are composed here from the single step.  Inputs are reduced to their low 30 bits, which
keeps every product inside a LONG and does not change the result.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the generator: one step is (FACTOR * t + INCREMENT) mod 2**BITS.
FACTOR = 1103515245
INCREMENT = 12345
BITS = 30
STEPS = 10
NORM_TERMS = 12

MODULUS = 1 << BITS


def _compose(steps: int) -> tuple[int, int]:
    factor = pow(FACTOR, steps, MODULUS)
    increment = sum(INCREMENT * pow(FACTOR, k, MODULUS) for k in range(steps)) % MODULUS
    return factor, increment


def _low_bits(value: Column) -> Column:
    return value.bitwiseAND(F.lit(MODULUS - 1))


def bench_rand(t: Column) -> Column:
    """Uniform number in [0, 1), always the same for the same ``t``."""
    factor, increment = _compose(STEPS)
    state = _low_bits(F.lit(factor) * _low_bits(t.cast("long")) + F.lit(increment))
    return state.cast("double") / F.lit(float(MODULUS))


def _step(value: Column, limits: list[int], results: list[float]) -> Column:
    """results[k], where k of the sorted ``limits`` are at most ``value``: a halving search."""
    if not limits:
        return F.lit(results[0])
    middle = len(limits) // 2
    return F.when(value < F.lit(limits[middle]), _step(value, limits[:middle], results[: middle + 1])).otherwise(
        _step(value, limits[middle + 1 :], results[middle + 1 :])
    )


def bench_rand_norm(t: Column, factor_of_t: int = 1, shift: int = 0) -> Column:
    """Near-normal number of u = factor_of_t * t + shift, with mean 0 and deviation 1: the twelve
    uniforms of 12u .. 12u + 11, minus six.

    The twelve states are (s + c_i) mod 2**30 with one s and constant c_i, so their sum is
    12 s + sum(c_i) less 2**30 for every i that wraps around, and how many wrap is a step function of
    s.  All terms are multiples of 2**-30 below 16, so the doubles are exact.  The short form matters:
    generated methods over 8000 bytes of bytecode are not compiled by the JVM.
    """
    factor, increment = _compose(STEPS)
    shifts = [(factor * i + increment) % MODULUS for i in range(NORM_TERMS)]
    per_u = factor * NORM_TERMS
    s = _low_bits(F.lit(per_u * factor_of_t % MODULUS) * _low_bits(t.cast("long")) + F.lit(per_u * shift % MODULUS))
    offset = sum(shifts) / MODULUS - 6.0
    wrapped = _step(s, sorted(MODULUS - c for c in shifts), [offset - k for k in range(NORM_TERMS + 1)])
    return s.cast("double") * F.lit(NORM_TERMS / MODULUS) + wrapped
