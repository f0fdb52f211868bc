"""Phred scales and genotype likelihoods."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of probabilities before a logarithm is taken.
MAX_TRUE, MIN_ERROR = 1.0 - 1.25e-10, 1.25e-10


def phred_to_error(phred: Column) -> Column:
    return F.pow(F.lit(10.0), -phred / 10.0)


def phred_to_log10_error(phred: Column) -> Column:
    return -phred / 10.0


def log10_to_real(x: Column) -> Column:
    return F.pow(F.lit(10.0), x)


def log10_error_to_phred(x: Column) -> Column:
    return x * -10.0


def log10_error_to_rounded_phred(x: Column) -> Column:
    return F.abs(F.round(x * -10.0)).cast("int")


def error_to_phred(p: Column) -> Column:
    return F.log10(p) * -10.0


def error_to_rounded_phred(p: Column) -> Column:
    return log10_error_to_rounded_phred(F.log10(p))


def true_to_phred(p: Column) -> Column:
    """Phred of 1 - p, p being bounded below 1."""
    return F.log10(1.0 - F.least(p, F.lit(MAX_TRUE))) * -10.0


def bounded_log10(p: Column) -> Column:
    return F.log10(F.greatest(p, F.lit(MIN_ERROR)))


def bounded_log10s(probs: Column) -> Column:
    """bounded_log10 of each by the C library's logarithm.

    Where a probability is a tenth of the greatest, what truncation gives depends on a logarithm's last bit, and Spark's differs there.
    """

    @F.arrow_udf("array<double>")
    def logs(lists: pa.Array) -> pa.Array:
        # offsets of a list that isn't there are empty, so its place is enough
        ends = [0]
        for n in lists.value_lengths().to_pylist():
            ends.append(ends[-1] + (n or 0))
        found = pa.array([None if x is None else math.log10(x) for x in lists.flatten().to_pylist()], pa.float64())
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found, mask=lists.is_null())

    return logs(F.transform(probs, lambda p: F.greatest(p, F.lit(MIN_ERROR))))


def zero_shifted(likelihoods: Column) -> Column:
    """Likelihoods less their greatest."""
    return F.transform(likelihoods, lambda x: x - F.array_max(likelihoods))


def pl_of_likelihoods(likelihoods: Column) -> Column:
    """Phred distances from the greatest, truncated."""
    return F.transform(likelihoods, lambda x: ((x - F.array_max(likelihoods)) * -10.0).cast("int"))


def pl_of(probs: Column) -> Column:
    return F.get(F.transform(F.array(bounded_log10s(probs)), pl_of_likelihoods), 0)


def genotype_quality(probs: Column, index: Column) -> Column:
    return F.round(true_to_phred(F.get(probs, index))).cast("int")


def variant_quality(probs: Column, digits: int = 7) -> Column:
    """Phred of the probability that a genotype other than the first is true."""
    variant = F.least(F.aggregate(F.slice(probs, 2, F.greatest(F.size(probs) - 1, F.lit(1))), F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
    return F.round(true_to_phred(variant), digits)


def small_model_quality(p: Column) -> Column:
    """Phred of 1 - p with p bounded to [1e-7, 1 - 1e-7]."""
    return F.log10(1.0 - F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))) * -10.0


def normal_cdf(x: Column) -> Column:
    """By the polynomial 7.1.26 of Abramowitz and Stegun for the error function."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + z * 0.3275911)
    poly = ((((t * 1.061405429 - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1.0 - poly * F.exp(-z * z)
    return F.when(x < 0, (1.0 - erf) * 0.5).otherwise((1.0 + erf) * 0.5)
