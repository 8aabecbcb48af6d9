"""Scalar column functions of the engine."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stringloom.operators import kernels


def bit_length(v: Column) -> Column:
    """Place of the highest set bit, from 1; 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(v)))


def zigzag(v: Column) -> Column:
    return F.when(v < 0, -2 * v - 1).otherwise(2 * v)


def unzigzag(v: Column) -> Column:
    return F.when(v % 2 == 1, -F.floor((v + 1) / 2)).otherwise(F.floor(v / 2)).cast("bigint")


def positive_code(v: Column) -> Column:
    """As ``zigzag``, from 1, for coders that have no code for 0."""
    return zigzag(v) + 1


def from_positive_code(v: Column) -> Column:
    return unzigzag(v - 1)


def collapse_n(text: Column) -> Column:
    """Every run of N as one N."""
    return F.regexp_replace(text, "N+", "N")


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that two strings share from the start."""
    n = F.least(F.char_length(a), F.char_length(b))
    differing = F.filter(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.coalesce(F.array_min(differing) - 1, n)


@F.pandas_udf(T.StringType())
def fnv1a(values: pd.Series) -> pd.Series:
    """FNV-1a over an array of 64-bit values, as decimal text (it does not fit a signed long)."""
    return values.map(lambda x: None if x is None else str(kernels.fnv1a([int(v) & 0xFFFFFFFFFFFFFFFF for v in x])))
