"""Column expressions over dense vectors (array<float> or array<double>), computed in double.

Arrays must have equal lengths: ``zip_with`` pads the shorter with nulls, which
would turn every sum into null rather than compare prefixes silently.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(x: Column | str, y: Column | str) -> Column:
    return total(F.zip_with(doubles(x), doubles(y), lambda a, b: a * b))


def l2_distance(x: Column | str, y: Column | str) -> Column:
    """Squared Euclidean distance."""
    return total(F.zip_with(doubles(x), doubles(y), lambda a, b: (a - b) * (a - b)))


def neg_ip(x: Column | str, y: Column | str) -> Column:
    """Negated inner product: smaller is closer."""
    return -dot(x, y)


def norm(x: Column | str) -> Column:
    return F.sqrt(dot(x, x))


def cosine_distance(x: Column | str, y: Column | str) -> Column:
    """1 - cosine; null if a vector is zero."""
    return 1 - dot(x, y) / F.nullif(norm(x) * norm(y), F.lit(0.0))


def distance(metric: str, x: Column | str, y: Column | str) -> Column:
    return {"l2": l2_distance, "ip": neg_ip, "cosine": cosine_distance}[metric](x, y)


def normalized(x: Column | str) -> Column:
    """The vector over its norm; itself if that is under 1e-10."""
    n = norm(x)
    return F.when(n > 1e-10, F.transform(doubles(x), lambda a: a / n)).otherwise(doubles(x))


def minus(x: Column | str, y: Column | str) -> Column:
    return F.zip_with(doubles(x), doubles(y), lambda a, b: a - b)


def plus(x: Column | str, y: Column | str) -> Column:
    return F.zip_with(doubles(x), doubles(y), lambda a, b: a + b)


def signs(x: Column | str) -> Column:
    """1 where positive, else 0."""
    return F.transform(doubles(x), lambda a: (a > 0).cast("tinyint"))


def packed(bits: Column) -> Column:
    """Bits by eights to unsigned bytes, lowest first; the last is padded with zeros."""
    n = F.size(bits)
    return F.transform(
        F.sequence(F.lit(0), F.ceil(n / 8).cast("int") - 1),
        lambda i: F.aggregate(
            F.slice(bits, i * 8 + 1, F.lit(8)),
            F.struct(F.lit(0).alias("v"), F.lit(1).alias("w")),
            lambda a, b: F.struct((a["v"] + a["w"] * b.cast("int")).alias("v"), (a["w"] * 2).alias("w")),
            lambda a: a["v"],
        ),
    )


def unpacked(data: Column, dim: int) -> Column:
    """The first ``dim`` bits of what ``packed`` made."""
    bits = F.flatten(
        F.transform(data, lambda v: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.getbit(v.cast("bigint"), k).cast("tinyint")))
    )
    return F.slice(bits, 1, dim)


def binary_ip(query: Column | str, bits: Column) -> Column:
    """Inner product with +1 for set bits and -1 for others."""
    return total(F.zip_with(doubles(query), bits, lambda q, b: F.when(b == 1, q).otherwise(-q)))


def code_ip(query: Column | str, codes: Column) -> Column:
    """Inner product with integer codes."""
    return total(F.zip_with(doubles(query), codes, lambda q, c: q * c))
